"""Text scalars as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (
    GENERIC_WORDS,
    GOVERNANCE_PREFIXES,
    TECHNICAL_PREFIXES,
)

# Whitespace as Python and browsers see it: the Unicode property plus the four separators.
_BLANK = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Strip every kind of whitespace (SQL trim strips spaces only)."""
    return F.regexp_replace(c, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def words(c: Column) -> Column:
    """Split on runs of whitespace; NULL and blank give an empty array."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), rf"(?U){_BLANK}+")
    return F.filter(parts, lambda w: w != "")


def any_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    """True when one of the words in ``c`` starts with one of ``prefixes``."""

    def starts(w: Column) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(w, F.lit(p))
        return hit

    return F.exists(words(c), starts)


def domain_tag(
    categories: Column,
    governance: Sequence[str] = GOVERNANCE_PREFIXES,
    technical: Sequence[str] = TECHNICAL_PREFIXES,
) -> Column:
    gov, tech = any_prefix(categories, governance), any_prefix(categories, technical)
    return (
        F.when(gov & tech, "both").when(gov, "gov").when(tech, "tech").otherwise("unknown")
    )


def assemble_text(title: Column, summary: Column, sep: str) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(summary, F.lit("")))


def is_generic_phrase(
    phrase: Column, stoplist: Sequence[str] = GENERIC_WORDS, token: str = "[A-Za-z0-9]+"
) -> Column:
    """True when the phrase has no word outside the stop list (or no word at all).

    ``token`` says what a word is; by default other letters than a to z are none.
    """
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(phrase, F.lit(""))), F.lit(token), F.lit(0)
    )
    known = F.array(*[F.lit(w) for w in stoplist])

    def singular(t: Column) -> Column:
        plural = F.endswith(t, F.lit("s")) & (F.length(t) > 3)
        return F.when(plural, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    return F.forall(tokens, lambda t: F.array_contains(known, singular(t)))


def ellipsize(c: Column, n: int) -> Column:
    s = strip(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def strip_subtitle(title: Column) -> Column:
    """Cut a colon and what follows it on the last line."""
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?d):.*$", ""))


def terms_json(terms: Column) -> Column:
    return F.to_json(terms)


def terms_from_json(c: Column) -> Column:
    return F.from_json(c, "array<string>")


_WEB_URL = r"(?is)\A\s*(https?)://([^/?#@]*@)?([^/?#@:]+)(:[0-9]*)?([^?#]*).*\z"


def canonical_url(url: Column) -> Column:
    """Drop query and fragment; web URLs also get a lower-case host, no default port and a path.

    What is no URL (no scheme) stays as it is.
    """
    scheme = F.lower(F.regexp_extract(url, _WEB_URL, 1))
    port = F.regexp_extract(url, _WEB_URL, 4)
    default_port = (
        port.isin("", ":")
        | ((scheme == "http") & (port == ":80"))
        | ((scheme == "https") & (port == ":443"))
    )
    path = strip(F.regexp_extract(url, _WEB_URL, 5))
    web = F.concat(
        scheme,
        F.lit("://"),
        F.regexp_extract(url, _WEB_URL, 2),
        F.lower(F.regexp_extract(url, _WEB_URL, 3)),
        F.when(default_port, "").otherwise(port),
        F.when(path == "", "/").otherwise(path),
    )
    other = F.regexp_replace(strip(url), r"(?s)[?#].*\z", "")
    return (
        F.when(url.rlike(_WEB_URL), web)
        .when(url.rlike(r"(?i)\A\s*https?:"), url)
        .when(url.rlike(r"(?i)\A\s*[a-z][a-z0-9+.\-]*:"), other)
        .otherwise(url)
    )


def term_count(hay: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal term."""
    removed = F.length(hay) - F.length(F.replace(hay, term, F.lit("")))
    return (removed / F.length(term)).cast("long")
