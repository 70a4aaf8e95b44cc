"""First-stage gates: which records become candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (
    FALLBACK_PATTERN,
    KEYWORD_PATTERNS,
    POLICY_CATEGORIES,
    POLICY_PREFIXES,
)
from ..functions.text import any_prefix, assemble_text, domain_tag, words

# i: no case; d: only a line feed ends a line, so "." crosses "\r".
_FLAGS = "(?id)"
# U: Unicode classes and case. It changes nothing on pure ASCII text but costs time there.
_UNICODE_FLAGS = "(?idU)"


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def one_pattern(patterns: Sequence[str]) -> str:
    """All patterns as one, with a leading word boundary they share tested once per position."""
    parts = [a for p in patterns for a in _alternatives(p)]
    at_word = [p[2:] for p in parts if p.startswith(r"\b")]
    rest = [p for p in parts if not p.startswith(r"\b")]
    head = [r"\b(?:" + "|".join(at_word) + ")"] if at_word else []
    return "|".join([*head, *rest])


def _matches(text: Column, pattern: str) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text.rlike(_FLAGS + pattern)).otherwise(
        text.rlike(_UNICODE_FLAGS + pattern)
    )


def keyword_hit(
    title: Column, summary: Column, patterns: Sequence[str] = KEYWORD_PATTERNS
) -> Column:
    """One regex over title, line feed, summary; compiled once per task."""
    return _matches(assemble_text(title, summary, "\n"), one_pattern(patterns))


def category_hit(
    categories: Column,
    exact: Sequence[str] = POLICY_CATEGORIES,
    prefixes: Sequence[str] = POLICY_PREFIXES,
) -> Column:
    listed = F.arrays_overlap(words(categories), F.array(*[F.lit(c) for c in exact]))
    return any_prefix(categories, prefixes) | listed


def fallback_hit(
    title: Column,
    summary: Column,
    categories: Column,
    keyword: Column,
    pattern: str = FALLBACK_PATTERN,
    exact: Sequence[str] = POLICY_CATEGORIES,
    prefixes: Sequence[str] = POLICY_PREFIXES,
) -> Column:
    """The looser pattern, tried only where the keywords missed and the category fits."""
    loose = _matches(assemble_text(title, summary, " "), one_pattern([pattern]))
    return F.when(~keyword & category_hit(categories, exact, prefixes), loose).otherwise(False)


def keyword_gate(df: DataFrame, patterns: Sequence[str] = KEYWORD_PATTERNS) -> DataFrame:
    return df.where(keyword_hit(F.col("title"), F.col("summary"), patterns))


def category_gate(
    df: DataFrame,
    exact: Sequence[str] = POLICY_CATEGORIES,
    prefixes: Sequence[str] = POLICY_PREFIXES,
) -> DataFrame:
    return df.where(category_hit(F.col("categories"), exact, prefixes))


# What a re-run of the gate refreshes on a paper already known; all else on it stays.
STAGE1_COLUMNS = [
    "title", "authors", "published", "summary", "link", "ai_regex_hit", "domain_tag",
]


def stage1(
    raw: DataFrame,
    keep_all: bool = False,
    patterns: Sequence[str] = KEYWORD_PATTERNS,
    fallback: str = FALLBACK_PATTERN,
    exact: Sequence[str] = POLICY_CATEGORIES,
    prefixes: Sequence[str] = POLICY_PREFIXES,
    tag: Column | None = None,
) -> DataFrame:
    """Candidates of the first stage: one narrow pass over the raw records.

    A row passes on the keywords or on the fallback; the stored flag is the keywords alone.
    """
    flagged = raw.withColumn(
        "_keyword", keyword_hit(F.col("title"), F.col("summary"), patterns)
    )
    if not keep_all:
        second = fallback_hit(
            F.col("title"), F.col("summary"), F.col("categories"), F.col("_keyword"),
            fallback, exact, prefixes,
        )
        flagged = flagged.where(F.col("_keyword") | second)
    return flagged.select(
        "id", "title", "authors", "published", "summary", "link",
        F.col("_keyword").cast("int").alias("ai_regex_hit"),
        (tag if tag is not None else domain_tag(F.col("categories"))).alias("domain_tag"),
    )


def kept(papers: DataFrame, clustered: bool = False, cluster: str = "kmeans_cluster") -> DataFrame:
    """Papers the second stage kept, optionally only those with a cluster."""
    rows = papers.where(F.col("ai_stage2_keep") == 1)
    return rows.where(F.col(cluster).isNotNull()) if clustered else rows
