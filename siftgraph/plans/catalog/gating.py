"""Gates and text scalars over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import text as tx
from ...functions.fixed import KEYWORD_PATTERNS
from ...operators import gates
from .base import clustered, papers, query, table

PATTERNS = [r"\blicen[sc]e\b", r"copyright", r"\btoken\b.*\b[0-9a-f]{8}", r"\bthe\b.*\bmentos?\b"]
FALLBACK = r"\b(el|la|thin)s?\b"
EXACT = ["src7", "src11"]
PREFIXES = ["lang.fr"]

# RE2 word boundaries are ASCII; these spell out the Unicode ones.
_B = r"(^|[^\p{L}\p{N}_])"
_E = r"($|[^\p{L}\p{N}_])"
_GAP = r"([^\p{L}\p{N}_\n]|[^\p{L}\p{N}_\n].*[^\p{L}\p{N}_\n])"
_KEYWORD = (
    rf"(?i){_B}licen[sc]e{_E}|copyright|{_B}token{_GAP}[0-9a-f]{{8}}|{_B}the{_GAP}mentos?{_E}"
)
_HIT = f"regexp_matches(title || chr(10) || summary, '{_KEYWORD}')"
_CATEGORY = (
    "(list_has_any(regexp_split_to_array(categories, '\\s+'), ['src7', 'src11']) OR lang = 'fr')"
)
_LOOSE = f"regexp_matches(title || ' ' || summary, '(?i){_B}(el|la|thin)s?{_E}')"
_TAG = """CASE WHEN lang IN ('fr', 'de') AND starts_with(source, 'src1') THEN 'both'
  WHEN lang IN ('fr', 'de') THEN 'gov' WHEN starts_with(source, 'src1') THEN 'tech' ELSE 'unknown' END"""


@query("keyword_gate", f"SELECT id FROM papers WHERE {_HIT}", "papers")
def keyword_gate(spark, sf):
    return gates.keyword_gate(papers(spark, sf), PATTERNS).select("id")


@query("category_gate", f"SELECT id FROM papers WHERE {_CATEGORY}", "papers")
def category_gate(spark, sf):
    return gates.category_gate(papers(spark, sf), EXACT, PREFIXES).select("id")


@query(
    "fallback_gate",
    f"SELECT id, CASE WHEN NOT {_HIT} AND {_CATEGORY} THEN {_LOOSE} ELSE false END AS hit FROM papers",
    "papers",
)
def fallback_gate(spark, sf):
    df = papers(spark, sf).withColumn(
        "_k", gates.keyword_hit(F.col("title"), F.col("summary"), PATTERNS)
    )
    hit = gates.fallback_hit(
        F.col("title"), F.col("summary"), F.col("categories"), F.col("_k"), FALLBACK, EXACT, PREFIXES
    )
    return df.select("id", hit.alias("hit"))


def _tag():
    return tx.domain_tag(F.col("categories"), ["lang.fr", "lang.de"], ["src1"])


@query("domain_tag", f"SELECT id, {_TAG} AS tag FROM papers", "papers")
def domain_tag(spark, sf):
    return papers(spark, sf).select("id", _tag().alias("tag"))


def _stage1(spark, sf, keep_all):
    rows = gates.stage1(papers(spark, sf), keep_all, PATTERNS, FALLBACK, EXACT, PREFIXES, _tag())
    return rows.select("id", "ai_regex_hit", "domain_tag", F.md5("summary").alias("summary_md5"))


_STAGE1 = f"SELECT id, CAST({_HIT} AS INTEGER) AS ai_regex_hit, {_TAG} AS domain_tag, md5(summary) AS summary_md5 FROM papers"


@query("stage1", f"{_STAGE1} WHERE {_HIT} OR ({_CATEGORY} AND {_LOOSE})", "papers")
def stage1(spark, sf):
    return _stage1(spark, sf, False)


@query("stage1_keep_all", _STAGE1, "papers")
def stage1_keep_all(spark, sf):
    return _stage1(spark, sf, True)


_ALL = "|".join(KEYWORD_PATTERNS)


@query(
    "keyword_gate_full",
    f"""SELECT lang, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(
      title || chr(10) || summary, '(?i){_ALL}')) AS hits FROM papers GROUP BY lang""",
    "papers",
)
def keyword_gate_full(spark, sf):
    """The full fixed pattern list over whole texts."""
    hit = gates.keyword_hit(F.col("title"), F.col("summary"))
    return papers(spark, sf).groupBy(F.substring("categories", 6, 2).alias("lang")).agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(hit).alias("hits")
    )


@query("kept", "SELECT id, cid FROM clustered", "clustered")
def kept(spark, sf):
    return gates.kept(clustered(spark, sf), clustered=True).select("id", "cid")


@query(
    "assemble_text",
    "SELECT id, md5(title || '[SEP]' || coalesce(nullif(summary, ''), '')) AS body, length(title || '. ' || summary) AS chars FROM papers",
    "papers",
)
def assemble_text(spark, sf):
    t, s = F.col("title"), F.nullif(F.col("summary"), F.lit(""))
    return papers(spark, sf).select(
        "id",
        F.md5(tx.assemble_text(t, s, "[SEP]")).alias("body"),
        F.length(tx.assemble_text(t, s, ". ")).cast("long").alias("chars"),
    )


@query(
    "ellipsize",
    r"""SELECT id, CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '…' ELSE s END AS sm
    FROM (SELECT id, regexp_replace(summary, '^\s+|\s+$', '', 'g') AS s FROM papers)""",
    "papers",
)
def ellipsize(spark, sf):
    return papers(spark, sf).select("id", tx.ellipsize(F.col("summary"), 400).alias("sm"))


@query(
    "strip_subtitle",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, ':[^\n]*$', ''), '^\s+|\s+$', '', 'g') AS short FROM pages""",
)
def strip_subtitle(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.strip_subtitle(F.col("url")).alias("short")
    )


@query(
    "canonical_url",
    "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages",
)
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query(
    "term_count",
    "SELECT id, (length(lower(summary)) - length(replace(lower(summary), 'tion', ''))) // 4 AS n FROM papers",
    "papers",
)
def term_count(spark, sf):
    return papers(spark, sf).select(
        "id", tx.term_count(F.lower("summary"), F.lit("tion")).alias("n")
    )


_GENERIC_SQL = """SELECT p_partkey, len(toks) = 0 OR len(list_filter(toks, lambda t: NOT list_contains(
  ['ring', 'widget', 'red'], CASE WHEN ends_with(t, 's') AND length(t) > 3 THEN substr(t, 1, length(t) - 1) ELSE t END))) = 0 AS generic
FROM (SELECT p_partkey, regexp_extract_all(lower(p_name || 's'), '[a-z0-9]+') AS toks FROM part)"""


@query("generic_phrase", _GENERIC_SQL)
def generic_phrase(spark, sf):
    phrase = F.concat("p_name", F.lit("s"))
    return table(spark, sf, "part").select(
        "p_partkey", tx.is_generic_phrase(phrase, ["ring", "widget", "red"]).alias("generic")
    )


@query(
    "terms_json",
    """SELECT id, '["' || array_to_string(list_sort(list_distinct([lang, source])), '","') || '"]' AS terms, 2 AS n
    FROM papers""",
    "papers",
)
def terms_json(spark, sf):
    terms = F.array_sort(F.array(F.substring("categories", 6, 2), "authors"))
    df = papers(spark, sf).select("id", tx.terms_json(terms).alias("terms"))
    return df.withColumn("n", F.size(tx.terms_from_json(F.col("terms"))))
