"""How the test tables stand in for papers and vectors, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names the shared SQL parts its SQL builds on."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            parts = _needed(ctes.split())
            head = ("WITH RECURSIVE " + ",\n".join(parts) + "\n") if parts else ""
            ORACLES[name] = head + sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers: first line as title, the rest as summary."""
    cut = F.instr("text", "\n")
    day = F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("n_chars") % 1500).cast("int"))
    return read_table(spark, f"{sf}/documents.parquet", spread=True).select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("summary"),
        F.col("source").alias("authors"),
        F.date_format(day, "yyyy-MM-dd").alias("published"),
        F.concat(F.lit("lang."), "lang", F.lit("  "), "source").alias("categories"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://docs.example.org/"), "doc_id")).alias("link"),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("paper_id"),
        F.lit("specter2").alias("model"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("cid"),
    )


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """All papers, with their vector's label as cluster; without a vector, the id's last digit."""
    near = embeddings(spark, sf).select(F.col("paper_id").alias("id"), "cid")
    digit = F.pmod("id", F.lit(10)).cast(near.schema["cid"].dataType)
    return (
        papers(spark, sf)
        .join(near, "id", "left")
        .withColumn("cid", F.coalesce("cid", digit))
        .withColumns(
            {
                "kmeans_cluster": F.col("cid"),
                "ai_stage2_keep": F.lit(1),
                "domain_tag": F.element_at(F.split("categories", " +"), 1),
            }
        )
    )


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


# Shared SQL parts by name; a part may build on those before it.
_PARTS: dict[str, tuple[str, str]] = {
    "papers": (
        "",
        """papers AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary,
    source AS authors,
    strftime(DATE '2020-01-01' + CAST(n_chars % 1500 AS INTEGER), '%Y-%m-%d') AS published,
    'lang.' || lang || '  ' || source AS categories, lang, source,
    CASE WHEN lang = 'en' THEN 'https://docs.example.org/' || doc_id END AS link
  FROM documents)""",
    ),
    "unit": (
        "",
        """unit AS (
  SELECT id, cid, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u
  FROM (SELECT vec_id AS id, label AS cid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""",
    ),
    "clustered": (
        "papers",
        """clustered AS (
  SELECT p.*, coalesce(e.label, CAST((p.id % 10 + 10) % 10 AS INTEGER)) AS cid, 'lang.' || lang AS domain_tag
  FROM papers p LEFT JOIN embeddings e ON e.vec_id = p.id)""",
    ),
    "seeds": ("", "seeds AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)"),
    "center": (
        "unit seeds",
        """center_parts AS (
  SELECT pos, avg(x) AS m FROM (
    SELECT unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit WHERE id IN (SELECT id FROM seeds))
  GROUP BY pos),
center AS (
  SELECT list(m / (n + 1e-12) ORDER BY pos) AS c
  FROM center_parts, (SELECT sqrt(sum(m * m)) AS n FROM center_parts))""",
    ),
    "scored": (
        "papers center",
        """scored AS (
  SELECT p.id, list_dot_product(u, (SELECT c FROM center)) AS sim
  FROM papers p LEFT JOIN unit USING (id))""",
    ),
    "centroids": (
        "unit",
        """centroid_parts AS (
  SELECT cid, pos, avg(x) AS m FROM (
    SELECT cid, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit) GROUP BY cid, pos),
centroids AS (
  SELECT cid, list(m / (n + 1e-12) ORDER BY pos) AS c
  FROM centroid_parts JOIN (SELECT cid, sqrt(sum(m * m)) AS n FROM centroid_parts GROUP BY cid) USING (cid)
  GROUP BY cid)""",
    ),
    "pairs": (
        "unit",
        """pairs AS (
  SELECT a.id AS src, b.id AS dst, a.cid AS cid, b.cid AS other, list_dot_product(a.u, b.u) AS sim
  FROM unit a JOIN unit b ON a.id <> b.id)""",
    ),
    "knn": (
        "pairs",
        """knn AS (
  SELECT src, dst, sim FROM pairs WHERE sim >= 0.30
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) <= 5)""",
    ),
    "links": (
        "knn",
        """links AS (
  SELECT least(src, dst) AS s, greatest(src, dst) AS t, max(sim) AS w FROM knn GROUP BY 1, 2)""",
    ),
    "both": (
        "links",
        "both_ways AS (SELECT s AS id, t AS nbr, w FROM links UNION ALL SELECT t, s, w FROM links)",
    ),
    "nodes": (
        "clustered",
        """numbered AS (
  SELECT row_number() OVER (ORDER BY cid, published DESC, id) - 1 AS node, * FROM clustered),
nodes AS (
  SELECT id, title AS t, authors AS au, domain_tag AS dm, summary AS sm, cid FROM clustered)""",
    ),
    "vectored": (
        "clustered",
        """numbered AS (
  SELECT row_number() OVER (ORDER BY cid, published DESC, id) - 1 AS node, * FROM clustered
  WHERE id IN (SELECT vec_id FROM embeddings))""",
    ),
    "degrees": (
        "nodes both",
        """degrees AS (
  SELECT n.id, count(b.nbr) AS deg FROM nodes n LEFT JOIN both_ways b USING (id) GROUP BY n.id)""",
    ),
    "hits": (
        "degrees",
        r"""counted AS (
  SELECT n.id, n.cid, d.deg,
    list_sum(list_transform(['tion', 'en'], lambda q:
      3.0 * ((length(lower(t)) - length(replace(lower(t), q, ''))) // length(q))
      + 2.0 * ((length(lower(au)) - length(replace(lower(au), q, ''))) // length(q))
      + 1.5 * ((length(lower(dm)) - length(replace(lower(dm), q, ''))) // length(q))
      + 1.0 * ((length(lower(sm)) - length(replace(lower(sm), q, ''))) // length(q)))) AS base
  FROM nodes n JOIN degrees d USING (id)),
hits AS (SELECT id, cid, deg, CAST(base AS DOUBLE) + CAST(least(deg, 50) * 0.02 AS DOUBLE) AS score FROM counted WHERE base > 0)""",
    ),
    "terms": (
        "clustered",
        r"""words AS (
  SELECT id, list_filter(
    regexp_extract_all(strip_accents(lower(title || '. ' || summary)), '[\p{L}\p{N}_]{2,}'),
    lambda w: w NOT IN ('the', 'of', 'and', 'la', 'de')) AS w
  FROM clustered),
grams AS (
  SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM words),
counts AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocabulary AS (
  SELECT term, count(*) AS df FROM counts GROUP BY term
  HAVING count(*) >= 6 AND count(*) <= 0.6 * (SELECT count(*) FROM clustered))""",
    ),
    "weights": (
        "terms",
        """raw AS (
  SELECT id, term, tf, df,
    tf * (ln((1.0 + (SELECT count(*) FROM clustered)) / (1.0 + df)) + 1.0) AS r
  FROM counts JOIN vocabulary USING (term)),
weights AS (SELECT id, term, tf, df, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS weight FROM raw),
cluster_terms AS (
  SELECT cid, term, sum(weight) / any_value(size) AS weight
  FROM weights JOIN clustered USING (id)
  JOIN (SELECT cid, count(*) AS size FROM clustered GROUP BY cid) USING (cid)
  GROUP BY cid, term)""",
    ),
    "phrases": (
        "centroids",
        """phrases AS (
  SELECT cid, phrase, sim, rank FROM (
    SELECT c.cid, p.id AS phrase, list_dot_product(p.u, c.c) AS sim,
      row_number() OVER (PARTITION BY c.cid ORDER BY round(list_dot_product(p.u, c.c), 9) DESC, p.id) AS rank
    FROM centroids c, unit p) WHERE rank <= 4)""",
    ),
    "reps": (
        "clustered centroids",
        """reps AS (
  SELECT p.cid, arg_min(p.title, (-round(list_dot_product(u, c), 9), p.id)) AS full_title,
    max(list_dot_product(u, c)) AS confidence
  FROM clustered p JOIN unit ON unit.id = p.id JOIN centroids ON centroids.cid = p.cid GROUP BY p.cid)""",
    ),
}


# Grows one tree per cluster, an edge a step: the strongest edge from inside to outside.
MST = """start AS (SELECT cid, min(id) AS root FROM unit GROUP BY cid),
grow AS (
  SELECT cid, [root] AS seen, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst,
    CAST(NULL AS DOUBLE) AS sim FROM start
  UNION ALL
  SELECT g.cid, list_append(g.seen, b.e.dst), least(b.e.src, b.e.dst), greatest(b.e.src, b.e.dst), b.e.sim
  FROM grow g JOIN LATERAL (
    SELECT arg_max({'src': p.src, 'dst': p.dst, 'sim': p.sim}, p.sim) AS e FROM pairs p
    WHERE p.cid = g.cid AND p.other = g.cid AND list_contains(g.seen, p.src)
      AND NOT list_contains(g.seen, p.dst)) b ON b.e IS NOT NULL)
"""


def _needed(names: list[str]) -> list[str]:
    found: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in found:
            return
        before, text = _PARTS[name]
        for n in before.split():
            visit(n)
        found[name] = text

    for name in names:
        visit(name)
    return list(found.values())
