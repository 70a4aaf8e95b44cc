"""Ranked text search over graph nodes (columns id, t, au, dm, sm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEGREE_BONUS, DEGREE_CAP, SEARCH_WEIGHTS
from ..functions.text import term_count


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def match_text(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose title, authors, domain or summary lines hold the whole query."""
    q = query.lower().strip()
    hay = F.concat_ws("\n", *[_lower(c) for c in SEARCH_WEIGHTS])
    return nodes.where(F.contains(hay, F.lit(q))) if q else nodes.limit(0)


def score_nodes(nodes: DataFrame, degrees: DataFrame, query: str) -> DataFrame:
    """Nodes with a hit, plus deg and score.

    Every term of the query counts in every field by its weight; a bonus for degree is added
    only where something matched. Counting precedes the join, so only hits are joined.
    """
    terms = query.lower().split()
    if not terms:
        return nodes.withColumns({"deg": F.lit(0).cast("long"), "score": F.lit(0.0)}).limit(0)
    base = F.lit(0.0)
    for name, weight in SEARCH_WEIGHTS.items():
        hits = F.lit(0).cast("long")
        for t in terms:
            hits = hits + term_count(_lower(name), F.lit(t))
        base = base + hits * F.lit(weight)
    hit = nodes.withColumn("_base", base).where(F.col("_base") > 0)
    joined = hit.join(degrees.select("id", "deg"), "id", "left").na.fill(0, ["deg"])
    bonus = F.least(F.col("deg"), F.lit(DEGREE_CAP)) * F.lit(DEGREE_BONUS)
    return joined.withColumn("score", F.col("_base") + bonus).drop("_base")


def search(nodes: DataFrame, degrees: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """The best hits, ties in node order."""
    return score_nodes(nodes, degrees, query).orderBy(F.col("score").desc(), "id").limit(limit)


def browse(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """All nodes by falling degree: the empty query."""
    joined = nodes.join(degrees.select("id", "deg"), "id", "left").na.fill(0, ["deg"])
    return joined.withColumn("score", F.lit(0.0)).orderBy(F.col("deg").desc(), "id")


def facet(results: DataFrame, cid: int) -> DataFrame:
    """One cluster of the results, taken after their cut."""
    return results.where(F.col("cid") == cid)
