"""Edges, degrees and neighbourhoods of the similarity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import rank_within


def cluster_sizes(papers: DataFrame, cid: str = "cid") -> DataFrame:
    return papers.groupBy(cid).agg(F.count(F.lit(1)).alias("size"))


def clusters(papers: DataFrame, cid: str = "cid") -> DataFrame:
    return papers.select(cid).distinct().orderBy(cid)


def union_edges(knn: DataFrame, mst: DataFrame, min_sim: float) -> DataFrame:
    """Undirected edges s < t, w; an edge found both ways or by both sources is kept once.

    One side listing the other is enough. Tree edges count from half of ``min_sim`` up; where
    both have an edge the neighbour's value stands.
    """

    def flat(df: DataFrame, source: int) -> DataFrame:
        return df.select(
            F.least("src", "dst").alias("s"),
            F.greatest("src", "dst").alias("t"),
            F.struct(F.lit(source).alias("source"), (-F.col("sim")).alias("o")).alias("e"),
        )

    both = flat(knn, 0).unionByName(flat(mst.where(F.col("sim") >= min_sim * 0.5), 1))
    return both.groupBy("s", "t").agg(F.min("e").alias("e")).select(
        "s", "t", (-F.col("e.o")).alias("w")
    )


def as_undirected(links: DataFrame) -> DataFrame:
    """Both directions of each edge: id, nbr, w."""
    out = links.select(F.col("s").alias("id"), F.col("t").alias("nbr"), "w")
    return out.unionByName(
        links.select(F.col("t").alias("id"), F.col("s").alias("nbr"), "w")
    )


def degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, deg of every node, 0 if isolated."""
    counts = as_undirected(links).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["deg"])


def adjacency(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, pos, nbr, w: each node's neighbours by falling weight (ties by id), one row each.

    A node without neighbours has one row with NULLs. The lists are rows, not arrays, and the
    positions come from a range sort, so a hub is never gathered in one place.
    """
    ranked = rank_within(as_undirected(links), ["id"], [F.col("w").desc(), F.col("nbr")])
    return nodes.select("id").join(ranked, "id", "left").select("id", "pos", "nbr", "w")


def _ids(*columns: str, value) -> Column:
    hit = F.col(columns[0]) == value
    for c in columns[1:]:
        hit = hit | (F.col(c) == value)
    return hit


def incident_edges(links: DataFrame, node) -> DataFrame:
    return links.where(_ids("s", "t", value=F.lit(node)))


def neighbors(nodes: DataFrame, links: DataFrame, node) -> DataFrame:
    """Neighbours of one node with their payload, by falling weight."""
    near = as_undirected(incident_edges(links, node)).where(F.col("id") == F.lit(node))
    near = near.select(F.col("nbr").alias("id"), "w")
    return near.join(nodes, "id").orderBy(F.col("w").desc(), F.col("id"))


def neighborhood(links: DataFrame, node) -> DataFrame:
    """The node and its direct neighbours."""
    own = links.sparkSession.range(1).select(F.lit(node).alias("id"))
    near = as_undirected(incident_edges(links, node)).where(F.col("id") == F.lit(node))
    return own.union(near.select(F.col("nbr").alias("id"))).distinct()
