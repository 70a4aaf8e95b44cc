"""Names for clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_PHRASES
from ..functions.text import is_generic_phrase, strip_subtitle
from ..functions.vectors import dot, l2_normalize
from ..session import cut
from .neighbours import TIE_PLACES, top_matches
from .vectors import Encoder, encode_rows


def candidate_phrases(
    terms: DataFrame, extra: Sequence[str] = (), token: str = "[A-Za-z0-9]+"
) -> DataFrame:
    """Distinct phrases of all clusters and the extras, defaults if there are none; no generic.

    A phrase without any ``token`` is generic; pass the terms' own pattern to keep all scripts.
    """
    spark = terms.sparkSession
    named = terms.select(F.col("term").alias("phrase"))
    if extra:
        named = named.union(spark.createDataFrame([(p,) for p in extra], "phrase string"))
    elif (named := cut(named.distinct(), "phrases")).isEmpty():  # the terms are counted once
        named = spark.createDataFrame([(p,) for p in DEFAULT_PHRASES], "phrase string")
    return named.distinct().where(~is_generic_phrase(F.col("phrase"), token=token))


def encode_phrases(phrases: DataFrame, encoder: Encoder, sep: str = "[SEP]") -> DataFrame:
    """phrase, vector through the same encoder as the papers, with an empty summary."""
    rows = phrases.select(F.col("phrase").alias("id"), F.concat("phrase", F.lit(sep)).alias("text"))
    return encode_rows(rows, encoder).select(F.col("id").alias("phrase"), "vector")


def rank_against_centroids(
    phrases: DataFrame, centroids: DataFrame, topk: int = 4, cid: str = "cid"
) -> DataFrame:
    """cid, phrase, sim, rank: the max(3, topk) phrases nearest to each centroid."""
    return top_matches(
        centroids, phrases, max(3, topk), cid, "phrase", "centroid", "vector"
    )


def top_phrases(ranked: DataFrame, cid: str = "cid") -> DataFrame:
    """cid, terms in rank order, confidence (similarity of the first)."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "phrase")))
    return ranked.groupBy(cid).agg(
        F.transform(listed, lambda e: e["phrase"]).alias("terms"), F.max("sim").alias("confidence")
    )


def representative(
    members: DataFrame, centroids: DataFrame, cid: str = "cid"
) -> DataFrame:
    """cid, title (without subtitle), confidence of the member nearest to its centroid."""
    scored = members.join(centroids, cid).withColumn(
        "_sim", dot(l2_normalize(F.col("vector")), F.col("centroid"))
    )
    order = F.struct((-F.round("_sim", TIE_PLACES)).alias("o"), "id")
    return scored.groupBy(cid).agg(
        F.min_by("title", order).alias("title"), F.max("_sim").alias("confidence")
    ).select(cid, strip_subtitle(F.col("title")).alias("title"), "confidence")


def unique_terms(ranked: DataFrame, sizes: DataFrame, cid: str = "cid") -> DataFrame:
    """cid, phrase: the best phrase each cluster gets when larger clusters choose first.

    Instead of walking the clusters one by one: every cluster asks for its best phrase not yet
    refused, a phrase accepts the largest asker (ties by id) and refuses the rest, until nobody
    is refused. As all phrases rank the askers alike, the outcome is that of the walk.
    """
    wishes = cut(ranked.join(sizes, cid).select(cid, "phrase", "rank", "size"), "wishes")
    refused: DataFrame | None = None
    while True:
        open_ = wishes if refused is None else wishes.join(refused, [cid, "phrase"], "left_anti")
        asks = open_.groupBy(cid, "size").agg(F.min_by("phrase", "rank").alias("phrase"))
        asks = cut(asks, "asks")
        winner = asks.groupBy("phrase").agg(
            F.min(F.struct((-F.col("size")).alias("o"), F.col(cid).alias("c"))).alias("w")
        )
        losers = asks.join(winner, "phrase").where(F.col("w.c") != F.col(cid)).select(cid, "phrase")
        losers = cut(losers, "refused")
        if losers.isEmpty():
            return asks.select(cid, "phrase")
        refused = losers if refused is None else refused.unionByName(losers)


def assign_labels(
    ranked: DataFrame,
    representatives: DataFrame,
    sizes: DataFrame,
    cosine_floor: float = 0.60,
    unique: bool = True,
    cid: str = "cid",
) -> DataFrame:
    """cid, label, confidence, terms for every cluster in ``sizes`` (cid, size).

    The label is the cluster's phrase; without one, or when its top similarity is under the
    floor, the representative title. The confidence of a phrase label is the top similarity even
    when a lower phrase was chosen, and a phrase taken by a cluster that then falls back stays
    taken.
    """
    ranked = cut(ranked, "ranked")
    firsts = ranked.where("rank = 1").select(cid, "phrase")
    chosen = unique_terms(ranked, sizes, cid) if unique else firsts
    rows = (
        sizes.select(cid)
        .join(top_phrases(ranked, cid).withColumnRenamed("confidence", "_top"), cid, "left")
        .join(chosen.withColumnRenamed("phrase", "_phrase"), cid, "left")
        .join(representatives.withColumnRenamed("confidence", "_rep"), cid, "left")
    )
    title = F.coalesce("title", F.lit("Cluster"))
    fallback = F.col("_phrase").isNull() | (F.coalesce("_top", F.lit(0.0)) < cosine_floor)
    return rows.select(
        cid,
        F.when(fallback, title).otherwise(F.col("_phrase")).alias("label"),
        F.when(fallback, F.coalesce("_rep", F.lit(0.0))).otherwise(F.col("_top")).alias("confidence"),
        F.when(fallback, F.array(title)).otherwise(F.col("terms")).alias("terms"),
    )


def label_rows(labels: DataFrame, method: str = "default", cid: str = "cid") -> DataFrame:
    """Rows for ``upsert`` into the label table by (method, cluster_id)."""
    return labels.select(
        F.lit(method).alias("method"),
        F.col(cid).cast("int").alias("cluster_id"),
        "label", "confidence", "terms",
        F.current_timestamp().alias("created_at"),
    )


# What a re-run replaces; the time of the first insert stays.
LABEL_COLUMNS = ["label", "confidence", "terms"]


def attach_labels(clusters: DataFrame, meta: DataFrame, method: str = "default") -> DataFrame:
    """Add the label of each cluster (NULL if none).

    Labels of ``method`` if there are any, else those of all methods, the newest per cluster.
    """
    present = meta.agg(F.coalesce(F.max(F.col("method") == method), F.lit(False))).scalar()
    usable = meta.withColumn("_only", present).where(~F.col("_only") | (F.col("method") == method))
    newest = usable.groupBy(F.col("cluster_id").alias("cid")).agg(
        F.max_by("label", F.struct("created_at", "method")).alias("label")
    )
    return clusters.join(newest, "cid", "left")
