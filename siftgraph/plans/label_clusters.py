"""Cluster labels, end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_MODEL
from ..functions.text import assemble_text
from ..operators.gates import kept
from ..operators.graph import cluster_sizes
from ..operators.labels import (
    assign_labels,
    candidate_phrases,
    encode_phrases,
    rank_against_centroids,
    representative,
)
from ..operators.terms import cluster_tfidf, diverse_terms
from ..operators.vectors import Encoder, centroid, for_model
from ..session import cut


def label_clusters(
    papers: DataFrame,
    emb: DataFrame,
    encoder: Encoder,
    topk: int = 4,
    ngram_range: tuple[int, int] = (1, 3),
    min_df: int = 3,
    max_df: float = 0.6,
    extra: Sequence[str] = (),
    cosine_floor: float = 0.60,
    unique: bool = True,
    stopwords: Sequence[str] | None = None,
    model: str | None = VECTOR_MODEL,
    cluster: str = "kmeans_cluster",
) -> DataFrame:
    """cid, label, confidence, terms of every cluster of the kept papers."""
    rows = kept(papers, True, cluster).withColumn("cid", F.col(cluster))
    rows = rows.select("id", "title", "summary", "cid")
    text = assemble_text(F.col("title"), F.col("summary"), ". ")
    terms = diverse_terms(cluster_tfidf(rows, text, ngram_range, min_df, max_df, stopwords), topk)
    phrases = cut(encode_phrases(candidate_phrases(terms, extra), encoder), "phrases")
    vectors = for_model(emb, model).select(F.col("paper_id").alias("id"), "vector")
    members = rows.select("id", "title", "cid").join(vectors, "id")
    # Written out, so the planner sees its true size before it decides how to join it.
    centers = cut(centroid(members, ["cid"]), "centroids")
    return assign_labels(
        rank_against_centroids(phrases, centers, topk),
        representative(members, centers),
        cluster_sizes(rows),
        cosine_floor,
        unique,
    )
