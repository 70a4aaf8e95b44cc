"""The similarity graph, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_MODEL
from ..operators.blocks import BLOCK_ROWS
from ..operators.clustering import pca_coords
from ..operators.export import cluster_legend, graph_links, graph_nodes
from ..operators.gates import kept
from ..operators.graph import cluster_sizes, union_edges
from ..operators.layout import scale_to_canvas
from ..operators.neighbours import knn_join
from ..operators.ordering import dense_node_id
from ..operators.spanning import cluster_mst
from ..operators.vectors import for_model, missing_embeddings
from ..session import cut


@dataclass
class Graph:
    nodes: DataFrame
    links: DataFrame
    clusters: DataFrame
    meta: DataFrame


def numbered_papers(
    papers: DataFrame, emb: DataFrame, model: str | None = VECTOR_MODEL, cluster: str = "kmeans_cluster"
) -> DataFrame:
    """Kept and clustered papers with their node number and vector; all must have a vector."""
    rows = kept(papers, True, cluster).withColumn("cid", F.col(cluster))
    if rows.isEmpty():
        raise ValueError("no kept and clustered papers; filter and cluster first")
    missing = missing_embeddings(rows, emb, model).count()
    if missing:
        raise ValueError(f"{missing} papers have no vector; embed first")
    vectors = for_model(emb, model).select(F.col("paper_id").alias("id"), "vector")
    columns = ["id", "title", "authors", "published", "summary", "link", "domain_tag", "cid"]
    # Only the sort columns go through the sort; texts and vectors move once, by id.
    numbers = dense_node_id(rows.select("id", "cid", "published")).select("id", "node")
    return cut(rows.select(*columns).join(numbers, "id").join(vectors, "id"), "numbered")


def graph_edges(
    numbered: DataFrame,
    top_k: int = 5,
    min_sim: float = 0.85,
    same_cluster: bool = False,
    mst: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Neighbour edges and, for connectivity, the strong part of each cluster's tree: s, t, w."""
    within = "cid" if same_cluster else None
    near = knn_join(numbered, top_k, min_sim, within, "node", "vector", block_rows)
    if mst:
        tree = cluster_mst(numbered, "cid", min_sim * 0.5, "node", "vector", block_rows)
    else:
        tree = near.limit(0)
    return union_edges(near, tree, min_sim)


def build_graph(
    papers: DataFrame,
    emb: DataFrame,
    labels: DataFrame | None = None,
    top_k: int = 5,
    min_sim: float = 0.85,
    same_cluster: bool = False,
    mst: bool = True,
    coords: str = "pca",
    canvas: tuple[int, int, int] = (1000, 700, 24),
    compact: bool = True,
    include_summaries: bool = False,
    max_summary_len: int = 400,
    model: str | None = VECTOR_MODEL,
    cluster: str = "kmeans_cluster",
) -> Graph:
    """Nodes, links, cluster legend and generation facts; ``coords`` is "pca" or "none"."""
    if coords not in ("pca", "none"):
        raise ValueError("coords must be pca or none")
    numbered = numbered_papers(papers, emb, model, cluster)
    edges = cut(graph_edges(numbered, top_k, min_sim, same_cluster, mst), "links")
    placed = None
    w, h, pad = canvas
    facts = numbered.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("embedding_dim")
    ).first()
    if coords == "pca" and facts["n"] >= 2:
        placed = scale_to_canvas(pca_coords(numbered, "node", "vector"), w, h, pad)
    spark = papers.sparkSession
    meta = spark.range(1).select(
        F.lit(model).alias("model"),
        F.lit(facts["embedding_dim"]).alias("embedding_dim"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.struct(
            F.lit(top_k).alias("top_k"),
            F.lit(min_sim).alias("min_sim"),
            F.lit(same_cluster).alias("same_cluster_only"),
        ).alias("neighbors"),
        F.struct(
            F.lit(placed is not None).alias("included"),
            F.lit("pca" if placed is not None else "none").alias("method"),
            F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(pad).alias("pad")).alias("canvas"),
        ).alias("coords"),
        F.lit(compact).alias("compact"),
    )
    return Graph(
        graph_nodes(numbered, placed, compact, include_summaries, max_summary_len),
        graph_links(edges, numbered, compact),
        cluster_legend(cluster_sizes(numbered), labels),
        meta,
    )
