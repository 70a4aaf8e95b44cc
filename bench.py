"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftgraph.plans.catalog import QUERIES
from siftgraph.session import local_session, release

# One or more of every stage: ingest, gates, upsert, vectors, neighbours, tree, clusters,
# terms, labels, graph, search, layout, export.
HEADLINE = [
    "harvest_records",
    "ingest",
    "keyword_gate",
    "keyword_gate_full",
    "stage1",
    "latest_per_key",
    "upsert_full",
    "upsert_partial",
    "read_table",
    "missing_embeddings",
    "embed_missing",
    "centroid_filter",
    "similarity_stats",
    "classifier_filter",
    "knn_global",
    "knn_in_cluster",
    "cluster_mst",
    "kmeans",
    "ward",
    "density_cluster",
    "assign_nearest",
    "pca_coords",
    "document_frequency",
    "tfidf",
    "diverse_terms",
    "representative",
    "phrase_ranking",
    "label_clusters",
    "adjacency",
    "dense_node_id",
    "search",
    "build_graph_tree_links",
    "grid_pairs",
    "decollide",
    "summary_lookup",
    "export_graph",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["kept"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    total = round(sum(times.values()), 3)
    line = {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
