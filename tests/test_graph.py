import gzip
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgraph.operators import export, graph, layout, ordering, search
from siftgraph.sources import sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def links(spark, data):
    return spark.createDataFrame(data, "s int, t int, w double")


def nodes(spark, n=6):
    data = [(i, f"Title {'aaaaa' if i == 1 else i}", "Ann", "tech", "text" if i else None, i % 2) for i in range(n)]
    return spark.createDataFrame(data, "id int, t string, au string, dm string, sm string, cid int")


def test_union_edges(spark):
    knn = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 1, 0.86)], "src int, dst int, sim double")
    mst = spark.createDataFrame([(1, 2, 0.5), (4, 2, 0.43), (4, 3, 0.42)], "src int, dst int, sim double")
    assert rows(graph.union_edges(knn, mst, 0.86)) == [(1, 2, 0.9), (1, 3, 0.86), (2, 4, 0.43)]


def test_degree_and_adjacency(spark):
    edges = links(spark, [(0, 1, 0.5), (0, 2, 0.9), (0, 3, 0.9)])
    assert rows(graph.degree(nodes(spark, 5), edges)) == [(0, 3), (1, 1), (2, 1), (3, 1), (4, 0)]
    listed = graph.adjacency(nodes(spark, 5), edges)
    assert rows(listed.where("id = 0"), "pos", "nbr", "w") == [(0, 2, 0.9), (1, 3, 0.9), (2, 1, 0.5)]
    assert rows(listed.where("id = 4"), "pos", "nbr") == [(None, None)]
    assert [r["id"] for r in graph.neighbors(nodes(spark), edges, 0).collect()] == [2, 3, 1]
    assert rows(graph.neighborhood(edges, 2)) == [(0,), (2,)]
    assert rows(graph.incident_edges(edges, 2), "s", "t") == [(0, 2)]


def test_numbering_is_dense_over_hot_keys(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 50 = 0 as int) as cid", "cast(500 - id as string) as published")
    spread = df.repartition(7)
    got = {r["id"]: r["node"] for r in ordering.dense_node_id(spread).collect()}
    order = sorted(df.collect(), key=lambda r: r["id"])
    order.sort(key=lambda r: r["published"], reverse=True)
    order.sort(key=lambda r: r["cid"])
    assert [got[r["id"]] for r in order] == list(range(500))
    ranked = ordering.rank_within(spread, ["cid"], [F.col("id")])
    assert rows(ranked.where("cid = 1"), "pos", "id") == [(i, i * 50) for i in range(10)]


def test_search(spark):
    n = nodes(spark)
    deg = spark.createDataFrame([(i, 60 if i == 1 else i) for i in range(6)], "id int, deg long")
    scores = {r["id"]: r["score"] for r in search.score_nodes(n, deg, " AA title ").collect()}
    assert scores[1] == pytest.approx(2 * 3 + 3 + 50 * 0.02) and scores[0] == 3.0
    assert search.score_nodes(n, deg, "zzz").count() == 0 and search.score_nodes(n, deg, "  ").count() == 0
    assert [r["id"] for r in search.search(n, deg, "title", 2).collect()] == [1, 5]
    # The facet applies after the cut: node 3 is in cluster 1 but below it.
    assert rows(search.facet(search.search(n, deg, "title", 2), 1), "id") == [(1,), (5,)]
    assert rows(search.match_text(n, "ANN\nTech"), "id") == [(i,) for i in range(6)]
    assert search.match_text(n, " ").count() == 0
    order = [F.col("deg").desc(), F.col("id")]
    assert [r["id"] for r in ordering.page(search.browse(n, deg), order, 2, 1).collect()] == [5, 4]


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")


def test_canvas(spark):
    assert rows(layout.scale_to_canvas(points(spark, [(3, 0), (3, 1)]))) == [(0, 24, 24), (1, 24, 676)]


GRID = [(0.0499, 0.01), (0.0501, 0.01), (0.0, 0.0), (0.05, 0.0), (0.5, 0.5), (0.5, 0.5), (0.52, 0.5)]


@pytest.mark.parametrize("block_rows", [2048, 1])
def test_grid_join_and_decollide(spark, block_rows):
    r = 0.05

    def near(i, j):
        d2 = (GRID[i][0] - GRID[j][0]) ** 2 + (GRID[i][1] - GRID[j][1]) ** 2
        return math.sqrt(d2) if 1e-12 < d2 < r * r else None

    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7) if near(i, j)]
    got = layout.grid_join(points(spark, GRID), r, block_rows)
    assert rows(got, "a", "b") == pairs
    assert (4, 5) not in pairs and (2, 3) not in pairs  # coincident; exactly r apart
    moved = {row["id"]: (row["x"], row["y"]) for row in layout.decollide(points(spark, GRID), r, block_rows).collect()}
    for i, (x, y) in enumerate(GRID):
        for j in range(7):
            d = near(i, j)
            if d:
                x += (GRID[i][0] - GRID[j][0]) * 0.5 * (r - d) / d
                y += (GRID[i][1] - GRID[j][1]) * 0.5 * (r - d) / d
        assert moved[i] == pytest.approx((x, y))


META = "method string, cluster_id int, label string, created_at int"


def test_attach_labels(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 2)], "cid int, size int")
    other = [("x", 0, "old", 1), ("y", 0, "new", 2)]
    assert rows(export.cluster_legend(sizes, spark.createDataFrame(other, META))) == [(0, "new", 3), (1, None, 2)]
    both = spark.createDataFrame([*other, ("default", 1, "one", 1)], META)
    assert rows(export.cluster_legend(sizes, both), "cid", "label") == [(0, None), (1, "one")]
    assert rows(export.cluster_legend(sizes, spark.createDataFrame([], META)), "label") == [(None,), (None,)]
    assert rows(export.cluster_legend(sizes, None), "label") == [(None,), (None,)]


PAPERS = "node int, id string, title string, authors string, published string, summary string, link string, domain_tag string, cid int"


def papers(spark):
    data = [
        (0, "u0", "T", "A", "2024", "  long text ", "l0", "tech", 0),
        (1, "u1", None, "", None, None, "", None, 1),
    ]
    return spark.createDataFrame(data, PAPERS)


def test_grid_pairs_of_a_block_are_held_once(spark, monkeypatch):
    kernels = []
    monkeypatch.setattr(layout, "block_cogroup", lambda *a: kernels.append(a[5]))
    layout.grid_join(spark.range(1).selectExpr("id", "0.0D x", "0.0D y"), 0.1)
    n = 2 * layout._STRIP
    points = pa.table({"id": range(n), "x": [i / n / 20 for i in range(n)], "y": [0.0] * n})
    found = kernels[0](points, points)
    assert found.num_rows == n * (n - 1) // 2 and found.column("a").num_chunks == 2


def test_graph_nodes_and_links(spark):
    compact = export.graph_nodes(papers(spark), include_summaries=True, max_summary_len=4)
    assert compact.columns == ["id", "aid", "t", "au", "pd", "dm", "ln", "cid", "sm"]
    got = {r["id"]: r for r in compact.collect()}
    assert got[0]["sm"] == "long…" and got[1]["sm"] is None
    assert (got[1]["t"], got[1]["dm"], got[1]["ln"]) == ("", "unknown", "u1")
    verbose = export.graph_nodes(papers(spark), compact=False)
    assert verbose.columns == ["id", "title", "authors", "published", "domain", "link", "cid", "summary"]
    edges = links(spark, [(0, 1, 0.1234565)])
    assert rows(export.graph_links(edges, papers(spark), compact=False)) == [("u0", "u1", 0.123456)]


def test_summaries(spark):
    data = [
        ("https://a.org/1?v=2", "https://b.org/1", "one"),
        ("https://a.org/2", "https://a.org/1", "two"),
        ("https://a.org/3", "", "three"),
    ]
    summaries = spark.createDataFrame(data, "url string, ln string, sm string")
    asked = ["https://a.org/1#x", "https://b.org/1?q", "https://A.org/3", "https://a.org/9", "", None]
    urls = spark.createDataFrame([(u, "own") for u in asked], "url string, own string")
    got = {r["url"]: r["sm"] for r in export.lookup_summary(urls, summaries, own="own").collect()}
    # The later entry's link takes over the key of the first.
    assert [got[u] for u in asked] == ["two", "one", "three", "own", "own", "own"]


def test_summaries_that_share_a_url(spark):
    data = [
        ("https://a.org/1", "https://b.org/1", "one"),
        ("https://a.org/1", "https://b.org/2", "two"),
        ("https://a.org/1", "https://b.org/2", "two"),
    ]
    summaries = spark.createDataFrame(data, "url string, ln string, sm string")
    got = {(r["key"], r["summary"]["sm"]) for r in export.summary_aliases(summaries).collect()}
    want = {("https://a.org/1", "two"), ("https://b.org/1", "one"), ("https://b.org/2", "two")}
    assert export.summary_aliases(summaries).count() == 3 and got == want
    urls = spark.createDataFrame([(k,) for k, _ in sorted(want)], "url string")
    found = export.lookup_summary(urls, summaries).select("url", "found.sm").collect()
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_summary_scope(spark):
    data = [("a", 1, 0), ("b", 0, 1), ("c", 1, None)]
    df = spark.createDataFrame(data, "id string, ai_stage2_keep int, kmeans_cluster int")
    ids = spark.createDataFrame([("b",), ("b",)], "id string")
    assert rows(export.summary_scope(df), "id") == [("a",), ("c",)]
    assert rows(export.summary_scope(df, ids), "id") == [("a",), ("b",), ("c",)]
    assert rows(export.summary_scope(df, ids, only_ids=True), "id") == [("b",)]
    assert rows(export.summary_scope(df, only_clustered=True), "id") == [("a",)]


def joined(folder, zipped=False):
    parts = sorted(folder.glob("part-*"))
    return "".join(gzip.open(p, "rt").read() if zipped else p.read_text() for p in parts)


@pytest.mark.parametrize("zipped", [False, True])
def test_export_documents(spark, tmp_path, zipped):
    n = export.graph_nodes(papers(spark))
    sizes = spark.createDataFrame([(0, 1), (1, 1)], "cid int, size int")
    legend = export.cluster_legend(sizes, None)
    meta = spark.range(1).select(F.lit("m").alias("model"))
    edges = links(spark, [(0, 1, 0.5)])
    path = sinks.export_graph(n, edges, legend, meta, str(tmp_path / "g"), zipped, document=True)
    doc = json.loads(joined(tmp_path / "g", zipped))
    assert path and doc["links"] == [{"s": 0, "t": 1, "w": 0.5}] and doc["meta"] == {"model": "m"}
    assert [x["id"] for x in doc["nodes"]] == [0, 1] and doc["clusters"]["1"]["size"] == 1
    sinks.export_graph(n, edges, legend, meta, str(tmp_path / "parts"), zipped)
    back = spark.read.schema(n.schema).json(str(tmp_path / "parts" / "nodes"))
    assert rows(back) == rows(n)
    summaries = spark.createDataFrame([("u", "s", 1)], "url string, sm string, cid int")
    sinks.export_summaries(summaries, str(tmp_path / "s"), document=True)
    assert json.loads(joined(tmp_path / "s")) == {"summaries": {"u": {"sm": "s", "cid": 1}}}


def test_documents_in_many_parts(spark, tmp_path):
    """Any number of rows: parts of all tasks that join to one document, quotes and ties included."""
    data = [(i, None if i % 7 == 0 else f'a "{i}"\n') for i in range(5000)]
    n = spark.createDataFrame(data, "id long, t string").repartition(9)
    edges = spark.range(7000).selectExpr("id div 3 as source", "id % 2 as target", "0.5D as w")
    legend = spark.createDataFrame([(2, 'x"', 1), (10, None, 4)], "cid int, label string, size int")
    meta = spark.range(1).select(F.lit("m").alias("model"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.export_graph(n, edges, legend, meta, str(tmp_path / "g"), document=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "g").glob("part-*"))) > 1
    doc = json.loads(joined(tmp_path / "g"))
    assert doc["nodes"] == [{"id": i, "t": t} if t else {"id": i} for i, t in data]
    ends = [(x["source"], x["target"]) for x in doc["links"]]
    assert ends == sorted((i // 3, i % 2) for i in range(7000))
    assert doc["clusters"] == {"2": {"label": 'x"', "size": 1}, "10": {"size": 4}}
    sinks.export_graph(n.limit(0), edges.limit(0), legend.limit(0), meta.limit(0), str(tmp_path / "e"), document=True)
    assert json.loads(joined(tmp_path / "e")) == {"meta": None, "clusters": {}, "nodes": [], "links": []}
