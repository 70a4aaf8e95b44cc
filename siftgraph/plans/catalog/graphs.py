"""Graph, search, layout and export over clustered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.vectors import round_weight
from ...operators import export, graph, layout, ordering, search
from ...operators.neighbours import knn_join, min_similarity
from ...operators.spanning import cluster_mst
from ...session import cut, scratch_path
from ...sources import sinks
from ..build_graph import build_graph
from .base import MST, clustered, embeddings, papers, query, table

QUERY = " Tion EN "


def _edges(spark, sf):
    """Undirected neighbour edges named by paper."""
    near = knn_join(embeddings(spark, sf), 5, 0.30)
    return cut(graph.union_edges(near, near.limit(0), 0.30), "links")


def _nodes(spark, sf):
    return clustered(spark, sf).select(
        "id", F.col("title").alias("t"), F.col("authors").alias("au"),
        F.col("domain_tag").alias("dm"), F.col("summary").alias("sm"), "cid",
    )


@query("union_edges", "SELECT s, t, round(w, 6) AS w FROM links", "links")
def union_edges(spark, sf):
    return _edges(spark, sf).select("s", "t", F.round("w", 6).alias("w"))


@query("as_undirected", "SELECT id, nbr, round(w, 6) AS w FROM both_ways", "both")
def as_undirected(spark, sf):
    rows = graph.as_undirected(_edges(spark, sf))
    return rows.select("id", "nbr", F.round("w", 6).alias("w"))


@query("min_similarity", "SELECT s, t FROM links WHERE w >= 0.35", "links")
def strong_edges(spark, sf):
    return min_similarity(_edges(spark, sf), 0.35, "w").select("s", "t")


@query("round_weight", "SELECT s, t, round(w, 4) AS w FROM links", "links")
def rounded(spark, sf):
    return _edges(spark, sf).select("s", "t", round_weight(F.col("w"), 4).alias("w"))


@query("degree", "SELECT id, deg FROM degrees", "degrees")
def degree(spark, sf):
    return graph.degree(_nodes(spark, sf), _edges(spark, sf))


@query(
    "adjacency",
    """SELECT n.id, pos, nbr, round(w, 6) AS w FROM nodes n LEFT JOIN (
      SELECT id, nbr, w, row_number() OVER (PARTITION BY id ORDER BY w DESC, nbr) - 1 AS pos FROM both_ways) b
    USING (id)""",
    "nodes both",
)
def adjacency(spark, sf):
    rows = graph.adjacency(_nodes(spark, sf), _edges(spark, sf))
    return rows.select("id", "pos", "nbr", F.round("w", 6).alias("w"))


@query(
    "neighbors",
    "SELECT n.id, t, cid, round(w, 6) AS w FROM both_ways b JOIN nodes n ON n.id = b.nbr WHERE b.id = 7",
    "nodes both",
)
def neighbors(spark, sf):
    rows = graph.neighbors(_nodes(spark, sf), _edges(spark, sf), 7)
    return rows.select("id", "t", "cid", F.round("w", 6).alias("w"))


@query(
    "neighborhood",
    "SELECT CAST(7 AS BIGINT) AS id UNION SELECT nbr FROM both_ways WHERE id = 7",
    "both",
)
def neighborhood(spark, sf):
    return graph.neighborhood(_edges(spark, sf), 7)


@query("incident_edges", "SELECT s, t FROM links WHERE s = 7 OR t = 7", "links")
def incident_edges(spark, sf):
    return graph.incident_edges(_edges(spark, sf), 7).select("s", "t")


@query("cluster_sizes", "SELECT cid, count(*) AS size FROM clustered GROUP BY cid", "clustered")
def cluster_sizes(spark, sf):
    return graph.cluster_sizes(clustered(spark, sf))


@query("clusters", "SELECT DISTINCT cid FROM clustered ORDER BY cid", "clustered")
def clusters(spark, sf):
    return graph.clusters(clustered(spark, sf))


@query("dense_node_id", "SELECT node, id FROM numbered", "nodes")
def dense_node_id(spark, sf):
    return ordering.dense_node_id(clustered(spark, sf)).select("node", "id")


@query("order_nodes", "SELECT id, cid, published FROM clustered ORDER BY cid, published DESC, id", "clustered")
def order_nodes(spark, sf):
    return ordering.order_nodes(clustered(spark, sf)).select("id", "cid", "published")


@query(
    "match_text",
    r"SELECT id FROM nodes WHERE contains(lower(t || chr(10) || au || chr(10) || dm || chr(10) || sm), 'tion en')",
    "nodes",
)
def match_text(spark, sf):
    return search.match_text(_nodes(spark, sf), QUERY).select("id")


@query("search_scores", "SELECT id, deg, round(score, 6) AS score FROM hits", "hits")
def search_scores(spark, sf):
    nodes = _nodes(spark, sf)
    rows = search.score_nodes(nodes, graph.degree(nodes, _edges(spark, sf)), QUERY)
    return rows.select("id", "deg", F.round("score", 6).alias("score"))


def _found(spark, sf, limit):
    nodes = _nodes(spark, sf)
    return search.search(nodes, graph.degree(nodes, _edges(spark, sf)), QUERY, limit)


@query(
    "search",
    "SELECT id, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, id LIMIT 100",
    "hits",
)
def search_top(spark, sf):
    return _found(spark, sf, 100).select("id", F.round("score", 6).alias("score"))


@query(
    "facet_after_limit",
    "SELECT id, cid FROM (SELECT * FROM hits ORDER BY score DESC, id LIMIT 200) WHERE cid = 3",
    "hits",
)
def facet_after_limit(spark, sf):
    return search.facet(_found(spark, sf, 200), 3).select("id", "cid")


@query("browse_by_degree", "SELECT id, deg FROM degrees ORDER BY deg DESC, id", "degrees")
def browse_by_degree(spark, sf):
    nodes = _nodes(spark, sf)
    return search.browse(nodes, graph.degree(nodes, _edges(spark, sf))).select("id", "deg")


@query("page", "SELECT id, deg FROM degrees ORDER BY deg DESC, id LIMIT 40 OFFSET 40", "degrees")
def page(spark, sf):
    nodes = _nodes(spark, sf)
    rows = search.browse(nodes, graph.degree(nodes, _edges(spark, sf)))
    return ordering.page(rows, [F.col("deg").desc(), F.col("id")], 40, 40).select("id", "deg")


def _points(spark, sf):
    return embeddings(spark, sf).select(
        F.col("paper_id").alias("id"),
        F.col("vector")[0].cast("double").alias("x"),
        F.col("vector")[1].cast("double").alias("y"),
    )


_POINTS = """WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
s AS (SELECT id, (x - x0) / greatest(x1 - x0, 1e-9) AS x, (y - y0) / greatest(y1 - y0, 1e-9) AS y FROM p, b),
near AS (
  SELECT a.id AS a, c.id AS b, a.x - c.x AS dx, a.y - c.y AS dy,
    sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS d
  FROM s a, s c WHERE (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) < 0.0025
    AND (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) > 1e-12)
"""


@query("bounds", _POINTS + "SELECT round(x0, 6) AS min_x, round(x1, 6) AS max_x, round(y0, 6) AS min_y, round(y1, 6) AS max_y FROM b")
def bounds(spark, sf):
    box = layout.bounds(_points(spark, sf))
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query(
    "canvas_points",
    _POINTS + "SELECT id, CAST(trunc(24 + x * 952) AS INTEGER) AS x, CAST(trunc(24 + y * 652) AS INTEGER) AS y FROM s",
)
def canvas_points(spark, sf):
    return layout.scale_to_canvas(_points(spark, sf))


@query("grid_pairs", _POINTS + "SELECT a, b, round(d, 6) AS d FROM near WHERE a < b")
def grid_pairs(spark, sf):
    rows = layout.grid_join(layout.unit_square(_points(spark, sf)), 0.05)
    return rows.select("a", "b", F.round("d", 6).alias("d"))


@query(
    "decollide",
    _POINTS
    + """SELECT id, round(x + coalesce(px, 0), 6) + 0.0 AS x, round(y + coalesce(py, 0), 6) + 0.0 AS y
    FROM s LEFT JOIN (SELECT a AS id, sum(dx * 0.5 * (0.05 - d) / d) AS px, sum(dy * 0.5 * (0.05 - d) / d) AS py
      FROM near GROUP BY a) USING (id)""",
)
def decollide(spark, sf):
    rows = layout.decollide(layout.unit_square(_points(spark, sf)), 0.05)
    return rows.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "node_defaults",
    """SELECT id, title, authors, published, lang AS domain_tag, coalesce(link, CAST(id AS VARCHAR)) AS link FROM papers""",
    "papers",
)
def node_defaults(spark, sf):
    df = papers(spark, sf).withColumn("domain_tag", F.substring("categories", 6, 2))
    return export.node_defaults(df).select(
        "id", "title", "authors", "published", "domain_tag", "link"
    )


_NODE_ROWS = r"""SELECT node AS id, CAST(id AS VARCHAR) AS aid, title AS t, authors AS au, published AS pd,
  domain_tag AS dm, coalesce(link, CAST(id AS VARCHAR)) AS ln, cid,
  CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '…' ELSE s END AS sm
FROM (SELECT *, regexp_replace(summary, '^\s+|\s+$', '', 'g') AS s FROM numbered)"""


def _numbered(spark, sf):
    return ordering.dense_node_id(clustered(spark, sf).withColumn("id", F.col("id").cast("long")))


@query("graph_nodes", _NODE_ROWS, "nodes")
def graph_nodes(spark, sf):
    rows = export.graph_nodes(_numbered(spark, sf), include_summaries=True)
    return rows.withColumn("aid", F.col("aid").cast("string"))


def _meta(spark, sf):
    """Labels of two methods, named after suppliers."""
    return table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") < 7, "default").otherwise("other").alias("method"),
        F.col("s_suppkey").cast("int").alias("cluster_id"),
        F.col("s_name").alias("label"),
        F.col("s_acctbal").alias("created_at"),
    )


_LEGEND = """SELECT cid, s_name AS label, count(*) AS size FROM clustered
    LEFT JOIN supplier ON s_suppkey = cid AND s_suppkey < 7 GROUP BY ALL"""


@query("cluster_legend", _LEGEND, "clustered")
def cluster_legend(spark, sf):
    return export.cluster_legend(graph.cluster_sizes(clustered(spark, sf)), _meta(spark, sf))


@query(
    "attach_labels",
    """SELECT cid, label FROM (SELECT DISTINCT cid FROM clustered) LEFT JOIN (
      SELECT s_nationkey AS cid, arg_max(s_name, (s_acctbal, s_name)) AS label FROM supplier GROUP BY 1) USING (cid)""",
    "clustered",
)
def attach_labels(spark, sf):
    """No label of the default method: all methods count, the newest wins."""
    meta = table(spark, sf, "supplier").select(
        F.col("s_name").alias("method"),
        F.col("s_nationkey").alias("cluster_id"),
        F.col("s_name").alias("label"),
        F.col("s_acctbal").alias("created_at"),
    )
    return export.attach_labels(graph.clusters(clustered(spark, sf)), meta)


def _graph(spark, sf, **options):
    """A paper without a vector has no place in the graph: building one with it is an error."""
    emb = embeddings(spark, sf)
    rows = clustered(spark, sf).join(emb.select(F.col("paper_id").alias("id")), "id", "semi")
    return build_graph(
        rows, emb, _meta(spark, sf), min_sim=0.30, model=None, **options
    )


@query(
    "build_graph_links",
    """SELECT least(a.node, b.node) AS s, greatest(a.node, b.node) AS t, round(w, 6) AS w
    FROM links l JOIN numbered a ON a.id = l.s JOIN numbered b ON b.id = l.t""",
    "vectored links",
)
def build_graph_links(spark, sf):
    return _graph(spark, sf, mst=False, coords="none").links


@query("build_graph_nodes", _NODE_ROWS, "vectored")
def build_graph_nodes(spark, sf):
    rows = _graph(spark, sf, include_summaries=True, coords="none").nodes
    return rows.withColumn("aid", F.col("aid").cast("string"))


@query("build_graph_placed_nodes")
def build_graph_placed_nodes(spark, sf):
    return _graph(spark, sf).nodes


_TREE_LINKS = """, named AS (
  SELECT s, t, w FROM links UNION
  SELECT src, dst, sim FROM grow WHERE sim >= 0.15
    AND (src, dst) NOT IN (SELECT (s, t) FROM links))
SELECT least(a.node, b.node) AS s, greatest(a.node, b.node) AS t, round(w, 6) AS w
FROM named JOIN numbered a ON a.id = named.s JOIN numbered b ON b.id = named.t"""


@query("build_graph_tree_links", ", " + MST + _TREE_LINKS, "vectored links")
def build_graph_tree_links(spark, sf):
    return _graph(spark, sf, coords="none").links


@query("export_graph", _NODE_ROWS.replace("CAST(id AS VARCHAR) AS aid", "id AS aid"), "nodes")
def export_graph(spark, sf):
    """Nodes written as gzip JSON parts and read back."""
    rows = export.graph_nodes(_numbered(spark, sf), include_summaries=True)
    sizes = graph.cluster_sizes(clustered(spark, sf))
    path = sinks.export_graph(
        rows, _edges(spark, sf), export.cluster_legend(sizes, None),
        spark.range(1), scratch_path(spark, "graph"), gzip=True,
    )
    return spark.read.schema(rows.schema).json(f"{path}/nodes")


def _document_lines(spark, sf, name):
    """One document written in ordered parts, read back line by line without the commas."""
    sizes = graph.cluster_sizes(clustered(spark, sf))
    legend = export.cluster_legend(sizes, _meta(spark, sf))
    path = sinks.export_graph(
        _nodes(spark, sf), _edges(spark, sf), legend, spark.range(1), scratch_path(spark, name), document=True
    )
    return spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("line"))


@query("export_document_links", "SELECT s, t, round(w, 6) AS w FROM links", "links")
def export_document_links(spark, sf):
    lines = _document_lines(spark, sf, "document-links").where(F.col("line").startswith('{"s":'))
    rows = lines.select(F.from_json("line", "s long, t long, w double").alias("r")).select("r.*")
    return rows.withColumn("w", F.round("w", 6))


@query("export_document_legend", _LEGEND, "clustered")
def export_document_legend(spark, sf):
    lines = _document_lines(spark, sf, "document-legend").where(F.col("line").rlike('^"-?[0-9]+":'))
    entry = F.from_json(F.concat(F.lit("{"), "line", F.lit("}")), "map<string, struct<label string, size long>>")
    rows = lines.select(F.explode(entry).alias("cid", "r"))
    return rows.select(F.col("cid").cast("int").alias("cid"), "r.label", "r.size")


_SUMMARY_ROWS = r"""SELECT 'https://docs.example.org/' || id AS url, CASE WHEN length(s) > 1000 THEN substr(s, 1, 1000) || '…' ELSE s END AS sm,
  title AS t, authors AS au, published AS pd, coalesce(link, 'https://docs.example.org/' || id) AS ln, domain_tag AS dm, cid
FROM (SELECT *, regexp_replace(summary, '^\s+|\s+$', '', 'g') AS s FROM clustered)"""


def _summaries(spark, sf):
    rows = clustered(spark, sf).withColumn("id", F.concat(F.lit("https://docs.example.org/"), "id"))
    return export.summary_rows(rows, trim=True)


@query("summary_rows", _SUMMARY_ROWS, "clustered")
def summary_rows(spark, sf):
    return _summaries(spark, sf)


@query("export_summaries", _SUMMARY_ROWS, "clustered")
def export_summaries(spark, sf):
    rows = _summaries(spark, sf)
    path = sinks.export_summaries(rows, scratch_path(spark, "summaries"), gzip=True)
    return spark.read.schema(rows.schema).json(path)


@query(
    "summary_scope",
    "SELECT id FROM clustered WHERE id IN (SELECT doc_id FROM labels)",
    "clustered",
)
def summary_scope(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    rows = export.summary_scope(clustered(spark, sf), ids, only_ids=True, only_clustered=True)
    return rows.select("id")


# Pages as summaries under their raw URL, linked under the same path of another host.
_LOOKUP = """WITH s AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS key,
    'https://link.example.org/' || page_id AS ln FROM pages),
al AS (SELECT key, url AS o, 0 AS k, page_id FROM s UNION ALL SELECT ln, url, 1, page_id FROM s),
aliases AS (SELECT key, page_id FROM al QUALIFY row_number() OVER (PARTITION BY key ORDER BY o DESC, k DESC) = 1)
"""


def _page_summaries(spark, sf):
    return table(spark, sf, "pages").select(
        "url",
        F.concat(F.lit("https://link.example.org/"), "page_id").alias("ln"),
        F.col("page_id").alias("sm"),
    )


@query("summary_aliases", _LOOKUP + "SELECT key, page_id FROM aliases")
def summary_aliases(spark, sf):
    rows = export.summary_aliases(_page_summaries(spark, sf))
    return rows.select("key", F.col("summary.sm").alias("page_id"))


@query(
    "summary_lookup",
    _LOOKUP
    + """, asked AS (SELECT url || '#again' AS url, page_id FROM pages UNION ALL
      SELECT 'https://link.example.org/' || doc_id || '?x=1', -1 FROM documents)
    SELECT asked.url, coalesce(aliases.page_id, asked.page_id) AS sm FROM asked
    LEFT JOIN aliases ON aliases.key = regexp_replace(asked.url, '[?#].*$', '')""",
)
def summary_lookup(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat("url", F.lit("#again")).alias("url"), F.col("page_id").alias("own")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("https://link.example.org/"), "doc_id", F.lit("?x=1")).alias("url"),
        F.lit(-1).cast("long").alias("own"),
    )
    asked = pages.unionByName(docs)
    found = export.lookup_summary(asked, _page_summaries(spark, sf), own="own")
    return found.select("url", "sm")
