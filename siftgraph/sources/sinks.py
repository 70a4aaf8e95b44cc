"""JSON output of the graph and the summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import number_rows


def _options(gzip: bool) -> dict[str, str]:
    return {"compression": "gzip"} if gzip else {}


def export_graph(
    nodes: DataFrame,
    links: DataFrame,
    clusters: DataFrame,
    meta: DataFrame,
    path: str,
    gzip: bool = False,
    document: bool = False,
) -> str:
    """Write the graph as JSON and return the path.

    By default each part is a folder of JSON lines, written by all tasks. ``document`` writes
    the single document a browser reads as ordered text parts: joined in the order of their names
    (``cat part-*``, also when gzipped) they are the document, one line for each node or link.
    All tasks write, and nothing is gathered. Without a row in ``meta`` the document's is null.
    """
    if not document:
        parts = {"nodes": nodes, "links": links, "clusters": clusters, "meta": meta}
        for name, df in parts.items():
            df.write.mode("overwrite").options(**_options(gzip)).json(f"{path}/{name}")
        return path
    head = F.coalesce(F.first(_json(meta.columns)), F.lit("null"))
    order = [c for c in ("s", "t", "source", "target") if c in links.columns]
    pieces = [
        '{"meta":',
        meta.limit(1).agg(head.alias("line")).select("line", F.lit(0).cast("long").alias("n")),
        ',"clusters":{',
        _items(clusters, ["cid"], _entry("cid", ["label", "size"])),
        '},"nodes":[',
        _items(nodes, ["id"], _json(nodes.columns)),
        '],"links":[',
        _items(links, order, _json(links.columns)),
        "]}",
    ]
    return _write_document(pieces, path, gzip)


def export_summaries(
    summaries: DataFrame, path: str, gzip: bool = False, document: bool = False
) -> str:
    """Write the summaries as JSON lines, or as one document (url to fields) in ordered parts.

    A url must not repeat in a document, as it is a key there.
    """
    if not document:
        summaries.write.mode("overwrite").options(**_options(gzip)).json(path)
        return path
    fields = [c for c in summaries.columns if c != "url"]
    pieces = ['{"summaries":{', _items(summaries, ["url"], _entry("url", fields)), "}}"]
    return _write_document(pieces, path, gzip)


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def _entry(key: str, fields: Sequence[str]) -> Column:
    """``"key":{...}``: an object of one entry without its braces."""
    one = F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*fields)), {"ignoreNullFields": "true"})
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _items(df: DataFrame, order: Sequence[str], line: Column) -> DataFrame:
    """line, n: the rows' JSON in order, each but the first behind a comma."""
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, line.alias("line"))
    placed = number_rows(rows, [F.col(c) for c in rows.columns], "n")
    return placed.select(F.concat(F.when(F.col("n") > 0, ",").otherwise(""), "line").alias("line"), "n")


def _write_document(pieces: Sequence[str | DataFrame], path: str, gzip: bool) -> str:
    spark = next(p for p in pieces if isinstance(p, DataFrame)).sparkSession
    fixed = [(i, 0, p) for i, p in enumerate(pieces) if isinstance(p, str)]
    text = spark.createDataFrame(fixed, "piece int, n long, line string")
    for i, p in enumerate(pieces):
        if isinstance(p, DataFrame):
            text = text.unionByName(p.withColumn("piece", F.lit(i)))
    lines = text.orderBy("piece", "n").select("line")
    lines.write.mode("overwrite").options(**_options(gzip)).text(path)
    return path
