"""Rows of the exported graph and of the summary lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, ellipsize
from ..functions.vectors import round_weight
from ..sources.tables import latest_per_key
from .labels import attach_labels


def _or(name: str, default) -> Column:
    """The column, or the default where it is NULL or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(F.col(name), F.lit("")), default)


def node_defaults(papers: DataFrame) -> DataFrame:
    """Fill what a node must have: texts, domain, and a link that falls back to the id."""
    return papers.withColumns(
        {
            "title": _or("title", ""),
            "authors": _or("authors", ""),
            "published": _or("published", ""),
            "domain_tag": _or("domain_tag", "unknown"),
            "link": _or("link", F.col("id").cast("string")),
        }
    )


def graph_nodes(
    numbered: DataFrame,
    coords: DataFrame | None = None,
    compact: bool = True,
    include_summaries: bool = False,
    max_summary_len: int = 400,
) -> DataFrame:
    """Nodes in the compact or the verbose key style; ``numbered`` has node, id, cid and texts.

    Compact nodes are named by number, verbose ones by paper id; only compact nodes leave out an
    absent summary.
    """
    filled = node_defaults(numbered)
    text = ellipsize(F.col("summary"), max_summary_len) if include_summaries else F.lit(None)
    columns = {
        "title": "t", "authors": "au", "published": "pd", "domain_tag": "dm", "link": "ln",
    }
    verbose = {"domain_tag": "domain"}
    named = [
        F.col(c).alias(short if compact else verbose.get(c, c)) for c, short in columns.items()
    ]
    head = [F.col("node").alias("id"), F.col("id").alias("aid")] if compact else [F.col("id")]
    summary = text.cast("string").alias("sm" if compact else "summary")
    place = []
    if coords is not None:
        filled = filled.join(coords.select("node", "x", "y"), "node", "left")
        place = ["x", "y"]
    keep_summary = [summary] if include_summaries or not compact else []
    return filled.select(*head, *named, "cid", *keep_summary, *place)


def graph_links(edges: DataFrame, numbered: DataFrame, compact: bool = True) -> DataFrame:
    """Links with rounded weights: by node number, or by paper id in the verbose style."""
    if compact:
        return edges.select("s", "t", round_weight(F.col("w")).alias("w"))
    names = numbered.select("node", "id")
    s = names.select(F.col("node").alias("s"), F.col("id").alias("source"))
    t = names.select(F.col("node").alias("t"), F.col("id").alias("target"))
    return (
        edges.join(s, "s").join(t, "t")
        .select("source", "target", round_weight(F.col("w")).alias("weight"))
    )


def cluster_legend(sizes: DataFrame, meta: DataFrame | None) -> DataFrame:
    """cid, label (NULL if none), size."""
    if meta is None:
        return sizes.select("cid", F.lit(None).cast("string").alias("label"), "size")
    return attach_labels(sizes, meta).select("cid", "label", "size")


def summary_scope(
    papers: DataFrame,
    ids: DataFrame | None = None,
    only_ids: bool = False,
    only_clustered: bool = False,
    cluster: str = "kmeans_cluster",
) -> DataFrame:
    """Papers to summarise: kept ones, plus or only the listed ids, optionally only clustered."""
    rows = papers
    if only_clustered:
        rows = rows.where(F.col(cluster).isNotNull())
    if ids is not None and only_ids:
        return rows.join(ids.select("id").distinct(), "id", "left_semi")
    kept = F.col("ai_stage2_keep") == 1
    if ids is None:
        return rows.where(kept)
    listed = ids.select("id", F.lit(True).alias("_listed")).distinct()
    return rows.join(listed, "id", "left").where(kept | F.col("_listed")).drop("_listed")


def summary_rows(
    papers: DataFrame,
    meta: bool = True,
    domain: bool = True,
    cid: bool = True,
    trim: bool = False,
    max_len: int = 1000,
    cluster: str = "kmeans_cluster",
) -> DataFrame:
    """url and the summary fields; the flags leave fields out, ``trim`` shortens the text."""
    filled = node_defaults(papers)
    text = F.coalesce(F.col("summary"), F.lit(""))
    columns = [F.col("id").alias("url"), (ellipsize(text, max_len) if trim else text).alias("sm")]
    if meta:
        columns += [
            F.col("title").alias("t"), F.col("authors").alias("au"),
            F.col("published").alias("pd"), F.col("link").alias("ln"),
        ]
    if domain:
        columns.append(F.col("domain_tag").alias("dm"))
    if cid:
        columns.append(F.col(cluster).alias("cid"))
    return filled.select(*columns)


def _entry(summaries: DataFrame) -> Column:
    """Names a summary: several may share a URL, and rows alike in all columns are one."""
    return F.struct("url", "ln", F.sha2(F.to_json(F.struct(*summaries.columns)), 256).alias("digest"))


def _entries(summaries: DataFrame, name: str) -> DataFrame:
    """_of, and all columns as ``name``; once for rows alike in all columns."""
    rows = summaries.select(_entry(summaries).alias("_of"), F.struct(*summaries.columns).alias(name))
    return rows.dropDuplicates(["_of"])


def _alias_keys(summaries: DataFrame, order: str) -> DataFrame:
    """key, _of: which summary each canonical key or link stands for; the later entry wins.

    Of summaries that share their place in ``order`` the one with the greater link does, then the
    one with the greater digest, so each key has one.
    """
    rows = summaries.select(_entry(summaries).alias("_of"), F.col(order).alias("_o"))
    by_key = rows.select(canonical_url(F.col("_of.url")).alias("key"), "_of", "_o", F.lit(0).alias("_k"))
    by_link = rows.where(F.col("_of.ln") != "").select(
        canonical_url(F.col("_of.ln")).alias("key"), "_of", "_o", F.lit(1).alias("_k")
    )
    both = by_key.unionByName(by_link)
    last = [F.col("_o"), F.col("_k"), F.col("_of")]
    return latest_per_key(both, ["key"], last).select("key", "_of")


def summary_aliases(summaries: DataFrame, order: str = "url") -> DataFrame:
    """key, summary: each summary under its canonical key and its canonical link."""
    # Keys are settled without the texts, which move once.
    return _alias_keys(summaries, order).join(_entries(summaries, "summary"), "_of").drop("_of")


def lookup_summary(
    urls: DataFrame,
    summaries: DataFrame,
    url: str = "url",
    own: str | None = None,
    order: str = "url",
) -> DataFrame:
    """Add the summary found under each URL's canonical form, as column ``found`` (NULL if none).

    With ``own``, column ``sm`` is the found text or else the row's own.
    """
    known = _alias_keys(summaries, order)
    keyed = urls.withColumn("_key", canonical_url(F.nullif(F.col(url), F.lit(""))))
    named = keyed.join(known.withColumnRenamed("key", "_key"), "_key", "left")
    joined = named.join(_entries(summaries, "found"), "_of", "left").drop("_of", "_key")
    return joined if own is None else joined.withColumn("sm", F.coalesce("found.sm", own))
