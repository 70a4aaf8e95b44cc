"""Prefix trie of conversations by fixed-length block hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import hot_split_join
from ..operators.ordering import rank_within
from ..session import cut
from .sorted_runs import in_order, last_seen, running_sums

# Turns in a block.
BLOCK = 4
# Ids of a node that ends are joined by so many before they are hashed.
ENDS = 256
ROOT = "0.0.0"
SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def _digest() -> Column:
    """Role and text of a turn as one digest; null counts as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, idx, digest, n_bytes) of every turn; idx runs from 0 by turn, null first.

    Turns with one number come in the order of their digests. Rows without a conv_id belong to no
    conversation and take no part. A conversation with a third of all turns is spread over tasks.
    """
    slim = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        _digest().alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    ranked = rank_within(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "idx")
    return cut(ranked.drop("turn"), "trie-turns")


def spliced(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: turns (conv_id, depth, digest, n_bytes) and conversations
    (conv_id, length).

    The first h turns come from the conversation conv_id - conv_id % ``every`` (all if it has
    fewer, none if it is absent), the rest are its own after its first h, where h is the CRC-32 of
    the decimal id modulo ``most``. The remainder has the sign of the id.
    """
    own = cut(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")), "trie-lens")
    base = own.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h})
    plan = plan.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))))
    plan = cut(plan.drop("base_len"), "trie-plan")
    rest = hot_split_join(turns, plan, ["conv_id"], "len", "idx").where("idx >= h")
    rest = rest.select("conv_id", (F.col("idx") - F.col("h") + F.col("m") + 1).alias("depth"), "digest", "n_bytes")
    lent = turns.where(F.col("idx") < most - 1).withColumnRenamed("conv_id", "base")
    lent = plan.where("m > 0").select("conv_id", "base", "m").join(lent, "base").where("idx < m")
    lent = lent.select("conv_id", (F.col("idx") + 1).alias("depth"), "digest", "n_bytes")
    length = F.greatest(F.col("len") - F.col("h"), F.lit(0)) + F.col("m")
    return rest.unionByName(lent), plan.select("conv_id", length.alias("length"))


def _name(depth: Column, a: Column, b: Column) -> Column:
    """A node by its depth and the digest of the turns on its path."""
    return F.concat_ws(".", depth.cast("long").cast("string"), a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of all prefixes: one row per node, from the textless root on.

    ``turns`` has conv_id, depth (from 1, gapless), digest (hexadecimal) and n_bytes, ``convs`` has
    conv_id and length, 0 where a conversation has no turns. The digest of a path is the sum of the
    digests of its turns, each hashed with its depth (120 bits), so it chains without a walk.

    Conversations are first grouped by the digests of whole blocks of ``block`` turns. Where a
    block is the only one behind its parent, each of its turns is a node with the block's members;
    only where siblings differ are turns grouped, and then one row for each different block, not
    for each conversation. Sums over subtrees are sums over members. A conversation brings 1 if it
    owns a childless node (a node is its smallest member's), and ``q``, the bytes of the longest
    prefix that is not its own; a node saves what its other members' ``q`` goes beyond its parent.

    An empty table gives no rows. Columns: see ``SCHEMA``.
    """
    convs = cut(convs, "trie-convs")
    parts = [F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("depth").cast("long").cast("string"), "digest"), 256), i, 15), 16, 10) for i in (1, 16)]
    turns = turns.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.floor((F.col("depth") - 1) / block).alias("blk"),
        F.col("n_bytes").alias("p"), *[x.cast("decimal(20,0)").alias(n) for x, n in zip(parts, "ab", strict=True)],
    )
    turns = cut(turns, "trie-hashed")
    chain = _chain(turns)
    ends = chain.groupBy("conv_id").agg(
        F.max_by("after", "blk").alias("end"), F.max_by("p1", "blk").alias("total"), F.count(F.lit(1)).alias("n_blocks")
    )
    ends = convs.join(ends, "conv_id", "left").fillna({"end": ROOT, "total": 0, "n_blocks": 0})
    ends = cut(ends, "trie-ends")

    # Blocks, then the turns of one member of each.
    blocks = chain.groupBy("after").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"),
        *[F.min(c).alias(c) for c in ("before", "blk", "a0", "b0", "p0")],
    )
    blocks = cut(blocks, "trie-blocks")
    lone = blocks.groupBy("before").agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("_only")).where("n = 1")
    blocks = blocks.join(lone.select("_only"), F.col("after") == F.col("_only"), "left")
    blocks = blocks.withColumn("alone", F.col("_only").isNotNull()).drop("_only")
    met = turns.withColumnRenamed("conv_id", "rep").join(blocks, ["rep", "blk"])
    inner = Window.partitionBy("after").orderBy("depth")
    upto = {n: F.col(f"{n}0") + F.sum(n).over(inner) for n in "abp"}
    met = met.select("after", "alone", "rep", "n_convs", "depth", *upto.keys(), *[v.alias(f"{n}1") for n, v in upto.items()])
    rows = cut(
        met.select(
            "after", "alone", "rep", "n_convs", "depth",
            _name(F.col("depth"), F.col("a1"), F.col("b1")).alias("key"),
            _name(F.col("depth") - 1, F.col("a1") - F.col("a"), F.col("b1") - F.col("b")).alias("up"),
            (F.col("p1") - F.col("p")).alias("prior"),
        ),
        "trie-rows",
    )
    nodes = rows.where("alone").select("key", "up", "depth", F.col("rep").alias("conv_id"), "n_convs", "prior")
    split = rows.where("not alone").groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("up", "depth")], F.min("rep").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("prior").alias("prior")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("prior"),
    )
    nodes = cut(nodes.unionByName(split).unionByName(root), "trie-nodes")
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(kids, "key", "left").fillna({"n_children": 0}), "trie-nodes")

    # What each conversation brings to the nodes above it.
    owned = nodes.groupBy("conv_id").agg(
        F.min("prior").alias("q"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.count(F.lit(1)).alias("n_owned")
    )
    brings = ends.join(owned, "conv_id", "left").select(
        "conv_id", "n_blocks", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("n_owned", F.lit(0)).alias("n_owned")
    )
    brings = cut(brings, "trie-brings")
    given = [F.sum(c).alias(c) for c in ("q", "leaf")]
    per_block = hot_split_join(chain.select("conv_id", "blk", "after"), brings, ["conv_id"], "n_blocks", "blk")
    per_block = per_block.groupBy("after").agg(*given)
    met = rows.select("after", "key", "alone").join(per_block, "after")
    sums = met.where("alone").select("key", "q", "leaf").unionByName(met.where("not alone").groupBy("key").agg(*given))
    sums = sums.unionByName(brings.agg(*given).select(F.lit(ROOT).alias("key"), "q", "leaf"))
    own_q = brings.where("n_owned > 0").select("conv_id", "n_owned", F.col("q").alias("own"))
    summed = cut(nodes.join(sums, "key"), "trie-sums")
    done = hot_split_join(summed, own_q, ["conv_id"], "n_owned", "key")
    saved = F.col("q") - F.col("own") - (F.col("n_convs") - 1) * F.col("prior")
    done = done.withColumn("saved_tokens", saved).join(_ends_sha256(ends), "key", "left")
    done = cut(done.drop("q", "own", "prior"), "trie-done")

    # A parent with a third of all nodes below it is split by the number of its children.
    parents = done.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    below = hot_split_join(done.where("up is not null"), cut(parents, "trie-parents"), ["up"], "_kids", "key")
    top = done.where("up is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.drop("_kids").unionByName(top).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _chain(turns: DataFrame) -> DataFrame:
    """Blocks of each conversation (conv_id, blk) with the path's sums before (a0, b0, p0) and
    after them (p1), and the names of the nodes there."""
    sums = [F.sum(c).alias(c) for c in "abp"]
    blocks = turns.groupBy("conv_id", "blk").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"), *sums)
    rows = in_order(blocks, [F.col("conv_id"), F.col("blk")], "trie-in-order")
    rows = running_sums(rows, {f"{c}1": F.col(c) for c in "abp"})
    rows = rows.withColumns({f"{c}0": F.col(f"{c}1") - F.col(c) for c in "abp"})
    first = {f"{c}f": F.when(F.col("blk") == 0, F.col(f"{c}0")) for c in "abp"}
    rows = last_seen(cut(rows, "trie-sums"), first)
    rows = rows.withColumns({f"{c}{i}": F.col(f"{c}{i}") - F.col(f"{c}f") for c in "abp" for i in "01"})
    before = _name(F.col("depth") - F.col("n"), F.col("a0"), F.col("b0"))
    after = _name(F.col("depth"), F.col("a1"), F.col("b1"))
    whole = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("a0", "b0")] + [F.col(c).cast("long").alias(c) for c in ("p0", "p1")]
    return cut(rows.select("conv_id", "blk", before.alias("before"), after.alias("after"), *whole), "trie-chain")


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): hash of the ids of the conversations that end at a node.

    SHA-256 has to see the ids one after the other. They are joined to texts of ``ENDS`` ids in
    parallel first, so a node where a third of all end is few rows, and these pass by one at a time.
    """
    rows = in_order(ends.select(F.col("end").alias("key"), "conv_id"), [F.col("key"), F.col("conv_id")], "trie-members")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_m", "conv_id"))), lambda x: x["conv_id"].cast("string"))
    texts = rows.groupBy("key", F.floor(F.col("_m") / ENDS).alias("_chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            names, sums = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if state is not None:
                        names.append(last)
                        sums.append(state.hexdigest())
                    last, state = key, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "ends_sha256": pa.array(sums, pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": [last], "ends_sha256": [state.hexdigest()]})

    dealt = texts.repartition("key").sortWithinPartitions("key", "_chunk").select("key", "ids")
    return dealt.mapInArrow(hashed, "key string, ends_sha256 string")


def conversation_trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of all ``spliced`` conversations of a table with conv_id, turn, role and text."""
    return prefix_trie(*spliced(numbered_turns(convs)), block=block)


# The same in DuckDB's SQL: each node is compared with all that begin with it.
SQL = """WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS idx
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(
    octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
lens AS (SELECT conv_id, count(*) AS len FROM turns GROUP BY conv_id),
plan AS (
  SELECT l.conv_id, l.len, l.conv_id - l.conv_id % 5 AS base, l.h, least(l.h, coalesce(b.len, 0)) AS m FROM (
    SELECT *, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)),
      lambda c, x: list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), xor(c, x)),
      CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM lens) l
  LEFT JOIN lens b ON b.conv_id = l.conv_id - l.conv_id % 5),
r AS (
  SELECT conv_id, idx - h + m + 1 AS depth, role, text FROM turns JOIN plan USING (conv_id) WHERE idx >= h
  UNION ALL SELECT p.conv_id, idx + 1, role, text FROM plan p JOIN turns t ON t.conv_id = p.base WHERE idx < m),
paths AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS n,
    list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM plan),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
  FROM (SELECT p.*, p.depth = e.depth AS ended FROM paths p JOIN ends e USING (conv_id)) GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
below AS (
  SELECT path[:above] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM whole) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b USING (path) LEFT JOIN nodes u ON w.depth > 0 AND u.path = w.path[:-2]"""
