"""Sharding by weighted rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sorted_runs import in_order

EVEN = (1.0,) * 16
# Hexadecimal digits of a draw: 52 bits, which a double holds beside a half.
DIGITS = 13


def _race(key: Column, shard: Column, weight: Column) -> Column:
    """How late a shard comes in for a key, as a struct that sorts by that, ties to the lower shard.

    The shard's draw is exponential with its weight as rate, so it is first as often as its weight
    says, and one shard's draw says nothing of another's.
    """
    digits = F.substring(F.md5(F.concat(shard.cast("string"), F.lit(":"), key)), 1, DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    late = F.when(weight > 0, -F.ln(u) / F.nullif(weight, F.lit(0.0))).otherwise(float("inf"))
    return F.struct(late.alias("late"), shard.alias("shard"))


def rendezvous(key: Column, weights: Sequence[float] = EVEN) -> Column:
    """Shard of a key (a string; null counts as empty): the one that comes in first.

    Key and weights alone decide. One more shard takes keys only into itself, one less gives only
    its own away, and a raised weight only draws keys in.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    given = F.array(*[F.lit(float(w)) for w in weights])
    key = F.coalesce(key, F.lit(""))
    runners = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: _race(key, s, F.get(given, s)))
    return F.array_min(runners)["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float] = EVEN, one_more: float = 1.0) -> DataFrame:
    """Each row's shard, its place there, and its shard when one of weight ``one_more`` is added.

    Rows of one ``doc_id`` share a shard, as the id decides; a null id is a key like any other. A
    null text has size 1 and the checksum of an empty one. Places run from 0 by doc_id, size and
    checksum, nulls first; rows alike in all of these differ in nothing that is returned. Other
    columns are not looked at; an empty table gives no rows. No row is moved by its shard: one sort
    over all columns spreads a hot key over tasks, and what is broadcast is one row per shard and
    sort partition that meet, fewer than both together.

    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = in_order(keyed, [F.col(c) for c in ("shard", "doc_id", "size", "text_crc32", "row")], "shards")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # Of each shard in each sort partition: where it begins there, and how many rows it has before.
    parts = rows.groupBy("shard", "_p").agg(F.min(local).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("shard", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    return rows.join(F.broadcast(offsets), ["shard", "_p"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (local + F.col("_off")).alias("slot"),
        _grown(key, F.col("shard"), weights, one_more).alias("grown_shard"),
    )


def _grown(key: Column, shard: Column, weights: Sequence[float], one_more: float) -> Column:
    """The shard with one more behind the last: only the newcomer and the old one still race."""
    given = F.array(*[F.lit(float(w)) for w in weights])
    new = _race(key, F.lit(len(weights)), F.lit(float(one_more)))
    return F.least(_race(key, shard, F.get(given, shard)), new)["shard"]


def write_shards(docs: DataFrame, folder: str, weights: Sequence[float] = EVEN) -> DataFrame:
    """Whole rows as Parquet under ``folder/shard=N``, and those files as a table.

    The columns of ``docs`` travel in one struct, ``record``, so that none clashes with ``shard``.
    Rows go to tasks by ranges of (shard, id, text), so a large shard is many files of like size.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(rendezvous(key, weights).alias("shard"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.repartitionByRange(parts, "shard", F.col("record.doc_id"), F.xxhash64("record.text"))
    spread.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(keyed.select("record", "shard").schema).parquet(folder)


SQL = """WITH crc AS (
  SELECT list_transform(range(256), lambda n:
    list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), n)) AS t),
sized AS (
  SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, xor(list_reduce(
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM documents, crc),
raced AS (
  SELECT r, doc_id, size, text_crc32, s AS shard, -ln((CAST('0x' || substr(md5(s || ':' ||
    coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS late
  FROM sized, range(17) AS x(s)),
won AS (
  SELECT r, doc_id, size, text_crc32, arg_min(shard, late) FILTER (WHERE shard < 16) AS shard,
    arg_min(shard, late) AS grown_shard FROM raced GROUP BY ALL)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard FROM won"""
