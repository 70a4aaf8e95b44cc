"""Exact deduplication with keyed streaming state on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import hot_split_join
from ..session import cut, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore."


def normalised(text: str = "text"):
    """The text with A to Z in lower case and nothing else changed; null is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _digest_state(rows: DataFrame, bytes_per_batch: str | None) -> DataFrame:
    """One row per digest, from the keyed state that a stream over ``rows`` leaves behind.

    The state lives in RocksDB on the executors' disks and in the shared checkpoint folder, and
    nothing expires. For each digest it holds how many rows had it, and the identifier and the
    locator of the row that stays. It is read where the stream has put it; no sink gathers it.
    """
    spark = rows.sparkSession
    landing = scratch_path(spark, "dedup-rows")
    rows.write.parquet(landing)
    stream = spark.readStream.schema(rows.schema)
    if bytes_per_batch:
        stream = stream.option("maxBytesPerTrigger", bytes_per_batch)
    kept = F.max(F.struct("doc_id", "row", "locator")).alias("keep")
    seen = stream.parquet(landing).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), kept)
    settings = {
        f"{STATE}providerClass": PROVIDER,
        f"{STATE}rocksdb.boundedMemoryUsage": "true",
        f"{STATE}rocksdb.allowFAllocate": "false",  # else each partition takes megabytes ahead
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    checkpoint = scratch_path(spark, "dedup-state")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.lastProgress is None:
            state = rows.limit(0).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), kept)
        else:
            state = spark.read.format("statestore").load(checkpoint)
            state = state.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("keep"))
        return cut(state, "dedup-digests")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(docs: DataFrame, bytes_per_batch: str | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): its group of equal texts and the row that stays.

    Texts are equal when identical after A to Z are lowered; null counts as empty. The row with
    the largest ``doc_id`` stays, of repeated ids one row; a null id is smaller than any other.
    A row whose digest has been seen is a hit, and hits are compared byte by byte: should texts
    differ under one digest, they are grouped by the texts themselves.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, row. Other columns of ``docs`` are
    not looked at. ``row`` numbers the rows of one call and has no meaning beyond it.
    """
    text = normalised()
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(text, 256).alias("digest"),
            F.input_file_name().alias("locator"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "dedup-slim",
    )
    state = _digest_state(rows, bytes_per_batch)
    found = cut(hot_split_join(rows, state, ["digest"], "n", "row"), "dedup-found")
    hits = found.where("n > 1").select(F.col("doc_id").alias("_id")).distinct()
    doubt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .groupBy(F.sha2("_text", 256).alias("digest"))
        .agg(F.min("_text").alias("_a"), F.max("_text").alias("_z"))
        .where("_a <> _z")
        .select("digest")
    )
    doubt = cut(doubt, "dedup-doubt")
    plain = found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "row",
    )
    if doubt.isEmpty():
        return plain
    again = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("_text"),
        F.sha2(text, 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    ).join(doubt.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_semi")
    same = Window.partitionBy("text_sha256", "_text")
    first = F.max(F.struct("doc_id", "row")).over(same)
    split = again.select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.col("row") == first["row"]).alias("kept"),
        "text_sha256",
        "row",
    )
    clean = plain.join(doubt.withColumnRenamed("digest", "text_sha256"), "text_sha256", "left_anti")
    return clean.unionByName(split)


def drop_exact(docs: DataFrame, bytes_per_batch: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; columns as they came, by any names.

    A source row travels as one struct. Only rows that share both id and text with another are
    shuffled once more, as one of them has to be picked.
    """
    found = exact_groups(docs, bytes_per_batch)
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    twice = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = cut(twice.select(F.col("doc_id").alias("twice_id"), F.col("text_sha256").alias("twice_sha")), "dedup-twice")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col("doc_id").cast("long").alias("id"),
        F.sha2(normalised(), 256).alias("sha"),
    )
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    same = F.col("id").eqNullSafe(F.col("twice_id")) & (F.col("sha") == F.col("twice_sha"))
    one = met.join(twice, same, "left_semi").dropDuplicates(["id", "sha"])
    return met.join(twice, same, "left_anti").unionByName(one).select("record.*")


SQL = """WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)"""
