"""Joins and aggregates over the embedding table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import VECTOR_MODEL
from ..functions.text import assemble_text
from ..functions.vectors import l2_normalize


def for_model(emb: DataFrame, model: str | None = VECTOR_MODEL) -> DataFrame:
    """Rows of one encoder; with the table partitioned by model this prunes folders."""
    return emb if model is None else emb.where(F.col("model") == model)


def vectors_for(ids: DataFrame, emb: DataFrame, model: str | None = VECTOR_MODEL) -> DataFrame:
    """Vectors of the listed ids (``ids.id``), as unit vectors."""
    wanted = ids.select(F.col("id").alias("paper_id")).distinct()
    return (
        for_model(emb, model)
        .join(wanted, "paper_id", "left_semi")
        .select("paper_id", l2_normalize(F.col("vector")).alias("vector"))
    )


def missing_embeddings(
    papers: DataFrame, emb: DataFrame, model: str | None = VECTOR_MODEL
) -> DataFrame:
    have = for_model(emb, model).select(F.col("paper_id").alias("id"))
    return papers.join(have, "id", "left_anti")


def vector_or_null(
    papers: DataFrame, emb: DataFrame, model: str | None = VECTOR_MODEL
) -> DataFrame:
    """All papers; the vector is NULL where there is none."""
    vectors = for_model(emb, model).select(F.col("paper_id").alias("id"), "vector")
    return papers.join(vectors, "id", "left")


def seed_vectors(seeds: DataFrame, emb: DataFrame, model: str | None = VECTOR_MODEL) -> DataFrame:
    """Vectors of the seeds that have one; absent seeds are ignored, none at all is an error."""
    found = vectors_for(seeds, emb, model)
    if found.isEmpty():
        raise ValueError("no seed has a vector; embed the seeds first")
    return found


# Partial sums of a group meet in this many tasks before the last one adds them up.
_FAN_IN = 64


def vector_sums(vectors: DataFrame, by: Sequence[str], vector: Column) -> DataFrame:
    """by, n, total: rows and elementwise sum per group; ``vector`` is an array of doubles.

    Summing happens on the map side, then in up to 64 tasks per group, then in one, so neither a
    group's size nor the number of map tasks falls on a single task. No row is exploded.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(_FAN_IN))
    rows = vectors.select(*by, part.alias("_part"), array_to_vector(vector).alias("_v"))
    partial = rows.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), Summarizer.sum(F.col("_v")).alias("_v")
    )
    return partial.groupBy(*by).agg(
        F.sum("_n").alias("n"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("total")
    )


def centroid(vectors: DataFrame, by: Sequence[str] = (), vector: str = "vector") -> DataFrame:
    """Mean of the unit vectors, made a unit vector again; overall or per group."""
    sums = vector_sums(vectors, by, l2_normalize(F.col(vector)))
    mean = F.transform("total", lambda x: x / F.col("n"))
    return sums.select(*by, l2_normalize(mean).alias("centroid"))


# Maps batches with the columns id and text to batches with id and vector.
BatchEncoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class FrameEncoder:
    """An encoder that is itself a DataFrame operation: rows of id and text to id and vector.

    Ids do not repeat.
    """

    rows: Callable[[DataFrame], DataFrame]


Encoder = BatchEncoder | FrameEncoder


def encode_rows(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """id, vector of rows with id and text."""
    if isinstance(encoder, FrameEncoder):
        return encoder.rows(rows)
    return rows.mapInPandas(encoder, schema=f"{_id_field(rows)}, vector array<float>")


# Letters of text in a task of the encoding: counting its words takes some 30 times their bytes.
TASK_LETTERS = 1 << 22


def embed_missing(
    papers: DataFrame,
    emb: DataFrame,
    encoder: Encoder,
    model: str = VECTOR_MODEL,
    sep: str = "[SEP]",
    partitions: int | None = None,
) -> DataFrame:
    """Unit vectors for the papers that lack one, ready for ``upsert`` into the table.

    A batch encoder runs once per task, so a model is loaded once per task. Id and text travel in
    one row. Encoding costs far more than moving the text, so the rows left to do are spread evenly
    first, over ``partitions`` or else the session's shuffle partitions, or as many more as keep a
    task's text, and so its memory, at one size; a frame encoder that groups by id needs no other
    shuffle.
    """
    todo = missing_embeddings(papers, emb, model).select(
        "id", assemble_text(F.col("title"), F.col("summary"), sep).alias("text")
    )
    n = partitions or task_count(todo)
    return as_embeddings(encode_rows(todo.repartition(n, "id"), encoder), model)


def task_count(rows: DataFrame) -> int:
    """Tasks for rows with text; a pass over the texts counts their letters."""
    letters = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(letters / TASK_LETTERS))


def as_embeddings(encoded: DataFrame, model: str = VECTOR_MODEL) -> DataFrame:
    unit = l2_normalize(F.col("vector")).cast("array<float>")
    return encoded.select(
        F.col("id").alias("paper_id"),
        F.lit(model).alias("model"),
        F.size("vector").alias("dim"),
        unit.alias("vector"),
        F.current_timestamp().alias("created_at"),
    )


WORD = r"[\p{L}\p{N}_]{2,}"

# What a new vector replaces; the time of the first insert stays.
EMBEDDING_COLUMNS = ["model", "dim", "vector"]


def _id_field(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}"


def hashed_encoder(dim: int = 256) -> FrameEncoder:
    """Default encoder for offline use: hashed word counts, damped by log; all of it in the JVM."""
    return FrameEncoder(lambda rows: hashed_vectors(rows, dim))


def hashed_vectors(rows: DataFrame, dim: int = 256) -> DataFrame:
    """id, vector: each distinct word of two or more letters, digits or underscores, in lower case,
    adds log(1 + count) to one of ``dim`` places, or takes it away; the first 32 bits of its MD5
    say which. A null text or one without words has zeros.

    Rows already hashed by id are not shuffled again: words, places and vectors group within it.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    counts = rows.select("id", F.explode_outer(words).alias("w")).groupBy("id", "w").agg(
        F.count("w").alias("n")
    )
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.col("h") >= F.lit(1 << 31), 1.0).otherwise(-1.0)
    # The one row of a text without words has no place and no weight.
    cells = counts.withColumn("h", F.coalesce(h, F.lit(0))).select(
        "id", (F.col("h") % dim).cast("int").alias("at"), (sign * F.log1p("n")).alias("x")
    )
    filled = cells.groupBy("id", "at").agg(F.sum("x").alias("x"))
    held = filled.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("x")
    )
    every = F.sequence(F.lit(0), F.lit(dim - 1))
    vector = F.transform(every, lambda i: F.coalesce(F.try_element_at("x", i), F.lit(0.0)))
    return held.select("id", vector.cast("array<float>").alias("vector"))
