"""Harvested XML pages as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import ABSTRACT_URL, PDF_URL
from ..functions.text import strip

RECORD = (
    "header struct<_status: string, identifier: string, datestamp: string>, "
    "metadata struct<arXiv: struct<id: string, created: string, updated: string, title: string, "
    "abstract: string, categories: string, "
    "authors: struct<author: array<struct<keyname: string, forenames: string>>>>>"
)


def read_records(
    spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """One row per ``record`` element, with where and when its page landed.

    Pages may lie in folders below ``path``; ``landed_set`` is the name of a page's own folder.
    """
    reader = (spark.readStream if streaming else spark.read).format("xml")
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.option("rowTag", "record")
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .schema(RECORD)
        .load(path)
        .withColumn("landed_at", F.col("_metadata.file_modification_time"))
        .withColumn("landed_in", F.col("_metadata.file_name"))
        .withColumn("landed_set", F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)/[^/]*$", 1))
    )


def _text(path: str) -> Column:
    return strip(F.coalesce(F.col(path), F.lit("")))


def valid_records(df: DataFrame) -> DataFrame:
    """Drop deleted headers, records without metadata and blank ids."""
    alive = F.col("header").isNotNull() & ~F.col("header._status").eqNullSafe("deleted")
    named = F.length(_text("metadata.arXiv.id")) > 0
    return df.where(alive & F.col("metadata.arXiv").isNotNull() & named)


def project_record(df: DataFrame) -> DataFrame:
    """Record to flat row; arrival columns are passed through for last-wins ordering."""
    body = "metadata.arXiv"
    blank = F.lit("")
    names = F.transform(
        F.col(f"{body}.authors.author"),
        lambda a: strip(
            F.concat_ws(
                " ",
                strip(F.coalesce(a["forenames"], blank)),
                strip(F.coalesce(a["keyname"], blank)),
            )
        ),
    )
    number = _text(f"{body}.id")
    carried = [c for c in ("landed_at", "landed_in", "landed_set") if c in df.columns]
    return df.select(
        F.concat(F.lit(ABSTRACT_URL), number).alias("id"),
        _text(f"{body}.title").alias("title"),
        F.coalesce(F.array_join(F.filter(names, lambda n: n != ""), ", "), blank).alias("authors"),
        _text(f"{body}.created").alias("published"),
        _text(f"{body}.abstract").alias("summary"),
        F.concat(F.lit(ABSTRACT_URL), number).alias("link"),
        _text(f"{body}.categories").alias("categories"),
        _text(f"{body}.updated").alias("updated"),
        F.concat(F.lit(PDF_URL), number, F.lit(".pdf")).alias("pdf_url"),
        F.col("header.datestamp").alias("datestamp"),
        *carried,
    )


def in_window(df: DataFrame, from_date: str | None, until_date: str | None) -> DataFrame:
    """Inclusive harvest window on the day of the header's datestamp (ISO text)."""
    day = F.substring("datestamp", 1, 10)
    if from_date:
        df = df.where(day >= from_date)
    return df.where(day <= until_date) if until_date else df
