"""Small side inputs: seed lists and supervision labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line: trimmed, blanks dropped, repeats dropped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("id"))
    return lines.where(F.length("id") > 0).distinct()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and the columns id and label (0 or 1)."""
    return spark.read.schema("id string, label int").csv(path, header=True)
