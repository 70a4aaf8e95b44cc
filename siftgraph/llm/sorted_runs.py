"""Sums and last values along a total order, with no window wider than a sort partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut


def _here() -> WindowSpec:
    return Window.partitionBy("_p").orderBy("_m")


def _before() -> WindowSpec:
    """Over a table of one row per sort partition."""
    return Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def in_order(df: DataFrame, order: Sequence[Column], name: str = "in-order") -> DataFrame:
    """``df`` as a written table in a total order, with its sort partition ``_p`` and the number
    ``_m``, which grows along the order."""
    rows = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    return rows.withColumn("_p", F.shiftrightunsigned(F.col("_m"), 33))


def running_sums(rows: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Rows of ``in_order`` with the sum of each column up to and including them.

    What is broadcast is one row per sort partition.
    """
    totals = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = totals.select("_p", *[F.coalesce(F.sum(f"_{n}").over(_before()), F.lit(0)).alias(f"_{n}") for n in sums])
    met = rows.join(F.broadcast(before), "_p")
    upto = {n: F.col(f"_{n}") + F.sum(c).over(_here()) for n, c in sums.items()}
    return met.withColumns(upto).drop(*[f"_{n}" for n in sums])


def last_seen(rows: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Rows of ``in_order`` with, for each column, its last value that is not null so far.

    A partition begins with what those before it have left: one row per sort partition.
    """
    tails = rows.groupBy("_p").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("_m"))).alias(f"_{n}") for n, c in values.items()])
    before = tails.select("_p", *[F.last(f"_{n}", ignorenulls=True).over(_before()).alias(f"_{n}") for n in values])
    met = rows.join(F.broadcast(before), "_p")
    found = {n: F.coalesce(F.last(c, ignorenulls=True).over(_here()), F.col(f"_{n}")) for n, c in values.items()}
    return met.withColumns(found).drop(*[f"_{n}" for n in values])
