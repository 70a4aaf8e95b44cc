"""Sorts, numbering and top-k that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import hot_split_join


def _placed(df: DataFrame, order: Sequence[Column], weight: Column) -> DataFrame:
    """Sorted rows with their sort partition ``_p``, place in it ``_m`` and ``_off``, the weight
    of all partitions before.

    A range sort spreads any run of equal leading keys over partitions. The sorted rows are
    written once, so the sums and the final numbers see the same partitions; what is broadcast
    is one row per sort partition.
    """
    sorted_ = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    rows = sorted_.withColumn("_p", F.shiftrightunsigned(F.col("_m"), 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_p")
        .agg(F.sum(weight).alias("_n"))
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return rows.join(F.broadcast(offsets), "_p")


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """0-based position of each row in a total order, with no single-partition window."""
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = _placed(df, order, F.lit(1)).withColumn(name, F.col("_off") + local)
    return rows.drop("_p", "_off", "_m")


def running_total(
    df: DataFrame, order: Sequence[Column], weight: str, name: str = "upto"
) -> DataFrame:
    """Sum of ``weight`` over the rows up to and including each, in a total order.

    The window runs inside one sort partition at a time.
    """
    upto = F.sum(weight).over(Window.partitionBy("_p").orderBy("_m"))
    rows = _placed(df, order, F.col(weight)).withColumn(name, F.col("_off") + upto)
    return rows.drop("_p", "_off", "_m")


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos"
) -> DataFrame:
    """0-based rank inside each key: global position minus the key's first position.

    Unlike a window it never brings all rows of a key to one task.
    """
    placed = number_rows(df, [*[F.col(k) for k in keys], *order], "_g")
    placed = cut(placed, "ranked")
    first = placed.groupBy(*keys).agg(
        F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    first = cut(first, "firsts")
    return (
        hot_split_join(placed, first, keys, "_rows", "_g")
        .withColumn(name, F.col("_g") - F.col("_first"))
        .drop("_g", "_first", "_rows")
    )


def order_nodes(df: DataFrame) -> DataFrame:
    """Cluster ascending, then newest first (dates are ISO text), ties by id."""
    return df.orderBy(F.col("cid").asc(), F.col("published").desc(), F.col("id").asc())


def dense_node_id(df: DataFrame, name: str = "node") -> DataFrame:
    """0-based node numbers in the order of ``order_nodes``."""
    return number_rows(
        df, [F.col("cid").asc(), F.col("published").desc(), F.col("id").asc()], name
    )


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first k rows of each group; the planner limits groups before the shuffle too."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def page(df: DataFrame, order: Sequence[Column], n: int = 40, offset: int = 0) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(n)
