"""Blocked pairing: every pair of rows sharing a key meets in one task, no task holds a key.

Rows of a key are hashed into blocks of about ``block_rows``; each block of the left side is
cogrouped with each block of the right side. A key with a third of all rows becomes many tasks
of the same size as any other, and a kernel returns only what it selects, never all pairs.
A row travels once for each block it meets, so where a kernel can take larger blocks (``task_rows``)
a key has a few blocks, and more only when these would get too large for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .joins import hot_split_join

BLOCK_ROWS = 4096
# Numbers in the vectors of a block where the kernel works through it in strips: 16 MB.
TASK_VALUES = 1 << 21
# A key gets no more blocks than these unless they would hold more than ``task_rows``.
FEW_BLOCKS = 8


def task_rows_of(points: DataFrame, vec: str = "vec") -> int:
    """Rows whose vectors a task takes as one block; never fewer than ``BLOCK_ROWS``."""
    first = points.select(F.size(vec).alias("n")).first()
    return max(BLOCK_ROWS, TASK_VALUES // max(1, first["n"])) if first else BLOCK_ROWS


def block_count(rows: Column, block_rows: int, task_rows: int | None, few: int) -> Column:
    """Blocks for a key of so many rows."""
    wanted = F.ceil(rows / F.lit(block_rows))
    if task_rows is not None:
        wanted = F.least(wanted, F.greatest(F.lit(few).cast("long"), F.ceil(rows / F.lit(task_rows))))
    return wanted.cast("int")


def block_cogroup(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_id: str,
    right_id: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    symmetric: bool = False,
    task_rows: int | None = None,
    few: int = FEW_BLOCKS,
) -> DataFrame:
    """``symmetric``: both sides are the same rows, so a block pair is formed in one order only.

    With ``task_rows`` the blocks of a large key grow up to it before there are more than ``few``.
    """
    key = list(key)
    # Both sides may come from one table; fresh column identities keep them apart.
    left = left.select(*[F.col(c).alias(c, metadata={}) for c in left.columns])
    right = right.select(*[F.col(c).alias(c, metadata={}) for c in right.columns])

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(*key).agg(n.alias(f"_rows{name}"), block_count(n, block_rows, task_rows, few).alias(f"_n{name}"))

    # One row per key; inner, since a key absent on one side has no pairs. Written, so that the
    # planner knows its size and a key with a third of all rows is never met whole.
    sizes = cut(blocks(left, "l").join(blocks(right, "r"), key), "blocks")

    def own(id_col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_col), F.col(n)).cast("int")

    def others(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(first, last))

    lefts = (
        hot_split_join(left, sizes.drop("_rowsr"), key, "_rowsl", left_id)
        .withColumn("_l", own(left_id, "_nl"))
        .withColumn("_r", others(F.col("_l") if symmetric else F.lit(0), F.col("_nr") - 1))
        .drop("_nl", "_nr", "_rowsl")
    )
    rights = (
        hot_split_join(right, sizes.drop("_rowsl"), key, "_rowsr", right_id)
        .withColumn("_r", own(right_id, "_nr"))
        .withColumn("_l", others(F.lit(0), F.col("_r") if symmetric else F.col("_nl") - 1))
        .drop("_nl", "_nr", "_rowsr")
    )
    at = [*key, "_l", "_r"]
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        # A block that drew no rows still meets the blocks of the other side.
        return kernel(a, b) if a.num_rows and b.num_rows else empty

    return lefts.groupBy(*at).cogroup(rights.groupBy(*at)).applyInArrow(pair, schema)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column as a 2-D float64 array."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(m: np.ndarray, eps: float) -> np.ndarray:
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + eps)


def array_of(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of two columns as equal integers, in value order."""
    both = pa.concat_arrays([a, b])
    ranks = pa.compute.rank(both, sort_keys="ascending", tiebreaker="dense").to_numpy()
    ranks = ranks.astype(np.int64)
    return ranks[: len(a)], ranks[len(a) :]
