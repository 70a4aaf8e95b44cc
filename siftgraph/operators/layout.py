"""Points on a canvas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, array_of, block_cogroup, codes

_COINCIDENT = 1e-12


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )


def unit_square(points: DataFrame) -> DataFrame:
    """Per-axis min-max scaling with a floor on the range."""
    box = bounds(points).select(F.struct("*")).scalar()
    rows = points.withColumn("_b", box)

    def scaled(axis: str) -> Column:
        low, high = F.col(f"_b.min_{axis}"), F.col(f"_b.max_{axis}")
        return (F.col(axis) - low) / F.greatest(high - low, F.lit(1e-9))

    return rows.withColumns({"x": scaled("x"), "y": scaled("y")}).drop("_b")


def on_canvas(points: DataFrame, w: int = 1000, h: int = 700, pad: int = 24) -> DataFrame:
    """Unit square to integer pixels, truncated."""
    return points.withColumns(
        {
            "x": (F.lit(pad) + F.col("x") * (w - 2 * pad)).cast("int"),
            "y": (F.lit(pad) + F.col("y") * (h - 2 * pad)).cast("int"),
        }
    )


def scale_to_canvas(points: DataFrame, w: int = 1000, h: int = 700, pad: int = 24) -> DataFrame:
    return on_canvas(unit_square(points), w, h, pad)


def _cells(points: DataFrame, r: float) -> tuple[DataFrame, DataFrame]:
    """Points in their own grid cell, and in their own and the eight around it."""
    own = points.withColumns(
        {"gx": F.floor(F.col("x") / r), "gy": F.floor(F.col("y") / r)}
    )
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = own.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    around = around.withColumns(
        {"gx": F.col("gx") + F.col("_dx"), "gy": F.col("gy") + F.col("_dy")}
    )
    return own, around.drop("_dx", "_dy")


def _offsets(left: pa.Table, right: pa.Table, start: int, stop: int, r: float):
    x, y = left.column("x").to_numpy()[start:stop], left.column("y").to_numpy()[start:stop]
    dx = x[:, None] - right.column("x").to_numpy()[None, :]
    dy = y[:, None] - right.column("y").to_numpy()[None, :]
    d2 = dx * dx + dy * dy
    return dx, dy, d2, (d2 < r * r) & (d2 > _COINCIDENT)


_STRIP = 512


def grid_join(points: DataFrame, r: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs a < b closer than ``r`` (not coincident), with their distance."""
    own, around = _cells(points.select("id", "x", "y"), r)
    kind = points.schema["id"].dataType.simpleString()

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = array_of(left, "id"), array_of(right, "id")
        here, there = codes(a, b)
        out = []
        for start in range(0, len(a), _STRIP):
            stop = min(start + _STRIP, len(a))
            _, _, d2, near = _offsets(left, right, start, stop, r)
            i, j = np.nonzero(near & (here[start:stop, None] < there[None, :]))
            out.append(pa.table({"a": a.take(pa.array(i + start)), "b": b.take(pa.array(j)), "d": np.sqrt(d2[i, j])}))
        # The strips stay as they are, so a block's pairs are held once.
        return pa.concat_tables(out)

    return block_cogroup(
        own, around, ["gx", "gy"], "id", "id", kernel, f"a {kind}, b {kind}, d double", block_rows
    )


def decollide(points: DataFrame, r: float = 0.01, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Push every pair closer than ``r`` apart by half its overlap each, all pairs at once.

    Equal positions are collapsed with their count, and a task returns one summed push per
    position instead of pairs.
    """
    spots = points.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    spots = spots.withColumn("id", F.struct("x", "y"))
    own, around = _cells(spots, r)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        px, py = np.zeros(left.num_rows), np.zeros(left.num_rows)
        n = right.column("n").to_numpy()
        for start in range(0, left.num_rows, _STRIP):
            stop = min(start + _STRIP, left.num_rows)
            dx, dy, d2, near = _offsets(left, right, start, stop, r)
            d = np.sqrt(np.where(near, d2, 1.0))
            push = np.where(near, 0.5 * (r - d) / d, 0.0) * n[None, :]
            px[start:stop], py[start:stop] = (dx * push).sum(axis=1), (dy * push).sum(axis=1)
        return pa.table({"x": left.column("x"), "y": left.column("y"), "px": px, "py": py})

    pushes = block_cogroup(
        own, around, ["gx", "gy"], "id", "id", kernel,
        "x double, y double, px double, py double", block_rows,
    )
    total = pushes.groupBy("x", "y").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
    moved = points.join(total, ["x", "y"], "left").withColumns(
        {
            "x": F.col("x") + F.coalesce("px", F.lit(0.0)),
            "y": F.col("y") + F.coalesce("py", F.lit(0.0)),
        }
    )
    return moved.select(*points.columns)
