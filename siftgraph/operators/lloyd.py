"""k-means by passes over the rows that advance all runs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import matrix
from .vectors import vector_sums

# Centres of all runs travel to every task; this many values (32 MB) is the most that may.
MAX_CENTER_VALUES = 4_000_000
# Rows that are compared with all centres at once.
_STRIP = 4096


def _strips(batches, vec_col: str):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(0, table.num_rows, _STRIP):
            part = table.slice(i, _STRIP)
            yield part, matrix(part, vec_col)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row (ties to the smaller) and the squared distance to it."""
    d2 = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * x @ c.T
    found = np.round(d2, 12).argmin(axis=1)
    return found, np.maximum(d2[np.arange(len(x)), found], 0.0)


def _tally(rows: DataFrame, centers: list[np.ndarray], vec_col: str) -> dict[tuple[int, int], tuple[float, float, np.ndarray]]:
    """Per run and centre: rows nearest to it, their squared distances in sum, and their sum.

    A task sends one row per run and centre, and these are summed in two levels, so what the driver
    gets is as large as the centres.
    """
    if sum(c.size for c in centers) > MAX_CENTER_VALUES:
        raise ValueError("too many centres to send to every task")
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def add(batches):
        runs = shared.value
        sums = [np.zeros((len(c), c.shape[1] + 2)) for c in runs]
        for _, x in _strips(batches, vec_col):
            for total, c in zip(sums, runs, strict=True):
                found, d2 = _nearest(x, c)
                order = np.argsort(found, kind="stable")
                met, first = np.unique(found[order], return_index=True)
                total[met, 2:] += np.add.reduceat(x[order], first, axis=0)
                total[:, 0] += np.bincount(found, minlength=len(c))
                total[:, 1] += np.bincount(found, d2, minlength=len(c))
        for run, total in enumerate(sums):
            met = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_pydict(
                {"run": pa.array(np.full(len(met), run, np.int32)), "c": pa.array(met.astype(np.int32)), "v": pa.array(list(total[met]), pa.list_(pa.float64()))}
            )

    parts = rows.select(vec_col).mapInArrow(add, "run int, c int, v array<double>")
    found = vector_sums(parts, ["run", "c"], F.col("v")).collect()
    return {(r.run, r.c): (r.total[0], r.total[1], np.array(r.total[2:])) for r in found}


def lloyd(
    rows: DataFrame, centers: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4, vec_col: str = "vector"
) -> list[tuple[float, np.ndarray]]:
    """(inertia, centres) of every run of Lloyd's algorithm from given centres.

    One pass moves the centres of all runs that still move by more than ``tol``; a centre without
    rows stays where it is. The inertia is that of the assignment to the centres before their last
    move.
    """
    centers = [np.asarray(c, dtype=np.float64) for c in centers]
    cost, live = [np.inf] * len(centers), list(range(len(centers)))
    for _ in range(max_iter):
        tally = _tally(rows, [centers[r] for r in live], vec_col)
        still = []
        for i, r in enumerate(live):
            moved = centers[r].copy()
            mine = {c: v for (run, c), v in tally.items() if run == i}
            for c, (n, _, total) in mine.items():
                moved[c] = total / n
            cost[r] = sum(d2 for _, d2, _ in mine.values())
            if ((moved - centers[r]) ** 2).sum(axis=1).max() > tol * tol:
                still.append(r)
            centers[r] = moved
        live = still
        if not live:
            break
    return list(zip(cost, centers, strict=True))


def seeds(rows: DataFrame, k: int, seed: int, n_init: int, rounds: int = 2, vec_col: str = "vector") -> list[np.ndarray]:
    """``k`` first centres for each run, drawn in ``rounds`` of oversampling by distance.

    Each round takes a row with probability 2k times its share of all squared distances, as a hash
    of its number, the run and the round decides; so about 2k rows a round and run reach the driver,
    which draws ``k`` of them by distance and by the rows that are nearest to them. ``rows`` has a
    row number ``i``.
    """
    first = rows.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(n_init).select(vec_col).toArrow()
    drawn = matrix(first, vec_col)
    if not len(drawn):
        return []
    found = [drawn[r % len(drawn)][None] for r in range(n_init)]
    for turn in range(rounds):
        tally = _tally(rows, found, vec_col)
        total = [sum(v[1] for (run, _), v in tally.items() if run == r) for r in range(n_init)]
        found = _oversampled(rows, found, total, k, seed, turn, vec_col)
    tally = _tally(rows, found, vec_col)
    out = []
    for r, c in enumerate(found):
        weight = np.array([tally.get((r, i), (0.0,))[0] for i in range(len(c))])
        out.append(_plus_plus(c, weight, k, np.random.default_rng([seed, r])))
    return out


def _oversampled(rows: DataFrame, found: list[np.ndarray], total: list[float], k: int, seed: int, turn: int, vec_col: str) -> list[np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(found)
    draws = [F.pmod(F.xxhash64("i", F.lit(seed), F.lit(r), F.lit(turn)), F.lit(1 << 52)) / float(1 << 52) for r in range(len(found))]

    def pick(batches):
        for table, x in _strips(batches, vec_col):
            u = matrix(table, "u")
            for r, c in enumerate(shared.value):
                if total[r] <= 0:
                    continue
                at = np.flatnonzero(u[:, r] * total[r] < 2 * k * _nearest(x, c)[1])
                some = table.take(pa.array(at))
                yield from pa.table({"run": pa.array(np.full(len(at), r, np.int32)), "i": some.column("i"), "v": some.column(vec_col)}).to_batches()

    kind = rows.schema[vec_col].dataType.simpleString()
    taken = rows.select("i", vec_col, F.array(*draws).alias("u")).mapInArrow(pick, f"run int, i long, v {kind}").toArrow()
    taken = taken.sort_by([("run", "ascending"), ("i", "ascending")])
    run = taken.column("run").to_numpy()
    return [np.concatenate([c, matrix(part, "v")]) if (part := taken.filter(pa.array(run == r))).num_rows else c for r, c in enumerate(found)]


def _plus_plus(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of the rows, each drawn by weight times squared distance to those drawn before."""
    share, out = weight.astype(float), []
    near = np.full(len(x), np.inf)
    for _ in range(k):
        if share.sum() <= 0:
            share = np.ones(len(x))
        out.append(x[rng.choice(len(x), p=share / share.sum())])
        near = np.minimum(near, ((x - out[-1]) ** 2).sum(axis=1))
        share = weight * near
    return np.array(out)


def best_centers(
    emb: DataFrame, k: int, seed: int, n_init: int, max_iter: int, vec_col: str = "vector"
) -> np.ndarray:
    """Centres of the run with the least inertia, ties to the first."""
    vector = F.col(vec_col).cast("array<double>").alias(vec_col)
    rows = emb.select(vector).where(F.col(vec_col).isNotNull())
    rows = cut(rows.withColumn("i", F.monotonically_increasing_id()), "kmeans-rows")
    begin = seeds(rows, k, seed, n_init, vec_col=vec_col)
    if not begin:
        raise ValueError("no vector to cluster")
    runs = lloyd(rows, begin, max_iter, vec_col=vec_col)
    return min(enumerate(runs), key=lambda r: (r[1][0], r[0]))[1][1]
