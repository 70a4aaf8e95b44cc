"""Exact top-k by inner product with a table of distances to pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def scaled(vector: str, scale: int) -> Column:
    """Each component as floor(scale * x), or null for a vector that is null or has a component
    that is null or not finite. Products must fit a long: a component of 2^28 or more, once scaled,
    is an error."""
    big = F.lit(float(1 << 28))
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        wide = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(wide) < big, F.floor(wide)).otherwise(F.raise_error(F.lit("a component is too large to score exactly")).cast("long"))

    return F.when(ok, F.transform(vector, whole))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(a), width)


def pivot_table(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of integer rows to the pivots."""
    a, p = rows.astype(np.float64), pivots.astype(np.float64)
    d2 = (a * a).sum(1)[:, None] + (p * p).sum(1)[None] - 2.0 * a @ p.T
    return np.sqrt(np.maximum(d2, 0))


def block_top(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, step: int = 512
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows of one block for each query, ties to smaller ids.

    A pivot p gives |d(q, p) - d(x, p)| <= d(q, x); the greatest over all pivots bounds the
    distance from below, and so the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Rows are
    scored in the order of that bound, and a query stops when the next bound is below its k-th
    score: nothing left can enter, not even by a tie.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    dx, dq = pivot_table(x, pivots), pivot_table(q, pivots)
    nx, nq = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (nx.max(initial=0) + nq.max(initial=0)) + 1e-3  # for rounding of the distances
    out_q, out_i, out_s = [], [], []
    for n in range(len(q)):
        low = np.zeros(len(x))
        for p in range(dx.shape[1]):
            np.maximum(low, np.abs(dx[:, p] - dq[n, p]), out=low)
        bound = (nq[n] + nx - low * low) / 2 + slack
        bound[ids == q_ids[n]] = -np.inf
        by = np.argsort(-bound, kind="stable")
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(by), step):
            part = by[i : i + step]
            if bound[part[0]] == -np.inf or (len(best_s) == k and bound[part[0]] < best_s[-1]):
                break
            part = part[bound[part] > -np.inf]
            s = np.concatenate([best_s, x[part] @ q[n]])
            c = np.concatenate([best_i, ids[part]])
            top = np.lexsort((c, -s))[:k]
            best_s, best_i = s[top], c[top]
        out_q.append(np.full(len(best_i), q_ids[n]))
        out_i.append(best_i)
        out_s.append(best_s)
    join = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
    return join(out_q), join(out_i), join(out_s)


def pivot_top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    n_pivots: int = 32,
    query_block: int = 1024,
    row_block: int = 16384,
) -> DataFrame:
    """The k rows of highest integer inner product for every query row, itself left out.

    Queries meet all rows in blocks: a task has one block of either, its size does not grow with
    the table, and it returns k rows a query. ``n_pivots`` rows, those of smallest hash of the
    id, serve as pivots; they steer the work and never the result. Vectors that are null or hold
    null or non-finite components, or none at all, take no part, nor rows with a null id; components
    too large to score exactly are an error; an id that comes twice
    is two rows, neither its own candidate. All vectors must have the same width. A table without
    usable rows gives no rows; other columns are not looked at.

    Returns query_id, rank from 1, vec_id, score.
    """
    usable = rows.select(
        F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("v"), is_query.alias("q")
    ).where("v is not null and size(v) > 0 and id is not null")
    usable = cut(usable, "topk-rows")
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").collect()
    if not sample:
        empty = "query_id long, rank int, vec_id long, score long"
        return rows.sparkSession.createDataFrame([], empty)
    pivots = np.array([r.v for r in sample], np.int64)
    width = pivots.shape[1]
    counts = usable.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).first()
    n_rows, n_queries = -(-counts.n // row_block), max(1, -(-counts.m // query_block))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = usable.where("q").select("id", "v", block(n_queries).alias("qb"), every(n_rows).alias("rb"))
    right = usable.select("id", "v", block(n_rows).alias("rb")).withColumn("qb", every(n_queries))

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = [t.column("id").to_numpy() for t in (a, b)]
        found = block_top(ids[0], _matrix(a.column("v"), width), ids[1], _matrix(b.column("v"), width), pivots, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            return kernel(a, b)
        return pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")]).empty_table()

    schema = "query_id long, vec_id long, score long"
    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(pair, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5"""
