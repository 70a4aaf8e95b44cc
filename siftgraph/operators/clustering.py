"""Clusterings of the kept vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..session import cut
from .blocks import block_cogroup, matrix, task_rows_of
from .joins import hot_split_join
from .linkage import linkage_levels, single_linkage
from .lloyd import MAX_CENTER_VALUES, best_centers
from .neighbours import knn_join, points_of
from .ordering import number_rows
from .spanning import jump_to_roots, reachability_mst
from .vectors import vector_sums


def pca(emb: DataFrame, d: int, id_col: str = "paper_id", vec_col: str = "vector") -> DataFrame:
    """Centred principal components, largest loading positive: id, vector of length d.

    The covariance is accumulated over partitions; only a dim x dim matrix reaches the driver.
    The built-in transform does not centre, so the projected mean is taken off afterwards.
    """
    rows = emb.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
    model = PCA(k=d, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    signs[signs == 0] = 1.0
    sums = vector_sums(rows, [], vector_to_array("v")).first()
    mean = np.array(sums["total"]) / sums["n"]
    shift = (mean @ loadings).tolist()
    sign = F.array(*[F.lit(float(s)) for s in signs])
    offset = F.array(*[F.lit(float(s)) for s in shift])
    centred = F.zip_with(vector_to_array("p"), offset, lambda x, m: x - m)
    return model.transform(rows).select(
        id_col, F.zip_with(centred, sign, lambda x, s: x * s).alias(vec_col)
    )


def pca_coords(emb: DataFrame, id_col: str = "paper_id", vec_col: str = "vector") -> DataFrame:
    """Two principal components of the unit vectors as x and y."""
    unit = emb.select(id_col, l2_normalize(F.col(vec_col)).alias(vec_col))
    return pca(unit, 2, id_col, vec_col).select(
        id_col, F.col(vec_col)[0].alias("x"), F.col(vec_col)[1].alias("y")
    )


def prepared(
    emb: DataFrame, reduce_dim: int | None = None, id_col: str = "paper_id", vec_col: str = "vector"
) -> DataFrame:
    """Vectors as the clusterings take them: optionally reduced, then made unit vectors."""
    rows = pca(emb, reduce_dim, id_col, vec_col) if reduce_dim else emb
    return rows.select(id_col, l2_normalize(F.col(vec_col)).alias(vec_col))


def kmeans_centers(
    emb: DataFrame,
    k: int = 8,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 300,
    vec_col: str = "vector",
) -> np.ndarray:
    """Centres of the run with the least inertia; each pass over the rows advances all runs."""
    return best_centers(emb, k, seed, n_init, max_iter, vec_col)


def assign_nearest(
    emb: DataFrame, centers: np.ndarray, vec_col: str = "vector", out: str = "cluster"
) -> DataFrame:
    """Add the index of the nearest centre (ties to the smaller); one narrow Arrow pass."""
    if centers.size > MAX_CENTER_VALUES:
        raise ValueError("too many centres to send to every task; use top_matches instead")
    shared = emb.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))

    def nearest(batches):
        c = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows:
                d2 = (c * c).sum(axis=1)[None, :] - 2.0 * matrix(table, vec_col) @ c.T
                found = np.round(d2, 12).argmin(axis=1).astype(np.int32)
                yield from table.append_column(out, pa.array(found)).to_batches()

    schema = T.StructType([*emb.schema.fields, T.StructField(out, T.IntegerType())])
    return emb.mapInArrow(nearest, schema)


def kmeans(
    emb: DataFrame,
    k: int = 8,
    seed: int = 42,
    n_init: int = 10,
    id_col: str = "paper_id",
    vec_col: str = "vector",
    out: str = "kmeans_cluster",
) -> DataFrame:
    centers = kmeans_centers(emb, k, seed, n_init, vec_col=vec_col)
    return assign_nearest(emb, centers, vec_col, out).select(id_col, out)


# Clusters that may meet in one task: a block of the pairing, and the end of the merging one by one.
WARD_ROWS = 2048
# Clusters of which one task goes on with the rounds: 8 MB of vectors of 64 numbers. A round of jobs
# over so few costs more than the comparing.
WARD_LAST_ROWS = 16384


def ward(
    emb: DataFrame,
    k: int = 8,
    id_col: str = "paper_id",
    vec_col: str = "vector",
    out: str = "agg_cluster",
    block_rows: int = WARD_ROWS,
    last_rows: int | None = None,
) -> DataFrame:
    """Ward's hierarchical clusters cut at k, exact at every size.

    A round merges all pairs of clusters that are each other's nearest. No merge brings a third
    cluster closer than the nearer of its two parts was, so these pairs also meet when pairs are
    merged one by one, and the tree is the same. The last ``last_rows`` clusters (``WARD_LAST_ROWS``,
    or ``block_rows`` if that is given) are merged in one task, in rounds until ``block_rows`` are left
    and then one by one. The k clusters are what is left when the k - 1 dearest merges are undone, numbered
    by their smallest ids. Copies of a vector merge first, at no cost, and are one row from the
    start, so fewer than k different vectors make fewer clusters. Ties go to the smaller ids.

    Nearest clusters are found by comparing all blocks, which is quadratic, as the exact tree
    demands; what leaves a block pair is one row per cluster.
    """
    rows = emb.select(id_col, F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    heads = rows.groupBy("v").agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_rows"))
    leaves = cut(number_rows(heads, [F.col("_id")], "m"), "leaves")
    live = leaves.select("m", F.col("_rows").cast("double").alias("n"), F.col("v").alias("c"))
    merges, task_rows = None, task_rows_of(leaves, "v")
    if last_rows is None:
        last_rows = WARD_LAST_ROWS if block_rows == WARD_ROWS else block_rows
    while live.count() > last_rows:
        best = _ward_nearest(live, block_rows, task_rows).groupBy("i").agg(F.min(F.struct("cost", "lo", "hi")).alias("p"))
        picks = best.groupBy("p.lo", "p.hi").agg(F.min("p.cost").alias("cost"), F.count(F.lit(1)).alias("picks"))
        picks = cut(picks, "picks")
        pairs = picks.where("picks = 2")
        if pairs.isEmpty():
            # Rounding can hide a pair from one of its sides; the cheapest of all may always merge.
            pairs = picks.orderBy("cost", "lo", "hi").limit(1)
        pairs = cut(pairs.select("lo", "hi", "cost"), "merges")
        merges = pairs if merges is None else merges.union(pairs)
        live = cut(_ward_merged(live, pairs), "live", [live, picks])

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by("m")
        m, c, n = table.column("m").to_numpy(), matrix(table, "c"), table.column("n").to_numpy()
        at, c, n, lo, hi, cost = ward_rounds(c, n, block_rows)
        left = ward_tree(c, n)
        lo, hi = np.concatenate([lo, at[left[0]]]), np.concatenate([hi, at[left[1]]])
        return pa.table({"lo": m[lo], "hi": m[hi], "cost": np.concatenate([cost, left[2]])})

    # One group of at most ``last_rows`` clusters.
    last = live.groupBy(F.lit(0).alias("all")).applyInArrow(finish, "lo long, hi long, cost double")
    merges = cut(last if merges is None else merges.union(last), "merges")
    dear = merges.orderBy(F.desc("cost"), F.desc("lo"), F.desc("hi")).limit(k - 1).select("hi")
    kept = merges.join(dear, "hi", "left_anti").select(F.col("hi").alias("m"), "lo")
    # A merged cluster keeps the smaller number, so every other leaf points to a smaller one.
    roots = jump_to_roots(
        leaves.select("m").join(kept, "m", "left").select(F.col("m").alias("c"), F.coalesce("lo", "m").alias("r"))
    )
    named = number_rows(roots.select("r").distinct(), [F.col("r")], "_n")
    labels = roots.join(named, "r").select(F.col("c").alias("m"), F.col("_n").cast("int").alias(out))
    labelled = cut(leaves.join(labels, "m").select("v", "_rows", out), "labelled")
    return hot_split_join(rows, labelled, ["v"], "_rows", id_col).select(id_col, out)


# Costs a task holds at a time.
_WARD_HELD = 1 << 22


def _ward_nearest(live: DataFrame, block_rows: int, task_rows: int) -> DataFrame:
    """(i, cost, lo, hi): for each block that a cluster meets, its cheapest pair there."""
    # Always 0, but not a constant: a join on constants would be planned as a nested loop.
    side = live.withColumn("cell", F.pmod(F.xxhash64("m"), F.lit(1)))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("m"), right.sort_by("m")
        i, j = left.column("m").to_numpy(), right.column("m").to_numpy()
        x, y = matrix(left, "c"), matrix(right, "c")
        n, w = left.column("n").to_numpy(), right.column("n").to_numpy()
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        same = np.array_equal(i, j)
        to, least = np.zeros(len(i), np.int64), np.full(len(i), np.inf)
        back, dear = (to, least) if same else (np.zeros(len(j), np.int64), np.full(len(j), np.inf))
        strip = max(16, min(512, _WARD_HELD // len(j)))
        for s in range(0, len(i), strip):
            # A block with itself: each pair is computed once, in the strip of its first cluster.
            e, first = min(len(i), s + strip), s if same else 0
            d = x[s:e] @ y[first:].T
            d *= -2.0
            d += xx[s:e, None]
            d += yy[None, first:]
            np.maximum(d, 0.0, out=d)
            d *= n[s:e, None] * w[None, first:] / (n[s:e, None] + w[None, first:])
            if same:
                d[:, : e - s] = np.minimum(d[:, : e - s], d[:, : e - s].T)
                np.fill_diagonal(d, np.inf)
            # Only less is nearer, so ties stay with the smaller number.
            for axis, at, near, cost in ((0, slice(first, None), back, dear), (1, slice(s, e), to, least)):
                found = d.argmin(axis=axis)
                value = np.take_along_axis(d, np.expand_dims(found, axis), axis).ravel()
                nearer = value < cost[at]
                near[at][nearer], cost[at][nearer] = found[nearer] + (s if axis == 0 else first), value[nearer]
        if same:
            one, other, cost = i, i[to], least
        else:
            one, other = np.concatenate([i, j]), np.concatenate([j[to], i[back]])
            cost = np.concatenate([least, dear])
        table = {"i": one, "cost": cost, "lo": np.minimum(one, other), "hi": np.maximum(one, other)}
        return pa.table(table).filter(pa.array(np.isfinite(cost)))

    schema = "i long, cost double, lo long, hi long"
    return block_cogroup(side, side, ["cell"], "m", "m", kernel, schema, block_rows, symmetric=True, task_rows=task_rows)


def _ward_merged(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters after the merges; a merged one has the number of its smaller part."""
    gone = live.join(pairs.select(F.col("hi").alias("m"), "lo"), "m").select(
        F.col("lo").alias("m"), F.col("n").alias("_n"), F.col("c").alias("_c")
    )
    stay = live.join(pairs.select(F.col("hi").alias("m")), "m", "left_anti").join(gone, "m", "left")
    both = F.col("n") + F.col("_n")
    mean = F.zip_with("c", "_c", lambda x, y: (x * F.col("n") + y * F.col("_n")) / both)
    return stay.select(
        "m", F.coalesce(both, "n").alias("n"), F.when(F.col("_n").isNull(), F.col("c")).otherwise(mean).alias("c")
    )


def _ward_nearest_of(rows: np.ndarray, to: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows`` the nearest of ``to`` (both in order) but itself, ties to the smaller, and its cost."""
    near, cost = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    y, w = c[to], n[to]
    yy = (y * y).sum(axis=1)
    strip = max(16, (1 << 18) // max(1, len(to)))
    for s in range(0, len(rows), strip):
        own = rows[s : s + strip]
        x, m = c[own], n[own]
        d = x @ y.T
        d *= -2.0
        d += (x * x).sum(axis=1)[:, None]
        d += yy[None, :]
        np.maximum(d, 0.0, out=d)
        d *= m[:, None] * w[None, :] / (m[:, None] + w[None, :])
        at = np.minimum(np.searchsorted(to, own), len(to) - 1)
        here = np.flatnonzero(to[at] == own)
        d[here, at[here]] = np.inf
        found = d.argmin(axis=1)
        near[s : s + strip], cost[s : s + strip] = to[found], d[np.arange(len(own)), found]
    return near, cost


def ward_rounds(
    c: np.ndarray, n: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounds that merge mutual nearest clusters until at most ``most`` are left: which these are, their
    centres and rows, and the merges (kept, gone, growth).

    Only a cluster that was merged, or lost its nearest, looks at all others again; the rest look at
    the merged ones alone.
    """
    c, n = c.copy(), n.copy()
    live = np.arange(len(n))
    near, cost = (_ward_nearest_of(live, live, c, n) if len(n) > most else (live, n))
    los, his, growth = [], [], []
    while len(live) > most:
        lo = live[(near[near[live]] == live) & (live < near[live])]
        hi = near[lo]
        if not len(lo):
            # Rounding can hide a pair from one of its sides; the cheapest of all may always merge.
            one = live[cost[live].argmin()]
            lo, hi = np.array([min(one, near[one])]), np.array([max(one, near[one])])
            cost[lo] = cost[one]
        los.append(lo)
        his.append(hi)
        growth.append(cost[lo].copy())
        both = n[lo] + n[hi]
        c[lo] = (c[lo] * n[lo, None] + c[hi] * n[hi, None]) / both[:, None]
        n[lo] = both
        changed = np.zeros(len(n), bool)
        changed[lo] = changed[hi] = True
        live = np.setdiff1d(live, hi, assume_unique=True)
        stale = changed[live] | changed[near[live]]
        again, rest = live[stale], live[~stale]
        near[again], cost[again] = _ward_nearest_of(again, live, c, n)
        if len(rest):
            other, value = _ward_nearest_of(rest, lo, c, n)
            nearer = (value < cost[rest]) | ((value == cost[rest]) & (other < near[rest]))
            near[rest[nearer]], cost[rest[nearer]] = other[nearer], value[nearer]
    joined = [np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, los), (np.int64, his), (float, growth))]
    return live, c[live], n[live], *joined


def ward_tree(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All merges of weighted centroids by least growth of variance: kept row, gone row, growth."""
    c, n = c.copy(), n.copy()
    alive = np.ones(len(n), dtype=bool)

    def costs(i: int) -> np.ndarray:
        d = ((c - c[i]) ** 2).sum(axis=1) * n * n[i] / (n + n[i])
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    cost = np.vstack([costs(i) for i in range(len(n))])
    near, least = cost.argmin(axis=1), cost.min(axis=1)
    lo, hi, growth = [], [], []
    for _ in range(len(n) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        lo.append(i)
        hi.append(j)
        growth.append(cost[i, j])
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j] = False
        cost[j, :] = cost[:, j] = np.inf
        cost[i, :] = cost[:, i] = costs(i)
        # Rows whose nearest was a part look again; others only at the merged one.
        stale = np.flatnonzero(alive & ((near == i) | (near == j)))
        near[stale], least[stale] = cost[stale].argmin(axis=1), cost[stale].min(axis=1)
        closer = alive & (cost[:, i] < least)
        near[closer], least[closer] = i, cost[closer, i]
        near[i], least[i] = cost[i].argmin(), cost[i].min()
        least[j] = np.inf
    return np.array(lo, np.int64), np.array(hi, np.int64), np.array(growth, float)


def density_cluster(
    emb: DataFrame,
    min_cluster_size: int = 5,
    min_samples: int = 3,
    id_col: str = "paper_id",
    vec_col: str = "vector",
    out: str = "hdbscan_cluster",
) -> DataFrame:
    """Density clusters of the unit vectors with noise as -1, by excess of mass.

    The tree of mutual reachability distances and the hierarchy read from it are exact at every
    size. Merges at one distance are one step, so their order does not matter. Clusters are
    numbered by their smallest ids.
    """
    points = cut(points_of(emb, id_col, vec_col, None), "points")
    labels = _density_labels(reachability_tree(points, min_samples), min_cluster_size)
    heads = number_rows(labels.groupBy("head").agg(F.min("least").alias("least")), [F.col("least")], "_n")
    named = labels.join(heads.select("head", "_n"), "head").select("id", F.col("_n").cast("int").alias(out))
    return (
        points.select("id")
        .join(named, "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce(out, F.lit(-1)).alias(out))
    )


def reachability_tree(points: DataFrame, min_samples: int = 3) -> DataFrame:
    """Spanning tree (u, v, dist) of ``points`` (id, grp, vec) by mutual reachability: the largest
    of two rows' distance and their distances to the ``min_samples``-th nearest other row."""
    near = knn_join(points, min_samples, -2.0, id_col="id", vec_col="vec")
    core = near.groupBy(F.col("src").alias("id")).agg(
        F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.min("sim"))).alias("core")
    )
    return cut(reachability_mst(points, core), "tree")


def _density_labels(edges: DataFrame, size: int) -> DataFrame:
    """(id, head, least) of the rows in a selected cluster, from a spanning tree's edges."""
    tops, held = linkage_levels(single_linkage(edges), size)
    rivals = tops.groupBy("up").agg(F.count(F.lit(1)).alias("rivals")).where("up is not null")
    # The only large part of its parent is the same cluster, one step down.
    born = F.coalesce(F.col("rivals") > 1, F.lit(True))
    big = cut(tops.join(rivals, "up", "left").withColumn("born", born), "big")
    chains = jump_to_roots(big.select(F.col("t").alias("c"), F.when(F.col("born"), F.col("t")).otherwise(F.col("up")).alias("r")))

    def density(dist: str) -> Column:
        return 1.0 / F.greatest(F.col(dist), F.lit(1e-10))

    gain = F.col("n") * (density("dist") - F.coalesce(density("up_dist"), F.lit(0.0)))
    met = big.join(chains, F.col("t") == F.col("c"))
    mass = met.groupBy("r").agg(F.sum(gain).alias("mass"))
    heads = big.where("born").select(F.col("t").alias("r"), "up", "least").join(
        chains.select(F.col("c").alias("up"), F.col("r").alias("outer")), "up", "left"
    )
    tree = cut(mass.join(heads.select("r", "outer", "least"), "r"), "clusters")
    picked = _excess_of_mass(tree.select("r", "mass", "outer"))
    final = _outermost(cut(picked.select("r", "outer", "picked"), "picked"))
    rows = held.join(chains.select(F.col("c").alias("t"), "r"), "t").join(final, "r")
    least = tree.select(F.col("r").alias("head"), "least")
    return cut(rows.select(F.col("point").alias("id"), "head").join(least, "head"), "labels")


def _outermost(picked: DataFrame) -> DataFrame:
    """(r, head): for each cluster the outermost picked one around it or itself, if there is one.

    Strides double: ``head`` is the outermost picked among those up to where ``to`` points.
    """
    steps = cut(picked.select("r", F.col("outer").alias("to"), F.when(F.col("picked"), F.col("r")).alias("head")), "outer")
    while not steps.where("to is not null").isEmpty():
        ahead = steps.select(F.col("r").alias("to"), F.col("to").alias("_to"), F.col("head").alias("_head"))
        steps = steps.join(ahead, "to", "left").select("r", F.col("_to").alias("to"), F.coalesce("_head", "head").alias("head"))
        steps = cut(steps, "outer")
    return steps.where("head is not null").select("r", "head")


def _excess_of_mass(tree: DataFrame) -> DataFrame:
    """Bottom-up choice: a cluster is picked unless its parts together have more mass.

    ``tree`` has r, mass and outer (NULL for the root, which is never picked). A cluster's value is
    the larger of its mass and its parts' values. A round settles what has no open parts. A cluster
    with one open part left is worth max(best, plus + what ``to`` is worth); such steps are chained,
    and double their stride each round. So the rounds grow with the logarithm of the clusters and
    not with the height of the tree.
    """
    none, zero = F.lit(None), F.lit(0.0)
    parts = tree.where("outer is not null").groupBy(F.col("outer").alias("r")).agg(F.count(F.lit(1)).alias("parts"))
    state = tree.join(parts, "r", "left").select(
        "r", "outer", "mass", zero.alias("inner"), F.coalesce("parts", F.lit(0).cast("long")).alias("parts"),
        none.cast(tree.schema["r"].dataType).alias("to"), zero.alias("best"), zero.alias("plus"),
    )
    state = cut(state, "open")
    settled = None
    while True:
        done = state.where("parts = 0").select("r", "outer", F.greatest("mass", "inner").alias("value"))
        settled = done if settled is None else settled.unionByName(done)
        left = state.where("parts > 0")
        if left.isEmpty():
            break
        state = cut(_settled_or_chained(left, done), "open")
    settled = cut(settled, "settled")
    inner = settled.where("outer is not null").groupBy(F.col("outer").alias("r")).agg(F.sum("value").alias("inner"))
    heavy = F.coalesce(F.col("inner") <= F.col("mass"), F.lit(True))
    return tree.join(inner, "r", "left").select("r", "outer", (F.col("outer").isNotNull() & heavy).alias("picked"))


def _settled_or_chained(left: DataFrame, done: DataFrame) -> DataFrame:
    """Open clusters after a round, less what is ``done``; with one open part they point onward."""
    gains = done.groupBy(F.col("outer").alias("r")).agg(F.sum("value").alias("_gain"))
    open_parts = left.groupBy(F.col("outer").alias("r")).agg(F.count(F.lit(1)).alias("_parts"), F.min("r").alias("_part"))
    ends = done.select(F.col("r").alias("to"), F.col("value").alias("_value"))
    rows = left.join(gains, "r", "left").join(open_parts, "r", "left").join(ends, "to", "left")
    known = F.col("_value").isNotNull()
    inner = F.col("inner") + F.coalesce("_gain", F.lit(0.0))
    rows = rows.select(
        "r", "outer", "mass",
        # What a chain's end settles needs no parts any more.
        F.when(known, F.greatest("best", F.col("_value") + F.col("plus"))).otherwise(inner).alias("inner"),
        F.when(known, F.lit(0)).otherwise(F.coalesce("_parts", F.lit(0))).cast("long").alias("parts"),
        "_part", "to", "best", "plus",
    )
    single = (F.col("parts") == 1) & F.col("to").isNull()
    rows = rows.select(
        "r", "outer", "mass", "inner", "parts",
        F.when(single, F.col("_part")).when(F.col("parts") == 1, F.col("to")).alias("to"),
        F.when(single, F.col("mass")).otherwise(F.col("best")).alias("best"),
        F.when(single, F.col("inner")).otherwise(F.col("plus")).alias("plus"),
    )
    rows = cut(rows, "pointing")
    ahead = rows.where("to is not null").select(
        F.col("r").alias("to"), F.col("to").alias("_to"), F.col("best").alias("_best"), F.col("plus").alias("_plus")
    )
    onward = F.col("_to").isNotNull()
    return rows.join(ahead, "to", "left").select(
        "r", "outer", "mass", "inner", "parts",
        F.coalesce("_to", "to").alias("to"),
        F.when(onward, F.greatest("best", F.col("_best") + F.col("plus"))).otherwise(F.col("best")).alias("best"),
        F.when(onward, F.col("_plus") + F.col("plus")).otherwise(F.col("plus")).alias("plus"),
    )
