"""Single-linkage hierarchy of a tree's edges by rounds of contraction.

The edges are halved by rank. What the light half connects is one node for the heavy half, so the
parts of the light half and the contracted heavy half have nothing to do with each other any more,
and each edge is in one part only. Halving goes on, in all parts at once, until a part fits a task;
there its edges are merged in order. So there are as many rounds as the logarithm of the number of
tasks, the result is exact at every size, and no task holds more than ``PART_EDGES`` edges or so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import hot_split_join
from .ordering import number_rows
from .spanning import connected_components, jump_to_roots

PART_EDGES = 1 << 17


def single_linkage(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """Every merge of the hierarchy, one row per edge of a forest (u, v, dist).

    ``e`` is the merge's rank by (dist, u, v), ``size`` the number of points it joins, ``least``
    the smallest of them. Its two sides are the merges ``ea`` and ``eb`` or, where these are null,
    the points ``pa`` and ``pb``.
    """
    ends = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "dist")
    ranked = number_rows(ends, [F.col("dist"), F.col("u"), F.col("v")], "e")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    state = ranked.withColumns({"su": one, "sv": one, "eu": none, "ev": none, "part": F.lit(0).cast("long")})
    state = cut(state, "linkage")
    done = None
    while True:
        sizes = cut(state.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("e", 0.5).alias("mid")), "linkage-parts")
        large = cut(sizes.where(F.col("n") > part_edges).drop("n"), "linkage-large")
        if large.isEmpty():
            break
        small = state.join(large.select("part"), "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        state = _halved(state.join(large, "part"))
    whole = state if done is None else done.unionByName(state)
    tasks = max(1, -(-whole.count() // part_edges))
    return cut(_merges(whole.withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks)))), "linkage-merges")


def _halved(state: DataFrame) -> DataFrame:
    """Edges of large parts in two halves; a new part is named by the least edge in it."""
    state = cut(state.withColumn("light", F.col("e") <= F.col("mid")).drop("mid"), "linkage-halves")
    light = state.where("light")

    def end(c: str) -> Column:
        return F.struct("part", F.col(c).alias("x"))

    nodes = connected_components(light.select(end("u").alias("u"), end("v").alias("v")))
    nodes = nodes.select(F.col("node.part").alias("part"), F.col("node.x").alias("x"), F.col("comp.x").alias("comp"))
    both = [state.select("part", F.col(c).alias("x"), F.col(f"s{c}").alias("s"), F.col(f"e{c}").alias("ex")) for c in "uv"]
    degrees = both[0].unionByName(both[1]).groupBy("part", "x").agg(F.max("s").alias("s"), F.max("ex").alias("ex"), F.count(F.lit(1)).alias("_rows"))
    nodes = cut(degrees.join(nodes, ["part", "x"], "left").withColumn("comp", F.coalesce("comp", "x")), "linkage-nodes")
    # What the light half makes of its nodes: their size, and the merge that completes them.
    joined = nodes.groupBy("part", "comp").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("members"), F.max("ex").alias("ex"))
    counted = nodes.select("part", F.col("x").alias("u"), F.col("comp").alias("cu"), "_rows")
    named = hot_split_join(state, cut(counted, "linkage-u"), ["part", "u"], "_rows", "e").drop("_rows")
    top = named.where("light").groupBy("part", F.col("cu").alias("comp")).agg(F.max("e").alias("top"), F.min("e").alias("first"))
    whole = joined.join(top, ["part", "comp"], "left").withColumn("ex", F.coalesce("top", "ex"))
    whole = nodes.select("part", "x", "comp", "_rows").join(whole, ["part", "comp"])
    whole = cut(whole.select("part", "x", "comp", "_rows", "s", "ex", "first"), "linkage-whole")

    def side(rows: DataFrame, c: str) -> DataFrame:
        new = whole.select(
            "part", F.col("x").alias(c), "_rows", F.col("comp").alias(f"c_{c}"), F.col("s").alias(f"s_{c}"),
            F.col("ex").alias(f"e_{c}"), F.col("first").alias(f"f_{c}"),
        )
        return hot_split_join(rows, new, ["part", c], "_rows", "e").drop("_rows")

    met = cut(side(side(state, "u"), "v"), "linkage-met")
    heavy = met.where("not light")
    least = heavy.groupBy("part").agg(F.min("e").alias("new"))
    heavy = heavy.join(least, "part").select(
        "e", "dist", F.col("c_u").alias("u"), F.col("c_v").alias("v"), F.col("s_u").alias("su"), F.col("s_v").alias("sv"),
        F.col("e_u").alias("eu"), F.col("e_v").alias("ev"), F.col("new").alias("part"),
    )
    kept = met.where("light").select("e", "dist", "u", "v", "su", "sv", "eu", "ev", F.col("f_u").alias("part"))
    return cut(kept.unionByName(heavy), "linkage")


def _merges(rows: DataFrame) -> DataFrame:
    """Merges of whole parts, several to a task, in the order of rank."""
    kind = rows.schema["u"].dataType.simpleString()

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("e")
        n = table.num_rows
        u, v = (table.column(c).combine_chunks() for c in "uv")
        names = pa.chunked_array([u, v]).combine_chunks().dictionary_encode()
        part = np.tile(table.column("part").to_numpy(), 2)
        code = np.unique(np.stack([part, names.indices.to_numpy()], 1), axis=0, return_inverse=True)[1].ravel()
        a, b = code[:n].tolist(), code[n:].tolist()
        size, at = np.zeros(int(code.max()) + 1, np.int64), np.full(int(code.max()) + 1, -1, np.int64)
        for c, s, x in ((code[:n], "su", "eu"), (code[n:], "sv", "ev")):
            size[c] = table.column(s).to_numpy()
            at[c] = pc.fill_null(table.column(x), -1).to_numpy()
        order = pc.rank(names.dictionary, sort_keys="ascending").to_numpy()
        least = np.zeros(len(size), np.int64)
        least[code] = order[names.indices.to_numpy()]
        size, at, least, root = size.tolist(), at.tolist(), least.tolist(), list(range(len(size)))
        out = {"size": [], "least": [], "ea": [], "eb": []}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for e, x, y in zip(table.column("e").to_pylist(), a, b, strict=True):
            x, y = find(x), find(y)
            out["ea"].append(at[x])
            out["eb"].append(at[y])
            if size[x] < size[y]:
                x, y = y, x
            root[y] = x
            size[x] += size[y]
            at[x] = e
            least[x] = min(least[x], least[y])
            out["size"].append(size[x])
            out["least"].append(least[x])
        by_rank = pc.sort_indices(names.dictionary)
        points = [pc.if_else(pa.array([e < 0 for e in out[c]]), col, pa.scalar(None, col.type)) for c, col in (("ea", u), ("eb", v))]
        sides = [pa.array([None if e < 0 else e for e in out[c]], pa.int64()) for c in ("ea", "eb")]
        return pa.table(
            [table.column("e"), table.column("dist"), pa.array(out["size"], pa.int64()),
             names.dictionary.take(by_rank.take(pa.array(np.array(out["least"], np.int64) - 1))), *sides, *points],
            ["e", "dist", "size", "least", "ea", "eb", "pa", "pb"],
        )

    schema = f"e long, dist double, size long, least {kind}, ea long, eb long, pa {kind}, pb {kind}"
    return rows.groupBy("task").applyInArrow(merge, schema)


def linkage_levels(merges: DataFrame, size: int = 1) -> tuple[DataFrame, DataFrame]:
    """The hierarchy read at its distances, as merges at one distance are one step.

    Returns components of at least ``size`` points (t, dist, n, least, up, up_dist), each from the
    distance at which it is complete to that at which ``up`` takes it in (null for the last), and
    for every point the smallest of these that holds it (point, t), if any does.
    """
    ups = merges.select(F.col("ea").alias("e"), F.col("e").alias("up"), F.col("dist").alias("up_dist"))
    ups = ups.union(merges.select("eb", "e", "dist")).where("e is not null")
    rows = cut(merges.select("e", "dist", "size", "least").join(ups, "e", "left"), "linkage-ups")
    passed = F.col("up").isNotNull() & ((F.col("dist") == F.col("up_dist")) | (F.col("size") < size))
    holds = jump_to_roots(rows.select(F.col("e").alias("c"), F.when(passed, F.col("up")).otherwise(F.col("e")).alias("r")))
    to = holds.select(F.col("c").alias("up"), F.col("r").alias("_up"))
    tops = rows.where(~passed & (F.col("size") >= size)).join(to, "up", "left")
    tops = tops.select(F.col("e").alias("t"), "dist", F.col("size").alias("n"), "least", F.col("_up").alias("up"), "up_dist")
    first = merges.select(F.col("pa").alias("point"), F.col("e").alias("c")).union(merges.select("pb", "e")).where("point is not null")
    big = F.col("size") >= size
    held = first.join(holds, "c").join(rows.where(big).select(F.col("e").alias("r")), "r").select("point", F.col("r").alias("t"))
    return cut(tops, "linkage-tops"), held
