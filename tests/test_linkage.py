"""The single-linkage hierarchy against merging one edge after the other."""

import random

import pytest

from siftgraph.operators import linkage


def plain_levels(edges, size):
    """Components of at least ``size`` points: (dist, points, dist at which they end)."""
    points = {p for u, v, _ in edges for p in (u, v)}
    label = {p: p for p in points}
    seen = {}
    for dist in sorted({d for *_, d in edges}):
        for u, v, d in edges:
            if d == dist:
                a, b = label[u], label[v]
                label = {p: a if x == b else x for p, x in label.items()}
        groups = {}
        for p, x in label.items():
            groups.setdefault(x, set()).add(p)
        for g in map(frozenset, groups.values()):
            if len(g) > 1 and g not in seen:
                seen[g] = dist
    out = []
    for g, dist in seen.items():
        over = [d for h, d in seen.items() if g < h]
        if len(g) >= size:
            out.append((dist, min(g), len(g), min(over) if over else None))
    return sorted(out, key=str), seen


def tree(kind, n, seed):
    rng = random.Random(seed)
    names = [f"p{i:03d}" for i in range(n)] if kind == "words" else list(range(n))
    rng.shuffle(names)
    if kind == "chain":
        return [(names[i], names[i + 1], float(i)) for i in range(n - 1)]
    if kind == "star":
        return [(names[0], names[i], float(rng.randrange(3))) for i in range(1, n)]
    if kind == "forest":
        cut = n // 3
        return [e for e in tree("random", n, seed) if (e[0] < cut) == (e[1] < cut)]
    return [(names[i], names[rng.randrange(i)], float(rng.randrange(n // 2))) for i in range(1, n)]


@pytest.mark.parametrize("kind,part,size", [("random", 9, 1), ("words", 1000, 4), ("chain", 5, 3), ("star", 6, 1), ("forest", 8, 2)])
def test_levels_equal_plain_merging(spark, kind, part, size):
    edges = tree(kind, 60, 4)
    id_type = "string" if kind == "words" else "long"
    df = spark.createDataFrame(edges, f"u {id_type}, v {id_type}, dist double").repartition(3)
    merges = linkage.single_linkage(df, part)
    assert merges.count() == len(edges)
    tops, held = linkage.linkage_levels(merges, size)
    want, seen = plain_levels(edges, size)
    rows = tops.collect()
    assert sorted(((r.dist, r.least, r.n, r.up_dist) for r in rows), key=str) == want
    by_t = {r.t: r for r in rows}
    assert all(r.up is None or by_t[r.up].dist == r.up_dist for r in rows)
    around = {r.point: by_t[r.t] for r in held.collect()}
    for p in {p for u, v, _ in edges for p in (u, v)}:
        mine = [(len(g), d) for g, d in seen.items() if p in g and len(g) >= size]
        assert (p in around) == bool(mine)
        if mine:
            assert (around[p].n, around[p].dist) == min(mine)


def test_no_edges_no_merges(spark):
    none = spark.createDataFrame([], "u long, v long, dist double")
    merges = linkage.single_linkage(none)
    assert merges.count() == 0
    assert linkage.linkage_levels(merges, 2)[0].count() == 0
