import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftgraph.operators import clustering, lloyd, neighbours, semantic, spanning, vectors
from siftgraph.operators.clustering import ward_rounds, ward_tree
from siftgraph.operators.spanning import dense_tree


def frame(spark, x, groups=None, ids=None):
    pdf = pd.DataFrame({"paper_id": range(len(x)) if ids is None else ids, "vector": list(np.asarray(x, dtype=np.float64))})
    pdf["model"] = "specter2"
    pdf["cid"] = 0 if groups is None else groups
    return spark.createDataFrame(pdf)


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def brute_knn(x, k, t, groups=None, ids=None):
    u = unit(np.asarray(x, dtype=float))
    s = u @ u.T
    n = len(x)
    ids = np.arange(n) if ids is None else np.asarray(ids)
    out = set()
    for i in range(n):
        ok = [j for j in range(n) if j != i and s[i, j] >= t - 1e-12 and (groups is None or groups[i] == groups[j])]
        ok.sort(key=lambda j: (-round(s[i, j], 9), ids[j]))
        out |= {(ids[i], ids[j], round(s[i, j], 6)) for j in ok[:k]}
    return out


def found(df):
    return {(r["src"], r["dst"], round(r["sim"], 6)) for r in df.collect()}


def sample(n=120, d=6, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 2.0 * rng.normal(size=(4, d))[rng.integers(0, 4, n)]
    if copies:
        x[:copies] = x[0]
        x[copies : copies + 5] = x[-1]
    return x


@pytest.mark.parametrize("copies", [0, 40])
@pytest.mark.parametrize("block_rows", [2048, 16])
def test_knn_equals_brute_force(spark, copies, block_rows):
    x = sample(copies=copies)
    rows = neighbours.knn_join(frame(spark, x), 5, 0.6, block_rows=block_rows)
    assert found(rows) == brute_knn(x, 5, 0.6)


@pytest.mark.parametrize("block_rows", [2048, 8])
def test_knn_within_groups(spark, block_rows):
    x = sample(copies=30)
    groups = [i % 3 for i in range(119)] + [9]  # the last group has one row
    rows = neighbours.knn_join(frame(spark, x, groups), 3, -2.0, within="cid", block_rows=block_rows)
    assert found(rows) == brute_knn(x, 3, -2.0, groups)


def test_knn_string_ids_and_edges(spark):
    x = [[1, 0], [1, 0], [0.6, 0.8], [0, 1], [0, 0]]
    ids = ["d", "b", "a", "c", "z"]
    rows = neighbours.knn_join(frame(spark, x, ids=ids), 1, 0.6)
    # Copies link to each other; the pair at the threshold loses to a closer row.
    assert found(rows) == {("d", "b", 1.0), ("b", "d", 1.0), ("a", "c", 0.8), ("c", "a", 0.8)}
    assert found(neighbours.knn_join(frame(spark, [[1, 0], [0.6, 0.8]]), 5, 0.6 - 1e-11)) == {(0, 1, 0.6), (1, 0, 0.6)}


def test_knn_approx_finds_most_and_adds_none(spark):
    x = sample(copies=20)
    exact = brute_knn(x, 5, 0.8)
    rows = found(neighbours.knn_approx(frame(spark, x), 5, 0.8, bits=3, tables=16, block_rows=16))
    pairs = {(a, b): s for a, b, s in brute_knn(x, 200, 0.8)}
    assert all(pairs[(a, b)] == s for a, b, s in rows)
    assert len(rows & exact) >= 0.9 * len(exact)


def prim_total(x):
    u = unit(np.asarray(x, dtype=float))
    s = u @ u.T
    inside, total = {0}, 0.0
    while len(inside) < len(x):
        i, j = max(((a, b) for a in inside for b in range(len(x)) if b not in inside), key=lambda e: s[e])
        inside.add(j)
        total += s[i, j]
    return total


@pytest.mark.parametrize("block_rows, copies", [(2048, 15), (8, 0), (8, 15)])
def test_cluster_mst(spark, block_rows, copies):
    x = sample(60, copies=copies)
    groups = np.array([i % 3 for i in range(57)] + [7, 8, 8])
    rows = spanning.cluster_mst(frame(spark, x, groups), "cid", block_rows=block_rows).toPandas()
    sizes = {g: int((groups == g).sum()) for g in set(groups)}
    assert len(rows) == sum(n - 1 for n in sizes.values())
    assert (groups[rows["src"]] == groups[rows["dst"]]).all()
    assert abs(rows["sim"].sum() - sum(prim_total(x[groups == g]) for g in sizes)) < 1e-9
    roots = list(range(60))
    for a, b in zip(rows["src"], rows["dst"]):
        ra, rb = roots[a], roots[b]
        assert ra != rb  # no cycle
        roots = [ra if r == rb else r for r in roots]


def test_cluster_mst_floor(spark):
    x = sample(60)
    tree = spanning.cluster_mst(frame(spark, x), "cid", block_rows=16)
    strong = spanning.cluster_mst(frame(spark, x), "cid", floor=0.9, block_rows=16)
    assert found(strong) == {e for e in found(tree) if e[2] >= 0.9}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60)]
    edges = spark.createDataFrame(edges, "u int, v int")
    comps = {r["node"]: r["comp"] for r in spanning.connected_components(edges).collect()}
    assert comps == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}


def test_centroid_filter(spark):
    emb = frame(spark, [[1, 0], [0, 1], [3, 4], [1, 1]], ids=["a", "b", "c", "far"])
    papers = spark.createDataFrame([("a", 9.0), ("b", None), ("c", None), ("none", 0.5)], "id string, ai_sem_sim double")
    seeds = spark.createDataFrame([("a",), ("a",), ("absent",)], "id string")
    out = {r["id"]: r for r in semantic.centroid_filter(papers, emb, seeds, tau=0.6 - 1e-12).collect()}
    assert out["a"]["ai_stage2_keep"] == 1 and out["b"]["ai_stage2_keep"] == 0
    assert out["c"]["ai_stage2_keep"] == 1 and abs(out["c"]["ai_sem_sim"] - 0.6) < 1e-9
    assert out["none"]["ai_stage2_keep"] is None and out["none"]["ai_sem_sim"] == 0.5
    assert out["none"]["ai_stage2_reason"] == "missing-embedding"
    counts = semantic.stage_counts(semantic.centroid_filter(papers, emb, seeds, 0.5)).first()
    assert tuple(counts) == (4, 2, 1, 1)
    with pytest.raises(ValueError):
        semantic.centroid_filter(papers, emb, seeds.where("id = 'absent'"))


def test_similarity_stats_interpolates(spark):
    values = np.random.default_rng(3).normal(size=37)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "ai_sem_sim double")
    got = semantic.similarity_stats(df).first()
    want = np.percentile(values, [0, 10, 50, 90, 100])
    assert np.allclose([got["min"], got["p10"], got["median"], got["p90"], got["max"]], want)
    near = semantic.similarity_stats(df, exact=False).first()
    assert abs(near["median"] - want[2]) < 0.2


def test_classifier_filter(spark):
    x = np.vstack([np.tile([1.0, 0.1], (20, 1)), np.tile([0.1, 1.0], (20, 1))])
    papers = spark.range(41).selectExpr("id")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(0, 40, 2)], "id long, label int")
    out = semantic.classifier_filter(papers, frame(spark, x), labels, tau=0.5).orderBy("id").collect()
    assert [r["ai_stage2_keep"] for r in out] == [1] * 20 + [0] * 20 + [None]


def test_classifier_scores_without_the_model_in_tasks(spark):
    x = np.vstack([np.tile([1.0, 0.1], (20, 1)), np.tile([0.1, 1.0], (20, 1))])
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "id long, label int")
    out = semantic.classifier_filter(spark.range(40), frame(spark, x), labels, tau=0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "UserDefinedFunction" not in plan
    scores = {r["id"]: r["ai_sem_sim"] for r in out.collect()}
    # The two sides mirror each other.
    assert 0.5 < scores[0] < 1 and abs(scores[0] + scores[39] - 1) < 1e-6


def test_classifier_scores_equal_the_models(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(3)
    data = [(x.tolist(), float(y)) for x, y in zip(rng.normal(size=(60, 3)), rng.integers(0, 3, 60))]
    rows = spark.createDataFrame(data, "vector array<double>, label double")
    for some in (rows.where("label < 2"), rows, rows.where("label = 0")):
        train = some.withColumn("features", array_to_vector("vector"))
        fitted = LogisticRegression(regParam=0.1).fit(train)
        both = fitted.transform(train).select(
            semantic._probability(fitted, F.col("vector")).alias("a"), vector_to_array("probability")[1].alias("b")
        )
        assert all(abs(r["a"] - r["b"]) < 1e-9 for r in both.collect())


def test_embed_missing_only_fills_gaps(spark):
    papers = spark.createDataFrame([(0, "x", "y"), (9, "new words", None)], "id long, title string, summary string")
    rows = vectors.embed_missing(papers, frame(spark, [[1, 0]]), vectors.hashed_encoder(16)).collect()
    assert [r["paper_id"] for r in rows] == [9] and rows[0]["dim"] == 16
    assert abs(np.linalg.norm(rows[0]["vector"]) - 1) < 1e-6


def blobs(seed=0, d=5):
    rng = np.random.default_rng(seed)
    centers = np.eye(d)[:3]
    noise = -np.abs(rng.normal(size=(6, d)))
    return np.vstack([rng.normal(0, 0.03, (30, d)) + c for c in centers] + [noise])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_kmeans_and_ward_find_blobs(spark):
    x = blobs()[:90]
    truth = [0] * 30 + [1] * 30 + [2] * 30
    emb = clustering.prepared(frame(spark, x))
    for rows in (clustering.kmeans(emb, 3, n_init=3), clustering.ward(emb, 3), clustering.ward(emb, 3, block_rows=20)):
        labels = [r[1] for r in sorted(rows.collect())]
        assert same_partition(labels, truth)


def test_lloyd_moves_all_runs_as_alone(spark):
    x = blobs(4)
    rows = frame(spark, x).repartition(3)
    starts = [x[:3].copy(), x[5:9].copy(), np.vstack([x[:2], [[50.0] * x.shape[1]]])]

    def alone(c, passes=100):
        for _ in range(passes):
            near = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            cost, still = ((x - c[near]) ** 2).sum(), ((moved - c) ** 2).sum(1).max() > 1e-8
            c = moved
            if not still:
                break
        return cost, c

    for (cost, c), start in zip(lloyd.lloyd(rows, starts), starts, strict=True):
        want = alone(start)
        assert np.allclose(c, want[1]) and np.isclose(cost, want[0])


def test_kmeans_of_few_and_equal_rows(spark):
    same = frame(spark, [[1.0, 0.0]] * 6)
    assert {r["kmeans_cluster"] for r in clustering.kmeans(same, 3, n_init=2).collect()} == {0}
    two = clustering.kmeans(frame(spark, [[1.0, 0.0], [0.0, 1.0]]), 2, n_init=3).collect()
    assert len({r["kmeans_cluster"] for r in two}) == 2
    with pytest.raises(ValueError):
        clustering.kmeans_centers(same.limit(0))


def test_kmeans_labels_are_nearest_centres(spark):
    x = unit(sample(50))
    centers = clustering.kmeans_centers(frame(spark, x), 4, n_init=2)
    rows = clustering.assign_nearest(frame(spark, x), centers).orderBy("paper_id").collect()
    want = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r["cluster"] for r in rows] == want.tolist()


def direct_ward(x, k):
    """Groups merged one by one, each time the two whose union adds the least variance."""
    groups = [[i] for i in range(len(x))]

    def spread(g):
        return ((x[g] - x[g].mean(axis=0)) ** 2).sum()

    while len(groups) > k:
        pairs = [(spread(a + b) - spread(a) - spread(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    truth = np.zeros(len(x), dtype=int)
    for n, g in enumerate(sorted(groups, key=min)):
        truth[g] = n
    return truth.tolist()


def test_ward_tree_equals_direct_definition():
    x = sample(25)
    lo, hi, cost = ward_tree(x, np.ones(25))
    assert (np.diff(cost) >= -1e-9).all()
    label = np.arange(25)
    for a, b in zip(lo[:-3], hi[:-3]):
        label[label == b] = a
    assert same_partition(label.tolist(), direct_ward(x, 4))


@pytest.mark.parametrize("block_rows", [6, 2048])
def test_ward_equals_direct_definition_in_rounds_and_blocks(spark, block_rows):
    x = sample(34, seed=4, copies=10)
    for k in (1, 5):
        rows = clustering.ward(frame(spark, x), k, block_rows=block_rows).orderBy("paper_id").collect()
        assert [r["agg_cluster"] for r in rows] == direct_ward(x, k)


def test_ward_rounds_in_a_task_equal_merging_one_by_one():
    rng = np.random.default_rng(12)
    x, n = rng.normal(size=(400, 6)), rng.integers(1, 5, 400).astype(float)
    want = sorted(zip(*(a.tolist() for a in ward_tree(x, n)), strict=True))
    for most in (1, 30, 400):
        at, c, left, *merges = ward_rounds(x, n, most)
        last = ward_tree(c, left)
        lo, hi, cost = (np.concatenate(p) for p in zip(merges, (at[last[0]], at[last[1]], last[2]), strict=True))
        got = sorted(zip(lo.tolist(), hi.tolist(), cost.tolist(), strict=True))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_ward_finishes_rounds_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(clustering, "_ward_nearest", None)  # no round of jobs for so few
    x = np.random.default_rng(3).normal(size=(2100, 4))
    assert clustering.ward(frame(spark, x), 5).select("agg_cluster").distinct().count() == 5


def test_ward_with_few_or_no_rows(spark):
    emb = frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert [r[1] for r in sorted(clustering.ward(emb, 8).collect())] == [0, 0, 1]
    assert clustering.ward(emb.limit(0), 8).count() == 0


def test_pca_matches_centred_svd(spark):
    x = sample(40) + 5.0
    rows = clustering.pca(frame(spark, x), 2).orderBy("paper_id").collect()
    got = np.array([r["vector"] for r in rows])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    sign = np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(axis=1)])
    assert np.allclose(got, (x - x.mean(axis=0)) @ vt[:2].T * sign)


def direct_density(x, size, samples):
    """Single-linkage hierarchy of mutual reachability, read at every distinct distance."""
    u = unit(np.asarray(x, dtype=float))
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(u @ u.T, 12)))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    a, b, w = dense_tree(u, core)
    levels = sorted(set((-w).tolist()))

    def parts(eps):
        label = list(range(len(x)))
        for i, j, c in zip(a, b, -w):
            if c <= eps:
                label = [label[i] if v == label[j] else v for v in label]
        groups = {}
        for i, v in enumerate(label):
            groups.setdefault(v, set()).add(i)
        return [g for g in groups.values() if len(g) >= size]

    def mass(group, level, birth):
        """(own mass, value, picked groups) of the cluster that is ``group`` at ``level``."""
        own, current = 0.0, group
        while True:
            density = 1 / max(levels[level], 1e-10)
            own += len(current) * (density - birth)
            birth = density
            inner = [g for g in parts(levels[level - 1]) if g <= current] if level else []
            level -= 1
            if len(inner) != 1:
                break
            current = inner[0]
        below = [mass(g, level, birth) for g in inner]
        total = sum(v for v, _ in below)
        if below and total > own:
            return total, [p for _, ps in below for p in ps]
        return own, [group]

    top = len(levels) - 1
    current, level = set(range(len(x))), top
    while True:
        inner = [g for g in parts(levels[level - 1]) if g <= current] if level else []
        level -= 1
        if len(inner) != 1:
            break
        current = inner[0]
    out = [-1] * len(x)
    birth = 1 / levels[level + 1]
    for n, g in enumerate(p for c in inner for p in mass(c, level, birth)[1]):
        for i in g:
            out[i] = n
    assert np.isfinite(reach[0]).sum() == len(x) - 1
    return out


@pytest.mark.parametrize("seed", [5])
def test_density_equals_direct_hierarchy(spark, seed):
    x = blobs(seed)
    want = direct_density(x, 5, 3)
    rows = clustering.density_cluster(frame(spark, x)).orderBy("paper_id").collect()
    got = [r["hdbscan_cluster"] for r in rows]
    assert same_partition(got, want) and [g == -1 for g in got] == [w == -1 for w in want]
    assert len(set(got) - {-1}) >= 3


def test_density_without_structure_is_noise(spark):
    rows = clustering.density_cluster(frame(spark, np.tile([[1.0, 0.0]], (8, 1)))).collect()
    assert {r["hdbscan_cluster"] for r in rows} == {-1}


def test_excess_of_mass_in_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # A chain of 150 with a leaf at each step, a plain chain of 100, and a bush.
    outer = [None] + [i // 2 * 2 for i in range(0, 300)]
    outer += [0] + list(range(301, 400))
    outer += [int(rng.integers(0, i)) for i in range(401, 600)]
    mass = rng.integers(1, 1000, len(outer)).astype(float)
    inner = [[] for _ in outer]
    for i, o in enumerate(outer):
        if o is not None:
            inner[o].append(i)
    value, want = list(mass), {}
    for i in reversed(range(len(outer))):
        below = sum(value[j] for j in inner[i])
        want[i] = outer[i] is not None and (not inner[i] or below <= mass[i])
        value[i] = max(mass[i], below)
    tree = spark.createDataFrame([(i, o, float(m)) for i, (o, m) in enumerate(zip(outer, mass))], "r long, outer long, mass double")
    written = []

    def counted(df, name="stage"):
        written.append(name)
        return cut(df, name)

    cut = clustering.cut
    monkeypatch.setattr(clustering, "cut", counted)
    rows = clustering._excess_of_mass(cut(tree, "tree")).collect()
    assert {r["r"]: r["picked"] for r in rows} == want and len(rows) == len(outer)
    assert len(written) < 40
