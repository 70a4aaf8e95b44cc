import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgraph.operators import blocks, clustering, neighbours, spanning, vectors

from .test_vectors import brute_knn, direct_ward, found, frame, sample, unit


def vectors_table(x, first=0):
    ids = pa.array(range(first, first + len(x)), pa.int64())
    return pa.table({"rid": ids, "grp": pa.array([0] * len(x)), "vec": [list(v) for v in x], "ids": [[i] for i in ids.to_pylist()]})


def test_a_key_has_few_blocks_until_they_are_too_large_for_a_task(spark):
    rows = spark.createDataFrame([(100,), (10_000,), (1 << 20,)], "n long").orderBy("n")
    some = rows.select(blocks.block_count(F.col("n"), 128, 1 << 15, 8).alias("b"), blocks.block_count(F.col("n"), 128, None, 8).alias("all"))
    assert [tuple(r) for r in some.collect()] == [(1, 1), (8, 79), (32, 8192)]


def test_cells_stay_few_and_large_cells_are_split(spark, monkeypatch):
    x = sample(300, copies=20)
    distinct = neighbours.distinct_vectors(neighbours.points_of(frame(spark, x), "paper_id", "vector", None), 6)
    large = neighbours.large_groups(distinct, 4)
    assert len(neighbours._pivots(distinct, large, 4, 4096, 1 << 15)) == 8
    # A task takes 20 rows: several cells, and blocks in them.
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(blocks, "TASK_VALUES", 1)
    monkeypatch.setattr(neighbours, "FEW_BLOCKS", 3)
    assert found(neighbours.knn_join(frame(spark, x), 5, 0.6, block_rows=4)) == brute_knn(x, 5, 0.6)


@pytest.mark.parametrize("least", [-2.0, 0.5])
def test_top_matches_of_strips_equal_brute_force(monkeypatch, least):
    monkeypatch.setattr(neighbours, "_FIRST", 9)
    monkeypatch.setattr(neighbours, "_HELD", 1)
    x = sample(90, copies=12)
    got = neighbours._top_kernel(4, least)(vectors_table(x), vectors_table(x)).to_pylist()
    assert {(r["src"], r["dst"], round(r["sim"], 6)) for r in got} == brute_knn(x, 4, least)


@pytest.mark.parametrize("held", [7, 4096])
@pytest.mark.parametrize("core", [False, True])
def test_forests_between_blocks_make_the_tree_of_all(monkeypatch, held, core):
    monkeypatch.setattr(spanning, "_HELD_ROWS", held)
    x = sample(60)
    u = unit(x)
    far = np.round(np.sqrt(np.maximum(0.0, 2 - 2 * np.sort(np.round(u @ u.T, 12), axis=1)[:, -4])), 12) if core else None

    def side(a, b):
        t = vectors_table(x[a:b], a)
        return t if far is None else t.append_column("core", pa.array(far[a:b]))

    kernel = spanning._tree_kernel(None)
    pairs = [((0, 25), (0, 25)), ((0, 25), (25, 60)), ((25, 60), (25, 60))]
    edges = pa.concat_tables([kernel(side(*a), side(*b)) for a, b in pairs])
    _, _, w = spanning._forest(*(edges.column(c).to_numpy() for c in "uvw"), 60)
    assert len(edges) == 24 + 59 + 34
    assert np.allclose(np.sort(w), np.sort(spanning.dense_tree(u, far)[2]), atol=1e-9)


def test_ward_costs_in_strips(spark, monkeypatch):
    monkeypatch.setattr(clustering, "_WARD_HELD", 1)
    x = sample(50, seed=4, copies=10)
    rows = clustering.ward(frame(spark, x), 4, block_rows=25).orderBy("paper_id").collect()
    assert [r["agg_cluster"] for r in rows] == direct_ward(x, 4)


def test_encoding_takes_more_tasks_as_texts_grow(spark, monkeypatch):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(i, "some words " * 10) for i in range(40)], "id long, text string")
    assert vectors.task_count(rows) == few == vectors.task_count(rows.limit(0))
    monkeypatch.setattr(vectors, "TASK_LETTERS", 440)
    assert vectors.task_count(rows) == 10
