"""Registered queries against their SQL on DuckDB. SIFTGRAPH_ALL=1 runs every one."""

import math
import os
import time

import duckdb
import pytest

import __spark_entry__ as contract
from siftgraph import session

SF = "/root/testdata/sf0.001"
FEW = [
    "keyword_gate", "stage1", "domain_tag", "upsert_full", "upsert_partial", "label_upsert",
    "read_table", "harvest_records", "upsert_repeats", "ingest_window", "centroid_filter", "stage_counts", "similarity_stats",
    "missing_embeddings", "knn_global", "knn_in_cluster", "tfidf", "diverse_terms",
    "phrase_ranking", "search_scores", "facet_after_limit", "adjacency", "graph_nodes",
    "summary_lookup", "canvas_points", "decollide",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("SIFTGRAPH_ALL") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    result = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(result.fetchall(), columns)


def test_entry_and_names(spark):
    assert contract.entry(spark).columns == ["id", "sim", "keep", "reason"]
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_release_deletes_what_was_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_written", [])
    kept = session.cut(spark.range(3).toDF("n"), "numbers")
    assert kept.count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert session.release(spark) == 1 and not list(tmp_path.iterdir())


def test_cut_ends_shuffles_and_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_written", [])
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))

    spark._jvm.System.gc()
    time.sleep(2)
    before = shuffled()
    first = session.cut(spark.range(1000).repartition(4, "id"), "first")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    last = session.cut_alone(lambda: session.cut(first, "inner").where("id < 7"), "last", [first])
    assert last.count() == 7 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["last"]


def test_scratch_folder_is_the_sessions():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    shared = Session(spark_checkpoint_dir="hdfs://x/shared/", spark_master="yarn")
    assert session.scratch_root(shared) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        session.scratch_root(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError):
        session.scratch_root(Session(spark_master="local-cluster[3,2,1024]"))
