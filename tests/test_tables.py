import pytest
from pyspark.sql import functions as F

from siftgraph import session
from siftgraph.plans.catalog import storage
from siftgraph.sources import files, tables
from siftgraph.sources.records import project_record, read_records, valid_records
from siftgraph.streaming.ingest import Harvest, flat_records, harvest, ingest


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_full_last_wins_and_repeatable(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    source = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, o int")
    once = tables.upsert(target, source, ["k"], order_by=[F.col("o")])
    assert rows(once, "k", "v") == [(1, "a"), (2, "y"), (3, None)]
    twice = tables.upsert(once, source, ["k"], order_by=[F.col("o")])
    assert rows(twice, "k", "v", "o") == rows(once, "k", "v", "o")


def test_upsert_partial_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", 7)], "k int, v string, cluster int")
    source = spark.createDataFrame([(1, None), (2, "n")], "k int, v string")
    merged = tables.upsert(target, source, ["k"], ["v"])
    assert rows(merged, "k", "v", "cluster") == [(1, None, 7), (2, "n", None)]
    pruned = tables.upsert(target.union(target.selectExpr("9", "v", "cluster")), source, ["k"], ["v"], prune=True)
    assert rows(pruned, "k") == [(1,), (2,)]


def test_update_by_key_overwrites_with_null_but_inserts_nothing(spark):
    target = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    updates = spark.createDataFrame([(1, None), (3, 1)], "k int, v int")
    assert rows(tables.update_by_key(target, updates, ["k"], ["v"]), "k", "v") == [(1, None), (2, 6)]


def test_union_sets_and_ensure_columns(spark):
    a = spark.createDataFrame([("1", "cs"), ("2", "cs")], "id string, s string")
    b = spark.createDataFrame([("1", "stat")], "id string, s string")
    assert rows(tables.union_sets([a, b]), "id", "s") == [("1", "stat"), ("2", "cs")]
    wide = tables.ensure_columns(a, tables.PAPERS)
    assert wide.schema["ai_sem_sim"].dataType.simpleString() == "double"
    assert tables.ensure_columns(wide, tables.PAPERS).columns == wide.columns


def test_integrity(spark):
    child = spark.createDataFrame([(1,), (2,)], "c int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert rows(tables.audit_integrity(child, parent, "c", "p"), "c") == [(2,)]
    assert rows(tables.cascade(child, parent, "c", "p"), "c") == [(1,)]


def test_snapshot_table_versions(spark, tmp_path):
    kept = tables.SnapshotTable(spark, str(tmp_path / "t"), "k int, v string, n int")
    assert kept.read().isEmpty()
    kept.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    kept.upsert(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    kept.update_by_key(spark.createDataFrame([(2, 4)], "k int, n int"), ["k"], ["n"])
    assert rows(kept.read(), "k", "v", "n") == [(1, "b", None), (2, "c", 4)]
    assert kept.versions() == [2, 3]
    # A folder without the success marker is a crashed write and does not count.
    (tmp_path / "t" / "v00000009").mkdir()
    assert kept.versions() == [2, 3]


PAGE = """<?xml version="1.0"?>
<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{}</ListRecords></OAI-PMH>"""
RECORD = """<record><header{status}><identifier>oai:{id}</identifier><datestamp>{day}</datestamp></header>
{meta}</record>"""
META = """<metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id> {id} </id><created>2024-01-01</created>
<title> {title} </title><authors>{authors}</authors><categories>cs.LG</categories>
<abstract>  text &amp; more </abstract></arXiv></metadata>"""


def record(id, title="T", status="", day="2024-01-02", meta=True, authors=""):
    body = META.format(id=id, title=title, authors=authors) if meta else ""
    return RECORD.format(status=f' status="{status}"' if status else "", id=id, day=day, meta=body)


AUTHORS = (
    "<author><keyname>Ng</keyname><forenames>A</forenames></author>"
    "<author><keyname>Solo</keyname></author><author></author>"
)


def test_records(spark, tmp_path):
    page = PAGE.format(
        record("1", "Two\nlines", authors=AUTHORS) + record("2", status="deleted")
        + record("3", meta=False) + record(" ") + record("4")
    )
    (tmp_path / "p.xml").write_text(page)
    flat = project_record(valid_records(read_records(spark, str(tmp_path))))
    found = {r["id"]: r for r in flat.collect()}
    assert set(found) == {"https://arxiv.org/abs/1", "https://arxiv.org/abs/4"}
    one = found["https://arxiv.org/abs/1"]
    assert one["title"] == "Two\nlines" and one["authors"] == "A Ng, Solo"
    assert one["summary"] == "text & more" and one["updated"] == ""
    assert one["pdf_url"] == "https://arxiv.org/pdf/1.pdf"
    assert found["https://arxiv.org/abs/4"]["authors"] == ""


def test_pages_do_not_grow_with_the_table(spark, tmp_path):
    data = spark.range(100).selectExpr("struct(string(id) as identifier) as header")
    storage._write_pages(data, str(tmp_path / "few"), 50)
    storage._write_pages(data, str(tmp_path / "many"), 5)
    assert [len(list((tmp_path / d).glob("part-*"))) for d in ("few", "many")] == [8, 20]
    assert read_records(spark, str(tmp_path / "many")).count() == 100


def test_ingest_is_resumable_and_equals_batch(spark, tmp_path):
    landing, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    landing.mkdir()

    def run():
        return ingest(spark, str(landing), str(target), str(state))

    (landing / "a.xml").write_text(PAGE.format(record("1", "old") + record("2")))
    assert run().count() == 2
    versions = tables.SnapshotTable(spark, str(target), tables.PAPERS_RAW).versions()
    assert rows(run(), "id") and tables.SnapshotTable(spark, str(target), tables.PAPERS_RAW).versions() == versions
    (landing / "b.xml").write_text(PAGE.format(record("1", "new", day="2024-02-02") + record("3")))
    streamed = rows(run(), "id", "title")
    assert [t for _, t in streamed] == ["new", "T", "T"]
    batch = tables.latest_per_key(
        flat_records(spark, str(landing)), ["id"], [F.col("landed_at"), F.col("landed_in")]
    )
    assert rows(batch, "id", "title") == streamed


def test_harvest_window_is_inclusive(spark, tmp_path):
    days = ["2024-01-01", "2024-01-02", "2024-01-03T10:00:00Z"]
    page = PAGE.format("".join(record(str(i), day=d) for i, d in enumerate(days)))
    (tmp_path / "p.xml").write_text(page)
    found = flat_records(spark, str(tmp_path), False, "2024-01-02", "2024-01-03")
    assert rows(found, "datestamp") == [("2024-01-02",), ("2024-01-03T10:00:00Z",)]


def test_record_outside_one_window_is_there_for_a_later_run(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.xml").write_text(PAGE.format(record("1", day="2020-01-01") + record("2", day="2021-01-01")))
    paths = [str(landing), str(tmp_path / "table"), str(tmp_path / "state")]
    assert ingest(spark, *paths, until_date="2020-06-01").count() == 1
    assert ingest(spark, *paths).count() == 2
    (landing / "b.xml").write_text(PAGE.format(record("2", "newer", day="2022-01-01")))
    assert ingest(spark, *paths, until_date="2020-06-01").where("title = 'newer'").count() == 0
    assert ingest(spark, *paths).where("title = 'newer'").count() == 1
    assert ingest(spark, *paths, until_date="2021-06-01").where("title = 'newer'").count() == 1


def test_harvest_goes_on_where_it_ended(spark, tmp_path):
    landing = tmp_path / "landing"
    for name in ("cs", "stat", "econ", "other"):
        (landing / name).mkdir(parents=True)
    (landing / "econ" / "a.xml").write_text(PAGE.format(record("1", "econ", day="2006-01-01") + record("9", "old", day="2001-01-01")))
    (landing / "cs" / "z.xml").write_text(PAGE.format(record("1", "cs", day="2006-01-01") + record("2", "cs", day="2007-01-01")))
    (landing / "other" / "z.xml").write_text(PAGE.format(record("2", "other", day="2007-01-01") + record("3", status="deleted")))
    (landing / "stat" / "b.xml").write_text(PAGE.format(record("2", "stat", day="2009-01-01")))
    paths = [str(landing), str(tmp_path / "table"), str(tmp_path / "state")]
    one = harvest(spark, *paths, until_date="2008-01-01")
    # From the first day of all; a later set wins, in whatever order pages landed.
    assert rows(one, "*") == [(1, "2005-09-16", "2008-01-01", 7, 6, 4, 2)]
    found = Harvest(spark, *paths)
    assert rows(found.table.read(), "id", "title") == [("https://arxiv.org/abs/1", "econ"), ("https://arxiv.org/abs/2", "cs")]
    (landing / "cs" / "n.xml").write_text(PAGE.format(record("4", day="2008-06-01")))
    two = harvest(spark, *paths)
    assert rows(two, "run", "from_date", "scanned", "saved", "waiting") == [(2, "2008-01-01", 1, 2, 1)]
    assert rows(found.table.read(), "title") == [("T",), ("econ",), ("stat",)]
    # What lies before every window waits, and an open one takes it.
    assert ingest(spark, *paths).count() == 4
    assert rows(found.runs(), "run", "waiting") == [(1, 2), (2, 1), (3, 0)]


def test_harvest_repeats_what_failed(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.xml").write_text(PAGE.format(record("1") + record("2", day="2030-01-01")))
    paths = [str(landing), str(tmp_path / "table"), str(tmp_path / "state")]

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.SnapshotTable, "replace", fail)
        with pytest.raises(RuntimeError):
            harvest(spark, *paths, until_date="2025-01-01")
    again = harvest(spark, *paths, until_date="2025-01-01")
    assert rows(again, "run", "scanned", "saved", "waiting") == [(1, 2, 1, 1)]
    assert harvest(spark, *paths, until_date="2031-01-01").first().saved == 1
    assert Harvest(spark, *paths).table.read().count() == 2


def test_merge_by_parts_leaves_other_parts_alone(spark, tmp_path):
    kept = tables.BucketTable(spark, str(tmp_path / "t"), "id string, x int", ["id"], 16)
    assert kept.read().count() == 0
    kept.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "id string, x int"))

    def files():
        return {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}

    before = files()
    source = spark.createDataFrame([("k7", 70), ("k7", 71), ("new", None)], "id string, x int")
    parts = kept.touched(source)
    merged = rows(kept.upsert(source), "id", "x")
    assert merged == sorted([(f"k{i}", i) for i in range(200) if i != 7] + [("k7", 71), ("new", None)], key=str)
    after = files()
    folders = {f"_bucket={b}" for b in parts}
    assert len(parts) == 2 and {f for f in before if f not in after} and all(f.split("/")[-2] in folders for f in before.keys() ^ after.keys())
    assert all(after[f] == t for f, t in before.items() if f.split("/")[-2] not in folders)
    assert kept.upsert(source.limit(0)).count() == 201 and files() == after
    with pytest.raises(ValueError):
        kept.upsert(source, prune=True)


def test_side_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("a\n\n  b \na\n\t\n")
    (tmp_path / "labels.csv").write_text("id,label\nx,1\ny,0\n")
    assert rows(files.read_ids(spark, str(tmp_path / "seeds.txt")), "id") == [("a",), ("b",)]
    assert rows(files.read_labels(spark, str(tmp_path / "labels.csv")), "id", "label") == [("x", 1), ("y", 0)]


def test_harvest_leaves_only_its_tables(spark, tmp_path, monkeypatch):
    """Pages land compressed; what a run writes on its way is deleted, and its shuffles end."""
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    monkeypatch.setattr(session, "_written", [])
    day = F.to_timestamp(F.lit("2001-02-03"))
    orders = spark.range(40).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority"),
        F.lit("O").alias("o_orderstatus"), day.alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"),
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    landing = storage._landed(spark, str(tmp_path), str(tmp_path / "landing"))
    pages = [p.name for p in (tmp_path / "landing").iterdir() if p.name.startswith("part-")]
    assert pages and all(p.endswith(".xml.gz") for p in pages)
    paths = [landing, str(tmp_path / "papers"), str(tmp_path / "state")]
    assert ingest(spark, *paths, until_date="2001-01-01").count() == 0
    assert ingest(spark, *paths).count() == 40
    assert session._written == []
    left = {p.name for p in tmp_path.iterdir()}
    assert left == {"orders.parquet", "landing", "papers", "papers_runs", "papers_waiting", "state"}
