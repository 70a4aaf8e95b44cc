import numpy as np
import pytest

from siftgraph.plans.build_graph import build_graph
from siftgraph.plans.stages import CorpusStages
from siftgraph.sources import tables

from .test_tables import META, PAGE, RECORD

TOPICS = {
    "reward": "reward hacking in reinforcement agents with reward models",
    "audit": "policy audit of deployed systems and audit reports",
    "probe": "probing hidden activations with sparse probes",
}


def corpus(tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    records = []
    for t, (name, words) in enumerate(TOPICS.items()):
        for i in range(12):
            id = f"{name}{i}"
            body = META.format(id=id, title=f"AI safety {name} {i}: part", authors="")
            body = body.replace("text &amp; more", f"{words} {name} number{i % 4}")
            records.append(RECORD.format(status="", id=id, day="2024-01-02", meta=body))
    records.append(RECORD.format(status="", id="off", day="2024-01-02", meta=META.format(id="off", title="Cooking", authors="")))
    (landing / "a.xml").write_text(PAGE.format("".join(records)))
    return str(landing)


def test_all_stages_end_to_end(spark, tmp_path):
    landing = corpus(tmp_path)
    stages = CorpusStages(spark, str(tmp_path / "tables"))
    seeds = spark.createDataFrame([(f"https://arxiv.org/abs/{t}0",) for t in TOPICS], "id string")
    out = tmp_path / "out"
    found = stages.run(
        landing, seeds, str(out), tau=0.2, kmeans=3, agg=3, density_min=4,
        labelling={"topk": 2, "ngram_range": (1, 2), "cosine_floor": 0.0},
        graph={"min_sim": 0.5, "document": True},
    )
    papers = stages.papers.read().toPandas()
    assert len(papers) == 36 and (papers["ai_stage2_keep"] == 1).all()
    for column in ("kmeans_cluster", "agg_cluster"):
        topics = papers["id"].str.extract(r"abs/([a-z]+)")[0]
        assert papers.groupby(topics)[column].nunique().max() == 1 and papers[column].nunique() == 3
    assert found.count() == 3 and found.select("label").distinct().count() == 3
    assert stages.counts["harvest"]["scanned"] == stages.counts["harvest"]["saved"] == 37
    assert stages.counts["stage1"] == {"scanned": 37, "copied": 36}
    said, sims = stages.counts["filter"], np.array(papers["ai_sem_sim"])
    assert (said["scanned"], said["kept"], said["rejected"], said["undecided"]) == (36, 36, 0, 0)
    assert np.allclose([said[c] for c in ("min", "p10", "median", "p90", "max")], np.percentile(sims, [0, 10, 50, 90, 100]))
    assert list((out / "graph").glob("part-*")) and list((out / "summaries").glob("part-*"))

    # A second run from the same landing changes nothing but the versions.
    before = stages.papers.read().drop("ai_sem_sim").exceptAll
    stages.harvest(landing)
    stages.stage1()
    assert before(stages.papers.read().drop("ai_sem_sim")).isEmpty()
    assert stages.embed().count() == 36


def test_filter_needs_its_inputs(spark, tmp_path):
    stages = CorpusStages(spark, str(tmp_path))
    for options in ({}, {"method": "logreg"}, {"method": "other"}):
        with pytest.raises(ValueError):
            stages.filter(**options)


def test_build_graph_guards(spark):
    papers = spark.createDataFrame([], tables.PAPERS)
    emb = spark.createDataFrame([], tables.EMBEDDINGS)
    with pytest.raises(ValueError, match="no kept"):
        build_graph(papers, emb)
    one = spark.createDataFrame([("a", 1, 0)], "id string, ai_stage2_keep int, kmeans_cluster int")
    with pytest.raises(ValueError, match="1 papers"):
        build_graph(tables.ensure_columns(one, tables.PAPERS), emb)
    vector = spark.createDataFrame([("a", "specter2", [1.0, 0.0])], "paper_id string, model string, vector array<float>")
    made = build_graph(tables.ensure_columns(one, tables.PAPERS), vector)
    assert made.links.isEmpty() and made.nodes.count() == 1
    assert made.meta.first()["coords"]["included"] is False


def test_graph_is_connected_within_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(30, 4)))
    papers = spark.createDataFrame(
        [(str(i), 1, i % 3) for i in range(30)], "id string, ai_stage2_keep int, kmeans_cluster int"
    )
    emb = spark.createDataFrame([(str(i), "specter2", v.tolist()) for i, v in enumerate(x)], "paper_id string, model string, vector array<double>")
    made = build_graph(tables.ensure_columns(papers, tables.PAPERS), emb, top_k=1, min_sim=0.2)
    node_cid = {r["id"]: r["cid"] for r in made.nodes.collect()}
    root = {n: n for n in node_cid}
    for s, t, _ in made.links.collect():
        assert s < t
        a, b = root[s], root[t]
        root = {n: a if r == b else r for n, r in root.items()}
    for c in range(3):
        assert len({root[n] for n, cid in node_cid.items() if cid == c}) == 1
    assert sorted(node_cid) == list(range(30))
    assert {(r["x"] >= 24 and r["x"] <= 976, r["y"] >= 24 and r["y"] <= 676) for r in made.nodes.collect()} == {(True, True)}
