"""Operators and stages do the whole of their job: what they decide and compute is in what they return."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from siftgraph import session
from siftgraph.llm import catalog, merge_dropout, mixing, trie_join
from siftgraph.llm.common import mix64, ranges

from . import brute

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_mixed_holds_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, "a  b\n", None), (-1, "a  b\n", None), (None, "c " * 200, None), (-9, None, "x"), (-9, " \t", "x")]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame(odd, "doc_id long, text string, source string"))
    docs = docs.withColumn("row", F.lit(1)).withColumn("size", F.lit("s"))
    said = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0")
    out = mixing.mixed(docs).cache()
    assert out.columns == docs.columns
    words = out.groupBy("doc_id").agg(F.sum(mixing.words()).alias("n"))
    assert sorted(map(tuple, words.collect()), key=str) == sorted(map(tuple, said.collect()), key=str)
    goal = docs.select("doc_id", "source", mixing.words().alias("size"))
    goal = {r.source: r.target for r in mixing.targets(goal).collect() if r.source_size}
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.words()).alias("n")).collect()}
    # Seats round by half the number of sources at most, and a source's last block may be short.
    assert got.keys() == goal.keys() and all(abs(got[s] - goal[s]) <= 64 * (len(goal) / 2 + 2) for s in goal)
    whole = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in out.where("doc_id is not null and doc_id >= 0").collect():
        assert set(r.text.split()) <= set(whole[r.doc_id].split())


def test_last_stage_keeps_the_ids(spark):
    import sentencepiece

    import corpus_pipeline

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(1, "Some words\n here"), (2, None), (3, "é 12!?")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["sentencepiece"]
    rows = corpus_pipeline.cut(stage(spark, docs, SF), "ids-test").collect()
    assert len(rows) == 3
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        assert len(r.ids) == r.n_ids and zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32
        assert sp.decode(r.ids) == texts[r.doc_id]


def test_every_occurrence_draws_its_own_drops(monkeypatch):
    monkeypatch.setattr(merge_dropout, "CHUNK", 1000)
    model = merge_dropout.MergeModel(PIECES)
    encoder = merge_dropout.Encoder(model, 0.1, 1)
    encoder.paths.most = 3  # emptied again and again
    texts = pa.array(["information the " + "-" * 60 + " é"] * 3000 + [None, "", "日本語 a"])
    names = np.arange(len(texts))
    ids, at = encoder(names, texts)
    units, first = merge_dropout.blank_units(model, texts)
    per_doc = np.diff(first)
    with np.errstate(over="ignore"):
        own = np.repeat(mix64(names.view(np.uint64) ^ encoder.seed), per_doc)
        keys = mix64(own + ranges(np.zeros(len(per_doc), np.int64), per_doc).view(np.uint64))
    want, n = merge_dropout.encode_units(model, units.to_pylist(), keys, 0.1)
    assert ids.tolist() == want.tolist() and np.diff(at).sum() == n.sum()
    ends = np.cumsum(n)
    word = [i for i, u in enumerate(units.to_pylist()) if u == b" information"]
    forms = [tuple(want[ends[i] - n[i] : ends[i]].tolist()) for i in word]
    assert len(set(forms)) > 4


def test_token_files_are_as_the_tokenizer_is_loaded(spark, tmp_path):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [
        f"end {end} next", f"{end}{end}a", f"a  {end}\n\n b", f"x{end}", "<|endof", "text|> y", None, "", end,
        f"hi's<|{end}|> é　{end}é", f"\u0085{end} \t{end}", "a|b <|x|>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op4_token_files"](spark, str(tmp_path))
    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect())) == brute.tokens(loaded, list(enumerate(texts)))


def test_levels_come_in_one_job(spark):
    """The sketch's levels took a job for each shuffle partition, which is most of the time on few rows."""
    sketch = trie_join.Sketch(16)
    tokens = mix64(np.arange(5000, dtype=np.uint64) % np.uint64(700))
    for part in np.array_split(tokens, 50):
        sketch.add(part)
    segment, counts = (a.to_pylist() for a in sketch.segments())
    rows = spark.createDataFrame([*zip(segment, counts), *zip(segment, counts)], "segment long, counts binary")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sc = spark.sparkContext
    try:
        for k, v in zip(kept, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        sc.setJobGroup("levels", "levels")
        level = trie_join._levels(rows, 16).value
        jobs = sc.statusTracker().getJobIdsForGroup("levels")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    expected = np.minimum(4 * np.log2(1 + 2 * sketch.counts.astype(np.int64)), 255).astype(np.uint8)
    assert np.array_equal(level, expected)
    assert len(jobs) < 10


def test_ngram_join_deletes_large_tables(spark, monkeypatch):
    """Sets and prefixes are larger than the texts and end with their use; a small list of what goes is sent to the documents."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 55 + i % 5], f"x{i // 40}"])) for i in range(120)] + [(500, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(trie_join, "BLOCK", 32)
    monkeypatch.setattr(session, "_written", [])
    kept = trie_join.drop_near(df)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in session._written}
    assert left == {"ngram-gone"}
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in kept.collect()} >= {0, 500}
    session._written.clear()
    trie_join.near_groups(df)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in session._written}
    assert not left & {"ngram-prefixes", "ngram-sets", "ngram-large"}
