"""Odd rows and columns of any name through the stages; edges that the contracts fix."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftgraph.llm import exact_dedup, gru_toxicity, merge_dropout, mixing, pivot_topk, trie_join

from . import brute

SF = "/root/testdata/sf0.001"
NAMES = "_n _id _own _digest _sha _row _mix _gone gone row record size n id sha rank label key twice_id kept_id node text_ part q".split()
ROWS = [
    (1, None, None), (2, "", "a"), (3, "Ab c d e f", "b"), (3, "Ab c d e f", "b"), (4, "aB c d e f", "b"), (None, "g h i j k l", "c"),
    (5, "g h i j k l", "c"), (None, " \t\n", None), (6, "word " * 5000, "c"), (7, "é É ▁ 12!?", None), (None, None, "a"), (None, None, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    return df.withColumns({c: F.lit(c.upper()) for c in NAMES}).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = corpus_pipeline.cut(stage(spark, odd, SF), "odd")
    if name == "sentencepiece":
        assert out.count() == len(ROWS) and out.where("not lossless").isEmpty()
    else:
        assert out.columns == odd.columns and not out.isEmpty()
        assert all(r[c] == c.upper() for r in out.collect() for c in NAMES)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_dedup_and_near_keep_the_right_rows(odd):
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_exact(odd).collect()), key=str)
    want = {(2, ""), (4, "aB c d e f"), (5, "g h i j k l"), (None, " \t\n"), (6, "word " * 5000), (7, "é É ▁ 12!?")}
    assert kept == sorted(want, key=str)
    groups = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in trie_join.near_groups(odd, 5, 80).collect()), key=str)
    assert groups == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 3), (None, 2, 5), (5, 2, 5), (None, 0, None), (6, 1, 6), (7, 1, 7), (None, 0, None), (None, 0, None)],
        key=str,
    )
    near = trie_join.drop_near(odd, 5, 80)
    assert near.where("text like 'g h%'").count() == 1 and near.where("doc_id = 4").isEmpty() and near.count() == len(ROWS) - 2


def test_a_table_of_few_words_is_mixed(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "y")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(docs).collect()) > 0
    assert mixing.mixed(docs).count() > 0


def test_components_that_do_not_fit_are_an_error(spark):
    rows = [(50, [1000.0, 1.0]), (3, [2.0, 1.0]), (4, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = pivot_topk.pivot_top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in top] == [(50, 1, 3, 1000 * 2 * 65536 + 65536)]
    more = vectors.union(spark.createDataFrame([(5, [2097152.0, 1.0])], vectors.schema))
    with pytest.raises(Exception, match="too large"):
        pivot_topk.pivot_top_k(more, F.col("vec_id") % 50 == 0).collect()


def test_network_scores_as_the_plain_one():
    texts = ["the bad word is ugly here " * n for n in (0, 1, 5, 6, 20)] + ["fine text with nice words " * n for n in (1, 7, 13)] + ["É é", "..."]
    net = gru_toxicity.train(texts, [1] * 5 + [0] * 5, rounds=1, epochs=1, least_steps=8)
    got = gru_toxicity.score_texts(net, pa.array(texts))[0]
    want = [brute.gru_score(net, t) for t in texts]
    assert abs(got - want).max() < 1e-4


def test_toxicity_and_pieces_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (3, 1)], "doc_id long, toxic int")
    net = gru_toxicity.fit(odd, labels, F.lit(True))
    rows = gru_toxicity.toxicity(odd, net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert gru_toxicity.fit(odd.limit(0), labels, F.lit(True)).words == []
    path = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    pieces = merge_dropout.encode_dropout(odd, path, arrays=True).collect()
    assert len(pieces) == len(ROWS) and all(r.lossless and len(r.ids) == r.n_ids for r in pieces)
    same = [tuple(r.ids) for r in pieces if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
