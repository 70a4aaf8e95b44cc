import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.operators import labels, terms
from siftgraph.operators.joins import hot_split_join


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def docs(spark, texts, cids=None):
    cids = cids or [0] * len(texts)
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, cids))], "id int, text string, cid int")


def test_fold_takes_all_letters(spark):
    text = "\U0001d400ﬁ Ⅷ é Ǆ plain"
    got = spark.createDataFrame([(text,), ("ABC",), ("",)], "t string").select(terms.fold(F.col("t"))).collect()
    assert [r[0] for r in got] == ["afi viii e dz plain", "abc", ""]


def test_tokens_fold_and_bridge_stop_words(spark):
    df = docs(spark, ["Safety of the Modèles, a b2 naïve_x!", "ÉTÉ Ⅷ x", ""])
    got = {}
    for r in terms.term_counts(df, F.col("text"), (1, 3), ["of", "the"]).collect():
        got.setdefault(r["id"], Counter())[r["term"]] = r["tf"]
    words = ["safety", "modeles", "b2", "naive_x"]
    grams = words + [" ".join(words[i : i + 2]) for i in range(3)] + [" ".join(words[i : i + 3]) for i in range(2)]
    assert got[0] == Counter(grams)
    assert got[1]["ete"] == 1 and 2 not in got


def test_candidate_phrases_of_other_letters(spark):
    df = spark.createDataFrame([("ßß",), ("слово",), ("models",), ("__",)], "term string")
    assert rows(labels.candidate_phrases(df, ["agents"], terms.TOKEN)) == [("__",), ("ßß",), ("слово",)]
    # Without a pattern the words are of a to z, as before.
    assert rows(labels.candidate_phrases(df)) == []


def test_candidate_phrases_count_terms_once(spark):
    late = spark.range(1).select(F.raise_error(F.concat(F.lit("read "), "id")).cast("string").alias("term"))
    labels.candidate_phrases(late, ["agents"])  # read by the caller alone
    found = spark.createDataFrame([("tall models",)], "term string")
    plan = labels.candidate_phrases(found)._jdf.queryExecution().executedPlan().toString()
    assert "phrases-" in plan  # read once, into a table


def test_document_terms_need_no_grouping(spark):
    df = docs(spark, ["a1 b1 a1 b1", "b1 c1", "", None])
    found = terms.document_terms(df, F.col("text"), (1, 2), ["c1"])
    assert rows(found) == [(0, "a1"), (0, "a1 b1"), (0, "b1"), (0, "b1 a1"), (1, "b1")]
    assert rows(terms.document_frequency(found, 4, 2, 1.0)) == [("b1", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def direct_tfidf(texts, min_df, max_df):
    counts = [Counter(t.split()) for t in texts]
    df = Counter(w for c in counts for w in c)
    n = len(texts)
    vocab = {w for w, k in df.items() if min_df <= k <= max_df * n}
    out = {}
    for i, c in enumerate(counts):
        raw = {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items() if w in vocab}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(i, w): v / norm for w, v in raw.items()}
    return out


def test_tfidf_bounds_are_inclusive(spark):
    texts = ["aa bb cc", "aa bb", "aa dd dd", "ee dd"]
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(docs(spark, texts), F.col("text"), (1, 1), 2, 0.5, []).collect()}
    want = direct_tfidf(texts, 2, 0.5)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert ("bb" in {t for _, t in got}) and ("aa" not in {t for _, t in got})


def test_vocabulary_is_document_frequency(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50)] + ["é", "ßé", "slow ﬁ", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(25))) for _ in range(150)] + [None, ""]
    df = docs(spark, texts).repartition(3)
    want = rows(terms.document_frequency(terms.document_terms(df, F.col("text"), (1, 2), ["w3"]), 152, 3, 0.5))
    for block_words in (1, 40, 1 << 20):
        assert rows(terms.vocabulary(df, F.col("text"), 152, (1, 2), 3, 0.5, ["w3"], block_words)) == want
    assert len(want) > 40
    assert rows(terms.vocabulary(df.limit(0), F.col("text"), 0)) == []


def test_terms_travel_packed(spark):
    """No row for each term and block is shuffled, and documents travel as texts."""
    found = terms.tfidf(docs(spark, ["aa bb cc", "aa bb"]), F.col("text"), (1, 2), 1, 1.0, [])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(part" in plan


def test_tfidf_with_hot_terms(spark):
    rng = random.Random(4)
    texts = ["hot " + " ".join(rng.choices([f"w{i:02d}" for i in range(30)], k=8)) for _ in range(200)]
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(docs(spark, texts), F.col("text"), (1, 1), 1, 1.0, []).collect()}
    want = direct_tfidf(texts, 1, 1.0)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hot_split_join_keeps_every_row(spark):
    large = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 0, id % 100) as k")
    counted = large.groupBy("k").count()
    joined = hot_split_join(large, counted, ["k"], "count", "id")
    assert rows(joined, "id", "k", "count") == rows(large.join(counted, "k"), "id", "k", "count")


def test_cluster_weight_counts_absent_terms(spark):
    df = docs(spark, ["a", "b", "c"], [0, 0, 1])
    weights = spark.createDataFrame([(0, "x", 1.0), (2, "x", 0.5)], "id int, term string, weight double")
    assert rows(terms.cluster_term_weight(weights, df)) == [(0, "x", 0.5), (1, "x", 0.5)]


def direct_diverse(pairs, topk):
    chosen = []
    for t, _ in sorted(pairs, key=lambda p: (-p[1], p[0])):
        if not any(t in u or u in t for u in chosen) and len(chosen) < topk:
            chosen.append(t)
    return chosen


def test_tfidf_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))) for _ in range(120)]
    df = docs(spark, texts).withColumn("cid", F.when(F.col("id") % 5 > 0, F.col("id") % 5))
    args = (F.col("text"), (1, 2), 3, 0.5, [])
    whole = terms.tfidf(df, *args)
    key = lambda r: (r["id"], r["term"], r["tf"], r["df"], round(r["weight"], 9))
    small = terms.tfidf(df, *args, block_words=50)
    assert sorted(map(key, small.collect())) == sorted(map(key, whole.collect()))
    # Rows of documents and terms are not shuffled for their norms.
    assert "windowspecdefinition(id" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = terms.cluster_term_weight(whole, df)
    rows = lambda f: sorted((r["cid"], r["term"], round(r["weight"], 9)) for r in f.collect())
    assert rows(terms.cluster_tfidf(df, *args, block_words=50)) == rows(want)
    # Rows with one id are one document, here in two clusters.
    twice = df.union(df.where("id % 7 = 0").withColumn("cid", F.lit(9)))
    want = terms.cluster_term_weight(terms.tfidf(twice, *args), twice)
    assert rows(terms.cluster_tfidf(twice, *args)) == rows(want)


def test_diverse_terms(spark):
    data = {
        0: [("deep safety", 0.9), ("safety", 0.8), ("deep safety net", 0.7), ("robust", 0.6), ("models", 0.95)],
        1: [("one", 0.5)],
        2: [("tie b", 0.4), ("tie a", 0.4), ("none", 0.0)],
    }
    flat = [(c, t, w) for c, ps in data.items() for t, w in ps]
    got = terms.diverse_terms(spark.createDataFrame(flat, "cid int, term string, weight double"), 3).collect()
    for c, ps in data.items():
        usable = [(t, w) for t, w in ps if t != "models" and w > 0]
        assert [r["term"] for r in sorted(got) if r["cid"] == c] == direct_diverse(usable, 3)


def test_candidate_phrases(spark):
    found = spark.createDataFrame([("alpha",), ("alpha",), ("models",)], "term string")
    assert rows(labels.candidate_phrases(found, ["beta", "agents"])) == [("alpha",), ("beta",)]
    empty = labels.candidate_phrases(found.limit(0))
    assert rows(empty) == [("evaluation",), ("governance",), ("reinforcement learning",), ("robustness",)]


@pytest.mark.parametrize("seed", range(3))
def test_unique_terms_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    sizes = {c: rng.randint(1, 6) for c in range(12)}
    wishes = {c: rng.sample(["p", "q", "r", "s", "t", "u", "v"], rng.randint(1, 4)) for c in sizes}
    used, want = set(), {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        pick = next((p for p in wishes[c] if p not in used), None)
        if pick:
            used.add(pick)
            want[c] = pick
    flat = [(c, p, i + 1) for c, ps in wishes.items() for i, p in enumerate(ps)]
    ranked = spark.createDataFrame(flat, "cid int, phrase string, rank int")
    got = labels.unique_terms(ranked, spark.createDataFrame(list(sizes.items()), "cid int, size int"))
    assert dict(rows(got, "cid", "phrase")) == want


def test_assign_labels(spark):
    ranked = [
        (0, "x", 0.9, 1), (0, "y", 0.8, 2),
        (1, "x", 0.7, 1), (1, "y", 0.65, 2),
        (2, "x", 0.95, 1),
        (3, "z", 0.3, 1),
    ]
    ranked = spark.createDataFrame(ranked, "cid int, phrase string, sim double, rank int")
    reps = spark.createDataFrame([(c, f"T{c}", 0.5) for c in range(5)], "cid int, title string, confidence double")
    sizes = spark.createDataFrame([(0, 5), (1, 5), (2, 1), (3, 9), (4, 2)], "cid int, size int")
    got = {r["cid"]: tuple(r)[1:] for r in labels.assign_labels(ranked, reps, sizes).collect()}
    assert got[0] == ("x", 0.9, ["x", "y"])
    assert got[1] == ("y", 0.7, ["x", "y"])  # the confidence of its first phrase
    assert got[2] == ("T2", 0.5, ["T2"])  # everything taken
    assert got[3] == ("T3", 0.5, ["T3"])  # below the floor
    assert got[4] == ("T4", 0.5, ["T4"])  # no phrase at all
    free = {r["cid"]: r["label"] for r in labels.assign_labels(ranked, reps, sizes, unique=False).collect()}
    assert free[1] == "x" and free[2] == "x"


def test_representative(spark):
    members = spark.createDataFrame(
        [(1, "Far: x", 0, [0.0, 1.0]), (3, "Near: b", 0, [1.0, 0.1]), (2, "Near: a", 0, [1.0, 0.1])],
        "id int, title string, cid int, vector array<double>",
    )
    center = spark.createDataFrame([(0, [1.0, 0.0])], "cid int, centroid array<double>")
    [row] = labels.representative(members, center).collect()
    assert row["title"] == "Near" and row["confidence"] == pytest.approx(1 / math.sqrt(1.01))
