"""Phrase streams, conversation tries and shards against plain versions and on odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from siftgraph.llm import collocations, prefix_trie, sharding
from siftgraph.llm.common import gathered, ranges

DOCS = "doc_id long, text string, lang string"
TURNS = "conv_id long, turn long, role string, text string"


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.sql(sql).fetchall(), key=str)


def plain_phrases(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            m = len(p)
            if m < 2 or any(len(q) > m and b >= a and any(q[i : i + m] == p for i in range(len(q) - m + 1)) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, m))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["a", "B", "the", "é", "\x01x", "\x00", "Éa", "日本", "a\xa0b", "zz"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None])))
    return [*rows, (1, None, "en"), (2, "", None), (3, " \t\n.", "fr"), (None, rows[0][1], "en"), (0, *rows[0][1:]), (9, "a b the " * 4000, "de")]


@pytest.mark.parametrize("least,top,longest", [(3, 10_000, 5), (8, 7, 5), (4, 100, 3), (5, 50, 2)])
def test_phrases_equal_plain_counts(spark, monkeypatch, least, top, longest):
    monkeypatch.setattr(collocations, "SLICE", 500)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit("x"), "key": F.lit(1), "f": F.lit(2)}).repartition(3)
    got = collocations.collocations(docs, least, top, longest)
    want = plain_phrases(rows, least, top, longest)
    assert want and sorted(map(tuple, got.collect())) == want


def test_phrases_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], DOCS)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert [tuple(r)[2:] for r in collocations.collocations(docs, least=1).collect()] == [("a b c", 1, 1, 1, 3, 3000)]


def test_counting_holds_few_times_a_slice(spark):
    """A slice's phrases were cut out by eight-byte places of all their bytes: over 500 MB a worker."""

    class Caught:
        def mapInArrow(self, task, schema):
            self.task = task
            return self

        groupBy = agg = lambda self, *columns: self

    class All:
        passes = staticmethod(lambda hashes: np.ones(len(hashes), bool))

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) + "." for _ in range(2000)]
    batch = pa.record_batch({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
    task = collocations._counted(Caught(), (1, 2, 3, 4, 5), All()).task
    tracemalloc.start()
    found = sum(pc.sum(b.column("f")).as_py() for b in task(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 * (400 + 399 + 398 + 397 + 396)
    assert most < 128 << 20


def test_gathered_is_ranges():
    data = np.arange(100, dtype=np.uint8)
    starts, lengths = np.array([5, 0, 90, 7, 7]), np.array([3, 0, 10, 60, 1])
    for most in (1, 4, 1000):
        assert np.array_equal(gathered(data, starts, lengths, most), data[ranges(starts, lengths)])
    assert len(gathered(data, starts[:0], lengths[:0])) == 0


def test_sieve_keeps_what_is_frequent(spark):
    words = [bytes(b + 1 for b in w.encode()) for w in ("one", "é", "a")]
    hashes = collocations._word_hashes(spark.createDataFrame([(w,) for w in words], "key binary"))
    sieve = collocations.Sieve(hashes, bits=1 << 20)
    out, begin, size, *_ = collocations._words(pa.array(["One é a", "other words here"]))
    assert sieve.passes(collocations._hashes(out, begin, size)).tolist() == [True] * 3 + [False] * 3


def plain_trie(rows, every=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(own.get(c - int(c / every) * 0 - (abs(c) % every) * (1 if c >= 0 else -1), [])[:h]) + tuple(ts[h:])
    nodes = defaultdict(list)
    for c, ts in sorted(whole.items()):
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            (members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in members if len(whole[c]) == len(p)).encode()).hexdigest())
            for p, members in nodes.items()
        ),
        key=str,
    )


def turn_rows():
    rng = random.Random(5)
    openings = [[(rng.choice(["user", None, "bot"]), "".join(rng.choice("aé ") for _ in range(rng.randrange(4)))) for _ in range(14)] for _ in range(6)]
    rows = []
    for c in [*range(-12, 90), 1000, 1003, 5000]:
        ts = rng.choice(openings)[: rng.randrange(1, 14)]
        if rng.random() < 0.4:
            ts = [*ts[: rng.randrange(len(ts))], ("user", str(rng.randrange(4)))]
        rows += [(c, i if i else None, *t) for i, t in enumerate(ts)]
    rng.shuffle(rows)
    return rows + [(None, 0, "user", "nobody's"), (200, 3, None, "x" * 50_000), (201, 1, "a", None)]


@pytest.mark.parametrize("block", [1, 3, 4, 50])
def test_trie_equals_plain_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    rows = turn_rows()
    convs = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "idx": F.lit(1), "a": F.lit(None)}).repartition(5)
    got = prefix_trie.conversation_trie(convs, block)
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_of_one_long_and_many_equal(spark):
    """A conversation with most turns, and a hundred that are the same."""
    rows = [(0, i, "user", f"t{i % 7}") for i in range(700)] + [(5 * c, i, "user", "same") for c in range(1, 101) for i in range(9)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    # Turns with one number come by digest, here and in SQL; a conversation may end without turns.
    convs = spark.createDataFrame([(7, 1, "a", "x"), (7, 1, "b", "y"), (7, 1, "b", "y"), (8, None, "c", "z"), (11, 0, "u", None)], TURNS)
    got = prefix_trie.conversation_trie(convs)
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(prefix_trie.SQL, conversations=convs)


def shard_docs(spark):
    rows = [(i, f"text {i}") for i in range(4000)] + [(None, "é"), (None, None), (7, "text 7"), (7, "text 7"), (7, None), (-1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"shard": F.lit("x"), "slot": F.lit(1), "row": F.lit(1), "record": F.lit(0), "size": F.lit("y")}).repartition(7)


def test_shards_equal_sql_and_are_gapless(spark):
    docs = shard_docs(spark)
    got = sharding.shard_rows(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(sharding.SQL, documents=docs)
    slots = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d"))
    assert all(r.n == r.d == r.last + 1 for r in slots.collect()) and slots.count() == 16
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_a_new_shard_takes_only_into_itself(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    few = (1.0, 2.0, 0.0, 3.0)
    both = keys.select(
        sharding.rendezvous(F.col("k"), few).alias("old"),
        sharding.rendezvous(F.col("k"), (*few, 2.0)).alias("new"),
        sharding.rendezvous(F.col("k"), (1.0, 4.0, 0.0, 3.0)).alias("raised"),
    ).collect()
    n = Counter(r.old for r in both)
    assert n[2] == 0 and all(abs(n[s] - 1000 * few[s]) < 130 for s in (0, 1, 3))
    moved = [r for r in both if r.old != r.new]
    assert {r.new for r in moved} == {4} and abs(len(moved) - 1500) < 150
    assert all(r.raised == 1 for r in both if r.raised != r.old)
    grown = sharding.shard_rows(keys.select(F.col("k").cast("long").alias("doc_id"), F.lit("").alias("text")), few, 2.0)
    assert Counter(r.grown_shard for r in grown.collect()) == Counter(r.new for r in both)
    for bad in ((), (0.0, 0.0), (1.0, -1.0)):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.col("k"), bad)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = shard_docs(spark)
    back = sharding.write_shards(docs, f"{tmp_path}/shards")
    assert sorted(map(tuple, back.select("record.*").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert back.select("record.doc_id", "shard").distinct().exceptAll(sharding.shard_rows(docs).select("doc_id", "shard").distinct()).isEmpty()
