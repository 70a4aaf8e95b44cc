"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is scored in overlapping windows of words and takes the score of its worst. A word comes in
as its own vector, if it is one of the words learned, plus the mean vector of its characters'
n-grams, so that a spelling never seen still has a meaning.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import forget, give_back, gram_buckets, plain_words, ranges, slices, spread

GRAMS = 1 << 15
WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN, ATTEND = 8, 8, 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    words: list[bytes]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.lexicon = pa.array(self.words, pa.large_binary())

    def begin(self, odds: np.ndarray, seed: int) -> None:
        """Small random weights; a word's first component starts at its log odds of being toxic."""
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=0.1: (rng.normal(size=s) * scale).astype(np.float32)
        self.p = {"word": draw(len(self.words) + 1, WIDTH), "gram": draw(GRAMS, WIDTH, scale=0.02)}
        self.p["word"][0] = 0
        self.p["word"][1:, 0] = odds
        for d in "fb":
            self.p |= {f"W{d}": draw(WIDTH, 3 * HIDDEN, scale=0.4), f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": draw(3 * HIDDEN, scale=0)}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND, scale=0.4), "a": draw(ATTEND, scale=0.4), "w": draw(2 * HIDDEN, scale=0.4), "o": draw(1, scale=0)}

    def inputs(self, words: pa.Array):
        """Distinct words: number in the lexicon (0: none), n-grams in a row, how many each has."""
        number = pc.fill_null(pc.index_in(words, value_set=self.lexicon), -1).to_numpy(zero_copy_only=False) + 1
        index, n = gram_buckets(words, (3, 4), GRAMS, (3,))
        return number, index, n

    def vectors(self, number: np.ndarray, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(n):
            return np.zeros((0, WIDTH), np.float32)
        sums = np.add.reduceat(self.p["gram"][index], np.cumsum(n) - n, axis=0)
        return self.p["word"][number] + sums / n[:, None].astype(np.float32)

    def known(self, words: pa.Array, step: int = 1 << 13) -> np.ndarray:
        """Vectors of distinct words; their n-grams are looked up some words at a time."""
        parts = [self.vectors(*self.inputs(words.slice(i, step))) for i in range(0, len(words), step)]
        return np.concatenate([np.zeros((0, WIDTH), np.float32), *parts])

    def gates(self, x: np.ndarray, way: str) -> np.ndarray:
        """Input part of the three gates of each word, and last a row of zeros for the filling,
        under which a state of zeros stays zero."""
        g = x @ self.p[f"W{way}"] + self.p[f"c{way}"]
        return np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)])

    def recur(self, gates: np.ndarray, word: np.ndarray, way: str, keep: bool = False):
        """States (time, window, unit) of one direction; what ``learn`` needs of it if ``keep``."""
        steps, n = word.shape
        u, h = self.p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
        states, kept = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g, a = gates[word[t]], h @ u
            zr = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr *= np.float32(0.5)
            zr += np.float32(0.5)
            z, r, an = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * an)
            before, h = h, c + z * (h - c)
            states[t] = h
            if keep:
                kept.append((t, before, z, r, an, c))
        return states, kept

    def pool(self, states: np.ndarray, real: np.ndarray):
        """Attention over time: each window's logit, and the parts of its gradient."""
        look = np.tanh(states @ self.p["A"])
        e = np.where(real, look @ self.p["a"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        e *= real
        share = e / np.maximum(e.sum(0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ self.p["w"] + self.p["o"][0], look, share, pooled

    def score(self, x: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probabilities of windows (time, window) of word numbers, -1 for filling."""
        out = np.zeros(word.shape[1], np.float32)
        gates = {w: self.gates(x, w) for w in "fb"}
        for i in range(0, word.shape[1], 4096):
            part = word[:, i : i + 4096]
            states = np.concatenate([self.recur(gates[w], part, w)[0] for w in "fb"], axis=2)
            out[i : i + 4096] = _sigmoid(self.pool(states, part >= 0)[0])
        return out

    def learn(self, words: pa.Array, word: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss over windows, by back-propagation through time."""
        number, index, n = self.inputs(words)
        x = self.vectors(number, index, n)
        real = word >= 0
        runs = {w: self.recur(self.gates(x, w), word, w, keep=True) for w in "fb"}
        states = np.concatenate([runs[w][0] for w in "fb"], axis=2)
        logit, look, share, pooled = self.pool(states, real)
        d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"w": pooled.T @ d, "o": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["w"]
        dstates = share[..., None] * dpool
        dshare = np.einsum("tbh,bh->tb", states, dpool)
        de = share * (dshare - (share * dshare).sum(0))
        g["a"] = np.einsum("tb,tba->a", de, look)
        dlook = de[..., None] * self.p["a"] * (1 - look * look)
        g["A"] = np.einsum("tbh,tba->ha", states, dlook)
        dstates = dstates + dlook @ self.p["A"].T
        dx = np.zeros((len(x) + 1, WIDTH), np.float32)
        at = np.where(real, word, len(x)).ravel()
        for k, way in enumerate("fb"):
            u, own = self.p[f"U{way}"], dstates[..., k * HIDDEN : (k + 1) * HIDDEN]
            du, dg = np.zeros_like(u), np.zeros((*word.shape, 3 * HIDDEN), np.float32)
            dh = np.zeros((word.shape[1], HIDDEN), np.float32)
            for t, before, z, r, an, c in reversed(runs[way][1]):
                dh = dh + own[t]
                dc = dh * (1 - z) * (1 - c * c)
                dz, dr = dh * (before - c) * z * (1 - z), dc * an * r * (1 - r)
                da = np.concatenate([dz, dr, dc * r], axis=1)
                dg[t] = np.concatenate([dz, dr, dc], axis=1)
                du += before.T @ da
                dh = dh * z + da @ u.T
            dg *= real[..., None]
            flat = dg.reshape(-1, 3 * HIDDEN)
            g[f"U{way}"], g[f"c{way}"] = du, flat.sum(0)
            per_word = np.stack([np.bincount(at, flat[:, j], minlength=len(x) + 1) for j in range(3 * HIDDEN)], 1).astype(np.float32)
            g[f"W{way}"] = x.T @ per_word[:-1]
            dx += per_word @ self.p[f"W{way}"].T
        dx = dx[:-1]
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], number, dx)
        g["word"][0] = 0
        each = np.repeat(dx / n[:, None], n, axis=0)
        g["gram"] = np.stack([np.bincount(index, each[:, j], minlength=GRAMS) for j in range(WIDTH)], 1).astype(np.float32)
        return g


def windows(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of all texts, as word numbers (time, window), and each one's text.

    Every word is in one at least: windows begin every ``STRIDE`` words until one reaches the end.
    A text without words has none.
    """
    size = np.diff(at)
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), n)
    begin = at[:-1][text] + STRIDE * ranges(np.zeros(len(n), np.int64), n)
    place = begin[None] + np.arange(WINDOW)[:, None]
    inside = place < at[1:][text][None]
    if not len(which):
        return np.full((WINDOW, 0), -1, np.int64), text
    return np.where(inside, which[np.minimum(place, len(which) - 1)], -1), text


def score_texts(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's score (0 without words), and all windows' scores and texts."""
    words, at = plain_words(texts)
    d = pc.dictionary_encode(words)
    word, text = windows(at, d.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    got = net.score(net.known(d.dictionary), word)
    best = np.zeros(len(texts), np.float32)
    np.maximum.at(best, text, got)
    return best, got, text


def train(texts: list[str], labels: list[int], rounds: int = 3, epochs: int = 3, batch: int = 128, rate: float = 0.01, least_steps: int = 360, seed: int = 1) -> Network:
    """Fit a network from texts whose labels say only that some window is toxic, or that none is.

    A toxic text stands in training for its window that looks worst: first by its words' log
    odds, then by the network itself. Of a clean text the window that looks worst and some drawn
    at random stand in. Adam steps; the same texts give the same network.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    words, at = plain_words(pa.array(texts, pa.string()))
    d = pc.dictionary_encode(words)
    which = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * max(len(d.dictionary), 1) + which)
    doc, w = np.divmod(pairs, max(len(d.dictionary), 1))
    bad = np.bincount(w, y[doc], minlength=len(d.dictionary))
    all_ = np.bincount(w, minlength=len(d.dictionary))
    p, n = y.sum(), len(y) - y.sum()
    odds = np.log((bad + 2) / (p + 2)) - np.log((all_ - bad + 2) / (n + 2))
    known = np.flatnonzero(all_ >= 5)
    net = Network([d.dictionary[int(i)].as_py() for i in known])
    net.begin((np.clip(odds[known], -1, 4) / 2).astype(np.float32), seed)
    word, text = windows(at, which)
    if not word.shape[1]:
        return net
    word = word.astype(np.int32)
    give_back()
    strength = np.where(all_ >= 5, np.clip(odds, 0, 4), 0)
    look = np.where(word >= 0, strength[word], 0).max(0)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for _ in range(rounds):
        order = np.lexsort((rng.random(len(look)), -look, text))
        worst = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        clean = np.flatnonzero(y[text] == 0)
        drawn = rng.choice(clean, min(len(clean), int(n)), replace=False) if len(clean) else clean
        used = np.concatenate([worst, drawn])
        # Few windows are gone through more often, so that the network gets enough steps.
        for _ in range(max(epochs, -(-least_steps * batch // (rounds * max(len(used), batch))))):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
                mine, local = np.unique(word[:, part], return_inverse=True)
                local = local.reshape(WINDOW, -1) - (mine[0] == -1)
                mine = mine[mine >= 0]
                g = net.learn(d.dictionary.take(pa.array(mine)), local, y[text[part]])
                step += 1
                for k in net.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    up = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                    net.p[k] = (net.p[k] - rate * up).astype(np.float32)
        look = net.score(net.known(d.dictionary), word)
    return net


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_label: int = 1200) -> Network:
    """A network from at most ``per_label`` texts of either label, drawn by hash of the id.

    Only ids are ranked, a few from each partition, and a repeated id brings one of its texts. The
    drawn texts, which do not grow with the table, meet in one task, which trains; the driver gets
    the weights. Without a labelled text the network is untrained and knows no word.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") > 0).cast("int").alias("_toxic"))
    ids = docs.where(may_learn).select(F.col("doc_id").cast("long").alias("_own"))
    some = known.join(ids, F.col("_id") == F.col("_own"), "left_semi").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    some = cut(some, "toxic-ids")
    order = [F.xxhash64(F.col("_id"), F.lit(10)), F.col("_id")]
    drawn = [some.where(F.col("_toxic") == t).orderBy(*order).limit(per_label) for t in (0, 1)]
    drawn = cut(drawn[0].unionByName(drawn[1]), "toxic-drawn")
    own = docs.select(F.col("doc_id").cast("long").alias("_own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(drawn, F.col("_own") == F.col("_id")).groupBy("_id", "_toxic").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("_id", "_toxic", "text")), strict=True))
        if rows:
            net = train([r[2] for r in rows], [r[1] for r in rows])
            give_back()
            yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps((net.words, net.p))], pa.binary())})

    made = texts.coalesce(1).mapInArrow(learn, "net binary").collect()
    return Network(*pickle.loads(made[0].net)) if made else train([], [])


def toxicity(docs: DataFrame, net: Network, least: float = 0.7) -> DataFrame:
    """The score of each whole text: that of its worst window; 0 where there is no word.

    A null text counts as empty; rows with a null or repeated doc_id are scored like any other;
    other columns are not looked at. Returns doc_id, score, predicted (1 from ``least`` on).
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, most=2 << 20):
            best = np.clip(score_texts(net, batch.column("text"))[0].astype(np.float64), 0, 1)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "score": best, "predicted": (best >= least).astype(np.int32)}
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInArrow(scan, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Network, least: float = 0.7) -> DataFrame:
    """``docs`` without the texts whose score is ``least`` or more; columns as they came."""
    names, schema = docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, most=2 << 20):
            fine = score_texts(net, batch.column("text"))[0] < least
            yield batch.filter(pa.array(fine))

    return spread(docs).mapInArrow(keep, schema).select(*names)
