"""Language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import gram_buckets, plain_words, ranges, slices, spread

BUCKETS = 1 << 16
SEGMENT = 32
# A language's texts are ranked in so many parts first.
PARTS = 64


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Affixes of 1 to 3 bytes, n-grams of 2 to 4 and the word itself (the learned lexicon)."""
    return gram_buckets(words, (2, 3, 4), BUCKETS, (1, 2, 3))


@dataclass
class Crf:
    labels: list[str]
    weight: np.ndarray  # features x labels
    move: np.ndarray  # labels x labels, log scale

    def emissions(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct words for each label: the mean weight of their features, scaled."""
        index, n = features(words)
        if not len(n):
            return np.zeros((0, len(self.labels)), np.float32)
        begin = np.cumsum(n) - n
        return np.add.reduceat(self.weight[index], begin, axis=0) / np.sqrt(n)[:, None].astype(np.float32)


def forward_backward(score: np.ndarray, at: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posterior of each label for each word of each chain; chain d has the words at[d]:at[d+1].

    Chains are cut into segments whose transfer matrices are multiplied for all segments at once;
    vectors then pass from segment to segment, and at last through all segments at once. So a very
    long text takes few steps, and the result is that of one pass over each chain. A chain begins
    from even odds. With ``pairs`` also the expected number of each transition.
    """
    n_labels = score.shape[1]
    emit = np.exp(score - score.max(1, keepdims=True)).astype(np.float32)
    step = np.exp(move).astype(np.float32)
    length = np.diff(at)
    per = -(-length // SEGMENT)
    chain = np.repeat(np.arange(len(length)), per)
    nth = ranges(np.zeros(len(per), np.int64), per)
    begin = at[:-1][chain] + nth * SEGMENT
    size = np.minimum(length[chain] - nth * SEGMENT, SEGMENT)
    s = len(begin)
    word = np.minimum(begin[:, None] + np.arange(SEGMENT)[None], max(len(score) - 1, 0))
    real = np.arange(SEGMENT)[None] < size[:, None]
    e = np.where(real[..., None], emit[word], np.float32(1)) if s else np.zeros((0, SEGMENT, n_labels), np.float32)
    whole = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (s, n_labels, n_labels)).copy()
    for t in range(SEGMENT):
        k = real[:, t]
        nxt = (whole[k] @ step) * e[k, t][:, None, :]
        whole[k] = nxt / nxt.sum((1, 2), keepdims=True)
    first = np.cumsum(per) - per
    inward = np.full((s, n_labels), 1 / n_labels, np.float32)
    outward = np.full((s, n_labels), 1 / n_labels, np.float32)
    for k in range(1, int(per.max(initial=0))):
        g = first[per > k] + k
        v = np.einsum("si,sij->sj", inward[g - 1], whole[g - 1])
        inward[g] = v / v.sum(1, keepdims=True)
        g = (first + per - 1)[per > k] - k
        v = np.einsum("sij,sj->si", whole[g + 1], outward[g + 1])
        outward[g] = v / v.sum(1, keepdims=True)
    ahead = np.empty((s, SEGMENT, n_labels), np.float32)
    a = inward
    for t in range(SEGMENT):
        nxt = (a @ step) * e[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(real[:, t, None], nxt, a)
        ahead[:, t] = a
    back, b = np.empty_like(ahead), outward
    for t in range(SEGMENT - 1, -1, -1):
        back[:, t] = b
        nxt = (b * e[:, t]) @ step.T
        nxt /= nxt.sum(1, keepdims=True)
        b = np.where(real[:, t, None], nxt, b)
    post = ahead * back
    post /= post.sum(2, keepdims=True)
    if not pairs:
        return post[real]
    before = np.concatenate([inward[:, None], ahead[:, :-1]], axis=1)
    joint = before[..., :, None] * step * (e * back)[..., None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return post[real], joint[real].sum(0)


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.5, seed: int = 1) -> Crf:
    """Fit feature weights and transitions by the gradient of the likelihood, with Adagrad steps.

    All words of a text are labelled with its language; transitions stay within +-3, so that a
    switch inside a text remains possible although no training text shows one.
    """
    labels = sorted(set(langs))
    k = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32))
    seen_w, seen_m = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1e-2, np.float32)
    target = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    prepared = []
    order = rng.permutation(len(texts))
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        words, at = plain_words(pa.array([texts[j] for j in part], pa.string()))
        if not len(words):
            continue
        d = pc.dictionary_encode(words)
        index, n = features(d.dictionary)
        which = d.indices.to_numpy(zero_copy_only=False)
        prepared.append((index, n, which, at, np.repeat(target[part], np.diff(at))))
    for _ in range(epochs):
        for j in rng.permutation(len(prepared)):
            index, n, which, at, gold = prepared[j]
            scale = (1 / np.sqrt(n)).astype(np.float32)
            score = np.add.reduceat(model.weight[index], np.cumsum(n) - n, axis=0) * scale[:, None]
            post, joint = forward_backward(score[which], at, model.move, pairs=True)
            gap = -post
            gap[np.arange(len(gold)), gold] += 1
            seen = np.bincount(gold, minlength=k) - np.bincount(gold[at[:-1][np.diff(at) > 0]], minlength=k)
            moves = np.diag(seen) + np.diag(np.bincount(gold[at[:-1][np.diff(at) > 0]], minlength=k)) - joint
            total = max(len(gold), 1)
            for c in range(k):
                own = np.bincount(which, gap[:, c], minlength=len(n)) * scale
                g = np.bincount(index, np.repeat(own, n), minlength=BUCKETS).astype(np.float32) / total * 100
                g -= 1e-4 * model.weight[:, c]
                seen_w[:, c] += g * g
                model.weight[:, c] += rate * g / np.sqrt(seen_w[:, c])
            g = (moves / total).astype(np.float32) - 1e-3 * model.move
            seen_m += g * g
            model.move = np.clip(model.move + rate * g / np.sqrt(seen_m), -3, 3).astype(np.float32)
    return model


def label_words(model: Crf, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, at which word each begins, and each word's posterior by label."""
    words, at = plain_words(texts)
    d = pc.dictionary_encode(words)
    if not len(words):
        return words, at, np.zeros((0, len(model.labels)), np.float32)
    score = model.emissions(d.dictionary)[d.indices.to_numpy(zero_copy_only=False)]
    return words, at, forward_backward(score, at, model.move)


def fit(docs: DataFrame, labelled: Column, per_label: int = 400) -> Crf:
    """A model from at most ``per_label`` labelled texts of each language, drawn by hash of the id.

    Ids are ranked, not texts; a repeated id brings one of its texts in each language. Rows without
    an id, a language or a text teach nothing.
    """
    ok = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = ok.groupBy(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang")).agg(F.min(F.xxhash64(F.col("doc_id"), F.lit(9))).alias("_hash"))
    order = [F.col("_hash"), F.col("_id")]
    # First in each of a few parts of a language, so that no task ranks a whole one.
    part = F.pmod(F.shiftright("_hash", 7), F.lit(PARTS))
    some = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_lang", part).orderBy(*order))).where(F.col("_n") <= per_label)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy(*order))).where(F.col("_n") <= per_label)
    some = cut(some.select("_id", "_lang"), "language-ids")
    met = ok.select(F.col("doc_id").cast("long").alias("_own"), F.col("lang").cast("string").alias("lang"), "text").join(
        some, (F.col("_own") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    )
    rows = met.groupBy("_id", "lang").agg(F.min("text").alias("text")).orderBy("lang", "_id").collect()
    if not rows:
        return Crf(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1), np.float32))
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """The language of each whole text: that with the largest mean posterior over its words.

    A null text, or one without a letter, is ``und`` with score 0; ties go to the first label.
    Rows with a null or repeated doc_id are labelled like any other. Other columns are not looked
    at. Returns doc_id, lang_pred, score.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.labels)
        for batch in slices(batches):
            texts = batch.column("text")
            _, at, post = label_words(model, texts)
            n = np.diff(at)
            sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)])
            mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = mean.argmax(1)
            ok = letter & (n > 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(np.where(ok, names[best], "und"), pa.string()),
                    "score": pa.array(np.clip(np.where(ok, mean.max(1), 0.0), 0, 1), pa.float64()),
                }
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(slim).mapInArrow(scan, "doc_id long, lang_pred string, score double")
