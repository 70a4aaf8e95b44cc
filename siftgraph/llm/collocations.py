"""Collocations of adjacent words by sorted streams of phrase counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import hot_split_join
from ..session import cut
from .common import binary_array, flat, gathered, give_back, lean, mix64, ranges, slices, spread
from .sorted_runs import in_order, last_seen

LONGEST = 5
# The bytes that end a piece, and those that end a word.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \x09"
# The sieve of frequent phrases has this many bits (16 MB) at any size of the input.
SIEVE_BITS = 1 << 27
SLICE = 4 << 20
# Words whose bytes are hashed at a time.
WORDS = 1 << 16
# A language's phrases are ranked in so many parts first.
PARTS = 32
ROWS = "lang string, phrase string, a long, l long, r long, n long, score long"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: their bytes, each one higher, with a 0 behind each word; where each
    begins, and how many bytes it has; its piece; its text.

    So a phrase is a slice, and slices sort by words first and bytes second.
    """
    at, data = flat(texts)
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)] = 1
    kind[list(BREAKS)] = 2
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    low += 1
    sort = kind[data]
    inside = sort == 0
    begins = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        first = at[:-1][at[:-1] < len(data)]
        begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    text = np.searchsorted(at, starts, side="right") - 1
    piece = np.cumsum(sort == 2, dtype=np.int32)[starts] + text
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    size = np.flatnonzero(ends) + 1 - starts
    begin = np.cumsum(size + 1) - (size + 1)
    word = np.ones(int(inside.sum()) + len(starts), bool)
    word[begin + size] = False
    out = np.zeros(len(word), np.uint8)
    out[word] = low[data[inside]]
    return out, begin, size, piece, text


def _hashes(out: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes and their places."""
    power = mix64(np.arange(int(size.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
    hashes = np.empty(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(begin), WORDS):
            n = size[i : i + WORDS]
            first = begin[i : i + WORDS] - begin[i]
            some = out[begin[i] : begin[i] + first[-1] + n[-1] + 1]
            place = np.arange(len(some)) - np.repeat(first, n + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(some * power[place], dtype=np.uint64)])
            hashes[i : i + WORDS] = mix64(sums[first + n] - sums[first])
    return hashes


def _extended(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of phrases with one more word at the end."""
    with np.errstate(over="ignore"):
        return mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + word)


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


class Sieve:
    """Which hashes may be of frequent phrases: a Bloom filter of a fixed size over those that are.

    It lets every frequent phrase pass. The rest that it lets pass costs work and is counted.
    """

    def __init__(self, hashes: DataFrame, bits: int = SIEVE_BITS):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = np.unique(np.concatenate(_bits(batch.column("h").to_numpy().view(np.uint64), bits)))
                yield pa.RecordBatch.from_pydict({"at": pa.array(both)})

        words = hashes.select("h").mapInArrow(places, "at long")
        words = words.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("b"))
        rows = words.toArrow()
        table = np.zeros(bits // 64, np.uint64)
        table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
        self.bits = bits
        self.table = hashes.sparkSession.sparkContext.broadcast(table)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        table = self.table.value
        a, b = _bits(hashes, self.bits)
        ok = (table[a >> 6] >> (a & 63).astype(np.uint64)) & np.uint64(1) == 1
        some = np.flatnonzero(ok)
        ok[some] = (table[b[some] >> 6] >> (b[some] & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _word_hashes(words: DataFrame) -> DataFrame:
    """(h): hashes of counted words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = flat(batch.column("key"))
            size = np.diff(at)
            begin = at[:-1] + np.arange(len(size))
            out = np.zeros(len(data) + len(size), np.uint8)
            out[ranges(begin, size)] = data
            yield pa.RecordBatch.from_pydict({"h": pa.array(_hashes(out, begin, size).view(np.int64))})

    return words.select("key").mapInArrow(hashed, "h long")


def _pair_hashes(texts: DataFrame, words: Sieve) -> DataFrame:
    """(h, f): how often pairs of words that pass have each hash, in all languages together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            out, begin, size, piece, _ = _words(batch.column("text"))
            hashes = _hashes(out, begin, size)
            ok = words.passes(hashes)
            some = np.flatnonzero((piece[:-1] == piece[1:]) & ok[:-1] & ok[1:])
            h, n = np.unique(_extended(hashes[some], hashes[some + 1]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "f": pa.array(n.astype(np.int64))})
        give_back()

    return texts.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _counted(texts: DataFrame, lengths: tuple[int, ...], pairs: Sieve | None) -> DataFrame:
    """(lang, key, f) of all phrases of these lengths in which each pair of words passes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            out, begin, size, piece, text = _words(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[text]
            # How many words from each on may be one phrase.
            reach = np.ones(len(begin), np.int64)
            if pairs is not None and len(begin):
                hashes = _hashes(out, begin, size)
                next_to = (piece[:-1] == piece[1:]) & pairs.passes(_extended(hashes[:-1], hashes[1:]))
                stops = np.append(np.flatnonzero(~next_to), len(begin) - 1)
                reach = stops[np.searchsorted(stops, np.arange(len(begin)))] - np.arange(len(begin)) + 1
            for m in lengths:
                at = np.flatnonzero(reach >= m)
                if not len(at):
                    continue
                last = at + m - 1
                span = begin[last] + size[last] - begin[at]
                keys = binary_array(gathered(out, begin[at], span), np.concatenate([[0], np.cumsum(span)]))
                table = pa.table({"lang": lang[at], "key": keys})
                table = table.group_by(["lang", "key"], use_threads=False).aggregate([("key", "count")])
                names = langs.dictionary.take(table.column("lang").combine_chunks())
                keys = table.column("key").combine_chunks().cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"lang": names, "key": keys, "f": table.column("key_count").combine_chunks()})
        give_back()

    return texts.mapInArrow(count, "lang string, key binary, f long").groupBy("lang", "key").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, m, key, f) of all phrases of up to ``longest`` words with f of at least ``least``,
    and (lang, n, rows) of all words.

    A phrase is no more frequent than any part of it. So the second pass over the texts counts
    hashes of pairs of words that pass the sieve of frequent words, and the third all phrases in
    which each pair passes the sieve of frequent pairs. Sieves only leave out; counts are of phrases.
    """
    texts = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    words = cut(_counted(texts, (1,), None), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = F.col("f") >= least
    counts = cut(words.where(often), "phrase-frequent")
    if longest > 1:
        pairs = cut(_pair_hashes(texts, Sieve(_word_hashes(counts))).where(often), "phrase-pairs")
        counts = counts.unionByName(_counted(texts, tuple(range(2, longest + 1)), Sieve(pairs)).where(often))
    # As many words as bytes 0 between them, and one.
    latin = F.decode("key", "ISO-8859-1")
    m = F.length(latin) - F.length(F.translate(latin, "\0", "")) + 1
    return cut(counts.select("lang", "key", "f", m.alias("m"), F.monotonically_increasing_id().alias("id")), "phrase-counts"), totals


def _parts(counts: DataFrame, key: Column, longest: int, name: str) -> DataFrame:
    """Count streams of all lengths, merged in the order of ``key``: id and, for each k below its
    length, (f, id) of the phrase of the first k words of the key.

    A phrase stands right before all that begin with it, so the last phrase of k words seen is the
    beginning of every longer one; every part of a frequent phrase is frequent and in the stream.
    """
    rows = in_order(counts.select("lang", "m", "id", "f", key.alias("key")), [F.col("lang"), F.col("key")], name)
    seen = {f"k{k}": F.when(F.col("m") == k, F.struct("f", "id")) for k in range(1, longest)}
    rows = last_seen(rows, seen)
    return rows.select("id", F.array(*[F.when(F.col("m") > k, F.col(f"k{k}")) for k in range(1, longest)]).alias(name))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    Texts are lowered (A to Z), split at ``BREAKS`` into pieces and at ``BLANKS`` into words; a null
    text is empty, a null language is ``und``. Candidates have 2 to ``longest`` words and occur at
    least ``least`` times. A cut into the first k words and the rest, which occur l and r times,
    scores floor(1000 * a * n / (l * r)); the lowest counts, ties to the smallest k. A candidate that
    occurs no more often than a longer phrase around it is dropped; then some phrase longer by one
    word occurs as often, so only those are compared.

    Counts are kept as streams in two orders, by first words and by last words, which are read in
    lockstep: the first gives l and the counts of extensions to the right, the second r and those
    to the left. Rows with the same text count each. Other columns are not looked at. An empty
    table, or one without candidates, gives no rows.

    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    with lean(docs.sparkSession):
        counts, totals = phrase_counts(docs, least, longest)
    latin = F.decode("key", "ISO-8859-1")
    back = F.encode(F.array_join(F.reverse(F.split(latin, "\\x00")), "\0"), "ISO-8859-1")
    first, last = _parts(counts, F.col("key"), longest, "first"), _parts(counts, back, longest, "last")
    both = cut(counts.join(first, "id").join(last, "id").where("m > 1"), "phrase-parts")
    # An extension by one word that is as frequent as what it extends marks that.
    shorter = F.array(F.get("first", F.col("m") - 2), F.get("last", F.col("m") - 2))
    marks = both.select("f", F.explode(shorter).alias("x")).where("f >= x.f").select(F.col("x.id").alias("id")).distinct()
    left = both.join(marks, "id", "left_anti")
    rows = left.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    totals = cut(rows.join(totals, "lang"), "phrase-totals")
    left = hot_split_join(cut(left, "phrase-left"), totals, ["lang"], "rows", "id")
    scored = left.withColumn("cut", F.array_min(F.array_compact(F.array(*[_cut(k) for k in range(1, longest)]))))
    named = scored.select("lang", "key", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score").mapInArrow(_with_text, ROWS)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First in each of a few parts of a language, so that no task ranks all its phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
    some = named.withColumn("_rn", best).where(F.col("_rn") <= top).drop("_rn")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(k: int) -> Column:
    """The cut after ``k`` words, or null where a phrase has no more. Products may pass 64 bits."""
    whole, parts = "1000bd * f * cast(n as decimal(20,0))", f"cast(get(first, {k - 1}).f as decimal(38,0)) * get(last, m - {k + 1}).f"
    row = f"named_struct('score', ({whole}) div ({parts}), 'k', {k}, 'l', get(first, {k - 1}).f, 'r', get(last, m - {k + 1}).f)"
    return F.expr(f"if(m > {k}, {row}, null)")


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases as text: every byte one lower, a blank between words."""
    back = bytes([32, *range(255)])
    for batch in batches:
        texts = [key.translate(back).decode() for key in batch.column("key").to_pylist()]
        at = batch.schema.get_field_index("key")
        yield batch.set_column(at, pa.field("phrase", pa.string()), pa.array(texts, pa.string()))


# The same in DuckDB's SQL.
SQL = r"""WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, 6) AS x(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE f >= 100),
alive AS (
  SELECT * FROM often c WHERE m > 1 AND NOT EXISTS (
    SELECT 1 FROM often d WHERE d.lang = c.lang AND d.m > c.m AND d.f >= c.f
    AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n,
    CAST(1000 AS HUGEINT) * c.f * CAST(n AS HUGEINT) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM alive) c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
    CAST(score AS BIGINT) AS score FROM weakest)
WHERE rank <= 2000"""
