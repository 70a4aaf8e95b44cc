"""Helpers for operators that work on Arrow batches of texts inside Spark tasks."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut so that its texts have about ``most`` bytes: one text at least, however long."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // most
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(at, at[1:], strict=False):
        yield batch.slice(i, j - i)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``pieces`` of all batches."""
    for batch in batches:
        yield from pieces(batch, text, most)
    give_back()


@contextlib.contextmanager
def lean(spark: SparkSession, most: int = 4 << 20):
    """Jobs run inside hand rows to Python in Arrow batches of about ``most`` bytes at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or if a column has it the same with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Free memory goes back to the system, as an idle worker waits beside busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of UTF-8 bytes, and where each begins and ends; null is empty."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Bytes cut at ``at`` as a binary column, without a copy of the bytes."""
    at = np.ascontiguousarray(at, np.int64)
    buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, buffers)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """``data`` at the ranges from each start on, in a row; about ``most`` places are held at a time,
    as a place takes eight times the memory of a byte."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(ends[-1]), data.dtype)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        out[ends[i] : ends[j]] = data[ranges(starts[i:j], lengths[i:j])]
        i = j
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores for heavy work per row; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _kept() -> dict:
    return vars(sys.modules.setdefault("_siftgraph_kept", types.ModuleType("_siftgraph_kept")))


def forget() -> None:
    """Let go of what earlier operators keep in this Python worker, which outlives their tasks."""
    names = [n for n in _kept() if not n.startswith("__")]
    for name in names:
        del _kept()[name]
    if names:
        give_back()


def per_worker(key: tuple, make):
    """What ``make`` returns, made once in a Python worker and kept for its later tasks.

    Functions travel with each job, and so do the globals that they see; a module entry of the
    process outlives the task. One thing is kept at a time.
    """
    name = repr(key)
    if name not in _kept():
        forget()
        _kept()[name] = make()
    return _kept()[name]


def plain_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (binary) and at which word each text begins.

    A word is a run of ASCII letters and characters beyond ASCII; A to Z and the accented capitals
    of Latin-1 are lowered.
    """
    at, data = flat(column)
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    low = table[data]
    if len(low):
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 32
    inside = low != 32
    begins = inside.copy()
    if len(low):
        begins[1:] &= ~inside[:-1]
        first = at[:-1][at[:-1] < len(low)]
        begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(inside)])
    words = binary_array(low[inside], np.append(before[starts], before[-1]))
    return words, np.searchsorted(starts, at)


def gram_buckets(words: pa.Array, orders: tuple[int, ...], buckets: int, affixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of distinct words, in a row, and how many each has: byte n-grams of the
    word between boundary marks, prefixes and suffixes, and the word itself."""
    at, data = flat(words)
    n = len(words)
    size = np.diff(at)
    # Each word between two marks.
    at2 = at + 2 * np.arange(n + 1)
    marked = np.full(len(data) + 2 * n, 1, np.uint64)
    inside = ranges(at2[:-1] + 1, size)
    marked[inside] = data
    owner = np.repeat(np.arange(n), size + 2)
    rows, hashes = [], []

    def add(who: np.ndarray, h: np.ndarray, salt: int) -> None:
        rows.append(who)
        hashes.append(mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))

    with np.errstate(over="ignore"):
        for k in orders:
            h = np.zeros(max(len(marked) - k + 1, 0), np.uint64)
            for i in range(k):
                h = h * np.uint64(257) + marked[i : len(marked) - k + 1 + i]
            ok = owner[: len(h)] == owner[k - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
            add(owner[: len(h)][ok], h[ok], 1000 + k)
        for k in affixes:
            long = np.flatnonzero(size >= k)
            for salt, begin in ((2000 + k, at2[:-1][long] + 1), (3000 + k, at2[:-1][long] + 1 + size[long] - k)):
                h = np.zeros(len(long), np.uint64)
                for i in range(k):
                    h = h * np.uint64(257) + marked[begin + i]
                add(long, h, salt)
        value = data.astype(np.uint64) + np.uint64(1)
        power = mix64(np.arange(int(size.max(initial=0)), dtype=np.uint64) + np.uint64(7)) | np.uint64(1)
        term = value * power[ranges(np.zeros(n, np.int64), size)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        add(np.arange(n), sums[at[1:]] - sums[at[:-1]], 4000)
    who, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(who, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int64), np.bincount(who, minlength=n)


def hash_fold(doc_id: str, parts: int):
    """Which of ``parts`` folds a document is in, by the CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


class IdFilter:
    """A Bloom filter of ids with a fixed size, 16 MB: every id of the table passes it, and with far
    fewer ids than bits hardly any other. What passes still has to be joined."""

    BITS = 1 << 27

    def __init__(self, ids: DataFrame):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.unique(self.place(batch.column(0).to_numpy())))})

        words = ids.mapInArrow(places, "at long").groupBy(F.shiftright("at", 6).alias("w"))
        rows = words.agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("b")).toArrow()
        table = np.zeros(self.BITS // 64, np.uint64)
        table[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    @classmethod
    def place(cls, ids: np.ndarray) -> np.ndarray:
        return (mix64(ids.view(np.uint64)) & np.uint64(cls.BITS - 1)).astype(np.int64)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        at = self.place(ids)
        return (self.table.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
