"""Repeated substrings of a corpus by a distributed merge sort of suffixes.

Which suffixes need sorting is found by hashes; whether one repeats is decided by the sort alone.

* A text's windows of ``LENGTH`` bytes fall into rows: neighbours whose least k-gram (by hash) is
  the same one. Equal windows have equal least k-grams, so a window repeats only where another
  row has the same one. Rows that share theirs and are equal as a whole are claimed to repeat;
  rows that share it with unlike rows are cut again by a longer k-gram, at last window by window.
* Claimed rows are suffixes of the text, cut where the row ends. Each task sorts its own into
  runs, sends them front-coded to the task of their range, and a loser tree there merges the
  runs. Its nodes remember how many bytes a loser shares with the last winner; a longer common
  prefix decides by itself, and bytes that are known to be equal are not looked at again.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import flat, give_back, lean, mix64, slices, spread
from .stores import discard, written

LENGTH = 200
LEVELS = (64, 176, 200)
CHUNK = 1 << 19
RUN_BYTES = 8 << 20
BASE = 0x9E3779B97F4A7C15
KEYS = ["k1", "k2"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.full(n, BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_KEPT: list[np.ndarray] = []


def least_gram_rows(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Rows of windows of all texts: text, first and last window (from the text's begin), hash of
    the least k-gram that its windows share, hash of all of its bytes."""
    if not _KEPT:
        _KEPT.extend(_powers(CHUNK + 2 * LENGTH))
    up, down = _KEPT
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    mark = np.zeros(len(data) + 1, np.int8)
    has = np.diff(at) >= LENGTH
    np.add.at(mark, at[:-1][has], 1)
    np.add.at(mark, at[1:][has] - LENGTH + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    out = []
    low = np.uint64((1 << 22) - 1)
    with np.errstate(over="ignore"):
        for c in range(0, len(data), CHUNK):
            ok = valid[c : c + CHUNK]
            if not ok.any():
                continue
            part = data[c : c + CHUNK + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)])])
            gram = mix64((sums[k:] - sums[:-k]) * down[: len(part) - k + 1])
            best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
            wide, width = LENGTH - k + 1, 1
            while width * 2 <= wide:
                best = np.minimum(best[:-width], best[width:])
                width *= 2
            if wide > width:
                best = np.minimum(best[: len(best) - (wide - width)], best[wide - width :])
            n = min(len(best), len(ok))
            ok, best = ok[:n], best[:n]
            new = ok.copy()
            new[1:] &= (best[1:] != best[:-1]) | ~ok[:-1] | begins[c + 1 : c + n]
            first = np.flatnonzero(new)
            last = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
            size = (last - first + LENGTH).astype(np.uint64)
            whole = mix64((sums[last + LENGTH] - sums[first]) * down[first] + size)
            out.append((first + c, last + c, gram[(best[first] & low).astype(np.int64)], whole))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first, last, gram, whole = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(at, first, side="right") - 1
    return text, first - at[text], last - at[text], gram, whole


# A row's place in one number: its first window, how many more it has (fewer than LENGTH, so a
# byte holds them), whether it is claimed to repeat, and whether it needs another look.
CLAIM, AGAIN = 2, 1
ROW = "gram long, whole long, k1 long, k2 long, off long, mark long"


def _windows(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of marked rows."""
    lo = mark >> 10
    return lo, lo + ((mark >> 2) & 255)


def _unpacked(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches with their texts whole again, a few rows at a time."""
    for all_ in batches:
        for i in range(0, all_.num_rows, most):
            batch = all_.slice(i, most)
            whole = [zstandard.decompress(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(whole, pa.binary()))


def _flagged(texts: DataFrame, k: int, packed: bool) -> tuple[DataFrame, str]:
    """Rows whose least k-gram another row has: (k1, k2, off, mark), and the table they are read from.

    Rows are sorted over all partitions, so a frequent k-gram is no one's task, and compared with
    their neighbours: an equal one makes a claim; an unlike one under the same k-gram asks for
    another look, unless all rows under it are seen to make claims. Only the rows at partition borders, two each, are compared by the driver.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_unpacked(batches) if packed else batches, most=CHUNK):
            text, lo, hi, gram, whole = least_gram_rows(*flat(batch.column("text"))[::-1], k)
            pick = pa.array(text)
            keys = [batch.column(c).take(pick) for c in (*KEYS, "off")]
            mark = pa.array((lo << 10) | ((hi - lo) << 2))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), *keys, mark], order)

    order = ["gram", "whole", *KEYS, "off", "mark"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        first = True

        def flags(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            gram, whole = t.column("gram").to_numpy(), t.column("whole").to_numpy()
            same = gram[1:] == gram[:-1]
            equal = same & (whole[1:] == whole[:-1])
            claim, again = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
            for x, y in ((claim, equal), (again, same & ~equal)):
                x[1:] |= y
                x[:-1] |= y
            # A group that lies inside this batch and has claims only needs no other look.
            group = np.concatenate([[0], np.cumsum(~same)])
            open_ = np.bincount(group, again & ~claim) > 0
            open_[[0, -1]] = True
            return claim, again & open_[group]

        def rows(t: pa.Table, claim, again, border: int) -> Iterator[pa.RecordBatch]:
            mark = t.column("mark").to_numpy() | claim * CLAIM | again * AGAIN
            t = t.set_column(5, "mark", pa.array(mark)).append_column("part", pa.array(np.full(len(mark), border, np.int64)))
            if border < 0:
                # Hashes are of no more use away from the borders.
                t = t.filter(pa.array(claim | again))
                none = pa.nulls(t.num_rows, pa.int64())
                t = t.set_column(0, "gram", none).set_column(1, "whole", none)
            yield from t.to_batches()

        # The last row is held back, with its flags so far, until its next one is known.
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held[0], t]) if held else t
            claim, again = flags(t)
            if held:
                claim[0] |= held[1]
                again[0] |= held[2]
            n = t.num_rows
            if first and n > 1:
                yield from rows(t.slice(0, 1), claim[:1], again[:1], part)
                first = False
                yield from rows(t.slice(1, n - 2), claim[1:-1], again[1:-1], -1)
            elif not first:
                yield from rows(t.slice(0, n - 1), claim[:-1], again[:-1], -1)
            held = (t.slice(n - 1, 1), claim[-1], again[-1])
        if held:
            yield from rows(held[0], np.array([held[1]]), np.array([held[2]]), part)
        give_back()

    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.mapInArrow(split, ROW).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found, path = written(ranged.mapInArrow(compare, f"{ROW}, part long"), "suffix-rows")
    border = [list(r) for r in found.where("part >= 0").select("part", *order).collect()]
    border.sort()
    for x, y in zip(border, border[1:], strict=False):
        if x[0] != y[0] and x[1] == y[1]:
            flag = CLAIM if x[2] == y[2] else AGAIN
            x[6] |= flag
            y[6] |= flag
    columns = [*KEYS, "off", "mark"]
    rows = found.where("part < 0").select(*columns)
    extra = [tuple(r[3:]) for r in border if r[6] & (CLAIM | AGAIN)]
    if extra:
        rows = rows.union(spark.createDataFrame(extra, ROW.split("whole long, ")[1]))
    return rows, path


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Run:
    """A sorted run of distinct suffixes, front-coded: what each shares with the one before it,
    the rest of its bytes, and where it stands."""

    @staticmethod
    def pack(texts: list[bytes], refs: np.ndarray) -> bytes:
        shared = [0, *(common(a, b, 0) for a, b in zip(texts, texts[1:], strict=False))]
        tails = [t[s:] for t, s in zip(texts, shared, strict=True)]
        head = np.array([shared, [len(t) for t in tails]], np.uint16).tobytes()
        body = zlib.compress(head + b"".join(tails), 1)
        return np.array([len(texts), len(body)], np.int64).tobytes() + body + refs.tobytes()

    def __init__(self, blob: bytes):
        n, size = np.frombuffer(blob[:16], np.int64).tolist()
        body = zlib.decompress(blob[16 : 16 + size])
        lengths = np.frombuffer(body[: 4 * n], np.uint16).astype(np.int64).reshape(2, n)
        self.shared, self.size = lengths[0].tolist(), lengths[1].tolist()
        self.body, self.at = body, 4 * n
        self.refs = np.frombuffer(blob[16 + size :], np.int64).reshape(n, 6)
        self.i, self.text = -1, b""

    def step(self) -> bool:
        """To the next suffix; ``shared[i]`` is what it has in common with the one before."""
        self.i += 1
        if self.i == len(self.size):
            return False
        end = self.at + self.size[self.i]
        self.text = self.text[: self.shared[self.i]] + self.body[self.at : end]
        self.at = end
        return True


class LoserTree:
    """Merge of sorted runs that never compares bytes known to be equal.

    Every run's head has ``lcp``, its common prefix with the suffix that came out last. At a node
    the one with the longer lcp is the smaller, without a look at the texts, and the loser keeps
    its own, which then is also its common prefix with the winner. At equal lcps the bytes behind
    them decide, and the loser remembers how far the two agree.
    """

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.n = len(runs)
        self.lcp = [0] * self.n
        self.over = [not r.step() for r in runs]
        self.tree = [-1] * max(self.n, 1)
        for r in range(self.n):
            self._enter(r)

    def _enter(self, r: int) -> None:
        """While the tree fills, a run waits at the first free node."""
        node = (r + self.n) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = r
                return
            r = self._play(node, r)
            node //= 2
        self.tree[0] = r

    def _play(self, node: int, r: int) -> int:
        """The winner goes on; the loser stays at the node."""
        s = self.tree[node]
        if self._first(s, r):
            self.tree[node], r = r, s
        return r

    def _first(self, s: int, r: int) -> bool:
        if self.over[s] or self.over[r]:
            return not self.over[s]
        a, b = self.lcp[s], self.lcp[r]
        if a != b:
            return a > b
        x, y = self.runs[s].text, self.runs[r].text
        k = common(x, y, a)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            self.lcp[r] = k
            return True
        self.lcp[s] = k
        return False

    def merged(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """(common prefix with the one before, suffix, its place) in order; equal ones in a row."""
        while self.n and not self.over[r := self.tree[0]]:
            run = self.runs[r]
            yield self.lcp[r], run.text, run.refs[run.i]
            self.over[r] = not run.step()
            self.lcp[r] = 0 if self.over[r] else run.shared[run.i]
            node = (r + self.n) // 2
            while node:
                r = self._play(node, r)
                node //= 2
            self.tree[0] = r


def _spans(runs: list[Run]) -> np.ndarray:
    """Windows that repeat, as (k1, k2, first, last) rows, from the merged order: a suffix's are
    those within what it shares with a neighbour, all if a run had several of it."""
    out = []
    last_ref, last_size, last_best = None, 0, 0

    def close() -> None:
        if last_ref is None:
            return
        k1, k2, lo, hi, _, many = last_ref.tolist()
        end = hi if many else min(hi, lo + last_best - LENGTH)
        if end >= lo:
            out.append((k1, k2, lo, end))

    for lcp, text, ref in LoserTree(runs).merged():
        last_best = max(last_best, lcp)
        close()
        last_ref, last_size, last_best = ref, len(text), lcp
    close()
    return np.array(out, np.int64).reshape(-1, 4)


SPAN = "range long, blob binary, k1 long, k2 long, off long, lo long, hi long, text binary"


def _span_batch(n: int, **given) -> pa.RecordBatch:
    kinds = {"range": pa.int64(), "blob": pa.binary(), "k1": pa.int64(), "k2": pa.int64(), "off": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "text": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def _runs(met: DataFrame, splitters: list[bytes]) -> tuple[DataFrame, str]:
    """From texts with their flagged rows: sorted runs by range, texts to look at again, and
    windows found to repeat within one run; and the table they are read from."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort()
            texts, refs, twins = [], [], []
            for text, *ref in held:
                if texts and text == texts[-1]:
                    refs[-1][5] = 1
                    twins.append(ref)
                else:
                    texts.append(text)
                    refs.append([*ref, 0, 0])
            edge = [0]
            for s in splitters:
                edge.append(bisect_right(texts, s, edge[-1]))
            edge.append(len(texts))
            table = np.array(refs, np.int64).reshape(-1, 6)
            blobs = [(i, Run.pack(texts[a:b], table[a:b])) for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a]
            yield _span_batch(len(blobs), range=[b[0] for b in blobs], blob=[b[1] for b in blobs])
            if twins:
                k1, k2, lo, hi = zip(*twins, strict=True)
                yield _span_batch(len(twins), k1=k1, k2=k2, lo=lo, hi=hi)

        for batch in batches:
            k1, k2, off = (batch.column(c).to_pylist() for c in (*KEYS, "off"))
            packed, rows = batch.column("text"), batch.column("rows")
            marks = rows.flatten().to_numpy(zero_copy_only=False)
            claim, again = marks & CLAIM > 0, marks & AGAIN > 0
            lo, hi = _windows(marks)
            ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                text = zstandard.decompress(packed[i].as_py())
                mine = np.flatnonzero(claim[a:b]) + a
                for x, y in zip(lo[mine].tolist(), hi[mine].tolist(), strict=True):
                    held.append((text[x : y + LENGTH], k1[i], k2[i], off[i] + x, off[i] + y))
                size += int((hi[mine] - lo[mine] + LENGTH).sum())
                mine = np.flatnonzero(again[a:b]) + a
                if len(mine):
                    # Rows side by side are one text for the next look.
                    mine = mine[np.argsort(lo[mine], kind="stable")]
                    x, y = lo[mine], np.maximum.accumulate(hi[mine])
                    new = np.concatenate([[True], x[1:] > y[:-1] + 1])
                    x, y = x[new].tolist(), y[np.append(np.flatnonzero(new)[1:] - 1, len(y) - 1)].tolist()
                    n = len(x)
                    some = [zstandard.compress(text[p : q + LENGTH], 1) for p, q in zip(x, y, strict=True)]
                    yield _span_batch(n, k1=[k1[i]] * n, k2=[k2[i]] * n, off=[off[i] + p for p in x], text=some)
                if size >= RUN_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()
            held.clear()
        give_back()

    return written(met.mapInArrow(work, SPAN), "suffix-runs")


def _merge(runs: DataFrame) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        got = _spans([Run(b) for b in table.column("blob").to_pylist()])
        give_back()
        return pa.table({c: pa.array(got[:, i]) for i, c in enumerate(("k1", "k2", "lo", "hi"))})

    return runs.groupBy("range").applyInArrow(merge, "k1 long, k2 long, lo long, hi long")


def _splitters(texts: DataFrame, parts: int) -> list[bytes]:
    """Borders of the ranges, from suffixes at even steps of 512 sampled texts; they steer the
    work and never the result."""
    rows = texts.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(512).select(F.substring("text", 1, 1 << 13).alias("text")).collect()
    some = sorted({bytes(r.text[i : i + 48]) for r in rows for i in range(0, max(len(r.text) - LENGTH, 0), 97)})
    return sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, most=CHUNK):
            small = [press.compress(t) for t in batch.column("text").to_pylist()]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(small, pa.binary()))

    return texts.mapInArrow(pack, texts.schema)


def repeated(texts: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Windows of ``LENGTH`` bytes that also start elsewhere: (k1, k2, lo, hi), first to last."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(texts, parts)
    spans, before = [], ""
    for level, k in enumerate(levels):
        rows, flagged = _flagged(texts, k, packed=level > 0)
        if level == len(levels) - 1:
            rows = rows.where(F.col("mark").bitwiseAND(F.lit(CLAIM)) > 0)
        each = rows.groupBy(*KEYS, "off").agg(F.collect_list("mark").alias("rows"))
        each = each.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("off").alias("_off"), "rows")
        same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("off") == F.col("_off"))
        source = texts if level else _packed(texts)
        found, path = _runs(source.join(each, same).select(*KEYS, "off", "text", "rows"), splitters)
        merged = _merge(found.where("blob is not null").select("range", "blob"))
        twins = found.where("range is null and text is null").select("k1", "k2", "lo", "hi")
        spans.append(cut(merged.union(twins), "suffix-spans"))
        texts = found.where("text is not null").select(*KEYS, "off", "text")
        # What later steps read is written by now.
        discard(texts.sparkSession, flagged)
        if before:
            discard(texts.sparkSession, before)
        before = path
    discard(texts.sparkSession, before)
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes [begin, end) that windows lo to hi cover."""
    order = np.argsort(lo, kind="stable")
    begin, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1) if len(begin) else np.zeros(0, np.int64)
    return begin[new], end[last]


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Each document without the bytes that a 200-byte string covers which also starts elsewhere.

    Texts are UTF-8 bytes; matches never cross documents, may overlap, and are judged on the
    input. A null text is empty, one under 200 bytes stays whole. Rows with a repeated or null
    doc_id are documents of their own; rows alike in id and text count each other as elsewhere.
    Other columns are not looked at. No rows give no rows.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``texts`` the remaining
    bytes as ``kept``.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    own = spread(own).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-1 << 63)).alias("k1"),
        F.xxhash64("text").alias("k2"),
        F.lit(0).cast("long").alias("off"),
        "text",
    )
    with lean(docs.sparkSession):
        spans = repeated(own.select(*KEYS, "off", "text"))
    mark = F.shiftleft("lo", 10) + F.shiftleft(F.col("hi") - F.col("lo"), 2)
    each = spans.groupBy(*KEYS).agg(F.collect_list(mark).alias("spans"))
    each = each.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "spans")
    met = _packed(own.drop("off")).join(each, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for packed, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                text = zstandard.decompress(packed.as_py())
                pieces, at = [], 0
                n = 0
                if spans.is_valid:
                    begin, end = covered(*_windows(spans.values.to_numpy()))
                    n = len(begin)
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        pieces.append(text[at:a])
                        at = b
                pieces.append(text[at:])
                kept = b"".join(pieces)
                for c, v in zip(out, (len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(v)
            if not texts:
                del out["kept"]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})
        give_back()

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return met.select("doc_id", "text", "spans").mapInArrow(strip, ddl)
