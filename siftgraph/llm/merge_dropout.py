"""SentencePiece merge encoding with seeded dropout, and its lossless decoding."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, flat, mix64, per_worker, ranges, slices, spread

NONE = np.int64(1 << 40)
CHUNK = 50_000  # units walked at once
WIDE = 48  # symbols; longer units go through a heap, whose work doesn't grow with the square


class MergeModel:
    """Pieces and merges of a SentencePiece merge model with byte fallback and no normalisation.

    A merge is a pair of symbols whose joined text is a piece; its rank follows the piece's score.
    A character that is no piece, and a literal U+2581, which stands for the blank in pieces, is
    a symbol that never merges and is written as its bytes.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace("▁", " ") for i in plain}
        known = {t: i for i, t in text.items()}
        self.size, self.odd = n, n + 1
        self.bytes_id = np.zeros(256, np.int64)
        pool: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes_id[value], pool[i] = i, bytes([value])
        for i, t in text.items():
            pool[i] = t.encode()
        self.piece_size = np.array([len(b) for b in pool], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.pool = np.frombuffer(b"".join(pool), np.uint8)
        self.char = np.full(0x110000, -1, np.int64)
        for t, i in known.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.joint = np.zeros((256, 256), bool)
        self.joint[128:], self.joint[:, 128:] = True, True
        for t in known:
            for a, b in zip(t.encode(), t.encode()[1:], strict=False):
                self.joint[a, b] = True
        place = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        rows = []
        for t, i in known.items():
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    rows.append((a << 32 | b, place[i], i))
        rows.sort()
        self.table = {(k >> 32, k & 0xFFFFFFFF): (r, i) for k, r, i in rows}
        self.keys, self.ranks, self.merged = (np.array(c, np.int64) for c in zip(*rows, strict=True))

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if they don't merge) and merged piece of pairs of symbols."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def symbols(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units in a row, a missing character c as -2 - c, and each unit's number."""
        texts = [u.decode() for u in units]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        got = self.char[chars]
        odd = got < 0
        got[odd] = -2 - chars[odd]
        return got, np.array([len(t) for t in texts], np.int64)

    def to_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols as ids, missing characters as their bytes."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, counts
        forms = [chr(-2 - int(c)).encode() for c in symbols[odd]]
        size = np.ones(len(symbols), np.int64)
        size[odd] = [len(f) for f in forms]
        out = np.repeat(symbols, size)
        out[out < 0] = self.bytes_id[np.frombuffer(b"".join(forms), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = ends[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(at)


def candidate(offset: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """What a candidate merge puts into its hash: its place and piece."""
    return mix64((offset.astype(np.uint64) << np.uint64(32)) | piece.astype(np.uint64))


def skipped(key: np.ndarray, mark: np.ndarray, rate: float) -> np.ndarray:
    """Is the candidate of this mark skipped under the key of its unit's occurrence?"""
    return (mix64(key ^ mark) >> np.uint64(11)).astype(np.float64) < rate * float(1 << 53)


def dropped(key: np.ndarray, offset: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Is this candidate merge skipped? By a hash keyed with the unit's key, place and piece."""
    return skipped(key, candidate(offset, piece), rate)


MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """``mix64`` of one word."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def by_heap(model: MergeModel, symbols: np.ndarray, key: int, rate: float) -> list[int]:
    """One unit: an agenda of candidate merges, best rank first, then leftmost; dropped ones go."""
    n, table, least = len(symbols), model.table, rate * (1 << 53)
    sym, prev, after = symbols.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            a, b = sym[i], sym[after[i]]
            found = table.get((a, b))
            if found and not (rate and _mix(key ^ _mix(i << 32 | found[1])) >> 11 < least):
                heapq.heappush(agenda, (found[0], i, found[1], a, b))

    for i in range(n):
        add(i)
    while agenda:
        _, i, piece, a, b = heapq.heappop(agenda)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j], after[i] = piece, -1, after[j]
        if after[j] >= 0:
            prev[after[j]] = i
        add(prev[i])
        add(i)
    out, i = [], 0
    while i >= 0 and n:
        out.append(sym[i])
        i = after[i]
    return out


def by_rounds(
    model: MergeModel, sym: np.ndarray, key: np.ndarray, rate: float, log: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Many units of up to ``WIDE`` symbols at once, rows filled with -1: each round takes the best
    candidate of every row off its agenda and merges or drops it. Symbols in place, and counts.

    ``log`` takes each round's rows with place and piece of their candidates."""
    n, width = sym.shape
    count = (sym != -1).sum(1)
    final = sym.copy()
    if width < 2:
        return final, count
    offset = np.broadcast_to(np.arange(width), sym.shape).copy()
    rank, piece = model.pair(sym[:, :-1], sym[:, 1:])
    rows, length = np.arange(n), count.copy()
    while len(rows):
        j = rank.argmin(1)
        at = np.arange(len(rows))
        going = rank[at, j] < NONE
        if not going.all():
            over = rows[~going]
            final[over] = -1
            final[over, : sym.shape[1]] = sym[~going]
            count[over] = length[~going]
            rows, sym, offset, rank, piece, length, j, key = (x[going] for x in (rows, sym, offset, rank, piece, length, j, key))
            at = np.arange(len(rows))
            if not len(rows):
                break
        if log is not None:
            log.append((rows, offset[at, j], piece[at, j]))
        if rate:
            skip = dropped(key, offset[at, j], piece[at, j], rate)
            rank[at[skip], j[skip]] = NONE
        else:
            skip = np.zeros(len(rows), bool)
        m = np.flatnonzero(~skip)
        if len(m):
            jm, w = j[m], sym.shape[1]
            sym[m, jm] = piece[m, jm]
            move = np.arange(w - 1)[None] + (np.arange(w - 1)[None] > jm[:, None])
            for x in (sym, offset):
                x[m, : w - 1] = x[m[:, None], move]
                x[m, w - 1] = -1
            if w > 2:
                for x, empty in ((rank, NONE), (piece, 0)):
                    x[m, : w - 2] = x[m[:, None], move[:, : w - 2]]
                    x[m, w - 2] = empty
            else:
                rank[m] = NONE
            length[m] -= 1
            for d in (-1, 0):
                i = jm + d
                ok = (i >= 0) & (i + 1 < length[m])
                k, i = m[ok], i[ok]
                rank[k, i], piece[k, i] = model.pair(sym[k, i], sym[k, i + 1])
            last = m[(jm < w - 1) & (jm >= length[m] - 1)]
            jl = j[last]
            inside = jl < rank.shape[1]
            rank[last[inside], jl[inside]] = NONE
        most = int(length.max())
        if most < sym.shape[1] and most >= 2:
            sym, offset = sym[:, :most].copy(), offset[:, :most].copy()
            rank, piece = rank[:, : most - 1].copy(), piece[:, : most - 1].copy()
    return final, count


def together(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Values of n rows in a row, and how many each has, from parts of (rows, values, counts)."""
    size = np.zeros(n, np.int64)
    for at, _, count in parts:
        size[at] = count
    begin, out = np.cumsum(size) - size, np.zeros(int(size.sum()), kind)
    for at, got, count in parts:
        out[ranges(begin[at], count)] = got
    return out, size


def by_width(symbols: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of up to ``WIDE`` symbols by size class: which, and their symbols filled with -1."""
    first = np.cumsum(n) - n
    for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 24), (24, WIDE)):
        at = np.flatnonzero((n > low) & (n <= high))
        if len(at):
            width = int(n[at].max())
            sym = np.full((len(at), width), -1, np.int64)
            sym[np.arange(width)[None] < n[at][:, None]] = symbols[ranges(first[at], n[at])]
            yield at, sym


def encode_units(model: MergeModel, units: list[bytes], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units in a row, each cut under its key, and how many each has."""
    symbols, n = model.symbols(units)
    first = np.cumsum(n) - n
    parts = []
    for at, sym in by_width(symbols, n):
        sym, count = by_rounds(model, sym, keys[at], rate)
        parts.append((at, *model.to_ids(sym[np.arange(sym.shape[1])[None] < count[:, None]], count)))
    for i in np.flatnonzero(n > WIDE).tolist():
        got = np.array(by_heap(model, symbols[first[i] : first[i] + n[i]], int(keys[i]), rate), np.int64)
        parts.append((np.array([i]), *model.to_ids(got, np.array([len(got)]))))
    return together(len(units), parts)


class Rising:
    """An array that values are added to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 10, kind), 0

    def __len__(self) -> int:
        return self.n

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(end, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : end], self.n = values, end


class Paths:
    """The merges of units already met, as they go if none is dropped, and the ids at their end.

    An occurrence draws its own hash for each of these merges, and takes the kept ids only where
    none of them is dropped; else it is encoded anew under its key. So what is kept decides
    nothing: every occurrence is cut as ``encode_units`` would. Emptied at ``most`` units; those
    of more than ``WIDE`` symbols are encoded each time.
    """

    def __init__(self, model: MergeModel, rate: float, most: int = 800_000):
        self.model, self.rate, self.most = model, rate, most
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.mark_at, self.marks, self.mark = Rising(np.int64), Rising(np.int32), Rising(np.uint64)
        self.id_at, self.size, self.pool = Rising(np.int64), Rising(np.int32), Rising(np.uint32)

    def _add(self, units: list[bytes]) -> None:
        symbols, n = self.model.symbols(units)
        ids, marks = [], []
        for at, sym in by_width(symbols, n):
            log: list = []
            sym, count = by_rounds(self.model, sym, np.zeros(len(at), np.uint64), 0.0, log)
            ids.append((at, *self.model.to_ids(sym[np.arange(sym.shape[1])[None] < count[:, None]], count)))
            if log:
                rows, place, piece = (np.concatenate(x) for x in zip(*log, strict=True))
                order = np.argsort(rows, kind="stable")
                marks.append((at, candidate(place[order], piece[order]), np.bincount(rows, minlength=len(at))))
        got, size = together(len(units), ids)
        mark, count = together(len(units), marks, np.uint64)
        self.mark_at.add(len(self.mark) + np.cumsum(count) - count)
        self.id_at.add(len(self.pool) + np.cumsum(size) - size)
        self.size.add(np.where(n > WIDE, -1, size))
        for kept, new in ((self.marks, count), (self.mark, mark), (self.pool, got)):
            kept.add(new)

    def ids(self, units: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, each cut under its key, and how many each has."""
        if len(self.number) > self.most:
            self._empty()
        d = pc.dictionary_encode(units)
        words, before = d.dictionary.to_pylist(), len(self.number)
        mine = np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int64, len(words))
        self._add([words[i] for i in np.flatnonzero(mine >= before).tolist()])
        at = mine[d.indices.to_numpy(zero_copy_only=False)]
        size = self.size.data[at].astype(np.int64)
        anew = size < 0
        if self.rate:
            n = self.marks.data[at].astype(np.int64)
            hit = skipped(np.repeat(keys, n), self.mark.data[ranges(self.mark_at.data[at], n)], self.rate)
            anew[np.repeat(np.arange(len(at)), n)[hit]] = True
        kept, anew = np.flatnonzero(~anew), np.flatnonzero(anew)
        got, n = encode_units(self.model, units.take(pa.array(anew)).to_pylist(), keys[anew], self.rate)
        as_kept = self.pool.data[ranges(self.id_at.data[at[kept]], size[kept])]
        return together(len(at), [(kept, as_kept, size[kept]), (anew, got, n)])


def blank_units(model: MergeModel, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts, each behind the blank that the model puts first, cut between characters that no
    piece has side by side (a blank behind another character, most marks behind letters), so that
    no merge could cross; and at which unit each text begins."""
    at, data = flat(column)
    full = np.diff(at) > 0
    data = np.insert(data, at[:-1][full], 32)
    at = at + np.concatenate([[0], np.cumsum(full)])
    edge = np.zeros(len(data), bool)
    if len(data):
        edge[1:] = ~model.joint[data[:-1], data[1:]]
        edge[at[:-1][full]] = True
    starts = np.flatnonzero(edge)
    return binary_array(data, np.append(starts, len(data))), np.searchsorted(starts, at)


class Encoder:
    """Ids of whole columns, each occurrence of a unit cut under a key of its own; with ``variants``
    under one of so many keys."""

    def __init__(self, model: MergeModel, rate: float, seed: int, variants: int | None = None, most: int = 800_000):
        self.variants = variants
        self.seed = mix64(np.array([seed], np.int64).view(np.uint64))[0]
        self.model, self.paths = model, Paths(model, rate, most)

    def __call__(self, names: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and at which id each begins; ``names`` are their doc_ids."""
        units, at = blank_units(self.model, texts)
        per_doc = np.diff(at)
        with np.errstate(over="ignore"):
            own = np.repeat(mix64(names.view(np.uint64) ^ self.seed), per_doc)
            keys = mix64(own + ranges(np.zeros(len(per_doc), np.int64), per_doc).view(np.uint64))
            if self.variants:
                keys = mix64(keys % np.uint64(self.variants) + self.seed)
        parts = [self.paths.ids(units[i : i + CHUNK], keys[i : i + CHUNK]) for i in range(0, len(units), CHUNK)]
        ids, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        return ids, np.concatenate([[0], np.cumsum(n)])[at]


def decode(model: MergeModel, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts (as binary) from their ids: pieces in a row, without the first blank."""
    n = model.piece_size[ids]
    data = model.pool[ranges(model.piece_at[ids], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[at]
    full = np.diff(at) > 0
    data = np.delete(data, ends[:-1][full])
    return binary_array(data, ends - np.concatenate([[0], np.cumsum(full)]))


def encode_dropout(
    docs: DataFrame, model_file: str, rate: float = 0.1, seed: int = 1, arrays: bool = False
) -> DataFrame:
    """Encode whole texts by merges, each candidate merge skipped with probability ``rate``.

    Skipping is decided by a hash keyed by ``seed``, the document's id, the unit's number in it,
    the place in the unit and the piece. So a rerun gives the same ids, while every occurrence of
    a word draws anew. At rate 0 the ids are those of the model itself. Every text is decoded again
    and compared.

    A null or empty text has no ids and decodes to an empty text; a null doc_id draws as 0; rows
    with equal ids are encoded alike. Other columns are not looked at.
    Returns doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit integers), lossless, and the
    ids if ``arrays``.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrays of ids need room themselves, so fewer paths are kept beside them.
        most = 250_000 if arrays else 800_000
        key = ("merges", model_file, rate, seed, most)
        encoder = per_worker(key, lambda: Encoder(MergeModel(model_file), rate, seed, most=most))
        model = encoder.model
        for batch in slices(batches, most=(1 if arrays else 4) << 20):
            names, texts = batch.column("doc_id"), batch.column("text")
            ids, at = encoder(names.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), texts)
            small = ids.astype("<u4")
            crc = [zlib.crc32(small[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            same = pc.equal(decode(model, ids, at), texts.cast(pa.large_binary()).fill_null(b""))
            out = {"doc_id": names, "n_ids": np.diff(at), "ids_crc32": pa.array(crc, pa.int64()), "lossless": same}
            if arrays:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, n_ids long, ids_crc32 long, lossless boolean" + ", ids array<int>" * arrays
    return spread(slim).mapInArrow(encode, ddl)
