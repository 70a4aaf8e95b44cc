"""Token ids as Arrow files of fixed-size lists: equal-length sequences with masks, read in place."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .common import per_worker, slices
from .stores import put, store
from .units import UnitPool, cut_units

SEQUENCE = 1024
BATCH = 256


def unit_pool(tokenizer_file: str, end_id: int, plain: bool) -> tuple[UnitPool, list[str]]:
    """Encoded units, and the texts that must be units; ids take two bytes where all of them fit."""
    encode, vocabulary, literals = unit_encoder(tokenizer_file, plain)
    return UnitPool(encode, np.uint16 if max(vocabulary, end_id + 1) <= 1 << 16 else np.uint32), literals


def unit_encoder(tokenizer_file: str, plain: bool):
    """How to encode units, the number of ids, and the added tokens that a text may hold: none if
    ``plain``, as their strings are ordinary text then."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = plain
    added = tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized and tokenizer.normalizer for t in added):
        raise ValueError("an added token that takes in or depends on the text beside it can't be a unit")
    literals = [t.content for t in added if not (plain and t.special)]
    size = tokenizer.get_vocab_size()

    def encode(units: list[bytes], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    return encode, size, literals


class SequenceWriter:
    """An Arrow file of (ids, mask) rows of equal length, filled as a stream of ids comes in.

    Record batches have ``BATCH`` sequences, uncompressed, so that a reader maps the file and
    finds sequence i of batch i // BATCH at a computed place. The last sequence is filled with 0
    and its mask says where the ids end. The schema's metadata has the number of ids.
    """

    def __init__(self, out: BinaryIO, kind: pa.DataType, length: int):
        self.kind, self.length, self.left = kind, length, np.zeros(0, kind.to_pandas_dtype())
        fields = [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(fields)
        self.file = pa.ipc.new_file(out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.left = np.concatenate([self.left, ids])
        step = self.length * BATCH
        whole = len(self.left) // step * step
        for i in range(0, whole, step):
            self._batch(self.left[i : i + step], step)
        self.left = self.left[whole:]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        real = len(self.left)
        if real:
            pad = np.zeros(-real % self.length, self.left.dtype)
            self._batch(np.concatenate([self.left, pad]), real)
        self.file.close()


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 2, length: int = SEQUENCE, plain: bool = True
) -> DataFrame:
    """Encode all texts in ascending order of doc_id and write them as Arrow files in ``folder``.

    Each range of ids is a task of its own and makes a pair of files: ``.ids.arrow`` with the
    sequences, ``.docs.arrow`` with each document's id, place and length in them. Ids that fit
    take two bytes, else four. Null texts are empty and have the end id alone; null doc_ids come
    first; rows of equal doc_id keep together in no given order. The strings of special tokens in
    a text are ordinary text if ``plain``, else they are those tokens, as the tokenizer is loaded.
    Returns part, path, tokens.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("units", tokenizer_file, end_id, plain)
        pool, literals = per_worker(key, lambda: unit_pool(tokenizer_file, end_id, plain))
        kind, part = pa.from_numpy_dtype(pool.kind), TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}"
        docs, counts = [], []
        total = 0

        def ids(out: BinaryIO) -> None:
            nonlocal total
            writer = SequenceWriter(out, kind, length)
            for batch in slices(batches, most=16 << 20):
                units, at = cut_units(batch.column("text"), literals)
                got, n = pool.ids(units)
                ends = np.concatenate([[0], np.cumsum(n)])[at]
                docs.append(batch.column("doc_id"))
                counts.append(np.diff(ends) + 1)
                total += int(counts[-1].sum())
                writer.add(np.insert(got, ends[1:], end_id))
            writer.close()

        put(f"{path}.ids.arrow", ids)
        if not docs:
            return
        n = np.concatenate(counts)
        index = pa.table({"doc_id": pa.chunked_array(docs), "start": np.cumsum(n) - n, "n_tokens": n})

        def places(out: BinaryIO) -> None:
            with pa.ipc.new_file(out, index.schema) as f:
                f.write_table(index, max_chunksize=1 << 16)

        put(f"{path}.docs.arrow", places)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "tokens": [total]})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ranged = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return cut(ranged.mapInArrow(write, "part long, path string, tokens long"), "token-files")


class Sequences:
    """Random access to a file of sequences by number, without reading or copying the others."""

    def __init__(self, uri: str):
        system, path = store(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at = (-1, None)

    def batch(self, i: int) -> pa.RecordBatch:
        if self._at[0] != i:
            self._at = (i, self.file.get_batch(i))
        return self._at[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        row = self.batch(i // BATCH).slice(i % BATCH, 1)
        return row.column("ids").flatten().to_numpy(), row.column("mask").flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """A run of ids by its place among all ids of the file; it may cross sequences."""
        step, parts = self.length * BATCH, []
        while n:
            b, i = divmod(start, step)
            flat_ids = self.batch(b).column("ids").flatten()
            part = flat_ids.slice(i, n).to_numpy()
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start among all ids, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(batch.column(c).to_pylist() for c in ("path", "before")), strict=True):
                tokens = Sequences(f"{path}.ids.arrow")
                system, name = store(f"{path}.docs.arrow")
                with pa.ipc.open_file(system.open_input_file(name)) as index:
                    for i in range(index.num_record_batches):
                        rows = index.get_batch(i)
                        start, n = (rows.column(c).to_numpy() for c in ("start", "n_tokens"))
                        crc = [zlib.crc32(tokens.ids(int(a), int(b)).astype("<u4")) for a, b in zip(start, n, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("doc_id"), pa.array(start + before), pa.array(n), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    placed = placed.repartition(max(1, files.count()))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_file: str, **how) -> DataFrame:
    """Write all texts as token files and read every document back from them."""
    return read_tokens(write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_file, **how))
