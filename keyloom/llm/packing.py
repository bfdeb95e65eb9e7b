"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import worker_bpe
from .shared import numbered, sub_batches


class BestFit:
    """Places lengths as they come into bins of ``capacity``; at most ``max_open`` bins are open.

    Bit f of ``free`` is set while an open bin has f places left. A length goes to the fullest bin that has room;
    where none has and ``max_open`` bins are open, the fullest one closes for the new one.
    """

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free, self.open, self.bins = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        bin_ = stack.pop()
        if not stack:
            self.free ^= 1 << space
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for 0 < length <= capacity."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, self.bins
            self.bins += 1
            if self.open >= self.max_open and length < self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - length
        if left:
            self.stacks[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.capacity - space


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's ids with the end id, cut where longer than ``capacity``; then the first piece takes what is left over."""

    def cut(batches):
        bpe = worker_bpe(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for rows, texts in sub_batches(batch, "text", 1_000_000):
                out: list[tuple] = []
                for i, x in zip(rows, bpe.encode(texts)):
                    ids = np.append(np.frombuffer(x, bpe.dtype).astype("<u4"), np.array([end_id], "<u4"))
                    doc_id, at, k = doc_ids[i].as_py(), 0, 0
                    while at < len(ids):
                        to = at + (len(ids) - at) % capacity if (len(ids) - at) % capacity else at + capacity
                        out.append((doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int, max_open: int = 1 << 16, block: int = 1 << 18) -> DataFrame:
    """Adds sequence_id and offset to rows with a length in 1..capacity.

    ``cut`` is a ``numbered`` table: rows are dealt by a hash of their numbers, so that equal rows part as well, into blocks of
    about ``block`` rows, each packed by one task, longest first within it. Every row is placed.
    """
    count = cut.count()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        from pyspark import TaskContext

        fit, base = BestFit(capacity, max_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(x) for x in batch.column("length").to_pylist()]
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], schema=schema)

    dealt = cut.repartition(max(1, -(-count // block)), F.xxhash64("r"))
    dealt = dealt.sortWithinPartitions(F.desc("length"), "r").drop("r")
    return dealt.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Documents (doc_id, text) cut and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; null and repeated doc_ids and repeated rows are packed like others, each by itself;
    other columns are ignored. Texts of any length are encoded whole and then cut. Pieces of one length come in the order in
    which the table of pieces was written. No rows give none. The small table of pieces is written before packing, so a lost
    executor doesn't cause texts to be encoded again.
    """
    return pack(numbered(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
