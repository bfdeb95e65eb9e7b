"""Token-id files: one concatenated id array, Elias-Fano coded document boundaries, select structures over them."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.succinct import prefix_sum
from .bpe import worker_bpe
from .shared import as_table, filesystem, shared_dir, sub_batches

MAGIC = b"KLIDS001"
SAMPLE = 256
_HEAD = struct.Struct("<8sBxxxxxxxqqqq")  # magic, id bytes, documents, of these with a null doc_id, ids, least doc_id
_LIST = struct.Struct("<qqqq")  # values, low width, low bytes, high bytes


class EliasFano:
    """A non-decreasing list of non-negative integers: low bits packed, high bits in unary.

    ``select(i)`` reads a sample (every 256th one bit) and then counts ones in bytes; no list of 64-bit values is kept.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        # one 32-bit byte position and one 8-bit count for each 256 values, found in stretches of the bits
        places, skips, seen = [], [], 0
        for i in range(0, len(self.high), 1 << 15):
            counts = np.bitwise_count(self.high[i : i + (1 << 15)])
            ends = np.cumsum(counts, dtype=np.int32)
            wanted = np.arange(-(-seen // SAMPLE) * SAMPLE, min(n, seen + int(ends[-1])), SAMPLE) - seen
            at = np.searchsorted(ends, wanted, side="right")
            places.append((at + i).astype(np.uint32))
            skips.append((wanted - (ends[at] - counts[at])).astype(np.uint8))
            seen += int(ends[-1])
        self.sample_byte = np.concatenate([np.zeros(0, np.uint32), *places])
        self.sample_skip = np.concatenate([np.zeros(0, np.uint8), *skips])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (int(values[-1]) // n).bit_length() - 1) if n and int(values[-1]) >= n else 0
        if width:
            bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        else:
            low = b""
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, width, low, high.tobytes())

    def _lows(self, i: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        first = i * self.width
        bits = np.unpackbits(self.low[first >> 3 : ((i + count) * self.width + 7) >> 3], bitorder="little")[first & 7 :]
        return bits[: count * self.width].reshape(count, self.width) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def select(self, i: int) -> int:
        """Value i, 0 <= i < n."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample_byte[i // SAMPLE]), i % SAMPLE + int(self.sample_skip[i // SAMPLE])
        while True:
            counts = np.bitwise_count(self.high[at : at + 64]).cumsum(dtype=np.int64)
            if counts[-1] > left:
                break
            left -= int(counts[-1])
            at += 64
        k = int(np.searchsorted(counts, left, side="right"))
        left -= int(counts[k - 1]) if k else 0
        one = 8 * (at + k) + int(np.flatnonzero(np.unpackbits(self.high[at + k : at + k + 1], bitorder="little"))[left])
        return ((one - i) << self.width) | int(self._lows(i, 1)[0])

    def block(self, i: int, count: int) -> np.ndarray:
        """Values i to i + count, of which the first one is selected and the rest follows in the bits."""
        count = min(count, self.n - i)
        at, skip = int(self.sample_byte[i // SAMPLE]), i % SAMPLE + int(self.sample_skip[i // SAMPLE])
        ones, end = [], at
        held = 0
        while held < skip + count:
            part = np.flatnonzero(np.unpackbits(self.high[end : end + 4096], bitorder="little")) + 8 * end
            ones.append(part)
            held += len(part)
            end += 4096
        high = np.concatenate(ones)[skip : skip + count] - np.arange(i, i + count)
        return (high << self.width) | self._lows(i, count)

    def to_bytes(self) -> bytes:
        return _LIST.pack(self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, width, low, high = _LIST.unpack_from(data, at)
        at += _LIST.size
        return cls(n, width, data[at : at + low], data[at + low : at + low + high]), at + low + high


def file_parts(doc_ids: list, lengths: list[int], ids: list[bytes], id_bytes: int) -> list[bytes]:
    """A file's bytes, in parts. doc_ids ascend, nulls first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(lengths, np.int64))
    return [
        _HEAD.pack(MAGIC, id_bytes, len(doc_ids), nulls, int(ends[-1]) if len(ends) else 0, least),
        EliasFano.of(np.concatenate([[0], ends])).to_bytes(),
        EliasFano.of(known.view(np.uint64) - np.uint64(least & (2**64 - 1))).to_bytes(),
        *ids,
    ]


class IdFile:
    """A file opened for reading: boundaries and doc_ids stay coded, ids are read by range."""

    def __init__(self, stream, size: int):
        self.stream = stream
        head = stream.read_at(min(size, 1 << 16), 0)
        magic, self.id_bytes, self.n, self.nulls, self.n_ids, self.least = _HEAD.unpack_from(head)
        if magic != MAGIC:
            raise ValueError("not an id file")
        self.ids_at = size - self.n_ids * self.id_bytes
        head = head if len(head) >= self.ids_at else stream.read_at(self.ids_at, 0)
        self.bounds, at = EliasFano.read(head, _HEAD.size)
        self.doc_ids, _ = EliasFano.read(head, at)
        self.dtype = np.dtype(f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        """Ids of document i."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self.stream.read_at((b - a) * self.id_bytes, self.ids_at + a * self.id_bytes), self.dtype)

    def documents(self, count: int = 1024):
        """(doc_id, start, ids) of every document in order, a block of boundaries at a time."""
        for i in range(0, self.n, count):
            bounds = self.bounds.block(i, min(count, self.n - i) + 1)
            known = max(0, i + len(bounds) - 1 - max(i, self.nulls))
            keys = [None] * (len(bounds) - 1 - known)
            if known:
                raw = self.doc_ids.block(max(i, self.nulls) - self.nulls, known).view(np.uint64) + np.uint64(self.least & (2**64 - 1))
                keys += raw.view(np.int64).tolist()
            a = int(bounds[0])
            ids = np.frombuffer(self.stream.read_at((int(bounds[-1]) - a) * self.id_bytes, self.ids_at + a * self.id_bytes), self.dtype)
            for k, x, y in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
                yield k, x, ids[x - a : y - a]


def write_id_files(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = 4_000_000) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes id files in ascending doc_id order; returns their manifest.

    Rows are dealt by ranges of (doc_id, hash of text), so neither many rows of one doc_id nor the order of the input
    loads one task. Null texts count as empty and null doc_ids come first; rows of one doc_id are ordered by text.
    Texts of any length are encoded whole; other columns are ignored; no rows give an empty manifest.
    Each attempt of a task writes files of its own, and only those that the manifest lists count.
    Manifest: part, file, path, size, documents, ids, start (ids before the file).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "ids")

    def write(batches):
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        bpe = worker_bpe(tokenizer)
        end = np.array([end_id], bpe.dtype).tobytes()
        part, n_files, keys, lengths, ids, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            name = f"{part:06d}-{n_files:05d}-{uuid.uuid4().hex}.ids"
            fs.create_dir(path, recursive=True)
            parts = file_parts(keys, lengths, ids, bpe.dtype.itemsize)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                for x in parts:
                    out.write(x)
            return pa.RecordBatch.from_pydict({"part": [part], "file": [n_files], "path": [f"{folder}/{name}"], "size": [sum(map(len, parts))], "documents": [len(keys)], "ids": [held]}, schema=_MANIFEST)

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for rows, texts in sub_batches(batch, "text", 1_000_000):
                for i, x in zip(rows, bpe.encode(texts)):
                    n = len(x) // bpe.dtype.itemsize + 1
                    if keys and held + n > shard_ids:
                        yield flush()
                        n_files, keys, lengths, ids, held = n_files + 1, [], [], [], 0
                    keys.append(doc_ids[i].as_py())
                    lengths.append(n)
                    ids += x, end
                    held += n
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("by", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "by").sortWithinPartitions("doc_id", "by", "text").select("doc_id", "text")
    manifest = as_table(rows.mapInArrow(write, "part long, file long, path string, size long, documents long, ids long"), "manifest")
    return prefix_sum(manifest.withColumn("__at", F.col("part") * (1 << 20) + F.col("file")), "__at", "ids", "start").withColumn("start", F.col("start").cast("long")).drop("__at")


_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])


def read_id_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as stream:
                    out: list[tuple] = []
                    for doc_id, start, ids in IdFile(stream, row["size"]).documents():
                        out.append((doc_id, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 8192:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    files = manifest.select("path", "size", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), F.col("path"))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "n_tokens", "ids_crc32"])
