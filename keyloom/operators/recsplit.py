"""Minimal perfect hash functions by recursive splitting: built in parallel by bucket, kept as a table, evaluated by a join."""

from __future__ import annotations

import functools
import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.codes import BitBuffer, pack_rice, unpack_rice
from ..functions.succinct import EliasFanoList, MultiStageList, monotone_list, prefix_sum
from ..plans.planner import p_places, parts_of, rice_parameter, rules_of, split_rules
from ..plans.tables import as_table, part_files, shared_dir, write_parts

U = np.uint64
UNIVERSAL_SHIFT = 18  # a new universal hash after 2**18 supplemental ones
CHUNK = 1 << 16
PART_SHIFT = 12  # buckets of one file of a function: 4,096
FEW_PARTS = 48  # functions of at most as many files are evaluated where the rows are


@dataclass(frozen=True)
class Options:
    """What a function is built with, and must be evaluated with.

    mode "fast": keys are well-mixed 64-bit values; the bucket is their top bits, sets are halved by one bit of a cheaper
    hash, and buckets of over 64 keys are refused.

    ``slots`` above 1 gives leaves more places than keys, so that the function has gaps, fewer bits and a shorter build;
    ``keys_each`` lets as many keys share a place of a leaf, for k-perfect functions.
    """

    kind: str = "long"  # long, string, or text: strings under another hash
    leaf_size: int = 8
    average_bucket_size: int = 100
    mode: str = "recsplit"
    overflow: int = 8
    split_mode: str = "optimised"  # or "legacy": the older rule of fan-outs
    lists: str = "elias_fano"  # or "multi_stage": the lists of the one-string form
    slots: float = 1.0  # places of a leaf for each key
    keys_each: int = 1  # keys that may share a place

    def __post_init__(self):
        if not 2 <= self.leaf_size <= 18:
            raise ValueError("leaf_size must be in 2..18")
        if not 4 <= self.average_bucket_size <= 65536:
            raise ValueError("average_bucket_size must be in 4..65536")
        if self.mode not in ("recsplit", "fast") or self.split_mode not in ("optimised", "legacy") or self.lists not in ("elias_fano", "multi_stage"):
            raise ValueError("unknown mode")
        if not 1 <= self.slots <= 2 or self.keys_each < 1:
            raise ValueError("slots must be in 1..2, keys_each at least 1")

    @property
    def minimal(self) -> bool:
        return self.slots == 1 and self.keys_each == 1

    def max_size(self) -> int:
        return 64 if self.mode == "fast" else max(self.overflow * self.average_bucket_size, self.leaf_size)

    def buckets(self, n: int) -> int:
        count = -(-n // self.average_bucket_size)
        return 1 << max(0, (count - 1).bit_length()) if self.mode == "fast" else max(1, count)

    def rules(self):
        """(split, rice k, nodes) for each size."""
        split, k, nodes = self._rules()
        if not self.minimal:
            k = k.copy()
            for n in range(2, min(self.leaf_size, len(k) - 1) + 1):
                k[n] = rice_parameter(p_places(n, self.leaf_places(n), self.keys_each))
        return split, k, nodes

    def leaf_places(self, n: int) -> int:
        return -(-int(n * self.slots) // self.keys_each)

    @functools.cache
    def places(self) -> np.ndarray:
        """How many places sets of each size take."""
        split, _, _ = self._rules()
        out = np.arange(len(split))
        if not self.minimal:
            for n in range(1, len(out)):
                out[n] = self.leaf_places(n) if n <= self.leaf_size else sum(out[m] for m in parts_of(n, int(split[n])))
        return out

    def _rules(self):
        if self.mode == "fast":
            n = np.arange(self.max_size() + 1)
            split, (_, k) = np.where(n <= self.leaf_size, n, -(n // 2)), split_rules(self.leaf_size, self.max_size())
            nodes = np.zeros(len(n), np.int64)
            for m in range(2, len(n)):
                nodes[m] = 1 if m <= self.leaf_size else 1 + nodes[m // 2] + nodes[m - m // 2]
            return split, k, nodes
        return rules_of(self.leaf_size, self.max_size(), self.split_mode)

    def low32(self, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
        if self.mode == "fast":
            x = hashes + index * U(H.M1)
            x = (x ^ (x >> U(32))) * U(H.M1)
            return (x ^ (x >> U(32))) & U(0xFFFFFFFF)
        return H.np_supplemental(hashes, index)


@dataclass
class Model:
    """A function: one row for each bucket (bucket, n, nodes, bit_len, alt, offset), its options and the number of keys.

    The table's files, of 4,096 buckets each, lie in ``path``. Keys of buckets that overflow are in ``fallback``, whose
    indexes follow the others.
    """

    table: DataFrame
    path: str
    options: Options
    n: int
    buckets: int
    fallback: object = None
    fallback_offset: int = 0

    @classmethod
    def of(cls, table: DataFrame, options: Options, n: int, buckets: int, path: str | None = None) -> Model:
        """From rows (bucket, n, nodes, bit_len, alt, offset)."""
        path = path or shared_dir(table.sparkSession, "model")
        stored = write_parts(table.withColumn("part", F.shiftright("bucket", PART_SHIFT)), "part", path)
        return cls(stored, path, options, n, buckets)

    def save(self, path: str) -> None:
        """Buckets, what overflowed, and the options, below ``path``."""
        from .other import save_sharded

        meta = {"options": asdict(self.options), "n": self.n, "buckets": self.buckets, "fallback_offset": self.fallback_offset, "hash": "siphash-2-4" if self.options.kind != "long" else "long-block-4"}
        if self.fallback is not None:
            meta["fallback"] = save_sharded(self.fallback, f"{path}/fallback")
        write_parts(self.table.withColumn("part", F.shiftright("bucket", PART_SHIFT)), "part", f"{path}/buckets")
        self.table.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str, expected: Options | None = None) -> Model:
        """Options that differ from the expected ones are an error, as evaluating would give arbitrary numbers."""
        from .other import load_sharded

        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        options = Options(**meta["options"])
        if expected is not None and expected != options:
            raise ValueError(f"built with {options}, asked for {expected}")
        fallback = load_sharded(spark, f"{path}/fallback", meta["fallback"]) if "fallback" in meta else None
        buckets = f"{path}/buckets" if "://" in path or path.startswith("file:") else f"file://{path}/buckets"
        return cls(spark.read.schema(_STORED).parquet(buckets).drop("part"), buckets, options, meta["n"], meta["buckets"], fallback, meta["fallback_offset"])

    def space(self) -> DataFrame:
        """n, bits of the trees, bits of the two Elias-Fano lists of ``to_bytes`` (keys and bits before each bucket, less their smallest steps), and bits a key."""
        rows = self.table.where("not alt")
        tree = F.coalesce(F.sum("bit_len"), F.lit(0))

        def entries(column):
            """Low parts and upper bits of a list that ends at the sum less as many smallest steps."""
            step = F.when(F.count("*") < self.buckets, F.lit(0)).otherwise(F.min(column))
            last, n = F.coalesce(F.sum(column) - self.buckets * step, F.lit(0)), F.lit(self.buckets + 1)
            width = F.when(last >= n, F.floor(F.log2(F.floor(last / n).cast("double"))) + 1).otherwise(0)
            return n * width + n + F.floor(last / F.pow(F.lit(2.0), width))

        out = rows.agg(F.lit(self.n).cast("long").alias("n"), tree.cast("long").alias("tree_bits"), (entries("n") + entries("bit_len")).cast("long").alias("list_bits"))
        return out.withColumn("bits_per_key", (F.col("tree_bits") + F.col("list_bits")) / F.greatest(F.col("n"), F.lit(1)))

    def nodes(self) -> DataFrame:
        """Every node of every bucket in pre-order: bucket, pos, depth, size, gap, rice_k."""
        options = self.options

        def walk(batches):
            split, k, _ = options.rules()
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    stack, pos = [(r["n"], 0)], 0
                    while stack:
                        size, depth = stack.pop()
                        if size < 2:
                            continue
                        out.append((r["bucket"], pos, depth, size, r["nodes"][pos], int(k[size])))
                        pos += 1
                        if size > options.leaf_size:
                            stack += [(m, depth + 1) for m in reversed(parts_of(size, int(split[size])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, ["bucket", "pos", "depth", "size", "gap", "rice_k"])

        rows = self.table.where("not alt").select("bucket", "n", "nodes")
        return rows.mapInArrow(walk, "bucket long, pos long, depth long, size long, gap long, rice_k long")

    def to_bytes(self, most_buckets: int = 1_000_000) -> bytes:
        """One string; for functions of a bounded number of buckets.

        In Elias-delta codes: n + 1, the buckets, and the smallest steps + 1 of the two lists; a bit for overflown keys.
        Then, each with its length before it: the lists of keys and of bits before each bucket, less their smallest
        steps, the trees, and the second function.
        """
        from .other import sharded_bytes

        if self.buckets > most_buckets:
            raise ValueError("too many buckets for one string")
        split, k, _ = self.options.rules()
        rows = sorted(self.table.where("not alt").select("bucket", "n", "nodes").collect(), key=lambda r: r.bucket)  # bounded by most_buckets
        sizes = np.zeros(self.buckets, np.int64)
        bits = np.zeros(self.buckets, np.int64)
        gaps, ks = [], []
        for r in rows:
            own = np.array([k[m] for m in preorder_sizes(r.n, self.options.leaf_size, split)], np.int64)
            gap = np.array(r.nodes, np.int64)
            sizes[r.bucket], bits[r.bucket] = r.n, int((gap >> own).sum() + (own + 1).sum())
            gaps.append(gap), ks.append(own)
        trees, _ = pack_rice(np.concatenate([np.zeros(0, np.int64), *gaps]), np.concatenate([np.zeros(0, np.int64), *ks]))
        out = BitBuffer()
        out.write_elias_delta(self.n + 1)
        out.write_elias_delta(self.buckets)
        out.write_bit(self.fallback is not None)
        steps = [int(x.min(initial=0) if not len(x) else x.min()) for x in (sizes, bits)]
        for step in steps:
            out.write_elias_delta(step + 1)
        parts = [monotone_list(np.concatenate([[0], np.cumsum(x - step)]), self.options.lists == "elias_fano").to_bytes() for x, step in zip((sizes, bits), steps)]
        parts += [trees] + ([sharded_bytes(self.fallback)] if self.fallback is not None else [])
        return out.to_bytes() + b"".join(len(x).to_bytes(8, "big") + x for x in parts)

    @classmethod
    def from_bytes(cls, spark, data: bytes, options: Options) -> Model:
        from .other import sharded_from_bytes

        header, lists, trees, fallback = read_string(data, options)
        split, k, _ = options.rules()
        before, starts = lists
        sizes = np.diff(before)
        at = np.flatnonzero(sizes)
        offsets = np.concatenate([[0], np.cumsum(options.places()[sizes])])
        preorder = [preorder_sizes(int(m), options.leaf_size, split) for m in sizes[at]]
        found = unpack_rice(trees, [np.array([k[m] for m in own], np.int64) for own in preorder], starts[at])
        rows = [(int(b), int(sizes[b]), gaps.tolist(), int(starts[b + 1] - starts[b]), False, int(offsets[b])) for b, gaps in zip(at, found)]
        if fallback is not None:
            # buckets without keys in the trees overflowed, or have none: the second function is asked
            rows += [(int(b), 0, None, 0, True, int(offsets[b])) for b in np.flatnonzero(sizes == 0)]
        model = cls.of(spark.createDataFrame(rows, _STORED), options, header["n"], header["buckets"])
        if fallback is not None:
            model.fallback, model.fallback_offset = sharded_from_bytes(spark, fallback), int(offsets[-1])
        return model


def read_string(data: bytes, options: Options):
    """The header's fields, the two lists, the trees' bits and the second function's bytes (or None) of the one-string form."""
    buffer = BitBuffer(data)
    header = {"n": buffer.read_elias_delta() - 1, "buckets": buffer.read_elias_delta(), "fallback": bool(buffer.read_bit()), "key_step": buffer.read_elias_delta() - 1, "bit_step": buffer.read_elias_delta() - 1}
    at, parts = -(-buffer.pos // 8), []
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "big")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    kind = EliasFanoList if options.lists == "elias_fano" else MultiStageList
    steps = np.arange(header["buckets"] + 1)
    lists = [kind.from_bytes(x).all() + steps * step for x, step in zip(parts, (header["key_step"], header["bit_step"]))]
    return header, lists, parts[2], parts[3] if header["fallback"] else None


def describe_bytes(data: bytes, options: Options) -> dict:
    """The one-string form's header and what its parts take: for looking at."""
    header, lists, trees, fallback = read_string(data, options)
    return header | {"keys_in_trees": int(lists[0][-1]), "tree_bits": int(lists[1][-1]), "bytes": len(data), "tree_bytes": len(trees), "fallback_bytes": len(fallback or b"")}


_MODEL = "bucket long, n int, nodes array<long>, bit_len long, alt boolean"
_STORED = _MODEL + ", offset long"


def preorder_sizes(size: int, leaf_size: int, split) -> list[int]:
    out, stack = [], [size]
    while stack:
        m = stack.pop()
        if m > 1:
            out.append(m)
            if m > leaf_size:
                stack += reversed(parts_of(m, int(split[m])))
    return out


def hashed(keys: DataFrame, key: str, kind: str) -> DataFrame:
    """key and h, its universal hash number 0. Null keys are an error."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            if column.null_count:
                raise ValueError("a key is null")
            yield pa.RecordBatch.from_arrays([column, pa.array(H.key_hashes(column, 0, kind).view(np.int64))], ["key", "h"])

    column = F.col(key).cast("long" if kind == "long" else "string").alias("key")
    return keys.select(column).mapInArrow(run, f"key {'long' if kind == 'long' else 'string'}, h long")


def with_bucket(rows: DataFrame, options: Options, buckets: int) -> DataFrame:
    if options.mode == "fast":
        bits = buckets.bit_length() - 1
        return rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    return rows.withColumn("bucket", H.reduce_range(F.col("h"), buckets))


class Search:
    """Finds the indexes of all nodes of many buckets at once: nodes of one size together, largest first."""

    def __init__(self, options: Options, keys, hashes: np.ndarray):
        self.o, self.keys, self.hashes = options, keys, hashes
        self.split, self.k, self.node_count = options.rules()
        self.places = options.places()

    def run(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys starts[i] to starts[i] + sizes[i] are bucket i. Gives all gaps, where each bucket's begin, and its bits."""
        base = np.concatenate([[0], np.cumsum(self.node_count[sizes])])
        gaps, bits = np.zeros(base[-1], np.int64), np.zeros(len(sizes), np.int64)
        work: dict[int, list] = {}
        for n in np.unique(sizes[sizes > 1]).tolist():
            at = np.flatnonzero(sizes == n)
            work[n] = [(starts[at][:, None] + np.arange(n), np.full(len(at), -1), at, base[at])]
        for n in range(int(sizes.max(initial=0)), 1, -1):
            if n not in work:
                continue
            rows, parent, bucket, pos = map(np.concatenate, zip(*work.pop(n)))
            index, slots = self._find(rows, parent + 1, n)
            gap = index - parent - 1
            gaps[pos] = gap
            np.add.at(bits, bucket, (gap >> int(self.k[n])) + 1 + int(self.k[n]))
            if n <= self.o.leaf_size:
                continue
            rows = np.take_along_axis(rows, np.argsort(slots, axis=1, kind="stable"), axis=1)
            at, pos = 0, pos + 1
            for m in parts_of(n, int(self.split[n])):
                if m > 1:
                    work.setdefault(m, []).append((rows[:, at : at + m], index, bucket, pos))
                at, pos = at + m, pos + self.node_count[m]
        return gaps, base, bits

    def slots(self, hashes: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        """The part, or the place in a leaf, of each key."""
        low = self.o.low32(hashes, index)
        s = int(self.split[n])
        if n <= self.o.leaf_size or s > 0:
            return H.np_reduce(low, int(self.places[n]) if n <= self.o.leaf_size else s)
        if self.o.mode == "fast":
            return H.np_reduce(low, 2)
        return (H.np_reduce(low, n) >= U(-s)).astype(U)

    def _good(self, slots: np.ndarray, n: int) -> np.ndarray:
        s = int(self.split[n])
        if n <= self.o.leaf_size and not self.o.minimal:
            return np.all([(slots == j).sum(axis=-1) <= self.o.keys_each for j in range(int(self.places[n]))], axis=0)
        if n <= self.o.leaf_size:
            return np.bitwise_or.reduce(U(1) << slots, axis=-1) == U((1 << n) - 1)
        if s < 0:
            return slots.sum(axis=-1) == n + s
        return np.all([(slots == j).sum(axis=-1) == n // s for j in range(s - 1)], axis=0)

    def _find(self, rows: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        index, current = start.astype(np.int64), start.astype(np.int64)
        hashes, level = self.hashes[rows], np.zeros(len(rows), np.int64)
        if n <= self.o.leaf_size and self.o.mode != "fast" and self.o.keys_each == 1:
            # equal hashes never part: on to the next universal hash at once
            tied = (np.diff(np.sort(hashes, axis=1), axis=1) == 0).any(axis=1)
            current[tied] = (current[tied] >> UNIVERSAL_SHIFT) + 1 << UNIVERSAL_SHIFT
        todo = np.arange(len(rows))
        while len(todo):
            now = current[todo]
            for i in np.flatnonzero(now >> UNIVERSAL_SHIFT != level[todo]):
                level[todo[i]] = now[i] >> UNIVERSAL_SHIFT
                if self.o.mode == "fast":
                    raise ValueError("keys of the fast mode repeat")
                hashes[todo[i]] = self._rehash(rows[todo[i]], int(level[todo[i]]))
            room = (1 << UNIVERSAL_SHIFT) - int((now & (1 << UNIVERSAL_SHIFT) - 1).max())
            tries = min(max(1, (1 << 16) // (len(todo) * n)), room)
            tried = (now[:, None] + np.arange(tries)).astype(U)
            good = self._good(self.slots(hashes[todo][:, None, :], tried[:, :, None], n), n)
            hit = good.any(axis=1)
            index[todo[hit]] = now[hit] + good[hit].argmax(axis=1)
            current[todo] += tried.shape[1]
            todo = todo[~hit]
        return index, self.slots(hashes, index.astype(U)[:, None], n)

    def _rehash(self, rows: np.ndarray, universal: int) -> np.ndarray:
        return H.key_hashes(self.keys.take(pa.array(rows)), universal, self.o.kind)


def dealt_to_search(rows: DataFrame, n: int, partitions: int | None = None) -> DataFrame:
    """Rows by bucket, in the session's number of tasks, or one for each 4,096 of ``n`` keys if those are fewer.

    The number is given, as partitions of few bytes would be put together at run time, though a search takes long.
    """
    return rows.repartition(partitions or max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096))), "bucket")


def build(keys: DataFrame, key: str, options: Options | None = None, partitions: int | None = None) -> Model:
    """A function from the distinct keys of a column to 0..n-1.

    One shuffle by bucket; equal keys meet in it, and any that repeat are an error. The result is the same however the
    input is partitioned. Buckets that overflow go to a second construction whose indexes follow. ``partitions`` sets the
    number of tasks that search, instead of the session's; sets that don't fit in memory spill in the shuffle.
    """
    options = options or Options("string" if dict(keys.dtypes)[key] == "string" else "long")
    n = keys.count()
    buckets = options.buckets(n)
    rows = with_bucket(hashed(keys, key, options.kind), options, buckets)
    if options.mode == "fast":
        rows = with_bucket(keys.select(F.col(key).cast("long").alias("key"), F.col(key).cast("long").alias("h")), options, buckets)
    limit = options.max_size()

    def run(batches):
        for chunk in whole_buckets(batches):
            bucket = chunk.column("bucket").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
            column = chunk.column("key")
            if column.null_count:
                raise ValueError("a key is null")
            values = column.to_numpy(zero_copy_only=False)
            if len(values) > 1 and (values[1:] == values[:-1]).any():
                raise ValueError("keys repeat")
            over = sizes > limit
            if options.mode == "fast" and over.any():
                raise ValueError("a bucket has over 64 keys: mix the keys first")
            gaps, base, bits = Search(options, column, chunk.column("h").to_numpy().view(U)).run(starts[~over], sizes[~over])
            lists = iter([gaps[a:b].tolist() for a, b in zip(base, base[1:])])
            bit = iter(bits.tolist())
            out = [(int(b), int(s), None if o else next(lists), 0 if o else next(bit), bool(o)) for b, s, o in zip(bucket[starts], sizes, over)]
            too_long = 64 * options.average_bucket_size * max(1, options.overflow // 8)
            out = [r if options.mode == "fast" or r[3] <= too_long else (r[0], r[1], None, 0, True) for r in out]
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["bucket", "n", "nodes", "bit_len", "alt"])

    dealt = dealt_to_search(rows, n, partitions).sortWithinPartitions("bucket", "h", "key")
    table = as_table(dealt.mapInArrow(run, _MODEL), "buckets")
    own = F.col("n") if options.minimal else F.get(F.lit(options.places().tolist()), F.col("n"))
    table = table.withColumn("own", F.when(F.col("alt"), 0).otherwise(own).cast("long"))
    placed = prefix_sum(table, "bucket", "own", "offset").drop("own")
    model = Model.of(placed.select("bucket", "n", "nodes", "bit_len", "alt", F.col("offset").cast("long")), options, n, buckets)
    over = model.table.where("alt")
    if options.mode != "fast" and not over.isEmpty():
        from .other import build_bdz

        left = as_table(rows.join(over.select("bucket"), "bucket", "left_semi").select("key"), "overflow")
        model.fallback = build_bdz(left, "key", options.kind)
        model.fallback_offset = table.agg(F.sum("own")).first()[0]
    return model


@dataclass
class BlockStore:
    """A fast function of a very large set, stored by blocks of its keys' top bits: ``path`` has a folder for each block, and a header.

    The header has a row for each block (block, n, tree_bits) and one without a block for all of them.
    """

    model: Model
    path: str
    blocks: int

    def header(self) -> DataFrame:
        return self.model.table.sparkSession.read.parquet(f"{self.path}/header")

    def block(self, number: int) -> Model:
        """The function of one block, from its files alone: it gives its keys the same indexes, and needs no other block."""
        spark, o = self.model.table.sparkSession, self.model
        rows = spark.read.schema(_STORED).parquet(f"{self.path}/blocks/block={number}")
        return Model.of(rows, o.options, o.n, o.buckets)


def build_blocks(keys: DataFrame, key: str, per_block: int = 2_000_000, options: Options | None = None) -> BlockStore:
    """Well-mixed 64-bit keys in blocks by their top bits, of about ``per_block`` keys: every block's buckets are searched and stored by themselves.

    A bucket lies in one block, as both are top bits; so tasks hold a bucket at a time, whatever a block's size, and the
    prefix sums over blocks and buckets are one.
    """
    options = options or Options(mode="fast", leaf_size=5, average_bucket_size=16)
    if options.mode != "fast":
        raise ValueError("blocks are built in the fast mode")
    model = build(keys, key, options)
    bucket_bits = model.buckets.bit_length() - 1
    bits = min(bucket_bits, max(0, (-(-model.n // per_block) - 1).bit_length()))
    path = shared_dir(keys.sparkSession, "blocks")
    rows = model.table.withColumn("block", F.shiftright("bucket", bucket_bits - bits))
    rows.repartition("block").sortWithinPartitions("block", "bucket").write.option("compression", "zstd").partitionBy("block").parquet(f"{path}/blocks")
    rows.rollup("block").agg(F.sum("n").alias("n"), F.sum("bit_len").alias("tree_bits")).coalesce(1).write.parquet(f"{path}/header")
    return BlockStore(model, path, 1 << bits)


SIMPLE = Options("string", leaf_size=8, average_bucket_size=100)
"""The plain variant for strings: buckets of 100 keys, leaves of 8, descriptions as arrays."""


def description(model: Model) -> DataFrame:
    """The uncompressed form: bucket, keys before it, nodes before it, and its nodes' indexes in pre-order."""
    rows = prefix_sum(model.table.withColumn("__nodes", F.coalesce(F.size("nodes"), F.lit(0)).cast("long")), "bucket", "__nodes", "first_node")
    return rows.select("bucket", F.col("offset").alias("first_key"), F.col("first_node").cast("long").alias("first_node"), "nodes")


def compressed(model: Model) -> DataFrame:
    """bucket, n and its nodes as packed Golomb-Rice codes."""
    options = model.options

    def run(batches):
        split, k, _ = options.rules()
        for batch in batches:
            data = [pack_rice(np.array(r["nodes"], np.int64), np.array([k[m] for m in preorder_sizes(r["n"], options.leaf_size, split)], np.int64))[0] for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("n"), pa.array(data, pa.binary())], ["bucket", "n", "bits"])

    return model.table.where("not alt").select("bucket", "n", "nodes").mapInArrow(run, "bucket long, n int, bits binary")


def expanded(packed: DataFrame, options: Options) -> DataFrame:
    """bucket, n and nodes back from ``compressed``; the buckets of a batch are read side by side."""

    def run(batches):
        split, k, _ = options.rules()
        for batch in batches:
            sizes, data = batch.column("n").to_pylist(), batch.column("bits").to_pylist()
            starts = 8 * np.cumsum([0, *map(len, data)])[:-1]
            nodes = unpack_rice(b"".join(data), [np.array([k[m] for m in preorder_sizes(n, options.leaf_size, split)], np.int64) for n in sizes], starts)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("n"), pa.array(nodes, pa.list_(pa.int64()))], ["bucket", "n", "nodes"])

    return packed.mapInArrow(run, "bucket long, n int, nodes array<long>")


def listed(model: Model, per_row: int = 1024) -> DataFrame:
    """The plain description as coded lists: for each stretch of ``per_row`` buckets the keys and the nodes before each, and the nodes' running sum, as Elias-Fano lists."""

    def run(batches):
        for chunk in whole_buckets(batches, 1):
            group = chunk.column("bucket").to_numpy()
            for g in np.unique(group).tolist():
                own = chunk.filter(pa.array(group == g))
                nodes = own.column("nodes")
                lists = (own.column("first_key").to_numpy(), own.column("first_node").to_numpy(), np.cumsum(nodes.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), own.column("id").slice(0, 1), pa.array([own.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(nodes.offsets.to_numpy()).tolist()], pa.list_(pa.int64())), *(pa.array([EliasFanoList(x).to_bytes()], pa.binary()) for x in lists)], ["stretch", "first", "buckets", "counts", "keys", "starts", "nodes"])

    rows = description(model).where("nodes is not null").select(F.floor(F.col("bucket") / per_row).alias("bucket"), F.col("bucket").alias("id"), "first_key", "first_node", "nodes")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, "stretch long, first long, buckets array<long>, counts array<long>, keys binary, starts binary, nodes binary")


def unlisted(rows: DataFrame) -> DataFrame:
    """bucket, first_key, first_node and nodes back from ``listed``."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, starts, sums = (EliasFanoList.from_bytes(r[c]).all() for c in ("keys", "starts", "nodes"))
                ends = np.cumsum(r["counts"])
                nodes = np.split(np.diff(sums, prepend=0), ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(r["buckets"], pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.tolist() for x in nodes], pa.list_(pa.int64()))], ["bucket", "first_key", "first_node", "nodes"])

    return rows.mapInArrow(run, "bucket long, first_key long, first_node long, nodes array<long>")


def whole_buckets(batches, rows: int = CHUNK):
    """Arrow batches in chunks of about ``rows`` rows that never cut a bucket; buckets follow each other."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= rows:
            bucket = held.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield held.slice(0, cut).combine_chunks().to_batches()[0]
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def walk(options: Options, keys, hashes: np.ndarray, sizes: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of keys within their buckets: all keys take a step at a time, those in parts of one size together."""
    search = Search(options, keys, hashes.copy())
    size, pos, add = sizes.astype(np.int64).copy(), begins.astype(np.int64).copy(), np.zeros(len(sizes), np.int64)
    index, level = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
    live = np.flatnonzero(size > 1)
    while len(live):
        index[live] += values[pos[live]] + 1
        for universal in np.unique(index[live] >> UNIVERSAL_SHIFT).tolist():
            at = live[(index[live] >> UNIVERSAL_SHIFT == universal) & (level[live] != universal)]
            if len(at) and options.mode != "fast":
                search.hashes[at], level[at] = search._rehash(at, universal), universal
        for n in np.unique(size[live]).tolist():
            at = live[size[live] == n]
            slot = search.slots(search.hashes[at], index[at].astype(U), n).astype(np.int64)
            if n <= options.leaf_size:
                add[at] += slot
                size[at] = 1
                continue
            parts = np.array(parts_of(n, int(search.split[n])))
            add[at] += np.concatenate([[0], np.cumsum(search.places[parts])])[slot]
            pos[at] += 1 + np.concatenate([[0], np.cumsum(search.node_count[parts])])[slot]
            size[at] = parts[slot]
        live = live[size[live] > 1]
    return add


class Part:
    """Buckets of one file of a function, with their nodes in one array."""

    def __init__(self, folder: str, part: int):
        tables = [f.read(["bucket", "n", "nodes", "alt", "offset"]) for f in part_files(f"{folder}/part={part}")]
        rows = pa.concat_tables(tables).combine_chunks().sort_by("bucket") if tables else None
        column = lambda name: rows.column(name).combine_chunks()
        self.bucket, self.n, self.offset = (column(c).to_numpy() if rows else np.zeros(0, np.int64) for c in ("bucket", "n", "offset"))
        self.alt = column("alt").to_numpy(zero_copy_only=False) if rows else np.zeros(0, bool)
        lists = column("nodes").fill_null([]) if rows else pa.array([[]], pa.list_(pa.int64()))
        self.begins, self.values = lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values.to_numpy()


@functools.lru_cache(maxsize=FEW_PARTS + 16)
def _part(folder: str, part: int) -> Part:
    return Part(folder, part)


def np_bucket(options: Options, buckets: int, h: np.ndarray) -> np.ndarray:
    if options.mode == "fast":
        bits = buckets.bit_length() - 1
        return (h >> U(64 - bits) if bits else np.zeros(len(h), U)).astype(np.int64)
    return H.np_reduce(h & U(0xFFFFFFFF), buckets).astype(np.int64)


def place(folder: str, options: Options, buckets: int, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of keys that aren't null, and what they are: 0 an index, 1 no such bucket, 2 an overflown bucket."""
    h = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(U) if options.mode == "fast" else H.key_hashes(keys, 0, options.kind)
    bucket = np_bucket(options, buckets, h)
    out, state = np.zeros(len(h), np.int64), np.ones(len(h), np.int8)
    order = np.argsort(bucket >> PART_SHIFT, kind="stable")
    numbers = (bucket >> PART_SHIFT)[order]
    for own in np.split(order, np.flatnonzero(np.diff(numbers)) + 1):
        if not len(own):
            continue
        part = _part(folder, int(bucket[own[0]] >> PART_SHIFT))
        if not len(part.bucket):
            continue
        i = np.minimum(np.searchsorted(part.bucket, bucket[own]), len(part.bucket) - 1)
        there = part.bucket[i] == bucket[own]
        own, i = own[there], i[there]
        state[own] = np.where(part.alt[i], 2, 0)
        own, i = own[~part.alt[i]], i[~part.alt[i]]
        if len(own):
            out[own] = part.offset[i] + walk(options, keys.take(pa.array(own)), h[own], part.n[i], part.values, part.begins[i])
    return out, state


def lookup(model: Model, df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Adds the index of ``key``. Absent keys get an arbitrary index, or null where their bucket is empty; null keys get null.

    Rows stay where they are: tasks load the function's files that their keys need. Functions of very many files have
    the rows dealt by file first, in partitions that Spark splits where a file is asked for very often. A column of ``df``
    that is named like ``out`` is an error.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    options, buckets, folder = model.options, model.buckets, model.path
    kind = "long" if options.kind == "long" else "string"
    rows = df.withColumn("__key", F.col(key).cast(kind))
    if buckets >> PART_SHIFT > FEW_PARTS and not df.isStreaming:

        def part_of(keys: pa.Array) -> pa.Array:
            known = keys.drop_null()
            h = known.to_numpy().view(U) if options.mode == "fast" else H.key_hashes(known, 0, options.kind)
            return scattered(np_bucket(options, buckets, h) >> PART_SHIFT, keys)

        part_of.__annotations__ = {"keys": pa.Array, "return": pa.Array}
        rows = rows.withColumn("__part", F.arrow_udf(part_of, "long")("__key")).hint("rebalance", "__part")

    def run(keys: pa.Array) -> pa.Array:
        index, state = place(folder, options, buckets, keys.drop_null())
        return scattered(np.where(state == 0, index, np.where(state == 1, -1, -2)), keys)

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    found = rows.withColumn("__found", F.arrow_udf(run, "long")("__key"))
    if model.fallback is None:
        return found.select(*df.columns, F.when(F.col("__found") >= 0, F.col("__found")).alias(out))
    from .other import lookup_bdz

    # keys of other buckets are not asked for
    found = found.withColumn("__over", F.when(F.col("__found") == -2, F.col("__key")))
    found = lookup_bdz(model.fallback, found, "__over", "__second")
    return found.select(*df.columns, F.when(F.col("__found") >= 0, F.col("__found")).when(F.col("__found") == -2, F.col("__second") + model.fallback_offset).alias(out))


def scattered(values: np.ndarray, keys: pa.Array) -> pa.Array:
    """Values of the keys that aren't null, at their places."""
    if not keys.null_count:
        return pa.array(values, pa.int64())
    valid = np.array(keys.is_valid())
    full = np.zeros(len(keys), np.int64)
    full[valid] = values
    return pa.array(full, pa.int64(), mask=~valid)


def universal_hash(column, kind: str):
    """Universal hash number 0 as a column; null for null."""

    def run(c):
        return scattered(H.key_hashes(c.drop_null(), 0, kind).view(np.int64), c)

    run.__annotations__ = {"c": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(column)


def check(df: DataFrame, idx: str = "idx") -> DataFrame:
    """One row: n, distinct_idx, min_idx and max_idx; a bijection has n, n, 0 and n - 1."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(idx).alias("distinct_idx"), F.min(idx).alias("min_idx"), F.max(idx).alias("max_idx"))
