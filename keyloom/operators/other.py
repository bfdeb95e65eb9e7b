"""Other perfect hash constructions. Sequential ones run per shard: keys are dealt by hash, each shard's indexes follow those before it."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.succinct import prefix_sum
from ..plans.tables import as_table, part_files, shared_dir, write_parts
from .recsplit import dealt_to_search, hashed, scattered, universal_hash, whole_buckets

U = np.uint64
SHARD = 20_000  # keys in a shard on average, so that a shard fits in a task whatever the number of keys


def peel(edges: np.ndarray, vertices: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (edges, their free vertices): in each round all edges go that alone have some vertex. None where a core is left.

    No vertex is free for two edges of a round, and none is touched by edges of later rounds.
    """
    edges, left, rounds = np.asarray(edges), np.arange(len(edges)), []
    degree = np.bincount(edges.ravel(), minlength=vertices)
    while len(left):
        alone = degree[edges[left]] == 1
        go = alone.any(axis=1)
        if not go.any():
            return None
        gone = left[go]
        rounds.append((gone, edges[gone, alone[go].argmax(axis=1)]))
        np.subtract.at(degree, edges[gone].ravel(), 1)
        left = left[~go]
    return rounds


@dataclass
class Sharded:
    """A function of shards: a row each (bucket, n, size, seed, data, offset), in files of ``PART`` shards below ``path``."""

    table: DataFrame
    path: str
    kind: str
    n: int
    shards: int
    method: str
    parameters: tuple = ()

    @classmethod
    def of(cls, table: DataFrame, kind: str, n: int, shards: int, method: str, parameters: tuple = (), path: str | None = None) -> Sharded:
        path = path or shared_dir(table.sparkSession, method)
        stored = write_parts(table.select("bucket", "n", "size", "seed", "data", "offset").withColumn("part", F.floor(F.col("bucket") / PART)), "part", path)
        return cls(stored, path, kind, n, shards, method, parameters)


PART = 64  # shards in a file
FEW_PARTS = 32  # functions of at most as many files are evaluated where the rows are
_STORED = "bucket long, n long, size long, seed long, data binary, offset long"


def save_sharded(model: Sharded, path: str) -> dict:
    Sharded.of(model.table, model.kind, model.n, model.shards, model.method, model.parameters, path)
    return {"kind": model.kind, "n": model.n, "shards": model.shards, "method": model.method, "parameters": list(model.parameters)}


def load_sharded(spark, path: str, meta: dict) -> Sharded:
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return Sharded(spark.read.schema(_STORED).parquet(path).drop("part"), path, meta["kind"], meta["n"], meta["shards"], meta["method"], tuple(meta["parameters"]))


def sharded_bytes(model: Sharded) -> bytes:
    """One string of a function of few shards."""
    rows = [[*r[:4], r.data.hex(), r.offset] for r in model.table.collect()]
    return json.dumps([model.kind, model.n, model.shards, model.method, list(model.parameters), rows]).encode()


def sharded_from_bytes(spark, data: bytes) -> Sharded:
    kind, n, shards, method, parameters, rows = json.loads(data)
    rows = [(*r[:4], bytearray.fromhex(r[4]), r[5]) for r in rows]
    return Sharded.of(spark.createDataFrame(rows, _STORED), kind, n, shards, method, tuple(parameters))


def _sharded(keys: DataFrame, key: str, kind: str, method: str, make: Callable, parameters: tuple = (), per_shard: int = SHARD) -> Sharded:
    n = keys.count()
    shards = max(1, -(-n // per_shard))
    rows = hashed(keys, key, kind).withColumn("bucket", H.reduce_range(F.col("h"), shards))

    def run(batches):
        for chunk in whole_buckets(batches, 1):
            bucket = chunk.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for first, last in zip(edges, edges[1:]):
                hashes = np.sort(chunk.column("h").to_numpy()[first:last].view(U))
                if (np.diff(hashes) == 0).any():
                    raise ValueError("keys repeat, or have equal hashes")
                seed, data, size = make(hashes, *parameters)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((int(bucket[first]), pa.int64()), (len(hashes), pa.int64()), (size, pa.int64()), (seed, pa.int64()), (data, pa.binary()))], ["bucket", "n", "size", "seed", "data"])

    dealt = dealt_to_search(rows, n).sortWithinPartitions("bucket", "h")
    table = as_table(dealt.mapInArrow(run, "bucket long, n long, size long, seed long, data binary"), method)
    placed = prefix_sum(table, "bucket", "size", "offset").withColumn("offset", F.col("offset").cast("long"))
    return Sharded.of(placed, kind, n, shards, method, parameters)


@functools.lru_cache(maxsize=FEW_PARTS + 8)
def _rows(folder: str, part: int) -> dict:
    return {r["bucket"]: r for f in part_files(f"{folder}/part={part}") for r in f.read(["bucket", "n", "size", "seed", "data", "offset"]).to_pylist()}


def _lookup(model: Sharded, df: DataFrame, key: str, out: str, place: Callable) -> DataFrame:
    """Rows stay where they are: tasks load the files of the shards that their keys need, and work through a batch shard by shard.

    Functions of very many files have the rows dealt by file first, in partitions that Spark splits where a file is asked
    for very often. Null keys get null; a column named like ``out`` is an error.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    folder, kind, shards, parameters = model.path, model.kind, model.shards, model.parameters
    rows = df.withColumn("__shard_key", F.col(key).cast("long" if kind == "long" else "string"))
    if -(-shards // PART) > FEW_PARTS and not df.isStreaming:
        rows = rows.withColumn("__shard_part", F.floor(H.reduce_range(universal_hash(F.col("__shard_key"), kind), shards) / PART)).hint("rebalance", "__shard_part")

    def run(keys: pa.Array) -> pa.Array:
        h = H.key_hashes(keys.drop_null(), 0, kind)
        shard = H.np_reduce(h, shards).astype(np.int64)
        found, order = np.full(len(h), -1), np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            b = int(shard[own[0]]) if len(own) else -1
            if r := _rows(folder, b // PART).get(b) if b >= 0 else None:
                found[own] = place(h[own], r["seed"], r["data"], r["n"], r["size"], *parameters) + r["offset"]
        return scattered(found, keys)

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    found = F.arrow_udf(run, "long")("__shard_key")
    # absent keys of a shard without keys
    return rows.withColumn(out, found).withColumn(out, F.when(F.col(out) >= 0, F.col(out))).select(*df.columns, out)


# ---- BDZ ----


def bdz_vertices(h: np.ndarray, seed: int, m: int) -> np.ndarray:
    """A vertex in each third."""
    third = m // 3
    return np.stack([H.np_reduce(H.np_mix64(h + U(3 * seed + j)), third).astype(np.int64) + j * third for j in range(3)], axis=1)


def peeled(h: np.ndarray, edges_of: Callable[[int], np.ndarray], vertices: int) -> tuple[int, np.ndarray, list]:
    """The first seed under which everything peels, its edges and the rounds."""
    for seed in range(1000):
        edges = edges_of(seed)
        if (rounds := peel(edges, vertices)) is not None:
            return seed, edges, rounds
    raise ValueError("no seed lets the keys be peeled")


def _make_bdz(h: np.ndarray):
    m = (3 + 123 * len(h) // 100) // 3 * 3 + 3
    seed, edges, rounds = peeled(h, lambda seed: bdz_vertices(h, seed, m), m)
    g = np.full(m, 3, np.uint8)
    for e, v in reversed(rounds):
        # the free vertex still counts as 3, that is as 0 modulo 3
        g[v] = ((edges[e] == v[:, None]).argmax(axis=1) - (g[edges[e]] % 3).sum(axis=1, dtype=np.int64)) % 3
    # two bits a vertex; 3 marks the unused ones, whose value counts as 0
    return seed, np.packbits(np.unpackbits(g[:, None], axis=1)[:, 6:].ravel()).tobytes(), len(h)


def _place_bdz(h, seed, data, n, size):
    m = (3 + 123 * n // 100) // 3 * 3 + 3
    g, used = _bdz_table(data, m)
    edges = bdz_vertices(h, seed, m)
    which = (g[edges] % 3).sum(axis=1) % 3
    return used[edges[np.arange(len(h)), which]]


@functools.lru_cache(maxsize=64)
def _bdz_table(data: bytes, m: int):
    """Values of a shard's vertices and the ranks of the used ones."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))[: 2 * m].reshape(m, 2)
    g = bits[:, 0] * 2 + bits[:, 1]
    return g, np.concatenate([[0], np.cumsum(g != 3)])


def build_bdz(keys: DataFrame, key: str, kind: str = "long") -> Sharded:
    """Hypergraph peeling: 2 bits for each of 1.23 n vertices, and their ranks."""
    return _sharded(keys, key, kind, "bdz", _make_bdz)


def lookup_bdz(model: Sharded, df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    return _lookup(model, df, key, out, _place_bdz)


# ---- compress, hash and displace ----


def _chd(h: np.ndarray, load: int, slots: int, k: int):
    """Buckets of about ``load`` keys, largest first, those of a size at once; each takes the first displacement that overfills no slot.

    Of buckets that ask for the same places in a round, those later in order look on. The first one always gets its own.
    """
    r = max(1, -(-len(h) // load))
    bucket = H.np_reduce(H.np_mix64(h), r).astype(np.int64)
    order, sizes = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=r)
    begins = np.cumsum(sizes) - sizes
    used, shift = np.zeros(slots, np.int64), np.zeros(r, np.uint32)
    for m in np.unique(sizes[sizes > 0])[::-1].tolist():
        todo = np.flatnonzero(sizes == m)
        own, d = h[order[begins[todo][:, None] + np.arange(m)]], np.ones(len(todo), np.int64)
        while len(todo):
            if d.max() > 1 << 24:
                raise ValueError("no displacement found")
            tries = min(max(8, (1 << 16) // (len(todo) * m)), 1 << 12)
            tried = np.sort(H.np_reduce(H.np_mix64(own[:, None, :] + (d[:, None] + np.arange(tries)).astype(U)[:, :, None]), slots).astype(np.int64), axis=2)
            fill = used[tried]
            for o in range(1, m):
                fill[:, :, o:] += tried[:, :, o:] == tried[:, :, :-o]
            fits = (fill < k).all(axis=2)
            at = np.where(fits.any(axis=1), fits.argmax(axis=1), tries)
            d += at
            asks = np.flatnonzero(at < tries)
            places = tried[asks, at[asks]].ravel()
            by_place = np.argsort(places, kind="stable")
            first = np.searchsorted(places[by_place], places[by_place])
            free = np.empty(len(places), bool)
            free[by_place] = used[places[by_place]] + np.arange(len(places)) - first < k
            won = free.reshape(-1, m).all(axis=1)
            shift[todo[asks[won]]] = d[asks[won]]
            np.add.at(used, places.reshape(-1, m)[won].ravel(), 1)
            left = np.ones(len(todo), bool)
            left[asks[won]] = False
            todo, own, d = todo[left], own[left], d[left]
    return shift, used


def _make_chd(h: np.ndarray, load: int, factor: float):
    slots = max(1, int(np.ceil(len(h) * factor)))
    shift, used = _chd(h, load, slots, 1)
    return 0, shift.astype("<u4").tobytes() + np.packbits(used == 0).tobytes(), len(h)


def _place_chd(h, seed, data, n, size, load, factor):
    r, slots = max(1, -(-n // load)), max(1, int(np.ceil(n * factor)))
    shift = np.frombuffer(data, "<u4", r).astype(U)
    holes = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * r))[:slots])
    at = H.np_reduce(H.np_mix64(h + shift[H.np_reduce(H.np_mix64(h), r).astype(np.int64)]), slots).astype(np.int64)
    return at - np.searchsorted(holes, at)


def build_chd(keys: DataFrame, key: str, kind: str = "long", load: int = 4, factor: float = 1.05) -> Sharded:
    """Minimal for any factor: a table with room for more slots than keys, less the empty ones below a slot."""
    return _sharded(keys, key, kind, "chd", _make_chd, (load, factor), 2_000 if factor <= 1 else SHARD)


def lookup_chd(model: Sharded, df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    return _lookup(model, df, key, out, _place_chd)


def _make_k_chd(h: np.ndarray, load: int, k: int):
    slots = max(1, -(-len(h) // k))
    shift, _ = _chd(h, load, slots, k)
    return 0, shift.astype("<u4").tobytes(), slots


def _place_k_chd(h, seed, data, n, size, load, k):
    shift = np.frombuffer(data, "<u4").astype(U)
    return H.np_reduce(H.np_mix64(h + shift[H.np_reduce(H.np_mix64(h), len(shift)).astype(np.int64)]), size).astype(np.int64)


def build_k_chd(keys: DataFrame, key: str, kind: str = "long", k: int = 4, load: int = 5) -> Sharded:
    """k-perfect: each of the about n / k slots takes at most k keys."""
    return _sharded(keys, key, kind, "k_chd", _make_k_chd, (load, k), 2_000)


def lookup_k_chd(model: Sharded, df: DataFrame, key: str, out: str = "slot") -> DataFrame:
    return _lookup(model, df, key, out, _place_k_chd)


# ---- levels of collision bits ----


def bbhash_levels(keys: DataFrame, key: str, gamma: float = 2.0, most: int | None = None) -> DataFrame:
    """level, key and slot of every key: on each level, keys alone in their slot stay and the others go down.

    Native throughout. Levels go on until no key is left, so their number grows with the logarithm of the keys; with
    ``most`` of them, the keys left come with a null slot. Nulls are left out, and keys must be distinct: ones that still
    share every slot after 128 levels are an error.
    """
    rest = as_table(keys.select(F.col(key).cast("long").alias("key")).where("key is not null"), "level")
    placed, level = None, 0
    while (n := rest.count()) and level != most:
        if level == 128:
            raise ValueError("keys repeat")
        size = max(1, int(n * gamma))
        with_slot = H.with_wrapped(rest, slot=H.reduce_range(H.mix64(F.col("key") + level), size))
        alone = with_slot.groupBy("slot").agg(F.count("*").alias("c"), F.min("key").alias("key"))
        here = as_table(alone.where("c = 1").select(F.lit(level).alias("level"), "key", "slot"), "placed")
        placed = here if placed is None else placed.unionByName(here)
        rest = as_table(rest.join(here.select("key"), "key", "left_anti"), "level")
        level += 1
    left = rest.select(F.lit(level).alias("level"), "key", F.lit(None).cast("long").alias("slot"))
    return left if placed is None else placed.unionByName(left)


def bbhash_counts(levels: DataFrame) -> DataFrame:
    """level and placed for every level of ``bbhash_levels``, and a row without a level for the keys left unplaced."""
    placed = levels.where("slot is not null").groupBy("level").agg(F.count("*").alias("placed"))
    return placed.unionByName(levels.where("slot is null").agg(F.lit(None).cast("int").alias("level"), F.count("*").alias("placed")))


def bbhash_level_sql(column: str, table: str, gamma: float) -> str:
    """The counts of all levels in SQL, by recursion: keys that share their slot go on to the next level."""
    wide = lambda x: f"(({x})::uhugeint % 18446744073709551616::uhugeint)"

    def mixed(x):
        a = wide(f"xor({x}, {x} >> 30) * {H.M1}::uhugeint")
        b = wide(f"xor({a}, {a} >> 27) * {H.M2}::uhugeint")
        return f"xor({b}, {b} >> 31)"

    def placed(source):
        slot = f"(({mixed('(k + level::uhugeint)')} & 4294967295::uhugeint) * greatest(1, floor(n * {gamma}))::uhugeint) >> 32"
        return f"select level, k, count(*) over (partition by slot) as c from (select level, k, {slot} as slot from (select level, k, count(*) over () as n from {source}))"

    base = f"(select distinct 0 as level, {column}::uhugeint as k from {table} where {column} is not null)"
    return f"with recursive t as ({placed(base)} union all {placed('(select level + 1 as level, k from t where c > 1)')}) select level, count(*) as placed from t where c = 1 group by 1 union all select null, 0"


# ---- cuckoo ----


class Cuckoo:
    """Keys in two slots' reach: an insertion pushes others on, and after too many pushes all are placed anew under another seed."""

    def __init__(self, keys: np.ndarray):
        self.size = max(2, int(len(keys) * 1.05 / 2) + 1)
        for seed in range(0, 10_000, 2):
            if seed and seed % 20 == 0:
                self.size += self.size // 10 + 1
            self.seed = seed
            if self._fill(keys):
                return
        raise ValueError("keys repeat")

    def places(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([H.np_reduce(H.np_mix64(keys + U(self.seed + j)), self.size).astype(np.int64) + j * self.size for j in (0, 1)], axis=1)

    def _fill(self, keys) -> bool:
        """All keys at once, then those that were pushed out to their other slot, until none is left."""
        at = self.places(keys)
        self.slots = np.full(2 * self.size, -1)
        moving, to = np.arange(len(keys)), at[:, 0]
        for _ in range(200 + 20 * len(keys).bit_length()):
            # of the keys that want one slot the first one takes it; it pushes out who is there
            taken, first = np.unique(to, return_index=True)
            out = self.slots[taken]
            self.slots[taken] = moving[first]
            late = np.ones(len(moving), bool)
            late[first] = False
            moving, came_to = np.concatenate([moving[late], out[out >= 0]]), np.concatenate([to[late], taken[out >= 0]])
            if not len(moving):
                return True
            to = np.where(came_to == at[moving, 0], at[moving, 1], at[moving, 0])
        return False

    def find(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Number of the key in ``own`` (the keys it was made of), or -1."""
        out = np.full(len(keys), -1)
        for column in self.places(keys).T:
            i = self.slots[column]
            hit = (i >= 0) & (own[np.maximum(i, 0)] == keys)
            out[hit] = i[hit]
        return out


class LongSet:
    """A set of 64-bit keys that are not 0, which marks an empty slot: ``contains``, and ``index``, the slot of a key or -1."""

    def __init__(self, keys):
        keys = np.asarray(keys, np.int64)
        if (keys == 0).any() or len(np.unique(keys)) < len(keys):
            raise ValueError("keys repeat, or one is 0")
        self.table = Cuckoo(keys.view(U))
        self.slots = np.zeros(len(self.table.slots), np.int64)
        used = self.table.slots >= 0
        self.slots[used] = keys[self.table.slots[used]]

    def index(self, keys) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1)
        for column in self.table.places(keys.view(U)).T:
            out = np.where((self.slots[column] == keys) & (keys != 0), column, out)
        return out

    def contains(self, keys) -> np.ndarray:
        return self.index(keys) >= 0


def cuckoo_lookup(entries: DataFrame, df: DataFrame, key: str, value: str, out: str = "value", per_part: int = 50_000) -> DataFrame:
    """Adds the value that ``entries`` (distinct long keys; null ones left out) has for each key, or null: a cuckoo table for each part of the entries.

    Parts are files; tasks load those that their keys need and keep their tables. Where there are many, the rows are
    dealt by part first, in partitions that Spark splits where a part is asked for very often.
    """
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    parts, folder = max(1, -(-entries.count() // per_part)), shared_dir(df.sparkSession, "cuckoo")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    pairs = entries.select(F.col(key).cast("long").alias("k"), F.col(value).cast("string").alias("v")).where("k is not null")
    write_parts(pairs.withColumn("p", part(F.col("k"))), "p", folder)
    rows = df.withColumn("__cuckoo_key", F.col(key).cast("long")).withColumn("__cuckoo_part", part(F.col("__cuckoo_key")))
    if parts > FEW_PARTS and not df.isStreaming:
        rows = rows.hint("rebalance", "__cuckoo_part")

    def run(keys: pa.Array, numbers: pa.Array) -> pa.Array:
        known = np.flatnonzero(np.array(keys.is_valid()))
        k, p = keys.fill_null(0).to_numpy(), numbers.fill_null(0).to_numpy()
        at, found, base = np.full(len(k), -1), [], 0
        for number in np.unique(p[known]).tolist():
            own = known[p[known] == number]
            if (table := _cuckoo(folder, number)) is not None:
                i = table[0].find(k[own].view(U), table[1])
                at[own] = np.where(i >= 0, i + base, -1)
                found.append(table[2])
                base += len(table[2])
        values = pa.chunked_array(found, pa.string()).combine_chunks() if found else pa.array([], pa.string())
        return values.take(pa.array(at, pa.int64(), mask=at < 0))

    run.__annotations__ = {"keys": pa.Array, "numbers": pa.Array, "return": pa.Array}
    return rows.withColumn(out, F.arrow_udf(run, "string")("__cuckoo_key", "__cuckoo_part")).select(*df.columns, out)


@functools.lru_cache(maxsize=FEW_PARTS + 8)
def _cuckoo(folder: str, part: int):
    """A part's table, keys and values."""
    tables = [f.read(["k", "v"]) for f in part_files(f"{folder}/part={part}")]
    if not tables:
        return None
    rows = pa.concat_tables(tables).combine_chunks()
    keys = rows.column("k").to_numpy().view(U)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("keys repeat")
    return Cuckoo(keys), keys, rows.column("v").combine_chunks()


def bucket_skew(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """How evenly a key's hash fills buckets: n, fewest, mean, most."""
    rows = H.with_wrapped(df, bucket=H.reduce_range(H.mix64(F.col(key)), buckets))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    return sizes.agg(F.count("*").alias("buckets"), F.min("c").alias("fewest"), F.avg("c").alias("mean"), F.max("c").alias("most"))
