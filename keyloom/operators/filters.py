"""Membership by fingerprints and xor filters, marker bitmaps and dense counters over a perfect hash function's indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..plans.tables import as_table
from .other import Sharded, _lookup, _sharded, peeled
from .recsplit import Model, lookup

U = np.uint64


def fingerprint(key: Column, bits: int = 8) -> Column:
    """Independent of the function's own hashes; native."""
    return F.xxhash64(F.lit("fingerprint"), key).bitwiseAND(F.lit((1 << bits) - 1))


def fingerprint_table(model: Model, keys: DataFrame, key: str, bits: int = 8) -> DataFrame:
    """idx and fp of every key: with the function, a static filter that errs on one absent key in 2**bits."""
    return as_table(lookup(model, keys, key).select("idx", fingerprint(F.col(key), bits).alias("fp")), "fingerprints")


def might_contain(model: Model, prints: DataFrame, df: DataFrame, key: str, bits: int = 8, out: str = "member") -> DataFrame:
    """Adds whether a key may be one of the function's; true for each of them."""
    found = lookup(model, df, key, "__idx")
    table = prints.withColumnsRenamed({"idx": "__idx", "fp": "__fp"})
    return found.join(table, "__idx", "left").withColumn(out, F.coalesce(F.col("__fp") == fingerprint(F.col(key), bits), F.lit(False))).drop("__idx", "__fp")


def xor_slots(h: np.ndarray, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, one in each block, and the 8-bit fingerprint."""
    mixed = H.np_mix64(h + U(seed))
    at = np.stack([H.np_reduce(mixed >> U(16 * j), block).astype(np.int64) + j * block for j in range(3)], axis=1)
    return at, (mixed & U(0xFF)).astype(np.uint8)


def _make_xor(h: np.ndarray):
    block = (32 + 123 * len(h) // 100) // 3
    seed, at, rounds = peeled(h, lambda seed: xor_slots(h, seed, block)[0], 3 * block)
    fp, table = xor_slots(h, seed, block)[1], np.zeros(3 * block, np.uint8)
    for e, v in reversed(rounds):
        table[v] = fp[e] ^ np.bitwise_xor.reduce(table[at[e]], axis=1)  # the free slot is still 0
    return seed, table.tobytes(), len(h)


def _test_xor(h, seed, data, n, size):
    table = np.frombuffer(data, np.uint8)
    at, fp = xor_slots(h, seed, len(table) // 3)
    return (np.bitwise_xor.reduce(table[at], axis=1) ^ fp == 0).astype(np.int64)


def build_xor(keys: DataFrame, key: str, kind: str = "long") -> Sharded:
    """About 9.9 bits a key; errs on one absent key in 256."""
    return _sharded(keys, key, kind, "xor", _make_xor)


def xor_contains(model: Sharded, df: DataFrame, key: str, out: str = "member") -> DataFrame:
    """Adds whether a key may be in the set; false for null keys."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    found = _lookup(model, df, key, "__in_xor", lambda h, seed, data, n, size: _test_xor(h, seed, data, n, size) * _YES)
    return found.select(*df.columns, F.coalesce(F.col("__in_xor") >= _YES, F.lit(False)).alias(out))


_YES = 1 << 60  # above all offsets of shards, which lookups add


def xor_to_bytes(h: np.ndarray) -> bytes:
    """A filter of one shard as bytes: number of fingerprints and seed as big-endian 32-bit numbers, then the fingerprints."""
    seed, table, _ = _make_xor(np.sort(h))
    return len(table).to_bytes(4, "big") + seed.to_bytes(4, "big") + table


def xor_test_bytes(data: bytes, h: np.ndarray) -> np.ndarray:
    """Whether hashes may be in the set of a filter stored by ``xor_to_bytes``."""
    size, seed = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
    if len(data) != 8 + size:
        raise ValueError("a filter of another size")
    return _test_xor(h, seed, data[8:], 0, size) == 1


def mark(model: Model, df: DataFrame, key: str) -> DataFrame:
    """Bitmaps of the indexes that occur: a row (part, bitmap) of 32,768 bits for each stretch of indexes."""
    found = lookup(model, df.select(F.col(key).alias("__k")), "__k", "__i").where("__i is not null")
    return found.groupBy(F.bitmap_bucket_number("__i").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__i")).alias("bitmap"))


def unmarked(model: Model, marks: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key's bit isn't set, with their own columns whatever they are named."""
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(floor(__bit / 8) as int) + 1, 1)")), 16, 10).cast("int")
    marks = marks.select(F.col("part").alias("__part"), F.col("bitmap").alias("__bitmap"))
    found = lookup(model, keys, key, "__i").withColumn("__part", F.bitmap_bucket_number("__i")).withColumn("__bit", F.bitmap_bit_position("__i")).join(marks, "__part", "left")
    is_set = F.col("__bitmap").isNotNull() & (byte.bitwiseAND(F.pow(F.lit(2), F.col("__bit") % 8).cast("int")) != 0)
    return found.where(~F.coalesce(is_set, F.lit(False))).select(*keys.columns)


def dense_counts(model: Model, df: DataFrame, key: str) -> DataFrame:
    """idx and cnt, how often each index occurs; no key is kept."""
    return lookup(model, df.select(F.col(key).alias("__k")), "__k").groupBy("idx").agg(F.count("*").alias("cnt"))
