"""Key sources and sinks: text lines, tokens, 8-byte records; distinct keys; orders; signatures as deltas; generated key sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.codes import pack_rice_apart, pack_var_longs, unpack_rice_apart, unpack_var_longs
from ..plans.tables import as_table, filesystem


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One key a line."""
    return spark.read.text(path).withColumnRenamed("value", "key")


def tokens(df: DataFrame, column: str) -> DataFrame:
    """Tokens between white space; the last one counts too, whatever follows it."""
    return df.select(F.explode(F.split(F.col(column), r"\s+")).alias("key")).where("key <> ''")


def records(spark: SparkSession, path: str, mix: bool = True, slice_bytes: int = 1 << 26) -> DataFrame:
    """Big-endian 8-byte records of binary files of any size, mixed unless told otherwise; a rest of fewer bytes is left out.

    Only names and lengths of the files are listed; tasks read slices of ``slice_bytes`` each, so a large file is many tasks.
    """
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") - F.col("length") % 8).alias("size"))
    slices = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(slice_bytes).cast("long"))).alias("at"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = filesystem(r["path"])
                with fs.open_input_file(name) as stream:
                    for at in range(r["at"], min(r["size"], r["at"] + slice_bytes), 1 << 22):
                        part = np.frombuffer(stream.read_at(min(1 << 22, r["size"] - at, r["at"] + slice_bytes - at), at), ">i8").astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(H.np_mix64(part.view(np.uint64)).view(np.int64) if mix else part)], ["key"])

    tasks = max(1, spark.sparkContext.defaultParallelism)
    return slices.repartition(tasks, "path", "at").mapInArrow(run, "key long")


def write_records(keys: np.ndarray) -> bytes:
    return np.asarray(keys, ">i8").tobytes()


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("key")).where("key is not null").distinct()


def duplicate_report(df: DataFrame, column: str) -> DataFrame:
    """n, n_distinct and duplicates of the keys that aren't null."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    return sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct")).withColumn("duplicates", F.col("n") - F.col("n_distinct"))


def length_first(column: str) -> list[Column]:
    """Shorter byte strings first, then byte by byte, unsigned."""
    return [F.octet_length(column), F.col(column).cast("string").cast("binary")]


def signatures(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """64-bit signatures of the distinct values of a column: keys of their own, of a fixed size."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().select("value", H.hash_bytes("murmur2_64", F.col("value"), seed).alias("key"))


def signatures128(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """value, and the two halves of a 128-bit signature: even of 10**12 values no two are likely to share it."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return rows.select("value", H.hash_bytes("murmur3_128_high", F.col("value"), seed).alias("high"), H.hash_bytes("murmur3_128_low", F.col("value"), seed).alias("low"))


def block_sorted(spark: SparkSession, n: int, seed: int = 0, blocks: int = 16) -> DataFrame:
    """block and key: generated keys dealt by their top bits, in unsigned order over blocks but not within them."""
    bits = max(1, (blocks - 1).bit_length())
    rows = generated(spark, n, seed).withColumn("block", F.shiftrightunsigned("key", 64 - bits))
    return rows.repartitionByRange(1 << bits, "block").select("block", "key")


def generated(spark: SparkSession, n: int, seed: int = 0, bits: int = 64) -> DataFrame:
    """n distinct pseudo-random keys: a range through a bijection, in any number of partitions."""
    return H.with_wrapped(spark.range(n), key=H.bijection(F.col("id") + seed, bits)).select("key")


def write_deltas(keys: DataFrame, code: str = "varint", rice_k: int = 50, block: int = 1 << 16) -> DataFrame:
    """Sorted unsigned signatures as coded differences: a row (part, at, n, first, data) for each ``block`` of keys.

    Parts follow each other in unsigned order, and blocks within a part from ``at`` on. ``first`` is a block's first
    key; ``data`` the differences of the others.
    """
    if code not in ("varint", "rice"):
        raise ValueError(code)
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, held, size, done = TaskContext.get().partitionId(), [], 0, 0

        def blocks(last: bool):
            nonlocal held, size, done
            values = np.concatenate(held) if held else np.zeros(0, np.uint64)
            while len(values) >= block or last and len(values):
                own, values = values[:block], values[block:]
                data = pack_var_longs(np.diff(own)) if code == "varint" else pack_rice_apart(np.diff(own), rice_k)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, done, len(own), int(own[:1].view(np.int64)[0]), data), schema)], schema=schema)
                done += len(own)
            held, size = [values], len(values)

        for batch in batches:
            held.append(batch.column("key").to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= block:
                yield from blocks(False)
        yield from blocks(True)

    by = H.unsigned_order(F.col("key"))
    return as_table(keys.select("key").withColumn("__by", by).repartitionByRange("__by").sortWithinPartitions("__by").select("key").mapInArrow(run, "part int, at long, n long, first long, data binary"), "deltas")


def read_deltas(table: DataFrame, code: str = "varint", rice_k: int = 50) -> DataFrame:
    """part, pos and key of every signature."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                steps = unpack_var_longs(r["data"]) if code == "varint" else unpack_rice_apart(r["data"], rice_k, r["n"] - 1)
                keys = np.cumsum(np.concatenate([np.array([r["first"]], np.int64).view(np.uint64), steps]), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * r["n"], pa.int32()), pa.array(r["at"] + np.arange(r["n"])), pa.array(keys.view(np.int64))], ["part", "pos", "key"])

    return table.select("part", "at", "n", "first", "data").mapInArrow(run, "part int, pos long, key long")


def deltas(keys: DataFrame, column: str, ranges: int = 256) -> DataFrame:
    """Native: each signature's difference to the one before it in unsigned order (null for the first), as text of the unsigned number.

    Windows run within ranges of the top bits; a range's first key is compared with the largest one of the ranges
    before it, found over a table of one row a range.
    """
    bits = (ranges - 1).bit_length()
    rows = keys.select(F.col(column).alias("key")).withColumn("range", F.shiftrightunsigned("key", 64 - bits)).withColumn("by", H.unsigned_order(F.col("key")))
    tops = rows.groupBy("range").agg(F.max("by").alias("top"))
    tops = tops.select("range", F.lag("top").over(Window.orderBy("range")).alias("before"))
    rows = rows.withColumn("own", F.lag("by").over(Window.partitionBy("range").orderBy("by"))).join(tops, "range")
    prior = F.coalesce("own", "before").cast("decimal(20,0)")
    return rows.select("key", (F.col("by").cast("decimal(20,0)") - prior).alias("delta"))


def signature_blocks(keys: DataFrame, column: str, per_block: int = 2_000_000) -> DataFrame:
    """Blocks by the high bits, of ``per_block`` expected keys: block, and what is left of the key, moved to the top."""
    n = keys.count()
    bits = max(0, (-(-n // per_block) - 1).bit_length())
    block = F.shiftrightunsigned(F.col(column), 64 - bits) if bits else F.lit(0).cast("long")
    return keys.select(F.col(column).alias("key"), block.alias("block"), F.shiftleft(F.col(column), bits).alias("rest"))


def save_manifest(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    spark.createDataFrame([(values,)], "meta map<string,string>").coalesce(1).write.parquet(path)


def load_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    return spark.read.parquet(path).first()[0]
