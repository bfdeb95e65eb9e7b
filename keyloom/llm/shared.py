"""Tables with row numbers, membership without a shuffle of rows, joins that salt hot keys, and batches by size."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import as_table, shared_dir  # noqa: F401

_PART = 33  # monotonically_increasing_id has the partition's number above 33 bits


def filesystem(uri: str):
    """pyarrow file system of a shared URI, and the path in it; used on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table with ``r``, a number of its own for each row, which stays as it was written."""
    return as_table(rows.withColumn("r", F.monotonically_increasing_id()), name)


def stored_numbers(numbers: DataFrame, name: str) -> str:
    """Folder of row numbers (one column) of a ``numbered`` table, dealt by the partition that wrote the row: a file for each, as small as partitions are."""
    folder = shared_dir(numbers.sparkSession, name)
    numbers = numbers.select(F.col(numbers.columns[0]).alias("r")).withColumn("p", F.shiftright("r", _PART))
    numbers.repartition("p").write.partitionBy("p").parquet(folder)
    return folder


def are_among(folder: str, r: pa.Array) -> np.ndarray:
    """Which row numbers are stored in the folder; tasks load the files of the partitions that they meet."""
    values = r.to_numpy()
    out = np.zeros(len(values), bool)
    for p in np.unique(values >> _PART).tolist():
        at = values >> _PART == p
        out[at] = np.isin(values[at], _numbers(folder, p))
    return out


def among(rows: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """Rows of a ``numbered`` table whose ``r`` is in ``numbers`` (one column): no row is shuffled, and only ``r`` goes to Python."""
    folder = stored_numbers(numbers, name)

    def found(r: pa.Array) -> pa.Array:
        return pa.array(are_among(folder, r))

    found.__annotations__ = {"r": pa.Array, "return": pa.Array}
    return rows.where(F.arrow_udf(found, "boolean")(F.col("r")))


@functools.lru_cache(maxsize=8)
def _numbers(folder: str, p: int) -> np.ndarray:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = filesystem(f"{folder}/p={p}")
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.path.endswith(".parquet")]
    return np.concatenate([np.zeros(0, np.int64), *(pq.ParquetFile(fs.open_input_file(x)).read(["r"]).column("r").to_numpy() for x in files)])


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: Column, how: str = "inner", counts: DataFrame | None = None, least: int = 64, share: int = 10_000) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key) by ``key``; rows of hot keys are dealt further by ``by``.

    Hot is a key of more than a ``share``-th of all rows, and of ``least``; there are at most ``share`` such keys, which bounds
    their broadcast. ``by`` must tell the rows of a key apart, and be the same whenever a lost task runs again.
    ``counts`` (key, n) are the rows of each key, where known.
    """
    counts = counts if counts is not None else rows.groupBy(key).agg(F.count("*").alias("n"))
    counts = counts.where(F.col(key).isNotNull())
    top, total = counts.agg(F.max("n"), F.sum("n")).first()
    most = max(least, (total or 0) // share)
    if (top or 0) <= most:
        return rows.join(table, key, how)
    hot = as_table(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__parts")), "hot")
    hot = F.broadcast(hot)  # at most ``share`` rows
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copies = table.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def sub_batches(batch, column: str, chars: int):
    """Rows of an Arrow batch as (row numbers, texts) with about ``chars`` characters each; null texts come as ''."""
    rows, texts, held = [], [], 0
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        rows.append(i)
        texts.append(text)
        held += len(text) + 16
        if held >= chars:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts
