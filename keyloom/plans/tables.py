"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) gets a temporary folder; on a cluster it is an error, as every executor
    would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.get(context.applicationId) or _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="keyloom-"))
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/keyloom/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read again: cuts the lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow file system of a shared URI, and the path in it; used on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def part_files(folder: str):
    """Open pyarrow files of a folder's Parquet parts, one after another; a folder that isn't there has none. Used on executors."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    for path in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.path.endswith(".parquet")):
        with fs.open_input_file(path) as stream:
            yield pq.ParquetFile(stream)


def write_parts(df: DataFrame, by: str, path: str) -> DataFrame:
    """Written in a folder ``part=k`` for each value k of the column ``by`` (renamed part), sorted by the other columns' first; the table read again."""
    first = next(c for c in df.columns if c != by)
    df.withColumnRenamed(by, "part").repartition("part").sortWithinPartitions("part", first).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return df.sparkSession.read.schema(df.drop(by).schema).parquet(path).select(*(c for c in df.columns if c != by))
