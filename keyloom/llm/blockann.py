"""Exact nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed, lists merged by heaps."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, filesystem, shared_dir

_BLOCK = "block long, dim int, n int, ids binary, vectors binary"


def blocks(rows: DataFrame, size: int, count: int, keep_copies: int = 0) -> DataFrame:
    """Rows (vec_id, embedding) as matrices of up to ``size`` vectors of one dimension each.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part.
    keep_copies > 0: of equal vectors in a block only those with that many smallest ids stay.
    """
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def flush(dim):
            nonlocal made
            ids = np.concatenate([x for x, _ in held[dim]])
            vectors = np.concatenate([x for _, x in held[dim]])
            held[dim], counts[dim] = [], 0
            for i in range(0, len(ids), size):
                own, part = ids[i : i + size], vectors[i : i + size]
                order = np.argsort(own, kind="stable")
                own, part = own[order], np.ascontiguousarray(part[order])
                if keep_copies:
                    part = part + 0.0  # no negative zeros, so that equal vectors have equal bytes
                    _, which = np.unique(part.view(f"V{part.shape[1] * 8}").ravel(), return_inverse=True)
                    by = np.argsort(which, kind="stable")
                    group, key = which[by], own[by]
                    new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]).cumsum()
                    rank = new - new[np.searchsorted(group, group)]  # repeats of an id share its rank
                    stay = np.sort(by[rank < keep_copies])
                    own, part = own[stay], part[stay]
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((base + made, dim, len(own), own.tobytes(), part.tobytes()), schema)], schema=schema)
                made += 1

        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False)
            lengths = np.diff(column.offsets.to_numpy())
            values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                part = values[column.offsets.to_numpy()[at][:, None] + np.arange(dim)]
                good = np.isfinite(part).all(axis=1) & (part != 0).any(axis=1)
                if good.any():
                    held.setdefault(dim, []).append((ids[at][good], part[good]))
                    counts[dim] = counts.get(dim, 0) + int(good.sum())
                    if counts[dim] >= size:
                        yield from flush(dim)
        for dim in held:
            if held[dim]:
                yield from flush(dim)

    rows = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.coalesce(count).mapInArrow(run, _BLOCK)


class Quantised:
    """int8 codes with a scale for each vector, and the norms that bound the error of a product."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = codes * self.scale[:, None]
        self.codes = codes
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.near_norm = np.sqrt((near**2).sum(axis=1))
        self.error = np.sqrt(((x - near) ** 2).sum(axis=1))


def tile(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products and bounds of their errors.

    The codes are multiplied as floats, in slices over which every sum of int8 products is a whole number that floats hold.
    """
    out = np.zeros((len(q.codes), len(c.codes)))
    for i in range(0, q.codes.shape[1], 1024):
        out += q.codes[:, i : i + 1024].astype(np.float32) @ c.codes[:, i : i + 1024].astype(np.float32).T
    out *= q.scale[:, None]
    out *= c.scale
    bound = q.error[:, None] * c.norm + q.near_norm[:, None] * c.error
    bound += 1e-12 * (q.norm[:, None] * c.norm) + 1e-300
    return out, bound


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component in double precision."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def slices(q: np.ndarray, step: int = 256) -> list[tuple[int, Quantised]]:
    return [(i, Quantised(q[i : i + step])) for i in range(0, len(q), step)]


def search_block(q_ids: np.ndarray, asked: list[tuple[int, Quantised]], c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray):
    """For queries with any: number, ids and scores of the up to k best candidates of the block, best first, ties to smaller ids.

    ``floor`` has the k-th best score that each query has already; candidates that can't reach it are left out.
    """
    c_q, order = Quantised(c), np.argsort(c_ids, kind="stable")
    for i, part in asked:
        ids = q_ids[i : i + len(part.x)]
        near, bound = tile(part, c_q)
        low = near - bound
        first, last = (np.searchsorted(c_ids, ids, side, sorter=order) for side in ("left", "right"))
        own = [(r, order[a:b]) for r, (a, b) in enumerate(zip(first, last)) if b > a]
        for r, at in own:
            low[r, at] = -np.inf
        least = floor[i : i + len(ids)]
        if low.shape[1] > k:
            least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        survive = near + bound >= least[:, None]
        for r, at in own:
            survive[r, at] = False
        rows, cols = np.nonzero(survive)
        scores = np.empty(len(rows))
        for j in range(0, len(rows), 1 << 16):
            scores[j : j + (1 << 16)] = exact(part.x[rows[j : j + (1 << 16)]], c[cols[j : j + (1 << 16)]])
        order_ = np.lexsort((c_ids[cols], -scores, rows))
        rows, cols, scores = rows[order_], cols[order_], scores[order_]
        starts = np.searchsorted(rows, np.arange(len(ids) + 1))
        for r in np.flatnonzero(np.diff(starts)).tolist():
            best = slice(starts[r], min(starts[r] + k, starts[r + 1]))
            yield i + r, c_ids[cols[best]].tolist(), scores[best].tolist()


def _matrix(r: dict):
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(r["n"], r["dim"])


def _stripe(folder: str, stripe: int):
    """Candidate blocks of a stripe, one at a time from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = filesystem(f"{folder}/stripe={stripe}")
    for file in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.path.endswith(".parquet")):
        with fs.open_input_file(file) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(batch_size=1):
                yield from map(_matrix, batch.to_pylist())


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096, stripe_blocks: int = 4096, stripes: int | None = None) -> DataFrame:
    """The k nearest rows by inner product for each row of ``queries`` (both vec_id, embedding): query_id, rank, vec_id, score.

    Exact: bounds only drop pairs that can't be among the k best. Rows with the query's own vec_id are no candidates
    for it; vectors of another dimension neither. Repeated candidate rows are candidates each; a repeated query row
    gets a list of its own. Null, zero and broken vectors and null ids take no part; no rows give none.

    Candidate blocks are written once, in stripes, and never shuffled: a task holds one query block and reads the
    blocks of one stripe, a tile at a time, with each query's k best so far in a heap-merged list. There are as many
    stripes as keep all cores busy while query blocks are few, and else one for ``stripe_blocks`` blocks; what is shuffled are
    the query blocks and k candidates a query, both once for each stripe.
    """
    spark = rows.sparkSession
    n_c, n_q = (max(1, -(-x.count() // block)) for x in (rows, queries))
    stripes = stripes or min(n_c, max(-(-4 * spark.sparkContext.defaultParallelism // n_q), -(-n_c // stripe_blocks)))
    folder = shared_dir(spark, "candidates")
    number = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    blocks(rows, block, n_c, keep_copies=k + 1).withColumn("stripe", F.pmod(number, F.lit(stripes)).cast("int")).write.partitionBy("stripe").option("compression", "zstd").parquet(folder)
    asks = as_table(blocks(queries, block, n_q), "queries")
    grid = asks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(max(1, n_q * stripes))
    found_schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _matrix(row)
                asked, best, floor = slices(q), [[] for _ in q_ids], np.full(len(q_ids), -np.inf)
                for c_ids, c in _stripe(folder, row["stripe"]):
                    if q.shape[1] != c.shape[1]:
                        continue
                    for i, ids, scores in search_block(q_ids, asked, c_ids, c, k, floor):
                        best[i] = list(itertools.islice(heapq.merge(best[i], zip([-x for x in scores], ids)), k))
                        if len(best[i]) == k:
                            floor[i] = -best[i][-1][0]
                base = (row["block"] >> 32 << 40) + ((row["block"] & 0xFFFFF) << 20)
                out = [(base + i, int(q_ids[i]), row["stripe"], [x for _, x in own], [-s for s, _ in own]) for i, own in enumerate(best) if own]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else [[]] * 5, found_schema)], schema=found_schema)

    found = grid.mapInArrow(run, "query long, query_id long, at long, ids array<long>, scores array<double>")

    def merge(batches):
        """Lists of a query stand together; a heap takes the best of their heads until k are out."""
        query, query_id, lists = None, None, []

        def best():
            merged = heapq.merge(*(list(zip([-x for x in scores], ids)) for ids, scores in lists))
            return [(query_id, rank + 1, vec_id, -score) for rank, (score, vec_id) in zip(range(k), merged)]

        out: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["query"] != query:
                    if lists:
                        out += best()
                    query, query_id, lists = r["query"], r["query_id"], []
                lists.append((r["ids"], r["scores"]))
            if len(out) >= 8192:
                yield ranked(out)
                out = []
        if lists:
            out += best()
        yield ranked(out)

    def ranked(out):
        types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, types)], ["query_id", "rank", "vec_id", "score"])

    return found.repartition("query").sortWithinPartitions("query", "at").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
