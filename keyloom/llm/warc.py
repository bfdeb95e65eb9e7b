"""WARC archives: records written with revisits, an index merged from sorted runs, records read back by offset."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_table, filesystem, salted_join, shared_dir

_ENTRY = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("path", pa.string()), ("chunk", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_SQL = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, path string, chunk long, offset long, length long"
_CHUNK = 64
_EPOCH = datetime.datetime(2020, 1, 1)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host names turned round, then the path: captures of one site stand together. Null and broken addresses sort as they are."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()) else ""
    return (",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def capture_time(page_id: int | None) -> datetime.datetime:
    """Pages carry no time, so each is taken to be captured as many seconds after a fixed day as its id says."""
    return _EPOCH + datetime.timedelta(seconds=(page_id or 0) % 10**9)


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as a gzip member; a revisit keeps the response's head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A gzip member's WARC fields and block."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def with_responses(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest and refers_to: null for responses.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response; rows that repeat it are
    responses too, and so are all where no page_id is known. Only payloads that occur more than once are joined; they
    are counted with partial sums first and written as a table, and the pages of one that is very frequent are dealt over
    tasks. Null payloads are empty; no pages give none; other columns are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    large = F.col("bytes") >= least
    copies = rows.where(large).groupBy("digest", "bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    copies = as_table(copies, "copies")
    # short payloads, null ones among them, share no key: they find nothing in the join
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("short "), F.xxhash64("page_id", "url", "html").cast("string")))
    joined = salted_join(rows.withColumn("__key", key), copies.select(F.col("digest").alias("__key"), "winner"), "__key", F.struct("page_id", "url"), "left", counts=copies.select(F.col("digest").alias("__key"), "n"))
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 1000, file_bytes: int = 1 << 28) -> DataFrame:
    """Writes a record per row; returns the index entries as sorted runs, a run for each archive file.

    Files begin anew after ``file_bytes``. Attempts write files of their own; the table of runs names those that count.
    """
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches):
        fs, base = filesystem(folder)
        out, name, at, entries = None, "", 0, []

        def close():
            out.close()
            entries.sort(key=_key)
            columns = zip(*entries)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ENTRY)], schema=_ENTRY)

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                page_id, url = page_id.as_py(), url.as_py()
                if out is None:
                    name, at, entries = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page_id, url, (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py())
                out.write(member)
                entries.append((url_key(url), f"{capture_time(page_id):%Y%m%d%H%M%S}", page_id, "response" if refers_to.as_py() is None else "revisit", digest.as_py(), f"{folder}/{name}", len(entries) // _CHUNK, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return as_table(with_responses(pages, least).mapInArrow(run, _ENTRY_SQL), "runs")


def _key(entry) -> tuple:
    """Order of captures: URL key, time, page_id with nulls first."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


class LoserTree:
    """Merges sorted streams: each inner node keeps the loser of its match, so a step replays one path only. One entry of each stream is held."""

    def __init__(self, runs: list, key=_key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.entries, self.heads = [None] * self.k, [None] * self.k
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _next(self, i: int) -> None:
        entry = next(self.runs[i], None)
        self.entries[i], self.heads[i] = entry, None if entry is None else self.key(entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.entries[w]
            self._next(w)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _entries(table: pa.Table, rows: int = 1024):
    """An Arrow table's rows, some of them at a time as Python values."""
    for batch in table.to_batches(max_chunksize=rows):
        yield from zip(*(x.to_pylist() for x in batch.columns))


def _stored(path: str):
    """A run in a file of the shared folder, a batch at a time."""
    fs, name = filesystem(path)
    with fs.open_input_file(name) as source:
        for batch in pa.ipc.open_stream(source):
            yield from _entries(pa.Table.from_batches([batch]))


def merge_runs(runs: DataFrame, per_range: int = 1 << 18, most_rows: int = 1 << 17) -> DataFrame:
    """The index in global order of (urlkey, timestamp, page_id), with ``part``: partitions follow each other in that order.

    The number of ranges follows from the index, of about ``per_range`` entries each, and ranges are of the whole key, so
    that one address with very many captures is split as well. In each range the stretches of the sorted runs are found
    where a batch's keys step back; they are kept as Arrow tables and, beyond ``most_rows`` rows, as files of the
    shared folder (a task that runs again writes its own), and merged by a loser tree that holds a batch of each stream. Equal
    entries all stay. No runs give an empty index.
    """

    folder = shared_dir(runs.sparkSession, "merge")

    def merge(batches):
        from pyspark import TaskContext

        part, (fs, base) = TaskContext.get().partitionId(), filesystem(folder)
        held, held_rows, stored, last = [], 0, [], None

        def spill():
            """Held stretches are merged into one file: each spill makes one longer run."""
            nonlocal held, held_rows
            name = f"{uuid.uuid4().hex}.run"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}", compression=None) as sink, pa.ipc.new_stream(sink, _ENTRY) as out:
                for batch in grouped(LoserTree([_entries(x) for x in held])):
                    out.write_batch(batch)
            stored.append(name)
            held, held_rows = [], 0

        try:
            for batch in batches:
                table = pa.Table.from_batches([batch]).cast(_ENTRY)
                keys = list(map(_key, _entries(table)))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a == b:
                        continue
                    piece = table.slice(a, b - a)
                    if not i and held and last is not None and keys[0] >= last:
                        held[-1] = pa.concat_tables([held[-1], piece])
                    else:
                        held.append(piece)
                    last = keys[b - 1]
                held_rows += len(keys)
                if held_rows > most_rows:
                    spill()
                    last = None
            streams = [_stored(f"{folder}/{name}") for name in stored] + [_entries(x) for x in held]
            for batch in grouped(LoserTree(streams)):
                yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int64()), *batch.columns], ["part", *_ENTRY.names])
        finally:
            for name in stored:
                fs.delete_file(f"{base}/{name}")

    def grouped(entries, rows: int = 8192):
        out: list[tuple] = []
        for entry in entries:
            out.append(entry)
            if len(out) == rows:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    ranges = max(1, -(-runs.count() // per_range))
    return runs.select(*_ENTRY.names).repartitionByRange(ranges, "urlkey", "timestamp", "page_id").mapInArrow(merge, "part long, " + _ENTRY_SQL)


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*entries), _ENTRY)], schema=_ENTRY)


def read_records(index: DataFrame) -> DataFrame:
    """Every record that the index lists, read from the archives: page_id, url, timestamp, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is hashed again; a digest that differs from its record's is an error. Revisits carry none.
    Stretches of a file are dealt out and read in the order of their offsets.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("timestamp", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(text: str | None):
        text = text and text.removeprefix("<urn:x-page:").removesuffix(">")
        return None if text in (None, "none") else int(text)

    def run(batches):
        path, stream = None, None
        for batch in batches:
            out, held = [], 0
            for entry in batch.to_pylist():
                if entry["path"] != path:
                    if stream:
                        stream.close()
                    path = entry["path"]
                    fs, name = filesystem(path)
                    stream = fs.open_input_file(name)
                fields, block = parse(stream.read_at(entry["length"], entry["offset"]))
                head, _, payload = block.partition(b"\r\n\r\n")
                length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                    raise ValueError(f"damaged record at {entry['offset']} of {path}")
                out.append((page(fields["warc-record-id"]), fields.get("warc-target-uri"), entry["timestamp"], payload if fields["warc-type"] == "response" else None, length, digest, fields["warc-type"], page(fields.get("warc-refers-to"))))
                held += len(payload)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if stream:
            stream.close()

    dealt = index.repartition("path", "chunk").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, timestamp string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
