"""Near duplicates by weighted MinHash: BagMinHash signatures of word shingles, bands, exact multiset overlap."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.succinct import prefix_sum
from .features import code_points, mix, parts, spans, word_hashes, word_table
from .shared import among, are_among, as_table, numbered, salted_join, stored_numbers, sub_batches

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 shares a band with a probability of 0.9999
_K = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def words_of(text: str) -> np.ndarray:
    """Hashes of the lower-case words (letters, digits, underscores) in order."""
    out = []
    for part in parts(text.lower()):
        codes = code_points(part)
        out.append(word_hashes(codes, *spans(word_table()[codes])))
    return np.concatenate(out)


def shingles(words: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of runs of ``size`` words: ascending hashes and counts. Shorter texts are one run."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for j in range(size):
        out = out * _K + words[j : len(words) - size + 1 + j]
    return np.unique(mix(out), return_counts=True)


def signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash: n x m signatures of multisets; the share of equal registers estimates the weighted Jaccard similarity without bias.

    ``owner`` tells which multiset (0 to n - 1) an element with its count belongs to; each must have one at least.

    Weights are discretised in unit levels, and the levels of an element are split like a tree: 0, 1, 2 to 3, 4 to 7
    and so on. Each part is a Poisson process of points in time whose rate is the part's width; a point falls on a
    level of its part and on a register, all of it told by hashes of the element, so that every multiset sees the same
    points. A point counts where its level is below the element's count, and a register holds the earliest such
    point. Points come in the order of time, so a process ends behind the horizon by which all registers are filled
    most likely; where one is not, the multiset is done again with twice the horizon, which changes no filled register.
    """
    out = np.full((n, m), np.inf)
    weight = np.bincount(owner, count, n)
    horizon = m / weight * (np.log(m) + 4)
    todo = np.ones(n, bool)
    while todo.any():
        use = todo[owner]
        _points(owner[use], element[use], count[use], horizon, m, out)
        todo &= ~np.isfinite(out).all(axis=1)
        horizon[todo] *= 2
    return out


def _points(owner, element, count, horizon, m, out) -> None:
    flat = out.reshape(-1)
    low = 0
    while len(owner):
        width = max(1, low)
        seed = mix(element + np.uint64(low * int(_K) & _MASK))
        who, limit, at = owner, count, np.zeros(len(owner))
        step = 0
        while len(who):
            a, b = mix(seed + np.uint64(step * int(_K) & _MASK)), mix(seed + np.uint64((step + 1) * int(_K) & _MASK))
            at = at - np.log(((a >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
            live = at <= horizon[who]
            who, limit, at, seed, b = who[live], limit[live], at[live], seed[live], b[live]
            register = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            if width == 1:
                np.minimum.at(flat, who * m + register, at)
            else:
                level = low + ((b >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
                hit = level < limit
                np.minimum.at(flat, who[hit] * m + register[hit], at[hit])
            step += 2
        low = max(1, low * 2)
        more = count > low
        owner, element, count = owner[more], element[more], count[more]


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _K), bits.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _K + bits[:, :, j])
    return key.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """r, doc_id, h, fp (of the word sequence; of the text where it has no word), weight (shingles) and bands of every row.

    ``docs`` has r, doc_id, h and text. Null texts count as empty; very long ones are cut into parts for hashing only.
    """

    def run(batches):
        for batch in batches:
            for rows, texts in sub_batches(batch, "text", 500_000):
                fps, weights, owner, element, count, has = [], [], [], [], [], []
                for text in texts:
                    words = words_of(text)
                    fps.append(hashlib.blake2b(words.tobytes() if len(words) else b"\0" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    e, c = shingles(words)
                    weights.append(int(c.sum()))
                    if len(e):
                        owner.append(np.full(len(e), len(has)))
                        element.append(e)
                        count.append(c)
                    has.append(bool(len(e)))
                bands: list = [None] * len(texts)
                if owner:
                    # multisets without elements have no signature
                    number = np.cumsum(has) - 1
                    known = np.flatnonzero(has)
                    keys = band_keys(signatures(number[np.concatenate(owner)], np.concatenate(element), np.concatenate(count), len(known), BANDS * ROWS))
                    for i, key in zip(known.tolist(), keys):
                        bands[i] = key
                own = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(own) for x in ("r", "doc_id", "h")), pa.array(fps, pa.binary()), pa.array(weights, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["r", "doc_id", "h", "fp", "weight", "bands"])

    return docs.select("r", "doc_id", "h", "text").mapInArrow(run, "r long, doc_id long, h long, fp binary, weight long, bands array<long>")


_SET = struct.Struct("<q")


def overlap_set(text: str) -> bytes:
    """A text's shingle multiset as bytes: for comparing, on candidates only."""
    e, c = shingles(words_of(text))
    return _SET.pack(len(e)) + e.tobytes() + c.astype("<u4").tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two multisets, exactly but for equal hashes of different shingles."""
    (x, cx), (y, cy) = _open(a), _open(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(cx[i], cy[j]).sum())
    total = int(cx.sum()) + int(cy.sum()) - both
    return both / total if total else 0.0


def _open(data: bytes):
    (n,) = _SET.unpack_from(data)
    return np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n).astype(np.int64)


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id and packed multiset of those rows of the ``numbered`` table ``texts`` (r, text) whose number is in ``ids``: picked in the same Python step, so that a task has one worker."""
    folder = stored_numbers(ids, "candidates")

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(are_among(folder, batch.column("r"))))
            for rows, texts in sub_batches(batch, "text", 2_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("r").take(pa.array(rows)), pa.array([zlib.compress(overlap_set(x), 1) for x in texts], pa.binary())], ["id", "bag"])

    return texts.select("r", "text").mapInArrow(run, "id long, bag binary")


def verified(pairs: DataFrame, bags: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) those whose texts overlap enough. A text in very many pairs is dealt over tasks, with a copy of its multiset for each."""

    def run(batches):
        last, bag = None, b""
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last:
                    last, bag = a, zlib.decompress(x)
                if similarity(bag, zlib.decompress(y)) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    right = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    left = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    both = salted_join(pairs.join(right, "b"), left, "a", F.col("b"), counts=counts)
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label, the smallest id of its component, of every end of the links (a, b).

    Each round, every node hooks on its smallest neighbour if that is smaller, chains are halved, and the links are
    carried over to what the nodes hang on; nothing is collected, and links vanish at least by half each round. Nodes
    with very many links are dealt over tasks, unless few links are left.
    """
    links = as_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while left := links.count():
        hang = as_table(_jumped(links.groupBy("a").agg(F.min("b").alias("b"))), "hang")
        ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
        step = ends.join(hang.select(F.col("a").alias("id"), F.col("b").alias("to")), "id", "left").select("id", F.coalesce("to", "id").alias("label"))
        if labels is None:
            labels = as_table(step, "labels")
        else:
            over = hang.select(F.col("a").alias("label"), F.col("b").alias("to"))
            labels = as_table(labels.join(over, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            over = hang.select(F.col("a").alias(end), F.col("b").alias("to"))
            links = (salted_join(links, over, end, F.col("a" if end == "b" else "b"), "left") if left > 2000 else links.join(over, end, "left")).withColumn(end, F.coalesce("to", end)).drop("to")
        links = as_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        labels = links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels


def _jumped(hang: DataFrame) -> DataFrame:
    """a -> b followed to the end: b < a, so every chain ends, and each round doubles the steps."""
    while True:
        hang = as_table(hang, "jump")
        over = hang.select(F.col("a").alias("b"), F.col("b").alias("to"))
        jumped = hang.join(over, "b", "left")
        if jumped.where("to is not null").isEmpty():
            return hang
        hang = jumped.select("a", F.coalesce("to", "b").alias("b"))


def _prepared(docs: DataFrame) -> DataFrame:
    """A table of doc_id, text, h (a hash of all columns but maps) and the row as ``doc``, with row numbers: texts are read from it and never shuffled."""
    known = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(*known).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"))
    return numbered(rows, "rows")


def _components(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Near-duplicate classes of the rows: prints (r, doc_id, h, fp), texts (id, fp, n, first, label), and links that made the labels.

    A text is all rows of one fingerprint; its id is the smallest row number among them, ``first`` its first row in the
    order (doc_id, nulls last; h; r).
    """
    prints = as_table(fingerprints(rows), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "r")).alias("first")
    texts = as_table(prints.groupBy("fp").agg(F.min("r").alias("id"), F.count("*").alias("n"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands"), first), "texts")
    members = as_table(texts.where("bands is not null").select("id", "weight", F.explode("bands").alias("key")), "members")
    buckets = as_table(members.groupBy("key").agg(F.min(F.struct("id", "weight")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("hub.id").alias("hub"), F.col("hub.weight").alias("hub_weight")), "buckets")
    members = as_table(salted_join(members, buckets.drop("n"), "key", F.col("id"), counts=buckets.select("key", "n")), "shared")
    alike = lambda x, y: f"least({x}, {y}) >= {SIMILARITY} * greatest({x}, {y})"

    bags = as_table(_sets(rows, members.select("id").distinct()), "bags")
    tested = as_table(members.where("id <> hub").where(alike("weight", "hub_weight")).groupBy("id").agg(F.min("hub").alias("a")).select("a", F.col("id").alias("b")), "tested")
    links = as_table(verified(tested, bags), "links")
    labelled = _labelled(members, components(links))
    of_hub = labelled.where("id = hub").select("hub", F.col("label").alias("hub_label")).distinct()
    pairs = salted_join(labelled.where("id <> hub").where(alike("weight", "hub_weight")).select("hub", "id", "label"), of_hub, "hub", F.col("id")).where("label <> hub_label")
    pairs = as_table(pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    links = as_table(links.unionByName(verified(pairs, bags)), "links")
    links = as_table(links.unionByName(_across(_labelled(members, components(links)), bags)), "links")
    return prints, texts, links


def _first_rows(texts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts with their label, and label with the class's first row."""
    texts = as_table(texts.select("id", "fp", "n", "first").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "texts")
    return texts, as_table(texts.groupBy("label").agg(F.min("first").alias("first")), "firsts")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its near-duplicate class, of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts of the same words in the same order are copies; other texts are linked where the multisets of their runs of
    five words have a similarity of 0.8 at least, and classes are what links join. Texts without words are copies if
    equal, and null counts as empty. Rows of one doc_id are one document, whatever texts they have: they link them. A row
    without doc_id gets the smallest doc_id of its class, or null where the class has none. No rows give none.

    Copies are collapsed first, with partial sums. Buckets of a band are never expanded into all pairs: (1) each text
    is compared with the smallest one that it shares a bucket with; (2) with the first text of each of its buckets that
    is in another class by then; (3) the texts of a bucket outside its largest class so far, with all of the bucket. That
    leaves out only pairs whose texts are in one class already, and pairs whose sizes alone rule the similarity out.
    """
    prints, texts, links = _components(_prepared(docs.select("doc_id", "text")))
    # texts that one doc_id has: linked to its smallest
    own = as_table(prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")).where("fp <> last").drop("last"), "several")
    if not own.isEmpty():
        id_of = texts.select("fp", F.col("id").alias("b"))
        several = prints.select("doc_id", F.col("fp").alias("own")).distinct()
        several = salted_join(several, own, "doc_id", F.col("own")).where("own <> fp").select("fp", "own")
        several = salted_join(several, id_of, "fp", F.col("own")).select("b", F.col("own").alias("fp"))
        several = salted_join(several, id_of.withColumnRenamed("b", "a"), "fp", F.col("b")).select("a", "b")
        links = as_table(links.unionByName(several), "links")
    texts, firsts = _first_rows(texts, components(links))
    of_text = salted_join(texts.select("id", "fp", "n", "label"), firsts.select("label", F.col("first.doc_id").alias("class_id")), "label", F.col("id"))
    of_text = as_table(of_text.select("fp", "n", "class_id"), "classes")
    return salted_join(prints.select("r", "doc_id", "fp"), of_text.drop("n"), "fp", F.col("r"), counts=of_text.select("fp", "n")).select("doc_id", "class_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class of texts, with all its columns: that with the smallest doc_id.

    Rows without doc_id come after all others; rows of one doc_id by a hash of their columns, then as they stand in the
    input. Unlike in ``classes``, rows of one doc_id with different texts are different documents: no text is lost
    but for a near copy that stays. Null texts count as empty, and all texts without words that are equal are
    one class. No rows give none.
    """
    rows = _prepared(docs)
    _, texts, links = _components(rows)
    _, firsts = _first_rows(texts, components(links))
    kept = among(rows, firsts.select("first.r"), "kept")
    return kept.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return as_table(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")


def _across(labelled: DataFrame, bags: DataFrame, cell: int = 512, most_cell: int = 4096, cell_weight: int = 4_000_000, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between texts of one bucket whose labels differ.

    The texts of a bucket's most frequent label need no comparing with each other, so only the others are held against
    all. Both are dealt into cells of bounded size; in a cell an index of the shingles gives the overlaps of a text with all
    others at once, and for each label that it reaches one link comes out. Buckets of two have been compared before.
    Cells grow with the bucket, so that a bucket is many tasks, yet a text's multiset is sent to few cells: in a bucket of
    n texts at most n / ``most_cell`` times, or 8 times. Cells are numbered from the largest on and dealt in turn, so that
    no task gets several large ones while another has none.
    """
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    cell_ = F.greatest(F.lit(cell), F.least(F.lit(most_cell), F.col("n") / 8))
    share = F.greatest(F.col("w") / F.col("n") / cell_weight, 1 / cell_)  # cells for each text; more if texts are long
    open_ = as_table(sizes.where("labels > 1 and n > 2").select("key", "n", F.col("top.label").alias("top"), F.ceil(F.col("n") * share).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("top.c")) * share).cast("int").alias("askers"), (F.col("n") - F.col("top.c")).alias("asking")), "open")
    cells = F.col("parts").cast("long") * F.col("askers")
    total = open_.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0]
    tasks = max(1, min(total, int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    open_ = numbered(open_.withColumn("cells", cells).orderBy(F.desc(F.col("n") / F.col("parts") + F.col("asking") / F.col("askers")), "key"), "ranked")
    open_ = as_table(prefix_sum(open_, "r", "cells", "first").select("key", "n", "top", "parts", "askers", F.col("first").cast("long").alias("first")), "open")
    rows = salted_join(labelled.select("key", "id", "label"), open_.drop("n"), "key", F.col("id"), counts=open_.select("key", "n"))
    number = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    asked = rows.where("label <> top").select("key", "id", "label", number("askers").alias("i"), every("parts").alias("j"), "first", "parts", F.lit(True).alias("asks"))
    against = rows.select("key", "id", "label", every("askers").alias("i"), number("parts").alias("j"), "first", "parts", F.lit(False).alias("asks"))
    at = F.pmod(F.col("first") + F.col("i").cast("long") * F.col("parts") + F.col("j"), F.lit(tasks)).cast("int")
    dealt = asked.unionByName(against).withColumn("at", at).drop("first", "parts").join(bags, "id").repartitionById(tasks, "at").sortWithinPartitions("key", "i", "j")

    def run(batches):
        group, held = None, []
        for batch in batches:
            out = []
            for key, i, j, id_, label, asks, bag in zip(*(batch.column(x).to_pylist() for x in ("key", "i", "j", "id", "label", "asks", "bag"))):
                if (key, i, j) != group:
                    out += _cell_links(held, least)
                    group, held = (key, i, j), []
                held.append((id_, label, asks, bag))
            yield _pairs(out)
        yield _pairs(_cell_links(held, least))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _cell_links(held: list, least: float) -> list[tuple[int, int]]:
    """For each text that asks, one text of each other label that is similar enough."""
    askers, others = ([x for x in held if x[2] is asks] for asks in (True, False))
    if not askers or not others:
        return []
    sets = [_elements(zlib.decompress(x[3])) for x in others]
    sizes = np.array([len(x) for x in sets])
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    ids, labels = np.array([x[0] for x in others]), np.array([x[1] for x in others])
    out = []
    for id_, label, _, bag in askers:
        own = _elements(zlib.decompress(bag))
        first, last = np.searchsorted(element, own, "left"), np.searchsorted(element, own, "right")
        n = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hits = np.flatnonzero((labels != label) & (both >= least * (len(own) + sizes - both)))
        for k in hits[np.unique(labels[hits], return_index=True)[1]].tolist():
            out.append((id_, int(ids[k])))
    return out


def _elements(bag: bytes) -> np.ndarray:
    """A multiset as a set: the second copy of an element counts as another one, and so on."""
    e, c = _open(bag)
    copy = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    return mix(np.repeat(e, c) + copy.astype(np.uint64) * _K)
