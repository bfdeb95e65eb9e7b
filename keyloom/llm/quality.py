"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import code_points, mix, ngram_hashes, parts, space_table, spans, word_hashes

NGRAMS = (3, 4)
_SAME = np.uint64(0x5A5A)  # the token of a word that repeats the one before it


@dataclass
class SubwordModel:
    """Vectors of hashed words and n-grams and the softmax layer over a document's mean vector."""

    vectors: np.ndarray  # buckets x dim
    output: np.ndarray  # dim x 2
    bias: np.ndarray  # 2

    def collapsed(self) -> tuple[np.ndarray, float]:
        """A bucket's share in the difference of the two outputs: the mean of vectors and the layer are linear, so scoring needs a number a bucket."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def hashed(text: str, buckets: int):
    """Bucket numbers of the text's words, repeated words and n-grams, in parts; n-grams keep within a word and its edges."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    last = None
    for part in parts(text):
        codes = code_points(part)
        space = space_table()[codes]
        starts, ends = spans(~space)
        if not len(starts):
            continue
        words = word_hashes(codes, starts, ends)
        before = np.concatenate([[last if last is not None else ~words[0]], words[:-1]])
        same = int((words == before).sum())
        last = words[-1]
        # a blank at either end of every word; the blank's code stands for any white space
        codes = np.concatenate([[32], np.where(space, 32, codes), [32]]).astype(np.uint64)
        blank = codes == 32
        out = [words >> shift, np.full(same, mix(np.array([_SAME]))[0] >> shift)]
        for n in NGRAMS:
            inner = np.zeros(max(0, len(codes) - n + 1), bool)
            for j in range(1, n - 1):
                inner |= blank[j : len(codes) - n + 1 + j]
            out.append(ngram_hashes(codes, n)[~inner] >> shift)
        yield np.concatenate(out).astype(np.int64)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 5, rate: float = 0.5, seed: int = 7, totals: tuple[int, int] | None = None) -> SubwordModel:
    """One document a step; the rate falls to nothing over the epochs.

    Classes weigh alike while training, then the bias takes their shares: those of ``totals``, the rows of each class that
    the sample is of, or else of the sample. So scores mean the same whether or not the sample's bounds were reached.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels)
    model = SubwordModel((rng.random((buckets, dim), np.float32) - np.float32(0.5)) / dim, np.zeros((dim, 2), np.float32), np.zeros(2))
    counted = []
    for text in texts:
        found = [x for x in hashed(text or "", buckets)]
        counted.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    share = np.array([max(1, (y == c).sum()) for c in (0, 1)]) / max(1, len(y))
    weights = np.minimum(4.0, 0.5 / share)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets_i, counts = counted[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(buckets_i):
                continue
            weight = (counts / counts.sum()).astype(np.float32)
            own = model.vectors[buckets_i]
            mean = weight @ own
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weights[y[i]]
            step_back = (model.output @ p).astype(np.float32)
            model.output -= (lr * np.outer(mean, p)).astype(np.float32)
            model.bias -= lr * p * 0.1
            # the mean's gradient goes to each vector by its share, scaled up as shares are small
            model.vectors[buckets_i] = own - np.float32(lr * 20) * weight[:, None] * step_back
    whole = np.array([max(1, x) for x in totals]) / max(2, sum(totals)) if totals and sum(totals) else share
    model.bias += np.log(whole / (weights * share))
    return model


def score_column(model: SubwordModel) -> Column:
    """The probability of label 1 of column ``text`` as a column: whole texts; null and empty ones get the bias alone."""
    scalars, bias = model.collapsed()
    buckets = len(scalars)

    def score(column):
        import pyarrow as pa

        out = np.empty(len(column))
        for i, text in enumerate(column):
            total, n = 0.0, 0
            for x in hashed(text.as_py() or "", buckets):
                total += float(scalars[x].sum(dtype=np.float64))
                n += len(x)
            out[i] = 1 / (1 + np.exp(-np.clip(total / max(1, n) + bias, -500, 500)))
        return pa.array(out, pa.float64())

    return F.arrow_udf(_annotated(score), "double")(F.col("text"))


def _annotated(f):
    import pyarrow as pa

    f.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return f


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, column: str, per_class: int, longest: int = 100_000) -> tuple[list, tuple[int, int]]:
    """(text, label) of at most ``per_class`` labelled rows of each class, chosen by hash among those not held out, and how many rows of each class there are.

    Texts of over ``longest`` characters are not taken, which bounds the sample's bytes as well. A label whose rows disagree
    counts by its smallest value, null ones not at all; rows without a doc_id are left out, and a doc_id with several texts
    gives its smallest one.
    """
    one = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    one = one.where(~F.coalesce(held_out(), F.lit(True)))
    counts = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).where("label in (0, 1)").collect()}
    chosen = None
    for value in (0, 1):
        part = one.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class small rows: the bound allows the broadcast; one text for each doc_id, so it bounds the sample too
    rows = docs.select("doc_id", "text").where((F.col("text").isNull()) | (F.length("text") <= longest)).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r.text or "", r.label) for r in sorted(rows.collect(), key=lambda r: r.doc_id)], (counts.get(0, 0), counts.get(1, 0))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> SubwordModel:
    """Trained on at most ``per_class`` labelled rows of each label; without any, every score is a half."""
    rows, totals = fit(docs, labels, "quality", per_class)
    return train([t for t, _ in rows], [y for _, y in rows], totals=totals)


def classify(docs: DataFrame, model: SubwordModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null doc_id is not held out.

    Null and empty texts get the bias's score; texts of any length are scored whole, in parts; repeated rows each get their
    score; other columns are ignored; no rows give none.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: SubwordModel, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, whatever they are named.

    Decided by the text alone: repeated rows and rows without doc_id go or stay alike, null texts like empty ones, texts of
    any length as a whole; a score equal to the threshold stays; no rows give none.
    """
    return docs.where(score_column(model) >= threshold)
