"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import code_points, ngram_hashes, parts, spans, word_hashes, word_table
from .quality import _annotated, fit

PREFIXES = (4, 5, 6)
GRADES = 4  # 0: not toxic; 1 to 3: thirds of the toxic texts by their share of telling words


@dataclass
class OrdinalModel:
    """P(grade >= k) = logistic(weights . x - thresholds[k - 1]); the thresholds ascend, the weights are shared."""

    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, z: float) -> float:
        """Expected grade."""
        return float(self._at_least(z).sum())

    def toxic(self, z: float) -> float:
        """Probability of a grade above 0."""
        return float(self._at_least(z)[0])

    def _at_least(self, z: float) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -500, 500)))


def counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of lower-case words and of their first characters, how often each occurs, and the number of words."""
    shift, found, words = np.uint64(64 - int(buckets).bit_length() + 1), [], 0
    for part in parts(text.lower()):
        codes = code_points(part)
        starts, ends = spans(word_table()[codes])
        words += len(starts)
        found.append(word_hashes(codes, starts, ends))
        for n in PREFIXES:
            at = starts[ends - starts > n]
            found.append(ngram_hashes(codes, n)[at] if len(at) else np.zeros(0, np.uint64))
    bucket, n = np.unique(np.concatenate(found) >> shift, return_counts=True)
    return bucket.astype(np.int64), n, words


def values(n: np.ndarray, words: int) -> np.ndarray:
    """Feature values: a damped share of the words, as long texts hold more of everything."""
    return np.log1p(100 * n / max(1, words)).astype(np.float32)


def telling(rows: list, y: np.ndarray, buckets: int, least: float = 20.0) -> np.ndarray:
    """Buckets whose presence depends on the label: a likelihood ratio statistic (G squared) of at least ``least``.

    The rest gets no weight; with many more features than rows, chance would otherwise give most of them one.
    """
    seen = np.zeros((2, buckets))
    for (bucket, _, _), label in zip(rows, y):
        seen[label, bucket] += 1
    size = np.array([[max(1, (y == c).sum())] for c in (0, 1)])
    total = 0.0
    for part, whole, column in ((seen, size, seen.sum(0)), (size - seen, size, (size - seen).sum(0))):
        expected = whole * column / size.sum()
        total = total + 2 * (part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
    return total >= least


def grades(rows: list, y: np.ndarray, buckets: int) -> np.ndarray:
    """Grades from two labels: telling words have log odds of at least 2; toxic texts are split in thirds by their share."""
    seen = np.zeros((2, buckets), np.int32)
    for (bucket, _, _), label in zip(rows, y):
        seen[label, bucket] += 1
    share = (seen + 0.5) / (np.array([[max(1, (y == c).sum())] for c in (0, 1)]) + 1)
    telling = (np.log(share[1] / share[0]) >= 2) & (seen[1] >= 5)
    density = np.array([n[telling[bucket]].sum() / max(1, words) for bucket, n, words in rows])
    toxic = density[y == 1]
    cuts = np.quantile(toxic, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(toxic) else np.zeros(GRADES - 2)
    return np.where(y == 1, 1 + np.searchsorted(cuts, density, side="left"), 0)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, epochs: int = 20, rate: float = 0.3, l2: float = 1e-4, seed: int = 7, totals: tuple[int, int] | None = None) -> OrdinalModel:
    """Adaptive gradient steps on the likelihood of the grades, one document a step.

    ``totals`` are the rows of either label that the sample is of: the thresholds are moved by the ratio of its odds to
    theirs, so that scores mean the same whether or not the sample's bounds were reached.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    rows = [counts(t or "", buckets) for t in texts]
    grade = grades(rows, y, buckets) if len(rows) else y
    use = telling(rows, y, buckets) if len(rows) else np.zeros(buckets, bool)
    x = [(bucket[use[bucket]], values(n, words)[use[bucket]]) for bucket, n, words in rows]
    w, w_sum = np.zeros(buckets, np.float32), np.full(buckets, 1e-6, np.float32)
    free, free_sum = np.array([1.0] + [0.0] * (GRADES - 2)), np.full(GRADES - 1, 1e-6)  # first threshold, logs of the gaps
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            bucket, value = x[i]
            gaps = np.exp(free[1:])
            theta = np.concatenate([free[:1], free[0] + np.cumsum(gaps)])
            z = float(w[bucket] @ value)
            _, by_z, by_theta = loss(theta, z, grade[i])
            by_free = np.concatenate([[by_theta.sum()], gaps * np.cumsum(by_theta[::-1])[::-1][1:]])
            step = np.float32(by_z) * value + np.float32(l2) * w[bucket]
            w_sum[bucket] += step * step
            w[bucket] -= np.float32(rate) * step / np.sqrt(w_sum[bucket])
            free_sum += by_free**2
            free -= rate * by_free / np.sqrt(free_sum)
    thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    if totals and min(totals) and 0 < y.sum() < len(y):
        thresholds = thresholds + np.log(y.sum() / (len(y) - y.sum())) - np.log(totals[1] / totals[0])
    return OrdinalModel(w, thresholds)


def loss(theta: np.ndarray, z: float, g: int) -> tuple[float, float, np.ndarray]:
    """Minus the log probability of grade g, and its derivatives by z and by each threshold."""
    below = np.concatenate([[0.0], 1 / (1 + np.exp(np.clip(z - theta, -30, 30))), [1.0]])  # P(grade < k)
    slope = below * (1 - below)
    p = max(below[g + 1] - below[g], 1e-9)
    by_theta = np.zeros(len(theta))
    if g < len(theta):
        by_theta[g] -= slope[g + 1] / p
    if g > 0:
        by_theta[g - 1] += slope[g] / p
    return -float(np.log(p)), float((slope[g + 1] - slope[g]) / p), by_theta


def logit(model: OrdinalModel, text: str) -> float:
    bucket, n, words = counts(text, len(model.weights))
    return float(model.weights[bucket] @ values(n, words)) if len(bucket) else -np.inf


def score_column(model: OrdinalModel) -> Column:
    """struct(severity, p_toxic) of column ``text``: whole texts; texts without words, and null ones, have severity 0."""

    def score(column):
        import pyarrow as pa

        z = [logit(model, text.as_py() or "") for text in column]
        return pa.StructArray.from_arrays([pa.array([model.severity(x) for x in z], pa.float64()), pa.array([model.toxic(x) for x in z], pa.float64())], ["severity", "p_toxic"])

    return F.arrow_udf(_annotated(score), "severity double, p_toxic double")(F.col("text"))


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> OrdinalModel:
    """Trained on at most ``per_class`` labelled rows of each label; without any, no text has a telling word."""
    rows, totals = fit(docs, labels, "toxic", per_class)
    return train([t for t, _ in rows], [y for _, y in rows], totals=totals)


def grade_documents(docs: DataFrame, model: OrdinalModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, severity (0 to 3), p_toxic and toxic (1 where p_toxic >= threshold) of every row.

    Texts without words and null ones have severity 0; texts of any length are graded whole; nulls and repeats of doc_id
    stay, repeated rows get the same; other columns are ignored; no rows give none.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", score_column(model).alias("s"))
    return scored.select("doc_id", "s.severity", "s.p_toxic", (F.col("s.p_toxic") >= threshold).cast("int").alias("toxic"))


def keep(docs: DataFrame, model: OrdinalModel, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't toxic, with all their columns, whatever they are named.

    Decided by the text alone: repeated rows and rows without doc_id go or stay alike, null, empty and wordless texts stay,
    texts of any length are graded whole; a probability equal to the threshold goes; no rows give none.
    """
    return docs.where(score_column(model)["p_toxic"] < threshold)
