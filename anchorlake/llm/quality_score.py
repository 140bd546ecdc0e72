"""Document quality by regularised quadratic discriminant analysis.

Each class of documents is a Gaussian over transformed statistics of the whole text. Its
covariance is shrunk towards the pooled one and towards the diagonal, and its Cholesky
factor is computed once; the score is the logistic of the difference of the two
log-densities, each a Mahalanobis distance and a log-determinant. Fitting needs only sums
over the labelled rows, which Spark adds up; nothing is sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import held_out, type_of
from anchorlake.llm.quality_rules import repeated_lines, repeated_words, stutters
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, range_hashes, sums, words_of
from anchorlake.session import cut_lineage

POOLED = 0.10     # weight of the pooled covariance in each class's
DIAGONAL = 0.05   # weight of the pooled variances alone
FLOOR = 1e-3      # least variance of a standardised statistic

_KINDS = {
    "symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".,;:",
    "marks": b"!?", "quotes": b"\"'()[]{}=_-/\\", "wide": bytes(range(128, 192)), "breaks": b"\n"}
STATISTICS = ["log_words", "chars_per_word", "distinct", "repeat", "dup_lines", "stutter", "bare_words",
              *_KINDS]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text: logs of sizes, square roots of shares."""
    words = words_of(data, offsets)
    hashes = range_hashes(data, words.start, words.end)
    n = np.diff(words.first)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda part, whole: np.sqrt(part / np.maximum(whole, 1))
    lines, dup = repeated_lines(data, offsets, words.start)
    own = np.unique(words.text.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))
    distinct = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=len(n))
    letters = np.zeros(256, dtype=bool)
    letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    lettered = np.concatenate([[0], np.cumsum(letters[data])])
    bare = lettered[words.end] == lettered[words.start]
    columns = [
        np.log1p(n), np.log1p(sums(words.end - words.start, words.first) / np.maximum(n, 1)),
        np.log(np.maximum(distinct, 1)) - 0.9 * np.log(np.maximum(n, 1)), share(repeated_words(hashes, words.first), n),
        share(dup, lines), share(stutters(hashes, words.first), n), share(sums(bare, words.first), n)]
    for kind in _KINDS.values():
        member = np.zeros(256, dtype=bool)
        member[list(kind)] = True
        columns.append(share(sums(member[data], offsets), size))
    return np.stack(columns, axis=1)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its vector of statistics; a null text has those of an empty one."""
    def measure(batches):
        for block, data, offsets in blocks(batches):
            rows = statistics(data, offsets)
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))],
                ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        measure, f"doc_id {type_of(docs, 'doc_id')}, x array<double>")


class Discriminant:
    """Two Gaussians with cached Cholesky factors, fitted from sums."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, products: np.ndarray):
        """``counts`` per class 0 and 1, sums of the vectors and of their outer products."""
        self.prior = np.log((counts + 1) / (counts.sum() + 2))
        mean = totals.sum(axis=0) / counts.sum()
        second = products.sum(axis=0) / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(second) - mean**2, 1e-12))
        self.center, self.scale = mean, scale
        size = len(mean)
        means = totals / counts[:, None]
        covariances = [
            (p / c - np.outer(m, m)) / np.outer(scale, scale)
            for p, c, m in zip(products, counts, means)]
        pooled = sum(c * s for c, s in zip(counts, covariances)) / counts.sum()
        self.means = (means - mean) / scale
        self.factors, self.log_dets = [], []
        for own in covariances:
            shrunk = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
            factor = np.linalg.cholesky(shrunk + FLOOR * np.eye(size))
            self.factors.append(np.linalg.inv(factor))
            self.log_dets.append(2 * np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        logs = [p - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                for p, m, f, d in zip(self.prior, self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))


def fit_discriminant(measured: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fit on the rows of ``measured`` that have a label; None unless both classes occur.

    Documents with contradicting labels teach nothing. What is collected is one number per
    class and entry of the sums, however many rows there are.
    """
    sure = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").drop("other")
    taught = measured.where(F.col("doc_id").isNotNull()).join(sure, "doc_id")
    size = len(STATISTICS)

    def add_up(batches):
        sums_of = {}
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, size)
            label = np.asarray(batch.column("label"))
            for k in (0, 1):
                own = x[label == k]
                entries = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
                sums_of[k] = sums_of.get(k, 0) + entries
        for k, entries in sums_of.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entries), k, dtype=np.int32)), pa.array(np.arange(len(entries), dtype=np.int32)),
                 pa.array(entries)], ["label", "entry", "total"])

    added = taught.select("x", F.col("label").cast("int").alias("label")).mapInArrow(
        add_up, "label int, entry int, total double").groupBy("label", "entry").agg(
        F.sum("total").alias("total")).toPandas()
    table = np.zeros((2, 1 + size + size * size))
    table[added["label"], added["entry"]] = added["total"]
    if (table[:, 0] == 0).any():
        return None
    return Discriminant(table[:, 0], table[:, 1:1 + size], table[:, 1 + size:].reshape(2, size, size))


def score_quality(measured: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted (1 from 0.5 on).

    Every row of ``measured`` gets its row. Without a model every score is 0.5.
    """
    def score(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            p = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return measured.select("doc_id", "x").mapInArrow(
        score, f"doc_id {type_of(measured, 'doc_id')}, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The model learns from labelled documents that are not held out; only the text decides a
    score, also of null and empty texts. Repeated rows give repeated rows, other columns are
    ignored, and an empty table gives an empty result.
    """
    measured = cut_lineage(text_statistics(docs))
    out = held_out(F.col("doc_id"))
    model = fit_discriminant(measured.where(~out), labels)
    return score_quality(measured, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op1_quality_score")
def op1(t):
    return quality_scores(t.documents, t.labels)
