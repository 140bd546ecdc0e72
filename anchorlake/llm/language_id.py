"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text becomes a vector of hashed letter n-grams (runs of one to three bytes of lower-cased
words), weighted by log tf and idf and scaled to length one. Each language is described by a
few centroids, found by spherical k-means over a bounded sample of its labelled documents;
document frequencies are counted over all of them.
The prediction is the language of the centroid with the largest cosine; a text whose cosine
stays below what nearly all of that language's own sample reaches counts as rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import held_out, type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, mix
from anchorlake.session import cut_lineage

DIMENSIONS = 1 << 12
GRAMS = 3
SAMPLE = 600          # labelled documents per language the model is fitted on, on average
CENTROIDS = 3
ROUNDS = 12
REJECT_SHARE = 0.001  # share of a language's sample that lies below its rejection limit
SEED = 20240607

# Bytes as letters: ASCII letters in lower case, every byte of other characters as itself,
# anything else as a space.
_LETTER = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _LETTER[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 0


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, one row per text; n-grams do not cross a text's bounds."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    letters = _LETTER[data]
    out = np.zeros(texts * DIMENSIONS, dtype=np.float32)
    code = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, GRAMS + 1):
        count = len(data) - n + 1
        if count <= 0:
            break
        code = code[:count] * np.uint64(257) + letters[n - 1:] + np.uint64(1)
        keep = owner[:count] == owner[n - 1:]
        keep &= letters[:count] + letters[n - 1:] > 0
        cell = (mix(code[keep] + np.uint64(n << 40)) >> np.uint64(64 - 12)).astype(np.int64)
        out += np.bincount(owner[:count][keep] * DIMENSIONS + cell, minlength=len(out)).astype(np.float32)
    return out.reshape(texts, DIMENSIONS)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))


def sample_counts(docs: DataFrame, size: int) -> DataFrame:
    """Counts of about ``size`` documents per language, drawn by a hash of id and text."""
    rows = _text(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = rows.groupBy("lang").agg((F.lit(float(size)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text")), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches):
        for block, data, offsets in blocks(batches):
            counts = gram_counts(data, offsets)
            row, cell = np.nonzero(counts)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("lang"), pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[row, cell].astype(np.int32)))],
                ["lang", "cells", "counts"])

    return drawn.mapInArrow(count, "lang string, cells array<int>, counts array<int>")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many labelled documents each n-gram cell occurs, and how many there are."""
    def count(batches):
        total, texts = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for _, data, offsets in blocks(batches):
            total += (gram_counts(data, offsets) > 0).sum(axis=0)
            texts += len(offsets) - 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], texts))], ["cell", "n"])

    rows = _text(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text")
    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    seen = sums.toPandas()  # at most DIMENSIONS + 1 rows
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    cells = seen[seen["cell"] >= 0]
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out, int(seen.loc[seen["cell"] < 0, "n"].sum())


def _dense(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for k, (cells, counts) in enumerate(zip(rows["cells"], rows["counts"])):
        out[k, cells] = counts
    return out


def _fit_language(idf: np.ndarray, centroids: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over the sample of one language; its size is bounded."""
        rows = rows.assign(order=[hash((tuple(c), tuple(n))) for c, n in zip(rows["cells"], rows["counts"])])
        vectors = _weigh(_dense(rows.sort_values("order")), idf)
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centroid": [], "limit": []})
        random = np.random.default_rng(SEED)
        seeds = [int(random.integers(len(vectors)))]
        while len(seeds) < min(centroids, len(vectors)):  # the next seed is the farthest text
            seeds.append(int(np.argmin((vectors @ vectors[seeds].T).max(axis=1))))
        centers = vectors[seeds]
        for _ in range(ROUNDS):
            nearest = np.argmax(vectors @ centers.T, axis=1)
            centers = _unit(np.stack([
                vectors[nearest == k].sum(axis=0) if (nearest == k).any() else centers[k]
                for k in range(len(centers))]))
        limit = float(np.quantile((vectors @ centers.T).max(axis=1), REJECT_SHARE))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.tolist() for c in centers], "limit": limit})

    return fit


class LanguageModel:
    """idf per n-gram cell, and per centroid its language and rejection limit."""

    def __init__(self, idf, langs, centers, limits):
        self.idf, self.langs, self.centers, self.limits = idf, langs, centers, limits

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        vectors = _weigh(gram_counts(data, offsets), self.idf)
        cosines = vectors @ self.centers.T
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return self.langs[best], score, score < self.limits[best]


def fit_languages(docs: DataFrame, size: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel | None:
    """Learn from text and lang of ``docs``; None where there is nothing to learn from.

    What reaches the driver is bounded by the model: a number per n-gram cell and a few
    centroids per language. Each language's sample is fitted in a task of its own.
    """
    sample = cut_lineage(sample_counts(docs, size))
    frequency, texts = document_frequencies(docs)
    if not texts:
        return None
    idf = np.log((1 + texts) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    fitted = sample.groupBy("lang").applyInPandas(
        _fit_language(idf, centroids), "lang string, centroid array<float>, limit double").toPandas()
    fitted = fitted.sort_values(["lang"], kind="stable")
    if fitted.empty:
        return None
    return LanguageModel(idf, fitted["lang"].to_numpy(object), np.stack(fitted["centroid"]).astype(np.float32),
                         fitted["limit"].to_numpy())


def identify_languages(docs: DataFrame, model: LanguageModel | None, reject: bool = False) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (cosine, 0 to 1) and rejected.

    lang_pred is ``und`` and score 0 for a null text or one without any letter, and for
    every text if there is no model. A text farther from its nearest centroid than nearly
    all of that language is marked rejected, and with ``reject`` also predicted ``und``.
    Repeated rows give repeated rows; other columns are ignored.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")

    def predict(batches):
        for block, data, offsets in blocks(batches):
            known = block.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if model is None:
                langs, score, odd = np.full(len(known), "und", object), np.zeros(len(known)), np.ones(len(known), bool)
            else:
                langs, score, odd = model.predict(data, offsets)
            langs = np.where(known & ~(odd & reject), langs, "und")
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(langs.tolist(), pa.string()),
                 pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array(odd | ~known)],
                ["doc_id", "lang_pred", "score", "rejected"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("*", lettered)
    return texts.mapInArrow(predict, f"doc_id {type_of(docs, 'doc_id')}, lang_pred string, score double, rejected boolean")


@query("op5_language_id")
def op5(t):
    model = fit_languages(t.documents.where(~held_out(F.col("doc_id"))))
    return identify_languages(t.documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
