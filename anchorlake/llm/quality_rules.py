"""Quality rules whose thresholds come from the data of each language and source.

Every document gets a few whole-text measures. Their distribution per language and source is
kept as a sketch with geometric buckets: a count per bucket, so sketches merge by adding
counts, in any order and with the same result, and every quantile is right to one per cent of
its value. A document is rejected where a measure lies beyond the far fence of its own group
(upper quartile plus three interquartile ranges plus a margin for short texts).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake.llm.common import attach, cut_narrow, type_of
from anchorlake.llm.registry import query
from anchorlake.llm.textblocks import blocks, range_hashes, sums, window_hashes, windows, words_of
from anchorlake.session import cut_lineage

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PRIOR = 20            # documents of the next wider group that count beside those of a group
FENCE = 3.0
ACCURACY = 0.01
# measure -> (margin, more margin per square root of the words)
MEASURES = {
    "symbols_per_word": (0.10, 1.0),
    "chars_per_word": (0.50, 12.0),
    "upper_share": (0.08, 1.0),
    "dup_line_share": (0.30, 1.5),
    "repeat_share": (0.20, 1.0),
    "stutter_share": (0.10, 0.5),
}
_GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
_ZERO = -100_000      # the bucket of values too small to matter
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
           "n_stutters"]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a"):ord("z") + 1] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once?"""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[near] == keys


def _in_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes told apart by text; a block has at most 256 texts."""
    return text.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text inside windows of ``size`` words found twice or more in it."""
    at, text = windows(first, size)
    again = at[_repeated(_in_text(text, window_hashes(hashes, at, size)))] if len(at) else at
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    return sums(np.cumsum(change[:-1]) > 0, first)


def stutters(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that repeat the word right before them."""
    at, _ = windows(first, 2)
    same = np.zeros(len(hashes), dtype=bool)
    same[at] = hashes[at] == hashes[at + 1]
    return sums(same, first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple:
    """Lines with a word of each text, and how many of them equal an earlier line."""
    breaks = np.flatnonzero(data == 0x0A)
    texts = len(offsets) - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    own_end = offsets[1:][owner]
    following = np.append(start[1:] - 1, 0)
    end = np.where(np.append(owner[1:] == owner[:-1], False), following, own_end)
    worded = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, start)
    start, end, owner = start[worded], end[worded], owner[worded]
    lines = np.bincount(owner, minlength=texts)
    distinct = np.unique(_in_text(owner, range_hashes(data, start, end)))
    return lines, lines - np.bincount((distinct >> np.uint64(56)).astype(np.int64), minlength=texts)


def text_measures(docs: DataFrame, carried: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The carried columns and the whole-text counts of every document.

    A carried ``row`` holds the text, which then does not go to the tasks a second time.
    """
    inside = "row" in carried and dict(docs.select("row.*").dtypes).get("text") == "string"

    def measure(batches):
        for block, data, offsets in blocks(batches, "row.text" if inside else "_text"):
            words = words_of(data, offsets)
            hashes = range_hashes(data, words.start, words.end)
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            lines, dup_lines = repeated_lines(data, offsets, words.start)
            counts = [
                np.diff(words.first), sums(leads[words.end] - leads[words.start], words.first),
                sums(_SYMBOL[data], offsets), dup_lines, repeated_words(hashes, words.first),
                lines, sums(_UPPER[data], offsets), sums(_LETTER[data], offsets),
                stutters(hashes, words.first)]
            yield pa.RecordBatch.from_arrays(
                [block.column(c) for c in carried] + [pa.array(c.astype(np.int64)) for c in counts],
                [*carried, *_COUNTS])

    text = [] if inside else [F.col("text").cast("string").alias("_text")]
    return docs.select(*carried, *text).mapInArrow(
        measure, ", ".join([*(f"{c} {type_of(docs, c)}" for c in carried), *(f"{c} long" for c in _COUNTS)]))


def _values() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": share("n_symbols", "n_words"), "chars_per_word": share("word_chars", "n_words"),
        "upper_share": share("n_upper", "n_letters"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "stutter_share": share("n_stutters", "n_words")}


def sketches(measured: DataFrame) -> DataFrame:
    """Documents per language, source, measure and bucket; only texts with words count."""
    entry = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value"))
                                for m, v in _values().items()]))
    bucket = F.when(F.col("e.value") < 1e-6, _ZERO).otherwise(
        F.ceil(F.log("e.value") / math.log(_GROWTH)).cast("int"))
    return (measured.where("n_words > 0").select("lang", "source", entry.alias("e"))
            .groupBy("lang", "source", F.col("e.measure").alias("measure"), bucket.alias("bucket"))
            .agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Size and both quartiles of every measure for each key, in one row per key."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    part = W.partitionBy(*keys, "measure")
    upto = F.sum("n").over(part.orderBy("bucket"))
    ranked = merged.select(*keys, "measure", "bucket", upto.alias("upto"), F.sum("n").over(part).alias("total"))
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(
        2 * F.pow(F.lit(_GROWTH), F.col("bucket")) / (_GROWTH + 1))
    at = lambda q, m: F.min(F.when((F.col("upto") >= q * F.col("total")) & (F.col("measure") == m), value))
    return ranked.groupBy(*keys).agg(
        F.max("total").alias(f"{prefix}_size"),
        *[at(q, m).alias(f"{prefix}_{m}_{name}") for m in MEASURES for q, name in ((0.25, "low"), (0.75, "high"))])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and both quartiles of every measure.

    A group's quartiles are averaged with those of its language, which count as ``PRIOR``
    documents, and a language's in the same way with those of all documents. So small groups
    lean on wider ones, and the lean fades with size without a step.
    """
    own = _quartiles(sketch, ["lang", "source"], "own")
    language = _quartiles(sketch, ["lang"], "lang").withColumnRenamed("lang", "_lang")
    everything = _quartiles(sketch, [], "all")
    joined = own.join(language, own["lang"].eqNullSafe(language["_lang"])).crossJoin(F.broadcast(everything))

    def leaning(group: str, wider: Column, name: str) -> Column:
        size = F.col(f"{group}_size")
        return (size * F.col(f"{group}_{name}") + PRIOR * wider) / (size + PRIOR)

    blended = lambda name: leaning("own", leaning("lang", F.col(f"all_{name}"), name), name)
    return joined.select("lang", "source", *[
        blended(f"{m}_{q}").alias(f"{m}_{q}") for m in MEASURES for q in ("low", "high")])


def group_limits(measured: DataFrame) -> DataFrame:
    """The stored thresholds of every language and source in ``measured``."""
    return cut_narrow(thresholds(cut_narrow(sketches(measured))))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed, out_of_range (the measures beyond their fence) and kept."""
    out = []
    for name, value in _values().items():
        margin, more = MEASURES[name]
        spread = F.col(f"{name}_high") - F.col(f"{name}_low")
        room = FENCE * spread + margin + more / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
        beyond = value > F.col(f"{name}_high") + room
        if name == "chars_per_word":
            beyond = beyond | (value < F.col(f"{name}_low") - room)
        out.append(F.when(beyond, F.lit(name)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return attach(measured, limits, ["lang", "source"]).withColumn("base_failed", failed).withColumn(
        "out_of_range", F.array_compact(F.array(*out))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("out_of_range") == 0))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the measures out of range.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored. A null or empty
    text has no words, so it fails the base rule. Null languages and sources form groups of
    their own. Repeated rows each get their row; an empty table gives an empty result.
    """
    measured = cut_lineage(text_measures(docs))
    return judged(measured, group_limits(measured)).select(
        "doc_id", *_COUNTS[:5], "base_failed", "kept", "out_of_range")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns.

    Only the thresholds are stored; every text is measured again where it lies, so no text
    is shuffled and rows with equal or null ids are judged by their own text.
    """
    limits = group_limits(text_measures(docs, ("lang", "source")))
    whole = docs.select(F.struct("*").alias("row"), "lang", "source", "text")
    return judged(text_measures(whole, ("row", "lang", "source")), limits).where("kept").select("row.*")


@query("op4_quality_rules")
def op4(t):
    return quality_rules(t.documents)
