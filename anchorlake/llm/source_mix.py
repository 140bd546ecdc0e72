"""Mixing sources to target weights by fitting subset sums to word budgets.

Every source has a target number of words. Whole copies of the source fill as much of it as
they can; the rest is a budget for a subset of its documents. The subset is chosen by length
alone: documents are counted by exact length, an even share of every length is taken first,
the longest lengths that still fit come next, and a bounded-knapsack program over the few
words left finds counts whose lengths sum to the budget. Which documents of a length are
taken is then a matter of a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake.llm.common import attach, cut_narrow, type_of
from anchorlake.llm.registry import query
from anchorlake.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 20240607
PROGRAM_WORDS = 1 << 22  # most words the exact program is tried with
CELLS = 1024          # hash ranges per source and length, for ranking without large groups


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    gaps = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.regexp_replace(gaps, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size and target from one row per source.

    Shares follow the weights of the sources in code point order, nulls last. A target may
    not exceed ``MAX_REPEATS`` times its source; what it may not take is shared out again by
    weight. That fixed point is found directly: sources are capped in order of
    size / weight, as long as the level the others would get is not below their cap.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    weighted = sources.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("at") % len(WEIGHTS) + 1).cast("double"))
    cap = (MAX_REPEATS * F.col("source_size")).cast("double")
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "at")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighted.withColumn("cap", cap).withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(rest))
    capped = F.col("cap") / F.col("weight") <= F.col("level")
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return levels.withColumn("final", level).select(
        "source", "source_size", "at",
        F.when(capped, F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``.

    All is divided by the lengths' greatest common divisor first; no sum lies between its
    multiples. The last words are left to the exact program, at first twice the longest length
    and more each time the budget is not met, up to all of it or ``PROGRAM_WORDS`` divisors.
    Where no choice gives the budget, the nearest sum below it that was found is taken.
    """
    best = np.zeros(len(lengths), dtype=np.int64)
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    counts = np.where(lengths <= budget, counts, 0)  # what is longer never fits
    if budget <= 0 or not counts.any():
        return best
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, budget = np.where(counts > 0, lengths, unit) // unit, budget // unit
    total, longest = int((lengths * counts).sum()), int(lengths.max())
    if budget >= total:
        return counts
    most = min(budget, max(PROGRAM_WORDS, 2 * longest))
    spare = min(2 * longest, budget)
    while True:
        take = np.floor(counts * ((budget - spare) / total)).astype(np.int64)
        left = budget - int((take * lengths).sum())
        for k in np.argsort(-lengths, kind="stable"):
            n = min(int(counts[k] - take[k]), max(0, left - spare) // int(lengths[k]))
            take[k] += n
            left -= n * int(lengths[k])
        take = take + _subset_sum(lengths, counts - take, left)
        if int((take * lengths).sum()) > int((best * lengths).sum()):
            best = take
        if int((best * lengths).sum()) == budget or spare >= most:
            return best
        spare = min(8 * spare, most)


def _subset_sum(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts up to ``free`` whose lengths sum nearest to ``budget`` from below.

    Sums reached so far are the bits of one number. Each length enters in chunks of 1, 2,
    4, ... documents, which cover every count up to its bound. Of the numbers on the way only
    every square-root-th is kept; the way back computes those between them once more.
    """
    chunks = []
    for k in np.argsort(lengths, kind="stable"):
        n, chunk = min(int(free[k]), budget // int(lengths[k])), 1
        while n > 0:
            chunks.append((int(k), min(chunk, n)))
            n, chunk = n - chunks[-1][1], chunk * 2
    mask, stride = (1 << (budget + 1)) - 1, max(1, math.isqrt(len(chunks)))
    with_chunk = lambda sums, c: (sums | sums << chunks[c][1] * int(lengths[chunks[c][0]])) & mask
    kept, sums, used = [], 1, 0
    while used < len(chunks) and not sums >> budget & 1:
        if used % stride == 0:
            kept.append(sums)
        sums, used = with_chunk(sums, used), used + 1
    at, out = sums.bit_length() - 1, np.zeros(len(lengths), dtype=np.int64)
    for first in range((used - 1) // stride * stride, -1, -stride) if used else ():
        own = [kept.pop()]
        for c in range(first, min(first + stride, used) - 1):
            own.append(with_chunk(own[-1], c))
        for c in range(first + len(own) - 1, first - 1, -1):
            if not own[c - first] >> at & 1:
                k, size = chunks[c]
                out[k] += size
                at -= size * int(lengths[k])
    return out


def _plan(groups: pd.DataFrame) -> pd.DataFrame:
    """Copies and picks for each length of one source; one row per distinct length."""
    source_size, target = int(groups["source_size"].iloc[0]), float(groups["target"].iloc[0])
    copies = min(MAX_REPEATS, int(target // source_size)) if source_size else 0
    budget = round(target) - copies * source_size if copies < MAX_REPEATS else 0
    lengths, counts = groups["size"].to_numpy(np.int64), groups["n"].to_numpy(np.int64)
    some = lengths > 0
    picks = np.zeros(len(lengths), dtype=np.int64)
    picks[some] = fit_budget(lengths[some], counts[some], budget)
    return groups.assign(copies=copies, picks=picks)[["source", "size", "copies", "picks"]]


def _measured(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """doc_id, source, size, a seeded draw with its hash cell, and ``more`` columns."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))
    return (docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), *more)
            .withColumn("cell", F.pmod("draw", F.lit(CELLS)).cast("int"))
            .withColumn("twin", F.monotonically_increasing_id()))


def mix_plan(sized: DataFrame, source_type: str) -> tuple[DataFrame, DataFrame]:
    """Targets per source, and per source and length how much of it the mix takes.

    Rows are taken in the order of a seeded hash: all hash cells up to ``whole``, and the
    first ``room`` rows of the cell ``edge``. ``sized`` is stored.
    """
    keys = ["source", "size"]
    lengths = cut_narrow(sized.groupBy(*keys).agg(F.count("*").alias("n")))
    goals = cut_narrow(targets(lengths.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    schema = f"source {source_type}, size long, copies int, picks long"
    plan = cut_narrow(attach(lengths, goals, ["source"]).groupBy("source").applyInPandas(_plan, schema))
    cells = sized.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("cell")) - F.col("n")
    bounds = cells.withColumn("before", before).join(
        plan.where("picks > 0").withColumnsRenamed({"source": "_s", "size": "_z"}),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    edge = bounds.where("before < picks and before + n > picks").select(
        *keys, F.col("cell").alias("edge"), (F.col("picks") - F.col("before")).alias("room"))
    whole = bounds.where("before + n <= picks").groupBy(*keys).agg(F.max("cell").alias("whole"))
    return goals, cut_narrow(
        plan.alias("p").join(whole.alias("w"), F.expr("p.source <=> w.source and p.size = w.size"), "left")
        .join(edge.alias("e"), F.expr("p.source <=> e.source and p.size = e.size"), "left")
        .selectExpr("p.source", "p.size", "p.copies", "w.whole", "e.edge", "e.room"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``times``, how often the mix takes each.

    Whole hash cells are taken or left by the plan alone; only the cell in which the last
    pick lies is ranked row by row, so a length that holds a third of all rows never meets
    in one task.
    """
    rows = attach(rows, plan, ["source", "size"])
    inside = F.col("cell") == F.col("edge")
    rank = F.row_number().over(W.partitionBy("source", "size", "cell").orderBy("draw", "doc_id", "twin"))
    ranked = rows.where(inside).withColumn("rank", rank).withColumn(
        "pick", F.col("rank") <= F.col("room")).drop("rank")
    others = rows.where(F.coalesce(~inside, F.lit(True))).withColumn(
        "pick", F.coalesce(F.col("cell") <= F.col("whole"), F.lit(False)))
    return ranked.unionByName(others).withColumn("times", F.col("copies") + F.col("pick").cast("int"))


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken words.

    A document is taken as often as its source is copied whole, and once more if it is
    picked; taken is that many times its size, never over ``MAX_REPEATS`` times. Null texts
    and texts without words have size 0 and are never picked. Null sources form one source,
    the last in order. Of rows with equal id and text either may be picked, with the same
    result. Other columns are ignored; an empty table gives an empty result.
    """
    sized = cut_lineage(_measured(docs, seed))
    goals, plan = mix_plan(sized, type_of(docs, "source"))
    return attach(_taken(sized, plan), goals, ["source"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix with all their columns, each as often as the mix takes it.

    Documents without words go, except where their source is copied whole.
    """
    _, plan = mix_plan(cut_lineage(_measured(docs, seed)), type_of(docs, "source"))
    rows = _taken(_measured(docs.withColumn("row", F.struct("*")), seed, "row"), plan).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("_n")).select("row.*")


@query("op2_source_mix")
def op2(t):
    return mix_sources(t.documents)
