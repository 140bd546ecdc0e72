"""Recommended request delay per host from its responses.

Each response changes a host's delay by a clamped linear step: a pushback doubles it
within limits, a healthy answer relaxes it towards the base. Such steps compose into
one clamped linear step, so a host's history can be cut anywhere: segments are
composed in parallel, the start delay of each segment follows, and only then are the
delays themselves replayed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators.keyed import Ordered, lookup


@dataclass(frozen=True)
class Pace:
    base: float
    ceiling: float
    recover: float

    @classmethod
    def of(cls, cfg: AuditConfig) -> "Pace":
        base = max(0.0, cfg.delay_per_host)
        return cls(base, max(base, cfg.max_delay_per_host), min(max(cfg.backoff_recover, 0.1), 0.99))

    def step(self, status, retry_after) -> tuple[float, float, float] | None:
        """The response's effect as (slope, low, high), or None if it has none."""
        if status is None or status != status:
            return None
        if status in (429, 503):
            low = max(self.base, 1.0) * 2
            if retry_after is not None and retry_after == retry_after:
                low = max(low, min(float(retry_after), self.ceiling))
            return 2.0, min(low, self.ceiling), self.ceiling
        if 200 <= status < 400:
            return self.recover, self.base, self.ceiling
        return None


def apply(step: tuple[float, float, float], delay: float) -> float:
    slope, low, high = step
    return min(max(slope * delay, low), high)


def compose(first: tuple[float, float, float], then: tuple[float, float, float]):
    """One step with the effect of two."""
    return first[0] * then[0], apply(then, first[1]), apply(then, first[2])


IDENTITY = (1.0, 0.0, float("inf"))


def _segments(batches: Iterator[pd.DataFrame]):
    """Consecutive rows of one (range, host), across batch borders."""
    for batch in batches:
        for key, rows in batch.groupby(["_range", "host"], sort=False):
            yield key, rows


def pacing_batch(
    responses: DataFrame, cfg: AuditConfig, seq: str = "seq", before: DataFrame | None = None
) -> DataFrame:
    """Per host: current delay, peak delay, pushbacks and responses.

    ``responses`` has host, ts, status, retry_after and a unique ``seq`` that orders
    equal timestamps. ``before`` is the result for all earlier responses, to go on from.
    """
    pace = Pace.of(cfg)
    rows = responses.where(F.coalesce("host", F.lit("")) != "").select(
        "host", "ts", F.col(seq).alias("seq"), F.col("status").cast("double").alias("status"),
        F.col("retry_after").cast("double").alias("retry_after"))
    if before is None:
        rows = rows.withColumn("_from", F.lit(pace.base))
    else:
        rows = lookup(rows, before.select("host", F.col("delay").alias("_from")), "host").withColumn(
            "_from", F.coalesce("_from", F.lit(pace.base)))
    ordered = Ordered(rows, [F.col("host"), F.col("ts"), F.col("seq")])

    def composed(batches):
        at, total, begun, names = None, IDENTITY, pace.base, ["range", "host", "m", "lo", "hi", "begun"]
        for key, part in _segments(batches):
            if key != at:
                if at is not None:
                    yield pd.DataFrame([(*at, *total, begun)], columns=names)
                at, total, begun = key, IDENTITY, part["_from"].iloc[0]
            for status, retry in zip(part["status"].to_numpy(), part["retry_after"].to_numpy()):
                step = pace.step(status, retry)
                if step:
                    total = compose(total, step)
        if at is not None:
            yield pd.DataFrame([(*at, *total, begun)], columns=names)

    def starts(segments: pd.DataFrame) -> pd.DataFrame:
        out, delay = [], segments["begun"].iloc[0]
        for s in segments.sort_values("range").itertuples():
            out.append((s.range, s.host, delay))
            delay = apply((s.m, s.lo, s.hi), delay)
        return pd.DataFrame(out, columns=["_range", "host", "_start"])

    # hosts cut by a range border: at most one per border, with at most one segment per range
    spans = ordered.rows.groupBy("host").agg(
        (F.min("_range") != F.max("_range")).alias("cut")).where("cut").select("host")
    cut_rows = ordered.rows.join(F.broadcast(spans), "host", "left_semi")
    first_delays = cut_rows.sortWithinPartitions("_range", "host", "ts", "seq").select(
        "_range", "host", "status", "retry_after", "_from").mapInPandas(
            composed, "range int, host string, m double, lo double, hi double, begun double"
        ).groupBy("host").applyInPandas(starts, "_range int, host string, _start double")

    def replay(batches):
        at, delay, peak, pushed, seen = None, 0.0, 0.0, 0, 0
        names = ["range", "host", "delay", "peak", "pushbacks", "responses"]
        for key, part in _segments(batches):
            if key != at:
                if at is not None:
                    yield pd.DataFrame([(*at, delay, peak, pushed, seen)], columns=names)
                start = part["_start"].iloc[0]
                delay = part["_from"].iloc[0] if start != start or start is None else start
                at, peak, pushed, seen = key, 0.0, 0, 0
            seen += len(part)
            for status, retry in zip(part["status"].to_numpy(), part["retry_after"].to_numpy()):
                step = pace.step(status, retry)
                if step:
                    pushed += step[0] == 2.0
                    delay = apply(step, delay)
                    if delay > pace.base and delay > peak:
                        peak = delay
        if at is not None:
            yield pd.DataFrame([(*at, delay, peak, pushed, seen)], columns=names)

    replayed = ordered.rows.join(F.broadcast(first_delays), ["_range", "host"], "left") \
        .sortWithinPartitions("_range", "host", "ts", "seq").select(
            "_range", "host", "status", "retry_after", "_from", "_start").mapInPandas(
                replay, "range int, host string, delay double, peak double, pushbacks long, responses long")
    paced = replayed.groupBy("host").agg(
        F.max_by("delay", "range").alias("delay"), F.max("peak").alias("peak"),
        F.sum("pushbacks").alias("pushbacks"), F.sum("responses").alias("responses"))
    if before is None:
        return paced
    both = paced.alias("n").join(before.alias("b"), "host", "full_outer")
    total = lambda c: (F.coalesce(f"n.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c)
    return both.select("host", F.coalesce("n.delay", "b.delay").alias("delay"),
                       F.greatest("n.peak", "b.peak").alias("peak"), total("pushbacks"), total("responses"))


def pacing_stats(paced: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Totals over hosts: pushbacks, throttled hosts, worst delay."""
    return paced.agg(
        F.sum("pushbacks").alias("pushback_responses"),
        F.count_if(F.col("peak") > 0).alias("throttled_hosts"),
        F.bround(F.greatest(F.max("peak"), F.lit(Pace.of(cfg).base)), 1).alias("worst_delay"))


def slowest_hosts(paced: DataFrame, limit: int = 8) -> DataFrame:
    return paced.where(F.col("peak") > 0).orderBy(F.desc("peak"), "host").limit(limit)
