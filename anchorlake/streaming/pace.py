"""Pacing as keyed state: one value per host, read and written only when the host answers.

The rows of a micro-batch are dealt by host and time cell, so a host that owns a third of
them is spread over all tasks. Each cell is folded into one segment: the clamped linear map
its responses have together, and the few maps that can make its highest delay. A host's state
then takes its segments in time order, one step per cell; those of a batch come as one row, as
each call and each row that Python reads beside its state costs far more than a step.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from anchorlake.config import AuditConfig
from anchorlake.operators.pacing import IDENTITY, Pace, apply, compose

STATE = "delay double, peak double, pushbacks long, responses long"
PACED = f"host string, {STATE}"
SEGMENT = "host string, cell long, path array<double>, pushbacks long, responses long, last double"
CELL_SECONDS = 3600  # a host that answers once a second puts as many responses into one fold
ROWS_SENT = 4096  # in one Arrow batch


def keep_highest(highest: list[tuple], step: tuple) -> list[tuple]:
    """The maps of which one gives the highest value, whatever they start from."""
    covers = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[2] >= b[2]
    if any(covers(old, step) for old in highest):
        return highest
    return [old for old in highest if not covers(step, old)] + [step]


def fold(statuses, retries, pace: Pace) -> tuple[tuple, list[tuple], int]:
    """What responses in a row do to a delay: the map, the maps for its highest value, the pushbacks."""
    total, highest, pushed = IDENTITY, [], 0
    for status, retry in zip(statuses, retries):
        step = pace.step(status, retry)
        if step:
            total = compose(total, step)
            highest = keep_highest(highest, total)
            pushed += step[0] == 2.0
    return total, highest, pushed


def flat(total: tuple, highest: list[tuple]) -> list[float]:
    """A segment as numbers: its map, how many maps its highest delay may come from, and those."""
    return [*total, float(len(highest)), *(x for h in highest for x in h)] if highest else []


def walk(path: list[float], delay: float) -> tuple[float, float]:
    """The delay after the segments of ``path``, one after the other, and the highest in between."""
    at, peak = 0, 0.0
    while at < len(path):
        start, end = at + 4, at + 4 + 3 * int(path[at + 3])
        peak = max(peak, *(apply(path[k:k + 3], delay) for k in range(start, end, 3)))
        delay, at = apply(path[at:at + 3], delay), end
    return delay, peak


def _of_task(batches: Iterator[pa.RecordBatch], order: list[str], by: list[str]) -> tuple[pa.Table, np.ndarray] | None:
    """A task's share of one micro-batch in order, and where its groups start."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    part = pa.Table.from_batches(held)
    keys = part.select(order).to_pandas().sort_values(order, kind="stable")
    first = np.flatnonzero((keys[by] != keys[by].shift()).any(axis=1).to_numpy())
    return part.take(pa.array(keys.index.to_numpy())).combine_chunks(), first


def segments(responses: DataFrame, pace: Pace, seconds: int = CELL_SECONDS) -> DataFrame:
    """One row per host and time cell of a batch of (host, ts, seq, status, retry_after)."""
    rows = responses.where(F.coalesce("host", F.lit("")) != "").select(
        "host", F.floor(F.col("ts").cast("double") / seconds).cast("long").alias("cell"),
        F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"),
        F.col("status").cast("double").alias("status"), F.col("retry_after").cast("double").alias("retry_after"))

    def folded(batches: Iterator[pa.RecordBatch]):
        found = _of_task(batches, ["host", "cell", "ts", "seq"], ["host", "cell"])
        if found is None:
            return
        part, first = found
        ends = np.append(first[1:], len(part))
        status, retry = part["status"].to_pylist(), part["retry_after"].to_pylist()
        folds = [fold(status[a:b], retry[a:b], pace) for a, b in zip(first.tolist(), ends.tolist())]
        yield from part.select(["host", "cell"]).take(pa.array(first)).append_column(
            "path", pa.array([flat(total, highest) for total, highest, _ in folds], pa.list_(pa.float64()))).append_column(
            "pushbacks", pa.array([pushed for *_, pushed in folds], pa.int64())).append_column(
            "responses", pa.array(ends - first)).append_column(
            "last", part["ts"].take(pa.array(ends - 1))).to_batches(ROWS_SENT)

    return rows.repartition("host", "cell").mapInArrow(folded, SEGMENT)


def joined(cells: DataFrame) -> DataFrame:
    """All segments of a host in a batch as one row: their paths one after the other, none composed."""
    def chained(batches: Iterator[pa.RecordBatch]):
        found = _of_task(batches, ["host", "cell"], ["host"])
        if found is None:
            return
        part, first = found
        paths = part["path"].combine_chunks()
        offsets = paths.offsets.take(pa.array(np.append(first, len(part))))
        over = lambda f, c: pa.array(f.reduceat(part[c].to_numpy(), first))
        yield from part.select(["host", "cell"]).take(pa.array(first)).append_column(
            "path", pa.ListArray.from_arrays(offsets, paths.values)).append_column(
            "pushbacks", over(np.add, "pushbacks")).append_column(
            "responses", over(np.add, "responses")).append_column(
            "last", over(np.fmax, "last")).to_batches(ROWS_SENT)

    return cells.repartition("host").mapInArrow(chained, SEGMENT)


class HostPace(StatefulProcessor):
    """The delay of one host; with ``idle`` seconds, a timer lets it recover while nothing comes."""

    def __init__(self, pace: Pace, idle: float | None):
        self.pace, self.idle = pace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pace", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        delay, peak, pushed, seen = self.state.get() or (self.pace.base, 0.0, 0, 0)
        cells = sorted(rows, key=lambda s: (s.cell is None, s.cell))
        for s in cells:
            delay, top = walk(s.path, delay)
            peak = max(peak, top) if top > self.pace.base else peak
            pushed, seen = pushed + s.pushbacks, seen + s.responses
        yield self._kept(key, delay, peak, pushed, seen, max((s.last for s in cells if s.last is not None), default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        delay, peak, pushed, seen = self.state.get()
        due, now = (x / 1000 for x in (expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        spells = int((now - due) // self.idle) + 1
        delay = max(self.pace.base, delay * self.pace.recover ** spells)
        yield self._kept(key, delay, peak, pushed, seen, due + (spells - 1) * self.idle)

    def _kept(self, key, delay, peak, pushed, seen, last: float | None) -> Row:
        """Store the state; a timer runs only while there is something to recover from."""
        self.state.update((float(delay), float(peak), int(pushed), int(seen)))
        if self.idle is not None:
            for due in self.handle.listTimers():
                self.handle.deleteTimer(due)
            if delay > self.pace.base:
                self.handle.registerTimer(int((last + self.idle) * 1000))
        return Row(host=key[0], delay=float(delay), peak=float(peak), pushbacks=int(pushed), responses=int(seen))

    def close(self) -> None:
        pass


def paced(responses: DataFrame, cfg: AuditConfig, idle: float | None = None) -> DataFrame:
    """The new state of every host that answered, or whose timer ran out, in a micro-batch."""
    pace = Pace.of(cfg)
    cells = segments(responses, pace)
    if idle is None:
        cells = joined(cells)
    else:  # cells apart, as each may be late by itself
        cells = cells.withColumn("at", F.timestamp_seconds("last")).withWatermark("at", f"{idle} seconds")
    return cells.groupBy("host").transformWithState(
        HostPace(pace, idle), PACED, "Update", "None" if idle is None else "EventTime")
