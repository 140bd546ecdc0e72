"""Structured Streaming jobs: pacing, progressive audits, URL dedup, change alerts.

State that a later batch needs lives in the state store or, for audited pages, in a keyed
result store; no job reads all it has written before.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from anchorlake.config import AuditConfig
from anchorlake.functions.urls import normalize_url
from anchorlake.operators.rundiff import changes, compared
from anchorlake.streaming.pace import PACED, paced
from anchorlake.streaming.results import ResultStore


def pacing_stream(
    responses: DataFrame, cfg: AuditConfig, path: str, checkpoint: str, idle: float | None = None
) -> DataStreamWriter:
    """Recommended delay per host from a stream of (host, ts, seq, status, retry_after).

    Each micro-batch reads and writes the state of its own hosts only, and writes their new
    values to a folder of its own under ``path``, which a retried batch overwrites. Responses
    count in time order within a batch, batches as they come. With ``idle``, a host that is
    silent for so many seconds of the stream's own time recovers as with one good answer, and
    responses that come more than ``idle`` seconds behind the newest one are dropped.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return paced(responses, cfg, idle).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint)


def latest_pacing(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of every host seen so far, read from the state store of ``pacing_stream``."""
    state = spark.read.format("statestore").option("stateVarName", "pace").load(checkpoint)
    return state.select("key.host", "value.*").select(*[c.split(" ")[0] for c in PACED.split(", ")])


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each URL once per Arrow batch, so that a very frequent one is hardly shuffled."""
    for batch in batches:
        yield batch.drop_duplicates("url")


def unique_urls(
    urls: DataFrame, path: str, checkpoint: str, seen_at: str | None = None, keep_for: str | None = None
) -> DataStreamWriter:
    """Each normalised URL once, on its first arrival, appended to Parquet files under ``path``.

    The URLs found are keys of the state store, so a batch costs what it holds, not what was
    seen before. They are kept for ever; or, with an event-time column ``seen_at``, until the
    watermark is ``keep_for`` (such as "30 days") past a URL's first arrival: a URL that comes
    back after that is written once more, and a row older than the watermark is dropped.
    """
    clean = urls.withColumn("url", normalize_url(F.col("url"))).where(F.col("url") != "")
    if keep_for is None:
        found = clean.select("url").mapInPandas(_thinned, "url string").dropDuplicates(["url"])
    else:
        timed = clean.select("url", F.col(seen_at).alias("seen_at")).withWatermark("seen_at", keep_for)
        found = timed.dropDuplicatesWithinWatermark(["url"]).select("url")
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def incremental_audit(
    pages: DataFrame, audit: Callable[[DataFrame], DataFrame], store: ResultStore, checkpoint: str,
    now: Column | None = None,
) -> DataStreamWriter:
    """Audit page files as they arrive; pages with a fresh result in ``store`` are skipped.

    Every micro-batch is an anti join of its pages with the fresh keys, an audit of the rest,
    and one write into the store. The checkpoint gives resume for files already read, the
    store for pages that come again in other files, also to another stream. A batch that is
    retried after a failure overwrites its own rows, so none are lost or doubled. Of equal
    keys in one batch one is audited.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        at = now if now is not None else F.current_timestamp()
        todo = store.without_fresh(batch, at, before=batch_id).dropDuplicates([store.key])
        store.put(audit(todo), at, batch_id)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def change_alerts(rows: DataFrame, late: str = "1 second", delta: float = 10.0) -> DataFrame:
    """A stream of all changes from each run to the next, removed URLs included.

    ``rows`` has one row per URL and run, with ``run_at``, the time of its run, and
    ``prev_run_at``, that of the run before it (``rundiff.stamped`` finds it). Every row is
    joined to those of the next run: a full outer join of the stream with itself, in which a
    URL without partner is reported once the run is closed, and rows that come later than that
    are dropped. A run is closed by the first row of a run more than ``late`` after it, or by its
    closing row (``rundiff.closing``); ``late`` must be positive, as the newest run is still on
    its way. The first run has nothing to be compared with.
    """
    url = F.coalesce("url", F.lit(""))
    facts = F.when(url != "", compared(rows))  # a closing row has none; it only moves both watermarks
    was = rows.select(url.alias("was_url"), F.col("run_at").alias("was_at"), facts.alias("a"))
    now = rows.where(F.col("prev_run_at").isNotNull()).select(
        url.alias("now_url"), F.col("prev_run_at").alias("since"), facts.alias("b"))
    both = was.withWatermark("was_at", late).join(
        now.withWatermark("since", late), F.expr("was_url = now_url AND was_at = since"), "full_outer")
    paired = both.where(F.coalesce("was_url", "now_url") != "").select(
        F.coalesce("was_url", "now_url").alias("url"), F.coalesce("since", "was_at").alias("since"), "a", "b")
    return changes(paired, delta, "since")
