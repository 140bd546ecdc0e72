"""Queries that run the streaming jobs over the given tables until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as X
from anchorlake.operators import links, pages, rundiff
from anchorlake.plans.q_audit import _diff_sql, _runs
from anchorlake.plans.q_pages import _FOUND, _WORDS, CFG
from anchorlake.plans.q_status import PACE_CFG, _RESPONSE, _split_select, pacing_sql
from anchorlake.plans.registry import Tables, query
from anchorlake.session import shared_dir
from anchorlake.streaming import jobs
from anchorlake.streaming.results import ResultStore


def _place(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _in_batches(rows: DataFrame, order: str, place: str, start, batches: int = 4) -> None:
    """Let ``rows`` arrive in so many parts along ``order``; the job is resumed for each of them."""
    bounds = rows.stat.approxQuantile(order, [k / batches for k in range(1, batches)], 0.01) if rows.take(1) else []
    part = F.lit(0)
    for bound in bounds:
        part = part + (F.col(order) > bound).cast("int")
    for k in range(batches):
        rows.where(part == k).write.mode("append").parquet(f"{place}/in")
        _finish(start(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{place}/in")))


@query("stream_pacing", pacing_sql("""SELECT host, round(delay, 6) AS delay, round(peak, 6) AS peak,
  pushbacks, responses FROM paced"""))
def stream_pacing(t):
    """Four micro-batches in time order, each going on from the state in the store."""
    place = _place(t)
    responses = t.events.selectExpr("event_id AS seq", "CAST(ts AS TIMESTAMP) AS ts", "unix_micros(CAST(ts AS TIMESTAMP)) AS at",
                                    *_split_select(f"SELECT {_RESPONSE} FROM x"))
    _in_batches(responses, "at", place,
                lambda stream: jobs.pacing_stream(stream, PACE_CFG, f"{place}/out", f"{place}/state"))
    newest = jobs.latest_pacing(t.spark, f"{place}/state")
    return newest.select("host", F.round("delay", 6).alias("delay"), F.round("peak", 6).alias("peak"),
                         "pushbacks", "responses")


@query("stream_unique_urls", """
SELECT DISTINCT concat('https://u', user_id, '.com/', event_id % 5) AS url FROM events""")
def stream_unique_urls(t):
    """Four micro-batches that bring the same URLs again and again."""
    place = _place(t)
    urls = t.events.selectExpr(
        "concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'https://' END, 'u', user_id, '.com/', event_id % 5) AS url", "event_id")
    _in_batches(urls, "event_id", place, lambda stream: jobs.unique_urls(stream, f"{place}/out", f"{place}/state"))
    return t.spark.read.parquet(f"{place}/out").select("url")


@query("stream_audit", f"""
SELECT page_id, {_WORDS} AS word_count, {_FOUND} AS link_found FROM pages""")
def stream_audit(t):
    """Pages in four parts, then all of them once more: those with a fresh result are skipped."""
    place = _place(t)
    store = ResultStore(t.spark, f"{place}/out", "page_id", compact_every=3)

    def features(batch: DataFrame) -> DataFrame:
        found = links.with_link_features(pages.parse_pages(batch), CFG)
        return found.select("page_id", X.word_count(F.col("text")).cast("long").alias("word_count"), "link_found")

    def start(stream: DataFrame):
        return jobs.incremental_audit(stream, features, store, f"{place}/state")

    _in_batches(t.pages, "page_id", place, start)
    t.pages.write.mode("append").parquet(f"{place}/in")
    _finish(start(t.spark.readStream.schema(t.pages.schema).parquet(f"{place}/in")))
    return store.rows().select("page_id", "word_count", "link_found")


@query("stream_alerts", f"WITH {_diff_sql()} SELECT change, count(*) AS n FROM d GROUP BY 1")
def stream_alerts(t):
    """Two runs that arrive one after the other, and the row that closes the second."""
    place, known = _place(t), None
    for rows, run_at in zip(_runs(t), ("2024-01-01", "2024-02-01")):
        rundiff.stamped(rows, run_at, known).write.mode("append").parquet(f"{place}/in")
        known = t.spark.read.parquet(f"{place}/in")
        stream = t.spark.readStream.schema(known.schema).parquet(f"{place}/in")
        writer = jobs.change_alerts(stream).writeStream.format("parquet").option(
            "path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        _finish(writer)
    rundiff.closing(known).write.mode("append").parquet(f"{place}/in")
    _finish(writer)
    return t.spark.read.parquet(f"{place}/out").groupBy("change").agg(F.count("*").alias("n"))
