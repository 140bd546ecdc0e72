from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators import rundiff
from anchorlake.operators.pacing import Pace, apply, compose, pacing_batch
from anchorlake.streaming import jobs, pace
from anchorlake.streaming.results import ResultStore

RESPONSES = "host string, ts int, seq int, status int, retry_after double"


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def arrive(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def by_host(df):
    return sorted((r.host, round(r.delay, 9), round(r.peak, 9), r.pushbacks, r.responses) for r in df.collect())


def test_pacing_state_equals_batch_over_several_batches(spark, tmp_path):
    rows = [(f"h{i % 3}", 17 * i, i, [200, 429, 503, 200, 404, None][i % 6], 5.0 if i % 7 == 0 else None) for i in range(120)]
    rows += [("quiet", 3, 500, 200, None), ("", 4, 501, 429, None), (None, 5, 502, 429, None)]
    df = spark.createDataFrame(rows, RESPONSES)
    for part in range(4):
        stream = arrive(spark, df.where(f"least(3, ts div 510) = {part}"), str(tmp_path / "in"))
        drain(jobs.pacing_stream(stream, AuditConfig(), str(tmp_path / "out"), str(tmp_path / "state")))
    assert by_host(jobs.latest_pacing(spark, str(tmp_path / "state"))) == by_host(pacing_batch(df, AuditConfig()))
    batches = spark.read.parquet(str(tmp_path / "out")).where("host = 'quiet'").select("batch").collect()
    assert [r.batch for r in batches] == [0]  # a host is written only when it answers


def test_a_host_comes_to_its_state_as_one_row_a_batch(spark, tmp_path, monkeypatch):
    class OneRow(pace.HostPace):
        def handleInputRows(self, key, rows, timerValues):
            row, = rows
            assert row.responses == 100
            yield from super().handleInputRows(key, iter([row]), timerValues)

    monkeypatch.setattr(pace, "HostPace", OneRow)
    df = spark.createDataFrame([(f"h{i % 3}", 1200 * i, i, [200, 200, 503, 200, 404, None, 429][i * i % 11 % 7],
                                 9.0 if i % 7 == 0 else None) for i in range(600)], RESPONSES)
    for part in range(2):
        stream = arrive(spark, df.where(f"seq div 300 = {part}"), str(tmp_path / "in"))
        drain(jobs.pacing_stream(stream, AuditConfig(), str(tmp_path / "out"), str(tmp_path / "state")))
    assert by_host(jobs.latest_pacing(spark, str(tmp_path / "state"))) == by_host(pacing_batch(df, AuditConfig()))

    cells = pace.segments(df, Pace.of(AuditConfig())).collect()
    assert len(cells) == 600 and len(pace.joined(pace.segments(df, Pace.of(AuditConfig()))).collect()) == 3
    for row in pace.joined(pace.segments(df, Pace.of(AuditConfig()))).collect():
        mine = sorted((c for c in cells if c.host == row.host), key=lambda c: c.cell)
        assert row.path == [x for c in mine for x in c.path]
        assert (row.pushbacks, row.last) == (sum(c.pushbacks for c in mine), mine[-1].last)


def test_idle_hosts_recover_by_timer(spark, tmp_path):
    cfg = AuditConfig(delay_per_host=1.0, max_delay_per_host=15.0, backoff_recover=0.5)
    seen = []
    for rows in ([("a", 100, 1, 429, 8.0), ("b", 100, 2, 200, None)], [("c", 115, 3, 200, None)],
                 [("c", 145, 4, 200, None)], [("c", 400, 5, 200, None), ("a", 401, 6, 503, None)]):
        stream = arrive(spark, spark.createDataFrame(rows, RESPONSES), str(tmp_path / "in"))
        drain(jobs.pacing_stream(stream, cfg, str(tmp_path / "out"), str(tmp_path / "state"), idle=10))
        seen.append({r.host: r.delay for r in jobs.latest_pacing(spark, str(tmp_path / "state")).collect()})
    # the watermark is 10 s behind: at 105 nothing is due, at 135 three spells are over
    assert [s["a"] for s in seen] == [8.0, 8.0, 1.0, 2.0]
    assert all(s["b"] == 1.0 for s in seen)


def test_highest_delay_of_a_segment_for_any_start():
    limits = Pace.of(AuditConfig())
    for seed in range(50):
        statuses = [[200, 429, 503, 404, 200, 200][(seed * 7 + k * k) % 6] for k in range(20)]
        retries = [None if k % 3 else float(k) for k in range(20)]
        total, highest, pushed = pace.fold(statuses, retries, limits)
        assert pushed == sum(s in (429, 503) for s in statuses) and len(highest) <= 6
        for start in (1.0, 1.5, 4.0, 15.0):
            delay, top = start, 0.0
            for step in filter(None, map(limits.step, statuses, retries)):
                delay = apply(step, delay)
                top = max(top, delay)
            assert abs(apply(total, start) - delay) < 1e-9
            assert abs(max((apply(h, start) for h in highest), default=0.0) - top) < 1e-9
    assert compose((2.0, 2.0, 15.0), (0.5, 1.0, 15.0)) == (1.0, 1.0, 7.5)


def test_resume_skips_fresh_results(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    store = ResultStore(spark, str(tmp_path / "out"), ttl_hours=24, compact_every=3)

    def audit(batch):
        calls.append(sorted(str(r.url) for r in batch.collect()))
        return batch.withColumn("n", F.length("url"))

    def arrives(urls, at, checkpoint="state"):
        stream = arrive(spark, spark.createDataFrame([(u,) for u in urls], "url string"), source)
        drain(jobs.incremental_audit(stream, audit, store, str(tmp_path / checkpoint), at))

    arrives(["u1", "u2", "u2"], now)
    arrives(["u2", "u3"], now)
    arrives([None, "u4"], now + F.expr("INTERVAL 1 HOUR"))            # compacts
    assert calls == [["u1", "u2"], ["u3"], ["None", "u4"]]            # a page without key is always audited
    assert sorted(p.name for p in (tmp_path / "out").iterdir())[0].startswith("base-")
    assert len(list((tmp_path / "out").glob("batch-*"))) <= 3
    arrives(["u1", "u4"], now + F.expr("INTERVAL 24 HOURS 30 MINUTES"))  # u1 is stale, u4 is not
    assert calls[3] == ["u1"]
    rows = {r.url: r.cached_at.day for r in store.fresh(now + F.expr("INTERVAL 24 HOURS 30 MINUTES")).collect() if r.url}
    assert rows == {"u1": 2, "u4": 1}
    store.compact(now + F.expr("INTERVAL 24 HOURS 30 MINUTES"), 4)
    assert {r.url for r in store.rows().collect()} == {"u1", "u4", None}  # what was stale has gone
    store.compact(now + F.expr("INTERVAL 24 HOURS 30 MINUTES"), 5)        # what the base before it replaced goes
    assert sorted(int(p.name.split("-")[1]) for p in (tmp_path / "out").iterdir() if p.is_dir()) == [4, 5]


def test_a_retried_batch_neither_loses_nor_doubles_rows(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "out"), compact_every=2)
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("u1",), ("u2",)], "url string")
    for batch in (0, 0, 1, 1, 2, 2):
        todo = store.without_fresh(rows.union(spark.createDataFrame([(f"b{batch}",)], "url string")), now, before=batch)
        store.put(todo, now, batch)
    assert sorted(r.url for r in store.rows().collect()) == ["b0", "b1", "b2", "u1", "u2"]


def test_store_without_lifetime_reuses_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "out"), ttl_hours=0)
    rows = spark.createDataFrame([("u1",)], "url string")
    store.put(rows, F.current_timestamp(), 0)
    assert store.without_fresh(rows, F.current_timestamp()).count() == 1 and store.rows().count() == 1


URLS = (["a.com", "https://a.com", "b.com", " "], ["c.com", "http://a.com"], ["https://b.com", "a.com", None])


def test_unique_urls_stream(spark, tmp_path):
    for urls in URLS:
        stream = arrive(spark, spark.createDataFrame([(u,) for u in urls], "url string"), str(tmp_path / "in"))
        query = drain(jobs.unique_urls(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [
        "http://a.com", "https://a.com", "https://b.com", "https://c.com"]
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 4 and state["numRowsUpdated"] == 0  # what was known is not written again


def test_unique_urls_forgets_after_its_lifetime(spark, tmp_path):
    days = [("a.com", 1), ("b.com", 1), ("a.com", 2), ("c.com", 20), ("a.com", 21), ("d.com", 40), ("a.com", 41)]
    for url, day in days:
        df = spark.createDataFrame([(url, day)], "url string, day int").selectExpr(
            "url", "timestamp_seconds(day * 86400L) AS seen_at")
        stream = arrive(spark, df, str(tmp_path / "in"))
        drain(jobs.unique_urls(stream, str(tmp_path / "out"), str(tmp_path / "state"), "seen_at", "10 days"))
    found = sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # on day 21 the watermark is day 10, short of day 1 + 10; on day 41 it is day 30
    assert found == ["https://a.com"] * 2 + ["https://b.com", "https://c.com", "https://d.com"]


RUN = "url string, registered string, verdict string, score double, link_found boolean, target_checked boolean, seq int"


def test_change_alerts_of_three_runs(spark, tmp_path):
    good, toxic = ("GOOD", 90.0, True, True), ("TOXIC", 10.0, True, True)
    runs = {
        "2024-01-01": [("u1", "a.com", *good, 1), ("u2", "b.com", *good, 2), ("u3", "c.com", *good, 3)],
        "2024-01-09": [("u1", "a.com", *toxic, 1), ("u2", "b.com", *toxic, 1), ("u2", "b.com", *good, 2)],
        "2024-03-01": [("u1", "a.com", *toxic, 1), ("u4", "d.com", *good, 2)]}
    source, known, got = str(tmp_path / "in"), None, {}

    def alerts(stream):
        drain(jobs.change_alerts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")))
        return {(r.change, r.url) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    for run_at, rows in runs.items():
        stream = arrive(spark, rundiff.stamped(spark.createDataFrame(rows, RUN), run_at, known), source)
        known = spark.read.parquet(source)
        got[run_at] = alerts(stream)
    changed = {("turned_toxic", "u1"), ("score_down", "u1"), ("verdict_worse", "u1")}
    assert got["2024-01-01"] == set()
    assert got["2024-01-09"] == changed                                # u3 may still come
    assert got["2024-03-01"] == changed | {("removed", "u3")}          # the second run is closed
    arrive(spark, rundiff.closing(known), source)
    assert alerts(stream) == changed | {("removed", "u3"), ("removed", "u2"), ("added", "u4")}
