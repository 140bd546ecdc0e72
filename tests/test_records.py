import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators import fetchlog, master, metrics, observations, rundiff
from anchorlake.operators.keyed import Ordered
from anchorlake.operators.pacing import Pace, apply, compose, pacing_batch

DAY = datetime.datetime


# ----------------------------------------------------------------- pacing ----
def replay(pace, events):
    delay, peak, pushed = pace.base, 0.0, 0
    for status, retry in events:
        step = pace.step(status, retry)
        if step:
            pushed += step[0] == 2.0
            delay = apply(step, delay)
            peak = max(peak, delay) if delay > pace.base else peak
    return delay, peak, pushed, len(events)


def test_pacing_steps():
    pace = Pace.of(AuditConfig(delay_per_host=1.0, max_delay_per_host=15.0))
    assert replay(pace, [(429, None)])[0] == 2.0
    assert replay(pace, [(429, None), (503, None)])[0] == 4.0
    assert replay(pace, [(429, 6.0)])[0] == 6.0
    assert replay(pace, [(429, 6.0)] + [(200, None)] * 8)[0] < 2.0
    assert replay(Pace.of(AuditConfig(max_delay_per_host=4.0)), [(429, 60.0)] * 3)[0] == 4.0
    assert replay(pace, [(404, None), (None, None), (200, None)]) == (1.0, 0.0, 0, 3)


def test_steps_compose():
    rng, pace = random.Random(2), Pace.of(AuditConfig())
    for _ in range(200):
        steps = [pace.step(rng.choice([429, 503, 200, 301]), rng.choice([None, 3.0, 40.0])) for _ in range(6)]
        total = (1.0, 0.0, math.inf)
        for s in steps:
            total = compose(total, s)
        x = y = rng.uniform(1, 15)
        for s in steps:
            y = apply(s, y)
        assert math.isclose(apply(total, x), y)


def test_pacing_over_cut_histories(spark):
    rng = random.Random(8)
    pace, history = Pace.of(AuditConfig()), {}
    rows = []
    for seq in range(3000):
        host = rng.choice(["hot"] * 6 + ["a", "b", "c", "d", "e", "zz"])
        event = (rng.choice([200, 200, 429, 503, 404, None]), rng.choice([None, None, 5.0]))
        history.setdefault(host, []).append(event)
        rows.append((host, seq // 10, seq, *event))
    df = spark.createDataFrame(rows, "host string, ts int, seq int, status int, retry_after double").repartition(5)
    assert Ordered(df, [F.col("host"), F.col("ts"), F.col("seq")]).rows.where("host = 'hot'").select("_range").distinct().count() > 1
    got = {r.host: (r.delay, r.peak, r.pushbacks, r.responses) for r in pacing_batch(df, AuditConfig()).collect()}
    for host, events in history.items():
        assert got[host] == pytest.approx(replay(pace, events))
    assert set(got) == set(history)


# -------------------------------------------------------------- fetch log ----
def test_ladder(spark):
    log = [("https://a.com/", "https", None, "SSL certificate error", 1), ("https://a.com/", "https-noverify", 200, "", 2),
           ("https://b.com/", "https", None, "timeout", 1), ("https://b.com/", "https-noverify", None, "timeout", 2), ("https://b.com/", "http", 404, "", 3),
           ("http://c.com/", "https", 500, "", 2), ("http://c.com/", "http", None, "connection refused", 1),
           ("https://d.com/", "https", None, "SSL certificate error", 1), ("https://e.com/", "https", None, "timeout", 1), ("https://f.com/", "https", 200, "", 1)]
    df = spark.createDataFrame(log, "url string, label string, status int, error string, seq int")
    dns = spark.createDataFrame([("e.com", False, []), ("f.com", False, []), ("a.com", True, ["1.2.3.4", "::1"])], "host string, resolved boolean, ips array<string>")
    got = {r.url: r for r in fetchlog.resolve_attempts(df, dns).collect()}
    a, b, c, d, e, f = (got[u] for u in sorted(got, key=lambda u: u.split("//")[1]))
    assert (a.status_verdict, a.tls_invalid, a.attempts, a.ip) == ("LIVE", True, "https:fail -> https-noverify", "1.2.3.4")
    assert (b.status_verdict, b.https_unavailable, b.https, b.checked_url) == ("DEAD", True, False, "http://b.com/")
    assert (c.status_verdict, c.scheme_used, c.attempts) == ("SERVER_ERROR", "https", "http:fail -> https")
    assert d.status_verdict == "SSL_ERROR" and e.status_verdict == "DNS_ERROR"
    assert f.status_verdict == "LIVE" and f.dns_note and f.error == ""


def test_redirects(spark):
    hops = [("https://x.com/chain1", "https://x.com/chain2", 301), ("https://x.com/chain2", "https://x.com/chain3", 302),
            ("https://x.com/chain3", "https://y.com/good", 301), ("https://y.com/good", None, 200),
            ("https://x.com/loop1", "https://x.com/loop2", 302), ("https://x.com/loop2", "https://x.com/loop1", 302),
            ("https://x.com/out", "https://unknown.com/", 301)]
    hops += [(f"n{i}", f"n{i + 1}", 301) for i in range(12)] + [("n12", None, 200)]
    got = {r.url: r for r in fetchlog.resolve_redirects(spark.createDataFrame(hops, "from_url string, to_url string, status int")).collect()}
    chain = got["https://x.com/chain1"]
    assert (chain.redirect_hops, chain.final_url, chain.final_status, chain.redirect_offsite, chain.redirect_target_domain) == (
        3, "https://y.com/good", 200, True, "y.com")
    assert chain.redirect_chain == "https://x.com/chain1 -> https://x.com/chain2 -> https://x.com/chain3 -> https://y.com/good"
    assert got["https://x.com/loop1"].redirect_error and got["https://x.com/loop1"].redirect_hops == 0
    assert got["https://x.com/out"].final_url == "https://unknown.com/" and got["https://x.com/out"].final_status is None
    assert got["n2"].redirect_hops == 10 and got["n1"].redirect_error and got["n0"].redirect_error
    assert got["https://y.com/good"].redirect_hops == 0


def test_robots(spark):
    robots = spark.createDataFrame([
        ("https://a.com", 200, "User-agent: *\nDisallow: /blocked\nAllow: /"), ("https://b.com:8080", 200, "User-agent: *\nDisallow: /"),
        ("https://c.com", 404, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    urls = ["https://a.com/blocked/x", "https://a.com/open", "https://b.com/x", "https://b.com:8080/x", "https://c.com/x", "https://d.com/x"]
    out = observations.robots_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), robots)
    blocked = {r.url for r in out.collect() if r.robots_blocked}
    assert blocked == {"https://a.com/blocked/x", "https://b.com:8080/x"}


# ----------------------------------------------------------------- master ----
MASTER = [("host.com", "host.com", 95.0, 1.0, "No Issues", DAY(2024, 6, 20)), ("blog.shop.com", "shop.com", 30.0, None, "Spammy", DAY(2024, 6, 1)),
          ("a.very.long.shop.com", "shop.com", 40.0, None, "", DAY(2024, 6, 1)), ("old.com", "old.com", 50.0, None, None, DAY(2020, 1, 1)),
          ("bare.com", "bare.com", None, None, "", DAY(2020, 1, 1))]
NOW = "2024-06-30 00:00:00"


@pytest.fixture
def listed(spark):
    return spark.createDataFrame([(h, r, da, ss, st, "sheet", "", DAY(2019, 1, 1), seen) for h, r, da, ss, st, seen in MASTER],
                                 "host string, registered string, da double, spam_score double, status string, source string, notes string, first_seen timestamp, last_seen timestamp")


def test_master_lookup_and_windows(spark, listed):
    rows = spark.createDataFrame([("host.com", "host.com"), ("x.host.com", "host.com"), ("www.shop.com", "shop.com"), ("new.io", "new.io")], "host string, registered string")
    got = {r.host: (r.in_master, r.master_match, r.master_host, r.master_status) for r in master.master_lookup(rows, listed).collect()}
    assert got == {"host.com": (True, "host", "host.com", "No Issues"), "x.host.com": (True, "registered", "host.com", "No Issues"),
                   "www.shop.com": (True, "registered", "blog.shop.com", "Spammy"), "new.io": (False, "", "", "")}
    wanted = spark.createDataFrame([("host.com",), ("old.com",), ("bare.com",)], "registered string")
    now = F.lit(NOW)
    assert [r.da for r in master.fresh_metrics(wanted, listed, now, 30).collect()] == [95.0]
    assert {r.registered for r in master.fresh_metrics(wanted, listed, now, 0).collect()} == {"host.com", "old.com"}
    assert {r.registered for r in master.stale_metrics(wanted, listed, now, 30).collect()} == {"old.com", "bare.com"}
    assert master.stale_metrics(wanted, listed, now, 0).count() == 0


def test_upsert_is_idempotent_and_keeps_values(spark, listed):
    cells = spark.createDataFrame([("HOST.com", "N/A", "7%", "", "", 1), ("https://new.com/x", "12", "", "Spammy", "seen", 2), ("new.com", "99", "", "", "", 3),
                                   ("two words", "1", "1", "", "", 4)], "host string, da string, spam_score string, status string, notes string, row_no int")
    sheet = master.clean_sheet(cells, "s.csv")
    once = master.master_upsert(listed, sheet, F.lit(NOW))
    got = {r.host: r for r in once.collect()}
    assert (got["host.com"].da, got["host.com"].spam_score, got["host.com"].status, got["host.com"].change) == (95.0, 7.0, "No Issues", "updated")
    assert (got["new.com"].da, got["new.com"].status, got["new.com"].change, got["new.com"].registered) == (12.0, "Spammy", "imported", "new.com")
    assert got["host.com"].first_seen == DAY(2019, 1, 1) and got["host.com"].last_seen == DAY(2024, 6, 30)
    counts = master.upsert_counts(cells, once).first()
    assert (counts.read, counts.imported, counts.updated, counts.skipped) == (4, 1, 1, 2)
    names = [c for c in once.columns if c != "change"]
    twice = master.master_upsert(once.select(names), sheet, F.lit(NOW))
    assert sorted(map(str, twice.select(names).collect())) == sorted(map(str, once.select(names).collect()))


def test_learning(spark, listed):
    rows = spark.createDataFrame([("bad.io", "bad.io", "TOXIC", "https://bad.io/1"), ("bare.com", "bare.com", "TOXIC", "u2"), ("host.com", "host.com", "TOXIC", "u3"),
                                  ("good.io", "good.io", "GOOD", "u4")], "host string, registered string, verdict string, url string").selectExpr(
                                      "*", "CAST(5 AS double) da", "CAST(NULL AS double) spam_score", "'why' issues")
    got = {r.host: (r.status, r.change) for r in master.learn_toxic(listed, rows, F.lit(NOW)).collect()}
    assert got["bad.io"] == ("Spammy", "added") and got["bare.com"] == ("Spammy", "filled") and got["host.com"] == ("No Issues", "kept")
    assert "good.io" not in got


def test_result_cache(spark):
    cache = spark.createDataFrame([("u", 1, DAY(2024, 6, 29, 22))], "url string, score int, cached_at timestamp")
    assert [master.fresh_results(cache, h, F.lit(NOW)).count() for h in (1, 24, 0, -1)] == [0, 1, 0, 0]
    old = spark.createDataFrame([("d", DAY(2020, 1, 1)), ("n", None)], "registered string, fetched_at timestamp")
    assert [master.fresh_cached_metrics(old, d, F.lit(NOW)).count() for d in (30, 0)] == [1, 2]


# ---------------------------------------------------------------- metrics ----
def test_metric_cells(spark):
    files = {
        "a.csv": [["My checker"], ["URL", "DA", "PA", "SS", "TB", "QB"], ["https://en.wikipedia.org/", "98", "82", "1%", "2,340,111", "1"], ["bad", "1", "2", "3", "4", "5"]],
        "b.csv": [["Website", "Domain Authority", "Page Authority", "Spam Score"], ["glassdoor.com", "92", "75", "2"], ["glassdoor.com", "93", "N/A", "2"]],
        "c.txt": [["example.com", "45", "38", "5"], ["nodata.com", "n/a", "-"]],
        "d.csv": [["n", "name", "da", "pa"], ["1", "one.com", "5", "6"], ["2", "two.com", "7"]],
        "e.csv": [["x"]] * 26 + [["URL", "DA", "PA"], ["late.com", "1", "2"]]}
    rows = [(f, DAY(2024, 1, 1 + i), n, c) for i, (f, cells) in enumerate(files.items()) for n, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "file string, mtime timestamp, row_no int, cells array<string>")
    got = {(r.file, r.registered): (r.da, r.pa, r.spam_score, r.backlinks) for r in metrics.parse_metric_cells(df).collect()}
    assert got == {("a.csv", "wikipedia.org"): (98.0, 82.0, 1.0, 2340111.0), ("b.csv", "glassdoor.com"): (93.0, None, 2.0, None),
                   ("c.txt", "example.com"): (45.0, 38.0, 5.0, None), ("d.csv", "one.com"): (5.0, 6.0, None, None),
                   ("d.csv", "two.com"): (7.0, None, None, None), ("e.csv", "late.com"): (1.0, 2.0, None, None)}


def test_later_files_override_with_nulls(spark):
    rows = [("a", DAY(2024, 1, 1), 0, ["url", "da", "pa"]), ("a", DAY(2024, 1, 1), 1, ["x.com", "10", "20"]),
            ("b", DAY(2024, 1, 2), 0, ["url", "da", "ss"]), ("b", DAY(2024, 1, 2), 1, ["x.com", "N/A", "3"])]
    parsed = metrics.parse_metric_cells(spark.createDataFrame(rows, "file string, mtime timestamp, row_no int, cells array<string>"))
    row = metrics.merge_metric_files(parsed).first()
    assert (row.da, row.pa, row.spam_score, row.source) == (None, 20.0, 3.0, "import:b")


def test_payloads(spark):
    walk = spark.createDataFrame([(1, '{"a":[{"URL":"https://sub.x.com/","domain_authority":"45","SS":"2%"},{"site":"y.com","tb":"9"}],"domain":"z.com","PA":7}')], "seq int, payload string")
    got = {r.registered: (r.da, r.pa, r.spam_score) for r in metrics.normalise_payload(walk, "any").collect()}
    assert got == {"x.com": (45.0, None, 2.0), "z.com": (None, 7.0, None)}


def test_payloads_of_any_depth_and_order(spark):
    deep = lambda n: "[" * n + '{"domain":"deep.com","da":1}' + "]" * n
    given = [
        (1, deep(200)), (2, deep(200_000)), (3, '{"domain": "a.com", "da": 5} trailing'), (4, "{broken"), (5, None), (6, "7"),
        (7, '[{"site":"a.com","da":1},{"site":"a.com","da":2}]'), (8, '{"Site":"b.com","DA":"1","D_A":"3"}'),
        (9, '{"url":"","domain":null,"target":0,"website":"c.com","domain authority":4,"x":{"page":"d.com","pa":"5%","dofollow":6}}'),
        (10, '{"da":1,"da":9,"domain":"e.com"}'), (11, '{"domain":{"x":1},"da":3,"page":"f.com"}')]
    rows = spark.createDataFrame(given, "seq int, payload string")
    got = {r.registered: (r.da, r.pa, r.quality_backlinks) for r in metrics.walk_payload(rows).collect()}
    assert got.pop("b.com")[0] in (1.0, 3.0)
    assert got == {"deep.com": (1.0, None, None), "a.com": (2.0, None, None), "c.com": (4.0, None, None),
                   "d.com": (None, 5.0, 6.0), "e.com": (9.0, None, None), "f.com": (3.0, None, None)}
    # too deep, broken and null ones are counted; what stands behind a first value is not read
    assert metrics.unreadable_payloads(rows).first().unreadable == 3
    assert metrics.walk_payload(rows.limit(0)).count() == 0


def test_queue_batches(spark):
    domains = spark.range(250).selectExpr("concat('d', lpad(id, 4, '0'), '.com') AS registered")
    known = domains.where("registered < 'd0020'").selectExpr("registered", "CASE WHEN registered < 'd0010' THEN 1.0D END AS da")
    queue = metrics.metric_queue(domains, known, 100).orderBy("position").collect()
    assert len(queue) == 240 and queue[0].registered == "d0010.com"
    assert [r.batch for r in queue] == [i // 100 + 1 for i in range(240)]


# --------------------------------------------------------------- run diff ----
RUN = ("url string, registered string, verdict string, score double, link_found boolean, is_followed boolean, is_nofollow boolean, link_rel string, target_checked boolean, status_code int")


def test_run_diff(spark):
    old = spark.createDataFrame([("https://a.com/1", "a.com", "GOOD", 90.0, True, True, False, "", True, 200), ("https://b.com/1", "b.com", "GOOD", 80.0, True, True, False, "", True, 200),
                                 ("https://e.com/1", "e.com", "GOOD", 85.0, True, True, False, "", True, 200)], RUN)
    new = spark.createDataFrame([("https://a.com/1", "a.com", "DEAD", 5.0, False, False, False, "", True, 404), ("https://b.com/1", "b.com", "REVIEW", 62.0, True, False, True, "nofollow", True, 200),
                                 ("https://e.com/1", "e.com", "LINK_LOST", 40.0, False, False, False, "", True, 200), ("https://new.io/1", "new.io", "GOOD", 80.0, True, True, False, "", True, 200)], RUN)
    changes = rundiff.run_diff(old, new)
    by_kind = {}
    for r in changes.collect():
        by_kind.setdefault(r.change, []).append(r.domain)
    assert by_kind["died"] == ["a.com"] and by_kind["link_lost"] == ["e.com"] and by_kind["went_nofollow"] == ["b.com"]
    assert by_kind["added"] == ["new.io"] and len(by_kind["score_down"]) == 3 and len(by_kind["verdict_worse"]) == 3
    assert rundiff.run_diff(old, old).count() == 0
    assert {(r.registered, r.change) for r in rundiff.domain_changes(old, new).collect()} == {("new.io", "new")}
    assert rundiff.headline_counts(changes).where("change = 'died'").first().n == 1
