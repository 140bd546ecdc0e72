"""The audit with all kinds of observations: targets, redirects, homes, browser, archive."""

import pytest
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators import classify, metrics, observations
from anchorlake.operators.pages import walk_page
from anchorlake.plans.audit import Observations, audit
from anchorlake.sources.readers import read_run
from anchorlake.sources.writers import write_run

CFG = AuditConfig(target_site="target.com")
WORDS = " ".join(f"word{i}" for i in range(200))


def page(body):
    return f'<!doctype html><html lang="en"><head><title>A page</title></head><body>{body}</body></html>'


def linking(site):
    return page(f'<article>{WORDS} <a href="https://{site}/x">Tools</a></article>')


def run(spark, listed, pages, **more):
    links = spark.createDataFrame(listed, "url string, target string, anchor string, notes string")
    stored = spark.createDataFrame(pages, "url string, html string")
    rows = audit(links, Observations(stored, **more), CFG, classify.authority_dim(spark), cluster=False)
    return {r.url: r for r in rows.collect()}


def test_own_targets_come_first(spark):
    pages = [("https://a.net/1", linking("other.com")), ("https://a.net/2", linking("other.com")),
             ("https://a.net/3", linking("target.com"))]
    got = run(spark, [("https://a.net/1", "other.com", "", ""), ("https://a.net/2", "", "", ""), ("https://a.net/3", None, "", "")], pages)
    assert got["https://a.net/1"].link_found and got["https://a.net/1"].verdict != "LINK_LOST"
    assert got["https://a.net/2"].verdict == "LINK_LOST" and got["https://a.net/3"].link_found


def test_redirects_are_followed_before_the_page_is_looked_up(spark):
    hops = spark.createDataFrame(
        [("https://b.net/old", "https://b.net/new", 301), ("https://b.net/tmp", "https://b.net/new", 302),
         ("https://b.net/new", None, 200), ("https://b.net/x", "https://b.net/y", 301), ("https://b.net/y", "https://b.net/x", 301)],
        "from_url string, to_url string, status int")
    listed = [(f"https://b.net/{p}", "", "", "") for p in ("old", "tmp", "x")]
    got = run(spark, listed, [("https://b.net/new", linking("target.com"))], redirects=hops)
    assert got["https://b.net/old"].status_verdict == "REDIRECT_PERM" and got["https://b.net/old"].link_found
    assert got["https://b.net/tmp"].status_verdict == "REDIRECT_TEMP" and got["https://b.net/tmp"].final_url == "https://b.net/new"
    assert got["https://b.net/x"].status_verdict == "ERROR" and "loop" in got["https://b.net/x"].error


def test_a_page_without_content_is_not_a_lost_link(spark):
    got = run(spark, [("https://c.net/1", "", "", ""), ("https://c.net/2", "", "", "")],
              [("https://c.net/1", None), ("https://c.net/2", "  ")])
    for row in got.values():
        assert not row.page_parsed and row.page_error and row.verdict != "LINK_LOST"


def test_a_dead_home_is_known_from_the_log(spark):
    log = spark.createDataFrame(
        [("https://d.net/p", "https", 200, "", 1), ("https://d.net/", "https", 404, "", 2), ("https://e.net/p", "https", 200, "", 3)],
        "url string, label string, status int, error string, seq int")
    got = run(spark, [("https://d.net/p", "", "", ""), ("https://e.net/p", "", "", "")],
              [("https://d.net/p", linking("target.com")), ("https://e.net/p", linking("target.com")), ("https://e.net/", page(WORDS))],
              attempts=log)
    assert got["https://d.net/p"].home_status_verdict == "DEAD" and got["https://e.net/p"].home_status_verdict == "LIVE"
    assert got["https://d.net/p"].score < got["https://e.net/p"].score


def test_browser_and_archive_passes(spark):
    rendered = spark.createDataFrame([("https://f.net/js", linking("target.com"))], "url string, html string")
    archive = spark.createDataFrame(
        [("https://f.net/gone", "old", "20200101", linking("target.com")), ("https://f.net/gone", "new", "20240101", page("moved"))],
        "url string, snapshot_url string, ts string, html string")
    log = spark.createDataFrame([("https://f.net/js", "https", 200, "", 1), ("https://f.net/gone", "https", 404, "", 2)],
                                "url string, label string, status int, error string, seq int")
    got = run(spark, [("https://f.net/js", "", "", ""), ("https://f.net/gone", "", "", "")], [("https://f.net/js", page(WORDS))],
              attempts=log, rendered=rendered, archive=archive)
    assert got["https://f.net/js"].rendered and got["https://f.net/js"].link_found
    gone = got["https://f.net/gone"]
    assert gone.archive_available and gone.archive_date == "2024-01-01" and not gone.archive_link_found


def test_newest_snapshot_wins(rows):
    dead = rows("url string, status_verdict string", ("u", "DEAD"))
    snaps = rows("url string, snapshot_url string, ts string, link_found boolean, anchor_texts string",
                 ("u", "a", "20240101", False, ""), ("u", "b", "20200101", True, "x"), ("u", "c", "20230101", True, "y"))
    got = observations.recover_from_archive(dead, snaps).first()
    assert got.archive_url == "a" and not got.archive_link_found


def test_unreadable_payloads_are_counted_not_fatal(rows):
    given = rows("seq int, payload string", (1, '{"domain": "a.com", "da": 5}'), (2, "{broken"), (3, None), (4, "[]"))
    assert [r.registered for r in metrics.walk_payload(given).collect()] == ["a.com"]
    assert metrics.unreadable_payloads(given).first().unreadable == 2


def test_a_saved_run_reads_back(spark, tmp_path):
    data = spark.range(50).selectExpr("concat('https://s.net/', id) AS url", "'GOOD' AS verdict", "CAST(id AS DOUBLE) AS score")
    write_run(data, "r1", str(tmp_path / "runs"))
    back = read_run(spark, str(tmp_path / "runs"))
    assert {(r.url, r.score) for r in back.collect()} == {(r.url, r.score) for r in data.collect()}
    assert back.select("seq").distinct().count() == 50


@pytest.mark.parametrize("depth", [1, 5, 6, 9, 40])
def test_ancestors_count_at_any_depth(depth):
    inner = "<div>" * depth + '<a href="/x">t</a>' + "</div>" * depth
    assert walk_page(f'<div style="display:none">{inner}</div>', "http://h.com/")["links"][0]["hidden"]
    assert walk_page(f"<footer>{inner}</footer>", "http://h.com/")["links"][0]["placement"] == "boilerplate"


def test_long_unclosed_markup_takes_linear_time():
    assert len(walk_page("<a href=/x>y<b>" * 40_000 + "</i>" * 40_000, "http://h.com/")["links"]) == 40_000


def test_robots_files_of_any_size(rows):
    long = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}" for i in range(60_000)) + "\n\nUser-agent: Googlebot\nDisallow: /g%6Fogle\n"
    files = rows("origin string, status int, body string", ("https://r.net", 200, long), ("https://s.net", 200, "Disallow: /\n\nUser-agent: *\n\nDisallow: /"),
                 ("https://t.net", 200, "User-agent: a\nUser-agent: *\r\nAllow: /ok\r\nDisallow: /"), ("https://u.net", 500, "User-agent: *\nDisallow: /"))
    urls = rows("url string", ("https://r.net/p7",), ("https://r.net/google/x",), ("https://s.net/a",), ("https://t.net/ok",),
                ("https://t.net/no",), ("https://u.net/",), ("https://v.net/",))
    got = {r.url: r.robots_blocked for r in observations.robots_verdict(urls, files).collect()}
    assert got == {"https://r.net/p7": False, "https://r.net/google/x": True, "https://s.net/a": False, "https://t.net/ok": False,
                   "https://t.net/no": True, "https://u.net/": False, "https://v.net/": False}


def test_headers_and_rows_may_be_long(spark, tmp_path):
    from anchorlake.sources.readers import read_cells

    wide = ",".join(f"c{i}" for i in range(70))
    lines = ["intro"] * 30 + ["URL,DA,PA,SS"] + ['"a, b.com",1,2,3', "x.com,5,6,7", wide, 'q.com,"say ""hi""",,9']
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "export.csv").write_text("\n".join(lines))
    cells = read_cells(spark, str(tmp_path / "m"))
    got = {r.cells[0]: r.cells for r in cells.collect()}
    assert len(got["c0"]) == 70 and got["a, b.com"] == ["a, b.com", "1", "2", "3"] and got["q.com"] == ["q.com", 'say "hi"', "", "9"]
    parsed = metrics.parse_metric_cells(cells).where("registered = 'x.com'").select("da", "pa", F.col("spam_score")).first()
    assert tuple(parsed) == (5.0, 6.0, 7.0)
