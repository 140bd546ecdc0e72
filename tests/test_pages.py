import pytest
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators import classify, links, pages
from anchorlake.operators.pages import walk_page
from anchorlake.plans.audit import Observations, audit

CFG = AuditConfig(target_site="target.example.com", target_aliases=("www.alias.example.org",))
WORDS = " ".join(f"word{i}" for i in range(200))


def page(body, head="", lang="en"):
    return f'<!doctype html><html lang="{lang}"><head><title>A page</title>{head}</head><body>{body}</body></html>'


LINK = '<a href="https://target.example.com/x">Target tools</a>'
PLACES = [
    (f"<article><p>{LINK}</p></article>", "in-content"), (f"<footer>{LINK}</footer>", "boilerplate"),
    (f'<div class="sidebar">{LINK}</div>', "boilerplate"), (f'<div id="blogroll">{LINK}</div>', "boilerplate"),
    (f'<div class="entry-content">{LINK}</div>', "in-content"), (f"<div>{LINK}</div>", "unknown"),
    (f'<article><aside class="related">{LINK}</aside></article>', "boilerplate"),
    (f"<footer>{LINK}</footer><main>{LINK}</main>", "in-content"), ("<p>none</p>", ""),
]


def test_placement(spark):
    df = spark.createDataFrame([(i, "https://p.example.net/a", page(b)) for i, (b, _) in enumerate(PLACES)],
                               "id int, url string, html string")
    out = links.with_link_features(pages.parse_pages(df), CFG).orderBy("id").collect()
    assert [r.link_placement for r in out] == [want for _, want in PLACES]
    assert [r.link_found for r in out] == [want != "" for _, want in PLACES]


def test_walk_page_repairs_markup():
    html = ('<title>x &amp; y</title><p>one<p>two <b>bold<ul><li>a<li>b</ul><script>var a="</p><a href=x>";</script>'
            '<noscript><a href="/hidden">no</a></noscript><a href="/q" rel="NoFollow UGC"><img src=i></a>'
            '<a name=n>no href</a><a href="#top">t</a><a href="mailto:x">m</a><!-- <a href="/c">c</a> --> tail < end')
    got = walk_page(html, "http://h.com/d/")
    assert got["title"] == "x & y"
    assert " ".join(" ".join(t.split()) for t in got["text"]) == "x & y one two bold a b no href t m tail < end"
    found = pages._links(got["links"], "http://h.com/d/")
    assert [(f["absolute"], f["rel"], f["text"]) for f in found] == [("http://h.com/q", ["nofollow", "ugc"], "")]
    li = walk_page("<ul><li><a href=1>1</a><li><a href=2>2</a></ul>", "http://h.com/")["links"]
    assert len(li) == 2


def test_walk_page_survives_anything():
    for html in ("<a \""*50_000, "<!-- > never closed", "", "<", "<a", "<a href='x", "</p></div>", "<script>", "<!--", "<a href=\"x>text", "\x00<p>", "<title>"):
        walk_page(html, "http://h.com/")


def test_self_and_repeated_internal_links(spark):
    body = '<a href="/a#x">1</a><a href="/a">2</a><a href="#">3</a><a href="https://p.example.net/me#z">4</a><a href="http://o.example.org/">5</a>'
    df = spark.createDataFrame([("https://p.example.net/me", page(body))], "url string, html string")
    row = links.with_link_features(pages.parse_pages(df), CFG).first()
    # example.net and example.org pages register as whole domains
    assert row.internal_urls == ["https://p.example.net/a"]
    assert (row.internal_links, row.outbound_links, row.total_links) == (3, 1, 4)
    assert row.outbound_ratio == 0.25


SITE = "https://site{n}.net"


@pytest.fixture(scope="module")
def audited(spark):
    casino = "casino " * 8
    cases = {
        "good": page(f"<article><p>{WORDS} <a href='https://target.com/'>Tools</a></p></article>", '<meta name="robots" content="index, follow">'),
        "sitewide": page(f"<p>{WORDS}</p><footer><a href='https://target.com/'>T</a></footer>"),
        "nofollow": page(f"<article>{WORDS} <a rel='nofollow' href='https://target.com/'>T</a></article>"),
        "sponsored": page(f"<article>{WORDS} sponsored post <a rel='sponsored' href='https://target.com/'>T</a></article>"),
        "removed": page(f"<article>{WORDS}</article>"),
        "noindex": page(f"<article>{WORDS} <a href='https://target.com/'>T</a></article>", '<meta name=robots content=noindex>'),
        "casino": page(f"<article>{WORDS} {casino} <a href='https://target.com/'>T</a></article>"),
        "parked": page("<p>This domain is for sale</p>"),
        "linkfarm": page("".join(f"<a href='http://s{i}.com/'>x</a>" for i in range(340)) + f"{WORDS} submit your site web directory <a href='https://target.com/'>T</a>"),
        "thin": page("<article>short <a href='https://target.com/'>T</a></article>"),
        "hidden": page(f"<article>{WORDS}<div style='display:none'><a href='https://target.com/'>T</a></div></article>"),
    }
    cfg = AuditConfig(target_site="target.com")
    urls = [(f"https://{name}.net/page", name) for name in cases] + [
        ("https://gone.net/page", "gone"), ("https://teapot.net/page", "refused"), ("https://nowhere.net/page", "dns"),
        ("https://flip.net/page", "flip"), ("https://shut.net/x", "shut")]
    cases["flip"], cases["shut"] = cases["good"], cases["good"]
    stored = [(f"https://{n}.net/page" if n != "shut" else "https://shut.net/x", h) for n, h in cases.items()]
    stored.append(("https://flip.net/", page(casino)))
    log = [(u, "https", {"gone": 404, "refused": 403}.get(n, 200) if n != "dns" else None, "DNS: domain does not resolve", i)
           for i, (u, n) in enumerate(urls)]
    obs = Observations(
        pages=spark.createDataFrame(stored, "url string, html string"),
        attempts=spark.createDataFrame(log, "url string, label string, status int, error string, seq int"),
        robots=spark.createDataFrame([("https://shut.net", 200, "User-agent: *\nDisallow: /x")], "origin string, status int, body string"),
        metric_sources=[spark.createDataFrame([(f"{n}.net", 92.0, 2.0, "test") for _, n in urls],
                                              "registered string, da double, spam_score double, source string")])
    links_df = spark.createDataFrame([(u, "", "", n) for u, n in urls], "url string, target string, anchor string, notes string")
    out = audit(links_df, obs, cfg, classify.authority_dim(spark))
    return {r.notes: r for r in out.collect()}


def test_audit_verdicts(audited):
    got = {n: r.verdict for n, r in audited.items()}
    assert got == {
        "good": "GOOD", "sitewide": "REVIEW", "nofollow": "REVIEW", "sponsored": "REVIEW", "removed": "LINK_LOST",
        "noindex": "LOW_VALUE", "casino": "TOXIC", "parked": "TOXIC", "linkfarm": "TOXIC", "thin": "REVIEW",
        "hidden": "TOXIC", "gone": "DEAD", "refused": "BLOCKED", "dns": "DEAD", "flip": "TOXIC", "shut": "REVIEW"}


def test_audit_details(audited):
    assert audited["good"].score == 75 and audited["good"].da == 92.0
    assert audited["sitewide"].score < audited["good"].score
    assert audited["casino"].da is None and audited["casino"].gate_stage == "2-page-content"
    assert audited["flip"].gate_stage == "3-homepage" and audited["flip"].home_content_spam
    assert audited["shut"].robots_blocked and not audited["good"].robots_blocked
    assert audited["removed"].needs_render and audited["refused"].render_reason == "blocked"
    assert audited["good"].action_group == "none" and audited["removed"].action_group == "reclaim"
    assert audited["parked"].action_group == "disavow" and audited["refused"].action_group == "verify"
    assert len(audited) == 16


def test_sitewide_notes(spark):
    rows = spark.createDataFrame([("u1", True, ["a", "b", "c", "d"]), ("u2", True, ["a", "x"]), ("u3", True, []),
                                  ("u4", False, ["a"]), ("u5", True, ["y"])], "url string, link_found boolean, internal_urls array<string>")
    seen = spark.createDataFrame([("a", True), ("b", True), ("d", True), ("x", False)], "url string, link_found boolean")
    got = {r.url: (r.sitewide_sampled, r.sitewide_hits, r.sitewide_ratio) for r in links.sitewide_sample(rows, seen, 3).collect()}
    assert got == {"u1": (3, 3, 1.0), "u2": (2, 1, 0.5), "u3": (0, 0, 0.0), "u4": (0, 0, 0.0), "u5": (0, 0, 0.0)}


def test_home_page_is_its_own_home(spark):
    rows = spark.createDataFrame([("http://a.com/", 7), ("http://a.com/x", 9), ("http://b.com/x", 1)], "url string, word_count int")
    homes = spark.createDataFrame([("http://a.com/", 70)], "url string, word_count int")
    got = {r.url: (r.home_checked, r.home_same_as_page, r.home_word_count) for r in pages.with_homepage(rows, homes).collect()}
    assert got == {"http://a.com/": (True, True, 7), "http://a.com/x": (True, False, 70), "http://b.com/x": (False, False, None)}


def test_links_with_their_own_targets(spark):
    body = page(f"<article>{WORDS} <a href='https://mine.com/'>M</a></article>")
    stored = spark.createDataFrame([("https://a.net/p", body), ("https://b.net/p", body)], "url string, html string")
    listed = spark.createDataFrame([("https://a.net/p", "mine.com", "", ""), ("https://b.net/p", "", "", "")],
                                   "url string, target string, anchor string, notes string")
    cfg = AuditConfig(target_site="theirs.com")
    out = audit(listed, Observations(stored), cfg, classify.authority_dim(spark), cluster=False)
    assert {r.url: r.link_found for r in out.collect()} == {"https://a.net/p": True, "https://b.net/p": False}


@pytest.mark.parametrize("body, content_type, want", [
    ("\ufeffé".encode("utf-8"), "text/html; charset=latin-1", ("é", "utf-8", 0)),
    ("\ufeffé".encode("utf-16-be"), "", ("é", "utf-16-be", 0)),
    ("é€".encode("cp1252"), "text/html; Charset='ISO-8859-1'", ("é€", "cp1252", 0)),
    ("日本".encode("shift_jis"), "text/html;charset=Shift_JIS", ("日本", "cp932", 0)),
    (b"<meta charset='koi8-r'>" + "да".encode("koi8-r"), "text/html; charset=no-such", ("<meta charset='koi8-r'>да", "koi8-r", 0)),
    (b'<META http-equiv=x content="text/html; charset=windows-1251">' + "да".encode("cp1251"), "",
     ('<META http-equiv=x content="text/html; charset=windows-1251">да', "cp1251", 0)),
    (b"<?xml version='1.0' encoding='gb2312'?>" + "中".encode("gb18030"), "", ("<?xml version='1.0' encoding='gb2312'?>中", "gb18030", 0)),
    (b"<meta charset=utf-16>\xc3\xa9", "", ("<meta charset=utf-16>é", "utf-8", 0)),
    ("é".encode("utf-8"), "", ("é", "utf-8", 0)),
    (b"caf\xe9", "", ("café", "cp1252", 0)),
    (b"a\xff\xfeb\xc3", "text/html; charset=utf-8", ("ab", "utf-8", 3)),
    (b"<meta charset=rot13>x", "charset=base64", ("<meta charset=rot13>x", "utf-8", 0)),
    (b"", "", ("", "utf-8", 0)),
])
def test_charset_and_decoding(body, content_type, want):
    assert pages.decode_body(body, content_type) == want


def test_pages_as_bytes(spark):
    given = spark.createDataFrame([(1, bytearray(b"caf\xe9"), None), (2, None, "text/html"), (3, bytearray(b"\xff"), "x; charset=utf-8")],
                                  "id int, body binary, content_type string")
    got = {r.id: (r.html, r.charset, r.undecodable) for r in pages.decoded_pages(given).collect()}
    assert got == {1: ("café", "cp1252", 0), 2: ("", "utf-8", 0), 3: ("", "utf-8", 1)}
    assert pages.decoded_pages(given.limit(0)).count() == 0


def test_pages_that_share_a_url_are_sampled_each_by_its_own_links(spark):
    rows = spark.createDataFrame([(1, "u", True, ["a", "b"]), (2, "u", True, ["x"]), (3, "u", False, ["a"]), (4, "v", True, ["a", "b"]),
                                  (5, "u", True, ["x"])], "id int, url string, link_found boolean, internal_urls array<string>")
    seen = spark.createDataFrame([("a", True), ("b", True), ("x", False)], "url string, link_found boolean")
    got = {r.id: (r.sitewide_sampled, r.sitewide_hits) for r in links.sitewide_sample(rows, seen, 3).collect()}
    assert got == {1: (2, 2), 2: (1, 0), 3: (0, 0), 4: (2, 2), 5: (1, 0)}


def test_archived_copies_of_pages_that_share_a_url(spark, tmp_path):
    from anchorlake.plans.q_status import archive_recovery

    stored = [(i, "https://www.example.com/x", page(f"<nav><a href='/{i}'>to {i}</a></nav>").replace("<title>", f"<title>{i} "))
              for i in (6, 9, 12)]
    spark.createDataFrame(stored, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.archive_available, r.archive_date, r.archive_title.split()[0])
           for r in archive_recovery(spark, str(tmp_path)).collect()}
    assert got == {6: (True, "2023-07-15", "6"), 9: (True, "2023-01-15", "9"), 12: (True, "2023-04-15", "12")}
