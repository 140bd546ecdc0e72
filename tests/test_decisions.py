import itertools
import random

from pyspark.sql import functions as F

from anchorlake.config import DEFAULT_PENALTIES, AuditConfig
from anchorlake.operators import anchors, gate, network, report, score

CFG = AuditConfig(target_site="acme.com")

GATE = [  # overrides, passed, stage
    (dict(status_verdict="DEAD", status_code=404), False, "1-live"), (dict(status_verdict="DNS_ERROR"), False, "1-live"),
    (dict(status_verdict="BLOCKED", status_code=403), False, "1-live"),
    (dict(content_spam=True), False, "2-page-content"), (dict(parked_markers="for sale"), False, "2-page-content"),
    (dict(outbound_links=400), False, "2-page-content"), (dict(is_noindex=True), False, "2-page-content"),
    (dict(link_directory_markers="x", outbound_links=160), False, "2-page-content"),
    (dict(home_checked=True, home_content_spam=True), False, "3-homepage"),
    (dict(home_checked=True, home_parked_markers="x"), False, "3-homepage"),
    (dict(), True, "4-metrics"), (dict(tier="B", content_spam=True), True, "4-metrics"),
    (dict(link_directory_markers="x", outbound_links=20), True, "4-metrics"),
    (dict(home_content_spam=True), True, "4-metrics"),
]
BASE = dict(status_verdict="LIVE", status_code=200, tier="D", content_spam=False, parked_markers="", outbound_links=10,
            link_directory_markers="", is_noindex=False, home_checked=False, home_content_spam=False,
            home_parked_markers="", home_same_as_page=False, da=80.0, word_count=400, target_checked=True, link_found=True,
            is_followed=True, link_placement="in-content", link_is_sitewide=False, network_id="", network_size=0)
SCHEMA = ("i int, status_verdict string, status_code int, tier string, content_spam boolean, parked_markers string, "
          "outbound_links int, link_directory_markers string, is_noindex boolean, home_checked boolean, "
          "home_content_spam boolean, home_parked_markers string, home_same_as_page boolean, da double, word_count int, "
          "target_checked boolean, link_found boolean, is_followed boolean, link_placement string, "
          "link_is_sitewide boolean, network_id string, network_size int")


def frame(spark, cases):
    return spark.createDataFrame([(i, *{**BASE, **c}.values()) for i, c in enumerate(cases)], SCHEMA)


def test_gates(spark):
    out = gate.with_gate(frame(spark, [c for c, _, _ in GATE]), CFG).orderBy("i").collect()
    assert [(r.gate_passed, r.gate_stage) for r in out] == [(p, s) for _, p, s in GATE]
    assert all(r.needs_metrics == r.gate_passed and r.gate_reason for r in out)
    open_ = gate.with_gate(frame(spark, [GATE[0][0]]), CFG.with_changes(staged=False)).first()
    assert open_.gate_passed and open_.gate_stage == "4-metrics" and open_.gate_reason == ""


def test_gate_works_without_optional_columns(spark):
    df = spark.createDataFrame([("LIVE",), (None,)], "status_verdict string")
    assert [r.gate_stage for r in gate.with_gate(df, CFG).collect()] == ["4-metrics", "1-live"]


def test_scores(spark):
    cases = [dict(), dict(home_checked=True, home_content_spam=True), dict(link_is_sitewide=True, link_placement="boilerplate"),
             dict(network_id="NET-1", network_size=3), dict(network_id="NET-1", network_size=5, da=20.0), dict(link_found=False),
             dict(status_verdict="DEAD"), dict(status_verdict="SSL_ERROR"), dict(parked_markers="p"), dict(da=None),
             dict(home_checked=True, home_content_spam=True, home_same_as_page=True), dict(da=91.0), dict(da=93.0)]
    out = score.with_score(frame(spark, cases), CFG).orderBy("i").collect()
    plain, flipped, sitewide, network3, network5, lost, dead, tls, parked, none, own, half_even, half_odd = out
    assert plain.score == 69 and plain.verdict == "REVIEW"
    assert flipped.score == 29 and flipped.verdict == "TOXIC" and flipped.spam_evidence
    assert sitewide.score == 57 and network3.score == 57 and network3.verdict == "REVIEW"
    assert network5.verdict == "TOXIC"
    assert lost.verdict == "LINK_LOST" and dead.score == 5 and dead.verdict == "DEAD"
    assert tls.verdict == "BLOCKED" and tls.score == 40 and parked.score == 8 and parked.verdict == "TOXIC"
    assert none.score == 58 and "no authority metrics" in none.issues and own.score == 69
    assert half_even.score == 74 and half_odd.score == 76  # 74.5 and 75.5 round to even
    assert plain.issues == "none" and plain.issue_count == 0
    assert plain.wins == "strong DA 80; live; followed link; editorial link"


def test_issue_count_equals_issues(spark):
    rng = random.Random(5)
    fixed = ("tier", "status_verdict")
    pick = {k: [v, not v] if isinstance(v, bool) else [v, "x"] if isinstance(v, str) and k not in fixed else [v]
            for k, v in BASE.items()}
    cases = [{k: rng.choice(v) for k, v in pick.items()} for _ in range(60)]
    for r in score.with_score(frame(spark, cases), CFG).collect():
        assert r.issue_count == (0 if r.issues == "none" else len(r.issues.split("; ")))


def test_unparsed_page_is_not_link_lost(spark):
    df = frame(spark, [dict(link_found=False)]).withColumn("page_parsed", F.lit(False))
    assert score.with_score(df, CFG).first().verdict == "REVIEW"


def test_config_from_mapping():
    cfg = AuditConfig.from_mapping({
        "target_site": "a.com", "target_aliases": ["b.com"], "scoring": {"penalties": {"nofollow": 1}, "thresholds": {"good": 80}},
        "content": {"expected_languages": [], "relevance_synonyms": {"x": ["y"]}}, "network_footprint": {"penalty_per_cluster": 9}})
    assert cfg.penalties["nofollow"] == 1 and cfg.penalties["network"] == 9 and cfg.good == 80
    assert cfg.penalties["ugc"] == DEFAULT_PENALTIES["ugc"] and cfg.expected_languages == () and cfg.brands() == ["a"]


def test_disagreements_and_actions(spark):
    df = spark.createDataFrame([
        (True, "No Issues", "TOXIC"), (True, "No Issues", "DEAD"), (True, "Spammy", "GOOD"), (True, "Spammy", "TOXIC"),
        (False, "Spammy", "GOOD"), (True, "", "TOXIC")], "in_master boolean, master_status string, verdict string")
    out = report.with_master_key(report.with_action(df)).collect()
    assert [r.master_disagrees for r in out] == ["clean_now_bad", "clean_now_dead", "spammy_now_clean", "", "", ""]
    assert [r.action_group for r in out] == ["correct_sheet_bad", "fix", "correct_sheet_clean", "disavow", "none", "disavow"]
    assert [r.known for r in out] == ["clean", "clean", "spammy", "spammy", "new", "other"]


def test_anchor_profile(spark):
    rows = [(True, True, ["corporate tools"])] * 4 + [(True, True, ["Acme"]), (True, False, ["https://acme.org/x.de"]), (False, False, ["lost"])]
    df = spark.createDataFrame(rows, "link_found boolean, is_followed boolean, anchor_list array<string>")
    cfg = AuditConfig(brand_terms=("acme",))
    total = anchors.anchor_summary(df, cfg).first()
    assert (total.total, total.distinct_anchors, total.top_anchor, total.top_n, total.followed) == (6, 3, "corporate tools", 4, 5)
    assert {r.warning for r in anchors.anchor_warnings(df, cfg).collect()} == {"one_anchor_dominates", "too_many_keyword_anchors"}
    empty = df.where("false")
    assert anchors.anchor_warnings(empty, cfg).count() == 0 and anchors.anchor_summary(empty, cfg).first().total == 0


FOOT = "registered string, ip string, generator string, page_title string, shared_host boolean, net_org string"


def clusters_of(spark, rows, size=3):
    df = spark.createDataFrame(rows, FOOT)
    signals = network.footprint_signals(df, [F.col("registered")])
    domains = network.domain_groups(signals, network.signal_groups(signals, size))
    return domains, network.link_clusters(domains)


def test_footprints(spark):
    farm = [(f"d{i}.com", "10.0.0.1", "PHP Link Directory 5.3", f"Name{i} Directory", False, "") for i in range(3)]
    genuine = [("real.com", "10.9.0.1", "Hugo", "Real bakery", False, "")]
    domains, found = clusters_of(spark, farm + genuine)
    assert [(r.cluster_id, r["size"], r.first_member) for r in found.collect()] == [("NET-1", 3, "d0.com")]
    assert sorted(r.registered for r in network.cluster_members(domains, found).collect()) == ["d0.com", "d1.com", "d2.com"]
    only_cms = [(f"w{i}.com", f"10.{i}.0.1", "WordPress 6", f"Site number {chr(97 + i)}xyz", False, "") for i in range(4)]
    assert clusters_of(spark, only_cms)[1].count() == 0
    cdn = [(f"c{i}.com", "10.5.5.5", "", f"Shop {chr(97 + i)}abc", True, "cloudflare") for i in range(4)]
    assert clusters_of(spark, cdn)[1].count() == 0
    small_host = [(f"s{i}.com", "10.6.6.6", "", f"Blog {chr(97 + i)}abc", False, "Tiny Host Ltd") for i in range(4)]
    assert clusters_of(spark, small_host)[1].first()["size"] == 4


def brute_force(rows, size):
    """Clusters by plain set algebra."""
    groups = {}
    for reg, ip, cms, title, shared, org in rows:
        facts = {"same IP ": ip, "same /24 ": ip.rsplit(".", 1)[0] + ".0/24" if ip else "", "same CMS ": cms.lower(),
                 "templated title ": title.lower(), "same host ": "" if shared else org.lower()}
        for kind, value in facts.items():
            if value:
                groups.setdefault((kind, value), set()).add(reg)
    shared_of = {r[0]: r[4] for r in rows}
    big = {k: v for k, v in groups.items() if len(v) >= size}
    ok = {}
    for (kind, value), members in big.items():
        if kind == "same IP " and any(shared_of[m] for m in members):
            continue
        if kind == "same /24 " and (all(shared_of[m] for m in members) or any(
                k[0] == "same IP " and members <= v and not any(shared_of[m] for m in v) for k, v in big.items())):
            continue
        ok[kind + value] = members
    found = {}
    for reg in sorted(shared_of):
        mine = sorted(k for k, v in ok.items() if reg in v)
        if len(mine) >= 2:
            members = frozenset(itertools.chain(*(ok[k] for k in mine)))
            found[members] = min(found.get(members, "~"), "; ".join(mine))
    return sorted((-len(m), min(m), labels) for m, labels in found.items()), found


def test_clusters_against_brute_force(spark):
    rng = random.Random(11)
    for size in (3, 5):
        rows = [(f"d{i:03}.com", rng.choice(["", "10.0.0.1", "10.0.0.2", "10.0.1.1", f"10.1.{i % 9}.7"]),
                 rng.choice(["", "cms", "wiki", "blog"]), rng.choice(["alpha", "beta", "gamma", f"t{chr(97 + i % 26)}q"]),
                 rng.random() < 0.15, rng.choice(["", "orga", "orgb"])) for i in range(90)]
        ordered, found = brute_force(rows, size)
        domains, clusters = clusters_of(spark, rows, size)
        got = [(-r["size"], r.first_member, r.signals) for r in clusters.orderBy("rank").collect()]
        assert got == ordered
        annotated = network.with_network(spark.createDataFrame(rows, FOOT), [F.col("registered")], size)
        by_labels = {labels: members for members, labels in found.items()}
        rank = {labels: i for i, (_, _, labels) in enumerate(ordered, 1)}
        for r in annotated.collect():
            mine = [rank[labels] for labels, members in by_labels.items() if r.registered in members]
            assert r.network_id == (f"NET-{max(mine)}" if mine else "")


def test_disavow(spark):
    rows = spark.createDataFrame([
        ("TOXIC", "a.x.zapto.org", "zapto.org", True), ("TOXIC", "b.bad.com", "bad.com", False), ("TOXIC", "bad.com", "bad.com", False),
        ("LOW_VALUE", "low.com", "low.com", False), ("LINK_LOST", "l.com", "l.com", False), ("DEAD", "d.com", "d.com", False)],
        "verdict string, host string, registered string, free_subdomain boolean")
    assert {r.entry for r in report.disavow_entries(rows).collect()} == {"domain:a.x.zapto.org", "domain:bad.com"}
    old = report.parse_disavow(spark.createDataFrame([(x,) for x in ("# head", "domain:oldspam.com", "domain: stillbad.net # why", "")], "line string"))
    new = report.parse_disavow(spark.createDataFrame([("DOMAIN:newspam.xyz",), ("domain:.stillbad.net",)], "line string"))
    diff = report.disavow_diff(old, new)
    assert {(r.entry, r.change) for r in diff.collect()} == {
        ("domain:newspam.xyz", "added"), ("domain:oldspam.com", "removed"), ("domain:stillbad.net", "unchanged")}
    counts = report.disavow_counts(diff).first()
    assert counts.merged == 3 and counts.added + counts.unchanged == counts.candidate


def test_distinct_audit_rows_meet_as_narrow_line_items(spark, tmp_path):
    from anchorlake.plans.q_audit import _distinct
    from anchorlake.plans.registry import Tables

    items = spark.createDataFrame([(1, 2, 3, 1, 7.0), (1, 2, 3, 1, 5.0), (1, 2, 3, 2, 9.0)],
                                  "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = _distinct(Tables(spark, str(tmp_path)))
    plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.url, r.word_count, r.final_url) for r in rows.collect()) == [
        (u, w, u) for u, w in (("https://s3.com/1/1/2", 100), ("https://s3.com/1/2/2", 180))]
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "min_by" not in plan


def test_a_gate_stage_needs_none_of_the_columns_of_its_reason(spark):
    from anchorlake.operators.gate import with_gate

    rows = spark.createDataFrame([("LIVE", "casino"), ("DEAD", "")], "status_verdict string, url_spam_categories string").withColumn(
        "error", F.lit("x")).withColumn("status_code", F.expr("uuid()"))
    gated = with_gate(rows, AuditConfig())
    assert [r.gate_stage for r in gated.collect()] == ["2-page-content", "1-live"]
    assert "uuid" not in gated.select("gate_stage")._jdf.queryExecution().optimizedPlan().toString()
