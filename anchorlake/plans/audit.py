"""The whole audit over observation tables; its narrow stages are stored on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.functions import urls as U
from anchorlake.functions.status import status_verdict
from anchorlake.operators import classify, fetchlog, links, master, metrics, network, observations, pages
from anchorlake.operators.gate import merge_rendered, with_gate, with_render_flags
from anchorlake.operators.keyed import first_per_key, lookup
from anchorlake.operators.report import triage_order, with_action
from anchorlake.operators.score import with_score
from anchorlake.operators.textscan import scan_urls
from anchorlake.rules import DEFAULT_KEYWORDS, Keyword
from anchorlake.session import cut_lineage


@dataclass
class Observations:
    """Tables an audit reads; every one but ``pages`` is optional."""

    pages: DataFrame                      # url, html[, content_type]
    attempts: DataFrame | None = None     # url, label, status, error, seq
    redirects: DataFrame | None = None    # from_url, to_url, status
    dns: DataFrame | None = None          # host, resolved, ips, dns_error
    robots: DataFrame | None = None       # origin, status, body
    rdap: DataFrame | None = None         # ip, payload
    rendered: DataFrame | None = None     # url, html as a browser shows it
    archive: DataFrame | None = None      # url, snapshot_url, ts, html
    master: DataFrame | None = None       # see operators.master.MASTER_SCHEMA
    metric_sources: list[DataFrame] | None = None


def page_rows(
    obs: Observations, cfg: AuditConfig, rules: list[Keyword] = DEFAULT_KEYWORDS,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Features of every stored page; HTML is parsed once and dropped.

    ``wanted`` (url, input_target) names the sites that pages should link to; a page
    wanted for several targets gives one row for each.
    """
    source = obs.pages
    if "content_type" in source.columns:
        source = pages.readable_pages(source)
    parsed = pages.parse_pages(source.select("url", "html"))
    if wanted is None:
        parsed = parsed.withColumn("input_target", F.lit(""))
    else:
        parsed = parsed.join(wanted, "url", "left").withColumn(
            "input_target", F.coalesce("input_target", F.lit("")))
    return pages.page_features(parsed, cfg, rules)


def status_rows(backlinks: DataFrame, obs: Observations) -> DataFrame:
    """Status and final URL per link.

    Redirects are followed first: the first hop decides between a permanent and a temporary
    redirect, a loop is an error, and what is stored under the final URL is the page. Without
    a fetch log a stored page counts as answered.
    """
    out = backlinks
    if obs.redirects is not None:
        landed = fetchlog.resolve_redirects(obs.redirects).withColumnRenamed("status_code", "_first_hop")
        out = lookup(out, landed, "url")
        out = out.withColumns({"final_url": F.coalesce("final_url", "url"),
                               "redirect_hops": F.coalesce("redirect_hops", F.lit(0))})
    else:
        out = out.withColumns({"final_url": F.col("url"), "redirect_hops": F.lit(0)})
    if obs.attempts is None:
        have = obs.pages.select(F.col("url").alias("final_url")).distinct().withColumn("_have", F.lit(True))
        out = lookup(out, have, "final_url").withColumns({
            "status_code": F.when(F.col("_have"), 200),
            "status_verdict": F.when(F.col("_have"), "LIVE").otherwise("ERROR"),
            "https": F.col("url").startswith("https://"), "error": F.lit(""),
            "tls_invalid": F.lit(False), "https_unavailable": F.lit(False), "ip": F.lit("")}).drop("_have")
    else:
        resolved = fetchlog.resolve_attempts(obs.attempts, obs.dns).drop("host")
        out = lookup(out, resolved, "url").withColumn(
            "status_verdict", F.coalesce("status_verdict", F.lit("ERROR")))
    if obs.redirects is None:
        return out
    endless = F.coalesce("redirect_error", F.lit("")) != ""
    moved = (F.col("redirect_hops") > 0) & F.col("status_verdict").isin("LIVE", "REDIRECT_PERM", "REDIRECT_TEMP")
    return out.withColumns({
        "status_code": F.when(moved & ~endless, F.col("_first_hop")).otherwise(F.col("status_code")),
        "status_verdict": F.when(endless, "ERROR").when(moved, status_verdict(F.col("_first_hop")))
        .otherwise(F.col("status_verdict")),
        "error": F.when(endless, F.col("redirect_error")).otherwise(F.col("error"))}).drop("_first_hop")


def home_rows(features: DataFrame, obs: Observations) -> DataFrame:
    """Stored home pages, and homes the fetch log knows, with the status logged for them."""
    homes = features.where(U.is_homepage(F.col("url"))).drop("input_target")
    if obs.attempts is None:
        return homes.withColumn("status_verdict", F.when(F.col("page_parsed"), "LIVE").otherwise("ERROR")).withColumn(
            "status_code", F.when(F.col("page_parsed"), 200))
    logged = fetchlog.resolve_attempts(obs.attempts.where(U.is_homepage(F.col("url"))), obs.dns).select(
        "url", "status_code", "status_verdict")
    both = homes.drop("status_code", "status_verdict").join(logged, "url", "full_outer")
    return both.withColumns({
        "status_code": F.coalesce("status_code", F.when(F.col("page_parsed"), 200)),
        "status_verdict": F.coalesce("status_verdict", F.when(F.col("page_parsed"), "LIVE").otherwise("ERROR"))})


def audit(
    backlinks: DataFrame, obs: Observations, cfg: AuditConfig, authority: DataFrame,
    rules: list[Keyword] = DEFAULT_KEYWORDS, as_of: Column | None = None, cluster: bool = True,
) -> DataFrame:
    """Audit rows with verdicts for ``backlinks`` (url, target, anchor, notes).

    Each link is checked against its own target, or ``cfg.target_site`` where it has none.
    Metrics are joined only for rows that passed the gates, and rows are scored again once
    their link network is known. Links that targets of their own are given for cost one
    shuffle of the page texts; a list without targets is spared it.
    """
    rows = classify.with_domain_parts(backlinks.withColumnsRenamed(
        {"target": "input_target", "anchor": "input_anchor"}), "url")
    # the link list alone is cheap to read again, so hot keys are counted there
    keys = rows.select("host", "registered", U.origin_of(F.col("url")).alias("origin"))
    rows = scan_urls(classify.with_trust_tier(rows, authority), rules)
    if obs.master is not None:
        rows = master.master_lookup(rows, obs.master, keys)
    # slim so far and read several times below: written once
    rows = cut_lineage(fetchlog.with_root_probe(status_rows(rows, obs)).withColumn(
        "input_target", F.trim(F.coalesce("input_target", F.lit("")))))
    own_targets = rows.where("input_target != ''").limit(1).count() > 0
    wanted = rows.select(F.col("final_url").alias("url"), "input_target").distinct() if own_targets else None
    # pages are parsed once; their features serve links, home pages and samples
    features = cut_lineage(page_rows(obs, cfg, rules, wanted))
    facts = first_per_key(features, ["url", "input_target"], [F.col("word_count"), F.col("h1")])
    if cfg.sitewide_sample:
        seen = first_per_key(features.select("url", "linked_domains", "word_count"), ["url"], [F.col("word_count")])
        facts = links.sitewide_sample(facts, seen, cfg.sitewide_sample)
    page_key = F.concat_ws("\u0001", F.col("final_url"), F.col("input_target"))
    facts = facts.withColumnRenamed("url", "final_url").withColumn("_page", page_key).drop(
        "final_url", "input_target", "linked_domains")
    rows = rows.withColumn("_page", page_key)
    rows = lookup(rows, facts, "_page", key_source=rows.select("_page")).drop("_page")
    rows = rows.withColumns({
        "page_parsed": F.coalesce("page_parsed", F.lit(False)),
        "link_found": F.coalesce("link_found", F.lit(False)),
        "target_checked": (F.col("input_target") != "") | F.lit(bool(cfg.target_site))})
    rows = pages.with_homepage(rows, home_rows(features, obs), key_source=keys)
    if obs.robots is not None:
        rows = observations.robots_verdict(rows, obs.robots, "final_url")
    rows = with_gate(with_render_flags(rows, cfg), cfg)
    if obs.rendered is not None:
        rows = merge_rendered(rows, _seen(obs.rendered, cfg, rules), cfg)
    if obs.archive is not None:
        rows = observations.recover_from_archive(rows, _snapshots(obs.archive, cfg, rules))
    rows = _with_metrics(rows, obs, cfg, as_of)
    if obs.rdap is not None:
        rows = observations.attach_hosting(rows, observations.hosting_from_rdap(obs.rdap))
    rows = with_score(rows, cfg)
    if cluster:
        # read by the footprint and again for the final rows: computed once
        rows = cut_lineage(rows)
        rows = with_score(network.with_network(rows, triage_order(), cfg.min_cluster), cfg)
    return with_action(rows)


def _seen(rendered: DataFrame, cfg: AuditConfig, rules: list[Keyword]) -> DataFrame:
    """Features of rendered pages, one row per URL."""
    features = pages.page_features(pages.parse_pages(rendered.select("url", "html")), cfg, rules)
    return first_per_key(features, ["url"], [F.col("word_count"), F.col("h1")])


def _snapshots(archive: DataFrame, cfg: AuditConfig, rules: list[Keyword]) -> DataFrame:
    """Title, link state and anchors of archived pages; unreadable ones keep nulls."""
    parsed = pages.parse_pages(archive.select("url", "snapshot_url", "ts", "html"))
    found = links.with_link_features(parsed, cfg)
    readable = F.col("page_error") == ""
    return found.select("url", "snapshot_url", "ts", F.when(readable, F.col("title")).alias("page_title"),
                        F.when(readable, F.col("link_found")).alias("link_found"), "anchor_texts")


def _with_metrics(
    rows: DataFrame, obs: Observations, cfg: AuditConfig, as_of: Column | None
) -> DataFrame:
    wanted = rows.where("needs_metrics").select("registered").distinct()
    sources = list(obs.metric_sources or [])
    if obs.master is not None and as_of is not None:
        sources.insert(0, master.fresh_metrics(wanted, obs.master, as_of, cfg.reuse_metrics_days))
    if not sources:
        return rows.withColumns({"da": F.lit(None).cast("double"), "spam_score": F.lit(None).cast("double")})
    return metrics.attach_metrics(rows, metrics.resolve_metrics(wanted, sources))


def verdicts_by_domain(rows: DataFrame) -> DataFrame:
    """Verdict histogram per registered domain."""
    return rows.groupBy("registered", "verdict").agg(
        F.count("*").alias("links"), F.bround(F.avg("score"), 1).alias("avg_score"))
