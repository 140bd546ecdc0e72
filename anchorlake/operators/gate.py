"""Staged gates, render flags, and the merge of browser-rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.functions.status import is_reachable
from anchorlake.operators.columns import Row

LIVE, PAGE, HOME, METRICS = "1-live", "2-page-content", "3-homepage", "4-metrics"


def with_gate(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """First failing stage per row, why it stopped there, and whether metrics are worth buying."""
    r = Row(df)
    verdict = F.coalesce(r.get("status_verdict").cast("string"), F.lit("ERROR"))
    code = r.text("status_code")
    not_live = (
        F.when(verdict == "DNS_ERROR", "the name does not resolve")
        .when(verdict == "SSL_ERROR", "the certificate is broken")
        .when(verdict == "RATE_LIMITED", "the host is rate limiting")
        .when(verdict == "ERROR", F.when(r.text("error") == "", "unreachable").otherwise(r.text("error")))
        .otherwise(F.concat(F.lit("the page answers "), code)))
    outbound, home_outbound = r.count("outbound_links"), r.count("home_outbound_links")
    home = r.flag("home_checked")
    tests: list[tuple[str, Column, Column]] = [
        (LIVE, ~is_reachable(verdict), F.concat(F.lit("not live: "), not_live)),
        (PAGE, r.text("parked_markers") != "",
         F.concat(F.lit("parked page: "), r.text("parked_markers"))),
        (PAGE, r.text("url_spam_categories") != "",
         F.concat(F.lit("spam words in the URL: "), r.text("url_spam_categories"))),
        (PAGE, r.flag("content_spam") & ~r.text("tier").isin("A", "B"),
         F.concat(F.lit("spam content: "), r.text("content_spam_categories"))),
        (PAGE, r.flag("link_in_hidden_block"), F.lit("the link is hidden from readers")),
        (PAGE, outbound >= cfg.outbound_bad,
         F.concat(F.lit("link farm: "), outbound.cast("string"), F.lit(" outbound links"))),
        (PAGE, (r.text("link_directory_markers") != "") & (outbound >= cfg.outbound_warn),
         F.concat(F.lit("link directory: "), outbound.cast("string"), F.lit(" outbound links"))),
    ]
    if cfg.noindex_fails_gate:
        tests.append((PAGE, r.flag("is_noindex"), F.lit("noindex page")))
    tests += [
        (HOME, home & (r.text("home_parked_markers") != ""),
         F.concat(F.lit("the home page is parked: "), r.text("home_parked_markers"))),
        (HOME, home & r.flag("home_content_spam"),
         F.concat(F.lit("the home page is spam: "), r.text("home_content_spam_categories"))),
        (HOME, home & (home_outbound >= cfg.outbound_bad),
         F.concat(F.lit("the home page is a link farm: "), home_outbound.cast("string"),
                  F.lit(" outbound links"))),
    ]
    home_verdict = r.text("home_status_verdict")
    passed_note = F.when(
        home & (home_verdict != "") & ~is_reachable(home_verdict),
        F.concat(F.lit("passed, but the home page is "), home_verdict)).otherwise("passed every gate")
    if not cfg.staged:
        tests, passed_note = [], F.lit("")
    # which test fails first; a stage asked for without its reason then needs none of the reason's columns
    at = F.lit(len(tests))
    for k, (_, failing, _) in reversed(list(enumerate(tests))):
        at = F.when(failing, k).otherwise(at)
    stage, reason = F.lit(METRICS), passed_note
    for k, (name, _, why) in enumerate(tests):
        stage = F.when(F.col("_gate") == k, name).otherwise(stage)
        reason = F.when(F.col("_gate") == k, why).otherwise(reason)
    passed = F.col("_gate") == len(tests)
    needs = F.lit(True) if not cfg.metrics_only_for_passing else passed
    return df.withColumn("_gate", at).withColumns({
        "gate_passed": passed, "gate_stage": stage, "gate_reason": reason, "needs_metrics": needs}).drop("_gate")


def with_render_flags(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Which rows deserve a look in a browser, and why."""
    r = Row(df)
    reachable = is_reachable(r.get("status_verdict").cast("string"))
    blocked = r.text("status_verdict").isin("BLOCKED", "RATE_LIMITED", "SSL_ERROR")
    missing = (r.flag("target_checked") & reachable & ~r.flag("link_found")
               & (r.text("page_error") == ""))
    needs = missing | (blocked & F.lit(cfg.render_blocked))
    return df.withColumn("needs_render", needs).withColumn(
        "render_reason", F.when(blocked, "blocked").when(needs, "link-missing").otherwise(""))


def merge_rendered(df: DataFrame, rendered: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Prefer the browser's view where it adds something, then gate again.

    ``rendered`` holds page features of rendered HTML by ``url``. A page that refused
    the crawler becomes LIVE and keeps its original status; a page with a missing link
    is replaced only if the browser shows the link.
    """
    from anchorlake.operators.keyed import lookup

    shared = [c for c in rendered.columns if c in df.columns and c != "url"]
    asked = df.withColumn("_ask", F.when(F.col("needs_render"), F.coalesce(
        F.nullif(Row(df).text("final_url"), F.lit("")), F.col("url"))))
    seen = rendered.select(
        F.col("url").alias("_ask"), F.struct(*shared).alias("_seen"),
        F.col("link_found").alias("_seen_link"))
    out = lookup(asked, seen, "_ask")
    got = F.col("_seen").isNotNull()
    unblocked = got & (F.col("render_reason") == "blocked")
    recovered = got & ~unblocked & F.coalesce("_seen_link", F.lit(False))
    use = unblocked | recovered
    out = out.withColumns({
        "rendered": got,
        "original_status_code": F.when(unblocked, Row(df).get("status_code")),
        "original_status_verdict": F.when(unblocked, F.col("status_verdict")),
        "render_note": F.when(unblocked, "refused the crawler but readable in a browser")
        .when(recovered, "the link appears only after scripts ran")
        .when(got, "no link in the browser either")
        .when(F.col("needs_render"), "not rendered").otherwise(""),
        "_use": use, "_unblocked": unblocked})
    out = out.withColumns({c: F.when(F.col("_use"), F.col("_seen")[c]).otherwise(F.col(c))
                           for c in shared})
    out = out.withColumn("status_verdict", F.when(
        F.col("_unblocked"), "LIVE").otherwise(F.col("status_verdict")))
    if "error" in out.columns:
        out = out.withColumn("error", F.when(F.col("_unblocked"), "").otherwise(F.col("error")))
    out = out.drop("_ask", "_seen", "_seen_link", "_use", "_unblocked",
                   "gate_passed", "gate_stage", "gate_reason", "needs_metrics")
    return with_gate(out, cfg)
