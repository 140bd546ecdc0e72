"""Summaries, facets, actions, outreach and disavow sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions.status import status_group
from anchorlake.operators.columns import Row
from anchorlake.operators.keyed import Ordered


def verdict_rank(verdict: Column) -> Column:
    rank = F.lit(99)
    for i, name in enumerate(fixed.VERDICT_ORDER):
        rank = F.when(verdict == name, i).otherwise(rank)
    return rank


def triage_order() -> list[Column]:
    """Most urgent first; the URL makes the order total."""
    return [verdict_rank(F.col("verdict")), F.col("score"), F.col("url")]


def triage(rows: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = rows.orderBy(*triage_order())
    return ordered if limit is None else ordered.limit(limit)


# ----------------------------------------------------------- row columns -----
def with_disagreement(rows: DataFrame) -> DataFrame:
    """Where the live result contradicts the master list."""
    r = Row(rows)
    status = F.lower(r.text("master_status"))
    clean, spammy = status.contains("no issue"), status.contains("spam")
    verdict, known = r.text("verdict"), r.flag("in_master")
    return rows.withColumn("master_disagrees", (
        F.when(~known, "")
        .when(clean & (verdict == "TOXIC"), "clean_now_bad")
        .when(clean & (verdict == "DEAD"), "clean_now_dead")
        .when(spammy & verdict.isin("GOOD", "REVIEW"), "spammy_now_clean")
        .otherwise("")))


def with_action(rows: DataFrame) -> DataFrame:
    """The single next action for a link."""
    rows = rows if "master_disagrees" in rows.columns else with_disagreement(rows)
    r = Row(rows)
    verdict, score = r.text("verdict"), F.coalesce(r.number("score"), F.lit(0.0))
    weak = (r.flag("is_nofollow") | r.flag("is_sponsored") | r.flag("is_ugc")
            | r.flag("link_is_sitewide"))
    return rows.withColumn("action_group", (
        F.when(F.col("master_disagrees") == "clean_now_bad", "correct_sheet_bad")
        .when(F.col("master_disagrees") == "spammy_now_clean", "correct_sheet_clean")
        .when(verdict == "TOXIC", "disavow").when(verdict == "LINK_LOST", "reclaim")
        .when(verdict == "DEAD", "fix").when(verdict == "BLOCKED", "verify")
        .when(r.flag("link_found") & (score >= 50) & weak, "upgrade")
        .when(r.flag("needs_metrics") & r.number("da").isNull(), "metrics")
        .otherwise("none")))


def with_master_key(rows: DataFrame) -> DataFrame:
    r = Row(rows)
    status = F.lower(r.text("master_status"))
    return rows.withColumn("known", (
        F.when(~r.flag("in_master"), "new").when(status.contains("spam"), "spammy")
        .when(status.contains("no issue"), "clean").otherwise("other")))


def with_facets(rows: DataFrame) -> DataFrame:
    """All eight facet columns of a row."""
    rows = with_master_key(with_action(rows))
    r = Row(rows)
    return rows.withColumns({
        "action_facet": F.col("action_group"), "status": status_group(r.text("status_verdict")),
        "stage": r.text("gate_stage"),
        "placement": F.when(~r.flag("link_found"), "none").otherwise(
            F.coalesce(F.nullif(r.text("link_placement"), F.lit("")), F.lit("unknown"))),
        "network": F.when(r.text("network_id") != "", "yes").otherwise("no")})


FACETS = {"action": "action_facet", "verdict": "verdict", "status": "status", "tier": "tier",
          "stage": "stage", "placement": "placement", "network": "network", "known": "known"}


# ------------------------------------------------------------- summaries -----
def summarise(rows: DataFrame) -> DataFrame:
    """One row of counts and averages over a run, in a single pass."""
    rows = with_disagreement(rows)
    r = Row(rows)
    status = F.lower(r.text("master_status"))
    known, checked, found = r.flag("in_master"), r.flag("target_checked"), r.flag("link_found")
    group, disagrees = status_group(r.text("status_verdict")), F.col("master_disagrees")
    conditions = {
        "with_metrics": r.number("da").isNotNull(), "gate_passed": r.flag("gate_passed"),
        "home_checked": r.flag("home_checked"), "home_spam": r.flag("home_content_spam"),
        "links_checked": checked, "links_live": checked & found,
        "links_followed": checked & r.flag("is_followed"),
        "links_sitewide": r.flag("link_is_sitewide"),
        "links_incontent": r.text("link_placement") == "in-content",
        "noindex": r.flag("is_noindex"), "lang_mismatch": r.flag("lang_mismatch"),
        "tls_invalid": r.flag("tls_invalid"), "no_https": r.flag("https_unavailable"),
        "in_network": r.text("network_id") != "",
        "truly_sitewide": (r.count("sitewide_sampled") >= 2)
        & (F.coalesce(r.number("sitewide_ratio"), F.lit(0.0)) >= 1.0),
        "js_recovered": r.flag("rendered") & found, "archive_recovered": r.flag("archive_link_found"),
        "shared_hosted": r.flag("shared_host"), "in_master": known,
        "master_spammy": known & status.contains("spam"),
        "master_clean": known & status.contains("no issue"), "brand_new": ~known,
        "master_disagrees": disagrees != "", "clean_now_bad": disagrees == "clean_now_bad",
        "spammy_now_clean": disagrees == "spammy_now_clean",
        "http_200": group == "200", "http_3xx": group == "3xx", "http_404": group == "404",
        "http_5xx": group == "5xx", "http_blocked": group.isin("blocked", "tls"),
        "http_dns": group == "dns", "http_ssl": group == "tls", "http_err": group.isin("error", "dns"),
        **{"verdict_" + v.lower(): r.text("verdict") == v for v in fixed.VERDICT_ORDER},
        **{"tier_" + t.lower(): r.text("tier") == t for t in "ABCD"},
    }
    return rows.agg(
        F.count("*").alias("total"),
        F.bround(F.avg(F.coalesce(r.number("score"), F.lit(0.0))), 1).alias("avg_score"),
        F.bround(F.avg(r.number("da")), 1).alias("avg_da"),
        *[F.count_if(c).alias(n) for n, c in conditions.items()])


def kpis(rows: DataFrame) -> DataFrame:
    """Headline ratios of a run."""
    r = Row(rows)
    checked = r.flag("target_checked")
    bad = r.text("verdict").isin("TOXIC", "LINK_LOST", "DEAD")
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(checked).alias("checked"),
        F.count_if(checked & r.flag("link_found")).alias("live"), F.count_if(bad).alias("need_action"))
    return counts.select(
        "total", "need_action",
        F.bround(100.0 * F.col("live") / F.greatest("checked", F.lit(1)), 0).cast("int").alias("live_pct"),
        F.bround(100.0 * (F.col("total") - F.col("checked")) / F.greatest("total", F.lit(1)), 0)
        .cast("int").alias("unverifiable_pct"))


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column separately, in one pass over the rows."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("value"))
        for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def facet_counts(rows: DataFrame) -> DataFrame:
    """Counts of every value of every facet."""
    faceted = with_facets(rows)
    return histogram(faceted.select(*[F.col(c).alias(f) for f, c in FACETS.items()]), list(FACETS))


def facet_filter(
    rows: DataFrame, chosen: dict[str, str], search: str = "", columns: list[str] | None = None
) -> DataFrame:
    """Rows matching every chosen facet value and, in any of ``columns``, the search text."""
    out = with_facets(rows)
    for facet, value in chosen.items():
        out = out.where(F.col(FACETS[facet]) == value)
    if search:
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or ["url", "registered"]]
        out = out.where(F.lower(F.concat_ws(" ", *texts)).contains(search.lower()))
    return out


# ---------------------------------------------------------- action lists -----
def outreach(rows: DataFrame) -> DataFrame:
    """Links worth an email, best authority first."""
    r = Row(rows)
    score, sitewide = F.coalesce(r.number("score"), F.lit(0.0)), r.flag("link_is_sitewide")
    problem = (
        F.when(r.text("verdict") == "LINK_LOST", "link removed from a live page")
        .when(r.flag("link_found") & r.flag("is_nofollow") & (score >= 55), "link is nofollow")
        .when(sitewide & (score >= 55), "link is sitewide boilerplate"))
    ask = (
        F.when(F.col("problem").startswith("link removed"), "restore the link")
        .when(F.col("problem") == "link is nofollow", "remove rel=nofollow")
        .otherwise("place one link in the content"))
    listed = rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        "registered", "url", r.number("da").alias("da"), "problem", ask.alias("ask"))
    order = [F.desc(F.coalesce("da", F.lit(0.0))), F.col("url")]
    return Ordered(listed, order, costly=True).numbered("priority")


def disavow_entries(rows: DataFrame) -> DataFrame:
    """Distinct disavow lines, only for TOXIC rows; free subdomains are named exactly."""
    r = Row(rows)
    name = F.when(r.flag("free_subdomain"), r.text("host")).otherwise(r.text("registered"))
    return rows.where(r.text("verdict") == "TOXIC").select(name.alias("_n")).where(
        F.col("_n") != "").select(F.concat(F.lit("domain:"), "_n").alias("entry")).distinct()


def disavow_comments(rows: DataFrame) -> DataFrame:
    """Link networks among the toxic rows, for the file's header."""
    r = Row(rows)
    return rows.where((r.text("verdict") == "TOXIC") & (r.text("network_id") != "")).groupBy(
        "network_id").agg(F.min("network_signals").alias("network_signals"))


def parse_disavow(lines: DataFrame, column: str = "line") -> DataFrame:
    """Entries of a disavow file: ``domain:`` lines and bare URLs, without comments."""
    bare = F.trim(F.substring_index(F.regexp_replace(F.col(column), "^﻿", ""), "#", 1))
    name = F.regexp_extract(bare, r"(?i)^\s*domain:\s*([^\s#]+)", 1)
    entry = F.when(name != "", F.concat(
        F.lit("domain:"), F.regexp_replace(F.lower(name), r"^\.+", ""))).when(
        bare.contains(".") & ~bare.contains(" "), F.lower(bare))
    return lines.select(entry.alias("entry")).where(F.col("entry").isNotNull()).distinct()


def disavow_diff(existing: DataFrame, candidate: DataFrame) -> DataFrame:
    """Every entry of the merged set with added, removed or unchanged; one shuffle."""
    both = existing.select("entry", F.lit(True).alias("o"), F.lit(False).alias("n")).unionByName(
        candidate.select("entry", F.lit(False).alias("o"), F.lit(True).alias("n")))
    return both.groupBy("entry").agg(F.bool_or("o").alias("o"), F.bool_or("n").alias("n")).select(
        "entry", F.when(~F.col("o"), "added").when(~F.col("n"), "removed")
        .otherwise("unchanged").alias("change"))


def disavow_counts(diff: DataFrame) -> DataFrame:
    change = F.col("change")
    return diff.agg(
        F.count_if(change != "added").alias("existing"), F.count_if(change != "removed").alias("candidate"),
        *[F.count_if(change == c).alias(c) for c in ("added", "removed", "unchanged")],
        F.count("*").alias("merged"))
