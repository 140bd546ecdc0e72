"""The 0-100 score, its reasons, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.functions.status import is_reachable
from anchorlake.operators.columns import Row, joined, shown

ACTIONS = {
    "GOOD": "Nothing to do.",
    "REVIEW": "Decide by hand.",
    "LOW_VALUE": "Harmless and worthless; do not disavow.",
    "TOXIC": "Check, then disavow.",
    "LINK_LOST": "Ask the site to restore the link.",
    "DEAD": "Ask for a fix, redirect, or drop it.",
    "BLOCKED": "Could not be read; open by hand or run again later.",
}


def with_score(df: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Add score, verdict, spam_evidence, issues, wins, action and issue_count.

    Everything is one set of column expressions over the row itself; scoring again
    after network clustering is applying it a second time.
    """
    r = Row(df)
    p = {k: float(v) for k, v in cfg.penalties.items()}
    tier, verdict = r.text("tier"), F.coalesce(r.get("status_verdict").cast("string"), F.lit("ERROR"))
    da, spam_score = r.number("da"), r.number("spam_score")
    reachable = is_reachable(verdict)
    redirected = verdict.isin("REDIRECT_PERM", "REDIRECT_TEMP")
    parsed = r.flag("page_parsed", True)
    checked, found = r.flag("target_checked"), r.flag("link_found")
    present = checked & found
    missing = checked & ~found & reachable & parsed
    trusted = tier.isin("A", "B")
    content_spam = r.flag("content_spam")
    outbound, home_outbound = r.count("outbound_links"), r.count("home_outbound_links")
    words = r.count("word_count")
    home = r.flag("home_checked") & ~r.flag("home_same_as_page")
    home_verdict = r.text("home_status_verdict")
    quality = reachable & parsed & (r.text("page_error") == "")
    relevance = r.number("relevance_score") if cfg.relevance_keywords else F.lit(None).cast("double")
    in_network = r.text("network_id") != ""

    def said(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    # (condition, points off, what to tell the reader; None keeps it silent)
    deductions: list[tuple[Column, float, Column | None]] = [
        (redirected, p["redirect"], said("redirects (", verdict, ") to ", r.text("final_url"))),
        (redirected & (r.count("redirect_hops") >= 3), p["redirect_chain_long"],
         said(r.count("redirect_hops").cast("string"), " redirect hops")),
        (redirected & r.flag("redirect_offsite"), p["redirect_offsite"],
         said("redirects to another domain")),
        (~r.flag("https", True), p["non_https"], said("not served over https")),
        (r.flag("tls_invalid"), p["tls_invalid"], said("untrusted certificate")),
        (r.flag("https_unavailable"), p["no_https"], said("https is not available")),
        (present & r.flag("is_nofollow"), p["nofollow"], None),
        (present & r.flag("is_sponsored"), p["sponsored"], None),
        (present & r.flag("is_ugc"), p["ugc"], None),
        (present & (r.flag("is_nofollow") | r.flag("is_sponsored") | r.flag("is_ugc")), 0.0,
         said("the link passes no signal (rel ", joined(
             F.when(r.flag("is_nofollow"), "nofollow"), F.when(r.flag("is_sponsored"), "sponsored"),
             F.when(r.flag("is_ugc"), "ugc"), sep=" "), ")")),
        (present & r.flag("link_in_hidden_block"), p["hidden_link"], said("the link is hidden")),
        (present & r.flag("link_is_sitewide"), p["sitewide_link"], said("sitewide boilerplate link")),
        (missing, p["link_missing"], said("the link is no longer on the page")),
        (r.flag("is_noindex"), p["noindex"], said("noindex page")),
        (r.flag("is_nofollow_page"), p["page_nofollow"], said("the whole page is nofollow")),
        (r.flag("robots_blocked"), p["robots_blocked"], said("disallowed by robots.txt")),
        (spam_score > 60, p["spam_score_high"], said("spam score ", shown(spam_score), "% (high)")),
        ((spam_score > 30) & (spam_score <= 60), p["spam_score_mid"],
         said("spam score ", shown(spam_score), "% (medium)")),
        (r.text("url_spam_categories") != "", p["bad_neighbourhood"],
         said("spam words in the URL: ", r.text("url_spam_categories"))),
        (content_spam & trusted, p["topical_mention"],
         said("mentions ", r.text("content_spam_categories"), " on a trusted site")),
        (content_spam & ~trusted, p["bad_neighbourhood"],
         said("spam content: ", r.text("content_spam_categories"))),
        (r.text("parked_markers") != "", 0.0, said("parked page: ", r.text("parked_markers"))),
        (r.flag("lang_mismatch"), p["lang_mismatch"], said("unexpected language ", r.text("lang"))),
        (in_network, p["network"], said("in link network ", r.text("network_id"), " of ",
                                        r.count("network_size").cast("string"), " domains")),
        (r.flag("free_subdomain"), p["free_subdomain"], said("free subdomain host")),
        (r.flag("spam_tld"), p["spam_tld"], said("risky suffix .", r.text("suffix"))),
        (home & (r.text("home_parked_markers") != ""), p["homepage_parked"],
         said("parked home page: ", r.text("home_parked_markers"))),
        (home & r.flag("home_content_spam"), p["homepage_spam"],
         said("spam home page: ", r.text("home_content_spam_categories"))),
        (home & (home_verdict != "") & ~is_reachable(home_verdict), p["homepage_dead"],
         said("the home page is ", home_verdict)),
        (home & (home_outbound >= cfg.outbound_bad), p["outbound_extreme"],
         said("the home page has ", home_outbound.cast("string"), " outbound links")),
        (quality & (words < cfg.min_word_count), p["thin_content"],
         said("thin content: ", words.cast("string"), " words")),
        (quality & (outbound >= cfg.outbound_bad), p["outbound_extreme"],
         said("link farm: ", outbound.cast("string"), " outbound links")),
        (quality & (outbound >= cfg.outbound_warn) & (outbound < cfg.outbound_bad), p["outbound_high"],
         said(outbound.cast("string"), " outbound links")),
        (quality & (r.text("link_directory_markers") != ""), p["link_directory"],
         said("link directory: ", r.text("link_directory_markers"))),
        (quality & (r.text("paid_link_markers") != ""), p["paid_link_marker"],
         said("paid placement: ", r.text("paid_link_markers"))),
        (quality & (relevance == 0) & (words >= cfg.min_word_count), p["irrelevant"],
         said("off topic")),
    ]
    statements = [
        F.when(da < 15, said("very low DA ", shown(da))),
        F.when(da.isNull(), said("no authority metrics")),
        F.when(verdict.isin(list(cfg.caps)), said("status ", verdict, " ", joined(
            F.nullif(r.text("status_code"), F.lit("")), F.nullif(r.text("error"), F.lit("")), sep=" "))),
    ]
    told = statements + [F.when(cond, text) for cond, _, text in deductions if text is not None]
    # concat_ws skips nulls and stays in generated code, which filtering an array would not
    issues = F.concat_ws("; ", *told)
    issue_count = sum((F.when(said_so.isNotNull(), 1).otherwise(0) for said_so in [
        F.when(da < 15, 1), F.when(da.isNull(), 1), F.when(verdict.isin(list(cfg.caps)), 1),
        *[F.when(cond, 1) for cond, _, text in deductions if text is not None]]), F.lit(0))
    wins = F.concat_ws(
        "; ",
        F.when(da >= 60, said("strong DA ", shown(da))),
        F.when((da >= 35) & (da < 60), said("decent DA ", shown(da))),
        F.when(verdict == "LIVE", said("live")),
        F.when(present & r.flag("is_followed"), said("followed link")),
        F.when(present & ~r.flag("link_is_sitewide") & (r.text("link_placement") == "in-content"),
               said("editorial link")),
        F.when(spam_score <= 30, said("low spam score ", shown(spam_score), "%")),
        F.when(quality & (relevance >= 50), said("on topic (", shown(relevance), "%)")))

    base = F.lit(58.0)
    for name, value in cfg.tier_base.items():
        base = F.when(tier == name, float(value)).otherwise(base)
    weight = min(max(cfg.da_weight, 0.0), 1.0)
    blended = F.when(da.isNull(), base).otherwise(base * (1 - weight) + da * weight)
    off = F.lit(0.0)
    for cond, points, _ in deductions:
        if points:
            off = off + F.when(cond, points).otherwise(0.0)
    cap = F.lit(None).cast("double")
    for name, value in cfg.caps.items():
        cap = F.when(verdict == name, float(value)).otherwise(cap)
    parked_cap = F.when(r.text("parked_markers") != "", float(cfg.parked_cap))
    score = F.bround(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), blended - off, cap, parked_cap)), 0).cast("int")

    evidence = F.coalesce(
        (home & ((r.text("home_parked_markers") != "") | r.flag("home_content_spam")
                 | (home_outbound >= cfg.outbound_bad)))
        | (r.text("url_spam_categories") != "") | (r.text("parked_markers") != "")
        | (content_spam & ~trusted) | F.coalesce(spam_score > 60, F.lit(False))
        | r.flag("link_in_hidden_block")
        | ((r.text("link_directory_markers") != "") & (outbound >= cfg.outbound_warn))
        | (outbound >= cfg.outbound_bad)
        | (in_network & (r.count("network_size") >= cfg.network_evidence_size)), F.lit(False))
    names = ["score", "spam_evidence", "verdict", "issues", "wins", "action", "issue_count"]
    scored = df.drop(*names).withColumns({
        "score": score, "spam_evidence": evidence, "_missing": missing,
        "issues": F.coalesce(F.nullif(issues, F.lit("")), F.lit("none")), "wins": wins,
        "issue_count": issue_count, "_status": verdict, "_root_note": r.text("root_note")})
    status = F.col("_status")
    final = (
        F.when(status.isin("DEAD", "GONE", "ERROR", "DNS_ERROR"), "DEAD")
        .when(status.isin("BLOCKED", "RATE_LIMITED", "SERVER_ERROR", "SSL_ERROR"), "BLOCKED")
        .when(F.col("spam_evidence") & (F.col("score") < cfg.good), "TOXIC")
        .when(F.col("_missing"), "LINK_LOST")
        .when(F.col("score") >= cfg.good, "GOOD")
        .when(F.col("score") >= cfg.review, "REVIEW")
        .otherwise("LOW_VALUE"))
    action = F.lit("")
    for name, text in ACTIONS.items():
        action = F.when(F.col("verdict") == name, text).otherwise(action)
    action = F.when((F.col("verdict") == "DEAD") & (F.col("_root_note") != ""),
                    F.concat(action, F.lit(" "), F.col("_root_note"))).otherwise(action)
    return scored.withColumn("verdict", final).withColumn("action", action).drop(
        "_missing", "_status", "_root_note")
