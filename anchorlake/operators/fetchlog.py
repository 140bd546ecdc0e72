"""Resolving fetch logs: attempts, redirects, DNS hints and root-domain probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import status as S
from anchorlake.functions import urls as U
from anchorlake.operators.keyed import first_per_key, lookup
from anchorlake.session import cut_lineage

LADDER = ["https", "https-noverify", "http"]
LADDER_HTTP = ["http", "https", "https-noverify"]


def _rung(url: Column, label: Column) -> Column:
    """Position of an attempt kind for this URL's scheme."""
    def place(order: list[str]) -> Column:
        spot = F.when(label == order[0], 1)
        for i, name in enumerate(order[1:], 2):
            spot = spot.when(label == name, i)
        return spot
    return F.when(url.startswith("http://"), place(LADDER_HTTP)).otherwise(place(LADDER))


def _label(url: Column, rung: Column) -> Column:
    pick = [F.array(*[F.lit(x) for x in order]) for order in (LADDER_HTTP, LADDER)]
    return F.get(F.when(url.startswith("http://"), pick[0]).otherwise(pick[1]), rung - 1)


def resolve_attempts(attempts: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """One status row per URL from its logged attempts.

    ``attempts`` has url, label, status, error and an ordering column ``seq``;
    optional columns response_ms, server and content_type ride along. The first rung
    of the ladder that got any HTTP status decides. Per URL only combinable
    aggregates are kept, so a URL with any number of logged attempts is fine.
    ``dns`` (host, resolved, ips, dns_error) turns a failed name lookup into a hint.
    """
    extras = [c for c in ("response_ms", "server", "content_type", "retry_after")
              if c in attempts.columns]
    rung = _rung(F.col("url"), F.col("label"))
    answered = F.col("status").isNotNull()
    order = F.struct("rung", "seq")
    per_url = (
        attempts.withColumn("rung", rung).where(F.col("rung").isNotNull()).groupBy("url").agg(
            F.min_by(F.struct("rung", "status", *extras), F.when(answered, order)).alias("win"),
            F.min_by(F.col("error"), F.when(~answered, order)).alias("first_error"),
            F.array_sort(F.collect_set("rung")).alias("tried")))
    tried = F.filter("tried", lambda r: F.col("win").isNull() | (r <= F.col("win.rung")))
    trail = F.array_join(F.transform(tried, lambda r: F.concat(
        _label(F.col("url"), r),
        F.when(F.col("win").isNotNull() & (r == F.col("win.rung")), "").otherwise(":fail"))), " -> ")
    used = F.when(F.col("win").isNotNull(), _label(F.col("url"), F.col("win.rung"))).otherwise("")
    out = per_url.withColumn("attempts", trail).withColumn("scheme_used", used)
    rest = F.regexp_replace(F.col("url"), "^https?", "")
    out = out.withColumns({
        "host": U.host_of(F.col("url")),
        "status_code": F.col("win.status"),
        "checked_url": F.when(used == "", F.col("url")).otherwise(
            F.concat(F.substring_index(used, "-", 1), rest)),
        "tls_invalid": used == "https-noverify",
        "https_unavailable": (used == "http") & F.col("url").startswith("https://"),
        "_error": F.when(F.col("win").isNull(), F.coalesce("first_error", F.lit("connection failed")))
        .otherwise(""),
        **{c: F.col(f"win.{c}") for c in extras},
    }).withColumn("https", F.col("checked_url").startswith("https://"))
    if dns is None:
        out = out.withColumn("dns_said_no", F.lit(False)).withColumn("ip", F.lit(""))
    else:
        hints = dns.select(
            "host", (~F.col("resolved")).alias("_no"), F.array_join("ips", ", ").alias("ips"),
            F.coalesce(F.get("ips", F.lit(0)), F.lit("")).alias("ip"))
        out = lookup(out, hints, "host").withColumn(
            "dns_said_no", F.coalesce("_no", F.lit(False))).drop("_no")
    failed, said_no = F.col("status_code").isNull(), F.col("dns_said_no")
    return out.withColumns({
        "status_verdict": F.when(failed & said_no, "DNS_ERROR")
        .when(failed, S.error_verdict(F.col("_error"))).otherwise(S.status_verdict(F.col("status_code"))),
        "error": F.when(failed & said_no, "domain does not resolve (DNS and HTTP agree)")
        .otherwise(F.col("_error")),
        "dns_note": F.when(~failed & said_no, "the site answered although its name did not resolve")
        .otherwise(""),
    }).drop("win", "first_error", "tried", "_error")


def resolve_redirects(hops: DataFrame, max_hops: int = 10) -> DataFrame:
    """Follow every URL's redirects to where it lands.

    ``hops`` has from_url, to_url and status: one row per URL, with to_url null where
    the URL answers itself. Paths double in length each round, so ten hops take four
    joins rather than ten; each round is written to the checkpoint folder, so the plan
    does not grow. A path longer than ``max_hops`` (or a loop) is an error.
    """
    step = cut_lineage(first_per_key(
        hops.select("from_url", "to_url", "status"), ["from_url"],
        [F.col("to_url"), F.col("status")]))
    paths = step.select(
        F.col("from_url").alias("url"), F.col("status").alias("status_code"),
        F.when(F.col("to_url").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("to_url")).alias("path"))
    reach = 1
    while reach <= max_hops:
        ends = paths.select(F.col("url").alias("_end"), F.col("path").alias("_more"))
        grown = paths.withColumn("_end", F.get("path", F.size("path") - 1))
        paths = cut_lineage(lookup(grown, ends, "_end", key_source=grown.select("_end")).withColumn(
            "path", F.concat("path", F.coalesce("_more", F.array().cast("array<string>")))
        ).drop("_end", "_more"))
        reach *= 2
    landed = paths.withColumn("redirect_hops", F.size("path")).withColumn(
        "_final", F.when(F.size("path") > 0, F.get("path", F.size("path") - 1)).otherwise(F.col("url")))
    statuses = step.select(F.col("from_url").alias("_final"), F.col("status").alias("_final_status"))
    landed = lookup(landed, statuses, "_final", key_source=landed.select("_final"))
    endless = F.col("redirect_hops") > max_hops
    moved = F.col("redirect_hops") > 0
    offsite = moved & ~endless & (
        U.registered_domain(F.col("url")) != U.registered_domain(F.col("_final")))
    return landed.select(
        "url", "status_code",
        F.when(endless, F.get("path", F.lit(0))).otherwise(F.col("_final")).alias("final_url"),
        F.when(~endless, F.col("_final_status")).alias("final_status"),
        F.when(endless, 0).otherwise(F.col("redirect_hops")).alias("redirect_hops"),
        F.when(moved & ~endless, F.concat_ws(" -> ", F.col("url"), F.array_join("path", " -> ")))
        .otherwise("").alias("redirect_chain"),
        offsite.alias("redirect_offsite"),
        F.when(offsite, U.registered_domain(F.col("_final"))).otherwise("").alias("redirect_target_domain"),
        F.when(endless, "too many redirects (redirect loop)").otherwise("").alias("redirect_error"))


FAILED = ["DEAD", "GONE", "ERROR", "SERVER_ERROR"]


def with_root_probe(rows: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """For failed URLs, say whether the root of the same domain still answers.

    ``rows`` has url, registered and status_verdict; ``status`` (default: the same
    rows) holds the observation of ``https://<registered>``.
    """
    source = rows if status is None else status
    bare = F.regexp_replace(F.col("url"), "/$", "")
    roots = first_per_key(
        source.where(bare.rlike("^https://[^/?#]+$")).select(
            bare.alias("_root"), F.col("status_verdict").alias("root_verdict"),
            F.col("status_code").alias("root_status")),
        ["_root"], [F.col("root_verdict")])
    asked = rows.withColumn("_root", F.when(
        F.col("status_verdict").isin(FAILED) & (F.col("registered") != ""),
        F.concat(F.lit("https://"), F.col("registered"))))
    out = lookup(asked, roots, "_root")
    alive = F.col("root_verdict").isin("LIVE", "REDIRECT_PERM", "REDIRECT_TEMP", "BLOCKED")
    note = (
        F.when(F.col("root_verdict").isNull(), "")
        .when(alive, F.concat(
            F.lit("the root of "), F.col("registered"), F.lit(" still answers ("),
            F.col("root_status").cast("string"), F.lit("); only this page or host failed")))
        .otherwise(F.concat(
            F.lit("the root of "), F.col("registered"), F.lit(" is down too ("),
            F.col("root_verdict"), F.lit(")"))))
    return (
        out.withColumn("root_domain", F.when(F.col("_root").isNotNull(), F.col("registered")).otherwise(""))
        .withColumn("root_note", note).drop("_root"))


def dns_stats(dns: DataFrame) -> DataFrame:
    return dns.agg(
        F.count("*").alias("hosts"), F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("unresolved"))
