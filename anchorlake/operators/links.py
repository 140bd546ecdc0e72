"""Link inventory, target matching and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.config import AuditConfig
from anchorlake.functions import urls as U

def explode_links(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per link of each parsed page, with the link's registered domain."""
    rows = parsed.select(*keep, F.explode("links").alias("link")).select(*keep, "link.*")
    return rows.withColumn("link_domain", U.registered_domain(F.col("absolute"))).where(
        F.col("link_domain") != "")


def link_counts(links: DataFrame, keys: list[str], page_domain: str) -> DataFrame:
    """Internal, external and total links per page, from exploded links."""
    internal = F.col("link_domain") == F.col(page_domain)
    return links.groupBy(*keys).agg(
        F.count_if(internal).alias("internal_links"),
        F.count_if(~internal).alias("outbound_links"),
        F.count("*").alias("total_links"))


def target_domains(target: Column, cfg: AuditConfig) -> Column:
    """Registered domains that count as the audited site."""
    sites = [target] + [F.lit(a) for a in cfg.target_aliases if a]
    return F.filter(F.array(*[U.registered_domain(s) for s in sites]), lambda d: d != "")


def with_link_features(parsed: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Per-page link columns.

    A page's links travel in one array of the page's own row, so this needs no
    explode, no shuffle and no join back, however many links a page holds.
    """
    target = F.coalesce(F.nullif(F.col("input_target"), F.lit("")), F.lit(cfg.target_site)) \
        if "input_target" in parsed.columns else F.lit(cfg.target_site)
    page_domain = U.registered_domain(F.col("url"))
    self_url = U.without_fragment(F.col("url"))

    def enriched(link: Column) -> Column:
        return F.struct(
            link["pos"].alias("pos"), link["absolute"].alias("absolute"),
            F.when(link["text"] == "", fixed.EMPTY_ANCHOR).otherwise(link["text"]).alias("text"),
            link["rel"].alias("rel"), link["placement"].alias("placement"), link["hidden"].alias("hidden"),
            U.registered_domain(link["absolute"]).alias("domain"))

    base = parsed.withColumns({
        "_page": page_domain, "_self": self_url, "_targets": target_domains(target, cfg),
        "_links": F.filter(F.transform("links", enriched), lambda a: a["domain"] != ""),
    }).withColumns({
        "_internal": F.filter("_links", lambda a: a["domain"] == F.col("_page")),
        "_matches": F.filter("_links", lambda a: F.array_contains(F.col("_targets"), a["domain"])),
    }).withColumns({
        "_places": F.col("_matches.placement"),
        "_rels": F.array_sort(F.array_distinct(F.flatten(F.col("_matches.rel")))),
    })
    other_urls = F.filter(
        F.transform("_internal", lambda a: U.without_fragment(a["absolute"])),
        lambda u: u != F.col("_self"))
    external = F.size("_links") - F.size("_internal")
    flags = {f"is_{flag}": F.array_contains("_rels", flag) for flag in ("nofollow", "sponsored", "ugc")}
    out = base.withColumns({
        "internal_links": F.size("_internal"), "outbound_links": external, "total_links": F.size("_links"),
        "outbound_ratio": F.bround(external / F.greatest(F.lit(1), F.size("_links")), 3),
        # as many as a sample asks for, see ``sitewide_sample``
        "internal_urls": F.slice(F.array_distinct(other_urls), 1, max(1, 3 * cfg.sitewide_sample)),
        "link_count": F.size("_matches"), "link_found": F.size("_matches") > 0,
        "target_checked": target != "", "target_domains": F.col("_targets"),
        "linked_domains": F.array_distinct(F.col("_links.domain")),
        "anchor_list": F.col("_matches.text"),
        "anchor_texts": F.array_join(F.array_distinct(F.col("_matches.text")), " | "),
        "link_target_urls": F.array_join(F.array_distinct(F.col("_matches.absolute")), " | "),
        "link_rel": F.array_join("_rels", ", "), **flags,
        "link_placement": F.when(F.array_contains("_places", "in-content"), "in-content")
        .otherwise(F.coalesce(F.get("_places", F.lit(0)), F.lit(""))),
        "link_in_hidden_block": F.exists("_matches", lambda a: a["hidden"]),
    })
    tagged = F.col("is_nofollow") | F.col("is_sponsored") | F.col("is_ugc")
    return out.withColumns({
        "is_followed": F.col("link_found") & ~tagged,
        "link_is_sitewide": F.col("link_placement") == "boilerplate",
    }).drop("_page", "_self", "_targets", "_links", "_internal", "_matches", "_places", "_rels")


def sitewide_sample(rows: DataFrame, seen: DataFrame, n: int = 3) -> DataFrame:
    """How many of a page's first internal URLs carry the target link too.

    ``rows`` has ``url``, ``link_found`` and ``internal_urls``, one row per page; pages
    that share a URL are sampled each by its own links.
    ``seen`` has one row per readable page with ``url`` and either ``link_found`` or,
    for rows with targets of their own, the ``linked_domains`` to compare with the
    rows' ``target_domains``. Candidates are the first 3n internal URLs, of which the
    first n readable ones are sampled.
    """
    from anchorlake.operators.keyed import lookup

    own_targets = "linked_domains" in seen.columns
    carried = ["target_domains"] if own_targets else []
    keys = [k for k in ("url", "input_target") if k in rows.columns]
    # pages equal in all of this have equal samples
    rows = rows.withColumn("_page", F.sha2(F.to_json(F.struct(
        *keys, *carried, F.slice("internal_urls", 1, 3 * n).alias("candidates"))), 256))
    candidates = rows.where(F.col("link_found")).select(
        "_page", *carried, F.posexplode(F.slice("internal_urls", 1, 3 * n)).alias("pos", "candidate"))
    readable = seen.select(
        F.col("url").alias("candidate"),
        F.col("linked_domains" if own_targets else "link_found").alias("seen"))
    hit = F.arrays_overlap("seen", "target_domains") if own_targets else F.col("seen")
    looked_up = lookup(candidates, readable, "candidate").where(
        F.col("seen").isNotNull()).withColumn("hit", hit)
    # at most 3n candidates per page, so this list stays small for every page
    sampled = looked_up.groupBy("_page").agg(F.slice(F.array_sort(F.collect_set(
        F.struct("pos", "hit"))), 1, n).alias("sample")).select(
            "_page", F.size("sample").alias("sitewide_sampled"),
            F.size(F.filter("sample", lambda s: s["hit"])).alias("sitewide_hits"))
    out = rows.join(sampled, "_page", "left").drop("_page")
    hits = F.coalesce("sitewide_hits", F.lit(0))
    checked = F.coalesce("sitewide_sampled", F.lit(0))
    note = (
        F.when(~F.col("link_found"), "")
        .when(F.size("internal_urls") == 0, "the page has no internal links to follow")
        .when(checked == 0, "none of the candidate pages could be read")
        .when((hits == checked) & (checked >= 2), F.concat(
            F.lit("on all "), checked.cast("string"), F.lit(" sampled pages: sitewide")))
        .when(hits > 0, F.concat(
            F.lit("on "), hits.cast("string"), F.lit(" of "), checked.cast("string"),
            F.lit(" sampled pages: part of some templates")))
        .otherwise(F.concat(
            F.lit("on none of "), checked.cast("string"), F.lit(" sampled pages: a single placement"))))
    return (
        out.withColumn("sitewide_note", note)
        .withColumn("sitewide_checked", checked > 0)
        .withColumn("sitewide_ratio", F.when(
            checked > 0, F.bround(hits / checked, 2)).otherwise(F.lit(0.0)))
        .withColumn("sitewide_sampled", checked).withColumn("sitewide_hits", hits))
