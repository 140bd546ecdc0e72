"""Domain parts and trust tiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions import urls as U
from anchorlake.rules import DEFAULT_AUTHORITY, authority_rows

# Beyond so many sites the list is joined by a shuffle instead of a broadcast.
BROADCAST_SITES = 200_000

NONPROFIT = ["org", "ngo", "ong", "foundation", "charity", "asso.fr", "asn.au"]
NONPROFIT_SECOND_LEVEL = ["org", "or"]


def any_of(parts: list[str]) -> str:
    """Regex that finds any of the given pieces of text."""
    return "|".join(map(re.escape, parts))


def with_domain_parts(
    df: DataFrame, url_col: str = "url", suffixes: U.Suffixes = U.DEFAULT_SUFFIXES
) -> DataFrame:
    """Add host, registered domain, suffix, subdomain and the free-subdomain flag."""
    host = F.col("host")
    return df.withColumn("host", U.host_of(F.col(url_col))).withColumns({
        "registered": U.registered_of_host(host, suffixes),
        "suffix": U.suffix_of_host(host, suffixes),
        "subdomain": U.subdomain_of_host(host, suffixes),
        "is_subdomain": U.is_real_subdomain(U.subdomain_of_host(host, suffixes)),
        "free_subdomain": U.is_free_subdomain(host),
    })


def authority_dim(spark: SparkSession, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Site -> group; a listed host also covers its registered domain."""
    rows = authority_rows(DEFAULT_AUTHORITY if groups is None else groups)
    listed = spark.createDataFrame(
        [(i, site, group) for i, (site, group) in enumerate(rows)],
        "rank int, site string, authority_group string")
    both = listed.unionByName(
        listed.withColumn("site", U.registered_domain(F.col("site"))))
    return both.groupBy("site").agg(F.min_by("authority_group", "rank").alias("authority_group"))


def with_trust_tier(df: DataFrame, authority: DataFrame) -> DataFrame:
    """Tier A (restricted suffix), B (authority list), C (non-profit suffix) or D.

    ``authority`` is the output of ``authority_dim``; it is counted, and broadcast if it
    has at most ``BROADCAST_SITES`` rows.
    """
    small = authority.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    side = F.broadcast if small else lambda df: df
    by_host = authority.select(
        F.col("site").alias("host"), F.col("authority_group").alias("_by_host"))
    by_domain = authority.select(
        F.col("site").alias("registered"), F.col("authority_group").alias("_by_domain"))
    suffix = F.col("suffix")
    second = F.substring_index(suffix, ".", 1)
    # only listed national suffixes have two labels here
    national = suffix.rlike(r"^[^.]+\.[^.]{2}$")
    restricted = suffix.isin(fixed.INSTITUTION_SUFFIXES) | (national & second.isin(fixed.INSTITUTION_LABELS))
    nonprofit = suffix.isin(NONPROFIT) | (national & second.isin(NONPROFIT_SECOND_LEVEL))
    kind = (
        F.when(suffix.rlike(any_of(fixed.GOVERNMENT_PARTS)), "government")
        .when(suffix.rlike(any_of(fixed.EDUCATION_PARTS)), "education")
        .otherwise("institutional"))
    group = F.coalesce("_by_host", "_by_domain")
    out = (
        df.join(side(by_host), "host", "left")
        .join(side(by_domain), "registered", "left")
        .withColumn("spam_tld", suffix.isin(fixed.SPAM_TLDS))
        .withColumn("tier", F.when(restricted, "A").when(group.isNotNull(), "B")
                    .when(nonprofit, "C").otherwise("D"))
        .withColumn("authority_group", F.when(F.col("tier") == "B", group).otherwise(""))
    )
    dotted = F.concat(F.lit("."), suffix)
    label = (
        F.when(F.col("tier") == "A", F.concat(F.lit("Institutional ("), kind, F.lit(")")))
        .when(F.col("tier") == "B", "High authority (curated)")
        .when(F.col("tier") == "C", "Non-profit TLD (weak signal)").otherwise("Unproven"))
    reason = (
        F.when(F.col("tier") == "A", F.concat(
            dotted, F.lit(" can only be registered by "), kind, F.lit(" bodies")))
        .when(F.col("tier") == "B", F.concat(
            F.col("registered"), F.lit(" is listed under "), group))
        .when(F.col("tier") == "C", F.concat(
            dotted, F.lit(" sounds non-profit but anyone can register it")))
        .when(F.col("spam_tld"), F.concat(
            dotted, F.lit(" is common in link networks; wait for authority metrics")))
        .otherwise(F.concat(F.lit("nothing known about "), dotted, F.lit(" sites as such"))))
    owner = F.when((F.col("tier") == "D") & F.col("free_subdomain"),
                   "; the host is a free subdomain its owner did not register").otherwise("")
    return (
        out.withColumn("tier_label", label).withColumn("reason", F.concat(reason, owner))
        .drop("_by_host", "_by_domain").select(*df.columns, "spam_tld", "tier", "tier_label",
                                               "authority_group", "reason"))
