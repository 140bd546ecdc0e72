"""Link-network footprints: domains that look independent but share several signals.

A cluster is the union of all signal groups of some domain. Listing the members of
every cluster would repeat a large group once per cluster, so clusters stay
factored: a cluster is its set of groups, a group is its set of domains. Sizes and
member-set fingerprints are additive measures, and a domain has at most five
signals, so inclusion-exclusion over the (at most 31) subsets of a cluster's groups
gives both exactly without ever expanding a member list.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.operators.columns import Row
from anchorlake.operators.keyed import Ordered, first_per_key, lookup
from anchorlake.session import cut_lineage

KINDS = {"ip": "same IP ", "host": "same host ", "subnet": "same /24 ",
         "cms": "same CMS ", "title": "templated title "}


def footprint_signals(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per (domain, signal), from each domain's first row in ``order``.

    The result is small next to the rows and read several times, so it is written to
    the checkpoint folder.
    """
    r = Row(rows)
    shared = r.flag("shared_host")
    org = F.lower(F.trim(F.coalesce(
        F.nullif(r.text("net_org"), F.lit("")), r.text("net_name"))))
    facts = rows.where(F.coalesce(F.col("registered"), F.lit("")) != "").select(
        "registered", F.trim(r.text("ip")).alias("ip"), shared.alias("shared"),
        X.generator_shape(r.text("generator")).alias("cms"),
        X.title_shape(r.text("page_title")).alias("title"),
        F.when(shared, "").otherwise(org).alias("host"),
        *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    first = first_per_key(facts, ["registered"], [F.col(f"_o{i}") for i in range(len(order))])
    first = first.withColumn("subnet", U.subnet24(F.col("ip")))
    signals = F.filter(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in KINDS
    ]), lambda s: s["value"] != "")
    label = F.concat(
        F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("s.kind")], F.col("s.value"))
    return cut_lineage(
        first.select("registered", "ip", "shared", F.explode(signals).alias("s")).select(
            "registered", "ip", "shared", "s.kind", "s.value", label.alias("label")))


def signal_groups(signals: DataFrame, min_size: int = 3) -> DataFrame:
    """Groups of at least ``min_size`` domains, with whether each counts as a footprint.

    Addresses of shared hosts do not count, nor does a /24 whose domains all sit on
    one address that already counts or which is shared hosting throughout.
    """
    groups = signals.groupBy("kind", "value", "label").agg(
        F.count("*").alias("size"), F.bool_or("shared").alias("any_shared"),
        F.bool_and("shared").alias("all_shared"),
        (F.min("ip") == F.max("ip")).alias("one_ip"), F.min("registered").alias("first_member"))
    explained = F.col("one_ip") & ~F.col("any_shared")
    counts = (
        F.when(F.col("kind") == "ip", ~F.col("any_shared"))
        .when(F.col("kind") == "subnet", ~F.col("all_shared") & ~explained)
        .otherwise(F.lit(True)))
    return groups.where(F.col("size") >= min_size).withColumn("counts", counts)


def group_members(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Domains of every reported group, one row each."""
    known = groups.select("label", F.col("size"), F.col("counts"))
    return lookup(signals.select("label", "registered"), known, "label",
                  key_source=signals.select("label")).where(F.col("size").isNotNull())


def domain_groups(signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Each domain's sorted list of counting groups (at most five)."""
    counting = groups.where("counts").select("label", F.lit(True).alias("_counts"))
    kept = lookup(signals.select("registered", "label"), counting, "label",
                  key_source=signals.select("label")).where("_counts")
    return cut_lineage(
        kept.groupBy("registered").agg(F.array_sort(F.collect_list("label")).alias("labels")))


def _subsets(labels: Column, signed: bool) -> Column:
    """All non-empty subsets of up to five labels, each as a key with its size."""
    parts = []
    for width in range(1, len(KINDS) + 1):
        for picks in combinations(range(len(KINDS)), width):
            members = F.array(*[F.get(labels, F.lit(i)) for i in picks])
            sign = 1 if width % 2 else -1
            parts.append(F.when(
                F.size(labels) > picks[-1],
                F.struct(F.array_join(members, "\u0001").alias("subset"),
                         F.lit(sign).alias("sign"), F.lit(width == 1).alias("single"))))
    return F.explode(F.array_compact(F.array(*parts)))


def link_clusters(domains: DataFrame) -> DataFrame:
    """Clusters with id, size and signals, from ``domain_groups`` output.

    Largest first; equal sizes by first member, then by signals. Two label sets with
    the same members are one cluster, named after the smaller label list.
    """
    def fingerprint(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "registered").cast("decimal(20,0)"))

    sets = domains.groupBy("labels").agg(
        F.count("*").cast("decimal(20,0)").alias("n"), fingerprint(1).alias("h1"),
        fingerprint(2).alias("h2"), F.min("registered").alias("first"))
    measures = sets.select(_subsets(F.col("labels"), False).alias("s"), "n", "h1", "h2", "first") \
        .groupBy(F.col("s.subset").alias("subset")).agg(
            *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", "h1", "h2")],
            F.min("first").alias("first"))
    seeds = sets.where(F.size("labels") >= 2).select(
        "labels", _subsets(F.col("labels"), True).alias("s")).select(
            "labels", "s.subset", "s.sign", "s.single")
    unions = lookup(seeds, measures, "subset").groupBy("labels").agg(
        *[F.sum(F.when(F.col("sign") > 0, F.col(c)).otherwise(-F.col(c))).alias(c)
          for c in ("n", "h1", "h2")],
        F.min(F.when(F.col("single"), F.col("first"))).alias("first_member"))
    distinct = unions.withColumn("signals", F.array_join("labels", "; ")).groupBy("n", "h1", "h2").agg(
        F.min_by(F.struct("labels", "signals", "first_member"), "signals").alias("c"))
    clusters = distinct.select(
        F.col("n").cast("long").alias("size"), "c.labels", "c.signals", "c.first_member")
    numbered = Ordered(
        clusters, [F.desc("size"), F.col("first_member"), F.col("signals")],
        costly=True).numbered("rank")
    return numbered.withColumn("cluster_id", F.concat(F.lit("NET-"), F.col("rank").cast("string")))


def cluster_of_domain(domains: DataFrame, clusters: DataFrame) -> DataFrame:
    """The smallest (last-ranked) cluster each domain belongs to."""
    by_label = clusters.select("rank", F.explode("labels").alias("label")).groupBy("label").agg(
        F.max("rank").alias("rank"))
    owned = domains.select("registered", F.explode("labels").alias("label"))
    mine = lookup(owned, by_label, "label", key_source=owned.select("label")).groupBy("registered").agg(
        F.max("rank").alias("rank")).where(F.col("rank").isNotNull())
    facts = clusters.select(
        "rank", F.col("cluster_id").alias("network_id"), F.col("size").alias("network_size"),
        F.col("signals").alias("network_signals"))
    return lookup(mine, facts, "rank").drop("rank")


def with_network(rows: DataFrame, order: list[Column], min_size: int = 3) -> DataFrame:
    """Attach each row's link network, if its domain is in one."""
    signals = footprint_signals(rows, order)
    domains = domain_groups(signals, signal_groups(signals, min_size))
    found = cluster_of_domain(domains, link_clusters(domains))
    out = lookup(rows.drop("network_id", "network_size", "network_signals"), found, "registered")
    size = F.coalesce("network_size", F.lit(0).cast("long"))
    return out.withColumns({
        "network_id": F.coalesce("network_id", F.lit("")), "network_size": size,
        "network_signals": F.coalesce("network_signals", F.lit("")),
        "network_note": F.when(size > 0, F.concat(
            size.cast("string"), F.lit(" domains share "), F.col("network_signals"),
            F.lit("; judge them together"))).otherwise("")})


def cluster_members(domains: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of the given clusters, one row each; pass the clusters to be listed."""
    wanted = clusters.select("cluster_id", F.explode("labels").alias("label"))
    owned = domains.select("registered", F.explode("labels").alias("label"))
    return wanted.join(owned, "label").select("cluster_id", "registered").distinct()
