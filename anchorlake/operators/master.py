"""The master domain list: lookups, reuse windows, upserts, learning, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.operators.keyed import Ordered, first_per_key, lookup

MASTER_SCHEMA = (
    "host string, registered string, da double, spam_score double, status string, source string, "
    "notes string, first_seen timestamp, last_seen timestamp, metrics_seen timestamp")


def master_lookup(
    rows: DataFrame, master: DataFrame, key_source: DataFrame | None = None
) -> DataFrame:
    """Tag rows with what the master list says: exact host, then registered domain.

    The third step takes the shortest host recorded under the same registered domain.
    ``rows`` needs host and registered; ``key_source`` is a cheap frame with the same
    two columns, where there is one, to find hot keys in.
    """
    facts = F.struct("status", "da", "spam_score", "host", "source", "first_seen", "notes")
    listed = master.select("host", "registered", facts.alias("m"))
    by_host = listed.select(F.col("host"), F.col("m").alias("_by_host"))
    by_name = listed.select(F.col("host").alias("registered"), F.col("m").alias("_by_name"))
    by_domain = first_per_key(
        listed.select("registered", F.col("m").alias("_by_domain")), ["registered"],
        [F.length("_by_domain.host"), F.col("_by_domain.host")])
    out = lookup(rows, by_host, "host", key_source=key_source)
    out = lookup(out, by_name, "registered", key_source=key_source)
    out = lookup(out, by_domain, "registered", key_source=key_source)
    hit = F.when(F.coalesce("host", F.lit("")) == "", None).otherwise(
        F.coalesce("_by_host", "_by_name", "_by_domain"))
    return out.withColumn("_m", hit).withColumns({
        "in_master": F.col("_m").isNotNull(),
        "master_status": F.coalesce("_m.status", F.lit("")),
        "master_da": F.col("_m.da"), "master_spam_score": F.col("_m.spam_score"),
        "master_match": F.when(F.col("_m").isNull(), "")
        .when(F.col("_by_host").isNotNull(), "host").otherwise("registered"),
        "master_host": F.coalesce("_m.host", F.lit("")),
        "master_source": F.coalesce("_m.source", F.lit("")),
        "master_first_seen": F.coalesce(F.date_format("_m.first_seen", "yyyy-MM-dd"), F.lit("")),
        "master_notes": F.coalesce("_m.notes", F.lit("")),
    }).drop("_m", "_by_host", "_by_name", "_by_domain")


def _cutoff(as_of: Column, days: float) -> Column:
    return F.timestamp_seconds(F.unix_micros(as_of.cast("timestamp")) / 1e6 - days * 86400.0)


def fresh_metrics(
    domains: DataFrame, master: DataFrame, as_of: Column, max_age_days: float = 30
) -> DataFrame:
    """Metrics on the list recorded within the window; 0 days means no limit."""
    known = master.where(F.col("da").isNotNull() | F.col("spam_score").isNotNull())
    if max_age_days and max_age_days > 0:
        known = known.where(F.col("last_seen") >= _cutoff(as_of, max_age_days))
    wanted = known.join(domains.select("registered").distinct(), "registered", "left_semi")
    best = first_per_key(
        wanted.select("registered", "host", "da", "spam_score", "last_seen"), ["registered"],
        [F.length("host"), F.col("host")])
    return best.select(
        "registered", "da", "spam_score", F.lit("master-sheet").alias("source"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("recorded"))


def stale_metrics(
    domains: DataFrame, master: DataFrame, as_of: Column, max_age_days: float = 30
) -> DataFrame:
    """Listed domains whose record is older than the window; 0 days means none."""
    if not max_age_days or max_age_days <= 0:
        return master.select("registered").where(F.lit(False))
    return (
        master.where(F.col("last_seen") < _cutoff(as_of, max_age_days))
        .join(domains.select("registered").distinct(), "registered", "left_semi")
        .select("registered").distinct())


def clean_sheet(cells: DataFrame, source: str | Column, default_status: str = "") -> DataFrame:
    """Sheet rows (host, da, spam_score, status, notes, row_no as text) to master values.

    Rows without a usable host are left out and the first row of a host wins.
    """
    host = X.clean_host_cell(F.col("host"))
    status = F.trim(F.coalesce("status", F.lit("")))
    rows = cells.select(
        host.alias("host"),
        X.lenient_number(F.col("da"), error_is_null=False).alias("da"),
        X.lenient_number(F.col("spam_score"), error_is_null=False).alias("spam_score"),
        F.when(status == "", default_status).otherwise(status).alias("status"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        F.trim(F.coalesce("notes", F.lit(""))).alias("notes"), "row_no")
    kept = first_per_key(rows.where(F.col("host") != ""), ["host"], [F.col("row_no")])
    return kept.drop("row_no").withColumn("registered", U.registered_of_host(F.col("host")))


def master_upsert(master: DataFrame, sheet: DataFrame, as_of: Column) -> DataFrame:
    """Merge a cleaned sheet into the list, one row per host.

    New numbers win only where present, status and notes only where not blank;
    first_seen survives and last_seen always moves. ``change`` says what happened.
    """
    old = master.select("host", F.struct(*[c for c in master.columns if c != "host"]).alias("o"))
    new = sheet.select("host", F.struct(*[c for c in sheet.columns if c != "host"]).alias("n"))
    now = as_of.cast("timestamp")
    both = old.join(new, "host", "full_outer")
    touched = F.col("n").isNotNull()

    def text(name: str) -> Column:
        return F.when(F.coalesce(F.col(f"n.{name}"), F.lit("")) != "", F.col(f"n.{name}")).otherwise(
            F.coalesce(F.col(f"o.{name}"), F.lit("")))

    has_numbers = F.col("n.da").isNotNull() | F.col("n.spam_score").isNotNull()
    old_seen = F.col("o.metrics_seen") if "metrics_seen" in master.columns else F.col("o.last_seen")
    return both.select(
        "host", F.coalesce("n.registered", "o.registered").alias("registered"),
        F.coalesce("n.da", "o.da").alias("da"),
        F.coalesce("n.spam_score", "o.spam_score").alias("spam_score"),
        text("status").alias("status"), F.coalesce("n.source", "o.source").alias("source"),
        text("notes").alias("notes"), F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(touched, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(touched & has_numbers, now).otherwise(old_seen).alias("metrics_seen"),
        F.when(~touched, "kept").when(F.col("o").isNull(), "imported").otherwise("updated").alias("change"))


def upsert_counts(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows read, imported, updated and skipped by an import."""
    read = cells.agg(F.count("*")).scalar()
    done = merged.agg(F.count_if(F.col("change") == "imported").alias("imported"),
                      F.count_if(F.col("change") == "updated").alias("updated"))
    return done.select(read.alias("read"), "imported", "updated").withColumn(
        "skipped", F.col("read") - F.col("imported") - F.col("updated"))


def learn_toxic(
    master: DataFrame, rows: DataFrame, as_of: Column, verdicts: tuple[str, ...] = ("TOXIC",),
    order: Column | None = None,
) -> DataFrame:
    """Remember toxic hosts: new hosts are added, blank statuses filled, set ones kept."""
    facts = rows.where(F.col("verdict").isin(*verdicts) & (F.coalesce("host", F.lit("")) != "")).select(
        "host", F.col("registered"), F.col("da").cast("double").alias("da"),
        F.col("spam_score").cast("double").alias("spam_score"),
        F.coalesce("issues", F.lit("")).alias("notes"),
        (order if order is not None else F.col("url")).alias("_order"))
    toxic = first_per_key(facts, ["host"], [F.col("_order")]).drop("_order")
    old = master.select("host", F.struct(*[c for c in master.columns if c != "host"]).alias("o"))
    new = toxic.select("host", F.struct("registered", "da", "spam_score", "notes").alias("n"))
    now = as_of.cast("timestamp")
    known, hit = F.col("o").isNotNull(), F.col("n").isNotNull()
    fill = known & hit & (F.trim(F.coalesce("o.status", F.lit(""))) == "")
    return old.join(new, "host", "full_outer").select(
        "host", F.coalesce("o.registered", "n.registered").alias("registered"),
        F.when(known, F.col("o.da")).otherwise(F.col("n.da")).alias("da"),
        F.when(known, F.col("o.spam_score")).otherwise(F.col("n.spam_score")).alias("spam_score"),
        F.when(fill | ~known, "Spammy").otherwise(F.col("o.status")).alias("status"),
        F.when(known, F.col("o.source")).otherwise("audit").alias("source"),
        F.when(known, F.col("o.notes")).otherwise(F.col("n.notes")).alias("notes"),
        F.when(known, F.col("o.first_seen")).otherwise(now).alias("first_seen"),
        F.when(fill | ~known, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(~known, "added").when(fill, "filled").otherwise("kept").alias("change"))


def master_stats(master: DataFrame) -> DataFrame:
    """Totals and counts by status in one pass; the total row has a null status."""
    status = F.when(F.coalesce("status", F.lit("")) == "", "(blank)").otherwise(F.col("status"))
    return master.withColumn("status", status).groupingSets([["status"], []], "status").agg(
        F.count("*").alias("domains"), F.count("da").alias("with_da"),
        F.count("spam_score").alias("with_spam_score"))


def domain_history(links: DataFrame, runs: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Recorded verdicts in time order with the previous verdict of the same domain.

    ``runs`` has one row per run. The order is cut into ranges, so a domain with a
    third of all records is spread over many tasks.
    """
    wanted = links if domains is None else links.join(
        domains.select("registered").distinct(), "registered", "left_semi")
    dated = lookup(wanted, runs.select("run_id", "started_at"), "run_id").where(
        F.col("started_at").isNotNull())
    order = [F.col("registered"), F.col("started_at"), F.col("run_id"), F.col("url")]
    return Ordered(dated, order).with_previous("registered", "verdict", "prev_verdict").withColumn(
        "changed", F.col("prev_verdict").isNotNull() & (F.col("prev_verdict") != F.col("verdict")))


def fresh_results(cache: DataFrame, ttl_hours: float, as_of: Column) -> DataFrame:
    """Cached rows young enough to reuse; a lifetime of 0 or less reuses nothing."""
    if ttl_hours <= 0:
        return cache.where(F.lit(False))
    return cache.where(F.col("cached_at") >= _cutoff(as_of, ttl_hours / 24.0))


def fresh_cached_metrics(cache: DataFrame, ttl_days: float, as_of: Column) -> DataFrame:
    """Cached metrics still valid; a lifetime of 0 never expires, nor does an undated row."""
    if ttl_days == 0:
        return cache
    return cache.where(F.col("fetched_at").isNull() | (F.col("fetched_at") >= _cutoff(as_of, ttl_days)))


def still_to_do(items: DataFrame, fresh: DataFrame, key: str = "url") -> DataFrame:
    """Items with no fresh result."""
    return items.join(fresh.select(key).distinct(), key, "left_anti")
