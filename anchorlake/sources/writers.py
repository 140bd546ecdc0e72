"""Writers: flat report, partitions, disavow file, run files, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.config import AuditConfig
from anchorlake.operators.anchors import anchor_distribution, anchor_warnings
from anchorlake.operators.columns import Row
from anchorlake.operators.report import disavow_comments, disavow_entries
from anchorlake.session import cut_lineage


def report_view(rows: DataFrame) -> DataFrame:
    """The flat report: labelled columns, booleans as YES/NO, nulls as empty text."""
    types = dict(rows.dtypes)

    def shown(name: str) -> Column:
        if name not in types:
            return F.lit("")
        if types[name] == "boolean":
            return F.when(F.col(name).isNull(), "").when(F.col(name), "YES").otherwise("NO")
        value = F.array_join(name, " | ") if types[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(value, F.lit(""))

    return rows.select(*[shown(key).alias(label) for key, label in fixed.REPORT_COLUMNS])


def write_report(rows: DataFrame, path: str) -> None:
    report_view(rows).write.mode("overwrite").option("header", True).csv(path)


def report_partitions(rows: DataFrame) -> DataFrame:
    """Every named subset of a report as (sheet, url) rows, in one pass."""
    from anchorlake.functions.status import status_group

    r = Row(rows)
    sheets = F.array_compact(F.array(
        F.concat(F.lit("verdict "), r.text("verdict")),
        F.concat(F.lit("status "), status_group(r.text("status_verdict"))),
        F.when(r.text("tier").isin("A", "B"), "authority"),
        F.when(r.flag("link_is_sitewide"), "sitewide")))
    return rows.select(F.explode(sheets).alias("sheet"), "url")


def write_partitions(rows: DataFrame, path: str, by: str = "verdict") -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def write_disavow(rows: DataFrame, path: str) -> None:
    """A disavow file in sorted parts: comments on link networks, then entries."""
    networks = disavow_comments(rows).select(
        F.concat(F.lit("#   "), "network_id", F.lit(": "), "network_signals").alias("value"),
        F.lit(0).alias("_part"))
    entries = disavow_entries(rows).select(F.col("entry").alias("value"), F.lit(1).alias("_part"))
    networks.unionByName(entries).orderBy("_part", "value").select("value").write.mode(
        "overwrite").text(path)


def write_merged_disavow(diff: DataFrame, path: str) -> None:
    """Existing plus new entries, sorted."""
    diff.select(F.col("entry").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_batches(queue: DataFrame, path: str) -> None:
    """The metric queue, one folder per batch."""
    queue.select("batch", F.col("registered").alias("value")).write.mode(
        "overwrite").partitionBy("batch").text(path)


def write_changes(changes: DataFrame, path: str) -> None:
    """Run differences as a flat file, most important kinds first."""
    rank = F.lit(len(fixed.CHANGE_KINDS))
    for i, (name, _) in enumerate(fixed.CHANGE_KINDS):
        rank = F.when(F.col("change") == name, i).otherwise(rank)
    changes.orderBy(rank, "url").write.mode("overwrite").option("header", True).csv(path)


def anchor_report(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """The anchor report as (section, name, kind, n, share): every anchor, the kinds' totals, the warnings."""
    each = cut_lineage(anchor_distribution(rows, cfg))
    total = each.agg(F.sum("n")).scalar()
    share = lambda n: F.bround(100.0 * n / total, 1).alias("share")
    anchors = each.select(F.lit("anchors").alias("section"), F.col("anchor").alias("name"), "kind", "n", share(F.col("n")))
    kinds = each.groupBy("kind").agg(F.sum("n").alias("n")).select(
        F.lit("kinds"), "kind", "kind", "n", share(F.col("n")))
    warnings = anchor_warnings(rows, cfg).select(F.lit("warnings"), "warning", "anchor", "n", "share")
    return anchors.union(kinds).union(warnings)


def write_anchor_report(rows: DataFrame, cfg: AuditConfig, path: str) -> None:
    """The anchor report as CSV, a folder for each section, most frequent first within a file."""
    anchor_report(rows, cfg).repartitionByRange("section", F.desc("n"), "name").sortWithinPartitions(
        "section", F.desc("n"), "name").write.mode("overwrite").partitionBy("section").option("header", True).option(
        "escape", '"').csv(path)


def write_network_report(members: DataFrame, groups: DataFrame, path: str) -> None:
    """One line per signal and domain, with the size of the signal's group."""
    sizes = groups.select("label", F.col("size").alias("Domains"))
    members.join(sizes, "label").select(
        F.col("label").alias("Signal"), "Domains", F.col("registered").alias("Domain")).write.mode(
        "overwrite").option("header", True).option("escape", '"').csv(path)


HISTORY_COLUMNS = ["url", "host", "registered", "verdict", "score", "da", "spam_score", "status_code",
                   "tier", "link_found", "is_followed", "action", "issues"]


def history_rows(rows: DataFrame, run_id: str | Column) -> DataFrame:
    """Rows as kept in the history: one per (run, URL), the last one of a URL."""
    r = Row(rows)
    named = {
        "host": r.text("host"), "registered": r.text("registered"), "verdict": r.text("verdict"),
        "score": r.number("score"), "da": r.number("da"), "spam_score": r.number("spam_score"),
        "status_code": r.text("status_code"), "tier": r.text("tier"),
        "link_found": r.flag("link_found"), "is_followed": r.flag("is_followed"),
        "action": r.text("action_group"), "issues": r.text("issues")}
    from anchorlake.operators.keyed import last_per_key

    order = F.col("seq") if "seq" in rows.columns else F.lit(0)
    kept = rows.select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), "url",
        *[v.alias(k) for k, v in named.items()], order.alias("_seq"))
    return last_per_key(kept, ["run_id", "url"], [F.col("_seq"), F.col("verdict")]).drop("_seq")


def append_run(rows: DataFrame, run_id: str, path: str) -> None:
    """Write a run into the history; writing it again replaces only that run."""
    history_rows(rows, run_id).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_run(rows: DataFrame, run_id: str, path: str) -> None:
    """Full rows of a run as JSON lines, one folder per run."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)
