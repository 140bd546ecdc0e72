"""Anchor-text profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.functions.text import anchor_kind


def anchor_occurrences(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """One row per anchor of every found link, lower-cased, with its kind.

    Uses ``anchor_list`` where rows have it; a joined ``anchor_texts`` otherwise.
    """
    found = rows.where(F.coalesce(F.col("link_found"), F.lit(False)))
    if "anchor_list" in rows.columns:
        pieces = F.array_distinct("anchor_list")
    else:
        pieces = F.split(F.coalesce("anchor_texts", F.lit("")), r"\|")
    return (
        found.select(F.explode(pieces).alias("piece"))
        .select(F.lower(F.trim("piece")).alias("anchor")).where(F.col("anchor") != "")
        .withColumn("kind", anchor_kind(F.col("anchor"), cfg.brands())))


def anchor_distribution(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Every distinct anchor with its kind and count."""
    return anchor_occurrences(rows, cfg).groupBy("anchor", "kind").agg(
        F.count("*").alias("n"))


def top_anchors(distribution: DataFrame, limit: int = 25) -> DataFrame:
    total = distribution.agg(F.sum("n").alias("_total"))  # one row
    return distribution.orderBy(F.desc("n"), "anchor").limit(limit).crossJoin(F.broadcast(total)).select(
        "anchor", "kind", "n", F.bround(100.0 * F.col("n") / F.col("_total"), 1).alias("share"))


def anchor_summary(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """One row: totals, kinds, the most common anchor, followed links.

    Rows are read once: every row gives one entry for itself and one for each anchor.
    """
    kinds = ["branded", "naked-url", "generic", "image-empty", "keyword"]
    found = F.coalesce(F.col("link_found"), F.lit(False))
    if "anchor_list" in rows.columns:
        pieces = F.array_distinct("anchor_list")
    else:
        pieces = F.split(F.coalesce("anchor_texts", F.lit("")), r"\|")
    anchors = F.filter(F.transform(pieces, lambda p: F.lower(F.trim(p))), lambda a: a != "")
    entry = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(found, anchors).otherwise(
        F.array().cast("array<string>")))).alias("anchor")
    followed = (found & F.coalesce("is_followed", F.lit(False))).cast("int").alias("followed")
    counted = rows.select(entry, followed).groupBy("anchor").agg(
        F.count("*").alias("n"), F.sum("followed").alias("followed")).withColumn(
        "kind", anchor_kind(F.col("anchor"), cfg.brands()))
    real = F.col("anchor").isNotNull()
    n = F.when(real, F.col("n"))
    return counted.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count("anchor").alias("distinct_anchors"),
        F.max(n).alias("top_n"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(k.replace("-", "_")) for k in kinds],
        F.coalesce(F.sum(F.when(~real, F.col("followed"))), F.lit(0)).alias("followed"),
        F.min(F.when(real, F.struct((-F.col("n")).alias("less"), "anchor")))["anchor"].alias("top_anchor"))


def anchor_warnings(rows: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Warnings about the profile as rows of (warning, share, n, total, anchor)."""
    s = anchor_summary(rows, cfg)

    def share(column: str):
        return F.lit(100.0) * F.col(column) / F.greatest(F.col("total"), F.lit(1))

    def row(when, name: str, column: str, anchor=None):
        return F.when(when & (F.col("total") > 0), F.struct(
            F.lit(name).alias("warning"), F.bround(share(column), 1).alias("share"),
            F.col(column).alias("n"), F.col("total").alias("total"),
            (F.lit("") if anchor is None else F.col(anchor)).alias("anchor")))

    checks = F.array_compact(F.array(
        row((share("top_n") > cfg.max_single_anchor_share) & (F.col("top_n") >= 3),
            "one_anchor_dominates", "top_n", "top_anchor"),
        row(share("keyword") > cfg.max_keyword_share, "too_many_keyword_anchors", "keyword"),
        row(F.col("branded") == 0, "no_branded_anchors", "branded"),
        row(share("image_empty") > cfg.max_image_share, "too_many_image_anchors", "image_empty")))
    return s.select(F.explode(checks).alias("w")).select("w.*")
