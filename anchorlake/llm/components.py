"""Connected components of a link table, by spreading the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.llm.common import cut_narrow


def components(links: DataFrame) -> DataFrame:
    """node and component for every node of ``links`` (a, b); a component is named by its least node.

    Each round every node takes the least label around it and then its label's own label, so
    the rounds grow with the logarithm of a component's width. Labels are stored after each
    round. No group is gathered anywhere: every step is a join or a combinable minimum.
    """
    both = cut_narrow(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_narrow(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                         .select("node", F.least("node", "near").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        nearest = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("next"))
        above = labels.select(F.col("node").alias("next"), F.col("label").alias("top"))
        jumped = cut_narrow(nearest.join(above, "next", "left").select(
            "node", F.least("next", F.coalesce("top", "next")).alias("label"),
            (F.coalesce("top", "next") < F.col("label")).alias("moved")))
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
