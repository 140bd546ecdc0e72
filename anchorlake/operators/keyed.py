"""Keyed building blocks that hold up when one key owns a third of the rows.

* ``first_per_key`` / ``last_per_key`` reduce with a combinable aggregate, never a window.
* ``lookup`` joins many rows to one row per key and routes hot keys around the shuffle.
* ``Ordered`` numbers rows, looks back and folds over a total order in range partitions,
  so neither a global rank nor one long per-key history ends up in a single task.
"""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake.session import cut_lineage

# A key counts as hot if it holds more than 1 / HOT_KEYS of all rows of the probing side, so
# there are at most HOT_KEYS of them however large the tables are.
HOT_KEYS = 1_000


def _whole_row(df: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def _per_key(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(pick(_whole_row(df, keys), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` for each key."""
    return _per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest ``order`` for each key."""
    return _per_key(df, keys, order, F.max_by)


def lookup(
    left: DataFrame, right: DataFrame, key: str, key_source: DataFrame | None = None,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join to ``right``, which holds one row per ``key``.

    Null keys are spread instead of meeting in one task. Hot keys are split at run
    time by adaptive execution, which costs no extra pass. Where the keys can be
    counted cheaply (a scan or a checkpointed frame, given as ``key_source``), they
    are also routed explicitly: rows of a key that holds more than 1 / ``hot_keys`` of
    all rows get their right row from a broadcast of just those keys, at most ``hot_keys``
    rows, and take an evenly spread key through the shuffle. Nothing is dropped or
    sampled either way.
    """
    values = [c for c in right.columns if c != key]
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*left.columns).cast("string"))
    own = F.col(key).cast("string")
    cold = right.select(own.alias("_key"), F.struct(*values).alias("_cold"))
    if key_source is None:
        joined = left.withColumn("_key", F.coalesce(own, spread)).join(cold, "_key", "left")
        return joined.select(*left.columns, *[F.col("_cold")[c].alias(c) for c in values])
    counts = key_source.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).where(
        (F.col("_n") * hot_keys > F.col("_all")) & F.col(key).isNotNull()).select(key)
    hot_right = right.join(F.broadcast(hot), key, "left_semi").select(
        key, F.struct(*values).alias("_hot"))
    marked = left.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), key, "left").join(
        F.broadcast(hot_right), key, "left")
    joined = marked.withColumn("_key", F.when(F.col("_is_hot"), spread).otherwise(
        F.coalesce(own, spread))).join(cold, "_key", "left")
    found = joined.withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*left.columns, *[F.col("_found")[c].alias(c) for c in values])


class Ordered:
    """A DataFrame cut into contiguous ranges of a total order.

    ``order`` must be a total order (end it with a unique column), so that equal
    values never force a range to grow. The ranges are written to the checkpoint
    folder once; every later step sees exactly the same cut, also after lost
    executors. Finding the cuts reads the input once more, so an input that is
    ``costly`` to compute is written first as well.
    """

    def __init__(
        self, df: DataFrame, order: list[Column], parts: int | None = None, costly: bool = False
    ):
        spark = df.sparkSession
        df = cut_lineage(df) if costly else df
        self.order = order
        self.columns = df.columns
        parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             spark.sparkContext.defaultParallelism)
        ranged = df.repartitionByRange(parts, *order)
        self.rows = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))

    def numbered(self, name: str) -> DataFrame:
        """Add a gap-free 1-based position in the total order."""
        sizes = self.rows.groupBy("_range").agg(F.count("*").alias("_size"))
        # one row per range: a window over it is a window over at most ``parts`` rows
        before = sizes.select(
            "_range",
            F.coalesce(
                F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0)).alias("_before"))
        inside = F.row_number().over(W.partitionBy("_range").orderBy(*self.order))
        return (
            self.rows.join(F.broadcast(before), "_range")
            .withColumn(name, (F.col("_before") + inside).cast("long"))
            .select(*self.columns, name))

    def with_previous(self, key: str, value: str, name: str) -> DataFrame:
        """Add ``value`` of the row before this one within ``key``.

        The order must start with ``key``. Only a range's first row can need a row
        of another range, so one row per range is enough to bridge the cuts.
        """
        here = W.partitionBy("_range").orderBy(*self.order)
        rows = self.rows.withColumn("_at", F.row_number().over(here)).withColumn(
            "_prev", F.lag(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).over(here))
        last = self.rows.groupBy("_range").agg(
            F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")),
                     F.struct(*self.order)).alias("_row"))
        bridge = last.select(
            F.col("_range"), F.lag("_row").over(W.orderBy("_range")).alias("_bridge"))
        source = F.when(F.col("_at") == 1, F.col("_bridge")).otherwise(F.col("_prev"))
        return (
            rows.join(F.broadcast(bridge), "_range", "left").withColumn("_src", source)
            .withColumn(name, F.when(F.col("_src")["k"] == F.col(key), F.col("_src")["v"]))
            .select(*self.columns, name))

    def map_ranges(self, step: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
        """Run ``step`` over each range's rows, in order, batch by batch."""
        return self.rows.sortWithinPartitions("_range", *self.order).mapInPandas(step, schema)


