"""A keyed store of results with a lifetime, as Parquet folders.

Every batch adds one folder; a compaction merges what is still fresh into one base folder and
removes what the one before it replaced. Readers see the newest complete base and the batches
after it, so what they read is bounded by the lifetime, not by the number of batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorlake.operators.keyed import last_per_key
from anchorlake.session import folders, remove


@dataclass(frozen=True)
class ResultStore:
    """Rows of (key, cached_at, ...) under ``path``, fresh for ``ttl_hours`` (0 or less: never)."""

    spark: SparkSession
    path: str
    key: str = "url"
    ttl_hours: float = 24.0
    compact_every: int = 20

    def _parts(self, before: int | None = None) -> list[str]:
        """The newest complete base and all complete batches after it, up to ``before``."""
        names = [f for f in folders(self.spark, self.path, "_SUCCESS") if f.startswith(("base-", "batch-"))]
        limit = float("inf") if before is None else before
        at = {f: int(f.split("-")[1]) for f in names if int(f.split("-")[1]) < limit}
        base = max((n for f, n in at.items() if f.startswith("base-")), default=-1)
        return sorted(f for f, n in at.items() if n > base or f == f"base-{base:012d}")

    def rows(self, before: int | None = None) -> DataFrame | None:
        """The newest row of every key, or None for an empty store; batches from ``before`` on do not count."""
        parts = self._parts(before)
        if not parts:
            return None
        found = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{p}" for p in parts])
        return last_per_key(found, [self.key], [F.col("cached_at"), F.col("batch")])

    def fresh(self, now: Column, before: int | None = None) -> DataFrame | None:
        """The newest row of every key that is younger than the lifetime."""
        rows = self.rows(before) if self.ttl_hours > 0 else None
        return rows if rows is None else rows.where(self._young(now))

    def _young(self, now: Column) -> Column:
        return F.col("cached_at") >= now.cast("timestamp") - F.make_dt_interval(secs=F.lit(self.ttl_hours * 3600))

    def without_fresh(self, items: DataFrame, now: Column, before: int | None = None) -> DataFrame:
        """``items`` that have no fresh result."""
        parts = self._parts(before) if self.ttl_hours > 0 else []
        if not parts:
            return items
        known = self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts]).where(self._young(now)).select(self.key)
        return items.join(known, self.key, "left_anti")

    def put(self, rows: DataFrame, now: Column, batch: int) -> None:
        """Add the rows of a batch; the same number again replaces them. Every so often, compact."""
        self._stamped(rows.withColumn("cached_at", now.cast("timestamp")), batch).write.mode("overwrite").parquet(
            f"{self.path}/batch-{batch:012d}")
        if self.compact_every and batch % self.compact_every == self.compact_every - 1:
            self.compact(now, batch)

    @staticmethod
    def _stamped(rows: DataFrame, batch: int) -> DataFrame:
        return rows.withColumn("batch", F.lit(batch).cast("long"))

    def compact(self, now: Column, batch: int) -> None:
        """Merge what is fresh up to and with ``batch`` into one base; what the last base replaced goes."""
        gone = [f for f in folders(self.spark, self.path, "_SUCCESS") if f not in self._parts(batch + 1)]
        fresh = self.fresh(now, batch + 1)
        if fresh is not None:
            fresh.write.mode("overwrite").parquet(f"{self.path}/base-{batch:012d}")
            remove(self.spark, *[f"{self.path}/{f}" for f in gone])
