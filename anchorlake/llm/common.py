"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.session import cut_lineage

# Rows a broadcast side may have; its rows are narrow, so this is a few tens of megabytes.
BROADCAST_ROWS = 200_000


def held_out(doc_id: Column) -> Column:
    """Documents no model may learn from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def attach(left: DataFrame, right: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on keys that may be null to ``right``, which holds one narrow row per key.

    ``right`` must be a stored table: it is counted, and broadcast only if it has at most
    ``rows`` rows. Beyond that both sides are shuffled and adaptive execution splits hot keys.
    """
    names = [f"_key_{k}" for k in keys]
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    if right.limit(rows + 1).count() <= rows:
        renamed = F.broadcast(renamed)
    same = [left[k].eqNullSafe(renamed[n]) for k, n in zip(keys, names)]
    return left.join(renamed, same, "left").drop(*names)


def cut_narrow(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for tables of a few narrow columns: at most four files for each core.

    Such tables hold little per shuffle partition; one small file for each would cost more in
    file operations than the rows themselves.
    """
    return cut_lineage(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
