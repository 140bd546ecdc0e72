"""A training corpus from raw documents: five stages, each one operator of the library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores every result
as Parquet in the shared folder and reads it again for the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anchorlake.llm.decontamination import without_contamination
from anchorlake.llm.near_duplicates import keep_one
from anchorlake.llm.packing import pack_documents
from anchorlake.llm.quality_rules import keep_good
from anchorlake.llm.source_mix import mixed_documents
from anchorlake.session import cut_lineage, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds of their group."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token sequences of all documents."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("source mix", mix),
    ("packed tokens", pack),
]

# Consistent sampling, random walks, knapsack choices and token ids are beyond SQL; the
# stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in ``sf_dir``."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
