"""Topical relevance of a page to configured concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.fixed_values import RELEVANCE_WEIGHTS
from anchorlake.functions.text import phrase_pattern, token_stream


def with_relevance(
    df: DataFrame, concepts: list[str], synonyms: dict[str, list[str]] | None = None,
    fields: dict[str, str] | None = None,
) -> DataFrame:
    """Share of concepts a page covers, weighted by the field that shows them best.

    ``fields`` maps title, h1, anchor, meta and body to column names. Each field is
    turned into a token stream once; each concept is one regex over it.
    """
    synonyms = synonyms or {}
    concepts = [c.strip() for c in concepts if c.strip()]
    fields = fields or {f: f for f in RELEVANCE_WEIGHTS if f in df.columns}
    if not concepts:
        return (df.withColumn("relevance_score", F.lit(0))
                .withColumn("relevance_matched", F.lit(""))
                .withColumn("relevance_missing", F.lit("")))
    streams = df.withColumns({f"_t_{name}": token_stream(F.col(c)) for name, c in fields.items()})
    # heaviest field first; among equal weights the declared order decides
    order = sorted((f for f in RELEVANCE_WEIGHTS if f in fields),
                   key=lambda f: -RELEVANCE_WEIGHTS[f])

    def best_field(concept: str) -> Column:
        pattern = phrase_pattern([concept, *synonyms.get(concept, [])])
        if pattern is None:
            return F.lit(None).cast("string")
        where = F.when(F.col(f"_t_{order[0]}").rlike(pattern), order[0])
        for name in order[1:]:
            where = where.when(F.col(f"_t_{name}").rlike(pattern), name)
        return where

    found = F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("concept"), best_field(c).alias("field"))
        for i, c in enumerate(concepts)])
    weights = F.create_map(*[F.lit(x) for kv in RELEVANCE_WEIGHTS.items() for x in kv])
    scored = streams.withColumn("_found", found).withColumn(
        "_hit", F.transform(
            F.filter("_found", lambda s: s["field"].isNotNull()),
            lambda s: F.struct((-F.element_at(weights, s["field"])).alias("less"),
                               s["at"].alias("at"), s["concept"].alias("concept"),
                               s["field"].alias("field"))))
    earned = F.aggregate("_hit", F.lit(0), lambda acc, s: acc - s["less"])
    ceiling = len(concepts) * RELEVANCE_WEIGHTS["title"]
    percent = F.bround(F.lit(100.0) * earned / ceiling, 0).cast("int")
    ranked = F.array_sort("_hit")
    detail = F.transform(ranked, lambda s: F.concat(
        s["concept"], F.lit(" ("), s["field"], F.lit(")")))
    missing = F.transform(F.filter("_found", lambda s: s["field"].isNull()),
                          lambda s: s["concept"])
    return (
        scored
        .withColumn("relevance_score", F.when(F.size("_hit") == 0, 0).otherwise(
            F.least(F.lit(100), F.greatest(F.lit(1), percent))))
        .withColumn("relevance_matched", F.array_join(detail, ", "))
        .withColumn("relevance_missing", F.array_join(missing, ", "))
        .drop("_found", "_hit", *[f"_t_{f}" for f in fields]))
