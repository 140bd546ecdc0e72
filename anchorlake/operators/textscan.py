"""Keyword and marker scans over URLs and page text.

Rules are literals in the plan: no rule x text join. The words of all rules are found in one
pass over a text, so its cost does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.functions.text import contains_any_keyword, keyword_pattern
from anchorlake.operators.wordtrie import word_hits
from anchorlake.rules import DEFAULT_DIRECTORY, DEFAULT_PAID, DEFAULT_PARKED, Keyword


def contains_any(low: Column, words: list[str]) -> Column:
    """Does lower-cased text contain any of the words as a plain substring?"""
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


def scan_urls(df: DataFrame, rules: list[Keyword], url_col: str = "url") -> DataFrame:
    """Distinct sorted categories and words that occur in the lower-cased URL."""
    url = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    scanned = df.withColumn("_hits", word_hits(url, [r.word for r in rules], plain=True))

    def listed(names: list[str]) -> Column:
        found = F.transform("_hits", lambda h: F.get(_strings(names), h["rule"]))
        return F.array_join(F.array_sort(F.array_distinct(found)), ", ")

    return scanned.withColumns({
        "url_spam_categories": listed([r.category for r in rules]),
        "url_spam_keywords": listed([r.word for r in rules])}).drop("_hits")


def _strings(values: list[str]) -> Column:
    return F.lit(values) if values else F.array().cast("array<string>")


def scan_text(
    df: DataFrame, rules: list[Keyword], text_col: str = "text",
    total_hits: int = 4, category_hits: int = 3,
) -> DataFrame:
    """Count every rule word in a text and decide whether the text is spam.

    Spam is one unambiguous word, ``total_hits`` hits in all, or ``category_hits``
    in one category. Categories come most hits first, then in rule order.
    """
    categories: list[str] = list(dict.fromkeys(r.category for r in rules))
    rules = [r for c in categories for r in rules if r.category == c]
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    category_of = F.lit([categories.index(r.category) for r in rules]) if rules else F.array().cast("array<int>")
    # one row of the plan for every category, none for every word
    counted = df.withColumn("_hits", F.transform(word_hits(low, [r.word for r in rules]), lambda h: F.struct(
        h["rule"].alias("rule"), h["n"].alias("n"), F.get(category_of, h["rule"]).alias("category"))))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda acc, h: acc + h["n"])

    def category(at: int, name: str) -> Column:
        own = F.filter("_hits", lambda h: h["category"] == at)
        return F.struct((-total(own)).alias("less"), F.lit(at).alias("at"), F.lit(name).alias("name"))

    per_category = F.array(*[category(at, name) for at, name in enumerate(categories)]) if categories else F.array().cast(
        "array<struct<less:int,at:int,name:string>>")
    words = F.transform("_hits", lambda h: F.struct(
        (-h["n"]).alias("less"), h["rule"].alias("at"), F.get(_strings([r.word for r in rules]), h["rule"]).alias("name")))
    hard = [i for i, r in enumerate(rules) if r.unambiguous]
    certain = F.transform(F.filter("_hits", lambda h: h["rule"].isin(hard)),
                          lambda h: F.get(_strings([r.word for r in rules]), h["rule"]))
    ranks = counted.withColumns({
        "_cats": F.array_sort(F.filter(per_category, lambda s: s["less"] < 0)), "_words": F.array_sort(words),
        "content_spam_total": total(F.col("_hits")),
        "content_spam_unambiguous": F.array_join(F.array_sort(certain), ", ")})
    top = F.transform(F.slice("_words", 1, 6),
                      lambda w: F.concat(w["name"], F.lit(" x"), (-w["less"]).cast("string")))
    most = F.coalesce(-F.get("_cats.less", F.lit(0)), F.lit(0))
    return ranks.withColumns({
        "content_spam": (F.col("content_spam_unambiguous") != "")
        | (F.col("content_spam_total") >= total_hits) | (most >= category_hits),
        "content_spam_categories": F.array_join("_cats.name", ", "),
        "content_spam_keywords": F.array_join(top, ", "),
    }).drop("_hits", "_cats", "_words")


def keyword_hits(df: DataFrame, rules: list[Keyword], text_col: str = "text") -> DataFrame:
    """Long table of (row, category, word, hits) for the words that occur.

    One row leaves per word present, not per rule.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    kept = [c for c in df.columns if c != text_col]
    hit = df.select(*kept, F.explode(word_hits(low, [r.word for r in rules])).alias("_h"))
    named = lambda names, as_name: F.get(_strings(names), F.col("_h.rule")).alias(as_name)
    return hit.select(*kept, named([r.category for r in rules], "category"), named([r.word for r in rules], "word"),
                      F.col("_h.n").alias("hits"))


def category_totals(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits per key and category."""
    return hits.groupBy(*keys, "category").agg(F.sum("hits").cast("long").alias("hits"))


def top_keywords(hits: DataFrame, limit: int = 6) -> DataFrame:
    """Most frequent words overall."""
    totals = hits.groupBy("word").agg(
        F.sum("hits").cast("long").alias("hits"), F.count("*").alias("texts"))
    return totals.orderBy(F.desc("hits"), "word").limit(limit)


def _first_markers(present: list[Column]) -> Column:
    return F.array_join(F.slice(F.array_compact(F.array(*present)), 1, 3), ", ")


def scan_markers(
    df: DataFrame, text_col: str = "text", parked: list[str] = DEFAULT_PARKED,
    paid: list[str] = DEFAULT_PAID, directory: list[str] = DEFAULT_DIRECTORY,
) -> DataFrame:
    """First three parked, paid-link and link-directory markers, in list order."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    scanned = df.withColumn("_low", low)
    text = F.col("_low")

    def matching(markers: list[str]) -> Column:
        return F.when(
            contains_any_keyword(text, markers),
            _first_markers([F.when(text.rlike(keyword_pattern(m)), F.lit(m)) for m in markers])
        ).otherwise("")

    return scanned.withColumns({
        "parked_markers": F.when(contains_any(text, parked), _first_markers(
            [F.when(text.contains(m), F.lit(m)) for m in parked])).otherwise(""),
        "paid_link_markers": matching(paid), "link_directory_markers": matching(directory),
    }).drop("_low")
