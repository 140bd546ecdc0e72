"""Queries on text scans and relevance over whole documents."""

from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions import text as X
from anchorlake.operators import textscan
from anchorlake.operators.relevance import with_relevance
from anchorlake.plans.registry import query
from anchorlake.rules import keyword_rules
from anchorlake.session import spread


@query("word_count", """
SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM documents""")
def word_count(t):
    return t.documents.select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


# words that do occur in the documents, in rules with ties, prefixes, gaps and non-ASCII words
TEXT_RULES = keyword_rules([
    ("verbs", "inger"), ("verbs", "reble"), ("verbs", "thwh-on"), ("verbs", "an the"),
    ("nouns", "eaunou"), ("nouns", "schen"), ("nouns", "eaux"), ("nouns", "enier"),
    ("names", "éau"), ("names", "ción"), ("names", "thinger"),
    ("marks", "worthless", True), ("marks", "eauvi", True), ("marks", "gefüh", True),
])


def _count_sql(word: str) -> str:
    body = word.replace("-", r"[-\s]?").replace(" ", r"\s+")
    prefix = r"(^|[^\p{L}\p{N}_])" if word.isascii() else ""
    return f"len(regexp_extract_all(lower(text), '{prefix}{body}'))"


_COUNTS = ", ".join(
    f"{{'i': {i}, 'c': '{r.category}', 'w': '{r.word}', 'u': {str(r.unambiguous).lower()}, 'n': {_count_sql(r.word)}}}"
    for i, r in enumerate(TEXT_RULES))
_HITS = f"""h AS (SELECT doc_id, unnest([{_COUNTS}]) AS r FROM documents),
  k AS (SELECT doc_id, r.i AS i, r.c AS c, r.w AS w, r.u AS u, r.n AS n FROM h WHERE r.n > 0)"""
_CATS = """p AS (SELECT doc_id, c, min(i) AS i, sum(n) AS n FROM k GROUP BY 1, 2)"""


@query("spam_verdict", f"""
WITH {_HITS}, cat_order AS (SELECT c, min(i) AS o FROM (VALUES {', '.join(f"('{r.category}', {i})" for i, r in enumerate(TEXT_RULES))}) v(c, i) GROUP BY 1),
  p AS (SELECT doc_id, k.c, o, sum(n) AS n FROM k JOIN cat_order USING (c) GROUP BY 1, 2, 3),
  t AS (SELECT doc_id, sum(n) AS total, max(n) AS top, string_agg(c, ', ' ORDER BY n DESC, o) AS cats FROM p GROUP BY 1),
  w AS (SELECT doc_id, string_agg(concat(w, ' x', n), ', ' ORDER BY n DESC, i) AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS rk FROM k) WHERE rk <= 6 GROUP BY 1),
  u AS (SELECT doc_id, string_agg(w, ', ' ORDER BY w) AS hard FROM k WHERE u GROUP BY 1)
SELECT d.doc_id, coalesce(t.total, 0)::INT AS content_spam_total, coalesce(t.cats, '') AS content_spam_categories,
  coalesce(w.words, '') AS content_spam_keywords, coalesce(u.hard, '') AS content_spam_unambiguous,
  coalesce(u.hard, '') <> '' OR coalesce(t.total, 0) >= 9 OR coalesce(t.top, 0) >= 6 AS content_spam
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN u USING (doc_id)""")
def spam_verdict(t):
    return textscan.scan_text(spread(t.documents.select("doc_id", "text")), TEXT_RULES, "text", 9, 6).drop("text")


@query("keyword_totals", f"""WITH {_HITS} SELECT doc_id, c AS category, sum(n)::BIGINT AS hits FROM k GROUP BY 1, 2""")
def keyword_totals(t):
    hits = textscan.keyword_hits(spread(t.documents.select("doc_id", "text")), TEXT_RULES)
    return textscan.category_totals(hits, ["doc_id"])


@query("keyword_top", f"""WITH {_HITS} SELECT w AS word, sum(n)::BIGINT AS hits, count(*) AS texts
FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def keyword_top(t):
    return textscan.top_keywords(
        textscan.keyword_hits(spread(t.documents.select("doc_id", "text")), TEXT_RULES))


PARKED = ["ble of", "eau", "ich", "the an", "tion."]
PAID = ["an the", "eaux", "thwh-on", "der"]
DIRECTORY = ["of the", "inger", "la", "un"]


def _first_three(words, test) -> str:
    cases = ", ".join(f"CASE WHEN {test(w)} THEN '{w}' END" for w in words)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL)[1:3], ', ')"


@query("marker_scan", f"""
SELECT doc_id, {_first_three(PARKED, lambda w: f"contains(lower(text), '{w}')")} AS parked_markers,
  {_first_three(PAID, lambda w: f"{_count_sql(w)} > 0")} AS paid_link_markers,
  {_first_three(DIRECTORY, lambda w: f"{_count_sql(w)} > 0")} AS link_directory_markers
FROM documents""")
def marker_scan(t):
    return textscan.scan_markers(
        spread(t.documents.select("doc_id", "text")), "text", PARKED, PAID, DIRECTORY).drop("text")


CONCEPTS = ["then things", "was", "ands", "studies in programmes", "inlying", "ofing that", "eaus", "staff people"]
SYNONYMS = {"was": ["is"], "ands": ["und", "et"], "studies in programmes": ["of the an", "de la"],
            "staff people": ["employees person", "die"]}
_STEM_TABLE = "MAP {" + ", ".join(
    f"'{k}': '{v}'" for k, v in fixed.STEM_TABLE.items()) + "}"
_SUFFIXES = fixed.STEM_SUFFIXES


def _stem_sql(w: str) -> str:
    """Stemming as a CASE over a bare word, with the same table and suffix order."""
    cases = " ".join(
        f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 4 THEN coalesce(tbl[{w}[:-{len(s) + 1}]], "
        + (f"concat({w}[:-{len(s) + 1}], 'y')" if s == "ies" else f"{w}[:-{len(s) + 1}]") + ")"
        for s in _SUFFIXES)
    return f"coalesce(tbl[{w}], CASE WHEN length({w}) <= 4 THEN {w} {cases} ELSE {w} END)"


def _stems_sql(text: str) -> str:
    words = f"list_transform(regexp_extract_all(lower({text}), '[a-z][a-z''-]*'), lambda x: regexp_replace(x, '[''-]+$', ''))"
    return f"list_transform({words}, lambda w: {_stem_sql('w')})"


@query("stem_counts", f"""
WITH m AS (SELECT {_STEM_TABLE} AS tbl), w AS (SELECT unnest({_stems_sql('text')}) AS stem FROM documents, m)
SELECT stem, count(*) AS n FROM w GROUP BY 1""")
def stem_counts(t):
    """Words are counted as they stand, so each different one is stemmed once."""
    words = spread(t.documents.select("text")).select(F.explode(X.raw_tokens(F.col("text"))).alias("word")).groupBy(
        "word").agg(F.count("*").alias("n"))
    return words.groupBy(X.stem(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


_BODY = f"concat(' ', array_to_string({_stems_sql('body')}, ' '), ' ')"
_HEAD = f"concat(' ', array_to_string({_stems_sql('title')}, ' '), ' ')"


def _relevance_sql() -> str:
    from anchorlake.functions.text import stem_word
    import re

    def has(stream: str, concept: str) -> str:
        forms = [concept, *SYNONYMS.get(concept, [])]
        tests = [f"contains({stream}, ' {' '.join(stem_word(w) for w in re.findall('[a-z]+', f))} ')" for f in forms]
        return "(" + " OR ".join(tests) + ")"

    weights = [f"CASE WHEN {has('hs', c)} THEN 3 WHEN {has('bs', c)} THEN 1 ELSE 0 END" for c in CONCEPTS]
    found = ", ".join(f"{{'w': {w}, 'c': '{c}', 'i': {i}}}" for i, (c, w) in enumerate(zip(CONCEPTS, weights)))
    return f"""
WITH m AS (SELECT {_STEM_TABLE} AS tbl),
  d AS (SELECT doc_id, text AS body, concat_ws(' ', lang, source, string_split(text, chr(10))[1]) AS title FROM documents),
  s AS (SELECT doc_id, {_HEAD} AS hs, {_BODY} AS bs FROM d, m),
  f AS (SELECT doc_id, [{found}] AS f FROM s),
  r AS (SELECT doc_id, f, list_sum(list_transform(f, lambda x: x.w)) AS earned FROM f)
SELECT doc_id, CASE WHEN earned = 0 THEN 0
    ELSE least(100, greatest(1, round_even(100.0 * earned / {3 * len(CONCEPTS)}, 0)))::INT END AS relevance_score,
  array_to_string(list_transform(list_sort(list_filter(list_transform(f, lambda x:
      {{'o': -x.w, 'i': x.i, 't': concat(x.c, CASE WHEN x.w = 3 THEN ' (title)' ELSE ' (body)' END)}}),
    lambda x: x.o < 0))[1:6], lambda x: x.t), ', ') AS relevance_matched,
  array_to_string(list_transform(list_filter(f, lambda x: x.w = 0)[1:8], lambda x: x.c), ', ') AS relevance_missing
FROM r"""


@query("relevance", _relevance_sql())
def relevance(t):
    """Concepts over whole documents: the first line plays the title, the text the body."""
    docs = spread(t.documents).select(
        "doc_id", F.col("text").alias("body"),
        F.concat_ws(" ", "lang", "source", F.substring_index("text", "\n", 1)).alias("title"))
    return with_relevance(docs, CONCEPTS, SYNONYMS).select(
        "doc_id", "relevance_score", "relevance_matched", "relevance_missing")
