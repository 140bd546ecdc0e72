"""The flagship query: a whole audit of the given pages."""

from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators.classify import authority_dim
from anchorlake.plans.audit import Observations, audit, verdicts_by_domain
from anchorlake.plans.q_pages import _CLEAN, _DOMAIN, _HREFS, _unescaped
from anchorlake.plans.registry import query
from anchorlake.rules import DEFAULT_DIRECTORY, DEFAULT_KEYWORDS, DEFAULT_PAID, DEFAULT_PARKED
from anchorlake.session import spread

CFG = AuditConfig(target_site="example.com")


def _count(word: str) -> str:
    body = word.replace(".", "[.]").replace("-", r"[-\s]?").replace(" ", r"\s+")
    prefix = r"(^|[^\p{L}\p{N}_])" if word.isascii() else ""
    return f"len(regexp_extract_all(low, '{prefix}{body}'))"


def _any(words: list[str], text: str = "low") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CATEGORIES = list(dict.fromkeys(r.category for r in DEFAULT_KEYWORDS))
_BY_CATEGORY = ", ".join(
    "(" + " + ".join(_count(r.word) for r in DEFAULT_KEYWORDS if r.category == c) + ")" for c in _CATEGORIES)
_HARD = " OR ".join(f"{_count(r.word)} > 0" for r in DEFAULT_KEYWORDS if r.unambiguous)


@query("audit_verdicts", f"""
WITH t AS (SELECT page_id, url, html, {_DOMAIN} AS registered, lower({_unescaped(_CLEAN)}) AS low,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len({_HREFS}) AS links FROM pages),
  h AS (SELECT *, [{_BY_CATEGORY}] AS hits, ({_HARD}) AS hard, {_any(DEFAULT_PARKED)} AS parked,
    ({' OR '.join(f'{_count(m)} > 0' for m in DEFAULT_PAID)}) AS paid,
    ({' OR '.join(f'{_count(m)} > 0' for m in DEFAULT_DIRECTORY)}) AS directory,
    {_any([r.word for r in DEFAULT_KEYWORDS], 'lower(url)')} AS url_spam,
    len(list_filter(string_split_regex(low, '\\s+'), lambda x: x <> '')) AS words,
    registered = 'example.com' AND links > 0 AS found FROM t),
  p AS (SELECT *, hard OR list_sum(hits) >= 4 OR list_max(hits) >= 3 AS spam FROM h),
  s AS (SELECT *, greatest(0, least(CASE WHEN parked THEN 8 ELSE 100 END,
    CASE WHEN registered LIKE '%.org' THEN 70 ELSE 58 END
    - CASE WHEN url LIKE 'http://%' THEN 3 ELSE 0 END - CASE WHEN found THEN 12 ELSE 30 END
    - CASE WHEN url_spam THEN 35 ELSE 0 END - CASE WHEN spam THEN 35 ELSE 0 END - CASE WHEN lang <> 'en' THEN 10 ELSE 0 END
    - CASE WHEN words < 150 THEN 8 ELSE 0 END - CASE WHEN directory THEN 12 ELSE 0 END - CASE WHEN paid THEN 8 ELSE 0 END))::INT AS score FROM p),
  v AS (SELECT registered, score, CASE WHEN url_spam OR parked OR spam THEN 'TOXIC' WHEN NOT found THEN 'LINK_LOST'
    WHEN score >= 75 THEN 'GOOD' WHEN score >= 50 THEN 'REVIEW' ELSE 'LOW_VALUE' END AS verdict FROM s)
SELECT registered, verdict, count(*) AS links, round_even(avg(score), 1) AS avg_score FROM v GROUP BY 1, 2""")
def audit_verdicts(t):
    """Verdicts per domain for links to example.com, each given page being a link."""
    source = spread(t.pages.select("url", "html"))
    backlinks = t.pages.select("url", F.lit("").alias("target"), F.lit("").alias("anchor"), F.lit("").alias("notes"))
    return verdicts_by_domain(audit(backlinks, Observations(source), CFG, authority_dim(t.spark)))
