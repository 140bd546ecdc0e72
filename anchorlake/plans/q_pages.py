"""Queries on page parsing, links, placement, home pages and anchors.

The given pages carry all their links in one ``nav``. Where a feature needs more
variety, the markup of every page is varied by its page_id before parsing, so the
parser and all features still run over whole pages.
"""

from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.operators import anchors, links, pages
from anchorlake.operators.keyed import first_per_key
from anchorlake.plans.registry import query
from anchorlake.session import spread

CFG = AuditConfig(target_site="https://www.example.com/", target_aliases=("example.org",))

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '<(script|style)>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"""
_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
             ("&amp;", "&"), ("&amp", "&"))


def _unescaped(sql: str) -> str:
    for entity, char in _ENTITIES:
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


_TITLE = _unescaped("trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\\s+', ' ', 'g'))")
_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"
_DOMAIN = f"regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1)"
_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query("page_parse", f"""
SELECT page_id, {_TITLE} AS title,
  {_unescaped("trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '\\s+', ' ', 'g'))")} AS h1,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  len(list_filter(string_split_regex({_unescaped(_CLEAN)}, '\\s+'), lambda x: x <> '')) AS word_count,
  len({_HREFS}) AS n_links
FROM pages""")
def page_parse(t):
    return pages.parse_pages(spread(t.pages)).select(
        "page_id", "title", "h1", "lang", X.word_count(F.col("text")).cast("long").alias("word_count"),
        F.size("links").cast("long").alias("n_links"))


@query("link_inventory", f"""
SELECT page_id, {_DOMAIN} AS page_domain, len({_HREFS}) AS internal_links, 0::BIGINT AS outbound_links,
  len({_HREFS}) AS total_links FROM pages WHERE len({_HREFS}) > 0""")
def link_inventory(t):
    parsed = pages.parse_pages(spread(t.pages)).withColumn(
        "page_domain", U.registered_domain(F.col("url")))
    exploded = links.explode_links(parsed, ["page_id", "page_domain"])
    return links.link_counts(exploded, ["page_id", "page_domain"], "page_domain")


@query("absolute_links", f"""
WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, unnest({_HREFS}) AS href FROM pages)
SELECT {_unescaped("concat(origin, href)")} AS absolute, count(*) AS n FROM l GROUP BY 1""")
def absolute_links(t):
    parsed = pages.parse_pages(spread(t.pages))
    return links.explode_links(parsed, ["page_id"]).groupBy("absolute").agg(F.count("*").alias("n"))


def _varied(t):
    """Pages whose links sit in different containers, with different rel values."""
    kind = "CAST(page_id % 7 AS INT)"
    opening = f"""CASE {kind} WHEN 1 THEN '<div class="Entry-Content main">' WHEN 2 THEN '<section id="blogroll">'
      WHEN 3 THEN '<article><aside class="x">' WHEN 4 THEN '<main>' WHEN 5 THEN '<div style="Display : none">'
      WHEN 6 THEN '<div>' ELSE '<nav>' END"""
    closing = f"""CASE {kind} WHEN 1 THEN '</div>' WHEN 2 THEN '</section>' WHEN 3 THEN '</aside></article>'
      WHEN 4 THEN '</main>' WHEN 5 THEN '</div>' WHEN 6 THEN '</div>' ELSE '</nav>' END"""
    anchor = """CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '<a rel="nofollow  UGC" href="/'
      WHEN 1 THEN "<a class=k rel=sponsored href='/" ELSE '<a href="/' END"""
    ending = """CASE CAST(page_id % 5 AS INT) WHEN 1 THEN "'>" ELSE '">' END"""
    head = """CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '<meta name="Robots" content="NOINDEX, follow">'
      WHEN 1 THEN '<meta content="none" property="googlebot"/><link rel="canonical" href="/other">'
      WHEN 2 THEN concat('<meta name=generator content="WordPress  6.', CAST(page_id % 3 AS STRING), '">',
        '<link href="#top" rel="Canonical">', '<META NAME="Description" CONTENT="about  &amp; more">')
      ELSE '' END"""
    inner = f"regexp_replace(html, '<a href=\"/([^\"]*)\">', concat({anchor}, '$1', {ending}))"
    body = f"replace(replace({inner}, '<nav>', {opening}), '</nav>', {closing})"
    return spread(t.pages).selectExpr(
        "page_id", "url", f"replace({body}, '<title>', concat({head}, '<title>')) AS html")


_TEXTS = "regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)"
_FOUND = f"({_DOMAIN} IN ('example.com', 'example.org') AND len({_HREFS}) > 0)"


_ANCHOR_TEXTS = _unescaped(f'''(SELECT string_agg(x, ' | ' ORDER BY i) FROM (
    SELECT min(i) AS i, trim(x) AS x FROM (SELECT unnest({_TEXTS}) AS x, generate_subscripts({_TEXTS}, 1) AS i)
    GROUP BY 2))''')


@query("target_links", f"""
SELECT page_id, {_FOUND} AS link_found, CASE WHEN {_FOUND} THEN len({_HREFS}) ELSE 0 END AS link_count,
  CASE WHEN NOT {_FOUND} THEN '' ELSE CASE page_id % 7 WHEN 1 THEN 'in-content' WHEN 2 THEN 'boilerplate'
    WHEN 3 THEN 'boilerplate' WHEN 4 THEN 'in-content' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unknown'
    ELSE 'boilerplate' END END AS link_placement,
  {_FOUND} AND page_id % 7 = 5 AS link_in_hidden_block,
  CASE WHEN NOT {_FOUND} THEN '' WHEN page_id % 5 = 0 THEN 'nofollow, ugc' WHEN page_id % 5 = 1 THEN 'sponsored'
    ELSE '' END AS link_rel,
  {_FOUND} AND page_id % 5 > 1 AS is_followed,
  CASE WHEN {_FOUND} THEN {_ANCHOR_TEXTS} ELSE '' END AS anchor_texts
FROM pages""")
def target_links(t):
    found = links.with_link_features(pages.parse_pages(_varied(t)), CFG)
    return found.select("page_id", "link_found", F.col("link_count").cast("long").alias("link_count"),
                        "link_placement", "link_in_hidden_block", "link_rel", "is_followed", "anchor_texts")


@query("indexability", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'noindex, follow' WHEN 1 THEN 'none' ELSE '' END AS meta_robots,
  page_id % 4 IN (0, 1) AS is_noindex, page_id % 4 = 1 AS is_nofollow_page, page_id % 4 = 1 AS canonical_mismatch,
  CASE WHEN page_id % 4 = 2 THEN concat('WordPress 6.', CAST(page_id % 3 AS STRING)) ELSE '' END AS generator,
  CASE WHEN page_id % 4 = 2 THEN 'about & more' ELSE '' END AS description,
  page_id % 7 = 5 AS hidden_text
FROM pages""")
def indexability(t):
    varied = _varied(t).withColumn("hidden_text", pages.hidden_text(F.col("html")))
    return pages.with_indexability(pages.parse_pages(varied)).select(
        "page_id", "meta_robots", "is_noindex", "is_nofollow_page", "canonical_mismatch", "generator",
        "description", "hidden_text")


@query("readable_pages", f"""
WITH k AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/HTML; charset=UTF-16'
  WHEN 2 THEN NULL WHEN 3 THEN 'image/png' ELSE 'application/xhtml+xml; charset="utf8"' END AS content_type,
  CASE page_id % 5 WHEN 1 THEN 'utf-16-le' ELSE 'utf-8' END AS charset, page_id % 5 = 4 AS broken FROM pages)
SELECT coalesce(content_type, '') AS content_type, charset, count(*) AS n, sum(broken::INT)::BIGINT AS undecodable,
  sum(length(html))::BIGINT AS chars, sum(len({_HREFS}))::BIGINT AS links
FROM k JOIN pages USING (page_id) WHERE page_id % 5 NOT IN (0, 3) GROUP BY 1, 2""")
def readable(t):
    """Pages as bytes: UTF-16 with a mark, UTF-8 by the page's own word, and UTF-8 with bytes that are none."""
    kinds = spread(t.pages).selectExpr("page_id", "url", """CASE CAST(page_id % 5 AS INT)
        WHEN 1 THEN concat(X'FFFE', encode(html, 'UTF-16LE'))
        WHEN 4 THEN concat(X'', encode(html, 'UTF-8'), X'FFFE') ELSE encode(html, 'UTF-8') END AS body""",
        """CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/HTML; charset=UTF-16'
        WHEN 2 THEN NULL WHEN 3 THEN 'image/png' ELSE 'application/xhtml+xml; charset="utf8"' END AS content_type""")
    read = pages.decoded_pages(pages.readable_pages(kinds)).withColumn("chars", F.length("html"))
    return pages.parse_pages(read).groupBy(F.coalesce("content_type", F.lit("")).alias("content_type"), "charset").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("undecodable") > 0, 1).otherwise(0)).cast("long").alias("undecodable"),
        F.sum("chars").cast("long").alias("chars"), F.sum(F.size("links")).cast("long").alias("links"))


@query("lang_mismatch", """
SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  regexp_extract(html, '<html lang="([^"]*)"', 1) NOT IN ('en', 'de') AS lang_mismatch, count(*) AS pages
FROM pages GROUP BY 1, 2""")
def lang_mismatch(t):
    parsed = pages.parse_pages(spread(t.pages))
    return parsed.groupBy("lang", X.language_mismatch(F.col("lang"), ["en-GB", "DE"]).alias("lang_mismatch")).agg(
        F.count("*").alias("pages"))


_OLDEST = f"""SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, min(page_id) AS home_id
  FROM pages GROUP BY 1 HAVING length(origin) % 4 <> 0"""
_WORDS = f"len(list_filter(string_split_regex({_unescaped(_CLEAN)}, '\\s+'), lambda x: x <> ''))"


@query("homepage_join", f"""
WITH h AS ({_OLDEST}), f AS (SELECT *, {_WORDS} AS words, {_TITLE} AS title FROM pages)
SELECT p.page_id, h.origin IS NOT NULL AS home_checked, h.origin || '/' AS home_url,
  f.title AS home_title, f.words AS home_word_count
FROM pages p LEFT JOIN h ON h.origin = regexp_extract(p.url, '^(https?://[^/?#]+)', 1)
LEFT JOIN f ON f.page_id = h.home_id""")
def homepage_join(t):
    """Each site's oldest page plays its home page; some are filed under another site's name."""
    origin = U.origin_of(F.col("url"))
    homes = first_per_key(
        spread(t.pages).select(origin.alias("origin"), "page_id", "html"), ["origin"], [F.col("page_id")]).selectExpr(
            "concat(origin, CASE WHEN length(origin) % 4 = 0 THEN '.elsewhere.net/' ELSE '/' END) AS url", "html")
    features = pages.parse_pages(homes).select(
        "url", F.col("title").alias("page_title"), X.word_count(F.col("text")).cast("long").alias("word_count"))
    out = pages.with_homepage(t.pages.select("page_id", "url"), features)
    return out.select("page_id", "home_checked", "home_url", "home_title", "home_word_count")


@query("sitewide_sample", f"""
WITH l AS (SELECT page_id, {_unescaped("concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), href)")} AS u, i
    FROM (SELECT page_id, url, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) AS i FROM pages)),
  d AS (SELECT page_id, u, min(i) AS i FROM l GROUP BY 1, 2),
  c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos FROM d),
  r AS (SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM c
    WHERE pos <= 9 AND length(u) % 4 <> 0),
  s AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE length(u) % 3 = 0) AS hits FROM r WHERE k <= 3 GROUP BY 1)
SELECT p.page_id, coalesce(s.n, 0) AS sitewide_sampled, coalesce(s.hits, 0) AS sitewide_hits,
  coalesce(round(s.hits / s.n, 2), 0) AS sitewide_ratio, coalesce(s.n, 0) > 0 AS sitewide_checked
FROM pages p LEFT JOIN s USING (page_id)""")
def sitewide(t):
    """Link targets play the fetched pages; a URL's length says what was seen there."""
    found = links.with_link_features(pages.parse_pages(spread(t.pages)), CFG).select(
        "page_id", "url", "internal_urls", F.lit(True).alias("link_found"))
    seen = found.select(F.explode("internal_urls").alias("u")).distinct().select(
        F.when(F.length("u") % 4 == 0, F.concat(F.lit("unread:"), "u")).otherwise(F.col("u")).alias("url"),
        (F.length("u") % 3 == 0).alias("link_found"))
    return links.sitewide_sample(found, seen, 3).select(
        "page_id", F.col("sitewide_sampled").cast("long").alias("sitewide_sampled"),
        F.col("sitewide_hits").cast("long").alias("sitewide_hits"), "sitewide_ratio", "sitewide_checked")


ANCHOR_CFG = CFG.with_changes(brand_terms=("the", "sch"), max_single_anchor_share=1.0, max_keyword_share=10.0)
_ANCHORS = f"""a AS (SELECT lower(x) AS anchor, page_id FROM (
    SELECT DISTINCT page_id, trim({_unescaped('y')}) AS x FROM (
      SELECT page_id, unnest({_TEXTS}) AS y FROM pages WHERE {_DOMAIN} IN ('example.com', 'example.org')))
    WHERE x <> ''),
  k AS (SELECT anchor, CASE WHEN contains(anchor, 'the') OR contains(anchor, 'sch') THEN 'branded'
      WHEN regexp_matches(anchor, '^(https?://|www[.])|[.](com|org|net|io|co|in|de)([^a-z0-9_äöüßéèêàçñóíáú]|$)') THEN 'naked-url'
      WHEN anchor IN ('click here','here','read more','more','link','this','this link','website','visit',
        'visit website','learn more','see more','source','read the full article','continue reading',
        'check it out','view') OR length(anchor) <= 3 THEN 'generic' ELSE 'keyword' END AS kind FROM a)"""


def _profile(t):
    return links.with_link_features(pages.parse_pages(spread(t.pages)), ANCHOR_CFG)


@query("anchor_distribution", f"WITH {_ANCHORS} SELECT anchor, kind, count(*) AS n FROM k GROUP BY 1, 2")
def anchor_distribution(t):
    return anchors.anchor_distribution(_profile(t), ANCHOR_CFG)


@query("anchor_top", f"""WITH {_ANCHORS} SELECT anchor, kind, count(*) AS n,
  round_even(100.0 * count(*) / (SELECT count(*) FROM k), 1)::DOUBLE AS share
FROM k GROUP BY 1, 2 ORDER BY n DESC, anchor LIMIT 25""")
def anchor_top(t):
    return anchors.top_anchors(anchors.anchor_distribution(_profile(t), ANCHOR_CFG))


_ANCHOR_TOTALS = """s AS (SELECT count(*) AS total, count(DISTINCT anchor) AS distinct_anchors,
    count(*) FILTER (WHERE kind = 'branded') AS branded, count(*) FILTER (WHERE kind = 'naked-url') AS naked_url,
    count(*) FILTER (WHERE kind = 'generic') AS generic, count(*) FILTER (WHERE kind = 'image-empty') AS image_empty,
    count(*) FILTER (WHERE kind = 'keyword') AS keyword FROM k),
  b AS (SELECT anchor AS top_anchor, count(*) AS top_n FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""


@query("anchor_summary", f"""WITH {_ANCHORS}, {_ANCHOR_TOTALS}
SELECT s.*, b.top_anchor, b.top_n, (SELECT count(*) FROM pages WHERE {_FOUND}) AS followed FROM s, b""")
def anchor_summary(t):
    return anchors.anchor_summary(_profile(t), ANCHOR_CFG)


_ANCHOR_WARNINGS = """SELECT 'one_anchor_dominates' AS warning, top_n AS n, total, top_anchor AS anchor FROM s, b
    WHERE 100.0 * top_n / total > 1 AND top_n >= 3
  UNION ALL SELECT 'too_many_keyword_anchors', keyword, total, '' FROM s WHERE 100.0 * keyword / total > 10
  UNION ALL SELECT 'no_branded_anchors', branded, total, '' FROM s WHERE branded = 0
  UNION ALL SELECT 'too_many_image_anchors', image_empty, total, '' FROM s WHERE 100.0 * image_empty / total > 40"""


@query("anchor_warnings", f"""WITH {_ANCHORS}, {_ANCHOR_TOTALS}, w AS ({_ANCHOR_WARNINGS})
SELECT warning, round_even(100.0 * n / total, 1)::DOUBLE AS share, n, total, anchor FROM w""")
def anchor_warnings(t):
    return anchors.anchor_warnings(_profile(t), ANCHOR_CFG)
