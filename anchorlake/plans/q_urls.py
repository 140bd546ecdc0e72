"""Queries on URL functions, status classes and trust tiers."""

from pyspark.sql import functions as F

from anchorlake.functions import status as S
from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.operators import classify
from anchorlake.operators.textscan import scan_urls
from anchorlake.plans.registry import columns, query
from anchorlake.rules import keyword_rules

_HOST = "regexp_extract(url, '^https?://([^/?#:]+)', 1)"


@query("url_parts", f"""
SELECT page_id, {_HOST} AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
  regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) AS registered,
  regexp_extract({_HOST}, '([^.]+)$', 1) AS suffix,
  regexp_replace(regexp_replace({_HOST}, '[.]?[^.]+[.][^.]+$', ''), '^www$|^www[.]', '') AS subdomain,
  regexp_replace(regexp_replace({_HOST}, '[.]?[^.]+[.][^.]+$', ''), '^www$|^www[.]', '') <> '' AS is_subdomain,
  regexp_matches(url, '^https?://[^/]*/?$') AS homepage,
  regexp_extract(url, '^([^#]*)', 1) AS no_fragment
FROM pages""")
def url_parts(t):
    return classify.with_domain_parts(t.pages.select("page_id", "url")).select(
        "page_id", "host", U.origin_of(F.col("url")).alias("origin"), "registered", "suffix", "subdomain",
        "is_subdomain", U.is_homepage(F.col("url")).alias("homepage"),
        U.without_fragment(F.col("url")).alias("no_fragment"))


# hosts under many kinds of suffix, one per customer
_KINDS = [  # host pattern, registered domain, suffix, free subdomain
    ("site{k}.com", "site{k}.com", "com", False),
    ("www.site{k}.co.uk", "site{k}.co.uk", "co.uk", False),
    ("dept.site{k}.edu.pe", "site{k}.edu.pe", "edu.pe", False),
    ("a.b.site{k}.gov.in", "site{k}.gov.in", "gov.in", False),
    ("site{k}.zapto.org", "zapto.org", "org", True),
    ("x.site{k}.github.io", "site{k}.github.io", "github.io", False),
    ("www.site{k}.org", "site{k}.org", "org", False),
    ("blog.site{k}.xyz", "site{k}.xyz", "xyz", False),
    ("site{k}.altervista.org", "site{k}.altervista.org", "altervista.org", True),
    ("en.wikipedia.org", "wikipedia.org", "org", False),
    ("m.site{k}.org.au", "site{k}.org.au", "org.au", False),
    # labels that are suffixes in some countries only
    ("mail{k}.web.de", "web.de", "de", False),
    ("x{k}.nic.io", "nic.io", "io", False),
    ("site{k}.edu.tk", "edu.tk", "tk", False),
    ("site{k}.go.it", "go.it", "it", False),
    ("a.site{k}.ed.ws", "ed.ws", "ws", False),
    ("x.site{k}.res.in", "site{k}.res.in", "res.in", False),
    ("site{k}.education", "site{k}.education", "education", False),
    ("www.x.site{k}.school.nz", "site{k}.school.nz", "school.nz", False),
    ("gov.uk", "gov.uk", "uk", False),
]


def _pick(index: int, key: str) -> str:
    """CASE over the kinds, as SQL both engines read."""
    cases = []
    for i, kind in enumerate(_KINDS):
        value = kind[index]
        text = (f"concat('{value.split('{k}')[0]}', {key}, '{value.split('{k}')[1]}')"
                if isinstance(value, str) and "{k}" in value
                else f"'{value}'" if isinstance(value, str) else str(value).lower())
        cases.append(f"WHEN {i} THEN {text}")
    return f"CASE CAST(c_custkey % {len(_KINDS)} AS INT) {' '.join(cases)} END"


_KEY = "CAST(c_custkey AS STRING)"
_SITE = {
    "c_custkey": "c_custkey",
    "url": f"concat('http://u:p@', upper({_pick(0, _KEY)}), ':8080/p/', {_KEY}, '?q=1#f')",
}


@query("domain_parts", f"""
SELECT c_custkey, {_pick(0, _KEY)} AS host, {_pick(1, _KEY)} AS registered, {_pick(2, _KEY)} AS suffix,
  {_pick(3, _KEY)} AS free_subdomain,
  CASE WHEN regexp_replace({_pick(0, _KEY)}, '^www[.]', '') = {_pick(1, _KEY)} THEN ''
       ELSE replace(regexp_replace({_pick(0, _KEY)}, '^www[.]', ''), concat('.', {_pick(1, _KEY)}), '') END AS subdomain
FROM customer""")
def domain_parts(t):
    sites = t.customer.selectExpr(*columns(**_SITE))
    return classify.with_domain_parts(sites).select(
        "c_custkey", "host", "registered", "suffix", "free_subdomain", "subdomain")


@query("trust_tier", f"""
WITH s AS (SELECT c_custkey, {_pick(1, _KEY)} AS registered, {_pick(2, _KEY)} AS suffix FROM customer)
SELECT c_custkey, registered,
  CASE WHEN suffix IN ('edu.pe', 'gov.in', 'res.in', 'school.nz') THEN 'A' WHEN registered = 'wikipedia.org' THEN 'B'
       WHEN suffix IN ('org', 'org.au') THEN 'C' ELSE 'D' END AS tier,
  CASE suffix WHEN 'edu.pe' THEN 'Institutional (education)' WHEN 'gov.in' THEN 'Institutional (government)'
       WHEN 'res.in' THEN 'Institutional (education)' WHEN 'school.nz' THEN 'Institutional (education)'
       ELSE CASE WHEN registered = 'wikipedia.org' THEN 'High authority (curated)'
            WHEN suffix IN ('org', 'org.au') THEN 'Non-profit TLD (weak signal)' ELSE 'Unproven' END END AS tier_label,
  suffix IN ('xyz', 'tk', 'ws') AS spam_tld,
  CASE WHEN registered = 'wikipedia.org' THEN 'reference' ELSE '' END AS authority_group
FROM s""")
def trust_tier(t):
    dim = classify.authority_dim(t.spark, {"reference": ["wikipedia.org"], "late": ["en.wikipedia.org"]})
    rows = classify.with_trust_tier(
        classify.with_domain_parts(t.customer.selectExpr(*columns(**_SITE))), dim)
    group = F.when(F.col("host") == "en.wikipedia.org", "reference").otherwise(F.col("authority_group"))
    return rows.select("c_custkey", "registered", "tier", "tier_label", "spam_tld",
                       group.alias("authority_group"))


_RAW = """CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat('  site', {k}, '.com/a ')
  WHEN 1 THEN concat('"site', {k}, '.com"') WHEN 2 THEN concat('http://site', {k}, '.com')
  WHEN 3 THEN concat('//site', {k}, '.com/x') WHEN 4 THEN concat('https://site', {k}, '.com/?a=b')
  ELSE '  ' END""".format(k=_KEY)


@query("url_normalise", f"""
SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat('https://site', {_KEY}, '.com/a')
  WHEN 1 THEN concat('https://site', {_KEY}, '.com') WHEN 2 THEN concat('http://site', {_KEY}, '.com')
  WHEN 3 THEN concat('https://site', {_KEY}, '.com/x') WHEN 4 THEN concat('https://site', {_KEY}, '.com/?a=b')
  ELSE '' END AS url FROM customer""")
def url_normalise(t):
    return t.customer.selectExpr("c_custkey", f"{_RAW} AS raw").select(
        "c_custkey", U.normalize_url(F.col("raw")).alias("url"))


@query("canonical_mismatch", """
SELECT page_id,
  regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '')
    = regexp_replace(regexp_extract(replace(url, '.html', ''), '^https?://([^?#]*)', 1), '/+$', '') AS same_without_ext,
  regexp_matches(url, '^https?://[^?#]*/(en|de|es|fr)/') = false AS same_as_other_lang
FROM pages""")
def canonical_mismatch(t):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        U.same_page(url, F.concat(F.replace(url, F.lit(".html"), F.lit("")), F.lit("#x"))).alias("same_without_ext"),
        U.same_page(url, F.regexp_replace(url, "/(en|de|es|fr)/", "/xx/")).alias("same_as_other_lang"))


_IP = """CASE WHEN event_id % 11 = 0 THEN concat('2001:db8::', CAST(event_id AS STRING))
  WHEN event_id % 13 = 0 THEN '' ELSE concat('10.', CAST(user_id % 200 AS STRING), '.',
  CAST(event_id % 7 AS STRING), '.', CAST(event_id % 250 AS STRING)) END"""


@query("subnets", f"""
SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN ''
  ELSE concat('10.', CAST(user_id % 200 AS STRING), '.', CAST(event_id % 7 AS STRING), '.0/24') END AS subnet,
  count(*) AS hosts FROM events GROUP BY 1""")
def subnets(t):
    return t.events.selectExpr(f"{_IP} AS ip").groupBy(
        U.subnet24(F.col("ip")).alias("subnet")).agg(F.count("*").alias("hosts"))


_CODE = "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(190 + (event_id * 37) % 420 AS INT) END"
_VERDICT_SQL = """CASE WHEN code IS NULL THEN 'ERROR' WHEN code BETWEEN 200 AND 299 OR code IN (300, 304) THEN 'LIVE'
  WHEN code IN (301, 308) THEN 'REDIRECT_PERM' WHEN code IN (302, 303, 307) THEN 'REDIRECT_TEMP'
  WHEN code IN (401, 403) THEN 'BLOCKED' WHEN code = 410 THEN 'GONE' WHEN code = 429 THEN 'RATE_LIMITED'
  WHEN code BETWEEN 400 AND 499 THEN 'DEAD' WHEN code BETWEEN 500 AND 599 THEN 'SERVER_ERROR' ELSE 'ERROR' END"""
STATUS_GROUP_SQL = """CASE WHEN {v} = 'LIVE' THEN '200' WHEN {v} LIKE 'REDIRECT%' THEN '3xx'
  WHEN {v} IN ('DEAD', 'GONE') THEN '404' WHEN {v} = 'SERVER_ERROR' THEN '5xx'
  WHEN {v} IN ('BLOCKED', 'RATE_LIMITED') THEN 'blocked' WHEN {v} = 'DNS_ERROR' THEN 'dns'
  WHEN {v} = 'SSL_ERROR' THEN 'tls' ELSE 'error' END"""


@query("status_classes", f"""
WITH c AS (SELECT {_CODE} AS code FROM events), v AS (SELECT code, {_VERDICT_SQL} AS verdict FROM c)
SELECT code, verdict, {STATUS_GROUP_SQL.format(v='verdict')} AS status_group, count(*) AS n FROM v GROUP BY ALL""")
def status_classes(t):
    codes = t.events.selectExpr(f"{_CODE} AS code").withColumn("verdict", S.status_verdict(F.col("code")))
    return codes.groupBy("code", "verdict", S.status_group(F.col("verdict")).alias("status_group")).agg(
        F.count("*").alias("n"))


_ERRORS = ["ConnectionError|[Errno -2] Name or service not known", "SSLError|bad handshake",
           "ConnectionError|certificate verify failed: expired", "ConnectionError|Connection refused",
           "ReadTimeout|read timed out (20s)", "TooManyRedirects|Exceeded 30 redirects",
           "ConnectionError|Connection aborted. RemoteDisconnected", "ChunkedEncodingError|broken body (x)"]
_RAW_ERROR = "CASE CAST(event_id % 8 AS INT) " + " ".join(
    f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ERRORS)) + " END"


@query("error_classes", """
WITH e AS (SELECT CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'DNS: domain does not resolve'
  WHEN 1 THEN 'SSL certificate error' WHEN 2 THEN 'SSL certificate error' WHEN 3 THEN 'connection refused'
  WHEN 4 THEN 'timeout' WHEN 5 THEN 'too many redirects (redirect loop)'
  WHEN 6 THEN 'connection aborted by server' ELSE 'ChunkedEncodingError: broken body' END AS error FROM events)
SELECT error, CASE WHEN error LIKE 'DNS%' THEN 'DNS_ERROR' WHEN error LIKE 'SSL%' THEN 'SSL_ERROR'
  ELSE 'ERROR' END AS verdict, count(*) AS n FROM e GROUP BY ALL""")
def error_classes(t):
    parts = F.split("raw", r"\|")
    errors = t.events.selectExpr(f"{_RAW_ERROR} AS raw").select(
        S.short_error(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("error"))
    return errors.groupBy("error", S.error_verdict(F.col("error")).alias("verdict")).agg(F.count("*").alias("n"))


URL_RULES = keyword_rules([
    ("shops", "utm_source"), ("shops", "page="), ("blogs", "blog."), ("blogs", "/es/"), ("mobile", "m.th"),
    ("mobile", "html"), ("farms", "spam-farm"), ("farms", "cheap-pills")])
_URL_HITS = ", ".join(
    f"CASE WHEN contains(lower(url), '{r.word}') THEN '{{}}' END".format(r.word) for r in URL_RULES)
_URL_CATS = ", ".join(
    f"CASE WHEN contains(lower(url), '{r.word}') THEN '{r.category}' END" for r in URL_RULES)


@query("url_spam", f"""
SELECT page_id,
  array_to_string(list_sort(list_distinct(list_filter([{_URL_CATS}], lambda x: x IS NOT NULL))), ', ') AS url_spam_categories,
  array_to_string(list_sort(list_distinct(list_filter([{_URL_HITS}], lambda x: x IS NOT NULL))), ', ') AS url_spam_keywords
FROM pages""")
def url_spam(t):
    return scan_urls(t.pages.select("page_id", "url"), URL_RULES).drop("url")


_CELL = """CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN concat(CAST(p_size AS STRING), '%')
  WHEN 1 THEN '1,234' WHEN 2 THEN 'N/A' WHEN 3 THEN 'error' WHEN 4 THEN concat('DA ', CAST(p_size AS STRING), '.5')
  WHEN 5 THEN '--' WHEN 6 THEN concat('-', CAST(p_size AS STRING)) WHEN 7 THEN '' ELSE 'none yet' END"""


@query("lenient_numbers", """
SELECT p_partkey, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN 1234.0
  WHEN 4 THEN p_size + 0.5 WHEN 6 THEN CAST(-p_size AS DOUBLE) END AS number FROM part""")
def lenient_numbers(t):
    return t.part.selectExpr("p_partkey", f"{_CELL} AS cell").select(
        "p_partkey", X.lenient_number(F.col("cell")).alias("number"))


_HOST_CELL = """CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat(' "Site', {k}, '.COM" ')
  WHEN 1 THEN concat('https://site', {k}, '.com/x y') WHEN 2 THEN concat('http://.site', {k}, '.com:80/p')
  WHEN 3 THEN 'see notes' WHEN 4 THEN concat('site', {k}) ELSE concat('site', {k}, '.co.uk/path') END""".format(k=_KEY)


@query("host_cells", f"""
SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN concat('site', {_KEY}, '.com') WHEN 1 THEN ''
  WHEN 2 THEN concat('site', {_KEY}, '.com') WHEN 3 THEN '' WHEN 4 THEN concat('site', {_KEY})
  ELSE concat('site', {_KEY}, '.co.uk') END AS host,
  c_custkey % 6 IN (2, 5) AS looks_like_domain FROM customer""")
def host_cells(t):
    cells = t.customer.selectExpr("c_custkey", f"{_HOST_CELL} AS cell")
    return cells.select("c_custkey", X.clean_host_cell(F.col("cell")).alias("host"),
                        X.looks_like_domain(F.replace("cell", F.lit(":80"), F.lit(""))).alias("looks_like_domain"))


@query("shapes", r"""
WITH w AS (SELECT p_partkey, list_sort(list_distinct(list_filter(
    string_split_regex(regexp_replace(lower(concat('The Best ', p_name, ' & ', p_type, ' 7 page')), '[^a-z ]+', ' ', 'g'), ' +'),
    lambda x: length(x) > 2 AND x NOT IN ('the','a','an','and','or','of','for','to','in','on','best','top','home','page',
      'site','website','online','free','com','net','org','info','www','welcome')))) AS words,
    trim(regexp_replace(regexp_replace(lower(concat(p_brand, ' ', p_type, ' 5.', CAST(p_size AS STRING))), '[0-9.]+', ' ', 'g'),
      '\s+', ' ', 'g')) AS generator FROM part)
SELECT p_partkey, array_to_string(words[1:3], ' ') AS title_shape, generator AS generator_shape FROM w""")
def shapes(t):
    parts = t.part.selectExpr(
        "p_partkey", "concat('The Best ', p_name, ' & ', p_type, ' 7 page') AS title",
        "concat(p_brand, ' ', p_type, ' 5.', CAST(p_size AS STRING)) AS generator")
    return parts.select("p_partkey", X.title_shape(F.col("title")).alias("title_shape"),
                        X.generator_shape(F.col("generator")).alias("generator_shape"))
