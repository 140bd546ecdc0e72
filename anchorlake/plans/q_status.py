"""Queries on fetch logs, redirects, robots files, hosting, archives and pacing."""

from pyspark.sql import functions as F

from anchorlake.config import AuditConfig
from anchorlake.operators import fetchlog, links, observations, pacing, pages
from anchorlake.plans.q_pages import _ANCHOR_TEXTS, _FOUND, _TITLE, CFG
from anchorlake.plans.q_urls import STATUS_GROUP_SQL, _VERDICT_SQL
from anchorlake.plans.registry import query
from anchorlake.session import spread

# events as a log of attempts: a user is a host, an event type a rung of the ladder
_URL = """concat(CASE WHEN user_id % 4 = 0 THEN 'http' ELSE 'https' END, '://h', CAST(user_id AS STRING),
  '.example.com/p', CAST(event_id % 3 AS STRING))"""
_LABEL = """CASE WHEN event_type IN ('view', 'signup') THEN 'https' WHEN event_type = 'click' THEN 'https-noverify'
  WHEN event_type = 'purchase' THEN 'http' ELSE CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'https'
  WHEN 1 THEN 'https-noverify' ELSE 'http' END END"""
_STATUS = """CASE WHEN event_type = 'error' OR user_id % 9 = 0 THEN NULL
  ELSE CAST(200 + (event_id * 7) % 320 AS INT) END"""
_ERROR = """CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'timeout' WHEN 1 THEN 'SSL certificate error'
  WHEN 2 THEN 'DNS: domain does not resolve' ELSE 'connection refused' END"""
_LOG = f"SELECT event_id AS seq, {_URL} AS url, {_LABEL} AS label, {_STATUS} AS status, {_ERROR} AS error FROM events"
_DNS_HOST = "concat(CASE WHEN user_id % 5 = 4 THEN 'unasked' ELSE 'h' END, CAST(user_id AS STRING), '.example.com')"
_DNS = f"""SELECT DISTINCT {_DNS_HOST} AS host, user_id % 3 <> 0 AS resolved,
  concat('10.0.', CAST(user_id % 256 AS STRING), '.1') AS ip FROM events"""


def _attempts(t):
    return t.events.selectExpr("event_id AS seq", f"{_URL} AS url", f"{_LABEL} AS label",
                               f"{_STATUS} AS status", f"{_ERROR} AS error")


def _dns(t):
    return t.events.selectExpr(
        f"{_DNS_HOST} AS host", "user_id % 3 <> 0 AS resolved",
        "CASE WHEN user_id % 3 <> 0 THEN array(concat('10.0.', CAST(user_id % 256 AS STRING), '.1'), '::1') "
        "ELSE CAST(array() AS array<string>) END AS ips").distinct()


_RUNG = """CASE WHEN url LIKE 'http://%' THEN CASE label WHEN 'http' THEN 1 WHEN 'https' THEN 2 ELSE 3 END
  ELSE CASE label WHEN 'https' THEN 1 WHEN 'https-noverify' THEN 2 ELSE 3 END END"""
_RESOLVED = f"""l AS ({_LOG}), r AS (SELECT *, {_RUNG} AS rung FROM l),
  w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rung, seq) AS k FROM r WHERE status IS NOT NULL),
  win AS (SELECT url, label, rung, status AS code FROM w WHERE k = 1),
  e AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rung, seq) AS k FROM r WHERE status IS NULL),
  tried AS (SELECT DISTINCT r.url, r.label, r.rung FROM r LEFT JOIN win USING (url) WHERE win.url IS NULL OR r.rung <= win.rung),
  trail AS (SELECT tried.url, string_agg(CASE WHEN tried.rung = win.rung THEN tried.label
    ELSE concat(tried.label, ':fail') END, ' -> ' ORDER BY tried.rung) AS attempts
    FROM tried LEFT JOIN win ON win.url = tried.url GROUP BY 1),
  dns AS ({_DNS}),
  s AS (SELECT trail.url, trail.attempts, win.label, win.code, win.code IS NULL AS failed,
      coalesce(NOT dns.resolved, false) AS said_no, CASE WHEN dns.resolved THEN dns.ip ELSE '' END AS ip,
      e.error, {_VERDICT_SQL.replace('code', 'win.code')} AS v
    FROM trail LEFT JOIN win USING (url) LEFT JOIN e ON e.url = trail.url AND e.k = 1
    LEFT JOIN dns ON dns.host = regexp_extract(trail.url, '://([^/]+)', 1)),
  status AS (SELECT *, CASE WHEN failed AND said_no THEN 'DNS_ERROR'
    WHEN failed THEN CASE WHEN error LIKE 'DNS%' THEN 'DNS_ERROR' WHEN error LIKE 'SSL%' THEN 'SSL_ERROR' ELSE 'ERROR' END
    ELSE v END AS status_verdict FROM s)"""


@query("status_resolution", f"""WITH {_RESOLVED}
SELECT url, code AS status_code, status_verdict, coalesce(label, '') AS scheme_used, attempts,
  coalesce(label = 'https-noverify', false) AS tls_invalid,
  coalesce(label = 'http', false) AND url LIKE 'https://%' AS https_unavailable,
  CASE WHEN label IS NULL THEN url LIKE 'https://%' ELSE label <> 'http' END AS https,
  said_no AS dns_said_no, NOT failed AND said_no AS dns_was_wrong, coalesce(ip, '') AS ip,
  CASE WHEN failed AND NOT said_no THEN error ELSE '' END AS error
FROM status""")
def status_resolution(t):
    out = fetchlog.resolve_attempts(_attempts(t), _dns(t))
    return out.select(
        "url", "status_code", "status_verdict", "scheme_used", "attempts", "tls_invalid", "https_unavailable",
        "https", "dns_said_no", (F.col("dns_note") != "").alias("dns_was_wrong"), F.coalesce("ip", F.lit("")).alias("ip"),
        F.when(F.col("status_code").isNull() & ~F.col("dns_said_no"), F.col("error")).otherwise("").alias("error"))


@query("status_histogram", f"""WITH {_RESOLVED}
SELECT {STATUS_GROUP_SQL.format(v='status_verdict')} AS status_group, count(*) AS links FROM status GROUP BY 1""")
def status_histogram(t):
    from anchorlake.functions.status import status_group

    return fetchlog.resolve_attempts(_attempts(t), _dns(t)).groupBy(
        status_group(F.col("status_verdict")).alias("status_group")).agg(F.count("*").alias("links"))


@query("dns_stats", f"""WITH dns AS ({_DNS})
SELECT count(*) AS hosts, count(*) FILTER (WHERE resolved) AS resolved,
  count(*) FILTER (WHERE NOT resolved) AS unresolved FROM dns""")
def dns_stats(t):
    return fetchlog.dns_stats(_dns(t))


# orders as redirects: one third of all chains run into the same landing page
_HOPS = """SELECT concat('https://s', CAST(o_orderkey % 5 AS STRING), '.com/', CAST(o_orderkey AS STRING)) AS from_url,
  CASE WHEN o_orderkey % 29 = 0 OR o_orderkey + 1 >= (SELECT count(*) FROM orders) THEN NULL
    WHEN o_orderkey % 29 BETWEEN 1 AND 9 THEN 'https://s0.com/0'
    WHEN o_orderkey % 29 = 28 AND o_orderkey % 3 = 0
      THEN concat('https://s', CAST((o_orderkey - 1) % 5 AS STRING), '.com/', CAST(o_orderkey - 1 AS STRING))
    ELSE concat('https://s', CAST((o_orderkey + 1) % 5 AS STRING), '.com/', CAST(o_orderkey + 1 AS STRING)) END AS to_url,
  CASE WHEN o_orderkey % 29 = 0 THEN 200 ELSE 301 + CAST(o_orderkey % 2 AS INT) END AS status FROM orders"""


@query("redirect_chains", f"""
WITH RECURSIVE h AS ({_HOPS}), p AS (
  SELECT from_url AS url, from_url AS spot, 0 AS n, from_url AS chain FROM h
  UNION ALL SELECT p.url, h.to_url, p.n + 1, concat(p.chain, ' -> ', h.to_url) FROM p JOIN h ON h.from_url = p.spot
    WHERE h.to_url IS NOT NULL AND p.n < 11),
  e AS (SELECT url, max(n) AS hops, arg_max(spot, n) AS landed, arg_max(chain, n) AS chain FROM p GROUP BY 1)
SELECT e.url, h.status AS status_code, CASE WHEN hops > 10 THEN h.to_url ELSE landed END AS final_url,
  CASE WHEN hops <= 10 THEN f.status END AS final_status, CASE WHEN hops > 10 THEN 0 ELSE hops END AS redirect_hops,
  CASE WHEN hops BETWEEN 1 AND 10 THEN chain ELSE '' END AS redirect_chain, hops > 10 AS endless,
  hops BETWEEN 1 AND 10 AND regexp_extract(e.url, '//([^/]+)', 1) <> regexp_extract(landed, '//([^/]+)', 1) AS redirect_offsite,
  CASE WHEN hops BETWEEN 1 AND 10 AND regexp_extract(e.url, '//([^/]+)', 1) <> regexp_extract(landed, '//([^/]+)', 1)
    THEN regexp_extract(landed, '//([^/]+)', 1) ELSE '' END AS redirect_target_domain
FROM e JOIN h ON h.from_url = e.url LEFT JOIN h f ON f.from_url = e.landed""")
def redirect_chains(t):
    orders = t.orders
    orders.createOrReplaceTempView("orders_for_hops")
    hops = t.spark.sql(_HOPS.replace("FROM orders)", "FROM orders_for_hops)").replace(
        "AS status FROM orders", "AS status FROM orders_for_hops"))
    return fetchlog.resolve_redirects(hops).select(
        "url", "status_code", "final_url", "final_status", "redirect_hops", "redirect_chain",
        (F.col("redirect_error") != "").alias("endless"), "redirect_offsite", "redirect_target_domain")


_PROBED = """SELECT o_orderkey, concat('https://', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'blog.' END, 'c',
    CAST(o_custkey AS STRING), '.com', CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE concat('/', CAST(o_orderkey AS STRING)) END) AS url,
  concat('c', CAST(o_custkey AS STRING), '.com') AS registered,
  CASE o_orderstatus WHEN 'F' THEN 'DEAD' WHEN 'O' THEN 'LIVE' ELSE 'SERVER_ERROR' END AS status_verdict,
  CASE o_orderstatus WHEN 'F' THEN 404 WHEN 'O' THEN 200 ELSE 503 END AS status_code FROM orders"""


@query("root_probe", f"""
WITH r AS ({_PROBED}), roots AS (SELECT rtrim(url, '/') AS root, min(status_verdict) AS root_verdict FROM r
  WHERE regexp_matches(url, '^https://[^/]+/?$') GROUP BY 1)
SELECT o_orderkey, status_verdict, CASE WHEN status_verdict <> 'LIVE' THEN root_verdict END AS root_verdict,
  CASE WHEN status_verdict <> 'LIVE' THEN registered ELSE '' END AS root_domain,
  status_verdict <> 'LIVE' AND coalesce(root_verdict = 'LIVE', false) AS only_this_page
FROM r LEFT JOIN roots ON roots.root = concat('https://', registered)""")
def root_probe(t):
    rows = t.orders.selectExpr(*_split_select(_PROBED))
    out = fetchlog.with_root_probe(rows)
    return out.select("o_orderkey", "status_verdict", "root_verdict", "root_domain",
                      F.col("root_note").contains("still answers").alias("only_this_page"))


def _split_select(sql: str) -> list[str]:
    """The select list of a one-table SELECT, for ``selectExpr``."""
    body = sql.strip()[len("SELECT "):].rsplit(" FROM ", 1)[0]
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch in "([") - (ch in ")]")
        if ch == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in parts + [body[start:]]]


# one robots file per site, rules depending on the site's name
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("robots_verdict", f"""
WITH p AS (SELECT page_id, {_ORIGIN} AS origin, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN length(origin) % 5 = 0 THEN false
  WHEN length(origin) % 5 = 1 THEN CASE WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en/%' THEN false
    WHEN path LIKE '/fr/%' THEN true ELSE false END
  WHEN length(origin) % 5 = 2 THEN path LIKE '/de/%' OR path LIKE '/en/2%'
  WHEN length(origin) % 5 = 3 THEN false ELSE true END AS robots_blocked FROM p""")
def robots_verdict(t):
    """Site names of five lengths stand for: no file, general rules, own rules, an error page, all closed."""
    urls = t.pages.select("page_id", "url")
    n = "CAST(length(origin) % 5 AS INT)"
    robots = urls.selectExpr(f"{_ORIGIN} AS origin").distinct().selectExpr(
        "origin", f"CASE WHEN {n} = 3 THEN 404 ELSE 200 END AS status",
        f"""CASE {n} WHEN 1 THEN 'User-agent: *\nDisallow: /en/1\nAllow: /%65n/ # fine\nDisallow: /fr\n\nUser-agent: other\nDisallow: /'
          WHEN 2 THEN 'User-Agent: *\nDisallow: /\n\nUser-agent: GoogleBot\nUser-agent: x\nDisallow: /de/\nDisallow: /en/2\n'
          WHEN 4 THEN 'User-agent: *\nDisallow: /\nAllow: /en/' WHEN 3 THEN 'User-agent: *\nDisallow: /' ELSE '' END AS body""")
    return observations.robots_verdict(urls, robots).select("page_id", "robots_blocked")


# suppliers as RDAP records
_ORG = """CASE CAST(s_suppkey % 7 AS INT) WHEN 0 THEN 'Cloudflare, Inc.' WHEN 1 THEN 'Hetzner Online GmbH'
  WHEN 2 THEN 'OVH on Amazon AWS' WHEN 3 THEN 'Smith Family Network' WHEN 4 THEN 'a2 hosting ltd' ELSE '' END"""
_NET = "CASE WHEN s_suppkey % 3 = 0 THEN 'VULTR-NET' ELSE concat('NET-', CAST(s_suppkey AS STRING)) END"


@query("hosting_class", f"""
WITH s AS (SELECT s_suppkey, {_ORG} AS org, {_NET} AS name FROM supplier),
  l AS (SELECT *, lower(CASE WHEN org <> '' THEN org ELSE name END) AS label FROM s)
SELECT s_suppkey, org AS net_org, name AS net_name,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('10.', s_suppkey, '.0.0/16') ELSE concat('10.', s_suppkey, '.0.0-10.', s_suppkey, '.0.255') END AS net_range,
  regexp_matches(label, 'cloudflare|a2 hosting') AS shared_host, regexp_matches(label, 'hetzner|ovh|vultr') AS vps_host
FROM l""")
def hosting_class(t):
    payload = f"""concat('{{"name": "', {_NET}, '", "handle": "H', s_suppkey, '", "entities": [',
      '{{"roles": ["abuse"], "vcardArray": ["vcard", [["fn", {{}}, "text", "Abuse Desk"]]]}}, ',
      '{{"roles": ["Registrant"], "vcardArray": ["vcard", [["version", {{}}, "text", "4.0"], ["fn", {{}}, "text", "', {_ORG}, '"]]]}}], ',
      CASE WHEN s_suppkey % 2 = 0 THEN concat('"cidr0_cidrs": [{{"v4prefix": "10.', s_suppkey, '.0.0", "length": 16}}]}}')
      ELSE concat('"startAddress": "10.', s_suppkey, '.0.0", "endAddress": "10.', s_suppkey, '.0.255"}}') END)"""
    rdap = t.supplier.selectExpr("s_suppkey", f"{payload} AS payload")
    return observations.hosting_from_rdap(rdap).select(
        "s_suppkey", "net_org", "net_name", "net_range", "shared_host", "vps_host")


@query("hosting_stats", f"""
WITH s AS (SELECT {_ORG} AS org, {_NET} AS name FROM supplier),
  l AS (SELECT *, lower(CASE WHEN org <> '' THEN org ELSE name END) AS label FROM s)
SELECT count(*) AS ips, count(*) AS identified, count(*) FILTER (WHERE regexp_matches(label, 'cloudflare|a2 hosting')) AS shared_hosts,
  count(*) FILTER (WHERE regexp_matches(label, 'hetzner|ovh|vultr')) AS vps_hosts FROM l""")
def hosting_stats(t):
    named = t.supplier.selectExpr(f"{_ORG} AS net_org", f"{_NET} AS net_name")
    label = F.when(F.col("net_org") != "", F.col("net_org")).otherwise(F.col("net_name"))
    shared, vps = observations.hosting_class(label)
    return observations.hosting_stats(named.withColumn("shared_host", shared).withColumn("vps_host", vps))


_ROW_IP = """CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN concat('2001:db8::', CAST(o_custkey AS STRING)) WHEN 1 THEN NULL
  WHEN 2 THEN ' 10.1.0.1 ' WHEN 3 THEN '10.1.0.1' ELSE concat('10.', CAST(o_custkey % 120 AS STRING), '.0.1') END"""


@query("hosting_rows", f"""
WITH h AS (SELECT concat('10.', s_suppkey, '.0.1') AS ip, {_ORG} AS org, {_NET} AS name FROM supplier),
  l AS (SELECT *, lower(CASE WHEN org <> '' THEN org ELSE name END) AS label FROM h),
  r AS (SELECT o_orderkey, trim(coalesce({_ROW_IP}, '')) AS ip FROM orders)
SELECT o_orderkey, coalesce(l.org, '') AS net_org, coalesce(l.name, '') AS net_name,
  coalesce(regexp_matches(label, 'cloudflare|a2 hosting'), false) AS shared_host,
  coalesce(regexp_matches(label, 'hetzner|ovh|vultr'), false) AS vps_host
FROM r LEFT JOIN l ON r.ip = l.ip AND r.ip NOT LIKE '%:%'""")
def hosting_rows(t):
    """Orders as rows, two sevenths of them on one address, with the hosting of suppliers; each address is known twice."""
    known = t.supplier.selectExpr("concat('10.', s_suppkey, '.0.1') AS ip", f"{_ORG} AS net_org", f"{_NET} AS net_name",
                                  "'' AS net_handle", "'' AS net_range")
    label = F.when(F.col("net_org") != "", F.col("net_org")).otherwise(F.col("net_name"))
    shared, vps = observations.hosting_class(label)
    hosting = known.withColumn("shared_host", shared).withColumn("vps_host", vps)
    later = hosting.withColumns({"net_org": F.lit("zz later"), "shared_host": F.lit(True)})
    rows = spread(t.orders).selectExpr("o_orderkey", f"{_ROW_IP} AS ip")
    return observations.attach_hosting(rows, later.unionByName(hosting)).select(
        "o_orderkey", "net_org", "net_name", "shared_host", "vps_host")


@query("archive_recovery", f"""
WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'DEAD' WHEN 1 THEN 'GONE' WHEN 2 THEN 'DNS_ERROR' ELSE 'LIVE' END <> 'LIVE'
    AND page_id % 5 <> 0 AS known, {_FOUND} AND page_id % 3 = 0 AS found, {_TITLE} AS title, {_ANCHOR_TEXTS} AS anchors FROM pages)
SELECT page_id, known AS archive_available,
  CASE WHEN known THEN concat('2023-0', 1 + page_id % 9, '-15') ELSE '' END AS archive_date,
  CASE WHEN known THEN title ELSE '' END AS archive_title, known AND found AS archive_link_found,
  CASE WHEN known AND found THEN anchors ELSE '' END AS archive_anchor FROM r""")
def archive_recovery(t):
    """Three snapshots per page, the newest with links on every third page only; all are parsed.

    Some pages share a URL; each is filed under a URL of its own, with its id as fragment.
    """
    filed = "concat(url, '#', CAST(page_id AS STRING)) AS url"
    rows = t.pages.selectExpr("page_id", filed, """CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'DEAD' WHEN 1 THEN 'GONE'
      WHEN 2 THEN 'DNS_ERROR' ELSE 'LIVE' END AS status_verdict""")
    bare = "regexp_replace(html, '<a href=\"[^\"]*\">[^<]*</a>', '')"
    copies = f"""explode(array(struct('20220115000000' AS ts, {bare} AS html),
      struct(concat('20230', CAST(1 + page_id % 9 AS STRING), '15120000') AS ts, CASE WHEN page_id % 3 = 0 THEN html ELSE {bare} END AS html),
      struct('20211231235959' AS ts, html AS html))) AS s"""
    snaps = spread(t.pages).selectExpr("page_id", filed, copies).select("page_id", "url", "s.ts", "s.html")
    seen = links.with_link_features(pages.parse_pages(snaps), CFG).select(
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("unlinked:"), "url")).otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("https://archive.example/"), "page_id", F.lit("/"), "ts").alias("snapshot_url"), "ts",
        F.col("title").alias("page_title"), "link_found", "anchor_texts")
    return observations.recover_from_archive(rows, seen).select(
        "page_id", "archive_available", "archive_date", "archive_title", "archive_link_found", "archive_anchor")


# responses: a user is a host
PACE_CFG = AuditConfig(delay_per_host=1.0, max_delay_per_host=15.0, backoff_recover=0.85)
_RESPONSE = """CASE WHEN user_id % 3 = 0 THEN 'hot.example' ELSE concat('h', CAST(user_id AS STRING)) END AS host,
  CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 503 ELSE 404 END
    WHEN 'signup' THEN NULL ELSE 200 END AS status,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN CAST(event_id % 23 AS DOUBLE) END AS retry_after"""


def _responses(t):
    return t.events.selectExpr("event_id AS seq", "ts", *[p for p in _split_select(f"SELECT {_RESPONSE} FROM x")])


def pacing_sql(select: str) -> str:
    return f"""
WITH r AS (SELECT event_id, ts, {_RESPONSE} FROM events),
  g AS (SELECT host, list({{'s': coalesce(status, 0)::DOUBLE, 'r': coalesce(retry_after, 0)}} ORDER BY ts, event_id) AS l,
    count(*) AS responses, count(*) FILTER (WHERE status IN (429, 503)) AS pushbacks FROM r GROUP BY 1),
  f AS (SELECT host, responses, pushbacks, list_reduce(list_transform(l, lambda x: {{'d': x.s, 'p': x.r}}), lambda acc, x:
      {{'d': CASE WHEN x.d IN (429, 503) THEN least(greatest(acc.d * 2, 2.0, least(x.p, 15.0)), 15.0)
               WHEN x.d BETWEEN 200 AND 399 AND acc.d > 1.0 THEN greatest(1.0, acc.d * 0.85) ELSE acc.d END,
        'p': greatest(acc.p, CASE WHEN x.d IN (429, 503) THEN least(greatest(acc.d * 2, 2.0, least(x.p, 15.0)), 15.0)
               WHEN x.d BETWEEN 200 AND 399 AND acc.d > 1.0 AND acc.d * 0.85 > 1.0 THEN acc.d * 0.85 ELSE 0.0 END)}},
      {{'d': 1.0::DOUBLE, 'p': 0.0::DOUBLE}}) AS s FROM g),
  paced AS (SELECT host, s.d AS delay, s.p AS peak, pushbacks, responses FROM f)
{select}"""


@query("host_pacing", pacing_sql("""SELECT host, round(delay, 6) AS delay, round(peak, 6) AS peak,
  pushbacks, responses FROM paced"""))
def host_pacing(t):
    paced = pacing.pacing_batch(_responses(t), PACE_CFG)
    return paced.select("host", F.round("delay", 6).alias("delay"), F.round("peak", 6).alias("peak"),
                        "pushbacks", "responses")


@query("pacing_stats", pacing_sql("""SELECT sum(pushbacks)::BIGINT AS pushback_responses,
  count(*) FILTER (WHERE peak > 0) AS throttled_hosts, round_even(greatest(max(peak), 1.0), 1) AS worst_delay FROM paced"""))
def pacing_stats(t):
    return pacing.pacing_stats(pacing.pacing_batch(_responses(t), PACE_CFG), PACE_CFG)


@query("slowest_hosts", pacing_sql("""SELECT host, round(peak, 6) AS peak FROM paced WHERE peak > 0
  ORDER BY paced.peak DESC, host LIMIT 8"""))
def slowest_hosts(t):
    return pacing.slowest_hosts(pacing.pacing_batch(_responses(t), PACE_CFG)).select(
        "host", F.round("peak", 6).alias("peak"))
