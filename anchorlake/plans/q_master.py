"""Queries on the master list, metrics, run history, disavow sets and input lists."""

from pyspark.sql import functions as F

from anchorlake.operators import master, metrics, report
from anchorlake.plans.q_status import _split_select
from anchorlake.plans.registry import query
from anchorlake.session import spread
from anchorlake.sources import readers, writers

AS_OF = "2024-06-30 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp")


# customers as the master list; some hosts are subdomains, so a domain can be listed twice
_MASTER = f"""SELECT CASE WHEN c_custkey % 4 = 1 THEN concat('blog.m', CAST(c_custkey - 1 AS STRING), '.com')
    WHEN c_custkey % 6 = 2 THEN concat('unlinked', CAST(c_custkey AS STRING), '.com')
    ELSE concat('m', CAST(c_custkey AS STRING), '.com') END AS host,
  CASE WHEN c_custkey % 4 = 1 THEN concat('m', CAST(c_custkey - 1 AS STRING), '.com')
    WHEN c_custkey % 6 = 2 THEN concat('unlinked', CAST(c_custkey AS STRING), '.com')
    ELSE concat('m', CAST(c_custkey AS STRING), '.com') END AS registered,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) END AS da,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS DOUBLE) END AS spam_score,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Spammy' WHEN 'MACHINERY' THEN 'No Issues' WHEN 'HOUSEHOLD' THEN '' END AS status,
  'sheet' AS source, c_mktsegment AS notes,
  CAST('2020-01-01 00:00:00' AS TIMESTAMP) AS first_seen,
  CASE WHEN c_custkey % 3 = 0 THEN CAST('2020-05-01 00:00:00' AS TIMESTAMP) ELSE CAST('2024-06-15 00:00:00' AS TIMESTAMP) END AS last_seen
  FROM customer"""


def _master(t):
    return t.customer.selectExpr(*_split_select(_MASTER))


_LINKS = """SELECT o_orderkey, concat('https://', CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'blog.' END,
  'm', CAST(o_custkey AS STRING), '.com/', CAST(o_orderkey AS STRING)) AS url,
  concat(CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'blog.' END, 'm', CAST(o_custkey AS STRING), '.com') AS host,
  concat('m', CAST(o_custkey AS STRING), '.com') AS registered FROM orders"""


def _links(t):
    return t.orders.selectExpr(*_split_select(_LINKS))


@query("master_lookup", f"""
WITH m AS ({_MASTER}), l AS ({_LINKS}),
  d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY registered ORDER BY length(host), host) = 1)
SELECT o_orderkey, coalesce(a.host, b.host, d.host) IS NOT NULL AS in_master,
  CASE WHEN a.host IS NOT NULL THEN 'host' WHEN coalesce(b.host, d.host) IS NOT NULL THEN 'registered' ELSE '' END AS master_match,
  coalesce(a.host, b.host, d.host, '') AS master_host,
  CASE WHEN a.host IS NOT NULL THEN coalesce(a.status, '') WHEN b.host IS NOT NULL THEN coalesce(b.status, '') ELSE coalesce(d.status, '') END AS master_status,
  CASE WHEN a.host IS NOT NULL THEN a.da WHEN b.host IS NOT NULL THEN b.da ELSE d.da END AS master_da,
  CASE WHEN coalesce(a.host, b.host, d.host) IS NOT NULL THEN '2020-01-01' ELSE '' END AS master_first_seen
FROM l LEFT JOIN m a ON a.host = l.host LEFT JOIN m b ON b.host = l.registered LEFT JOIN d ON d.registered = l.registered""")
def master_lookup(t):
    links = _links(t)
    return master.master_lookup(links, _master(t), links.select("host", "registered")).select(
        "o_orderkey", "in_master", "master_match", "master_host", "master_status", "master_da", "master_first_seen")


@query("fresh_metrics", f"""
WITH m AS ({_MASTER}), l AS ({_LINKS})
SELECT registered, da, spam_score, 'master-sheet' AS source, '2024-06-15' AS recorded FROM m
WHERE (da IS NOT NULL OR spam_score IS NOT NULL) AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  AND registered IN (SELECT registered FROM l)
QUALIFY row_number() OVER (PARTITION BY registered ORDER BY length(host), host) = 1""")
def fresh_metrics(t):
    return master.fresh_metrics(_links(t), _master(t), now(), 30)


@query("stale_metrics", f"""
WITH m AS ({_MASTER}), l AS ({_LINKS}) SELECT DISTINCT registered FROM m
WHERE last_seen < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND registered IN (SELECT registered FROM l)""")
def stale_metrics(t):
    return master.stale_metrics(_links(t), _master(t), now(), 30)


# suppliers and parts stand for a metric cache and for provider results
_CACHE = """SELECT concat('m', CAST(s_suppkey * 7 AS STRING), '.com') AS registered, CAST(s_suppkey % 80 AS DOUBLE) AS da,
  CAST(s_nationkey AS DOUBLE) AS pa, 'cache' AS source,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN CAST('2024-06-20 00:00:00' AS TIMESTAMP)
    ELSE CAST('2024-05-01 00:00:00' AS TIMESTAMP) END AS fetched_at FROM supplier"""
_BOUGHT = """SELECT concat(CASE WHEN p_partkey % 5 = 4 THEN 'unlinked' ELSE 'm' END, CAST(p_partkey * 3 AS STRING), '.com') AS registered, CAST(p_size AS DOUBLE) AS da,
  CAST(p_partkey AS DOUBLE) AS backlinks, 'import:x.csv' AS source FROM part"""
_FRESH = f"""m AS ({_MASTER}), l AS ({_LINKS}), f AS (SELECT registered, da, spam_score FROM m
  WHERE (da IS NOT NULL OR spam_score IS NOT NULL) AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
  QUALIFY row_number() OVER (PARTITION BY registered ORDER BY length(host), host) = 1),
  c AS (SELECT * FROM ({_CACHE}) WHERE fetched_at IS NULL OR fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
  b AS ({_BOUGHT}), w AS (SELECT DISTINCT registered FROM l),
  x AS (SELECT w.registered,
    CASE WHEN f.registered IS NOT NULL THEN f.da WHEN c.registered IS NOT NULL THEN c.da ELSE b.da END AS da,
    CASE WHEN f.registered IS NOT NULL THEN NULL WHEN c.registered IS NOT NULL THEN c.pa END AS pa,
    CASE WHEN f.registered IS NOT NULL THEN f.spam_score END AS spam_score,
    CASE WHEN f.registered IS NOT NULL OR c.registered IS NOT NULL THEN NULL ELSE b.backlinks END AS backlinks,
    CASE WHEN f.registered IS NOT NULL THEN 'master-sheet' WHEN c.registered IS NOT NULL THEN 'cache'
      ELSE coalesce(b.source, '') END AS source
    FROM w LEFT JOIN f USING (registered) LEFT JOIN c USING (registered) LEFT JOIN b USING (registered))"""


def _resolved(t):
    links = _links(t)
    cache = master.fresh_cached_metrics(t.supplier.selectExpr(*_split_select(_CACHE)), 30, now())
    return metrics.resolve_metrics(links, [
        master.fresh_metrics(links, _master(t), now(), 30), cache,
        t.part.selectExpr(*_split_select(_BOUGHT))])


@query("metric_precedence", f"WITH {_FRESH} SELECT * FROM x")
def metric_precedence(t):
    return _resolved(t).select("registered", "da", "pa", "spam_score", "backlinks", "source")


@query("metric_attach", f"""WITH {_FRESH} SELECT o_orderkey, x.da, x.spam_score, x.source AS metrics_source
FROM l JOIN x USING (registered)""")
def metric_attach(t):
    links = _links(t)
    return metrics.attach_metrics(links, _resolved(t)).select("o_orderkey", "da", "spam_score", "metrics_source")


@query("metric_queue", f"""WITH {_FRESH}, q AS (SELECT DISTINCT registered FROM x WHERE da IS NULL)
SELECT registered, row_number() OVER (ORDER BY registered) AS position,
  CAST(floor((row_number() OVER (ORDER BY registered) - 1) / 100) AS BIGINT) + 1 AS batch FROM q""")
def metric_queue(t):
    return metrics.metric_queue(_links(t), _resolved(t), 100)


# suppliers' rows as an imported sheet, with duplicates and unusable cells
_SHEET = """SELECT CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN concat(' "M', CAST(l_partkey AS STRING), '.com" ')
    WHEN 1 THEN concat('http://m', CAST(l_partkey AS STRING), '.com/x') WHEN 2 THEN 'not a host'
    ELSE concat('m', CAST(l_partkey AS STRING), '.com') END AS host,
  CASE CAST(l_orderkey % 3 AS INT) WHEN 0 THEN 'N/A' ELSE concat(CAST(l_orderkey % 100 AS STRING), '%') END AS da,
  CASE CAST(l_orderkey % 4 AS INT) WHEN 0 THEN '' ELSE CAST(l_orderkey % 90 AS STRING) END AS spam_score,
  CASE l_returnflag WHEN 'A' THEN ' Spammy ' WHEN 'R' THEN '' ELSE 'No Issues' END AS status,
  CASE WHEN l_linenumber = 1 THEN concat('n', CAST(l_orderkey AS STRING)) ELSE ' ' END AS notes,
  l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS row_no FROM lineitem"""
_CLEAN_SHEET = f"""i AS ({_SHEET}), n AS (SELECT * FROM (SELECT lower(replace(replace(replace(trim(host), '"', ''), 'http://', ''), '/x', '')) AS host,
    CASE WHEN da = 'N/A' THEN NULL ELSE CAST(replace(da, '%', '') AS DOUBLE) END AS da,
    CASE WHEN spam_score = '' THEN NULL ELSE CAST(spam_score AS DOUBLE) END AS spam_score,
    trim(status) AS status, trim(notes) AS notes, row_no FROM i WHERE host <> 'not a host')
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY row_no) = 1)"""


def _sheet(t):
    cells = spread(t.lineitem).selectExpr(*_split_select(_SHEET))
    return cells, master.clean_sheet(cells, "new.csv")


_MERGED = f"""{_CLEAN_SHEET}, m AS ({_MASTER}),
  u AS (SELECT coalesce(m.host, n.host) AS host, coalesce(n.da, m.da) AS da, coalesce(n.spam_score, m.spam_score) AS spam_score,
    CASE WHEN coalesce(n.status, '') <> '' THEN n.status ELSE coalesce(m.status, '') END AS status,
    CASE WHEN coalesce(n.notes, '') <> '' THEN n.notes ELSE coalesce(m.notes, '') END AS notes,
    CASE WHEN n.host IS NOT NULL THEN 'new.csv' ELSE m.source END AS source,
    CASE WHEN m.host IS NOT NULL THEN '2020-01-01' ELSE '2024-06-30' END AS first_seen,
    CASE WHEN n.host IS NOT NULL THEN '2024-06-30' ELSE strftime(m.last_seen, '%Y-%m-%d') END AS last_seen,
    CASE WHEN n.host IS NULL THEN 'kept' WHEN m.host IS NULL THEN 'imported' ELSE 'updated' END AS change
    FROM m FULL JOIN n ON n.host = m.host)"""


@query("master_upsert", f"WITH {_MERGED} SELECT * FROM u")
def master_upsert(t):
    day = "yyyy-MM-dd"
    return master.master_upsert(_master(t), _sheet(t)[1], now()).select(
        "host", "da", "spam_score", "status", "notes", "source", F.date_format("first_seen", day).alias("first_seen"),
        F.date_format("last_seen", day).alias("last_seen"), "change")


@query("upsert_counts", f"""WITH {_MERGED}, c AS (SELECT (SELECT count(*) FROM i) AS read,
  count(*) FILTER (WHERE change = 'imported') AS imported, count(*) FILTER (WHERE change = 'updated') AS updated FROM u)
SELECT *, read - imported - updated AS skipped FROM c""")
def upsert_counts(t):
    cells, sheet = _sheet(t)
    return master.upsert_counts(cells, master.master_upsert(_master(t), sheet, now()))


_FOUND = """SELECT concat(CASE WHEN o_custkey % 9 < 4 THEN 'm' ELSE 'new' END, CAST(o_custkey AS STRING), '.com') AS host,
  concat(CASE WHEN o_custkey % 9 < 4 THEN 'm' ELSE 'new' END, CAST(o_custkey AS STRING), '.com') AS registered,
  CASE o_orderstatus WHEN 'F' THEN 'TOXIC' WHEN 'O' THEN 'GOOD' ELSE 'DEAD' END AS verdict,
  CAST(o_orderkey % 70 AS DOUBLE) AS da, CAST(NULL AS DOUBLE) AS spam_score, concat('issue ', CAST(o_orderkey AS STRING)) AS issues,
  concat('https://m', CAST(o_custkey AS STRING), '.com/', CAST(o_orderkey AS STRING)) AS url, o_orderkey FROM orders"""


@query("learn_toxic", f"""
WITH m AS ({_MASTER}), t AS (SELECT * FROM ({_FOUND}) WHERE verdict = 'TOXIC'
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY o_orderkey) = 1)
SELECT coalesce(m.host, t.host) AS host, CASE WHEN m.host IS NOT NULL THEN m.da ELSE t.da END AS da,
  CASE WHEN m.host IS NULL OR (t.host IS NOT NULL AND trim(coalesce(m.status, '')) = '') THEN 'Spammy' ELSE m.status END AS status,
  CASE WHEN m.host IS NULL THEN 'audit' ELSE m.source END AS source, CASE WHEN m.host IS NULL THEN t.issues ELSE m.notes END AS notes,
  CASE WHEN m.host IS NULL THEN 'added' WHEN t.host IS NOT NULL AND trim(coalesce(m.status, '')) = '' THEN 'filled' ELSE 'kept' END AS change
FROM m FULL JOIN t ON t.host = m.host""")
def learn_toxic(t):
    rows = t.orders.selectExpr(*_split_select(_FOUND))
    return master.learn_toxic(_master(t), rows, now(), order=F.col("o_orderkey")).select(
        "host", "da", "status", "source", "notes", "change")


@query("master_stats", f"""
WITH m AS ({_MASTER}) SELECT CASE WHEN coalesce(status, '') = '' THEN '(blank)' ELSE status END AS status, count(*) AS domains,
  count(da) AS with_da, count(spam_score) AS with_spam_score FROM m GROUP BY 1
UNION ALL SELECT NULL, count(*), count(da), count(spam_score) FROM m""")
def master_stats(t):
    return master.master_stats(_master(t))


# ------------------------------------------------------ history, caches ------
_HISTORY = """SELECT concat('r', CAST(month(ts) * 100 + day(ts) AS STRING)) AS run_id,
  concat('https://h', CAST(user_id % 40 AS STRING), '.com/', CAST(user_id AS STRING)) AS url, event_id AS seq,
  CASE WHEN user_id % 3 = 0 THEN 'hot.com' ELSE concat('h', CAST(user_id % 40 AS STRING), '.com') END AS registered,
  CASE event_type WHEN 'view' THEN 'GOOD' WHEN 'click' THEN 'REVIEW' WHEN 'signup' THEN 'TOXIC' WHEN 'purchase' THEN 'DEAD'
    ELSE 'LINK_LOST' END AS verdict, CAST(event_id % 100 AS DOUBLE) AS score, event_id % 2 = 0 AS link_found FROM events"""
_RUN_ID = "concat(CASE WHEN day(ts) = 13 THEN 'lost' ELSE 'r' END, CAST(month(ts) * 100 + day(ts) AS STRING))"
_RUNS = f"""SELECT DISTINCT {_RUN_ID} AS run_id, CAST(month(ts) * 100 + day(ts) AS INT) AS started_at FROM events"""


def _history(t):
    return writers.history_rows(t.events.selectExpr(*_split_select(_HISTORY)), F.col("run_id"))


@query("history_rows", f"""WITH h AS ({_HISTORY}) SELECT run_id, url, registered, verdict, score, link_found, '' AS tier FROM h
QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY seq DESC) = 1""")
def history_rows(t):
    return _history(t).select("run_id", "url", "registered", "verdict", "score", "link_found", "tier")


@query("domain_history", f"""
WITH h AS (SELECT * FROM ({_HISTORY}) QUALIFY row_number() OVER (PARTITION BY run_id, url ORDER BY seq DESC) = 1), r AS ({_RUNS}),
  p AS (SELECT run_id, url, registered, started_at, verdict,
    lag(verdict) OVER (PARTITION BY registered ORDER BY started_at, run_id, url) AS prev_verdict FROM h JOIN r USING (run_id))
SELECT *, prev_verdict IS NOT NULL AND prev_verdict <> verdict AS changed FROM p""")
def domain_history(t):
    runs = t.events.selectExpr(
        f"{_RUN_ID} AS run_id", "CAST(month(ts) * 100 + day(ts) AS INT) AS started_at").distinct()
    return master.domain_history(_history(t), runs).select(
        "run_id", "url", "registered", "started_at", "verdict", "prev_verdict", "changed")


@query("results_to_do", """
WITH c AS (SELECT user_id, max(ts) AS cached_at FROM events GROUP BY 1)
SELECT DISTINCT user_id AS url FROM events WHERE user_id NOT IN
  (SELECT user_id FROM c WHERE cached_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 HOUR)""")
def results_to_do(t):
    cache = t.events.groupBy(F.col("user_id").alias("url")).agg(F.max("ts").cast("timestamp").alias("cached_at"))
    fresh = master.fresh_results(cache, 30, F.lit("2024-01-31 00:00:00"))
    return master.still_to_do(t.events.select(F.col("user_id").alias("url")).distinct(), fresh)


# ----------------------------------------------------------- metric files ----
# parts as rows of seven exports: some with headers, some positional, one nameless URL column
_FILES = """SELECT concat('f', CAST(p_partkey % 7 AS STRING), '.csv') AS file,
  CAST(concat('2024-01-0', CAST(1 + p_partkey % 7 AS STRING), ' 00:00:00') AS TIMESTAMP) AS mtime, p_partkey + 10 AS row_no,
  CAST(p_partkey % 7 AS INT) AS k, concat('https://d', CAST(CAST(floor(p_partkey / 9) AS BIGINT) % 150 AS STRING), '.com/') AS site,
  CAST(p_size AS STRING) AS size, CAST(p_partkey AS STRING) AS key FROM part"""
_CELLS = """CASE k WHEN 0 THEN array(site, size, 'N/A', concat(size, '%'))
  WHEN 1 THEN array('x', site, size) WHEN 2 THEN array(replace(replace(site, 'https://', ''), '/', ''), size, '2,340', '7')
  WHEN 3 THEN array(concat('#', key), replace(replace(site, 'https://', ''), '/', ''), '12', key)
  WHEN 4 THEN array('bad site', size) WHEN 5 THEN array(site, 'n/a', '-') ELSE array(site, size, '3', '4', key, key, key) END"""
_HEADS = """CASE k WHEN 0 THEN array('URL', 'DA', 'pa', 'Spam Score %') WHEN 1 THEN array('No', 'Web Page', 'Domain Authority')
  WHEN 3 THEN array('rank', 'name', 'spam', 'TB') WHEN 5 THEN array('site', 'da', 'ss') ELSE array('exported on monday') END"""


def _cells(t):
    rows = t.part.selectExpr(*_split_select(_FILES))
    heads = rows.groupBy("file", "mtime", "k").agg(F.min("row_no").alias("_r")).select(
        "file", "mtime", (F.col("_r") - 5).alias("row_no"), F.expr(_HEADS).alias("cells"))
    return heads.unionByName(rows.select("file", "mtime", "row_no", F.expr(_CELLS).alias("cells")))


# file 1 names a single metric, so it is read by position: its first cell is no domain
_PARSED = f"""p AS ({_FILES}), v AS (SELECT file, mtime, k, row_no, regexp_extract(site, '//([^/]+)', 1) AS registered,
    CASE k WHEN 0 THEN size::DOUBLE WHEN 2 THEN size::DOUBLE WHEN 6 THEN size::DOUBLE END AS da,
    CASE k WHEN 2 THEN 2340.0 WHEN 6 THEN 3.0 END AS pa,
    CASE k WHEN 0 THEN size::DOUBLE WHEN 2 THEN 7.0 WHEN 3 THEN 12.0 WHEN 6 THEN 4.0 END AS spam_score,
    CASE k WHEN 3 THEN key::DOUBLE WHEN 6 THEN key::DOUBLE END AS backlinks,
    CASE k WHEN 6 THEN key::DOUBLE END AS quality_backlinks FROM p WHERE k IN (0, 2, 3, 6)),
  f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY file, registered ORDER BY row_no DESC) = 1)"""


@query("metric_cells", f"""WITH {_PARSED}
SELECT file, registered, da, pa, spam_score, backlinks, quality_backlinks FROM f""")
def metric_cells(t):
    return metrics.parse_metric_cells(_cells(t)).select(
        "file", "registered", "da", "pa", "spam_score", "backlinks", "quality_backlinks")


@query("metric_merge", f"""WITH {_PARSED}, g AS (SELECT registered,
    arg_max_null(da, mtime) FILTER (WHERE k IN (0, 2, 6)) AS da, arg_max_null(pa, mtime) FILTER (WHERE k IN (0, 2, 6)) AS pa,
    arg_max_null(spam_score, mtime) FILTER (WHERE k IN (0, 2, 3, 6)) AS spam_score,
    arg_max_null(backlinks, mtime) FILTER (WHERE k IN (3, 6)) AS backlinks, max_by(file, mtime) AS file FROM f GROUP BY 1)
SELECT registered, da, pa, spam_score, backlinks, concat('import:', file) AS source FROM g""")
def metric_merge(t):
    return metrics.merge_metric_files(metrics.parse_metric_cells(_cells(t))).select(
        "registered", "da", "pa", "spam_score", "backlinks", "source")


# ------------------------------------------------------- provider payloads ---
@query("payload_results", """
WITH x AS (SELECT concat(CASE l_linenumber % 2 WHEN 1 THEN 'p' ELSE 'q' END, l_suppkey, '.com') AS registered, max(l_orderkey) AS last
    FROM lineitem GROUP BY 1)
SELECT x.registered, CAST(last % 100 AS DOUBLE) AS da, CASE WHEN last % 3 = 0 THEN NULL ELSE CAST(last % 50 AS DOUBLE) END AS spam_score,
  CASE WHEN last % 2 = 0 THEN 7.0 ELSE CAST(last AS DOUBLE) END AS backlinks FROM x""")
def payload_results(t):
    """Line items as result lists of one entry; odd ones name a page, even ones a root domain."""
    item = """concat('{"', CASE WHEN l_linenumber % 2 = 1 THEN 'page' ELSE 'root_domain' END, '": "',
      CASE WHEN l_linenumber % 2 = 1 THEN 'http://www.p' ELSE 'q' END, l_suppkey, '.com', CASE WHEN l_linenumber % 2 = 1 THEN '/x' ELSE '' END,
      '", "subdomain": "", "domain_authority": ', l_orderkey % 100,
      CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat(', "spam_score": ', l_orderkey % 50) END,
      ', "external_pages_to_root_domain": ', CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_orderkey END, ', "external_pages": 7}')"""
    payloads = spread(t.lineitem).selectExpr(
        "l_orderkey AS seq", f"concat('{{\"results\": [', {item}, ']}}') AS payload")
    return metrics.normalise_payload(payloads, "results").select("registered", "da", "spam_score", "backlinks")


@query("payload_tasks", """
WITH x AS (SELECT concat('t', l_suppkey, '.com') AS registered, l_linenumber % 3 AS k, max(l_orderkey) AS last FROM lineitem GROUP BY 1, 2),
  r AS (SELECT registered, max(last) FILTER (WHERE k = 0) AS a, max(last) FILTER (WHERE k = 1) AS b, max(last) FILTER (WHERE k = 2) AS c FROM x GROUP BY 1)
SELECT registered, round_even((a % 1000) / 10.0, 1)::DOUBLE AS da, CAST(b % 100 AS DOUBLE) AS spam_score, CAST(c AS DOUBLE) AS backlinks,
  CAST(c % 7 AS DOUBLE) AS referring_domains FROM r""")
def payload_tasks(t):
    item = """concat('{"target": "sub.t', l_suppkey, '.com", ', CASE CAST(l_linenumber % 3 AS INT)
      WHEN 0 THEN concat('"rank": ', l_orderkey % 1000) WHEN 1 THEN concat('"spam_score": ', l_orderkey % 100)
      ELSE concat('"backlinks": ', l_orderkey, ', "referring_domains": ', l_orderkey % 7) END, '}')"""
    payloads = spread(t.lineitem).selectExpr(
        "CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'rank' WHEN 1 THEN 'spam' ELSE 'links' END AS kind",
        "l_orderkey AS seq", f"concat('{{\"tasks\": [{{\"result\": [{{\"items\": [', {item}, ']}}]}}]}}') AS payload")
    return metrics.normalise_payload(payloads, "tasks")


@query("payload_any", """
WITH x AS (SELECT concat('w', user_id, '.com') AS registered, max(event_id) AS last FROM events WHERE event_id % 4 <> 3 GROUP BY 1)
SELECT registered, CASE WHEN last % 4 = 0 THEN CAST(last % 100 AS DOUBLE) END AS da,
  CASE WHEN last % 4 = 1 THEN 12.5 END AS pa, CASE WHEN last % 4 = 2 THEN 3.0 END AS spam_score,
  CAST(last AS DOUBLE) AS backlinks FROM x""")
def payload_any(t):
    """Events as payloads nested to many depths, of four shapes; those without a metric are too deep to read."""
    metric = """CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('"Domain_Authority": ', event_id % 100) WHEN 1 THEN '"PA": "12.5%"'
      WHEN 2 THEN '"spam score": 3' ELSE '"da": "N/A"' END"""
    depth = "CAST(CASE WHEN event_id % 4 = 3 THEN 1500 ELSE event_id % 20 END AS INT)"
    payloads = t.events.selectExpr("event_id AS seq", f"""concat('{{"ok": true, "data": {{"rows": [1, ', repeat('[', {depth}),
      '{{"Domain": "http://a.w', user_id, '.com/", ', {metric}, ', "TB": "', event_id, '"}}', repeat(']', {depth}), ']}}}}') AS payload""")
    return metrics.normalise_payload(payloads, "any").select("registered", "da", "pa", "spam_score", "backlinks")


# ------------------------------------------------------- lists and disavow ---
_RAW_LINKS = """SELECT CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN concat('  s', CAST(l_suppkey AS STRING), '.com/', CAST(l_partkey % 50 AS STRING))
  WHEN 1 THEN concat('https://s', CAST(l_suppkey AS STRING), '.com/', CAST(l_partkey % 50 AS STRING)) WHEN 2 THEN ' '
  ELSE concat('"//s', CAST(l_suppkey AS STRING), '.com/', CAST(l_partkey % 50 AS STRING), '"') END AS url, concat('t', CAST(l_orderkey AS STRING)) AS target,
  concat('file', CAST(l_suppkey % 3 AS STRING)) AS file, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS line FROM lineitem"""


@query("input_dedup", f"""
WITH r AS ({_RAW_LINKS}), n AS (SELECT replace(replace(replace(trim(url), '"', ''), 'https://', ''), '//', '') AS u, * FROM r)
SELECT concat('https://', u) AS url, target FROM n WHERE u <> ''
QUALIFY row_number() OVER (PARTITION BY u ORDER BY file, line) = 1""")
def input_dedup(t):
    raw = spread(t.lineitem).selectExpr(*_split_select(_RAW_LINKS))
    return readers.dedup_first(raw, ["file", "line"]).select("url", "target")


@query("rerun_selection", f"""
WITH h AS ({_HISTORY}) SELECT url, 'mine.com' AS target FROM h WHERE verdict IN ('TOXIC', 'LINK_LOST')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1""")
def rerun_selection(t):
    rows = t.events.selectExpr(*_split_select(_HISTORY))
    return readers.select_rerun(rows, ["toxic", " link_lost "], "mine.com").select("url", "target")


_LINES = """CASE CAST({k} % 7 AS INT) WHEN 0 THEN concat('domain: ', 'D', CAST({n} AS STRING), '.com # old')
  WHEN 1 THEN concat('DOMAIN:.d', CAST({n} AS STRING), '.com') WHEN 2 THEN concat('https://D', CAST({n} AS STRING), '.com/Page')
  WHEN 3 THEN '# a comment.' WHEN 4 THEN 'two words. here' WHEN 5 THEN 'nodots' ELSE concat('  domain:d', CAST({n} AS STRING), '.com') END"""
_ENTRY = """CASE CAST({k} % 7 AS INT) WHEN 2 THEN concat('https://d', CAST({n} AS STRING), '.com/page')
  ELSE concat('domain:d', CAST({n} AS STRING), '.com') END"""
_SETS = f"""o AS (SELECT DISTINCT {_ENTRY.format(k='s_suppkey', n='s_suppkey')} AS entry FROM supplier WHERE s_suppkey % 7 NOT IN (3, 4, 5)),
  n AS (SELECT DISTINCT {_ENTRY.format(k='c_custkey', n='(c_custkey * 2) % 3000')} AS entry FROM customer WHERE c_custkey % 7 NOT IN (3, 4, 5)),
  d AS (SELECT entry, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o)
    UNION ALL SELECT entry, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
    UNION ALL SELECT entry, 'unchanged' FROM (SELECT * FROM o INTERSECT SELECT * FROM n))"""


def _disavow(t):
    old = t.supplier.selectExpr(_LINES.format(k="s_suppkey", n="s_suppkey") + " AS line")
    new = t.customer.selectExpr(_LINES.format(k="c_custkey", n="(c_custkey * 2) % 3000") + " AS line")
    return report.disavow_diff(report.parse_disavow(old), report.parse_disavow(new))


@query("disavow_diff", f"WITH {_SETS} SELECT entry, change FROM d")
def disavow_diff(t):
    return _disavow(t)


@query("disavow_counts", f"""WITH {_SETS} SELECT count(*) FILTER (WHERE change <> 'added') AS existing,
  count(*) FILTER (WHERE change <> 'removed') AS candidate, count(*) FILTER (WHERE change = 'added') AS added,
  count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
  count(*) AS merged FROM d""")
def disavow_counts(t):
    return report.disavow_counts(_disavow(t))


@query("recorded_vs_live", """
WITH v AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(worthless|eaux|inger)') THEN 'TOXIC' ELSE 'GOOD' END AS verdict FROM documents),
  l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Spammy' WHEN quality = 1 THEN 'No Issues' ELSE '' END AS s FROM labels)
SELECT CASE WHEN l.doc_id IS NULL THEN 'new' WHEN s = 'Spammy' THEN 'spammy' WHEN s = 'No Issues' THEN 'clean' ELSE 'other' END AS known, verdict,
  CASE WHEN s = 'No Issues' AND verdict = 'TOXIC' THEN 'clean_now_bad' WHEN s = 'Spammy' AND verdict = 'GOOD' THEN 'spammy_now_clean' ELSE '' END AS master_disagrees,
  count(*) AS documents
FROM v LEFT JOIN l USING (doc_id) GROUP BY 1, 2, 3""")
def recorded_vs_live(t):
    """Recorded labels against a live scan of every document."""
    from anchorlake.operators.textscan import scan_text
    from anchorlake.rules import keyword_rules
    rules = keyword_rules([("x", "worthless"), ("x", "eaux"), ("x", "inger")])
    live = scan_text(spread(t.documents.select("doc_id", "text")), rules, "text", 1, 1).select(
        "doc_id", F.when(F.col("content_spam"), "TOXIC").otherwise("GOOD").alias("verdict"))
    recorded = t.labels.select("doc_id", F.lit(True).alias("in_master"), F.when(
        F.col("toxic") == 1, "Spammy").when(F.col("quality") == 1, "No Issues").otherwise("").alias("master_status"))
    rows = live.join(recorded, "doc_id", "left")
    return report.with_master_key(report.with_disagreement(rows)).groupBy(
        "known", "verdict", "master_disagrees").agg(F.count("*").alias("documents"))
