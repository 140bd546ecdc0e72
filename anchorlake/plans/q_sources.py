"""Queries that write the given tables as files of every kind, read them back and compare."""

from __future__ import annotations

import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorlake.operators import metrics, network, report
from anchorlake.plans.q_pages import ANCHOR_CFG, _ANCHOR_TOTALS, _ANCHOR_WARNINGS, _ANCHORS, _profile
from anchorlake.plans.registry import Tables, query
from anchorlake.session import shared_dir
from anchorlake.sources import readers, writers


def _place(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/files/{uuid.uuid4().hex}"


def _write_headed(lines: DataFrame, head: list[str], path: str) -> None:
    """Files of type csv, one for each partition, that all begin with the same lines."""
    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": head})
        yield from batches

    lines.mapInPandas(headed, "value string").write.options(sep="\u0001", quote="", escapeQuotes=False).csv(path)


def _write_documents(rows: DataFrame, path: str) -> None:
    """Run documents, one for each partition: a list of rows over many lines between other parts."""
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["{", ' "meta": {', '  "rows": [1, "{"]', " },", ' "rows": [']})
        comma = ""
        for batch in batches:
            lines = []
            for url, verdict, target in batch.itertuples(index=False):
                lines += [f"  {comma}" if comma else "", "  {", f'   "url": "{url}",', f'   "verdict": "{verdict}",',
                          f'   "notes": "[{{",', f'   "input_target": "{target}"', "  }"]
                comma = ","
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": [" ]", "}"]})

    rows.mapInPandas(written, "value string").write.text(path)


# customers as three kinds of link lists: half of them twice
@query("list_files", """
WITH l AS (
  SELECT c_custkey AS k, 'https://site' || c_custkey || '.com/p' AS url, 'target' || c_custkey % 7 || '.com' AS target,
    'say "' || c_name || '",' || chr(10) || 'ok' AS anchor, 0 AS pos FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'https://site' || c_custkey || '.com/p', c_mktsegment, '', 1 FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, 'https://site' || c_custkey || '.com/p', '', '', 2 FROM customer WHERE c_custkey % 3 = 2 OR c_custkey % 2 = 0)
SELECT url, target, anchor, '' AS notes FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1""")
def list_files(t):
    """Comma lists with quoted cells over two lines and headers, semicolon lists without one, and plain lists."""
    place, c = _place(t), t.customer
    url = "concat('https://site', c_custkey, '.com/p')"
    c.where("c_custkey % 3 = 0").selectExpr(
        f"{url} AS `Backlink URL`", "concat('target', c_custkey % 7, '.com') AS `Target`",
        "concat('say \"', c_name, '\",\nok') AS `Anchor text`").write.option("header", True).option(
        "escape", '"').csv(f"{place}/kind=a")
    c.where("c_custkey % 3 = 1").selectExpr(url, "c_mktsegment").write.option("sep", ";").csv(f"{place}/kind=b")
    c.where("c_custkey % 3 = 2 OR c_custkey % 2 = 0").selectExpr(f"concat({url}, '  # seen') AS value").write.text(
        f"{place}/kind=c")
    return readers.read_backlinks(t.spark, place)


@query("export_files", """
SELECT 'site' || p_partkey || '.com' AS registered, p_size::DOUBLE AS da, (p_size % 7)::DOUBLE AS spam_score,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 1000.0 END::DOUBLE AS backlinks FROM part""")
def export_files(t):
    """Parts as metric exports: headed files with a long preamble, and files read by position."""
    place = _place(t)
    site = "concat('site', p_partkey, '.com')"
    lines = t.part.where("p_partkey % 2 = 0").selectExpr(
        f"concat('https://', {site}, '/,', p_size, ',', p_size % 7, '%,\"', format_number(p_partkey * 1000, 0), '\"') AS value")
    _write_headed(lines, [f"line {k}" for k in range(40)] + ["URL,DA,SS,TB"], f"{place}/kind=headed")
    t.part.where("p_partkey % 2 = 1").selectExpr(f"concat({site}, '   ', p_size, '   0   ', p_size % 7) AS value").write.text(
        f"{place}/kind=plain")
    cells = readers.read_cells(t.spark, place)
    return metrics.parse_metric_cells(cells).select("registered", "da", "spam_score", "backlinks")


@query("sheet_files", """
SELECT 'site' || s_suppkey || '.net' AS host, CAST(s_suppkey % 100 AS VARCHAR) AS da,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Spammy' ELSE 'No Issues' END AS status FROM supplier""")
def sheet_files(t):
    place = _place(t)
    t.supplier.selectExpr("concat('site', s_suppkey, '.net') AS Domain", "s_suppkey % 100 AS DA",
                          "CASE WHEN s_suppkey % 2 = 0 THEN 'Spammy' ELSE 'No Issues' END AS Status").write.option(
        "header", True).csv(f"{place}/kind=sheet")
    return readers.read_sheet(readers.read_cells(t.spark, place)).select("host", "da", "status")


@query("run_files", """
SELECT 'https://o' || o_orderkey || '.com' AS url, CASE WHEN o_orderkey % 2 = 0 THEN 't.com' ELSE 'mine.com' END AS target,
  '' AS anchor, CASE WHEN o_orderkey % 3 = 0 THEN '[{' ELSE '' END AS notes FROM orders WHERE o_orderstatus = 'F'""")
def run_files(t):
    """Orders as a saved run, and a third of them as run documents, read back and picked for another audit."""
    place = _place(t)
    rows = t.orders.selectExpr("o_orderkey", "concat('https://o', o_orderkey, '.com') AS url",
                               "CASE o_orderstatus WHEN 'F' THEN 'TOXIC' WHEN 'O' THEN 'GOOD' ELSE 'REVIEW' END AS verdict",
                               "CASE WHEN o_orderkey % 2 = 0 THEN 't.com' ELSE '' END AS input_target")
    writers.write_run(rows.where("o_orderkey % 3 <> 0").drop("o_orderkey"), "first", f"{place}/saved")
    _write_documents(rows.where("o_orderkey % 3 = 0").drop("o_orderkey"), f"{place}/documents")
    return readers.select_rerun(readers.read_run(t.spark, f"{place}/*"), ["toxic"], "mine.com")


@query("anchor_report", f"""WITH {_ANCHORS}, {_ANCHOR_TOTALS}, w AS ({_ANCHOR_WARNINGS}),
  r AS (SELECT 'anchors' AS section, anchor AS name, kind, count(*) AS n FROM k GROUP BY 2, 3
    UNION ALL SELECT 'kinds', kind, kind, count(*) FROM k GROUP BY 2, 3 UNION ALL SELECT 'warnings', warning, anchor, n FROM w)
SELECT section, name, nullif(kind, '') AS kind, n, round_even(100.0 * n / (SELECT total FROM s), 1)::DOUBLE AS share FROM r""")
def anchor_report(t):
    """The whole anchor report, written and read again."""
    place = _place(t)
    writers.write_anchor_report(_profile(t), ANCHOR_CFG, place)
    return t.spark.read.schema("name string, kind string, n long, share double, section string").option(
        "header", True).option("escape", '"').csv(place)


_NETS = """SELECT 'site' || c_custkey || '.com' AS registered, '10.0.' || c_nationkey || '.' || c_custkey % 40 AS ip FROM customer"""


@query("network_report", f"""WITH s AS ({_NETS}), g AS (SELECT ip, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 3)
SELECT 'same IP ' || ip AS "Signal", CAST(n AS VARCHAR) AS "Domains", registered AS "Domain" FROM g JOIN s USING (ip)""")
def network_report(t):
    """Domains of every shared address, written as a report and read again."""
    place = _place(t)
    sites = t.customer.selectExpr("concat('site', c_custkey, '.com') AS registered",
                                  "concat('10.0.', c_nationkey, '.', c_custkey % 40) AS ip")
    signals = network.footprint_signals(sites, [F.col("registered")]).where("kind = 'ip'")
    groups = network.signal_groups(signals)
    writers.write_network_report(network.group_members(signals, groups), groups, place)
    return t.spark.read.option("header", True).option("escape", '"').csv(place)


@query("disavow_files", """
SELECT DISTINCT 'domain:site' || s_suppkey || '.org' AS entry FROM supplier WHERE s_suppkey % 3 = 0""")
def disavow_files(t):
    """A disavow file written from verdicts and read again."""
    place = _place(t)
    rows = t.supplier.selectExpr(
        "concat('https://site', s_suppkey, '.org/x') AS url", "concat('site', s_suppkey, '.org') AS registered",
        "concat('site', s_suppkey, '.org') AS host", "false AS free_subdomain",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'TOXIC' ELSE 'GOOD' END AS verdict", "'' AS network_id", "'' AS network_signals")
    report.disavow_entries(rows).select(F.col("entry").alias("value")).write.text(place)
    return readers.read_disavow(t.spark, place).select("entry").distinct()
