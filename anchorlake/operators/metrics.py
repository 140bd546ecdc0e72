"""Authority metrics: export cells, file merging, provider payloads, precedence, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions import text as X
from anchorlake.functions import urls as U
from anchorlake.operators.keyed import Ordered, last_per_key, lookup
from anchorlake.session import cut_lineage

METRICS = list(fixed.METRIC_HEADERS)
POSITIONAL = ["da", "pa", "spam_score", "backlinks", "quality_backlinks"]


def _column_of(cells: Column, pattern: str) -> Column:
    """0-based index of the first cell matching a header pattern, or null."""
    spot = F.array_position(
        F.transform(cells, lambda c: F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)), True)
    return F.when(spot > 0, (spot - 1).cast("int"))


def find_headers(cells: DataFrame, enough: Column, columns: dict[str, Column]) -> DataFrame:
    """Header row per file: the first row for which ``enough`` holds, wherever it stands."""
    candidates = cells.select("file", "row_no", F.struct(*[
        c.alias(n) for n, c in columns.items()]).alias("at"), enough.alias("ok")).where("ok")
    return candidates.groupBy("file").agg(
        F.min("row_no").alias("header_row"), F.min_by("at", "row_no").alias("at"))


def parse_metric_cells(cells: DataFrame) -> DataFrame:
    """Cells of metric exports (file, mtime, row_no, cells) to metrics per file and domain.

    A header row names at least two metrics. Without a URL header the first column
    where at least half of the five rows below look like domains is used. Files
    without a header are read by position. The last row of a domain in a file wins.
    """
    found = {m: _column_of(F.col("cells"), p) for m, p in fixed.METRIC_HEADERS.items()}
    present = sum((c.isNotNull().cast("int") for c in found.values()), F.lit(0))
    headers = cut_lineage(find_headers(
        cells, present >= 2, {**found, "url": _column_of(F.col("cells"), fixed.METRIC_URL_HEADER)}))
    # the first five rows below each header decide which column holds domains; a
    # row_number filter this small is applied before the shuffle as well
    below = lookup(cells.select("file", "row_no", "cells"),
                   headers.select("file", "header_row", F.col("at.url").alias("_url")), "file")
    below = below.where(F.col("_url").isNull() & (F.col("row_no") > F.col("header_row")))
    nearest = F.row_number().over(W.partitionBy("file").orderBy("row_no"))
    samples = below.withColumn("_n", nearest).where(F.col("_n") <= 5).groupBy("file").agg(
        F.collect_list("cells").alias("rows"))
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))

    def domains_in(j: Column) -> Column:
        column = F.filter("rows", lambda r: F.size(r) > j)
        hits = F.size(F.filter(column, lambda r: X.looks_like_domain(F.get(r, j))))
        return (F.size(column) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(column) / 2)))

    guessed = samples.select("file", F.get(F.filter(
        F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), domains_in), F.lit(0)).alias("_guess"))
    layout = headers.join(guessed, "file", "left").select(
        "file", "header_row", "at", F.coalesce("at.url", "_guess", F.lit(0)).alias("url_at"))
    rows = lookup(cells, layout, "file", key_source=cells.select("file"))
    headed = F.col("header_row").isNotNull()
    named = rows.where(headed & (F.col("row_no") > F.col("header_row"))).select(
        "file", "mtime", "row_no", F.trim(F.get("cells", F.col("url_at"))).alias("raw"),
        F.struct(*[
            F.when(F.col(f"at.{m}").isNotNull(),
                   X.lenient_number(F.get("cells", F.col(f"at.{m}")))).alias(m) for m in METRICS]).alias("v"),
        F.array_compact(F.array(*[
            F.when(F.col(f"at.{m}") < F.size("cells"), F.lit(m)) for m in METRICS])).alias("given"))
    filled = F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    numbers = F.filter(
        F.transform(F.slice("_filled", F.lit(2), F.size("_filled")), lambda c: X.lenient_number(c)),
        lambda n: n.isNotNull())
    plain = rows.where(~headed).withColumn("_filled", filled).where(F.size("_filled") >= 2) \
        .withColumn("_numbers", numbers).where(F.size("_numbers") > 0).select(
            "file", "mtime", "row_no", F.get("_filled", F.lit(0)).alias("raw"),
            F.struct(*[F.get("_numbers", F.lit(POSITIONAL.index(m))).alias(m) if m in POSITIONAL
                       else F.lit(None).cast("double").alias(m) for m in METRICS]).alias("v"),
            F.slice(F.array(*[F.lit(m) for m in POSITIONAL]), F.lit(1),
                    F.least(F.size("_numbers"), F.lit(len(POSITIONAL)))).alias("given"))
    usable = named.unionByName(plain).withColumn("registered", U.registered_domain(F.col("raw"))).where(
        (F.col("registered") != "") & X.looks_like_domain(F.col("raw"))
        & F.coalesce(*[F.col(f"v.{m}") for m in METRICS]).isNotNull())
    last = last_per_key(usable.select("file", "mtime", "registered", "row_no", "v", "given"),
                        ["file", "registered"], [F.col("row_no")])
    return last.select("file", "mtime", "registered", "v.*", "given")


def merge_metric_files(parsed: DataFrame) -> DataFrame:
    """One row per domain: later files override earlier ones key by key, nulls included."""
    when = F.struct("mtime", "file")
    return parsed.groupBy("registered").agg(
        *[F.max_by(F.col(m), F.when(F.array_contains("given", m), when)).alias(m) for m in METRICS],
        F.concat(F.lit("import:"), F.max_by("file", when)).alias("source"))


# ------------------------------------------------------ provider payloads ----
_URL_METRICS = (
    "results array<struct<page:string,subdomain:string,root_domain:string,domain_authority:double,"
    "page_authority:double,spam_score:double,external_pages_to_root_domain:double,"
    "external_pages:double,root_domains_to_root_domain:double>>")
_BULK = ("tasks array<struct<result:array<struct<items:array<struct<target:string,rank:double,"
         "spam_score:double,backlinks:double,referring_domains:double>>>>>>")


def url_metrics_payload(payloads: DataFrame) -> DataFrame:
    """Payloads of the form {results: [...]}: page, then subdomain, then root names the site."""
    item = payloads.select("seq", F.posexplode(
        F.from_json("payload", _URL_METRICS)["results"]).alias("pos", "i"))
    target = F.coalesce(*[F.nullif(F.col(f"i.{k}"), F.lit("")) for k in ("page", "subdomain", "root_domain")])
    rows = item.select(
        "seq", "pos", U.registered_domain(target).alias("registered"),
        F.col("i.domain_authority").alias("da"), F.col("i.page_authority").alias("pa"),
        F.col("i.spam_score").alias("spam_score"),
        F.coalesce(F.nullif(F.col("i.external_pages_to_root_domain"), F.lit(0.0)),
                   "i.external_pages").alias("backlinks"),
        F.col("i.root_domains_to_root_domain").alias("referring_domains"))
    last = last_per_key(rows.where(F.col("registered") != ""), ["registered"], [F.col("seq"), F.col("pos")])
    return last.drop("seq", "pos")


def bulk_payload(payloads: DataFrame) -> DataFrame:
    """Three feeds (kind rank, spam or links) of the form {tasks: [{result: [{items}]}]}.

    Ranks run to 1000 and become an authority of rank / 10.
    """
    results = F.flatten(F.transform(F.from_json("payload", _BULK)["tasks"], lambda t: t["result"]))
    items = F.flatten(F.transform(results, lambda r: r["items"]))
    rows = payloads.select("kind", "seq", F.posexplode(items).alias("pos", "i")).select("kind", "seq", "pos", "i.*")

    def latest(value: str, kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("seq", "pos", F.col(value).alias("value")))).alias(value)

    # folded by the name as it stands first, so each different one is taken apart once
    names = rows.groupBy("target").agg(
        latest("rank", "rank"), latest("spam_score", "spam"), latest("backlinks", "links"), latest("referring_domains", "links"))
    found = names.withColumn("registered", U.registered_domain(F.col("target"))).where(F.col("registered") != "")
    return found.groupBy("registered").agg(
        F.bround(F.max("rank")["value"] / 10, 1).alias("da"),
        *[F.max(c)["value"].alias(c) for c in ("spam_score", "backlinks", "referring_domains")])


# --- fixed values: key names accepted in payloads of unknown shape
_TARGET_KEYS = ["url", "domain", "target", "website", "site", "page"]
_METRIC_KEYS = {
    "da": ["da", "domainauthority"], "pa": ["pa", "pageauthority"], "spam_score": ["ss", "spamscore"],
    "backlinks": ["tb", "backlinks", "totalbacklinks"],
    "quality_backlinks": ["qb", "qualitybacklinks", "dofollow"],
}


def unreadable_payloads(payloads: DataFrame) -> DataFrame:
    """How many payloads are null, no JSON, or nested more than 1,000 deep."""
    return payloads.agg(F.count_if(F.col("payload").isNull() | F.try_parse_json("payload").isNull()).alias("unreadable"))


# objects and lists of every payload, outermost first; path holds the place of a node in each of its parents
_NODES = """
WITH RECURSIVE node(seq, path, v) MAX RECURSION LEVEL 1002 AS (
  SELECT seq, CAST(array() AS ARRAY<INT>), v FROM {parsed} WHERE v IS NOT NULL
  UNION ALL
  SELECT n.seq, concat(n.path, array(e.pos)), e.value FROM node n, LATERAL variant_explode(n.v) e
  WHERE try_cast(e.value AS MAP<STRING, VARIANT>) IS NOT NULL OR try_cast(e.value AS ARRAY<VARIANT>) IS NOT NULL)
SELECT seq, path, map_entries(try_cast(v AS MAP<STRING, VARIANT>)) AS fields FROM node"""


def _field(names: list[str], key: Column, usable: Column | None = None) -> Column:
    """The text of the first of ``names`` that is a key of the object; of equal keys the last one."""
    def entries(name: str) -> Column:
        same = lambda e: (key(e["key"]) == name) & (F.lit(True) if usable is None else usable(e["value"]))
        return F.filter("fields", same)

    found = [F.get(F.reverse(entries(n)), F.lit(0)) for n in names]
    first = F.coalesce(*found)["value"]
    return first.try_cast("string")


def _squeezed(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[ _]", "")


def _names_something(value: Column) -> Column:
    """A value that is no object or list, and neither null nor empty, zero or false."""
    inner = F.coalesce(value.try_cast("map<string,variant>").isNotNull(), F.lit(False)) | F.coalesce(
        value.try_cast("array<variant>").isNotNull(), F.lit(False))
    return ~inner & ~F.coalesce(value.try_cast("string"), F.lit("")).isin("", "0", "0.0", "false")


def walk_payload(payloads: DataFrame) -> DataFrame:
    """Metrics found anywhere in JSON payloads of unknown shape; unreadable ones hold none.

    Payloads are parsed once and taken apart level by level, so no task holds more than one
    of them. Of a domain that is named several times the last payload counts, and in it the
    last element of a list; the fields of an object count in the order of their names.
    """
    parsed = payloads.select("seq", F.try_parse_json("payload").alias("v"))
    nodes = payloads.sparkSession.sql(_NODES, parsed=parsed).where("fields IS NOT NULL")
    target = _field(_TARGET_KEYS, F.lower, _names_something)
    rows = nodes.select("seq", "path", U.registered_domain(target).alias("registered"), *[
        X.lenient_number(_field(names, _squeezed)).alias(m) for m, names in _METRIC_KEYS.items()])
    rows = rows.where((F.col("registered") != "") & F.coalesce("da", "pa", "spam_score").isNotNull())
    return last_per_key(rows, ["registered"], [F.col("seq"), F.col("path")]).drop("seq", "path")


def normalise_payload(payloads: DataFrame, kind: str) -> DataFrame:
    """Dispatch on payload shape: 'results', 'tasks' or 'any'."""
    return {"results": url_metrics_payload, "tasks": bulk_payload, "any": walk_payload}[kind](payloads)


# ------------------------------------------------------ precedence, queue ----
def resolve_metrics(domains: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Metrics per domain from the first source that knows it; empty where none does.

    Each source has registered, source and any of the metric columns, one row per
    domain, and is already limited to records fresh enough to use.
    """
    ranked: DataFrame | None = None
    for rank, source in enumerate(sources):
        rows = source.select(
            "registered", F.lit(rank).alias("_rank"),
            *[(F.col(m).cast("double") if m in source.columns else F.lit(None).cast("double")).alias(m)
              for m in METRICS], F.col("source"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy("registered").agg(F.min_by(
        F.struct(*METRICS, "source"), "_rank").alias("_m")).select("registered", "_m.*")
    wanted = domains.select("registered").distinct()
    return wanted.join(best, "registered", "left").withColumn(
        "source", F.coalesce("source", F.lit("")))


def attach_metrics(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics by registered domain onto audit rows."""
    facts = metrics.withColumnRenamed("source", "metrics_source")
    clean = rows.drop(*[c for c in facts.columns if c != "registered"])
    return lookup(clean, facts, "registered")


def metric_queue(domains: DataFrame, known: DataFrame, size: int = 100) -> DataFrame:
    """Domains that still lack an authority figure, sorted, in numbered batches."""
    have = known.where(F.col("da").isNotNull()).select("registered").distinct()
    todo = domains.select("registered").where(F.col("registered") != "").distinct().join(
        have, "registered", "left_anti")
    return Ordered(todo, [F.col("registered")]).numbered("position").withColumn(
        "batch", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))
