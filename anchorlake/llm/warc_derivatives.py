"""Derivatives of WARC responses: a metadata and a plain-text conversion record for each.

Both records point at their response (WARC-Refers-To) and the metadata record also at the
conversion made with it (WARC-Concurrent-To). They keep the response's target, date, headers
and payload digest and carry a digest of their own block. Record ids are derived from the
response's id, so a repeated or retried job builds the same records.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from anchorlake.llm.registry import query

CAPTURED = "1970-01-01T00:00:00Z"  # the date of responses that come without one
_DROPPED = "script", "style", "noscript", "template"
_LINES = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article",
          "section", "header", "footer", "nav", "main", "aside", "blockquote", "pre", "title", "hr", "dt", "dd")
DROP = "(?is)<!--.*?-->|" + "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in _DROPPED)
LINE = r"(?i)</?(?:" + "|".join(_LINES) + r")(?:[\s/][^>]*)?>"
TAG = r"</?[A-Za-z!][^>]*>"


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t).replace("\xa0", " ") if t and "&" in t else t)


def plain_text(markup: Column) -> Column:
    """Visible text: one line per block, single spaces, entities decoded once."""
    bare = F.regexp_replace(markup, DROP, " ")
    bare = F.regexp_replace(bare, LINE, "\n")
    bare = _decoded(F.regexp_replace(bare, TAG, ""))
    bare = F.regexp_replace(bare, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(bare, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def record_id(*parts: Column) -> Column:
    """A stable ``urn:uuid`` from the given parts; null parts count as empty."""
    h = F.md5(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses_of(pages: DataFrame) -> DataFrame:
    """Stored pages as responses: response_id, target_uri, date, source_headers, body."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        "page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url"), body).alias("response_id"),
        F.col("url").alias("target_uri"), F.lit(CAPTURED).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.octet_length(body).cast("string"), F.lit("\r\n")).alias("source_headers"),
        body.alias("body"))


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines; a line without a value is left out."""
    return F.concat(F.lit("WARC/1.1\r\n"), *[
        F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
        for name, value in lines])


def derivatives(responses: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    ``responses`` has ``id_column``, response_id, target_uri, date, source_headers and body.
    A null body counts as empty and gives an empty conversion; a null target gives records
    without WARC-Target-URI. Repeated responses give repeated records with the same ids.
    Other columns are ignored; an empty table gives an empty one.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    facts = responses.select(
        id_column, "response_id", "target_uri", "date",
        F.coalesce("source_headers", F.lit("")).alias("source_headers"), plain_text(body).alias("text"),
        F.octet_length(body).alias("size"), digest(body).alias("source_digest"))
    facts = facts.withColumns({
        "conversion_id": record_id(F.col("response_id"), F.lit("conversion")),
        "metadata_id": record_id(F.col("response_id"), F.lit("metadata")),
        "fields": F.concat(
            F.lit("source-payload-digest: "), F.col("source_digest"),
            F.lit("\r\nsource-payload-length: "), F.col("size").cast("string"),
            F.lit("\r\nconversion: "), record_id(F.col("response_id"), F.lit("conversion")),
            F.lit("\r\ntext-length: "), F.octet_length("text").cast("string"), F.lit("\r\n"),
            F.regexp_replace(F.regexp_replace("source_headers", r"(?m)^HTTP/", "status: HTTP/"),
                             r"(?m)^([A-Za-z])", "source-$1"))})

    def record(kind: str, block: str, content_type: str) -> Column:
        own, other = f"{kind}_id", F.lit(None).cast("string")
        concurrent = F.col("conversion_id") if kind == "metadata" else other
        length, block_digest = F.octet_length(block), digest(F.col(block))
        return F.struct(
            F.lit(kind).alias("warc_type"), F.col(own).alias("record_id"), concurrent.alias("concurrent_to"),
            F.lit(content_type).alias("content_type"), length.cast("long").alias("content_length"),
            block_digest.alias("block_digest"),
            _header(("WARC-Type", F.lit(kind)), ("WARC-Record-ID", F.col(own)),
                    ("WARC-Refers-To", F.col("response_id")), ("WARC-Concurrent-To", concurrent),
                    ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")),
                    ("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Block-Digest", block_digest),
                    ("Content-Type", F.lit(content_type)), ("Content-Length", length)).alias("header"),
            F.col(block).alias("block"))

    both = F.explode(F.array(record("metadata", "fields", "application/warc-fields"),
                             record("conversion", "text", "text/plain; charset=utf-8")))
    return facts.select(
        id_column, F.col("response_id").alias("refers_to"), "target_uri", "date", "source_headers",
        "source_digest", both.alias("r")).select(
        id_column, "refers_to", "target_uri", "date", "source_headers", "source_digest", "r.*")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one per partition."""
    (records.select(F.concat("header", F.lit("\r\n"), "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


_LINES_SQL = "|".join(_LINES)
_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages),
t AS (
  SELECT page_id, url AS target_uri, body, strlen(body) AS size,
    'sha256:' || sha256(body) AS source_digest,
    md5(concat_ws(chr(31), 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), body)) AS r,
    replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(body, '{DROP}', ' ', 'g'), '{LINE}', chr(10), 'g'), '{TAG}', '', 'g'),
      '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&amp', '&') AS bare FROM p),
x AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, '[ \\t\\r\\f\\x0B]+', ' ', 'g'),
      ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text,
    '<urn:uuid:' || r[1:8] || '-' || r[9:12] || '-' || r[13:16] || '-' || r[17:20] || '-' || r[21:32] || '>' AS refers_to,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || size || chr(13) || chr(10) AS source_headers FROM t),
i AS (
  SELECT *, md5(refers_to || chr(31) || 'conversion') AS c, md5(refers_to || chr(31) || 'metadata') AS m FROM x),
f AS (
  SELECT *, '<urn:uuid:' || c[1:8] || '-' || c[9:12] || '-' || c[13:16] || '-' || c[17:20] || '-' || c[21:32] || '>' AS cid,
    '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' AS mid FROM i),
b AS (
  SELECT *, 'metadata' AS warc_type, mid AS record_id, cid AS concurrent_to, 'application/warc-fields' AS content_type,
    'source-payload-digest: ' || source_digest || chr(13) || chr(10) || 'source-payload-length: ' || size || chr(13) || chr(10)
    || 'conversion: ' || cid || chr(13) || chr(10) || 'text-length: ' || strlen(text) || chr(13) || chr(10)
    || 'source-status: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-Content-Type: text/html; charset=utf-8'
    || chr(13) || chr(10) || 'source-Content-Length: ' || size || chr(13) || chr(10) AS block FROM f
  UNION ALL
  SELECT *, 'conversion', cid, NULL, 'text/plain; charset=utf-8', text FROM f),
d AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM b)
SELECT page_id, refers_to, target_uri, '{CAPTURED}' AS date, source_headers, source_digest, warc_type, record_id,
  concurrent_to, content_type, CAST(content_length AS BIGINT) AS content_length, block_digest,
  'WARC/1.1' || e || 'WARC-Type: ' || warc_type || e || 'WARC-Record-ID: ' || record_id || e || 'WARC-Refers-To: '
  || refers_to || e || coalesce('WARC-Concurrent-To: ' || concurrent_to || e, '')
  || coalesce('WARC-Target-URI: ' || target_uri || e, '') || 'WARC-Date: {CAPTURED}' || e
  || 'WARC-Source-Payload-Digest: ' || source_digest || e || 'WARC-Block-Digest: ' || block_digest || e
  || 'Content-Type: ' || content_type || e || 'Content-Length: ' || content_length || e AS header, block
FROM d, (SELECT chr(13) || chr(10) AS e)
"""


@query("op6_warc_derivatives", _SQL)
def op6(t):
    return derivatives(responses_of(t.pages))
