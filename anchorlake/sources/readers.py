"""Readers for link lists, metric exports, master sheets, run files and disavow files.

Files are read as distributed text, all in one pass; their delimiters and headers are
aggregates per file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorlake import fixed_values as fixed
from anchorlake.functions.urls import normalize_url
from anchorlake.operators.keyed import first_per_key
from anchorlake.session import cut_lineage, shared_dir

DELIMITERS = [",", ";", "\t", "|"]
ALL_HEADERS = set(fixed.URL_HEADERS + fixed.TARGET_HEADERS + fixed.ANCHOR_HEADERS + fixed.NOTE_HEADERS)
BACKLINK_COLUMNS = ["url", "target", "anchor", "notes"]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a number that grows with their position in the file.

    Byte-order marks and bytes that are no UTF-8 are left out.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.regexp_replace(F.col("value"), "^\ufeff|\ufffd", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("mtime"))
    # within a task the id grows line by line; the block start orders a file's tasks
    return raw.select("file", "mtime", "block", "line",
                      F.monotonically_increasing_id().alias("at"))


CHUNK_BITS = 16  # at most 65,536 lines, whatever a file block holds


def _chunk_of(at: Column) -> Column:
    """A file block's lines in runs small enough to be windows."""
    return F.shiftright(at, CHUNK_BITS)


# --- fixed value: the longest cell the usual csv readers accept
LONGEST_CELL = 131_072


def _open_after(line: Column, inside: bool) -> Column:
    """Does a quoted cell stay open behind a line that starts inside one, or outside?

    The line is cut at its quotes. Outside, a quote opens a cell only where one begins; inside,
    it closes the cell, or is the first of two that stand for one.
    """
    parts = F.split(line, '"')
    begins = f"[{''.join(DELIMITERS)}] *$"
    state = lambda is_open, closed: F.struct(is_open.alias("open"), closed.alias("closed"))

    def at_quote(s: Column, part: Column) -> Column:
        """The state behind the quote that follows ``part``."""
        doubled = s["closed"] & (part == "")
        return state(F.when(s["open"], False).otherwise(doubled | part.rlike(begins)), s["open"])

    first = F.get(parts, F.lit(0))
    start = state(F.lit(False), F.lit(True)) if inside else state(first.rlike(f"^ *$|{begins}"), F.lit(False))
    quotes = F.size(parts) - 1
    last = F.aggregate(F.slice(parts, 2, F.greatest(quotes - 1, F.lit(0))), start, at_quote)
    return F.when(quotes == 0, F.lit(inside)).otherwise(last["open"])


def join_records(lines: DataFrame) -> DataFrame:
    """Lines of delimited files, those that a quoted cell runs over joined to one.

    What a line does to the state "inside a quoted cell" is a map of two values, and such maps
    compose. So the state at every line's start follows from a running composition inside each
    file block and one value per block, however long a file is. Files in which no line opens
    such a cell are passed through. What would be longer than the longest cell csv readers accept,
    as behind a quote that is never closed, is no cell: its lines are records of their own.
    """
    stepped = lines.withColumn("_out", _open_after(F.col("line"), False)).withColumn(
        "_in", _open_after(F.col("line"), True)).withColumn("_chunk", _chunk_of(F.col("at")))
    broken = stepped.where("_out").select("file").distinct()
    plain = lines.join(broken, "file", "left_anti")
    mapped = cut_lineage(stepped.join(broken, "file", "left_semi"))  # read several times below
    if not mapped.limit(1).count():
        return lines
    here = W.partitionBy("file", "block", "_chunk").orderBy("at")
    before = here.rowsBetween(W.unboundedPreceding, -1)
    # a line that sets the state whatever it was, and how often the state has turned since
    fixed_to = F.when(F.col("_out") == F.col("_in"), F.col("_out"))
    turned = (F.col("_out") & ~F.col("_in")).cast("int")
    counted = mapped.withColumn("_turns", F.sum(turned).over(here)).withColumn("_set", F.when(
        fixed_to.isNotNull(), F.struct(fixed_to.alias("to"), F.col("_turns").alias("at"))))
    state = lambda since, turns, start: F.when(since.isNotNull(), since["to"] != ((turns - since["at"]) % 2 == 1)).otherwise(
        start != (turns % 2 == 1))
    chunks = counted.groupBy("file", "block", "_chunk").agg(
        F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("at"))).alias("_set"), F.max("_turns").alias("_turns"))
    # the same composition over one row per block
    files = W.partitionBy("file").orderBy("block", "_chunk")
    parity = F.sum("_turns").over(files)
    total = chunks.withColumn("_sum", parity).withColumn("_fixed", F.when(F.col("_set").isNotNull(), F.struct(
        (F.col("_set.to") != ((F.col("_turns") - F.col("_set.at")) % 2 == 1)).alias("to"), F.col("_sum").alias("at"))))
    earlier = files.rowsBetween(W.unboundedPreceding, -1)
    starts = total.select("file", "block", "_chunk", F.coalesce(state(
        F.last("_fixed", True).over(earlier), F.lag("_sum").over(files), F.lit(False)), F.lit(False)).alias("_start"))
    placed = counted.withColumn("_since", F.last("_set", True).over(before)).withColumn(
        "_before", F.coalesce(F.lag("_turns").over(here), F.lit(0))).join(starts, ["file", "block", "_chunk"])
    inside = state(F.col("_since"), F.col("_before"), F.col("_start"))
    place = F.struct("block", "at")
    begun = placed.withColumn("_begin", F.when(~inside, place))
    last_begin = begun.groupBy("file", "block", "_chunk").agg(F.max("_begin").alias("_last"))
    carried = last_begin.select("file", "block", "_chunk", F.last("_last", True).over(earlier).alias("_carried"))
    numbered = cut_lineage(begun.withColumn("_own", F.last("_begin", True).over(here)).join(
        carried, ["file", "block", "_chunk"]).select(*lines.columns, F.coalesce("_own", "_carried").alias("_record")))
    sizes = numbered.groupBy("file", "_record").agg(
        (F.sum(F.length("line") + 1) > LONGEST_CELL).alias("_long"), F.count("*").alias("_lines"))
    sized = numbered.join(sizes, ["file", "_record"]).select(*lines.columns, "_record", "_long", "_lines")
    alone = sized.where("_lines = 1 OR _long").select(*lines.columns)
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    joined = sized.where("_lines > 1 AND NOT _long").groupBy("file", "_record").agg(
        F.min("mtime").alias("mtime"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("line")).select(
        "file", "mtime", F.col("_record.block").alias("block"), "line", F.col("_record.at").alias("at"))
    return plain.unionByName(cut_lineage(alone.unionByName(joined)))


def header_at(names: Column, candidates: list[str]) -> Column:
    """0-based place of the name that equals a candidate, else of one that contains it."""
    low = F.transform(names, lambda n: F.lower(F.trim(F.coalesce(n, F.lit("")))))
    equal = [F.array_position(low, c) for c in candidates]

    def holds(candidate: str) -> Column:
        return F.array_position(F.transform(low, lambda n: n.contains(candidate)), True)

    inside = [holds(c) for c in candidates]
    return F.coalesce(*[F.when(spot > 0, (spot - 1).cast("int")) for spot in equal + inside])


def read_delimited(cells: DataFrame) -> DataFrame:
    """Link lists from cells (file, block, at, cells) of any number of .csv and .tsv files.

    A file's first row is its header if it holds a known column name, or if it is the only
    row that does not start with something like a URL. Without a header the first column is
    the URL and the second the target.
    """
    place = F.struct("block", "at")
    first = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    url_like = first.contains(".") & ~first.contains(" ")
    layout = cells.groupBy("file").agg(
        F.min_by("cells", place).alias("head"), F.min_by(url_like, place).alias("_like"),
        F.count_if(~url_like).alias("_unlike"), F.count("*").alias("_rows"), F.max(F.size("cells")).alias("_width"))
    known = F.exists("head", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(sorted(ALL_HEADERS)))
    headed = known | ~F.col("_like") & (F.col("_unlike") == 1) & (F.col("_rows") > 1)
    names = zip(BACKLINK_COLUMNS, (fixed.URL_HEADERS, fixed.TARGET_HEADERS, fixed.ANCHOR_HEADERS, fixed.NOTE_HEADERS))
    at = {name: F.when(headed, header_at(F.col("head"), words)) for name, words in names}
    at["url"] = F.coalesce(at["url"], F.lit(0))
    at["target"] = F.coalesce(at["target"], F.when(~headed & (F.col("_width") > 1), 1))
    layout = layout.select("file", F.when(headed, F.col("head")).alias("_head"), F.struct(*[
        c.alias(n) for n, c in at.items()]).alias("_at"))
    from anchorlake.operators.keyed import lookup

    rows = lookup(cells, layout, "file", key_source=cells.select("file"))
    is_header = F.coalesce(F.col("cells") == F.col("_head"), F.lower(first).isin(sorted(ALL_HEADERS)))
    values = [F.coalesce(F.get("cells", F.col(f"_at.{n}")), F.lit("")).alias(n) for n in BACKLINK_COLUMNS]
    return rows.where(~is_header).select(*values, "file", "block", "at").where(F.col("url") != "")


def read_plain(lines: DataFrame) -> DataFrame:
    """Text files of one URL per line; # starts a comment line."""
    line = F.trim("line")
    return lines.where((line != "") & ~line.startswith("#")).select(
        F.get(F.split(line, r"\s+"), F.lit(0)).alias("url"),
        *[F.lit("").alias(c) for c in BACKLINK_COLUMNS[1:]], "file", "block", "at")


def read_backlinks(spark: SparkSession, path: str, urls: list[str] | None = None) -> DataFrame:
    """All link lists under a path as (url, target, anchor, notes), normalised, first wins.

    Files count in name order, lines in file order; URLs given directly come first. All
    files are read in one pass, whatever their number; quoted cells may run over several lines.
    """
    lines = lines_of(spark, path)
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    lines = lines.where(~base.startswith("~$") & ~base.startswith(".") & base.rlike(r"\.(csv|tsv|txt)$"))
    if not urls and not lines.limit(1).count():
        raise FileNotFoundError(f"no link lists under {path}")
    found = read_delimited(split_cells(join_records(lines.where(base.rlike(r"\.(csv|tsv)$"))))).unionByName(
        read_plain(lines.where(base.endswith(".txt"))))
    if urls:
        found = found.unionByName(spark.createDataFrame(
            [(u, "", "", "given", "", 0, i) for i, u in enumerate(urls)],
            "url string, target string, anchor string, notes string, file string, block long, at long"))
    return dedup_first(found, ["file", "block", "at"]).select(*BACKLINK_COLUMNS)


def dedup_first(df: DataFrame, order: list[str], url_col: str = "url") -> DataFrame:
    """Normalise URLs, drop blanks, keep the first row of each URL."""
    clean = df.withColumn(url_col, normalize_url(F.col(url_col))).where(F.col(url_col) != "")
    return first_per_key(clean, [url_col], [F.col(c) for c in order])


_CHUNK = ["file", "block", "_chunk"]


def _before(lines: DataFrame, **values: Column) -> DataFrame:
    """``lines`` with the sum of each of ``values`` over all earlier lines of the same file.

    A running sum inside each run of lines and one sum per run; no file meets in one task.
    """
    here, files = W.partitionBy(*_CHUNK).orderBy("at"), W.partitionBy("file").orderBy("block", "_chunk")
    rows = lines.withColumns({f"_{name}_value": value for name, value in values.items()})
    sums = rows.groupBy(*_CHUNK).agg(*[F.sum(f"_{name}_value").alias(f"_{name}_sum") for name in values])
    starts = sums.select(*_CHUNK, *[
        (F.sum(f"_{name}_sum").over(files) - F.col(f"_{name}_sum")).alias(f"_{name}_start") for name in values])
    inside = {f"_{name}_inside": F.sum(f"_{name}_value").over(here) - F.col(f"_{name}_value") for name in values}
    return rows.withColumns(inside).join(starts, _CHUNK).select(*lines.columns, *[
        (F.col(f"_{name}_start") + F.col(f"_{name}_inside")).alias(name) for name in values])


def _latest(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """``lines`` with the last non-null ``value`` up to and with each line of its file."""
    here, files = W.partitionBy(*_CHUNK).orderBy("at"), W.partitionBy("file").orderBy("block", "_chunk")
    rows = lines.withColumn("_value", value)
    last = rows.groupBy(*_CHUNK).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("at"))).alias("_last"))
    carried = last.select(*_CHUNK, F.last("_last", True).over(
        files.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    return rows.withColumn("_own", F.last("_value", True).over(here)).join(carried, _CHUNK).withColumn(
        name, F.coalesce("_own", "_carried")).select(*lines.columns, name)


def document_rows(lines: DataFrame) -> DataFrame:
    """file, seq and JSON text of the elements of the top-level list ``rows`` of JSON documents.

    No string runs over a line break in JSON, so every line says by itself how it changes the
    nesting, and running sums over blocks give the nesting of every line however long a
    document is. Lines at the level of the list begin an element; elements that begin or end
    inside a line are found where the document has one line only.
    """
    bare = F.regexp_replace("line", r'"(?:[^"\\]++|\\.)*+"', '""')
    change = F.regexp_count(bare, F.lit(r"[{\[]")) - F.regexp_count(bare, F.lit(r"[}\]]"))
    leveled = cut_lineage(_before(
        lines.withColumn("_chunk", _chunk_of(F.col("at"))), _level=change, _line=F.lit(1)))
    key = F.regexp_extract("line", r'^\s*"((?:[^"\\]++|\\.)*+)"\s*:', 1)
    named = _latest(leveled, F.when((F.col("_level") == 1) & (key != ""), key), "_section")
    inner = named.where((F.col("_section") == "rows") & (F.col("_level") >= 2))
    begins = (F.col("_level") == 2) & F.trim("line").startswith("{")
    placed = _latest(inner, F.when(begins, F.col("_line")), "seq").where(
        "_level > 2 OR ltrim(line) LIKE '{%'")
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "line")))
    text = F.array_join(F.transform(parts, lambda p: p["line"]), " ")
    return placed.groupBy("file", "seq").agg(F.regexp_replace(F.trim(text), r",\s*$", "").alias("json"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of saved runs; ``seq`` grows with a row's place in its file.

    Runs that ``write_run`` saved are JSON lines. Documents with a list of ``rows`` over many
    lines are cut at the lines of that list, in parallel; a document that is one line is parsed
    by one task, and its rows are dealt out again.
    """
    lines = lines_of(spark, path)
    first = lines.where(F.trim("line") != "").groupBy("file").agg(
        F.min_by("line", F.struct("block", "at")).alias("_first"), F.count("*").alias("_lines"))
    # an object that is over in its first line, or goes on behind it
    whole = F.try_parse_json("_first").isNotNull()
    kinds = cut_lineage(first.select("file", F.when(~whole, "document").when(
        F.try_variant_get(F.try_parse_json("_first"), "$.rows", "array<variant>").isNotNull(), "line").otherwise(
        "rows").alias("_kind")))
    of = lambda kind: lines.join(kinds.where(F.col("_kind") == kind), "file", "left_semi")
    rows = of("rows").where(F.trim("line") != "").select(
        "file", F.monotonically_increasing_id().alias("seq"), F.col("line").alias("json"))
    single = of("line").select("file", F.posexplode(F.try_variant_get(
        F.try_parse_json("line"), "$.rows", "array<variant>")).alias("seq", "v")).repartition("file", "seq").select(
        "file", F.col("seq").cast("long").alias("seq"), F.to_json("v").alias("json"))
    found = rows.unionByName(document_rows(of("document"))).unionByName(single)
    rest = F.substring(F.trim("json"), 2, F.length("json"))
    run = F.try_url_decode(F.regexp_extract("file", "/run_id=([^/]+)/", 1))  # the folder of a saved run
    numbered = F.concat(F.lit('{"_seq":'), F.col("seq").cast("string"),
                        F.when(run != "", F.concat(F.lit(',"run_id":'), F.to_json(F.array(run)).substr(F.lit(2), F.length(F.to_json(F.array(run))) - 2))).otherwise(""),
                        F.when(F.trim(rest) == "}", "").otherwise(","), rest)
    folder = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    found.select(numbered.alias("value")).write.text(folder)
    return spark.read.json(folder).drop("seq").withColumnRenamed("_seq", "seq")


def select_rerun(rows: DataFrame, verdicts: list[str] | None, default_target: str = "") -> DataFrame:
    """Links of a saved run to audit again, optionally of some verdicts only."""
    from anchorlake.operators.columns import Row

    picked = rows if not verdicts else rows.where(
        F.col("verdict").isin([v.strip().upper() for v in verdicts]))
    r = Row(rows)
    items = picked.where(F.coalesce("url", F.lit("")) != "").select(
        "url", F.when(r.text("input_target") == "", default_target)
        .otherwise(r.text("input_target")).alias("target"),
        r.text("input_anchor").alias("anchor"), r.text("notes").alias("notes"), "seq")
    return dedup_first(items, ["seq"]).drop("seq")


# ------------------------------------------------------------ cell files -----
SKIPPED_NAMES = ["readme", "read-me", "instructions", "notes", "help"]


def split_cells(lines: DataFrame) -> DataFrame:
    """Lines of exports to cells: by delimiter for csv/tsv, by tabs or wide gaps for text.

    A file's delimiter is the one that cuts most of its lines into the same number of cells,
    more than one; quoted cells are honoured.
    """
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    delimited = base.rlike(r"\.(csv|tsv)$")
    cuts = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.regexp_count("line", F.lit(f"[{d}]")).alias("cuts"))
                               for i, d in enumerate(DELIMITERS)]))
    same = lines.where(delimited & (F.trim("line") != "")).select("file", cuts.alias("c")).groupBy(
        "file", "c.rank", "c.cuts").agg(F.count("*").alias("n"))
    separators = F.array(*[F.lit(d) for d in DELIMITERS])
    votes = same.groupBy("file").agg(F.max_by("rank", F.struct((F.col("cuts") > 0).alias("cut"), F.when(
        F.col("cuts") > 0, F.col("n")).alias("n"), (-F.col("rank")).alias("first"))).alias("rank"))
    from anchorlake.operators.keyed import lookup

    known = lookup(lines, votes.select("file", F.get(separators, F.col("rank")).alias("_sep")), "file")

    def by_delimiter(d: str) -> Column:
        """A row's own cells, however many: quoted ones, with doubled quotes, or plain ones."""
        cell = rf'(?:^|[{d}]) *+(?:"([^"]*+(?:""[^"]*+)*+)"[^{d}]*+|([^{d}]*+))'
        quoted = F.regexp_extract_all("line", F.lit(cell), F.lit(1))
        plain = F.regexp_extract_all("line", F.lit(cell), F.lit(2))
        return F.zip_with(quoted, plain, lambda q, p: F.trim(
            F.when(q != "", F.regexp_replace(q, '""', '"')).otherwise(p)))

    wide = F.split(F.trim("line"), r"\t+|\s{2,}")
    loose = F.when(F.size(wide) == 1, F.split(F.trim("line"), r"\s+")).otherwise(wide)
    cells = F.when(F.col("_sep").isNull(), loose)
    for d in DELIMITERS:
        cells = cells.when(F.col("_sep") == d, by_delimiter(d))
    return known.where(F.trim("line") != "").withColumn("cells", cells).drop("_sep")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Metric exports or sheets under a path as (file, mtime, row_no, cells)."""
    base = F.lower(F.element_at(F.split("file", "/"), -1))
    data = lines_of(spark, path).where(
        base.rlike(r"\.(csv|tsv|txt)$") & ~base.startswith("~$") & ~base.startswith(".")
        & ~F.substring_index(base, ".", 1).isin(SKIPPED_NAMES))
    delimited = base.rlike(r"\.(csv|tsv)$")
    records = join_records(data.where(delimited)).unionByName(data.where(~delimited))
    return split_cells(records).select("file", "mtime", F.struct("block", "at").alias("row_no"), "cells")


def read_sheet(cells: DataFrame) -> DataFrame:
    """Master-sheet cells to (file, row_no, host, da, spam_score, status, notes) texts.

    The first row with a host header names the columns, the first match per field counts; a file without one has its hosts in the first column.
    """
    from anchorlake.functions.text import clean_host_cell
    from anchorlake.operators.keyed import lookup
    from anchorlake.operators.metrics import _column_of, find_headers

    found = {k: _column_of(F.col("cells"), p) for k, p in fixed.SHEET_HEADERS.items()}
    headers = find_headers(cells, found["host"].isNotNull(), found)
    first_cell = cells.groupBy("file").agg(F.min_by(F.get("cells", F.lit(0)), "row_no").alias("_first"))
    bare = first_cell.where(clean_host_cell(F.col("_first")) != "").select("file", F.lit(True).alias("_bare"))
    rows = lookup(lookup(cells, headers, "file"), bare, "file")
    below = F.col("header_row").isNotNull() & (F.col("row_no") > F.col("header_row"))
    plain = F.col("header_row").isNull() & F.coalesce("_bare", F.lit(False))

    def cell(key: str) -> Column:
        named = F.when(F.col(f"at.{key}").isNotNull(), F.get("cells", F.col(f"at.{key}")))
        return F.coalesce(F.when(plain, F.get("cells", F.lit(0))).otherwise(named) if key == "host"
                          else named, F.lit(""))

    return rows.where(below | plain).select(
        "file", "row_no", *[cell(k).alias(k) for k in fixed.SHEET_HEADERS])


def read_disavow(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an uploaded disavow file."""
    from anchorlake.operators.report import parse_disavow

    return parse_disavow(lines_of(spark, path))
