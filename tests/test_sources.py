import json

import pytest
from pyspark.sql import functions as F

from anchorlake.operators import master, metrics
from anchorlake.sources import readers, writers


def test_link_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Referring page,Target URL,Anchor,Notes\nmedium.com,t.com,\"best, tools\",n1\nhttps://x.com/p?a=1,,,\n,,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("https://y.com/1;t2.com\nhttps://medium.com;dup.com\n")
    (tmp_path / "c.txt").write_text("# comment\n\nz.com trailing words\nhttps://y.com/1\n")
    (tmp_path / "d.csv").write_text("domain\nlone.com\n")
    (tmp_path / "e.tsv").write_text("source url\tcomment\ntabbed.com\thello\n")
    (tmp_path / "~$lock.csv").write_text("junk.com\n")
    got = {r.url: (r.target, r.anchor, r.notes) for r in readers.read_backlinks(spark, str(tmp_path), ["given.com"]).collect()}
    assert got == {
        "https://given.com": ("", "", "given"), "https://medium.com": ("t.com", "best, tools", "n1"), "https://x.com/p?a=1": ("", "", ""),
        "https://y.com/1": ("t2.com", "", ""), "https://z.com": ("", "", ""), "https://lone.com": ("", "", ""), "https://tabbed.com": ("", "", "hello")}


def test_header_matching(rows):
    df = rows("names array<string>, id int", (["My Target Url", "Link", "URL "], 1), (["x", "the source page"], 2), (["x", None], 3))
    got = {r.id: r.at for r in df.select("id", readers.header_at(F.col("names"), ["url", "link"]).alias("at")).collect()}
    assert got == {1: 2, 2: None, 3: None}
    got = {r.id: r.at for r in df.select("id", readers.header_at(F.col("names"), ["source", "page"]).alias("at")).collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_delimiters_and_headerless_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a.com|b|c\nd.com|e,f|g\n")
    (tmp_path / "b.csv").write_text("page name\nc.com\nx.com/1,2\n")
    (tmp_path / "c.csv").write_text("one.com\n")
    got = {(r.url, r.target) for r in readers.read_backlinks(spark, str(tmp_path)).collect()}
    assert got == {("https://a.com", "b"), ("https://d.com", "e,f"), ("https://c.com", ""), ("https://x.com/1", ""), ("https://one.com", "")}


def test_metric_files(spark, tmp_path):
    (tmp_path / "README.txt").write_text("example.com   45   38   5\n")
    (tmp_path / "x.csv").write_text('title\nURL,DA,PA,SS,TB\nhttps://en.wikipedia.org/,98,82,1%,"2,340,111"\n')
    (tmp_path / "y.txt").write_text("example.com   45   38   5\nother.com\t7\nthird.com 8 9\n")
    cells = readers.read_cells(spark, str(tmp_path))
    got = {r.registered: (r.da, r.pa, r.spam_score, r.backlinks) for r in metrics.parse_metric_cells(cells).collect()}
    assert got == {"wikipedia.org": (98.0, 82.0, 1.0, 2340111.0), "example.com": (45.0, 38.0, 5.0, None),
                   "other.com": (7.0, None, None, None), "third.com": (8.0, 9.0, None, None)}


def test_master_sheet(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Sheet of 2024,,,,,\nDomain,DA,SS,Status,Domain,DA\ngood.com,50,1,No Issues,,\nbad.com,9,40,Spammy,,\n"
                                    "blog.x.com,N/A,,No Issues,,\nplain.com,5,2,,,\ngood.com,1,1,Spammy,,\n")
    (tmp_path / "bare.txt").write_text("only.com\nhttps://two.com/x\n")
    sheet = readers.read_sheet(readers.read_cells(spark, str(tmp_path)))
    merged = master.clean_sheet(sheet, F.col("file"))
    got = {r.host: (r.da, r.spam_score, r.status) for r in merged.collect()}
    assert got == {"good.com": (50.0, 1.0, "No Issues"), "bad.com": (9.0, 40.0, "Spammy"), "blog.x.com": (None, None, "No Issues"),
                   "plain.com": (5.0, 2.0, ""), "only.com": (None, None, ""), "two.com": (None, None, "")}


def test_runs_round_trip(spark, tmp_path):
    run = {"meta": {"when": "x"}, "rows": [{"url": "a.com", "verdict": "TOXIC"}, {"url": "https://b.com", "verdict": "GOOD"},
                                           {"url": "https://a.com", "verdict": "DEAD"}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    rows = readers.read_run(spark, str(tmp_path / "run.json"))
    picked = readers.select_rerun(rows, ["toxic", "dead"], "mine.com").collect()
    assert [(r.url, r.target) for r in picked] == [("https://a.com", "mine.com")]
    assert readers.select_rerun(rows, None).count() == 2

    path = str(tmp_path / "history")
    writers.append_run(rows, "r1", path)
    writers.append_run(rows.where("verdict = 'GOOD'"), "r2", path)
    writers.append_run(rows.where("verdict <> 'GOOD'"), "r1", path)
    kept = spark.read.parquet(path).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in kept} == {"r1": 2, "r2": 1}
    writers.write_run(rows, "r1", str(tmp_path / "full"))
    assert spark.read.json(str(tmp_path / "full")).count() == 3


def test_run_documents_of_many_lines_are_read_in_parts(spark, tmp_path):
    rows = [{"url": f"https://a{k}.com", "verdict": "GOOD", "note": ['x "{[" y', "a\\", "é\n", "}]"][k % 4],
             "inner": {"rows": [k, {"z": []}]}, "list": [[], {}]} for k in range(60)] + [{}]
    head = {"meta": {"rows": [{"url": "no"}], "when": "x"}, "anchors": None}
    documents = {"indented.json": json.dumps(head | {"rows": rows, "after": {"rows": [1]}}, indent=1),
                 "wide.json": json.dumps(head | {"rows": rows}, indent=4),
                 "single.json": json.dumps(head | {"rows": rows}), "none.json": json.dumps({"rows": []}, indent=1),
                 "lines.json": "\n".join(json.dumps(r) for r in rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3kb")
        for name, text in documents.items():
            (tmp_path / name).write_text(text)
            got = readers.read_run(spark, str(tmp_path / name)).collect() if name != "none.json" else []
            assert [r.url for r in sorted(got, key=lambda r: r.seq)] == ([r.get("url") for r in rows] if got else []), name
            assert {r.url: (r.note, r.inner.rows[0]) for r in got if r.url} == (
                {r["url"]: (r["note"], str(r["inner"]["rows"][0])) for r in rows if r} if got else {})
        assert readers.document_rows(readers.lines_of(spark, str(tmp_path / "none.json"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.com", "a.com", "TOXIC", True, None, "NET-1", "same IP 1", False),
                                  ("https://b.com", "b.com", "GOOD", False, 3.5, "", "", False)],
                                 "url string, registered string, verdict string, link_found boolean, da double, network_id string, network_signals string, free_subdomain boolean")
    view = writers.report_view(rows)
    assert len(view.columns) == 86
    first = view.where("URL = 'https://a.com'").first()
    assert (first["Link live?"], first["DA"], first["Words"]) == ("YES", "", "")
    writers.write_report(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    writers.write_partitions(rows, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("verdict = 'GOOD'").count() == 1
    writers.write_disavow(rows, str(tmp_path / "disavow"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "disavow")).collect()]
    assert lines == ["#   NET-1: same IP 1", "domain:a.com"]
    assert [r.entry for r in readers.read_disavow(spark, str(tmp_path / "disavow")).collect()] == ["domain:a.com"]


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_backlinks(spark, str(tmp_path))


def csv_rows(text, delimiter):
    import csv
    import io

    return [[c.strip() for c in row] for row in csv.reader(io.StringIO(text), delimiter=delimiter) if any(row)]


def test_records_over_several_lines_are_those_of_a_csv_reader(spark, tmp_path):
    import random

    draw = random.Random(4)
    cells = ["plain", "", 'say "hi"', "two\nlines", "a, b; c", 'open "', "\n\n", '5" pipe', "x" * 50, 'q"\n"q', "tab\tin", "é"]
    want = {}
    for k in range(8):
        delimiter = ",;\t|"[k % 4]
        lines = []
        for _ in range(draw.randint(1, 60)):
            row = []
            for c in [f"https://a{len(lines)}.com"] + [draw.choice(cells if k % 3 else cells[:2]) for _ in range(2)]:
                quoted = any(x in c for x in (delimiter, "\n")) or c.startswith('"') or draw.random() < 0.2
                row.append('"' + c.replace('"', '""') + '"' if quoted else c)
            lines.append(delimiter.join(row))
        text = "\n".join(lines) + "\n"
        (tmp_path / f"f{k:02}.csv").write_text(text, encoding="utf-8")
        want[f"f{k:02}.csv"] = csv_rows(text, delimiter)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1kb", before):  # many blocks a file, then one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.split_cells(readers.join_records(readers.lines_of(spark, str(tmp_path)))).collect()
            got = {name: [[c.strip() for c in r.cells] for r in sorted(rows, key=lambda r: (r.block, r.at))
                          if r.file.endswith(name)] for name in want}
            for name in want:
                assert got[name] == [r for r in want[name] if any(r)], name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_link_is_invented_from_a_cell_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfurl,anchor,notes\n"https://a.com/1","two\nlines, more","n"\nhttps://b.com,caf\xe9,\n')
    (tmp_path / "b.tsv").write_text("https://c.com\t\tx\nhttps://d.com\tt.com\ty\n")
    got = sorted((r.url, r.target, r.anchor, r.notes) for r in readers.read_backlinks(spark, str(tmp_path)).collect())
    assert got == [("https://a.com/1", "", "two\nlines, more", "n"), ("https://b.com", "", "caf", ""),
                   ("https://c.com", "", "", ""), ("https://d.com", "t.com", "", "")]


def test_a_quote_that_is_never_closed_swallows_no_links(spark, tmp_path):
    rows = "".join(f"https://s{k}.com,{'word ' * 30}\n" for k in range(2000))
    (tmp_path / "a.csv").write_text('https://first.com,"never closed\n' + rows)
    assert readers.read_backlinks(spark, str(tmp_path)).count() == 2001


def test_long_documents_and_lists_are_cut_into_short_runs_of_lines(spark, tmp_path, monkeypatch):
    from anchorlake.sources import readers

    monkeypatch.setattr(readers, "CHUNK_BITS", 2)  # four lines to a run
    rows = [f'  {{"url": "https://u{i}.com",\n   "verdict": "GOOD",\n   "notes": "[{{"\n  }}' for i in range(30)]
    (tmp_path / "d.json").write_text('{"meta": {\n "rows": [1]\n},\n"rows": [\n' + ",\n".join(rows) + "\n]}\n")
    got = readers.read_run(spark, str(tmp_path / "d.json")).orderBy("seq").collect()
    assert [r.url for r in got] == [f"https://u{i}.com" for i in range(30)] and {r.notes for r in got} == {"[{"}
    (tmp_path / "l.csv").write_text("url,anchor\n" + "".join(f'https://v{i}.com/,"a\n\n\n\n\n{i}"\n' for i in range(9)))
    lines = readers.join_records(readers.lines_of(spark, str(tmp_path / "l.csv")))
    assert lines.count() == 10 and lines.where("line LIKE '%\n8\"'").count() == 1
