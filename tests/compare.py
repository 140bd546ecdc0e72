"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def expected(folder, sql):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.sql(sql)
    return list(result.columns), result.fetchall()


def compare(spark, folder, name, queries, oracles):
    start = time.time()
    df = queries[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in oracles:
        return True, f"{len(got)} rows, no SQL", took
    names, rows = expected(folder, oracles[name])
    want = rows_of(names, rows)
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    if got == want:
        return True, f"{len(got)} rows", took
    missing = [r for r in want if r not in set(got)][:2] if len(want) < 200_000 else []
    extra = [r for r in got if r not in set(want)][:2] if len(got) < 200_000 else []
    return False, f"{len(got)} vs {len(want)} rows; columns {sorted(names)}; want {missing}; got {extra}", took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from anchorlake.session import local_session

    spark = local_session(8)
    folder = f"/root/testdata/sf{sys.argv[1]}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [q for q in queries if any(q.startswith(a) for a in sys.argv[2:])] if len(sys.argv) > 2 else queries
    bad = 0
    for q in wanted:
        try:
            ok, note, took = compare(spark, folder, q, queries, oracles)
        except Exception as exc:  # report and go on with the next query
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q:28} {took:6.2f}s {note}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} match")
