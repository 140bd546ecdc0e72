import random

from pyspark.sql import functions as F

from anchorlake.operators.keyed import Ordered, first_per_key, last_per_key, lookup


def test_first_and_last_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS at", "concat('v', id) AS v")
    for parts in (1, 5, 40):
        got = {r.k: (r.at, r.v) for r in first_per_key(df.repartition(parts), ["k"], [F.col("at")]).collect()}
        assert got == {k: (k, f"v{k}") for k in range(7)}
        last = {r.k: r.at for r in last_per_key(df.repartition(parts), ["k"], [F.col("at")]).collect()}
        assert last == {k: max(range(k, 1000, 7)) for k in range(7)}


def test_lookup_hot_null_and_missing_keys(spark):
    left = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN NULL ELSE concat('k', id % 20) END AS k")
    right = spark.createDataFrame([("hot", 1, "x"), ("k4", 2, None), ("k7", None, "z")], "k string, a int, b string")
    plain = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "a", "b").collect()), key=str)
    for source in (None, left):
        out = lookup(left, right, "k", key_source=source, hot_keys=20)
        assert out.columns == ["id", "k", "a", "b"]
        assert sorted(map(tuple, out.collect()), key=str) == plain


def test_ordered_numbers_and_previous(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "hot", "hot", "hot", "z"]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, ts int, id int")
    order = [F.col("k"), F.col("ts"), F.col("id")]
    cut = Ordered(df.repartition(7), order, parts=9)
    assert cut.rows.select("_range").distinct().count() > 3
    expected = sorted(data)
    numbered = {r.id: r.n for r in cut.numbered("n").collect()}
    assert numbered == {row[2]: i for i, row in enumerate(expected, 1)}
    previous = {r.id: r.prev for r in cut.with_previous("k", "ts", "prev").collect()}
    want = {row[2]: (expected[i - 1][1] if i and expected[i - 1][0] == row[0] else None) for i, row in enumerate(expected)}
    assert previous == want


def test_ordered_descending_rank(spark):
    df = spark.range(100).selectExpr("id", "CAST(id % 10 AS double) AS da")
    ranked = Ordered(df, [F.desc("da"), F.col("id")], parts=5).numbered("n")
    got = [r.id for r in ranked.orderBy("n").collect()]
    assert got == sorted(range(100), key=lambda i: (-(i % 10), i))
