import random

from pyspark.sql import functions as F

from wayfold.llm import topn


def brute(rows, n):
    groups = {}
    for g, b, s, r in rows:
        if s is not None and s == s:
            groups.setdefault((g, b), []).append((-s, r))
    return {(g, b, r, i) for (g, b), v in groups.items() for i, (s, r) in enumerate(sorted(v)[:n], 1)}


def run(df, n, hot=64):
    out = topn.top_n_per_group(df, ["g", "b"], "s", ["r"], n, hot_rows=hot).collect()
    return {(x["g"], x["b"], x["r"], x["place"]) for x in out}


def test_against_brute_force_with_a_hot_group(spark):
    random.seed(1)
    rows = [(1, 1, float(random.randrange(50)), i) for i in range(3000)]  # many ties in a group of half of all rows
    rows += [(random.choice([None, *range(2, 300)]), random.randrange(2), random.choice([None, float("nan"), 1.0, 2.5, -3.0, float("inf")]), 3000 + i) for i in range(2500)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, b int, s double, r long").repartition(7)
    for n, hot in ((3, 1), (3, 64), (1, 1), (10, 10**9)):
        assert run(df, n, hot) == brute(rows, n)


def test_shuffle_join_of_many_bounds(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_ROWS", 0)
    rows = [(i % 5, 0, float(i), i) for i in range(200)]
    assert run(spark.createDataFrame(rows, "g long, b int, s double, r long").repartition(3), 2, 1) == brute(rows, 2)


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 7, "x", 9), (1, 1, 5.0, 7, "y", 9)], "g long, b int, s double, r long, __x string, place int")
    out = topn.top_n_per_group(df, ["g", "b"], "s", ["r"], 3).collect()
    assert sorted(x["place"] for x in out) == [1, 2] and {x["__x"] for x in out} == {"x", "y"}
    assert topn.top_n_per_group(df.limit(0), ["g", "b"], "s", ["r"], 3).collect() == []
    assert topn.top_n_per_group(df, ["g", "b"], "s", ["r"], 0).collect() == []


def test_a_bound_never_drops_a_winner(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("g"), F.lit(0).alias("b"), (F.hash("id") % 1000).cast("double").alias("s"), F.col("id").alias("r")).repartition(13)
    want = [r["r"] for r in df.orderBy(F.desc("s"), "r").limit(5).collect()]
    got = topn.top_n_per_group(df, ["g", "b"], "s", ["r"], 5).orderBy("place").collect()
    assert [r["r"] for r in got] == want
