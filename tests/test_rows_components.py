import datetime as dt

from pyspark.sql import functions as F

from wayfold.operators.components import components
from wayfold.operators.rows import rows_in_use


def test_rows_in_use(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, t[0], 1.0), (1, t[1], 2.0), (1, t[1], 2.0), (1, t[2], None), (2, t[0], 5.0), (2, t[0], 7.0), (None, t[0], 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, at timestamp, v double")
    got = {r["k"]: r["v"] for r in rows_in_use(df, ["k"], "at", ["v"], F.col("v").isNotNull()).collect()}
    assert got == {1: 2.0, 2: 7.0}
    assert rows_in_use(df.limit(0), ["k"], "at", ["v"]).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (101, 102), (7, 7), (None, 5)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100 and got[259] == 200 and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
