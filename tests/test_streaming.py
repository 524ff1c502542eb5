import datetime as dt

from wayfold.streaming.rows import keep_rows_in_use

SCHEMA = "k long, at timestamp, v double"


def test_late_rows_replace_earlier_ones(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    batches = [[(1, day(1), 1.0), (2, day(5), 2.0)], [(1, day(3), 9.0), (2, day(4), 7.0), (3, day(1), None)]]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        keep_rows_in_use(stream, out, cp, ["k"], "at", ["v"]).awaitTermination()
    rows = {r["k"]: r["v"] for r in spark.read.parquet(f"{out}/1").collect()}
    assert rows == {1: 9.0, 2: 2.0, 3: None}
