from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.sources import files


def test_missing_dump_load_and_memo(spark, tmp_path):
    assert files.load(spark, str(tmp_path / "none.csv")) == (None, False)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for name in ("t.csv", "t.parquet"):
        files.dump(df, str(tmp_path / name))
        back, there = files.load(spark, str(tmp_path / name))
        assert there and sorted(map(tuple, back.collect()), key=str) == [(1, "a"), (2, None)]
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert files.memoised(spark, str(tmp_path / "memo"), make).count() == 2
    assert calls == [1]


def test_resume_computes_each_key_once(spark, tmp_path):
    work = spark.createDataFrame([(i,) for i in range(5)], "k int")
    go = lambda d: d.withColumn("v", F.col("k") * 10)
    assert files.resume(spark, str(tmp_path / "r"), work.filter("k < 3"), ["k"], go).count() == 3
    assert files.resume(spark, str(tmp_path / "r"), work, ["k"], go).count() == 5
    assert files.resume(spark, str(tmp_path / "r"), work, ["k"], go).count() == 5


def test_chunks_lines_and_literals(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 0.5, 1.0, 2.0)], "c int, a double, b double, x double, y double")
    files.write_chunks(df, str(tmp_path / "c"), "c")
    assert files.corpus(spark, str(tmp_path / "c")).count() == 1
    line = files.line_geometry(df, "a", "b", "x", "y").first()["geometry"]
    assert line == '{"type":"LineString","coordinates":[[0.0,0.5],[1.0,2.0]]}'
    t = spark.createDataFrame([("[1, 2]",), ("[]",), ("x",), (None,)], "s string")
    assert [r[0] for r in t.select(C.list_literal(F.col("s"))).collect()] == [[1, 2], [], None, None]


def test_vectors_are_kept(spark, tmp_path):
    from wayfold.operators import walks

    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "id long, vec array<double>")
    for _ in range(2):
        walks.save_vectors(df, str(tmp_path / "v"))
    assert sorted(map(tuple, walks.load_vectors(spark, str(tmp_path / "v")).collect())) == [(1, [0.5, 1.0]), (2, None)]
