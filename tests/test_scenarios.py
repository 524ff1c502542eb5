from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

EVENTS = [
    (1, 1, "click", 3.0), (2, 1, "click", 4.0), (3, 2, "click", None), (4, 3, "click", 1.5), (5, 2, "view", 9.0),
    (6, 3, "view", 2.0), (7, None, "view", 8.0), (8, 4, None, 5.0), (9, 4, "error", 7.0), (10, 1, "error", 0.25),
]


@pytest.mark.parametrize("name", ["std_by_od", "distributional_features", "utility_similarity", "ratio_similarity"])
def test_events_without_a_scenario_item_or_value(spark, tmp_path, name):
    """A scenario that is null is one of all zeros, an item that is null too; a mean that is null is 0."""
    day = datetime(2024, 1, 5)
    rows = [(i, day, u, t, v) for i, u, t, v in EVENTS]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) >= 2


def test_many_scenarios(spark, tmp_path):
    """Work goes with the cells, not with scenarios times scenarios: a minute and more where each element is looked up in a map."""
    from wayfold.plans import vectors

    e = spark.range(120_000).selectExpr("id user_id", "timestamp '2024-01-05 00:00:00' ts", "if(id % 3 = 0, 'view', 'click') event_type", "double(id % 7) value")
    rows = {r["id"]: r for r in vectors.scenario_vectors(e).selectExpr("id", "size(vec) n", "aggregate(vec, 0d, (s, x) -> s + x) total", "vec[3] a", "vec[4] b").collect()}
    assert len(rows) == 2 and {r["n"] for r in rows.values()} == {120_000}
    assert sum(r["total"] for r in rows.values()) == sum(i % 7 for i in range(120_000))
    assert sorted((r["a"], r["b"]) for r in rows.values()) == [(0.0, 4.0), (3.0, 0.0)]
