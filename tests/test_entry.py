import importlib
import sys

import __spark_entry__ as entry


def test_contract(spark, small):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90


def test_queries_match_their_sql(spark, small):
    """A cross-section of the SQL comparison that runs on all queries elsewhere."""
    import duckdb

    con = duckdb.connect()
    import os

    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{small}/{f}')")
    q, o = entry.queries(), entry.oracle_sql()
    for name in ("sssp_cutoff", "access_by_origin", "p1_found", "knn_weights", "opt_gap", "route_utility", "contract_chains"):
        got = q[name](spark, small).toPandas()
        want = con.execute(o[name]).df()[list(got.columns)]
        key = lambda d: sorted(map(tuple, d.round(5).astype(object).where(d.notna(), None).values.tolist()), key=str)
        assert key(got) == key(want), name


def test_the_rest_works_without_the_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "wayfold.llm", None)
    try:
        bare = importlib.reload(entry)
        assert "p1_found" in bare.queries() and not any(n.startswith(("p2_", "p8_")) for n in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
