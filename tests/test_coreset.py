import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import coreset, learn, report, similarity, walks

ITEMS = "id long, vec array<double>, worth double"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 5))
    return v, spark.createDataFrame([(i, v[i].tolist(), float(1 + i % 4)) for i in range(120)], ITEMS)


@pytest.mark.parametrize("chunk", [1000, 7])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest(items, metric, chunk, monkeypatch):
    monkeypatch.setattr(coreset, "CHUNK_ROWS", chunk)
    v, df = items
    reps = df.filter("id % 6 = 0")
    ids = list(range(0, 120, 6))
    d = np.round(coreset.distances(v, v[ids], metric), 9)
    want = {(i, ids[j]) for i in range(120) for j in sorted(range(20), key=lambda j: (d[i, j], ids[j]))[:3]}
    assert {(r["id"], r["rep"]) for r in coreset.nearest(df, reps, 3, metric).collect()} == want


def test_weights_keep_the_total_and_whole_sets_keep_their_own(items):
    _, df = items
    reps = df.filter("id % 10 = 0")
    w = coreset.assignment_weights(df, reps, coreset.nearest(df, reps, 3).select("id", "rep"))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(df.agg(F.sum("worth")).first()[0])
    same = coreset.assignment_weights(df, df, coreset.nearest(df, df, 1).select("id", "rep"))
    assert same.join(df, same.rep == df.id).filter("abs(weight - worth) > 1e-9").count() == 0 and same.count() == 120


def test_k_center_and_median_are_reasonable_and_repeatable(items):
    v, df = items
    a = coreset.k_center(df, 12, seed=1).orderBy("rank").collect()
    assert [r["id"] for r in a] == [r["id"] for r in coreset.k_center(df.repartition(3), 12, seed=1).orderBy("rank").collect()]
    assert len({r["id"] for r in a}) == 12
    m = coreset.p_median(df, 6, seed=2, rounds=3, swaps=2).collect()
    start = [r["id"] for r in coreset.uniform_sample(df, 6, 2).collect()]
    cost = lambda ids: (coreset.distances(v, v[ids], "cosine").min(1) * np.array([1 + i % 4 for i in range(120)])).sum()
    assert m[0]["obj"] == pytest.approx(cost([r["id"] for r in m]), abs=1e-6) and m[0]["obj"] <= cost(start) + 1e-9


def test_sample_is_exact_and_seeded(items):
    _, df = items
    a = {r["id"] for r in coreset.uniform_sample(df, 30, 0).collect()}
    assert len(a) == 30 and a == {r["id"] for r in coreset.uniform_sample(df.repartition(5), 30, 0).collect()}
    assert a != {r["id"] for r in coreset.uniform_sample(df, 30, 1).collect()}


def test_pair_scores_cover_all_pairs_once(spark, items, monkeypatch):
    v, df = items
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 17)
    got = {(r["i"], r["j"]): r["w"] for r in similarity.pair_scores(df, similarity.co_connection).collect()}
    assert len(got) == 120 * 119 // 2 and got[3, 77] == pytest.approx(v[3] @ v[77])


def test_walks_follow_edges(spark):
    g = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 1, 3.0), (4, 9, 1.0), (1, 4, 0.0)], "i long, j long, w double")
    rows = walks.random_walks(g, 20, 6, seed=1).collect()
    ok = {(1, 2), (2, 3), (2, 1), (4, 9)}
    assert len(rows) == 60 and all((a, b) in ok for r in rows for a, b in zip(r["nodes"], r["nodes"][1:]))
    assert all(len(r["nodes"]) == 2 for r in rows if r["start"] == 4)
    again = walks.random_walks(g.repartition(3), 20, 6, seed=1).collect()
    assert sorted(map(tuple, [(r["round"], r["start"], tuple(r["nodes"])) for r in rows])) == sorted((r["round"], r["start"], tuple(r["nodes"])) for r in again)


def test_regressions_recover_a_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = 2 + x @ np.array([1.0, 0.0, -3.0])
    y[:10] += 500  # outliers that absolute error shrugs off
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(300)], "id long, vec array<double>, y double")
    assert learn.absolute_lasso(df, 0.0) == pytest.approx([2, 1, 0, -3], abs=0.02)
    clean = df.filter("id >= 10")
    assert learn.least_squares(clean) == pytest.approx([2, 1, 0, -3], abs=1e-6)
    p = learn.predict_hidden(clean, learn.hidden_layer(clean, epochs=400))
    assert learn.mean_absolute_error(p) < 0.7


def test_as_of_and_quantiles(spark):
    steps = spark.createDataFrame([("a", 5.0, 1), ("a", 10.0, 2), ("b", 7.0, 3)], "k string, at double, v int")
    levels = spark.createDataFrame([("a", 4.0), ("a", 10.0), ("b", 100.0)], "k string, at double")
    got = {(r["k"], r["at"]): r["v"] for r in report.as_of(levels, "at", steps, "at", ["v"], ["k"]).collect()}
    assert got == {("a", 4.0): None, ("a", 10.0): 2, ("b", 100.0): 3}
    import pandas as pd

    vals = [1.0, 1.0, 2.0, 3.0, 8.0, 9.0, 9.5, 20.0, 21.0, 30.0, 30.0]
    q = report.quantile_group(spark.createDataFrame([(v,) for v in vals], "v double"), "v", 5, "g")
    want = list(pd.qcut(pd.Series(vals), 5, labels=False) + 1)
    assert sorted((r["v"], r["g"]) for r in q.collect()) == sorted(zip(vals, want))


def test_regression_weights_equal_fit_then_predict(spark, items):
    v, df = items
    reps = df.filter("id % 4 = 0")
    w = {r["rep"]: r["weight"] for r in learn.regression_weights(df, reps, ridge=1e-9).collect()}
    rng = np.random.default_rng(8)
    value = rng.normal(size=120)
    worth = np.array([1.0 + i % 4 for i in range(120)])
    inside = np.arange(120) % 4 == 0
    x = np.concatenate([np.ones((120, 1)), v], 1)
    beta = np.linalg.lstsq(x[inside], value[inside], rcond=None)[0]
    want = (worth[inside] * value[inside]).sum() + (worth[~inside] * (x[~inside] @ beta)).sum()
    assert sum(w[i] * value[i] for i in np.flatnonzero(inside)) == pytest.approx(want, rel=1e-6)


def test_nth_greatest_by_counting(spark, monkeypatch):
    """The same place by counting as by ordering: ties, infinities, one value for all rows."""
    import random

    random.seed(5)
    for rows in ([(float(random.choice([1, 2, 2.5, 9])), i) for i in random.sample(range(10_000), 700)], [(random.random(), i) for i in range(700)], [(3.0, i) for i in range(700)], [(float("inf"), 1), (float("inf"), 0)] + [(1.0 / (1 + i), i) for i in range(2, 700)]):
        df = spark.createDataFrame(rows, "v double, id long").cache()
        want = sorted(rows, key=lambda r: (-r[0], r[1]))
        monkeypatch.setattr(coreset, "TOP_ROWS", 40)
        assert [coreset.nth_greatest(df, "v", "id", n) for n in (1, 41, 300, 700)] == [want[n - 1] for n in (1, 41, 300, 700)]
    few = {r["id"] for r in coreset.uniform_sample(df.select("id"), 300, 7).collect()}
    monkeypatch.setattr(coreset, "TOP_ROWS", 10_000)
    assert len(few) == 300 and few == {r["id"] for r in coreset.uniform_sample(df.select("id"), 300, 7).collect()}


def test_constrained_medians(spark):
    import random

    random.seed(6)
    items = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(4)], 1.0) for i in range(60)], "id long, vec array<double>, worth double")
    chosen = coreset.p_median(items, 6, seed=2, rounds=2, swaps=1, restarts=2)
    first = {r["id"] for r in chosen.collect()}
    again = {r["id"]: r["kept"] for r in coreset.perturbed_median(items, chosen, seed=1).collect()}
    assert len(again) == len(first) == 6 and {i for i, k in again.items() if k} <= first
    assert sum(again.values()) == 3 and not {i for i, k in again.items() if not k} & first
    with pytest.raises(ValueError):
        coreset.p_median(items, 3, metric="euclidean")


def test_weights_of_blends_add_up(spark):
    """Weights times values are the totals that the blends predict directly."""
    import random

    random.seed(7)
    rows = [(i, [random.gauss(0, 1) for _ in range(3)], float(1 + i % 4), random.gauss(2, 1)) for i in range(80)]
    items = spark.createDataFrame(rows, "id long, vec array<double>, worth double, y double")
    reps = items.filter("id % 8 = 0")
    near = coreset.nearest(items, reps, 1).select("id", "rep")
    y = {r[0]: r[3] for r in rows}
    total = sum(r["weight"] * y[r["rep"]] for r in learn.boosted_weights(items, reps, near).collect())
    assert total == pytest.approx(learn.boosted_total(items, reps, near).first()["total"])
    parts = [sum(r["weight"] * y[r["rep"]] for r in w.collect()) for w in (coreset.assignment_weights(items, reps, near), learn.regression_weights(items, reps))]
    blend = sum(r["weight"] * y[r["rep"]] for r in learn.bagged_weights(items, reps, near, 0.25).collect())
    assert blend == pytest.approx(0.25 * parts[0] + 0.75 * parts[1])
