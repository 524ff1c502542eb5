import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.functions.vptree import METRICS, Pivots, VPTree
from wayfold.operators import spatial

POINTS = "id long, x double, y double"


def brute_near(rows, r):
    ok = [p for p in rows if None not in p and all(math.isfinite(v) for v in p[1:])]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[:i] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= r * r}


def pairs(df, rel="near"):
    return sorted((r["left_id"], r["right_id"]) for r in df.collect() if r["rel"] == rel)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-200, 200), st.integers(-200, 200)), min_size=1, max_size=150), st.integers(1, 60))
def test_tree_finds_all_pairs_whatever_the_ties(places, radius):
    x, y = (np.array([p[i] for p in places], float) for i in (0, 1))
    q, p = VPTree(x, y, leaf=4).pairs_within(x, y, radius)
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= radius**2}
    assert set(zip(q.tolist(), p.tolist())) == want and len(q) == len(want)


@pytest.mark.parametrize("metric", list(METRICS))
def test_pivots_within_nearest(metric):
    rng = np.random.default_rng(3)
    px, py, qx, qy = rng.uniform(-60, 60, (4, 120))
    extra = rng.uniform(0, 30 if metric == "euclidean" else 2e6, 120)
    d = METRICS[metric][0](qx[:, None], qy[:, None], px[None], py[None])
    home, nearest, q, p, _ = Pivots(px, py, metric).within_nearest(qx, qy, extra)
    assert np.array_equal(home, d.argmin(1)) and np.allclose(nearest, d.min(1))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= d.min(1)[:, None] + extra[:, None]))}
    assert set(zip(q.tolist(), p.tolist())) == want


def test_near_and_inside_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(0, 60, (900, 2)) * 64) / 64)]
    rows += [(900 + i, 10.0, 10.0) for i in range(20)]  # one place many times
    square = [(0.0, 0.0), (0.0, 40.0), (40.0, 40.0), (40.0, 0.0), (0.0, 0.0)]
    hook = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (30.0, 50.0), (30.0, -30.0), (-50.0, -30.0)]
    shapes = spark.createDataFrame([(5001, [{"x": x, "y": y} for x, y in square]), (5002, [{"x": x, "y": y} for x, y in hook[::-1]])], "poly_id long, ring array<struct<x double, y double>>")
    rows += [(1000, 0.0, 20.0), (1001, 40.0, 40.0), (1002, 20.0, 20.0)]  # on a side, on a corner, inside
    for cell_rows in (50, 5000):
        out = spatial.nearby(spark.createDataFrame(rows, POINTS), 12.0, shapes, cell_rows=cell_rows)
        assert pairs(out) == sorted(brute_near(rows, 12.0))
        inside = {(i, 5001) for i, x, y in rows if 0 < x < 40 and 0 < y < 40}
        in_hook = lambda x, y: (-50 < x < 50 and -50 < y < -30) or (30 < x < 50 and -50 < y < 50)
        inside |= {(i, 5002) for i, x, y in rows if in_hook(x, y)}
        assert pairs(out, "inside") == sorted(inside)


def test_hot_cell_is_cut_into_slabs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SLAB_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 60, (400, 2)))]
    ring = [{"x": 5.0, "y": 5.0}, {"x": 55.0, "y": 5.0}, {"x": 55.0, "y": 55.0}]
    shapes = spark.createDataFrame([(9000 + i, ring) for i in range(90)], "poly_id long, ring array<struct<x double, y double>>")
    out = spatial.nearby(spark.createDataFrame(rows, POINTS), 5.0, shapes)
    assert pairs(out) == sorted(brute_near(rows, 5.0))
    one = sorted(i for i, x, y in rows if x < 55 and y > 5 and x > y)
    assert pairs(out, "inside") == sorted((i, 9000 + k) for k in range(90) for i in one)


def test_nulls_empty_tables_and_extra_columns(spark):
    rows = [(1, 0.0, 1.0, "a", 1), (2, None, 1.0, None, 2), (3, 0.0, float("nan"), "c", 3), (None, 0.0, 1.0, "d", 4), (5, float("inf"), 1.0, "e", 5), (6, 0.0, 13.0, "f", 6), (7, 0.0, 13.1, "g", 7)]
    points = spark.createDataFrame(rows, POINTS + ", cell string, home int")
    assert pairs(spatial.nearby(points, 12.0)) == [(1, 6), (6, 7)]
    shapes = spark.createDataFrame([(10, None), (11, []), (12, [{"x": 0.0, "y": 0.0}]), (13, [{"x": None, "y": 0.0}, {"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 1.0}]), (None, [{"x": -9.0, "y": -9.0}, {"x": 9.0, "y": -9.0}, {"x": 0.0, "y": 9.0}])], "poly_id long, ring array<struct<x double, y double>>")
    out = spatial.nearby(points, 12.0, shapes)
    assert pairs(out) == [(1, 6), (6, 7)] and pairs(out, "inside") == []
    assert spatial.nearby(points.limit(0), 12.0, shapes).collect() == []


def test_great_circle(spark):
    rows = [(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.0, 80.0), (4, 0.001, 80.0), (5, 179.9999, 10.0), (6, -179.9999, 10.0)]
    out = spatial.nearby(spark.createDataFrame(rows, POINTS), 50.0, metric="great_circle")
    assert pairs(out) == [(3, 4), (5, 6)]


def test_nearest_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (200, 2)))]
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (60, 2)))]
    want = {i: min(pts, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[0] for i, x, y in places}
    for chunk in (1000, 37):
        monkeypatch.setattr(spatial, "NEAREST_CHUNK", chunk)
        got = {r["id"]: r["nearest"] for r in spatial.nearest_points(spark.createDataFrame(places, POINTS), spark.createDataFrame(pts, POINTS)).collect()}
        assert got == want


def test_nearest_points_stay_in_their_cells(spark, monkeypatch):
    """Only pivots and sizes of cells go to the driver; a place that holds many points, far places and cut cells are right."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.normal(0, 50, (1500, 2)).round(2), np.full((600, 2), 7.0), [[5000.0, 5000.0], [-3000.0, 10.0]]])
    pts = [(5000 - i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 80, (80, 2)).round(2), [[7.0, 7.0], [1e6, 1e6], [-2000.0, 0.0]]]))]
    want = {i: min(pts, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[0] for i, x, y in places}
    monkeypatch.setattr(spatial, "NEAREST_CHUNK", 200)
    kind, most = type(spark.range(1)), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: most.append(len(rows := collect(self))) or rows)
    got = spatial.nearest_points(spark.createDataFrame(places, POINTS), spark.createDataFrame(pts, POINTS), cell_rows=100)
    assert max(most) <= 21
    assert {r["id"]: r["nearest"] for r in got.collect()} == want
