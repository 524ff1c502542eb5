import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import cluster, neighbors, vectors
from wayfold.llm.hnsw import HNSW

ROWS = "od_id long, feature array<double>, pivot long, cell int"


def make(seed=0, clusters=40, singles=60, hot=400, d=16):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(singles, d))]
    for _ in range(clusters):
        c = rng.normal(size=d)
        parts.append(c / np.linalg.norm(c) + rng.normal(scale=0.045, size=(rng.integers(1, 12), d)))
    c = rng.normal(size=d)
    parts.append(c / np.linalg.norm(c) + rng.normal(scale=0.02, size=(hot, d)))  # a third of all rows in one spot
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    parts.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 2.5, 14)]))  # a chain: linked through others
    m = np.concatenate(parts)
    m = np.concatenate([m, m[:3]])  # repeated vectors
    return rng.permutation(m)


def frame(spark, m):
    return spark.createDataFrame([(i * 3 + 1, v.tolist(), 5, 6) for i, v in enumerate(m)], ROWS)


def cosines(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def linked(m, threshold, least):
    s, n = cosines(m) >= threshold, len(m)
    label = np.arange(n)
    while True:
        new = np.array([label[s[i]].min() for i in range(n)])
        if (new == label).all():
            break
        label = new
    return {(int(label[i]) * 3 + 1, i * 3 + 1) for i in range(n) if (label == label[i]).sum() >= least}


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("slab", [40_000, 60])
def test_linked_groups_are_exact(spark, monkeypatch, seed, slab):
    monkeypatch.setattr(cluster, "SLAB_ROWS", slab)
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    if seed:
        monkeypatch.setattr(cluster, "NEAREST_FIRST", 1)
    m = make(seed)
    c = cluster.pivot_clusters(frame(spark, m), "od_id", "feature", 0.95)
    got = {(r["first_id"], r["id"]) for r in cluster.linked_groups(c, 0.95, 3).collect()}
    assert got == linked(m, 0.95, 3)


def test_clusters_cover_all_rows_and_pivots_are_apart(spark):
    m = make(2)
    s = cosines(m)
    c = cluster.pivot_clusters(frame(spark, m), "od_id", "feature", 0.95)
    rows = {r["id"]: r["pivot"] for r in c.collect()}
    at = lambda i: (i - 1) // 3
    assert len(rows) == len(m) and all(s[at(i), at(p)] >= 0.95 for i, p in rows.items())
    heads = sorted(set(rows.values()))
    assert all(s[at(a), at(b)] < 0.95 for a in heads for b in heads if a != b)
    again = cluster.pivot_clusters(frame(spark, m[::1]).repartition(5), "od_id", "feature", 0.95)
    assert {r["id"]: r["pivot"] for r in again.collect()} == rows
    moved = {r["id"]: r["pivot"] for r in cluster.closest_pivots(c, 0.95).collect()}
    for i, p in moved.items():
        best = i if i in heads else min(heads, key=lambda h: (-(m[at(i)] @ m[at(h)]) / np.linalg.norm(m[at(h)]), h))
        assert p == best or abs(s[at(i), at(p)] - s[at(i), at(best)]) < 1e-5


def test_typical_members(spark):
    m = make(3, hot=50)
    c = cluster.pivot_clusters(frame(spark, m), "od_id", "feature", 0.95)
    of = {}
    for r in c.collect():
        of.setdefault(r["pivot"], []).append(r["id"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in cluster.typical_members(c).collect():
        ids = sorted(of[r["cluster"]])
        v = u[[(i - 1) // 3 for i in ids]]
        score = np.round(v @ v.sum(0), 9)
        want = [ids[k] for k in np.lexsort((ids, -score))[:3]]
        assert r["members"] == len(ids) and r["typical"] == want and r["medoid"] == want[0]


def test_empty_and_damaged_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, float("nan")]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0, 2.0]), (7, [float("inf"), 1.0]), (8, [1e200, 2e200])]
    df = spark.createDataFrame(rows, "od_id long, feature array<double>")
    ok = df.filter(vectors.usable_vector("feature", 2))
    assert sorted(r["od_id"] for r in ok.collect()) == [6, 7, 8]
    c = cluster.pivot_clusters(ok, "od_id", "feature", 0.95)
    assert sorted(r["id"] for r in c.collect()) == [6, 8]
    assert [(r["id"], r["other"]) for r in neighbors.nearest_vectors(ok, "od_id", "feature", 3, 0.95).orderBy("id").collect()] == [(6, 8), (8, 6)]
    none = ok.limit(0)
    assert cluster.pivot_clusters(none, "od_id", "feature", 0.95).collect() == []
    assert cluster.linked_groups(cluster.pivot_clusters(none, "od_id", "feature", 0.95), 0.95).collect() == []
    assert neighbors.nearest_vectors(none, "od_id", "feature").collect() == []


def test_graph_recall():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = HNSW(v, 16, 64)
    ids, sims = g.search(v[:300], 64)
    s = v[:300] @ v.T
    want = np.argsort(-s, 1)[:, :5]
    recall = np.mean([len(set(ids[i]) & set(want[i])) / 5 for i in range(300)])
    assert recall >= 0.9 and (np.diff(sims, axis=1) <= 1e-6).all()
    assert HNSW(v[:0]).search(v[:2], 4)[0].tolist() == [[-1] * 4] * 2
    assert HNSW(v[:1]).search(v[:1], 4)[0][0].tolist() == [0, -1, -1, -1]
    assert set(HNSW(np.repeat(v[:1], 50, 0)).search(v[:1], 8)[0][0]) <= set(range(50))


@pytest.mark.parametrize("limits", [{}, {"MOST_SHARD_ROWS": 150, "QUERY_ROWS": 120, "SHARD_ROWS": 100}])
def test_neighbours_reach_the_recall(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(neighbors, k, v)
    m = make(4)
    s = cosines(m)
    np.fill_diagonal(s, -9)
    want = set()
    for i in range(len(m)):
        near = [j for j in np.lexsort((np.arange(len(m)), -s[i]))[:3] if s[i, j] >= 0.95]
        want |= {(i * 3 + 1, j * 3 + 1) for j in near}
    out = neighbors.nearest_vectors(frame(spark, m), "od_id", "feature", 3, 0.95).collect()
    got = {(r["id"], r["other"]) for r in out}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert max(r["place"] for r in out) <= 3 and all(r["id"] != r["other"] for r in out)


def test_recall_on_the_tables(spark):
    """Queries are all rows whose id divides by 20, against all rows, computed in full."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    from wayfold.llm.queries import vectors_in_use

    used = vectors_in_use(spark, sf)
    rows = used.orderBy("od_id").collect()
    ids = np.array([r["od_id"] for r in rows])
    s = cosines(np.array([r["feature"] for r in rows]))
    np.fill_diagonal(s, -9)
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 20 == 0) for j in np.lexsort((ids, -s[i]))[:3] if s[i, j] >= 0.95}
    got = {(r["id"], r["other"]) for r in neighbors.nearest_vectors(used, "od_id", "feature", 3, 0.95).filter(F.col("id") % 20 == 0).collect()}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("spread", [0.0, 1e-8])
def test_ties_go_to_the_smallest_ids(spark, spread):
    """A spot of 150 rows that are copies, or that tie at six decimals without being equal, beside 30 copies and others."""
    rng = np.random.default_rng(8)
    spot, twin = rng.normal(size=(2, 16))
    m = np.concatenate([spot + rng.normal(scale=spread, size=(150, 16)), np.repeat(twin[None], 30, 0), rng.normal(size=(60, 16)), spot + rng.normal(scale=0.02, size=(5, 16))])
    m = rng.permutation(m)
    s = cosines(m)
    np.fill_diagonal(s, -9)
    want = {(i * 3 + 1, int(j) * 3 + 1, s[i, j], p + 1) for i in range(len(m)) for p, j in enumerate(np.lexsort((np.arange(len(m)), -s[i]))[:3]) if s[i, j] >= 0.95}
    out = neighbors.nearest_vectors(frame(spark, m), "od_id", "feature", 3, 0.95).collect()
    got = {(r["id"], r["other"], r["cosine"], r["place"]) for r in out}
    assert len(out) == len(got) and len(want) > 500 and got == want


def test_many_copies_among_others(spark):
    """500 rows of one vector pick its three smallest ids; with copies scattered over other rows nearly nothing is missed."""
    rng = np.random.default_rng(9)
    base = make(5)
    m = np.concatenate([np.repeat(rng.normal(size=(1, base.shape[1])), 500, 0), base, base[rng.integers(0, len(base), 400)] * 2.0])
    m = rng.permutation(m)
    s = cosines(m)
    np.fill_diagonal(s, -9)
    want = {(i * 3 + 1, int(j) * 3 + 1) for i in range(len(m)) for j in np.lexsort((np.arange(len(m)), -s[i]))[:3] if s[i, j] >= 0.95}
    got = {(r["id"], r["other"]) for r in neighbors.nearest_vectors(frame(spark, m), "od_id", "feature", 3, 0.95).collect()}
    same = np.flatnonzero((s >= 1).sum(1) == 499)
    first = [int(i) * 3 + 1 for i in same[:4]]
    assert len(same) == 500 and all((int(i) * 3 + 1, f) in got for i in same for f in [x for x in first if x != int(i) * 3 + 1][:3])
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


@pytest.mark.parametrize("d", [1, 3, 32])
def test_packed_vectors_are_exact(d):
    rng = np.random.default_rng(d)
    m = np.round(rng.normal(size=(3000, d)) * 300) / 1024
    m[(m == 0).all(1)] = 1.0
    other = [rng.normal(size=(50, d)), rng.normal(size=(50, d)).astype("f4").astype(float), rng.integers(-(2**24), 2**24, (50, d)) + 0.5]
    extreme = [np.full((1, d), x) for x in (1e-320, 1.7e308, 2.0**24, -(2.0**-40))]
    for rows in (m, m * 2.0 ** rng.integers(-300, 300, (len(m), 1)), rng.permutation(np.concatenate([m[:200], *other, *extreme]))):
        assert (vectors.unpacked(vectors.packed(rows)) == vectors.unit(rows)).all()
        assert (vectors.unpacked(vectors.packed(rows).slice(5, 9)) == vectors.unit(rows[5:14])).all()
    assert vectors.packed(m).nbytes < (4 * d + 8) * len(m)
    assert len(vectors.unpacked(vectors.packed(m[:0]))) == 0


def shuffled(spark):
    sc = spark.sparkContext
    none = sc._gateway.jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("tile", [512, 7])
def test_blocks_of_pivots_are_not_copied(spark, monkeypatch, tile):
    """25 blocks meet each other, but each row is moved once; pairs are those of brute force, by the bound of their radii."""
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 200)
    monkeypatch.setattr(cluster, "TILE_ROWS", tile, raising=False)
    rng = np.random.default_rng(tile)
    v = rng.normal(size=(5000, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    radius = np.where(rng.random(5000) < 0.5, 0.0, rng.random(5000) * 0.3)
    bound = lambda a, b: np.where(np.maximum(a, b) > 0, np.cos(np.asarray(a) + np.asarray(b) + 0.2), 2.0)
    df = spark.createDataFrame([(i, bytes(x.as_py()), float(r)) for i, (x, r) in enumerate(zip(vectors.packed(v), radius))], "id long, vec binary, radius double")
    before = shuffled(spark)
    got = cluster.similar_pivots(df, bound).collect()
    moved = shuffled(spark) - before
    s = v @ v.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= bound(radius[:, None], radius[None]))) if i < j}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 100
    assert 0 < moved < 3 * len(v) * (8 * v.shape[1] + 24)


def test_only_the_clusters_stay_on_disk(spark):
    from pathlib import Path

    size = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))
    cluster.pivot_clusters(frame(spark, make(6)), "od_id", "feature", 0.95)
    before = size()
    c = cluster.pivot_clusters(frame(spark, np.concatenate([make(7)] * 4)), "od_id", "feature", 0.95)
    assert size() - before < 1.3 * c.count() * 220
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
