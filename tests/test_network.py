import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import access, design, graph
from wayfold.plans import growing

EDGES = "src long, dst long, time double"


def dijkstra(edges, origin, cutoff):
    out, heap = {}, [(0, origin)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = d
        for s, t, c in edges:
            if s == n and d + c <= cutoff:
                heapq.heappush(heap, (d + c, t))
    return out


@pytest.fixture(scope="module")
def net(spark):
    random.seed(4)
    edges = [(i, j, float(random.randint(1, 6))) for i in range(14) for j in range(14) if i != j and random.random() < 0.2]
    return edges, spark.createDataFrame(edges, EDGES)


def test_reach_two_ways_and_paths(spark, net):
    edges, df = net
    want = {(o, n): d for o in range(14) for n, d in dijkstra(edges, o, 9).items()}
    origins = spark.createDataFrame([(i,) for i in [*range(14), 3, None]], "orig long")
    for f in (graph.reach, graph.reach_by_joins):
        assert {(r["orig"], r["node"]): r["dist"] for r in f(origins, df, 9).collect()} == want
    cost = {(s, t): c for s, t, c in edges}
    for r in graph.shortest_paths(origins, df, 9).collect():
        p = r["path"]
        assert p[0] == r["orig"] and p[-1] == r["node"] and sum(cost[a, b] for a, b in zip(p, p[1:])) == r["dist"] == want[r["orig"], r["node"]]


def test_large_networks_go_through_joins(spark, net, monkeypatch):
    monkeypatch.setattr(graph, "MOST_EDGES", 3)
    edges, df = net
    origins = spark.createDataFrame([(0,), (5,)], "orig long")
    got = {(r["orig"], r["node"]): r["dist"] for r in graph.reach(origins, df, 7).collect()}
    assert got == {(o, n): d for o in (0, 5) for n, d in dijkstra(edges, o, 7).items()}


def test_equal_paths_take_the_smaller_nodes(spark):
    df = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (1, 3, 1.0), (2, 3, 1.0)], EDGES)
    row = graph.shortest_paths(spark.createDataFrame([(0,)], "orig long"), df, 5).filter("node = 3").first()
    assert row["path"] == [0, 1, 3]


def test_augment_replaces_and_opening_never_hurts(spark):
    base = spark.createDataFrame([(0, 1, 100.0), (1, 2, 3.0)], EDGES)
    new = spark.createDataFrame([(0, 1, 4.0), (0, 1, 5.0)], EDGES)
    assert sorted(map(tuple, graph.augment(base, new).collect())) == [(0, 1, 4.0), (1, 2, 3.0)]


def test_contract_chains(spark):
    e = [(1, 2, 5, 1), (2, 3, 5, 3), (3, 4, 1, 2), (4, 3, 1, 2), (3, 2, 5, 3), (2, 1, 5, 1), (4, 9, 2, 1)]
    df = spark.createDataFrame(e, "src long, dst long, length long, lts long")
    got = sorted(map(tuple, graph.contract_chains(df, spark.createDataFrame([(1,), (4,)], "node long")).collect()))
    assert got == [(1, 4, 11, 3), (4, 1, 11, 3)]  # the spur to 9 ends without a stop
    with pytest.raises(ValueError):
        graph.contract_chains(spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (2, 4, 1, 1), (2, 5, 1, 1)], "src long, dst long, length long, lts long"), spark.createDataFrame([(1,)], "node long"))


def test_edge_lookup_raises_for_unknown_edges(spark):
    rec = spark.createDataFrame([(1, 2, 77)], "src long, dst long, rec long")
    assert graph.edge_lookup(spark.createDataFrame([(2, 1)], "src long, dst long"), rec).first()["rec"] == 77
    with pytest.raises(Exception, match="no record of edge"):
        graph.edge_lookup(spark.createDataFrame([(2, 3)], "src long, dst long"), rec).collect()


def test_penalty_is_continuous_and_reaches_the_level(spark):
    beta = C.betas(0.02, 15, 20)
    t = spark.createDataFrame([(15.0,), (15.000001,), (20.0,), (20.5,)], "t double")
    p = [r[0] for r in t.select(C.penalty(F.col("t"), beta, 15, 20)).collect()]
    assert p[0] == pytest.approx(0.3) and p[1] == pytest.approx(0.3, abs=1e-5) and p[2] == pytest.approx(1.0) and p[3] == 1.0


def test_run_scores_and_softmax(spark):
    df = spark.createDataFrame([([True, True, False, True],), ([False],), ([],)], "c array<boolean>")
    got = [r[0] for r in df.select(C.run_score(F.col("c"), 1.02)).collect()]
    assert got == pytest.approx([2 * 1.02**2 + 1.02, 0.0, 0.0])
    v = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>")
    assert v.select(C.softmax_expectation(F.col("v"))).first()[0] == pytest.approx(1000.0)


@pytest.fixture(scope="module")
def problem(spark):
    random.seed(9)
    base = [(i, (i + 1) % 9, 9.0) for i in range(9)]
    proj = [(p, *random.sample(range(9), 2), float(random.randint(1, 5))) for p in range(7)]
    proj += [(p, t, s, c) for p, s, t, c in proj]
    pairs = [(i * 9 + j, i, j, float(random.randint(1, 9))) for i in range(9) for j in range(9) if i != j]
    cost = {p: float(random.randint(2, 6)) for p in range(7)}
    make = lambda **k: design.Problem(spark.createDataFrame(base, EDGES), spark.createDataFrame(proj, "proj int, src long, dst long, time double"), spark.createDataFrame(list(cost.items()), "proj int, cost double"), spark.createDataFrame(pairs, "od_id long, orig long, des long, weight double"), 10.0, **k)
    return base, proj, pairs, cost, make


def brute_best(base, proj, pairs, cost, budget, worth, charge=0.0):
    best = -1e9
    for n in range(len(cost) + 1):
        for y in itertools.combinations(cost, n):
            if sum(cost[p] for p in y) > budget:
                continue
            net = {(s, t): c for s, t, c in base}
            for p, s, t, c in sorted(proj):
                if p in y:
                    net[s, t] = c
            edges = [(s, t, c) for (s, t), c in net.items()]
            far = {o: dijkstra(edges, o, 10.0) for o in range(9)}
            score = sum(w * worth(far[o][d]) for _, o, d, w in pairs if d in far[o]) - charge * n
            best = max(best, score)
    return best


@pytest.mark.parametrize("piecewise,charge", [(False, 0.0), (True, 3.0)])
def test_designs_against_brute_force(problem, piecewise, charge):
    base, proj, pairs, cost, make = problem
    beta = C.betas(0.05, 6, 10)
    pen = lambda t: t * beta[1] if t <= 6 else beta[1] * 6 + beta[2] * (t - 6)
    want = brute_best(base, proj, pairs, cost, 12, (lambda t: 1 - pen(t)) if piecewise else (lambda t: 1), charge)
    p = make(worth=lambda d: 1 - C.penalty(d, beta, 6, 10), charge=charge) if piecewise else make(charge=charge)
    assert design.enumerate_best(p, 7, 12).first()["score"] == pytest.approx(want)
    loop = design.cut_loop(p, 12).first()
    assert loop["score"] == pytest.approx(want) and loop["bound"] == pytest.approx(want, abs=1e-5)
    steps = design.greedy(p, 12).collect()
    assert all(s["allocated"] <= 12 and s["score"] <= want + 1e-6 for s in steps)
    assert [s["score"] for s in steps] == sorted(s["score"] for s in steps)
    opened, score = design.swap_search(p, list(steps[-1]["selected"]) if steps else [], 12, rounds=3)
    assert score <= want + 1e-6 and (not steps or score >= steps[-1]["score"] - 1e-6)


def test_accessibility_counts_listed_destinations_only(spark):
    far = spark.createDataFrame([(0, 1, 5.0), (0, 2, 50.0), (0, 3, 1.0)], "orig long, node long, dist double")
    od = spark.createDataFrame([(0, 1), (0, 2), (4, 1)], "orig long, des long")
    pot = spark.createDataFrame([(1, 10), (2, 20), (3, 40)], "node long, population long")
    assert sorted(map(tuple, access.accessibility(far, od, pot, 15).collect())) == [(0, 10), (4, 0)]


def test_long_chains_and_loops(spark):
    """A chain of 5,000 edges comes out whole; a loop without a stop raises only where a stop leads into it."""
    rows = [(i, i + 1, 2, 1 + (i == 4321)) for i in range(5000)] + [(9001, 9002, 1, 1), (9002, 9003, 1, 1), (9003, 9001, 1, 1)]
    schema = "src long, dst long, length long, lts long"
    stops = spark.createDataFrame([(0,), (5000,), (5000,)], "node long")
    assert list(map(tuple, graph.contract_chains(spark.createDataFrame(rows, schema), stops).collect())) == [(0, 5000, 10000, 2)]
    into = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (3, 4, 1, 1), (4, 2, 1, 1)], schema)
    with pytest.raises(ValueError):
        graph.contract_chains(into, spark.createDataFrame([(1,)], "node long"))
    two = spark.createDataFrame([(1, 2, 1, 1), (2, 3, 1, 1), (2, 4, 1, 1)], schema)
    with pytest.raises(ValueError):
        graph.contract_chains(two, spark.createDataFrame([(1,), (3,), (4,)], "node long"))
    assert graph.contract_chains(spark.createDataFrame([], schema), stops).collect() == []


def test_designs_and_paths_by_joins(spark, net, monkeypatch):
    """Beyond MOST_EDGES designs and paths come out the same, not refused."""
    edges, df = net
    random.seed(3)
    proj = [(p, s, t, 1.0 + p % 3) for p in range(5) for s, t in [random.sample(range(16), 2)]]
    pe = spark.createDataFrame(proj, "proj long, src long, dst long, time double")
    runs = spark.createDataFrame([(s, o, y) for s, y in enumerate(([], [0, 2], [1, 3, 4], [0, 1, 2, 3, 4], [77], None)) for o in (0, 3, 99)], "scen long, orig long, open array<int>")
    origins = spark.createDataFrame([(0,), (5,), (99,)], "orig long")
    far = lambda: sorted(map(tuple, graph.reach_of_designs(runs, df, pe, 8).collect()))
    ways = lambda: sorted((r["orig"], r["node"], r["dist"], tuple(r["path"])) for r in graph.shortest_paths(origins, df, 8).collect())
    small = far(), ways()
    monkeypatch.setattr(graph, "MOST_EDGES", 3)
    assert (far(), ways()) == small and len(small[0]) > 40
    for scen, y in ((1, [0, 2]), (3, [0, 1, 2, 3, 4])):
        opened = {}
        for p, s, t, c in proj:
            if p in y:
                opened[s, t] = min(c, opened.get((s, t), c))
        own = [(s, t, c) for s, t, c in edges if (s, t) not in opened] + [(s, t, c) for (s, t), c in opened.items()]
        assert [x for x in small[0] if x[0] == scen and x[1] == 3] == sorted((scen, 3, n, d) for n, d in dijkstra(own, 3, 8).items())


def test_edges_beyond_the_cutoff_do_not_count_towards_the_most(spark, monkeypatch):
    """A network is searched as arrays if those of its edges that a search can take are few enough; an open project's edge
    takes the place of a base edge however long it is."""
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 4.0), (3, 4, 90.0), (4, 5, 90.0), (5, 6, 90.0)], "src long, dst long, time double")
    pe = spark.createDataFrame([(7, 2, 3, 50.0), (7, 3, 6, 50.0), (8, 1, 4, 5.0)], "proj long, src long, dst long, time double")
    origins = spark.createDataFrame([(1,), (4,)], "orig long")
    runs = spark.createDataFrame([(7, 1, [7]), (8, 1, [8, 7]), (9, 1, [])], "scen long, orig long, open array<long>")
    monkeypatch.setattr(graph, "MOST_EDGES", 2)
    for name in ("reach_by_joins", "reach_of_designs_by_joins"):
        monkeypatch.setattr(graph, name, lambda *_: pytest.fail("searched by joins"))
    assert sorted(map(tuple, graph.reach(origins, edges, 10).collect())) == [(1, 1, 0), (1, 2, 3), (1, 3, 7), (4, 4, 0)]
    got = sorted((r["scen"], r["node"], r["dist"]) for r in graph.reach_of_designs(runs, edges, pe, 10).collect())
    assert got == [(7, 1, 0), (7, 2, 3), (8, 1, 0), (8, 2, 3), (8, 4, 5), (9, 1, 0), (9, 2, 3), (9, 3, 7)]


def test_pairs_apart_are_the_same_by_joins(spark, net, monkeypatch):
    """Pairs out of reach now, under several networks at once, against single searches."""
    edges, df = net
    marked = df.withColumn("mark", (F.col("src") * 5 + F.col("dst") * 3) % 8)
    origins = spark.createDataFrame([(o,) for o in (0, 3, 5, 99)], "orig long")
    for most in (2_000_000, 3):
        monkeypatch.setattr(graph, "MOST_EDGES", most)
        far = lambda df, c: {(r["orig"], r["node"]): r["dist"] for r in graph.reach(origins, df, c).collect()}
        now = far(marked.filter("mark % 2 = 1"), 6)
        pairs = {k: d for k, d in far(df, 9).items() if k not in now and k[0] != k[1]}
        got = graph.reach_apart(origins, marked, 9, 6)
        assert {(r["orig"], r["node"]): r["dist"] for r in got.collect()} == pairs and len(pairs) > 3
        rows = graph.reach_apart(origins, marked, 9, 6, [1, 2]).collect()
        want = [(b, *k, d) for b in (1, 2) for k, d in far(marked.filter(f"(mark & {1 << b}) != 0"), 9).items() if k in pairs]
        assert sorted(map(tuple, rows)) == sorted(want) and want


def test_pairs_apart_in_a_large_network_are_found_piece_by_piece(spark, monkeypatch):
    """Beyond MOST_EDGES the pairs come out as from one array, without a join search for each network; pieces that are too
    large themselves go by joins, with the same pairs."""
    random.seed(8)
    edges = [(i, i + d, float(random.randint(3, 5)), random.randint(0, 7)) for i in range(300) for d in (1, 2, 9) if random.random() < 0.7]
    edges += [(b, a, t, m) for a, b, t, m in edges]
    marked = spark.createDataFrame(edges + edges[:5] + [(5, 250, 90.0, 7)], "src long, dst long, time double, mark long")
    origins = spark.createDataFrame([(o,) for o in [*range(0, 300, 3), 3, 999, None]], "orig long")
    monkeypatch.setattr(graph, "EDGES_A_PIECE", 100)
    monkeypatch.setattr(graph, "RUN_OF_NODES", 16)
    got = lambda under: sorted(map(tuple, graph.reach_apart(origins, marked, 9, 6, under).collect()))
    several, one = got([1, 2]), got(None)
    assert len(several) > 300 and len(one) > 300
    joins = graph.reach_by_joins
    for most, few, under, want in ((len(edges) - 1, 100_000, [1, 2], several), (len(edges) - 1, 0, None, one), (150, 100_000, None, one)):
        monkeypatch.setattr(graph, "MOST_EDGES", most)
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "reach_by_joins", joins if most == 150 else lambda *_: pytest.fail("searched by joins"))
        assert got(under) == want


def test_event_types_without_a_number_open_no_network(spark, small, tmp_path):
    """A missing event type gives no scenario; it raised."""
    for t in ("od", "nodes", "events"):
        df = spark.read.parquet(f"{small}/{t}.parquet")
        (df.unionByName(df.limit(3).withColumn("event_type", F.lit(None).cast("string"))) if t == "events" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    run = growing.places_scenario_od
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(map(tuple, run(spark, small).collect()))
