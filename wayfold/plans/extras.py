"""Queries of instance assembly, sampling in batches, designs as vectors, small exact searches and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import access, coreset, graph, learn
from wayfold.plans.base import OD, query, reach, with_net
from wayfold.plans.designs import SCEN, SCEN_REACH, _scenarios
from wayfold.plans.network import Network
from wayfold.plans.network_tables import CRIT_SQL, ROADS_SQL, _roads, critical_nodes_of
from wayfold.plans.reports import LISTS_SQL, ROUTE_SQL, UTIL_SQL, _lists, _routes, _runs
from wayfold.plans.vectors import _items, _reps
from wayfold.session import table
from wayfold.sources import files


@query("od_from_map", with_net(" SELECT src AS orig, dst AS des, time FROM edges"))
def od_from_map(spark, sf):
    """Nested maps of destinations turned into flat pairs."""
    e = Network(spark, sf).edges.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "time"))).alias("m"))
    return e.select(F.col("src").alias("orig"), F.explode("m").alias("des", "time"))


@query("one_hot_designs", with_net(" SELECT u.scen, string_agg(CASE WHEN (u.scen * 37 + p.proj * 11) % 5 < 2 THEN '1' ELSE '0' END, '' ORDER BY p.proj) AS bits FROM (SELECT DISTINCT user_id AS scen FROM events) u, projects p GROUP BY u.scen", SCEN))
def one_hot_designs(spark, sf):
    """Each scenario's design as a vector of zeros and ones over all projects."""
    n, s = _scenarios(spark, sf)
    every = n.projects.agg(F.sort_array(F.collect_list(F.col("proj").cast("int"))).alias("all"), F.lit(1).alias("one"))
    rows = s.withColumn("one", F.lit(1)).join(F.broadcast(every), "one")
    bits = F.transform("all", lambda p: F.when(F.array_contains("open", p), "1").otherwise("0"))
    return rows.select("scen", F.array_join(bits, "").alias("bits"))


@query("inner_points", with_net(" SELECT proj, least(1.0::DOUBLE, 100::DOUBLE / (2 * n * cost)) AS y0, 0.5 * least(1.0::DOUBLE, 100::DOUBLE / (2 * n * cost)) + 0.5 AS y1 FROM (SELECT proj, sum(time) AS cost, count(*) OVER () AS n FROM project_edges GROUP BY proj)"))
def inner_points(spark, sf):
    """Start inside the budget for each project, and its first move towards opening it."""
    c = Network(spark, sf).project_edges.groupBy("proj").agg(F.sum("time").alias("cost"), F.lit(1).alias("one"))
    n = c.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    y = F.least(F.lit(1.0), F.lit(100.0) / (2 * F.col("n") * F.col("cost")))
    return c.join(F.broadcast(n), "one").select("proj", y.alias("y0"), (0.5 * y + 0.5).alias("y1"))


@query("best_sample_per_p", "SELECT p, min(obj) AS obj, CAST(arg_min(rec_id, ROW(obj, rec_id)) AS BIGINT) AS rec_id FROM sample_p2000 WHERE obj IS NOT NULL AND NOT isnan(obj) GROUP BY p")
def best_sample_per_p(spark, sf):
    t = table(spark, sf, "sample_p2000").filter("obj is not null and not isnan(obj)")
    return t.groupBy("p").agg(F.min("obj").alias("obj"), F.min_by("rec_id", F.struct("obj", "rec_id")).alias("rec_id"))


GRID_SQL = """WITH c AS (SELECT r, k, r * 7 + k AS id FROM (SELECT unnest(range(0, 7)) AS r), (SELECT unnest(range(0, 7)) AS k)),
e AS (SELECT id AS src, id + 1 AS dst FROM c WHERE k < 6 UNION ALL SELECT id, id + 7 FROM c WHERE r < 6)
SELECT src, dst, 3 + (src * 31 + dst * 17) % 7 AS time FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


@query("grid_network", GRID_SQL)
def grid_network(spark, sf):
    """Intersections of a grid of six by six cells with edges between neighbours, times by rule."""
    return grid_edges(spark, 6, 6)


def grid_edges(spark, rows: int, cols: int):
    """(src, dst, time) of a grid: ids from position, neighbours by arithmetic, made in parallel."""
    w = cols + 1
    n = spark.range((rows + 1) * w)
    right = n.filter(F.col("id") % w < cols).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.filter(F.col("id") < rows * w).select(F.col("id").alias("src"), (F.col("id") + w).alias("dst"))
    one = right.unionByName(down)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.select("src", "dst", (3 + (F.col("src") * 31 + F.col("dst") * 17) % 7).alias("time"))


@query("cell_adjacency", "WITH c AS (SELECT unnest(range(0, 36)) AS id) SELECT a.id AS cell, b.id AS other FROM c a JOIN c b ON (a.id % 6 = b.id % 6 AND abs(a.id - b.id) = 6) OR (a.id // 6 = b.id // 6 AND abs(a.id - b.id) = 1)")
def cell_adjacency(spark, sf):
    c = spark.range(36).withColumnRenamed("id", "cell")
    k, r = F.col("cell") % 6, F.floor(F.col("cell") / 6)
    near = F.array_compact(F.array(F.when(k > 0, F.col("cell") - 1), F.when(k < 5, F.col("cell") + 1), F.when(r > 0, F.col("cell") - 6), F.when(r < 5, F.col("cell") + 6)))
    return c.select("cell", F.explode(near).alias("other"))


INSTANCE = """
inst AS (SELECT e.src, e.dst, e.time, CASE WHEN e.lts > 2 OR (e.src % 5 = 2 AND e.src NOT IN (2, 12)) THEN 100 ELSE e.time END AS cost FROM edges e),
corridor AS (SELECT src, dst, time, CASE WHEN least(src, dst) % 6 = 0 AND greatest(src, dst) % 2 = 1 THEN 100 ELSE cost END AS cost FROM inst),
icost AS (SELECT src, dst, cost AS time FROM inst), ccost AS (SELECT src, dst, cost AS time FROM corridor)"""


def _instance(spark, sf, without_corridor: bool):
    n = Network(spark, sf)
    stressful = (F.col("src") % 5 == 2) & ~F.col("src").isin(2, 12)
    e = n.edges.select("src", "dst", F.when((F.col("lts") > 2) | stressful, 100).otherwise(F.col("time")).cast("long").alias("time"))
    if without_corridor:
        hit = (F.least("src", "dst") % 6 == 0) & (F.greatest("src", "dst") % 2 == 1)
        e = e.withColumn("time", F.when(hit, F.lit(100).cast("long")).otherwise(F.col("time")))
    full = n.reach(n.edges, 20).filter("orig != node")
    return full.join(n.reach(e, 15).select("orig", "node"), ["orig", "node"], "left_anti").select("orig", F.col("node").alias("des"), "dist")


@query("instance_pairs", with_net(" SELECT f.orig, f.node AS des, f.dist FROM f WHERE f.orig <> f.node AND NOT EXISTS (SELECT 1 FROM n WHERE n.orig = f.orig AND n.node = f.node)", INSTANCE, reach("f", "edges", 20), reach("n", "icost", 15)))
def instance_pairs(spark, sf):
    """The pairs of an instance: in reach on the whole network, not on the current one with its stress costs."""
    return _instance(spark, sf, False)


@query("instance_pairs_without_corridor", with_net(" SELECT f.orig, f.node AS des, f.dist FROM f WHERE f.orig <> f.node AND NOT EXISTS (SELECT 1 FROM n WHERE n.orig = f.orig AND n.node = f.node)", INSTANCE, reach("f", "edges", 20), reach("n", "ccost", 15)))
def instance_pairs_without_corridor(spark, sf):
    return _instance(spark, sf, True)


@query("simplified_network")
def simplified_network(spark, sf):
    """One-way roads expanded, chains between critical nodes merged, shortcuts to arterial nodes added."""
    r = _roads(spark, sf)
    end = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"))
    ways = F.array_compact(F.array(F.when(F.col("oneway").isin(0, 1), end("fnode", "tnode")), F.when(F.col("oneway").isin(0, -1), end("tnode", "fnode"))))
    e = r.select(F.explode(ways).alias("w"), "length", "lts").select("w.src", "w.dst", "length", "lts")
    merged = graph.contract_chains(e, critical_nodes_of(r, include_terminal=True))
    from wayfold.plans.reachability import arterial_shortcuts

    extra = arterial_shortcuts(spark, sf).select(F.col("orig").alias("src"), F.col("node").alias("dst"), (F.col("dist") * 100).alias("length"), F.lit(1).cast("long").alias("lts"))
    return merged.select("src", "dst", F.col("length").cast("long").alias("length"), F.col("lts").cast("long").alias("lts")).unionByName(extra)


@query("road_ends", with_net(" SELECT node, count(*) AS roads, CAST(sum(length) AS BIGINT) AS metres FROM (SELECT fnode AS node, length FROM roads UNION ALL SELECT tnode, length FROM roads) WHERE node IN (SELECT node FROM crit) GROUP BY node", ROADS_SQL + CRIT_SQL))
def road_ends(spark, sf):
    r = _roads(spark, sf)
    ends = r.select(F.col("fnode").alias("node"), "length").unionByName(r.select(F.col("tnode").alias("node"), "length"))
    return ends.join(critical_nodes_of(r), "node", "left_semi").groupBy("node").agg(F.count("*").alias("roads"), F.sum("length").alias("metres"))


DRAW_SQL = """, sc0 AS (SELECT DISTINCT user_id AS scen FROM events), un AS (SELECT id AS node FROM nodes WHERE id % 4 = 1),
cnt AS (SELECT scen, (SELECT count(*) FROM projects) AS p, (SELECT count(*) FROM un) AS u, CAST('0x' || substr(md5('n' || scen), 1, 8) AS BIGINT) AS hn, CAST('0x' || substr(md5('s' || scen), 1, 8) AS BIGINT) AS hs FROM sc0),
want AS (SELECT scen, p // 2 + hn % greatest(p - p // 2, 1) AS np, CASE WHEN u <= 1 THEN 0 ELSE 1 + hs % (u - 1) END AS ns FROM cnt),
pr AS (SELECT scen, proj, row_number() OVER (PARTITION BY scen ORDER BY md5(scen || 'p' || proj), proj) AS k FROM sc0, projects),
sr AS (SELECT scen, node, row_number() OVER (PARTITION BY scen ORDER BY md5(scen || 'u' || node), node) AS k FROM sc0, un)
SELECT w.scen, 'project' AS kind, CAST(pr.proj AS BIGINT) AS id FROM want w JOIN pr ON pr.scen = w.scen AND k <= np UNION ALL SELECT w.scen, 'signal', sr.node FROM want w JOIN sr ON sr.scen = w.scen AND k <= ns"""


@query("random_designs", with_net(DRAW_SQL))
def random_designs(spark, sf):
    """Seeded designs: of P projects from half to all but one, of U nodes without a signal from one to all but one (none if
    U is one), without replacement by rank of a hash. The hash is MD5 of the names, which any engine repeats."""
    n, s = _scenarios(spark, sf)
    listed = lambda df, c: F.broadcast(df.agg(F.sort_array(F.collect_list(F.col(c).cast("long"))).alias("all"), F.lit(1).alias("one")))
    number = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(tag), F.col("scen").cast("string"))), 1, 8), 16, 10).cast("long")

    def drawn(every, tag: str, want, kind: str):
        rows = s.select("scen", F.lit(1).alias("one")).join(every, "one").withColumn("n", F.size("all").cast("long"))
        name = lambda x: F.md5(F.concat(F.col("scen").cast("string"), F.lit(tag), x.cast("string")))
        ranked = F.transform(F.sort_array(F.transform("all", lambda x: F.struct(name(x).alias("h"), x.alias("id")))), lambda t: t["id"])
        return rows.select("scen", F.lit(kind).alias("kind"), F.explode(F.slice(ranked, F.lit(1), want.cast("int"))).alias("id"))

    half, size = F.floor(F.col("n") / 2), F.col("n")
    projects = drawn(listed(n.projects, "proj"), "p", half + number("n") % F.greatest(size - half, F.lit(1)), "project")
    signals = drawn(listed(n.nodes.filter("id % 4 = 1"), "id"), "u", F.when(size <= 1, 0).otherwise(1 + number("s") % F.greatest(size - 1, F.lit(1))), "signal")
    return projects.unionByName(signals)


@query("sample_batch")
def sample_batch(spark, sf):
    return coreset.sample_batch(_items(spark, sf).select("id"), [0.01, 0.05, 0.1], list(range(5)))


@query("exact_median", """WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label AS id, d, avg(x) AS x FROM x GROUP BY label, d),
v AS (SELECT id, list(x ORDER BY d) AS vec FROM m GROUP BY id), w AS (SELECT label AS id, count(*) AS worth FROM embeddings GROUP BY label),
d AS (SELECT a.id AS i, w.worth, b.id AS j, round(1 - list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)), 9) + 0 AS d FROM v a JOIN w ON w.id = a.id, v b),
s AS (SELECT x.j AS p, y.j AS q, sum(least(x.d, y.d) * x.worth) AS obj FROM d x JOIN d y ON x.i = y.i AND x.j < y.j GROUP BY x.j, y.j)
SELECT CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q, round(obj, 5) AS obj FROM s ORDER BY round(obj, 9), p, q LIMIT 1""")
def exact_median(spark, sf):
    """Best two of the mean vectors of all labels, each weighing as many items as it stands for."""
    i = _items(spark, sf)
    means = i.select("label", F.posexplode("vec").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).select("label", F.col("v.x").alias("vec"))
    small = vec.join(i.groupBy("label").agg(F.count("*").alias("worth")), "label").select(F.col("label").cast("long").alias("id"), "vec", "worth")
    best = coreset.exact_median(small, 2)
    return best.select(F.col("ids")[0].alias("p"), F.col("ids")[1].alias("q"), F.round("obj", 5).alias("obj"))


@query("perturbed_median")
def perturbed_median(spark, sf):
    i = _items(spark, sf)
    return coreset.perturbed_median(i, _reps(i), seed=3)


@query("selected_project_records", LISTS_SQL + """, d AS (SELECT ins_id, arg_max(p, ROW(budget, obj, rec_id)) AS p FROM l WHERE budget <= 300 GROUP BY ins_id)
SELECT ins_id, CAST(x AS BIGINT) AS proj, p_name AS name FROM (SELECT ins_id, unnest(p) AS x FROM d) LEFT JOIN part ON p_partkey = x""")
def selected_project_records(spark, sf):
    """Records of the projects of the design kept for each instance: a last-row lookup, taken apart and joined to the table
    of records, here `part`. Projects without a record stay."""
    d = _runs(spark, sf).filter("budget <= 300").groupBy("ins_id").agg(F.max_by("rec_id", F.struct("budget", "obj", "rec_id")).alias("rec_id"))
    records = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("proj"), F.col("p_name").alias("name"))
    return d.join(_lists(spark, sf), "rec_id").select("ins_id", "proj").join(records, "proj", "left").select("ins_id", "proj", "name")


@query("routes_per_od", ROUTE_SQL + " SELECT od_id, CAST(count(*) AS INTEGER) AS routes, string_agg(array_to_string(nodes, '-'), '|' ORDER BY r) AS joined FROM routes GROUP BY od_id")
def routes_per_od(spark, sf):
    r = _routes(spark, sf).select("od_id", F.struct("r", F.array_join(F.col("nodes").cast("array<string>"), "-").alias("s")).alias("x"))
    g = r.groupBy("od_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select("od_id", F.size("x").alias("routes"), F.array_join(F.col("x.s"), "|").alias("joined"))


UTILITY_SETS_SQL = UTIL_SQL + """, prj AS (SELECT unnest(range(0, 6)) AS proj), sets AS (SELECT p.proj AS p, q.proj AS q FROM prj p, prj q WHERE WHICH),
c AS (SELECT p, q, route_id, pos, (a * 3 + b) % 4 < 1 OR (a + 2 * b) % 6 IN (p, q) AS c FROM st, sets),
i AS (SELECT p, q, route_id, pos, c, pos - row_number() OVER (PARTITION BY p, q, route_id, c ORDER BY pos) AS island FROM c),
sc AS (SELECT p, q, route_id, sum(n * power(1.02, n)) AS score FROM (SELECT p, q, route_id, island, count(*) AS n FROM i WHERE c GROUP BY p, q, route_id, island) GROUP BY p, q, route_id),
v AS (SELECT s.p, s.q, r.od_id, r.route_id, coalesce(sc.score, 0) - vb.v_bar AS v FROM routes r CROSS JOIN sets s LEFT JOIN sc ON sc.route_id = r.route_id AND sc.p = s.p AND sc.q = s.q JOIN vb ON vb.route_id = r.route_id),
u AS (SELECT p, q, od_id, sum(exp(v - m) * v) / sum(exp(v - m)) AS utility FROM (SELECT *, max(v) OVER (PARTITION BY p, q, od_id) AS m FROM v) GROUP BY p, q, od_id),
o AS (SELECT p, q, round(sum(utility), 3) AS obj FROM u GROUP BY p, q)"""


def _utility_of_sets(spark, sf, sets: list[tuple[int, int]]):
    """(p, q, obj): the route-choice objective with the projects of each set open on top of what is open, all sets in one
    job. Routes are made once and scored in array expressions."""
    r = _routes(spark, sf)
    every = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for p, q in sets])
    runs = r.join(access.route_overlap(r), "route_id").select("route_id", "od_id", "v_bar", C.consecutive_pairs(F.col("nodes")).alias("steps"))
    runs = runs.withColumn("s", F.explode(every))
    hit = lambda e: ((e["a"] * 3 + e["b"]) % 4 < 1) | ((e["a"] + 2 * e["b"]) % 6).isin(F.col("s.p"), F.col("s.q"))
    v = runs.withColumn("covered", F.transform("steps", hit)).select("s", "od_id", "route_id", (C.run_score(F.col("covered"), 1.02) - F.col("v_bar")).alias("v"))
    listed = v.groupBy("s", "od_id").agg(F.sort_array(F.collect_list(F.struct("route_id", "v"))).alias("x"))
    u = listed.select("s", C.softmax_expectation(F.transform("x", lambda x: x["v"])).alias("u"))
    return u.groupBy("s").agg(F.round(F.sum("u"), 3).alias("obj")).select("s.p", "s.q", "obj")


@query("utility_candidates", UTILITY_SETS_SQL.replace("WHICH", "p.proj = q.proj") + " SELECT p AS proj, obj FROM o")
def utility_candidates(spark, sf):
    """The step of a search under route choice: the objective with each project opened alone."""
    return _utility_of_sets(spark, sf, [(p, p) for p in range(6)]).select(F.col("p").alias("proj"), "obj")


@query("utility_design", UTILITY_SETS_SQL.replace("WHICH", "p.proj < q.proj") + " SELECT p, q, obj FROM o ORDER BY obj DESC, p, q LIMIT 1")
def utility_design(spark, sf):
    """The two projects that are best together under route choice, among all pairs of them."""
    return _utility_of_sets(spark, sf, [(p, q) for p in range(6) for q in range(p + 1, 6)]).orderBy(F.desc("obj"), "p", "q").limit(1)


@query("experiment_grid", "SELECT b AS budget, s AS size, k AS seed FROM (SELECT unnest([100, 300, 500]) AS b), (SELECT unnest([CAST(0.01 AS DOUBLE), 0.05, 0.1]) AS s), (SELECT unnest(range(0, 10)) AS k)")
def experiment_grid(spark, sf):
    """All combinations of an experiment's parameters as work items."""
    e = lambda *v: F.explode(F.array(*[F.lit(x) for x in v]))
    g = spark.range(10).withColumnRenamed("id", "seed").select("seed", e(100, 300, 500).alias("budget"))
    return g.select("budget", e(0.01, 0.05, 0.1).alias("size"), "seed")


@query("sampled_lines")
def sampled_lines(spark, sf):
    """Pairs as GeoJSON lines."""
    from wayfold.plans.network_tables import parallel_lines

    return files.line_geometry(parallel_lines(spark, sf), "ox", "oy", "dx", "dy").select("od_id", "geometry")


def _blend_inputs(spark, sf):
    i = _items(spark, sf).withColumn("y", F.col("vec")[0].cast("double") + 1)
    return i, _reps(i)


@query("bagged_objective")
def bagged_objective(spark, sf):
    i, r = _blend_inputs(spark, sf)
    w = coreset.assignment_weights(i, r, coreset.nearest(i, r, 1).select("id", "rep"))
    return learn.bagged_total(i, r, w, 0.5)


@query("boosted_objective")
def boosted_objective(spark, sf):
    i, r = _blend_inputs(spark, sf)
    return learn.boosted_total(i, r, coreset.nearest(i, r, 1).select("id", "rep"))


@query("leader_dataset", with_net(""", m AS (SELECT d, avg(x) AS v FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d),
y AS (SELECT sc.scen, CAST(sum(p.population) AS BIGINT) AS y FROM sc JOIN od ON od.orig = sc.orig AND od.des = sc.node JOIN pot p ON p.node = sc.node WHERE sc.dist <= 15 GROUP BY sc.scen),
u AS (SELECT DISTINCT user_id AS scen FROM events),
x AS (SELECT u.scen, row_number() OVER (PARTITION BY u.scen ORDER BY p.proj) - 1 AS k, CAST(CASE WHEN (u.scen * 37 + p.proj * 11) % 5 < 2 THEN 1 ELSE 0 END AS DOUBLE) AS x FROM u, projects p
  UNION ALL SELECT u.scen, (SELECT count(*) FROM projects) + d - 1, v FROM u, m)
SELECT x.scen, CAST(x.k AS INTEGER) AS k, round(CAST(x.x AS DOUBLE), 6) AS x, coalesce(y.y, 0) AS y FROM x LEFT JOIN y USING (scen)""", OD, SCEN, SCEN_REACH))
def leader_dataset(spark, sf):
    """Rows of a dataset that predicts a design's accessibility, one element to a row: the design as zeros and ones over
    all projects, followed by the mean vector of all items; y is the accessibility under the design."""
    from wayfold.plans.designs import scenario_accessibility
    from wayfold.plans.vectors import mean_feature

    n, s = _scenarios(spark, sf)
    every = n.projects.agg(F.sort_array(F.collect_list(F.col("proj").cast("int"))).alias("all"), F.lit(1).alias("one"))
    mean = mean_feature(spark, sf).agg(F.sort_array(F.collect_list(F.struct("dim", "mean"))).alias("m"), F.lit(1).alias("one")).select("m.mean", "one")
    rows = s.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").join(F.broadcast(mean), "one")
    bits = F.transform("all", lambda p: F.array_contains("open", p).cast("double"))
    rows = rows.join(scenario_accessibility(spark, sf).select("scen", F.col("acc").alias("y")), "scen", "left")
    return rows.select("scen", F.coalesce("y", F.lit(0)).alias("y"), F.posexplode(F.concat(bits, "mean")).alias("k", "x")).select("scen", "k", F.round("x", 6).alias("x"), "y")
