"""Queries over result tables, packed lists, event sequences and equity groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions import columns as C
from wayfold.operators import access, coreset, packed, report
from wayfold.operators.rows import rows_in_use
from wayfold.plans.base import NET, query, with_net
from wayfold.plans.network import Network
from wayfold.plans.vectors import VEC_SQL, _items, _reps
from wayfold.session import finite, table
from wayfold.sources import files

KNN_SQL = """WITH usable AS (SELECT rec_id, ins_id, budget, round(size, 6) AS size, seed, obj, acc, time, projects, loaded_at FROM complete_pmedian_knn WHERE budget IS NOT NULL AND size IS NOT NULL AND obj IS NOT NULL AND isfinite(obj)),
runs AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC, ins_id DESC, budget DESC, size DESC, seed DESC, obj DESC, time DESC, projects DESC, acc DESC) = 1)"""


def _runs(spark, sf):
    t = table(spark, sf, "complete_pmedian_knn").withColumn("size", F.round("size", 6))
    return rows_in_use(t, ["rec_id"], "loaded_at", ["ins_id", "budget", "size", "seed", "obj", "time", "projects", "acc"], F.col("budget").isNotNull() & F.col("size").isNotNull() & finite(F.col("obj")))


@query("opt_gap", KNN_SQL + """, b AS (SELECT ins_id, budget, max(obj) AS best FROM runs GROUP BY ins_id, budget)
SELECT budget, size, round(avg(1 - obj / best), 6) AS gap, round(stddev_pop(1 - obj / best), 6) AS spread, count(*) AS runs FROM runs JOIN b USING (ins_id, budget) WHERE best <> 0 GROUP BY budget, size""")
def opt_gap(spark, sf):
    g = report.optimality_gap(_runs(spark, sf), ["budget", "size"], ["ins_id", "budget"])
    return g.select("budget", "size", F.round("gap", 6).alias("gap"), F.round("spread", 6).alias("spread"), "runs")


@query("solve_times", KNN_SQL + " SELECT budget, round(avg(time), 6) AS mean_time, max(time) AS max_time, round(avg(obj), 6) AS mean_obj, count(*) AS runs FROM runs GROUP BY budget")
def solve_times(spark, sf):
    return _runs(spark, sf).groupBy("budget").agg(F.round(F.avg("time"), 6).alias("mean_time"), F.max("time").alias("max_time"), F.round(F.avg("obj"), 6).alias("mean_obj"), F.count("*").alias("runs"))


@query("best_per_budget", KNN_SQL + " SELECT ins_id, budget, max(obj) AS best FROM runs GROUP BY ins_id, budget")
def best_per_budget(spark, sf):
    return _runs(spark, sf).groupBy("ins_id", "budget").agg(F.max("obj").alias("best"))


@query("running_best", KNN_SQL + ", m AS (SELECT budget, max(obj) AS best FROM runs GROUP BY budget) SELECT budget, best, max(best) OVER (ORDER BY budget ROWS UNBOUNDED PRECEDING) AS best_so_far FROM m")
def running_best(spark, sf):
    return report.running_best(_runs(spark, sf).groupBy("budget").agg(F.max("obj").alias("best")), "budget", "best")


GREEDY_SQL = "WITH steps AS (SELECT run_id, allocated, max(acc) AS acc, max(step) AS step FROM greedy_abs_job_par WHERE acc IS NOT NULL GROUP BY run_id, allocated), levels AS (SELECT DISTINCT run_id, CAST(unnest([20, 40, 80, 120, 200, 400]) AS DOUBLE) AS budget FROM steps)"


def _steps(spark, sf):
    s = table(spark, sf, "greedy_abs_job_par").filter("acc is not null")
    return s.groupBy("run_id", "allocated").agg(F.max("acc").alias("acc"), F.max("step").alias("step"))


@query("asof_budget", GREEDY_SQL + " SELECT l.run_id, l.budget, arg_max(s.acc, s.allocated) AS acc, arg_max(s.step, s.allocated) AS step FROM levels l LEFT JOIN steps s ON s.run_id = l.run_id AND s.allocated <= l.budget GROUP BY l.run_id, l.budget")
def asof_budget(spark, sf):
    """What a greedy run had reached when each budget was used up."""
    s = _steps(spark, sf)
    levels = s.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(float(b)) for b in (20, 40, 80, 120, 200, 400)])).alias("budget"))
    return report.as_of(levels, "budget", s, "allocated", ["acc", "step"], ["run_id"]).select("run_id", "budget", "acc", "step")


@query("greedy_vs_best", KNN_SQL + """, opt AS (SELECT budget, max(acc) AS best FROM runs WHERE acc IS NOT NULL GROUP BY budget),
steps AS (SELECT run_id, allocated, max(acc) AS acc FROM greedy_abs_job_par WHERE acc IS NOT NULL GROUP BY run_id, allocated),
g AS (SELECT run_id, budget, arg_max(s.acc, s.allocated) AS acc FROM steps s JOIN opt ON s.allocated <= opt.budget GROUP BY run_id, budget),
b AS (SELECT budget, max(acc) AS greedy FROM g GROUP BY budget), cur AS (SELECT min(acc) AS curr FROM steps)
SELECT o.budget, b.greedy, o.best, round((CAST(o.best AS DOUBLE) - b.greedy) / b.greedy, 6) AS gain, round(b.greedy * 100.0 / curr, 6) AS greedy_percent, round(o.best * 100.0 / curr, 6) AS best_percent FROM opt o JOIN b USING (budget), cur""")
def greedy_vs_best(spark, sf):
    """Best result of the optimiser at each of its budgets against the best that greedy runs had reached with as much, and
    both in percent of the least accessibility on record."""
    opt = _runs(spark, sf).filter("acc is not null").groupBy("budget").agg(F.max("acc").alias("best"))
    s = _steps(spark, sf)
    levels = s.select("run_id").distinct().join(F.broadcast(opt.select(F.col("budget").cast("double").alias("budget"))))  # a row for each budget of an experiment
    at = report.as_of(levels, "budget", s, "allocated", ["acc"], ["run_id"]).filter("acc is not null")
    b = at.groupBy(F.col("budget").cast("int").alias("budget")).agg(F.max("acc").alias("greedy"))
    both = opt.join(b, "budget").withColumn("one", F.lit(1)).join(F.broadcast(s.agg(F.min("acc").alias("curr"), F.lit(1).alias("one"))), "one")
    percent = lambda c: F.round(F.try_divide(F.col(c) * 100.0, F.col("curr")), 6)
    return both.select("budget", "greedy", "best", F.round(F.try_divide(F.col("best").cast("double") - F.col("greedy"), F.col("greedy")), 6).alias("gain"), percent("greedy").alias("greedy_percent"), percent("best").alias("best_percent"))


@query("last_design_at_budget", KNN_SQL + " SELECT ins_id, arg_max(projects, ROW(budget, obj, rec_id)) AS projects FROM runs WHERE budget <= 300 GROUP BY ins_id")
def last_design_at_budget(spark, sf):
    """Design of the greatest budget within a limit, not the last row of a file."""
    return _runs(spark, sf).filter("budget <= 300").groupBy("ins_id").agg(F.max_by("projects", F.struct("budget", "obj", "rec_id")).alias("projects"))


LISTS_SQL = KNN_SQL + r""", l AS (SELECT rec_id, obj, ins_id, budget, from_json(projects, '["BIGINT"]') AS p FROM runs)"""


def _lists(spark, sf):
    """(rec_id, proj) of every result in use, whatever form its list has."""
    v = packed.split_packed(_runs(spark, sf).select("rec_id", "projects"), "rec_id", "projects")
    return v.select("rec_id", "pos", F.expr("try_cast(try_cast(value AS double) AS bigint)").alias("proj"))


@query("list_literals", LISTS_SQL + " SELECT rec_id, CAST(len(p) AS BIGINT) AS n, CAST(list_sum(p) AS BIGINT) AS total FROM l WHERE len(p) > 0")
def list_literals(spark, sf):
    """Number and sum of the listed projects of each result; results without any are left out."""
    return _lists(spark, sf).groupBy("rec_id").agg(F.count("*").alias("n"), F.sum("proj").alias("total"))


@query("project_frequency", LISTS_SQL + " SELECT CAST(proj AS BIGINT) AS proj, count(*) AS runs, round(avg(obj), 6) AS mean_obj FROM (SELECT obj, unnest(p) AS proj FROM l) GROUP BY proj")
def project_frequency(spark, sf):
    """Selected projects, one to a row, joined to their results."""
    rows = _lists(spark, sf).join(_runs(spark, sf).select("rec_id", "obj"), "rec_id")
    return rows.groupBy("proj").agg(F.count("*").alias("runs"), F.round(F.avg("obj"), 6).alias("mean_obj"))


@query("resumable_work", KNN_SQL + ", done AS (SELECT DISTINCT ins_id, budget, seed FROM complete_pcenter_naive) SELECT ins_id, budget, seed FROM (SELECT DISTINCT ins_id, budget, seed FROM runs) r ANTI JOIN done d USING (ins_id, budget, seed)")
def resumable_work(spark, sf):
    """Keys still to be computed: those of one result table that another has not."""
    keys = ["ins_id", "budget", "seed"]
    return files.pending(_runs(spark, sf).select(*keys).distinct(), table(spark, sf, "complete_pcenter_naive"), keys)


@query("first_qualifying", "SELECT user_id, days FROM (SELECT user_id, count(DISTINCT day(ts)) AS days FROM events GROUP BY user_id) WHERE days > 0 AND days < 30 ORDER BY user_id LIMIT 20")
def first_qualifying(spark, sf):
    """The first twenty scenarios that are neither empty nor full: a bounded selection by id."""
    d = table(spark, sf, "events").groupBy("user_id").agg(F.countDistinct(F.dayofmonth("ts")).alias("days"))
    return d.filter("days > 0 and days < 30").orderBy("user_id").limit(20)


@query("drop_incomplete", "SELECT od_id, orig, des, time FROM od WHERE time IS NOT NULL AND NOT isnan(time)")
def drop_incomplete(spark, sf):
    return table(spark, sf, "od").na.drop(subset=["time"]).select("od_id", "orig", "des", "time")


# --- scalar functions over all lines -----------------------------------------------------------------------------

def _decay_sql(v):
    a, b, t = C.DECAY[v]
    m = "least(CASE WHEN time IS NULL OR time < 0 THEN (SELECT max(time) FROM p) ELSE time END, 60)"
    return f"round(1 - {m} * CAST({a!r} AS DOUBLE) - greatest({m} - {t}, 0) * (CAST({b!r} AS DOUBLE) - CAST({a!r} AS DOUBLE)), 9) AS {v}"


@query("time_to_access", "WITH p AS (SELECT DISTINCT od_id, CASE WHEN isnan(time) THEN NULL ELSE time END AS time FROM od) SELECT od_id, " + ", ".join(_decay_sql(v) for v in C.DECAY) + " FROM p")
def time_to_access(spark, sf):
    """Accessibility left of each travel time under the three decays; the longest time is one row joined back."""
    p = table(spark, sf, "od").select("od_id", F.when(~F.isnan("time"), F.col("time")).alias("time")).distinct().withColumn("one", F.lit(1))
    p = p.join(F.broadcast(p.agg(F.max("time").alias("longest"), F.lit(1).alias("one"))), "one")
    return p.select("od_id", *[F.round(C.decayed_access(F.col("time"), v, F.col("longest")), 9).alias(v) for v in C.DECAY])


@query("time_to_penalty", "WITH p AS (SELECT DISTINCT od_id, CASE WHEN isnan(time) THEN NULL ELSE time END AS time FROM od) SELECT od_id, round(CASE WHEN time IS NULL OR time < 0 THEN 1 ELSE time * 0.001 + CASE WHEN time > 28 THEN (time - 28) * ((1 - 0.001 * 28) / 2 - 0.001) ELSE 0 END END, 9) AS penalty FROM p")
def time_to_penalty(spark, sf):
    p = table(spark, sf, "od").select("od_id", F.when(~F.isnan("time"), F.col("time")).alias("time")).distinct()
    return p.select("od_id", F.round(C.time_penalty(F.col("time"), C.betas(0.001, 28, 30), 28), 9).alias("penalty"))


def _graph_access_sql() -> str:
    a, b, t, _ = C.GRAPH_DECAY["synthetic"]
    c, d, u, cap = C.GRAPH_DECAY["real"]
    n = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"""WITH p AS (SELECT DISTINCT od_id, coalesce(CASE WHEN isnan(time) THEN NULL ELSE time END, -1) AS t FROM od),
q AS (SELECT od_id, CASE WHEN t < 0 THEN (SELECT max(t) FROM p) ELSE t END AS l, least(t, {cap}) AS m FROM p),
r AS (SELECT od_id, 1 - l * {n(a)} - greatest(l - {t}, 0) * ({n(b)} - {n(a)}) AS plain, 1 - m * {n(c)} - greatest(m - {u}, 0) * ({n(d)} - {n(c)}) AS acc FROM q)
SELECT od_id, round(plain, 9) + 0 AS plain, round(CASE WHEN acc <= 1 THEN acc ELSE 0 END, 9) + 0 AS masked FROM r"""


@query("masked_access", _graph_access_sql())
def masked_access(spark, sf):
    """Accessibility that similarity graphs are made from. Plain: pairs out of reach take the longest time. Masked: times
    are capped, and what is out of reach, a negative time that comes out above one, is masked to nothing."""
    t = F.coalesce(F.when(~F.isnan("time"), F.col("time")), F.lit(-1.0))
    p = table(spark, sf, "od").select("od_id", t.alias("t")).distinct().withColumn("one", F.lit(1))
    p = p.join(F.broadcast(p.agg(F.max("t").alias("longest"), F.lit(1).alias("one"))), "one")

    def access_at(v: str, time):
        first, second, threshold, _ = C.GRAPH_DECAY[v]
        return 1 - time * first - F.greatest(time - threshold, F.lit(0.0)) * (second - first)

    plain = access_at("synthetic", F.when(F.col("t") < 0, F.col("longest")).otherwise(F.col("t")))
    acc = access_at("real", F.least("t", F.lit(float(C.GRAPH_DECAY["real"][3]))))
    return p.select("od_id", (F.round(plain, 9) + 0).alias("plain"), (F.round(F.when(acc <= 1, acc).otherwise(0.0), 9) + 0).alias("masked"))


@query("beta_second_diff", "WITH f AS (SELECT i, i * power(1.02, i) AS f FROM (SELECT unnest(range(0, 101)) AS i)) SELECT i, round(d, 9) AS value FROM (SELECT i, f - 2 * lag(f, 1) OVER (ORDER BY i) + coalesce(lag(f, 2) OVER (ORDER BY i), 0) AS d FROM f) WHERE i > 0")
def beta_second_diff(spark, sf):
    """Second differences of i * alpha^i, a list of a hundred."""
    f = spark.range(0, 101).select(F.col("id").alias("i"), (F.col("id") * F.pow(F.lit(1.02), F.col("id"))).alias("f"))
    w = Window.orderBy("i")
    return f.select("i", F.round(F.col("f") - 2 * F.lag("f", 1).over(w) + F.coalesce(F.lag("f", 2).over(w), F.lit(0.0)), 9).alias("value")).filter("i > 0")


# --- sequences: the events of a user in order are a route over event types ---------------------------------------

SEQ_SQL = "WITH e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("route_run_score", SEQ_SQL + """, m AS (SELECT user_id, k, event_type IN ('view', 'click', 'signup') AS c FROM e), i AS (SELECT user_id, k, c, k - row_number() OVER (PARTITION BY user_id, c ORDER BY k) AS island FROM m),
r AS (SELECT user_id, island, count(*) AS n FROM i WHERE c GROUP BY user_id, island) SELECT u.user_id, round(coalesce(sum(n * power(1.02, n)), 0), 6) AS score FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY u.user_id""")
def route_run_score(spark, sf):
    """Runs of covered steps of each user's sequence. Islands are found by two row numbers, so a user of any number of
    events is sorted, not collected."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("view", "click", "signup").alias("c"))
    e = e.withColumn("k", F.row_number().over(w)).withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("user_id", "c").orderBy("k")))
    runs = e.groupBy("user_id", "c", "island").agg(F.count("*").alias("n"))
    worth = F.when(F.col("c"), F.col("n") * F.pow(F.lit(1.02), F.col("n"))).otherwise(0.0)
    return runs.groupBy("user_id").agg(F.round(F.sum(worth), 6).alias("score"))


@query("consecutive_edges", SEQ_SQL + ", p AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY k) AS b FROM e) SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b")
def consecutive_edges(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return p.filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


ROUTE_SQL = """WITH e AS (SELECT l_orderkey AS od_id, l_suppkey % 3 AS r, l_partkey % 40 AS node, l_linenumber, l_partkey, l_quantity FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY od_id, r ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM e),
routes AS (SELECT od_id * 10 + r AS route_id, od_id, r, list(node ORDER BY k) AS nodes FROM k GROUP BY od_id, r HAVING count(*) > 1),
steps AS (SELECT route_id, od_id, unnest(range(1, len(nodes))) AS pos, nodes FROM routes), st AS (SELECT route_id, od_id, pos, nodes[pos] AS a, nodes[pos + 1] AS b FROM steps)"""


def _routes(spark, sf):
    """Routes: the lines of an order split by supplier into up to three lists of places."""
    w = Window.partitionBy("od_id", "r").orderBy("l_linenumber", "l_partkey", "l_quantity")
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("od_id"), (F.col("l_suppkey") % 3).alias("r"), (F.col("l_partkey") % 40).alias("node"), "l_linenumber", "l_partkey", "l_quantity")
    k = e.withColumn("k", F.row_number().over(w))
    r = k.groupBy("od_id", "r").agg(F.sort_array(F.collect_list(F.struct("k", "node"))).alias("s")).filter(F.size("s") > 1)
    return r.select((F.col("od_id") * 10 + F.col("r")).alias("route_id"), "od_id", "r", F.col("s.node").alias("nodes"))


@query("subsequences", ROUTE_SQL + ", s AS (SELECT array_to_string(nodes[i : j], '-') AS seg FROM (SELECT nodes, i, unnest(range(i + 1, len(nodes) + 1)) AS j FROM (SELECT nodes, unnest(range(1, len(nodes))) AS i FROM routes))) SELECT seg, count(*) AS n FROM s GROUP BY seg")
def subsequences(spark, sf):
    """All contiguous parts of routes, counted."""
    s = _routes(spark, sf).select(F.explode(C.subsequences(F.col("nodes"))).alias("seg"))
    return s.select(F.array_join(F.col("seg").cast("array<string>"), "-").alias("seg")).groupBy("seg").agg(F.count("*").alias("n"))


@query("segment_ids", ROUTE_SQL + ", seg AS (SELECT a, b, min(ROW(route_id, pos)) AS first_at FROM st GROUP BY a, b) SELECT row_number() OVER (ORDER BY first_at) - 1 AS seg_id, a, b FROM seg")
def segment_ids(spark, sf):
    """Dense ids of segments by first appearance. There are as many segments as pairs of places, not as routes."""
    steps = _routes(spark, sf).select("route_id", F.posexplode(C.consecutive_pairs(F.col("nodes"))).alias("pos", "e"))
    seg = steps.groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.min(F.struct("route_id", "pos")).alias("first_at"))
    return seg.select((F.row_number().over(Window.orderBy("first_at")) - 1).cast("long").alias("seg_id"), "a", "b")


@query("segment_projects", "WITH RECURSIVE " + NET + "," + ROUTE_SQL.removeprefix("WITH ").replace("routes AS", "rts AS").replace("FROM routes", "FROM rts").replace("steps AS", "stps AS").replace("FROM steps", "FROM stps") + " SELECT DISTINCT s.a, s.b, p.proj FROM st s JOIN projects p ON p.a = least(s.a, s.b) AND p.b = greatest(s.a, s.b)")
def segment_projects(spark, sf):
    """Segments of all routes with the projects they touch: joined to project edges in either direction."""
    steps = _routes(spark, sf).select(F.explode(C.consecutive_pairs(F.col("nodes"))).alias("e")).select("e.a", "e.b").distinct()
    p = Network(spark, sf).project_edges.select("proj", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    return steps.join(p.select("proj", "e.a", "e.b").distinct(), ["a", "b"]).select("a", "b", "proj")


UTIL_SQL = ROUTE_SQL + """, sh AS (SELECT od_id, a, b, count(DISTINCT route_id) AS sharing FROM st GROUP BY od_id, a, b),
vb AS (SELECT route_id, ln(sum(1.0 / n / sharing)) AS v_bar FROM (SELECT DISTINCT st.route_id, st.od_id, st.a, st.b, len(nodes) - 1 AS n FROM st JOIN routes USING (route_id)) d JOIN sh USING (od_id, a, b) GROUP BY route_id)"""


@query("vbar_overlap", UTIL_SQL + " SELECT route_id, round(v_bar, 6) + 0 AS v_bar FROM vb")
def vbar_overlap(spark, sf):
    return access.route_overlap(_routes(spark, sf)).select("route_id", (F.round("v_bar", 6) + 0).alias("v_bar"))


UTIL2_SQL = UTIL_SQL + """, c AS (SELECT route_id, pos, (a * 3 + b) % 4 < 2 AS c FROM st), i AS (SELECT route_id, pos, c, pos - row_number() OVER (PARTITION BY route_id, c ORDER BY pos) AS island FROM c),
sc AS (SELECT route_id, sum(n * power(1.02, n)) AS score FROM (SELECT route_id, island, count(*) AS n FROM i WHERE c GROUP BY route_id, island) GROUP BY route_id),
v AS (SELECT r.od_id, r.route_id, coalesce(sc.score, 0) - vb.v_bar AS v FROM routes r LEFT JOIN sc USING (route_id) JOIN vb USING (route_id)),
u AS (SELECT od_id, sum(exp(v - m) * v) / sum(exp(v - m)) AS utility FROM (SELECT *, max(v) OVER (PARTITION BY od_id) AS m FROM v) GROUP BY od_id)"""


def _utilities(spark, sf):
    r = _routes(spark, sf)
    open_edges = spark.range(40).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("dst")).filter("(src * 3 + dst) % 4 < 2")
    scored = access.route_scores(r, open_edges, 1.02).join(access.route_overlap(r), "route_id")
    return access.expected_utility(scored)


@query("route_utility", UTIL2_SQL + " SELECT od_id, round(utility, 6) AS utility FROM u")
def route_utility(spark, sf):
    return _utilities(spark, sf).select("od_id", F.round("utility", 6).alias("utility"))


@query("utility_objective", UTIL2_SQL + " SELECT round(sum(utility * (1 + od_id % 9)), 4) AS obj, count(*) AS pairs FROM u")
def utility_objective(spark, sf):
    return _utilities(spark, sf).agg(F.round(F.sum(F.col("utility") * (1 + F.col("od_id") % 9)), 4).alias("obj"), F.count("*").alias("pairs"))


# --- equity ------------------------------------------------------------------------------------------------------

@query("qcut_quintile", "WITH q AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM customer) SELECT c_custkey, CAST(1 + (c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT + (c_acctbal > q[3])::INT + (c_acctbal > q[4])::INT AS INTEGER) AS quintile FROM customer, q")
def qcut_quintile(spark, sf):
    return report.quantile_group(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 5, "quintile").select("c_custkey", "quintile")


EQ_SQL = """, score AS (SELECT CAST(c_nationkey AS BIGINT) AS orig, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY 1),
eq AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM score),
grp AS (SELECT orig, CAST(1 + (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT AS INTEGER) AS grp FROM score, eq),
near AS (SELECT orig, node FROM nw WHERE orig <> node),
curr AS (SELECT orig, CAST(sum(population) AS BIGINT) AS curr FROM near JOIN pot USING (node) GROUP BY orig)"""


def _equity(spark, sf):
    from wayfold.operators import graph

    n = Network(spark, sf)
    score = n.table("customer").groupBy(F.col("c_nationkey").cast("long").alias("orig")).agg(F.round(F.avg("c_acctbal"), 6).alias("score"))
    grp = report.quantile_group(score, "score", 5, "grp").select("orig", "grp")
    near = n.reach(n.current, 15).filter("orig != node").join(n.potentials, "node")
    return n, grp, near.groupBy("orig").agg(F.sum("population").alias("curr"))


from wayfold.plans.base import reach as _reach  # noqa: E402


@query("equity_access", with_net(" SELECT g.orig, g.grp, coalesce(c.curr, 0) AS curr, t.total FROM grp g LEFT JOIN curr c USING (orig) CROSS JOIN (SELECT CAST(sum(population) AS BIGINT) AS total FROM pot) t", _reach("nw", "cur", 15) + EQ_SQL))
def equity_access(spark, sf):
    """Current accessibility of each origin (0 without any) and the total, with its quintile."""
    n, grp, curr = _equity(spark, sf)
    total = n.potentials.agg(F.sum("population").alias("total"), F.lit(1).alias("one"))
    rows = grp.join(curr, "orig", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    return rows.select("orig", "grp", F.coalesce("curr", F.lit(0)).alias("curr"), "total")


@query("equity_groups", with_net(" SELECT grp, count(*) AS origins, round(avg(coalesce(curr, 0)), 6) AS mean_curr FROM grp LEFT JOIN curr USING (orig) GROUP BY grp", _reach("nw", "cur", 15) + EQ_SQL))
def equity_groups(spark, sf):
    _, grp, curr = _equity(spark, sf)
    rows = grp.join(curr, "orig", "left")
    return rows.groupBy("grp").agg(F.count("*").alias("origins"), F.round(F.avg(F.coalesce("curr", F.lit(0))), 6).alias("mean_curr"))


@query("equity_weights", with_net(" SELECT grp.grp, near.rep, round(sum(near.worth), 6) AS weight, round(avg(coalesce(c.curr, 0)), 6) AS mean_curr FROM near JOIN grp ON grp.orig = near.id % 25 LEFT JOIN curr c ON c.orig = grp.orig WHERE near.place = 1 GROUP BY grp.grp, near.rep", _reach("nw", "cur", 15) + EQ_SQL.replace("near AS", "close AS").replace("FROM near JOIN", "FROM close JOIN"), VEC_SQL.removeprefix("WITH ")))
def equity_weights(spark, sf):
    """Potential that each group hands to each representative, and the mean current accessibility behind it: items go to
    their nearest representative and to the group of their origin."""
    _, grp, curr = _equity(spark, sf)
    i = _items(spark, sf)
    near = coreset.nearest(i, _reps(i), 1).select("id", "rep").join(i.select("id", "worth"), "id")
    rows = near.withColumn("orig", F.col("id") % 25).join(grp, "orig").join(curr, "orig", "left")
    return rows.groupBy("grp", "rep").agg(F.round(F.sum(F.col("worth").cast("double")), 6).alias("weight"), F.round(F.avg(F.coalesce("curr", F.lit(0))), 6).alias("mean_curr"))


# --- evaluation --------------------------------------------------------------------------------------------------

@query("best_const_mae", "WITH b AS (SELECT min(label) AS lo, max(label) AS hi FROM embeddings), c AS (SELECT k, lo + k * (hi - lo) / 99.0 AS c FROM b, (SELECT unnest(range(0, 100)) AS k)), m AS (SELECT k, CAST(c AS DOUBLE) AS c, avg(abs(label - CAST(c AS DOUBLE))) AS mae FROM c, embeddings GROUP BY k, c) SELECT round(c, 6) AS const, round(mae, 6) AS mae FROM m ORDER BY round(mae, 9), c LIMIT 1")
def best_const_mae(spark, sf):
    """Best constant on a grid of a hundred points. Values are counted first, so the grid meets distinct values only."""
    y = table(spark, sf, "embeddings").groupBy(F.col("label").cast("double").alias("y")).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    b = y.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.lit(1).alias("one"))
    grid = b.select("one", F.explode(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / 99.0)).alias("c"))
    m = y.join(F.broadcast(grid), "one").groupBy("c").agg((F.sum(F.abs(F.col("y") - F.col("c")) * F.col("n")) / F.sum("n")).alias("mae"))
    best = m.agg(F.min(F.struct(F.round("mae", 9).alias("m"), "c", "mae")).alias("b"))
    return best.select(F.round("b.c", 6).alias("const"), F.round("b.mae", 6).alias("mae"))


@query("mae_by_scenario", "SELECT user_id AS scen, round(avg(abs(value - m)), 6) AS mae, round(1 - avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS naive_accuracy FROM (SELECT user_id, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY user_id")
def mae_by_scenario(spark, sf):
    """Error of a mean predictor per scenario: two grouped aggregates, no window over whole types."""
    e = table(spark, sf, "events")
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"))
    return e.join(m, "event_type").groupBy(F.col("user_id").alias("scen")).agg(F.round(F.avg(F.abs(F.col("value") - F.col("m"))), 6).alias("mae"), F.round(1 - F.avg((F.col("value") > 20).cast("int")), 6).alias("naive_accuracy"))
