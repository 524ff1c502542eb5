"""Queries of scenarios, design search, walks, embeddings and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import coreset, design, graph, learn, similarity, walks
from wayfold.plans.base import OD, query, with_net
from wayfold.plans.network import TIME_LIMIT, TIME_MAX, Network
from wayfold.plans.vectors import _items, _reps, _scenario_items
from wayfold.session import table

# --- scenarios: each user of the events opens a pseudo-random set of projects --------------------------------------

SCEN = """
chosen AS (SELECT u.scen, p.proj FROM (SELECT DISTINCT user_id AS scen FROM events) u JOIN projects p ON (u.scen * 37 + p.proj * 11) % 5 < 2)"""
SCEN_REACH = """
scen_edges AS (SELECT u.scen, c.src, c.dst, c.time FROM (SELECT DISTINCT user_id AS scen FROM events) u, cur c UNION ALL SELECT ch.scen, p.src, p.dst, p.time FROM chosen ch JOIN project_edges p USING (proj)),
sc_r AS (SELECT u.scen, n.id AS orig, n.id AS node, CAST(0 AS BIGINT) AS dist FROM (SELECT DISTINCT user_id AS scen FROM events) u, nodes n
  UNION SELECT r.scen, r.orig, e.dst, r.dist + e.time FROM sc_r r JOIN scen_edges e ON e.scen = r.scen AND e.src = r.node WHERE r.dist + e.time <= 20),
sc AS (SELECT scen, orig, node, min(dist) AS dist FROM sc_r GROUP BY scen, orig, node)"""


def _scenarios(spark, sf):
    n = Network(spark, sf)
    users = n.table("events").select(F.col("user_id").alias("scen")).distinct().withColumn("one", F.lit(1))
    every = n.projects.agg(F.sort_array(F.collect_list("proj")).alias("all"), F.lit(1).alias("one"))  # projects are few
    rows = users.join(F.broadcast(every), "one")
    return n, rows.select("scen", F.filter("all", lambda p: (F.col("scen") * 37 + p * 11) % 5 < 2).cast("array<int>").alias("open"))


@query("scenario_designs", with_net(" SELECT scen, CAST(proj AS INTEGER) AS proj FROM chosen", SCEN))
def scenario_designs(spark, sf):
    _, s = _scenarios(spark, sf)
    return s.select("scen", F.explode("open").alias("proj"))


def _scenario_od(spark, sf):
    n, s = _scenarios(spark, sf)
    runs = s.select("scen", "open", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("orig")).repartition("scen")
    far = graph.reach_of_designs(runs, n.current, n.project_edges, TIME_MAX)
    return n, s, far.join(n.od.select("od_id", "orig", F.col("des").alias("node")), ["orig", "node"]).select("scen", "od_id", F.col("dist").cast("long").alias("t"))


@query("scenario_od", with_net(" SELECT sc.scen, od.od_id, sc.dist AS t FROM sc JOIN od ON od.orig = sc.orig AND od.des = sc.node", OD, SCEN, SCEN_REACH))
def scenario_od(spark, sf):
    """Travel times of all pairs under all scenarios; pairs out of reach give no row."""
    return _scenario_od(spark, sf)[2]


@query("scenario_accessibility", with_net(" SELECT sc.scen, CAST(sum(p.population) AS BIGINT) AS acc, count(*) AS pairs FROM sc JOIN od ON od.orig = sc.orig AND od.des = sc.node JOIN pot p ON p.node = sc.node WHERE sc.dist <= 15 GROUP BY sc.scen", OD, SCEN, SCEN_REACH))
def scenario_accessibility(spark, sf):
    n, _, t = _scenario_od(spark, sf)
    worth = n.od.select("od_id", F.col("des").alias("node")).join(n.potentials, "node").select("od_id", "population")
    return t.filter(F.col("t") <= TIME_LIMIT).join(worth, "od_id").groupBy("scen").agg(F.sum("population").alias("acc"), F.count("*").alias("pairs"))


@query("scenario_connection_share", with_net(", c AS (SELECT od.od_id, count(*) AS n FROM sc JOIN od ON od.orig = sc.orig AND od.des = sc.node GROUP BY od.od_id) SELECT od_id, n AS scenarios FROM c WHERE n > 0 AND n < (SELECT count(DISTINCT user_id) FROM events)", OD, SCEN, SCEN_REACH))
def scenario_connection_share(spark, sf):
    """Pairs that some but not all scenarios connect."""
    _, s, t = _scenario_od(spark, sf)
    c = t.groupBy("od_id").agg(F.count("*").alias("scenarios"), F.lit(1).alias("one"))
    return c.join(F.broadcast(s.agg(F.count("*").alias("all"), F.lit(1).alias("one"))), "one").filter("scenarios > 0 and scenarios < all").select("od_id", "scenarios")


# --- design search -------------------------------------------------------------------------------------------------

def problem(spark, sf, packages: int | None = None, worth=None, weights=None, charge: float = 0.0) -> design.Problem:
    n = Network(spark, sf)
    edges = n.project_edges  # with packages, all projects are dealt to that many packages that open as one
    if packages:
        edges = edges.withColumn("proj", F.col("proj") % packages)
    costs = edges.groupBy("proj").agg(F.sum("time").alias("cost"))
    pairs = n.od.select("od_id", "orig", "des").join(n.potentials.select(F.col("node").alias("des"), F.col("population").alias("weight")), "des")
    if weights is not None:
        pairs = pairs.join(weights, "od_id").withColumn("weight", F.col("weight") * F.col("factor"))
    cutoff = TIME_LIMIT if worth is None else TIME_MAX
    return design.Problem(n.current, edges, costs, pairs.select("od_id", "orig", "des", "weight"), cutoff, worth or (lambda d: F.lit(1.0)), charge)


STEP_SQL = """
pe AS (SELECT p.proj AS scen, c.src, c.dst, c.time FROM projects p, cur c UNION ALL SELECT proj, src, dst, time FROM project_edges),
st_r AS (SELECT p.proj AS scen, n.id AS orig, n.id AS node, CAST(0 AS BIGINT) AS dist FROM projects p, nodes n
  UNION SELECT r.scen, r.orig, e.dst, r.dist + e.time FROM st_r r JOIN pe e ON e.scen = r.scen AND e.src = r.node WHERE r.dist + e.time <= 15),
st AS (SELECT scen, orig, node, min(dist) AS dist FROM st_r GROUP BY scen, orig, node),
cost AS (SELECT proj, CAST(sum(time) AS BIGINT) AS cost FROM project_edges GROUP BY proj),
g AS (SELECT c.proj, c.cost, CAST(coalesce(sum(p.population), 0) AS DOUBLE) AS gain FROM cost c LEFT JOIN (SELECT st.scen, st.node FROM st JOIN od ON od.orig = st.orig AND od.des = st.node) h ON h.scen = c.proj LEFT JOIN pot p ON p.node = h.node GROUP BY c.proj, c.cost)"""


@query("greedy_candidates", with_net(" SELECT proj, cost, gain FROM g", OD, STEP_SQL))
def greedy_candidates(spark, sf):
    """Gain of opening each project alone. Pairs are those not connected yet, so nothing open scores nothing."""
    return design.candidate_gains(problem(spark, sf), []).select("proj", "cost", "gain")


@query("greedy_step_abs", with_net(" SELECT proj, cost, gain FROM g WHERE gain > 0 AND cost <= 30 ORDER BY gain DESC, proj LIMIT 1", OD, STEP_SQL))
def greedy_step_abs(spark, sf):
    return design.best_candidate(design.candidate_gains(problem(spark, sf), []), 30, False).select("proj", "cost", "gain")


@query("greedy_step_ratio", with_net(" SELECT proj, cost, gain FROM g WHERE gain > 0 AND cost <= 30 ORDER BY round(gain / cost, 9) DESC, proj LIMIT 1", OD, STEP_SQL))
def greedy_step_ratio(spark, sf):
    return design.best_candidate(design.candidate_gains(problem(spark, sf), []), 30, True).select("proj", "cost", "gain")


@query("greedy_design")
def greedy_design(spark, sf):
    return design.greedy(problem(spark, sf), 30)


@query("greedy_design_ratio")
def greedy_design_ratio(spark, sf):
    return design.greedy(problem(spark, sf), 30, per_cost=True)


def enum_sql(packages: int, budget: float, cutoff: int = TIME_LIMIT, worth: str = "1", factor: str = "1", charge: float = 0.0) -> str:
    """All affordable sets of packages with their scores."""
    return f"""
pack AS (SELECT proj % {packages} AS proj, src, dst, time FROM project_edges), cost AS (SELECT proj, CAST(sum(time) AS BIGINT) AS cost FROM pack GROUP BY proj),
sets AS (SELECT b AS scen, coalesce(sum(CASE WHEN (b >> proj) & 1 = 1 THEN cost END), 0) AS cost FROM (SELECT unnest(range(0, {2**packages})) AS b), cost GROUP BY b HAVING coalesce(sum(CASE WHEN (b >> proj) & 1 = 1 THEN cost END), 0) <= {budget}),
se AS (SELECT s.scen, c.src, c.dst, c.time FROM sets s, cur c UNION ALL SELECT s.scen, p.src, p.dst, p.time FROM sets s JOIN pack p ON (s.scen >> p.proj) & 1 = 1),
en_r AS (SELECT s.scen, n.id AS orig, n.id AS node, CAST(0 AS BIGINT) AS dist FROM sets s, nodes n UNION SELECT r.scen, r.orig, e.dst, r.dist + e.time FROM en_r r JOIN se e ON e.scen = r.scen AND e.src = r.node WHERE r.dist + e.time <= {cutoff}),
en AS (SELECT scen, orig, node, min(dist) AS dist FROM en_r GROUP BY scen, orig, node),
score AS (SELECT sets.scen, coalesce(v.v, 0) - CAST({charge!r} AS DOUBLE) * bit_count(sets.scen) AS score FROM sets LEFT JOIN (
  SELECT en.scen, CAST(sum(p.population * ({worth}) * ({factor})) AS DOUBLE) AS v FROM en JOIN od ON od.orig = en.orig AND od.des = en.node JOIN pot p ON p.node = en.node GROUP BY en.scen) v USING (scen))"""


ENUM_SQL = enum_sql(8, 100)
BEST_SCORE = " SELECT round(score, 6) AS score FROM score ORDER BY round(score, 9) DESC, scen LIMIT 1"


def _worth_sql(variant: str) -> str:
    from wayfold.plans.reachability import VARIANTS

    b1, limit, most = VARIANTS[variant]
    _, b1, b2 = C.betas(b1, limit, most)
    return f"1 - CASE WHEN en.dist <= {limit} THEN en.dist * CAST({b1!r} AS DOUBLE) ELSE CAST({b1!r} AS DOUBLE) * {limit} + CAST({b2!r} AS DOUBLE) * (en.dist - {limit}) END"


@query("enumerated_design", with_net(" SELECT scen, CAST(cost AS DOUBLE) AS cost, coalesce(score, 0) AS score FROM sets LEFT JOIN score USING (scen) ORDER BY coalesce(score, 0) DESC, scen LIMIT 1", OD, ENUM_SQL))
def enumerated_design(spark, sf):
    """Exact best design of all projects in eight packages, by trying all affordable sets."""
    return design.enumerate_best(problem(spark, sf, 8), 8, 100).select("scen", "cost", "score")


@query("enumerated_piecewise", with_net(" SELECT scen, CAST(cost AS DOUBLE) AS cost, round(score, 6) AS score FROM sets JOIN score USING (scen) ORDER BY round(score, 9) DESC, scen LIMIT 1", OD, enum_sql(8, 100, TIME_MAX, _worth_sql("exp"))))
def enumerated_piecewise(spark, sf):
    """The same with the piecewise worth of travel times."""
    return design.enumerate_best(problem(spark, sf, 8, _piecewise("exp")), 8, 100).select("scen", "cost", F.round("score", 6).alias("score"))


@query("cut_loop_design", with_net(BEST_SCORE, OD, ENUM_SQL))
def cut_loop_design(spark, sf):
    """The same optimum through cuts and a master problem."""
    return design.cut_loop(problem(spark, sf, 8), 100).select(F.round("score", 6).alias("score"))


@query("cut_loop_strengthened", with_net(BEST_SCORE, OD, ENUM_SQL))
def cut_loop_strengthened(spark, sf):
    """The same optimum with cuts made deepest at a core point, and cuts near the relaxed optimum before the search."""
    return design.cut_loop(problem(spark, sf, 8), 100, strengthen=True, root=3).select(F.round("score", 6).alias("score"))


def _piecewise(variant):
    from wayfold.plans.reachability import VARIANTS

    b1, limit, most = VARIANTS[variant]
    return lambda d: 1 - C.penalty(d, C.betas(b1, limit, most), limit, most)


@query("cut_loop_piecewise", with_net(BEST_SCORE, OD, enum_sql(10, 80, TIME_MAX, _worth_sql("exp"), charge=1.0)))
def cut_loop_piecewise(spark, sf):
    """Cuts with the piecewise objective and a charge per project."""
    return design.cut_loop(problem(spark, sf, 10, _piecewise("exp"), charge=1.0), 80).select(F.round("score", 6).alias("score"))


GROUPS_SQL = """
sc0 AS (SELECT CAST(c_nationkey AS BIGINT) AS orig, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY 1), eq AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM sc0),
grp AS (SELECT orig, 1 + (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT AS grp FROM sc0, eq)"""


def _groups(spark, sf):
    """(orig, grp): origins by quintile of their customers' mean balance."""
    from wayfold.operators.report import quantile_group

    score = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("orig")).agg(F.round(F.avg("c_acctbal"), 6).alias("s"))
    return quantile_group(score, "s", 5, "grp").select("orig", "grp")


@query("cut_loop_equity", with_net(BEST_SCORE, OD, GROUPS_SQL, enum_sql(10, 80, factor="coalesce((SELECT 6.0 - g.grp FROM grp g WHERE g.orig = en.orig), 0)")))
def cut_loop_equity(spark, sf):
    """Cuts with pairs weighted by the quintile of their origin, the poorest most."""
    n = Network(spark, sf)
    factor = _groups(spark, sf).select("orig", (6.0 - F.col("grp")).alias("factor"))
    return design.cut_loop(problem(spark, sf, 10, weights=n.od.join(factor, "orig").select("od_id", "factor")), 80).select(F.round("score", 6).alias("score"))


@query("reduced_problem_design")
def reduced_problem_design(spark, sf):
    """Greedy design on representatives only, weighted by the pairs they stand for; scored on all pairs."""
    n = Network(spark, sf)
    p = problem(spark, sf)
    at = n.od.select("od_id", F.array((F.col("orig") % 5).cast("double") + 1, F.floor(F.col("orig") / 5).cast("double") + 1, (F.col("des") % 5).cast("double") + 1, F.floor(F.col("des") / 5).cast("double") + 1, F.col("time").cast("double")).alias("vec"))
    items = at.join(p.pairs.select("od_id", "weight"), "od_id").select(F.col("od_id").alias("id"), "vec", F.col("weight").alias("worth"))
    reps = coreset.k_center(items.select("id", "vec"), 40, seed=5, tol=0.02).select("id").join(items, "id")
    w = coreset.assignment_weights(items, reps, coreset.nearest(items, reps, 1).select("id", "rep"))
    small = p.pairs.drop("weight").join(w.select(F.col("rep").alias("od_id"), "weight"), "od_id")
    from wayfold.session import checkpointed

    g = design.greedy(design.Problem(p.base, p.project_edges, p.costs, checkpointed(small), p.cutoff), 24)
    full = p.score(g.select(F.col("step").cast("long").alias("scen"), F.col("selected").alias("open"))).select(F.col("scen").cast("int").alias("step"), F.col("score").alias("full_score"))
    return g.join(full, "step")


@query("swap_design")
def swap_design(spark, sf):
    p = problem(spark, sf, 12)
    start = [r["selected"] for r in design.greedy(p, 60).orderBy(F.desc("step")).limit(1).collect()]
    opened, score = design.swap_search(p, list(start[0]) if start else [], 60, rounds=3)
    return spark.createDataFrame([(opened, float(score))], "open array<int>, score double")


# --- candidate routes ----------------------------------------------------------------------------------------------

ROUTES = "path_{k} AS (SELECT id AS orig, id AS node, CAST(0 AS BIGINT) AS dist, [id] AS path FROM nodes UNION ALL SELECT r.orig, e.dst, r.dist + e.time, list_append(r.path, e.dst) FROM path_{k} r JOIN ({e}) e ON r.node = e.src WHERE r.dist + e.time <= {c}), best_{k} AS (SELECT orig, node, path FROM path_{k} QUALIFY row_number() OVER (PARTITION BY orig, node ORDER BY dist, path) = 1)"
DIRECT = "SELECT src, dst, 1 + abs(src % 5 - dst % 5) + abs(src // 5 - dst // 5) AS time FROM edges"
ARTERIAL = "SELECT src, dst, CASE WHEN lts >= 3 THEN time ELSE time * 3 END AS time FROM edges"


@query("candidate_routes", with_net(" SELECT orig, node, 0 AS kind, array_to_string(path, '-') AS path FROM best_a UNION ALL SELECT orig, node, 1, array_to_string(path, '-') FROM best_b UNION ALL SELECT orig, node, 2, array_to_string(path, '-') FROM best_c",
    ROUTES.format(k="a", e="SELECT src, dst, time FROM edges", c=20), ROUTES.format(k="b", e=DIRECT, c=12), ROUTES.format(k="c", e=ARTERIAL, c=24)))
def candidate_routes(spark, sf):
    """Fastest, most direct and arterial-favouring route of each pair of nodes in reach."""
    n = Network(spark, sf)
    cell = lambda c: (F.col(c) % 5, F.floor(F.col(c) / 5))
    (sx, sy), (dx, dy) = cell("src"), cell("dst")
    nets = [(n.edges.select("src", "dst", "time"), 20), (n.edges.select("src", "dst", (1 + F.abs(sx - dx) + F.abs(sy - dy)).alias("time")), 12), (n.edges.select("src", "dst", F.when(F.col("lts") >= 3, F.col("time")).otherwise(F.col("time") * 3).alias("time")), 24)]
    parts = [graph.shortest_paths(n.origins, e, c).select("orig", "node", F.lit(k).alias("kind"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path")) for k, (e, c) in enumerate(nets)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- walks, embeddings, regressions --------------------------------------------------------------------------------

def _similar(spark, sf):
    return similarity.top_similar(similarity.pair_scores(_scenario_items(spark, sf), similarity.ratio_sum), 10).select("i", "j", "w")


@query("random_walks")
def random_walks(spark, sf):
    return walks.random_walks(_similar(spark, sf), rounds=5, length=10, seed=2).select("round", "start", F.array_join(F.col("nodes").cast("array<string>"), " ").alias("walk"))


@query("word2vec_embedding")
def word2vec_embedding(spark, sf):
    w = walks.random_walks(_similar(spark, sf), rounds=10, length=12, seed=2)
    return walks.word_vectors(w, 16, seed=4)


@query("pca_2d")
def pca_2d(spark, sf):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = _items(spark, sf).select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))


def _labelled(spark, sf):
    x = _items(spark, sf).select("id", "vec", F.col("label").cast("double").alias("y"))
    return x.filter("id % 5 != 0"), x.filter("id % 5 = 0")


@query("regression_mae")
def regression_mae(spark, sf):
    """Held-out absolute error of each regressor."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    train, test = _labelled(spark, sf)
    vec = lambda d: d.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    lasso = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=0.01).fit(vec(train)).transform(vec(test))
    rows = [
        ("least squares", learn.mean_absolute_error(learn.predict(test, learn.least_squares(train)))),
        ("absolute lasso", learn.mean_absolute_error(learn.predict(test, learn.absolute_lasso(train, 0.001, 10)))),
        ("lasso", learn.mean_absolute_error(lasso)),
        ("two neighbours", learn.mean_absolute_error(learn.neighbour_mean(train, test, 2))),
        ("hidden layer", learn.mean_absolute_error(learn.predict_hidden(test, learn.hidden_layer(train)))),
    ]
    return spark.createDataFrame([(a, float(b)) for a, b in rows], "model string, mae double")


@query("logistic_accuracy")
def logistic_accuracy(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train, test = (d.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), (F.col("y") < 5).cast("double").alias("label")) for d in _labelled(spark, sf))
    out = LogisticRegression(maxIter=20).fit(train).transform(test)
    return out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query("reconstructed_objective")
def reconstructed_objective(spark, sf):
    """Total potential of items outside the representatives, predicted from a fit on the representatives: only the sum
    of the outside vectors is needed."""
    items = _items(spark, sf)
    reps = _reps(items)
    fit = learn.least_squares(reps.select("vec", F.col("worth").cast("double").alias("y")), ridge=0.1)
    rest = items.join(reps.select("id"), "id", "left_anti").withColumn("y", F.col("worth").cast("double"))
    return learn.predict(rest, fit).agg(F.sum("prediction").alias("predicted"), F.sum("y").alias("actual"), F.count("*").alias("n"))


def _pair_items(spark, sf, p):
    """Pairs with a small vector of their places and time."""
    n = Network(spark, sf)
    cell = lambda c: ((F.col(c) % 5).cast("double"), F.floor(F.col(c) / 5).cast("double"))
    vec = F.array(*cell("orig"), *cell("des"), F.col("time").cast("double"))
    return n.od.select(F.col("od_id").alias("id"), vec.alias("vec")).join(p.pairs.select(F.col("od_id").alias("id"), F.col("weight").alias("worth")), "id")


@query("regression_weights")
def regression_weights(spark, sf):
    items = _pair_items(spark, sf, problem(spark, sf))
    return learn.regression_weights(items, items.filter("id % 10 = 0"), ridge=1.0).select("rep", F.round("weight", 6).alias("weight"))


def _weighted_design(spark, sf, weigh):
    """Greedy design on representatives with the given weights; every step scored on all pairs."""
    from wayfold.session import checkpointed

    p = problem(spark, sf)
    items = checkpointed(_pair_items(spark, sf, p))
    w = weigh(items, items.filter("id % 10 = 0"))
    small = p.pairs.drop("weight").join(w.select(F.col("rep").alias("od_id"), "weight"), "od_id")
    g = design.greedy(design.Problem(p.base, p.project_edges, p.costs, small, p.cutoff), 24)
    full = p.score(g.select(F.col("step").cast("long").alias("scen"), F.col("selected").alias("open"))).select(F.col("scen").cast("int").alias("step"), F.col("score").alias("full_score"))
    return g.join(full, "step")


@query("regression_design")
def regression_design(spark, sf):
    """Representatives weighted so that a fit predicts all other pairs."""
    return _weighted_design(spark, sf, lambda i, r: learn.regression_weights(i, r, ridge=1.0))


@query("bagged_design")
def bagged_design(spark, sf):
    """Representatives weighted half by nearest ones and half by a fit."""
    return _weighted_design(spark, sf, lambda i, r: learn.bagged_weights(i, r, coreset.nearest(i, r, 1).select("id", "rep"), 0.5, 1.0))


@query("boosted_design")
def boosted_design(spark, sf):
    """Representatives weighted by nearest ones, corrected by a fit of what those get wrong."""
    return _weighted_design(spark, sf, lambda i, r: learn.boosted_weights(i, r, coreset.nearest(i, r, 1).select("id", "rep")))


@query("regression_bounded_design")
def regression_bounded_design(spark, sf):
    """Design of the regression weights among those whose fit on the representatives' own values errs by at most a bound,
    widened by a tenth of their number where no project meets it."""
    from wayfold.session import checkpointed

    p = problem(spark, sf, 12)
    items = checkpointed(_pair_items(spark, sf, p))
    reps = checkpointed(items.filter("id % 10 = 0"))
    w = learn.regression_weights(items, reps, ridge=1.0)
    small = p.pairs.drop("weight").join(w.select(F.col("rep").alias("od_id"), "weight"), "od_id")
    q = design.Problem(p.base, p.project_edges, p.costs, small, p.cutoff)
    n = reps.count()

    def loss(opened):
        near = q.with_open(opened).base_values.select(F.col("od_id").alias("id"), F.lit(1.0).alias("v"))
        return learn.fit_loss(reps.select("id", "vec").join(near, "id", "left").select("vec", F.coalesce("v", F.lit(0.0)).alias("y")), 1.0)

    return design.bounded_greedy(q, 20, loss, 0.1 * n, 0.1 * n)


EQUITY_SQL = ENUM_SQL.replace("score AS (", "flat_score AS (") + "," + GROUPS_SQL + """,
gains AS (SELECT en.scen, g.grp, CAST(sum(p.population) AS DOUBLE) AS gain FROM en JOIN od ON od.orig = en.orig AND od.des = en.node JOIN pot p ON p.node = en.node JOIN grp g ON g.orig = en.orig GROUP BY en.scen, g.grp),
cells AS (SELECT s.scen, g.grp, coalesce(x.gain, 0) AS gain FROM sets s CROSS JOIN (SELECT DISTINCT grp FROM grp) g LEFT JOIN gains x ON x.scen = s.scen AND x.grp = g.grp),
m AS (SELECT scen, sum(gain) AS efficiency, min(gain) AS rawls, sum(ln(1 + gain)) AS nash, -(max(gain) - min(gain)) + 0.001 * sum(gain) AS equality FROM cells GROUP BY scen),
long AS (SELECT scen, 'efficiency' AS criterion, efficiency AS v FROM m UNION ALL SELECT scen, 'rawls', rawls FROM m UNION ALL SELECT scen, 'nash', nash FROM m UNION ALL SELECT scen, 'equality', equality FROM m)"""


@query("equity_criteria", with_net(" SELECT criterion, scen, round(v, 6) AS value FROM long QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY round(v, 9) DESC, scen) = 1", OD, EQUITY_SQL))
def equity_criteria(spark, sf):
    """The best affordable set of packages by each criterion on the gains of the origins' quintiles: total, worst group,
    product (sum of logs), and closeness of groups with the total as a tie-break."""
    from wayfold.operators.report import quantile_group

    n = Network(spark, sf)
    p = problem(spark, sf, 8)
    score = n.table("customer").groupBy(F.col("c_nationkey").cast("long").alias("orig")).agg(F.round(F.avg("c_acctbal"), 6).alias("s"))
    grp = quantile_group(score, "s", 5, "grp").select("orig", "grp")
    designs = design.all_designs(p.costs, 8, 100).select("scen", "open")
    gains = p.values(designs).join(p.pairs.select("od_id", "orig"), "od_id").join(grp, "orig").groupBy("scen", "grp").agg(F.sum("value").alias("gain"))
    groups = grp.select("grp").distinct().agg(F.collect_list("grp").alias("g"), F.lit(1).alias("one"))
    cells = designs.select("scen", F.lit(1).alias("one")).join(F.broadcast(groups), "one").select("scen", F.explode("g").alias("grp"))
    cells = cells.join(gains, ["scen", "grp"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total, low, high = F.sum("gain"), F.min("gain"), F.max("gain")
    m = cells.groupBy("scen").agg(total.alias("efficiency"), low.alias("rawls"), F.sum(F.log1p("gain")).alias("nash"), (-(high - low) + 0.001 * total).alias("equality"))
    long = m.unpivot("scen", ["efficiency", "rawls", "nash", "equality"], "criterion", "v")
    best = long.groupBy("criterion").agg(F.max(F.struct(F.round("v", 9).alias("r"), (-F.col("scen")).alias("s"), "v")).alias("b"))
    return best.select("criterion", (-F.col("b.s")).alias("scen"), F.round("b.v", 6).alias("value"))
