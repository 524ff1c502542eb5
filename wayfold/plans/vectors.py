"""Queries over vectors: nearest representatives, weights, objectives, similarity graphs, features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import coreset, similarity
from wayfold.plans.base import NET, OD, query, with_net
from wayfold.plans.network import Network
from wayfold.session import checkpointed, table

#: Representatives here are the vectors whose number divides by 25; the potential of a vector is its label plus one.
VEC_SQL = """WITH items AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label + 1 AS worth, label FROM embeddings),
reps AS (SELECT * FROM items WHERE id % 25 = 0),
cos AS (SELECT i.id, r.id AS rep, round(1 - list_dot_product(i.vec, r.vec) / sqrt(list_dot_product(i.vec, i.vec)) / sqrt(list_dot_product(r.vec, r.vec)), 9) + 0 AS distance, i.worth FROM items i, reps r),
near AS (SELECT id, rep, distance, worth, row_number() OVER (PARTITION BY id ORDER BY distance, rep) AS place FROM cos)"""


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") + 1).alias("worth"), "label")


def _reps(items):
    return items.filter("id % 25 = 0")


@query("knn_cosine_k1", VEC_SQL + " SELECT id, rep, round(distance, 6) AS distance FROM near WHERE place = 1")
def knn_cosine_k1(spark, sf):
    i = _items(spark, sf)
    return coreset.nearest(i, _reps(i), 1).select("id", "rep", F.round("distance", 6).alias("distance"))


@query("knn_euclid_k3", VEC_SQL + """, euc AS (SELECT i.id, r.id AS rep, round(list_distance(i.vec, r.vec), 9) AS distance FROM items i, reps r)
SELECT id, rep, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, rep) AS INTEGER) AS place FROM euc QUALIFY place <= 3""")
def knn_euclid_k3(spark, sf):
    i = _items(spark, sf)
    return coreset.nearest(i, _reps(i), 3, "euclidean").select("id", "rep", F.round("distance", 6).alias("distance"), "place")


@query("nearest_pairs_skip_self", VEC_SQL + """, euc AS (SELECT i.id, r.id AS rep, round(list_distance(i.vec, r.vec), 9) AS distance FROM reps i, items r)
SELECT id, rep, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, rep) - 1 AS INTEGER) AS place FROM euc QUALIFY place BETWEEN 1 AND 3""")
def nearest_pairs_skip_self(spark, sf):
    """The three nearest others of each representative: rank 0 is the item itself."""
    i = _items(spark, sf)
    return coreset.nearest(_reps(i), i, 4, "euclidean").filter("place > 1").select("id", "rep", (F.col("place") - 1).alias("place"))


W_SQL = VEC_SQL + """, given AS (SELECT rep, worth / 3.0 AS w FROM near WHERE place <= 3 AND id % 25 <> 0 UNION ALL SELECT id, worth FROM reps)"""


@query("knn_weights", W_SQL + " SELECT rep, round(sum(CAST(w AS DOUBLE)), 6) AS weight FROM given GROUP BY rep")
def knn_weights(spark, sf):
    i = _items(spark, sf)
    near = coreset.nearest(i, _reps(i), 3).select("id", "rep")
    return coreset.assignment_weights(i, _reps(i), near).select("rep", F.round("weight", 6).alias("weight"))


@query("knn_weights_equity", VEC_SQL + """, given AS (SELECT rep, CAST(worth AS DOUBLE) / 3 * power(((rep % 7) + 1) / 10.0 * 10, 1.5) AS w FROM near WHERE place <= 3 AND id % 25 <> 0 UNION ALL SELECT id, worth FROM reps)
SELECT rep, round(sum(w), 6) AS weight FROM given GROUP BY rep""")
def knn_weights_equity(spark, sf):
    """What a representative receives is scaled by the marginalisation score of its origin, here ((rep mod 7) + 1) / 10."""
    i = _items(spark, sf)
    near = coreset.nearest(i, _reps(i), 3).select("id", "rep")
    factor = F.pow(((F.col("rep") % 7) + 1) / 10.0 * 10, F.lit(1.5))
    return coreset.assignment_weights(i, _reps(i), near, factor).select("rep", F.round("weight", 6).alias("weight"))


@query("knn_weights_utility", VEC_SQL + """, us AS (SELECT id, 1.0 + id % 5 AS u, 0.5 + id % 3 AS s FROM items),
given AS (SELECT n.rep, CAST(n.worth AS DOUBLE) / 3 * (a.u * a.s) / (b.u * b.s) AS w FROM near n JOIN us a ON a.id = n.id JOIN us b ON b.id = n.rep WHERE place <= 3 AND n.id % 25 <> 0 UNION ALL SELECT id, worth FROM reps)
SELECT rep, round(sum(w), 6) AS weight FROM given GROUP BY rep""")
def knn_weights_utility(spark, sf):
    """Shares scaled by initial utility times spread of giver over receiver (here simple functions of the ids)."""
    i = _items(spark, sf)
    near = coreset.nearest(i, _reps(i), 3).select("id", "rep")
    us = lambda c: (F.lit(1.0) + F.col(c) % 5) * (F.lit(0.5) + F.col(c) % 3)
    return coreset.assignment_weights(i, _reps(i), near, F.try_divide(us("id"), us("rep"))).select("rep", F.round("weight", 6).alias("weight"))


@query("out_of_sample_feature", "SELECT CAST(dim - 1 AS INTEGER) AS dim, round(sum(worth * x), 6) AS value FROM (SELECT label + 1 AS worth, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE vec_id % 25 <> 0) GROUP BY dim")
def out_of_sample_feature(spark, sf):
    i = _items(spark, sf)
    return coreset.out_of_sample_sum(i, _reps(i)).select("dim", F.round("value", 6).alias("value"))


@query("feature_split", "SELECT vec_id AS id, vec_id % 25 = 0 AS in_sample FROM embeddings")
def feature_split(spark, sf):
    i = _items(spark, sf)
    inside = i.join(_reps(i).select("id"), "id", "left_semi").select("id", F.lit(True).alias("in_sample"))
    return inside.unionByName(i.join(_reps(i).select("id"), "id", "left_anti").select("id", F.lit(False).alias("in_sample")))


@query("pmedian_obj", VEC_SQL + """, k AS (SELECT * FROM near WHERE place <= 2 AND id % 25 <> 0), c AS (SELECT rep, count(*) AS c FROM k GROUP BY rep),
t AS (SELECT sum(distance * worth) AS cost, count(DISTINCT id) AS n FROM k), u AS (SELECT count(*) AS used FROM c)
SELECT round(0.9 * (SELECT cost FROM t) + 0.1 * 0.2 * sum(abs(c - CAST((SELECT n FROM t) AS DOUBLE) / (SELECT used FROM u))), 6) AS obj, round(sum(abs(c - CAST((SELECT n FROM t) AS DOUBLE) / (SELECT used FROM u))), 6) AS spread FROM c""")
def pmedian_obj(spark, sf):
    i = _items(spark, sf)
    return coreset.median_objective(i, _reps(i), 2, 0.1)


@query("pmedian_nearest_obj", VEC_SQL + " SELECT round(sum(distance), 6) AS obj FROM near WHERE place = 1")
def pmedian_nearest_obj(spark, sf):
    i = _items(spark, sf)
    return coreset.nearest(i, _reps(i), 1).agg(F.round(F.sum("distance"), 6).alias("obj"))


EUC1 = VEC_SQL + ", d AS (SELECT i.id, min(round(list_distance(i.vec, r.vec), 9)) AS d FROM items i, reps r GROUP BY i.id)"


@query("kcenter_obj", EUC1 + " SELECT round(max(d), 6) AS farthest, round((SELECT d FROM d ORDER BY d DESC LIMIT 1 OFFSET (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) - 1 FROM d)), 6) AS nth_farthest, round(avg(d), 6) AS mean FROM d")
def kcenter_obj(spark, sf):
    i = _items(spark, sf)
    return coreset.center_objective(i, _reps(i), 0.1).select(*[F.round(c, 6).alias(c) for c in ("farthest", "nth_farthest", "mean")])


@query("topn_outlier_distance", EUC1 + " SELECT id, round(d, 6) AS distance FROM d ORDER BY d DESC, id LIMIT 20")
def topn_outlier_distance(spark, sf):
    """The twenty items farthest from all representatives: a top list."""
    i = _items(spark, sf)
    near = coreset.nearest(i, _reps(i), 1, "euclidean").select("id", "distance")
    return near.orderBy(F.desc("distance"), "id").limit(20).select("id", F.round("distance", 6).alias("distance"))


@query("pairwise_distances", VEC_SQL + " SELECT id, rep, round(distance, 6) + 0 AS cosine, round(list_distance((SELECT vec FROM items x WHERE x.id = cos.id), (SELECT vec FROM items x WHERE x.id = cos.rep)), 6) AS euclidean FROM cos WHERE id % 25 = 0")
def pairwise_distances(spark, sf):
    r = _reps(_items(spark, sf))
    n = r.count()
    far = lambda metric: coreset.nearest(r, r, n, metric).select("id", "rep", F.round("distance", 6).alias(metric))
    return far("cosine").join(far("euclidean"), ["id", "rep"])


# Scenario matrices: each user of the events is a scenario; an item is an event type on one day of the month.
SCEN_SQL = """WITH cells AS (SELECT user_id AS scen, (ascii(event_type) * 31 + length(event_type)) % 97 * 100 + day(ts) AS item, avg(value) AS t FROM events GROUP BY ALL),
ids AS (SELECT DISTINCT item FROM cells), scens AS (SELECT DISTINCT scen FROM cells),
grid AS (SELECT i.item, s.scen, coalesce(round(c.t, 6), 0) AS t FROM ids i CROSS JOIN scens s LEFT JOIN cells c ON c.item = i.item AND c.scen = s.scen),
wide AS (SELECT item AS id, list(t ORDER BY scen) AS vec FROM grid GROUP BY item)"""


def _scenario_cells(e):
    """(scen, id, t) of the events; t is null, which counts as 0, where the scenario, the item or all values are null."""
    item = ((F.ascii("event_type") * 31 + F.length("event_type")) % 97 * 100 + F.dayofmonth("ts")).cast("long")
    cells = e.groupBy(F.col("user_id").alias("scen"), item.alias("id")).agg(F.round(F.avg("value"), 6).alias("t"))
    return cells.withColumn("t", F.when(F.col("scen").isNotNull() & F.col("id").isNotNull(), F.col("t")))


def _scenario_items(spark, sf):
    return scenario_vectors(table(spark, sf, "events"))


def scenario_vectors(events):
    """(id, vec): an element for each scenario in order, one that is null last. The places of the scenarios are as many rows
    as a vector has elements, so they are broadcast; a cell goes to its place in one step."""
    scens = checkpointed(events.select(F.col("user_id").alias("scen")).distinct())
    n = scens.count()
    places = scens.agg(F.sort_array(F.collect_set("scen")).alias("s")).select(F.posexplode("s").alias("place", "scen"))
    placed = _scenario_cells(events).join(F.broadcast(places), "scen", "left").select("id", "place", "t")

    def run(key, t):
        vec = np.zeros(n)
        t = t.filter(pc.and_(t.column("place").is_valid(), t.column("t").is_valid()))
        vec[t.column("place").to_numpy()] = t.column("t").to_numpy()
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "vec": pa.array([vec], pa.list_(pa.float64()))})

    return placed.groupBy("id").applyInArrow(run, "id long, vec array<double>")


def scenario_stats(events):
    """(id, sd, m, least) of each item's vector: population spread, mean and least element. Cells are summed up and the
    elements without one counted, so no vector is made."""
    n = F.broadcast(events.agg((F.countDistinct("user_id") + F.coalesce(F.max(F.col("user_id").isNull().cast("int")), F.lit(0))).alias("n")))
    cells = _scenario_cells(events).groupBy("id").agg(F.count("t").cast("double").alias("k"), F.coalesce(F.avg("t"), F.lit(0.0)).alias("a"), F.coalesce(F.var_pop("t"), F.lit(0.0)).alias("v"), F.min("t").alias("least"))
    squares = F.col("v") * F.col("k") + F.col("a") * F.col("a") * F.col("k") * (F.col("n") - F.col("k")) / F.col("n")
    least = F.when(F.col("k") < F.col("n"), F.least("least", F.lit(0.0))).otherwise(F.col("least"))
    return cells.crossJoin(n).select("id", F.sqrt(squares / F.col("n")).alias("sd"), (F.col("a") * F.col("k") / F.col("n")).alias("m"), least.alias("least"))


RATIO_SQL = SCEN_SQL + """, sim AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: least(z[1] / (z[2] + 0.001), z[2] / (z[1] + 0.001)))) AS w FROM wide a, wide b WHERE a.id < b.id)"""


@query("ratio_similarity", RATIO_SQL + " SELECT i, j, round(w, 6) AS w FROM sim WHERE w > 0")
def ratio_similarity(spark, sf):
    return similarity.pair_scores(_scenario_items(spark, sf), similarity.ratio_sum, 0.0).select("i", "j", F.round("w", 6).alias("w"))


@query("topk_similarity", RATIO_SQL + """, both_ways AS (SELECT i, j, round(w, 9) AS w FROM sim UNION ALL SELECT j, i, round(w, 9) FROM sim)
SELECT i, j, round(w, 6) AS w, CAST(row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS INTEGER) AS place FROM both_ways WHERE w <> 0 QUALIFY place <= 5""")
def topk_similarity(spark, sf):
    s = similarity.pair_scores(_scenario_items(spark, sf), similarity.ratio_sum).withColumn("w", F.round("w", 9))
    return similarity.top_similar(s, 5).select("i", "j", F.round("w", 6).alias("w"), "place")


CONN_SQL = SCEN_SQL + """, conn AS (SELECT DISTINCT item, scen FROM cells WHERE t > 10), n AS (SELECT item, count(*) AS n FROM conn GROUP BY item),
co AS (SELECT a.item AS i, b.item AS j, count(*) AS c FROM conn a JOIN conn b ON a.scen = b.scen AND a.item < b.item GROUP BY a.item, b.item)"""


def _connected(spark, sf):
    return _scenario_items(spark, sf).select("id", F.transform("vec", lambda x: (x > 10).cast("double")).alias("vec"))


@query("jaccard_conn", CONN_SQL + " SELECT i, j, round(c / (x.n + y.n - c + 0.01), 6) AS w FROM co JOIN n x ON x.item = i JOIN n y ON y.item = j WHERE c / (x.n + y.n - c + 0.01) > 0.3")
def jaccard_conn(spark, sf):
    return similarity.pair_scores(_connected(spark, sf), similarity.jaccard, 0.3).select("i", "j", F.round("w", 6).alias("w"))


@query("co_connection_top50", CONN_SQL + """, both_ways AS (SELECT i, j, c FROM co UNION ALL SELECT j, i, c FROM co)
SELECT i, j, CAST(c AS DOUBLE) AS w, CAST(row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS INTEGER) AS place FROM both_ways QUALIFY place <= 50""")
def co_connection_top50(spark, sf):
    return similarity.top_similar(similarity.pair_scores(_connected(spark, sf), similarity.co_connection, 0.0), 50)


@query("utility_similarity", SCEN_SQL + """, m AS (SELECT id, list_transform(vec, lambda x: x + 1) AS v FROM wide), st AS (SELECT id, v, list_min(v) AS lo, list_aggregate(v, 'stddev_pop') AS sd FROM m),
inc AS (SELECT id, list_transform(v, lambda x: (x / lo - 1) / sd) AS v FROM st WHERE sd > 0),
sim AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: least(z[1] / (z[2] + 0.001), z[2] / (z[1] + 0.001)))) AS r,
 len(list_filter(a.v, lambda x: x > 0)) + len(list_filter(b.v, lambda x: x > 0)) - len(list_filter(list_zip(a.v, b.v), lambda z: z[1] > 0 AND z[2] > 0)) + 0.001 AS d FROM inc a, inc b WHERE a.id < b.id)
SELECT i, j, round(r / d, 6) AS w FROM sim""")
def utility_similarity(spark, sf):
    v = _scenario_items(spark, sf).select("id", F.transform("vec", lambda x: x + 1).alias("v"))
    total = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x)) / F.size("v")
    v = C.computed_once(v, lo=F.array_min("v"), mean=total(lambda x: x))
    v = C.computed_once(v, sd=F.sqrt(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))))).filter("sd > 0")
    inc = v.select("id", F.transform("v", lambda x: (x / F.col("lo") - 1) / F.col("sd")).alias("vec"))
    return similarity.pair_scores(inc, similarity.utility_ratio).select("i", "j", F.round("w", 6).alias("w"))


@query("weights_merge", RATIO_SQL + " SELECT i, j, round(sum(w), 6) AS w FROM (SELECT i, j, w FROM sim UNION ALL SELECT i, j, w FROM sim WHERE i % 2 = 0) GROUP BY i, j")
def weights_merge(spark, sf):
    s = similarity.pair_scores(_scenario_items(spark, sf), similarity.ratio_sum)
    return similarity.merge_weights(s, s.filter("i % 2 = 0")).select("i", "j", F.round("w", 6).alias("w"))


@query("std_by_od", SCEN_SQL + " SELECT id, round(list_aggregate(vec, 'stddev_pop'), 6) AS sd, round(list_min(vec), 6) AS least FROM wide")
def std_by_od(spark, sf):
    return scenario_stats(table(spark, sf, "events")).select("id", F.round("sd", 6).alias("sd"), F.round("least", 6).alias("least"))


@query("merged_matrix", SCEN_SQL + " SELECT scen, item, round(sum(t), 6) AS t FROM (SELECT scen, item, t FROM cells UNION ALL SELECT scen, item, t FROM cells WHERE scen % 2 = 0) GROUP BY scen, item")
def merged_matrix(spark, sf):
    """Chunks of a scenario matrix added up element by element."""
    e = table(spark, sf, "events")
    item = ((F.ascii("event_type") * 31 + F.length("event_type")) % 97 * 100 + F.dayofmonth("ts")).cast("long")
    cells = e.groupBy(F.col("user_id").alias("scen"), item.alias("item")).agg(F.avg("value").alias("t"))
    return cells.unionByName(cells.filter("scen % 2 = 0")).groupBy("scen", "item").agg(F.round(F.sum("t"), 6).alias("t"))


@query("zscore_features", "SELECT vec_id AS id, CAST(dim - 1 AS INTEGER) AS dim, round((x - avg(x) OVER (PARTITION BY dim)) / nullif(stddev_pop(x) OVER (PARTITION BY dim), 0), 6) AS z FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)")
def zscore_features(spark, sf):
    """Standardised with population spread; the statistics of all dimensions are one small table joined back."""
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = x.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return x.join(stats, "dim").select("id", "dim", F.round(F.try_divide(F.col("x") - F.col("m"), F.col("s")), 6).alias("z"))


@query("distributional_features", SCEN_SQL + """, f AS (SELECT id, list_min(vec) AS lo, list_aggregate(vec, 'stddev_pop') AS sd, list_avg(vec) AS m FROM wide), g AS (SELECT id, lo, sd, m * sd AS scaled FROM f)
SELECT id, round((sd - (SELECT avg(sd) FROM g)) / (SELECT stddev_pop(sd) FROM g), 6) AS z_sd, round((scaled - (SELECT avg(scaled) FROM g)) / (SELECT stddev_pop(scaled) FROM g), 6) AS z_scaled FROM g""")
def distributional_features(spark, sf):
    rows = scenario_stats(table(spark, sf, "events"))
    g = checkpointed(rows.select("id", "sd", (F.col("m") * F.col("sd")).alias("scaled"), F.lit(1).alias("one")))
    s = g.agg(F.avg("sd").alias("m1"), F.stddev_pop("sd").alias("s1"), F.avg("scaled").alias("m2"), F.stddev_pop("scaled").alias("s2"), F.lit(1).alias("one"))
    return g.join(F.broadcast(s), "one").select("id", F.round((F.col("sd") - F.col("m1")) / F.col("s1"), 6).alias("z_sd"), F.round((F.col("scaled") - F.col("m2")) / F.col("s2"), 6).alias("z_scaled"))


@query("minmax_features", "WITH f AS (SELECT id, x, y FROM nodes WHERE isfinite(x) AND isfinite(y)) SELECT id, round(((x - (SELECT min(x) FROM f)) / (SELECT max(x) - min(x) FROM f) - 0.5) * 4, 6) AS fx, round(((y - (SELECT min(y) FROM f)) / (SELECT max(y) - min(y) FROM f) - 0.5) * 4, 6) AS fy FROM f")
def minmax_features(spark, sf):
    """Places scaled to [-2, 2]; the extremes are one row joined back."""
    f = table(spark, sf, "nodes").filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", "x", "y", F.lit(1).alias("one"))
    s = f.agg(*[g(c).alias(f"{n}_{c}") for c in "xy" for n, g in (("lo", F.min), ("hi", F.max))], F.lit(1).alias("one"))
    scale = lambda c: F.round(((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 0.5) * 4, 6)
    return f.join(F.broadcast(s), "one").select("id", scale("x").alias("fx"), scale("y").alias("fy"))


POS_SQL = """, place AS (SELECT id, CAST(id % 5 AS DOUBLE) * 10 AS x, CAST(id // 5 AS DOUBLE) * 10 AS y FROM nodes),
f AS (SELECT od.od_id, a.x AS ox, a.y AS oy, b.x AS dx, b.y AS dy, sqrt((a.x - 20) ** 2 + (a.y - 20) ** 2) AS c2o, sqrt((b.x - 20) ** 2 + (b.y - 20) ** 2) AS c2d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS direct, abs(a.x - b.x) * abs(a.y - b.y) AS area, CAST(od.time AS DOUBLE) AS path
 FROM od JOIN place a ON a.id = od.orig JOIN place b ON b.id = od.des)"""


@query("position_features", with_net(" SELECT od_id, ox, oy, dx, dy, round(c2o, 6) AS c2o, round(c2d, 6) AS c2d, round(direct, 6) AS direct, area, path FROM f", OD + POS_SQL))
def position_features(spark, sf):
    n = Network(spark, sf)
    at = n.nodes.select("id", ((F.col("id") % 5).cast("double") * 10).alias("x"), (F.floor(F.col("id") / 5).cast("double") * 10).alias("y"))
    o, d = at.toDF("orig", "ox", "oy"), at.toDF("des", "dx", "dy")
    gap = lambda a, b, c, e: F.sqrt((a - c) * (a - c) + (b - e) * (b - e))
    ox, oy, dx, dy = (F.col(c) for c in ("ox", "oy", "dx", "dy"))
    rows = n.od.join(o, "orig").join(d, "des")
    return rows.select("od_id", "ox", "oy", "dx", "dy", F.round(gap(ox, oy, F.lit(20), F.lit(20)), 6).alias("c2o"), F.round(gap(dx, dy, F.lit(20), F.lit(20)), 6).alias("c2d"), F.round(gap(ox, oy, dx, dy), 6).alias("direct"), (F.abs(ox - dx) * F.abs(oy - dy)).alias("area"), F.col("time").cast("double").alias("path"))


@query("intercept_features", "SELECT vec_id AS id, 65 AS n, CAST(1 AS DOUBLE) AS first FROM embeddings")
def intercept_features(spark, sf):
    f = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.array(F.lit(1.0)), F.col("embedding").cast("array<double>")).alias("v"))
    return f.select("id", F.size("v").alias("n"), F.col("v")[0].alias("first"))


@query("mean_feature", "SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY dim")
def mean_feature(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("embedded_pairs", "SELECT row_number() OVER (ORDER BY od_id) - 1 AS position, od_id FROM (SELECT DISTINCT od_id FROM od) SEMI JOIN (SELECT od_id FROM embedding WHERE feature IS NOT NULL AND len(feature) = 32) e USING (od_id)")
def embedded_pairs(spark, sf):
    """Pairs that have a vector, with their position. Positions of all pairs: counted per range of ids, then added up."""
    ids = table(spark, sf, "od").select("od_id").distinct().join(table(spark, sf, "embedding").filter("feature is not null and size(feature) = 32").select("od_id"), "od_id", "left_semi")
    return dense_positions(ids, "od_id").select("position", "od_id")


def dense_positions(df, key):
    """`position` from 0 in the order of a unique whole-number key, without one task seeing all rows: rows are ranked
    within ranges of the key, and each range starts where the one before ends."""
    from pyspark.sql.window import Window

    width = 4096
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.join(starts, "__range").withColumn("position", (F.col("__start") + rank).cast("long")).drop("__range", "__start")


@query("uniform_sample")
def uniform_sample(spark, sf):
    return coreset.uniform_sample(_items(spark, sf).select("id"), 50, 11)


@query("kcenter_select")
def kcenter_select(spark, sf):
    return coreset.k_center(_items(spark, sf), 8, seed=3)


@query("pmedian_heuristic")
def pmedian_heuristic(spark, sf):
    return coreset.p_median(_items(spark, sf), 10, seed=1, rounds=3, swaps=1, restarts=2)
