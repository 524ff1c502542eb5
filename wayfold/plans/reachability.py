"""Queries of reachability, accessibility, objectives and the network's relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import columns as C
from wayfold.operators import access, graph
from wayfold.plans.base import OD, query, reach, with_net
from wayfold.plans.network import TIME_LIMIT, TIME_MAX, Network

DESIGN = "proj % 3 = 0"
DESIGN_SQL = """
opened AS (SELECT src, dst, time FROM project_edges WHERE proj % 3 = 0),
aug AS (SELECT src, dst, time FROM cur WHERE (src, dst) NOT IN (SELECT (src, dst) FROM opened) UNION ALL SELECT src, dst, min(time) FROM opened GROUP BY src, dst)"""


@query("sssp_cutoff", with_net(" SELECT orig, node, dist FROM sp", reach("sp", "edges", TIME_MAX)))
def sssp_cutoff(spark, sf):
    n = Network(spark, sf)
    return n.reach(n.edges, TIME_MAX)


@query("sssp_by_joins", with_net(" SELECT orig, node, dist FROM sp", reach("sp", "edges", TIME_MAX)))
def sssp_by_joins(spark, sf):
    n = Network(spark, sf)
    return graph.reach_by_joins(n.origins, n.edges, TIME_MAX).withColumn("dist", F.col("dist").cast("long"))


PATHS = """
path_r AS (SELECT id AS orig, id AS node, CAST(0 AS BIGINT) AS dist, [id] AS path FROM nodes
  UNION ALL SELECT r.orig, e.dst, r.dist + e.time, list_append(r.path, e.dst) FROM path_r r JOIN edges e ON r.node = e.src WHERE r.dist + e.time <= 20),
paths AS (SELECT orig, node, dist, path FROM path_r QUALIFY row_number() OVER (PARTITION BY orig, node ORDER BY dist, path) = 1)"""


@query("shortest_paths", with_net(" SELECT orig, node, dist, array_to_string(path, '-') AS path FROM paths", PATHS))
def shortest_paths(spark, sf):
    n = Network(spark, sf)
    p = graph.shortest_paths(n.origins, n.edges, TIME_MAX)
    return p.select("orig", "node", F.col("dist").cast("long").alias("dist"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query("od_anti_connected", with_net(" SELECT od_id, orig, des, time FROM od", OD))
def od_anti_connected(spark, sf):
    return Network(spark, sf).od


def _access_sql(edges: str, cutoff: int, worth: str) -> str:
    return reach("sp", edges, cutoff) + f"""
, acc AS (SELECT o.orig, CAST(coalesce(sum(CASE WHEN s.node IS NOT NULL THEN p.{worth} END), 0) AS BIGINT) AS accessibility
 FROM od o LEFT JOIN sp s ON s.orig = o.orig AND s.node = o.des LEFT JOIN pot p ON p.node = o.des GROUP BY o.orig)"""


@query("access_by_origin", with_net(" SELECT orig, accessibility FROM acc", OD, DESIGN_SQL, _access_sql("aug", TIME_LIMIT, "population")))
def access_by_origin(spark, sf):
    n = Network(spark, sf)
    return access.accessibility(n.reach(n.design_edges(DESIGN), TIME_LIMIT), n.od, n.potentials, TIME_LIMIT)


@query("access_jobs_by_origin", with_net(" SELECT orig, accessibility FROM acc", OD, DESIGN_SQL, _access_sql("aug", TIME_LIMIT, "job")))
def access_jobs_by_origin(spark, sf):
    n = Network(spark, sf)
    return access.accessibility(n.reach(n.design_edges(DESIGN), TIME_LIMIT), n.od, n.potentials, TIME_LIMIT, "job")


@query("access_total_rollup", with_net(" SELECT orig, CAST(sum(accessibility) AS BIGINT) AS accessibility FROM acc GROUP BY ROLLUP (orig)", OD, DESIGN_SQL, _access_sql("aug", TIME_LIMIT, "population")))
def access_total_rollup(spark, sf):
    return access_by_origin(spark, sf).rollup("orig").agg(F.sum("accessibility").alias("accessibility"))


@query("total_accessibility", with_net(" SELECT CAST(sum(p.population) AS BIGINT) AS accessibility, count(*) AS pairs FROM od JOIN pot p ON p.node = od.des", OD))
def total_accessibility(spark, sf):
    n = Network(spark, sf)
    return n.od.join(n.potentials.withColumnRenamed("node", "des"), "des").agg(F.sum("population").alias("accessibility"), F.count("*").alias("pairs"))


#: Scoring of each variant on this network: slope, time limit and greatest time.
VARIANTS = {"linear": (1 / 20, 20, 20), "exp": (0.75 / 7, 7, 20), "rec": (0.001, 18, 20)}


def _penalties(spark, sf, variant):
    n = Network(spark, sf)
    b1, limit, most = VARIANTS[variant]
    return access.od_penalties(n.reach(n.design_edges(DESIGN), most), n.od, n.potentials, C.betas(b1, limit, most), limit, most)


def _penalty_sql(variant: str) -> str:
    b1, limit, most = VARIANTS[variant]
    b0, b1, b2 = C.betas(b1, limit, most)
    return reach("sp", "aug", most) + f"""
, pen AS (SELECT o.od_id, o.orig, o.des, p.population AS worth, s.dist,
  CASE WHEN s.dist <= {limit} THEN s.dist * CAST({b1!r} AS DOUBLE) WHEN s.dist <= {most} THEN CAST({b1!r} AS DOUBLE) * {limit} + CAST({b2!r} AS DOUBLE) * (s.dist - {limit}) END AS p
  FROM od o LEFT JOIN sp s ON s.orig = o.orig AND s.node = o.des LEFT JOIN pot p ON p.node = o.des)"""


def _objective_query(variant):
    body = " SELECT round(sum(worth * (1 - coalesce(p, 1))), 6) AS obj, CAST(coalesce(sum(CASE WHEN dist IS NOT NULL THEN worth END), 0) AS BIGINT) AS acc, CAST(sum(worth) AS BIGINT) AS most FROM pen"

    @query(f"con_obj_{variant}", with_net(body, OD, DESIGN_SQL, _penalty_sql(variant)))
    def run(spark, sf):
        return access.objective(_penalties(spark, sf, variant))


for _v in VARIANTS:
    _objective_query(_v)


@query("penalty_per_od", with_net(" SELECT od_id, orig, des, round(coalesce(p, 0), 9) AS penalty, round(coalesce(p, 1), 9) AS charged FROM pen", OD, DESIGN_SQL, _penalty_sql("exp")))
def penalty_per_od(spark, sf):
    p = _penalties(spark, sf, "exp")
    return p.select("od_id", "orig", "des", F.round("penalty", 9).alias("penalty"), F.round("charged", 9).alias("charged"))


@query("od_remaining", with_net(" SELECT od_id, orig, des FROM od WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.orig = od.orig AND sp.node = od.des)", OD, DESIGN_SQL, reach("sp", "aug", TIME_MAX)))
def od_remaining(spark, sf):
    n = Network(spark, sf)
    reached = n.reach(n.design_edges(DESIGN), TIME_MAX).select("orig", F.col("node").alias("des"))
    return n.od.join(reached, ["orig", "des"], "left_anti").select("od_id", "orig", "des")


@query("reachable_destinations", with_net(" SELECT sp.orig, sp.node AS des FROM sp WHERE sp.orig <> sp.node AND sp.node IN (SELECT node FROM pot WHERE job > 0)", reach("sp", "cur", TIME_LIMIT)))
def reachable_destinations(spark, sf):
    n = Network(spark, sf)
    places = n.potentials.filter("job > 0").select("node")
    return n.reach(n.current, TIME_LIMIT).filter("orig != node").join(places, "node", "left_semi").select("orig", F.col("node").alias("des"))


@query("augment_network", with_net(" SELECT src, dst, time FROM aug", DESIGN_SQL))
def augment_network(spark, sf):
    return Network(spark, sf).design_edges(DESIGN)


SIGNALS_SQL = DESIGN_SQL + """

, unsig AS (SELECT id AS node FROM nodes WHERE id % 4 = 1), fresh AS (SELECT id AS node FROM nodes WHERE id % 8 = 5), heads AS (SELECT id AS node FROM nodes WHERE id % 2 = 0),
sig_at AS (SELECT src AS node FROM opened WHERE src IN (SELECT node FROM unsig) UNION SELECT dst FROM opened WHERE dst IN (SELECT node FROM unsig) UNION SELECT node FROM fresh)"""


@query("signal_opened_edges", with_net(" SELECT src, dst, time FROM edges WHERE src IN (SELECT node FROM sig_at) AND dst IN (SELECT node FROM heads)", SIGNALS_SQL))
def signal_opened_edges(spark, sf):
    n = Network(spark, sf)
    pick = lambda cond: n.nodes.filter(cond).select(F.col("id").alias("node"))
    return graph.signal_edges(n.edges, n.project_edges.filter(DESIGN), pick("id % 4 = 1"), pick("id % 8 = 5"), pick("id % 2 = 0"))


@query("selected_project_edges", with_net(" SELECT proj, src, dst, time FROM project_edges WHERE proj % 3 = 0"))
def selected_project_edges(spark, sf):
    return Network(spark, sf).project_edges.filter(DESIGN).select("proj", "src", "dst", "time")


@query("project_cost", with_net(" SELECT proj, CAST(sum(time) AS BIGINT) AS cost, count(*) AS edges FROM project_edges GROUP BY proj"))
def project_cost(spark, sf):
    return Network(spark, sf).project_edges.groupBy("proj").agg(F.sum("time").alias("cost"), F.count("*").alias("edges"))


@query("affordable_projects", with_net(" SELECT proj, cost FROM (SELECT proj, CAST(sum(time) AS BIGINT) AS cost FROM project_edges GROUP BY proj) WHERE cost > 0 AND cost <= 6"))
def affordable_projects(spark, sf):
    return project_cost(spark, sf).filter("cost > 0 and cost <= 6").select("proj", "cost")


@query("project_nodes", with_net(" SELECT DISTINCT node FROM (SELECT src AS node FROM project_edges UNION ALL SELECT dst FROM project_edges)"))
def project_nodes(spark, sf):
    return graph.touched_nodes(Network(spark, sf).project_edges)


@query("node_lts", with_net(" SELECT id AS node, CASE WHEN id % 4 <> 1 AND coalesce(m, 0) >= 3 THEN 3 ELSE 2 END AS lts FROM nodes LEFT JOIN (SELECT node, max(lts) AS m FROM (SELECT src AS node, lts FROM edges UNION ALL SELECT dst, lts FROM edges) GROUP BY node) ON node = id"))
def node_lts(spark, sf):
    """Stress of a node: 3 where it is without a signal and touches an edge of stress 3 or more, else 2. Here nodes
    whose number leaves 1 modulo 4 have a signal."""
    n = Network(spark, sf)
    ends = n.edges.select(F.col("src").alias("node"), "lts").unionByName(n.edges.select(F.col("dst").alias("node"), "lts"))
    worst = ends.groupBy("node").agg(F.max("lts").alias("m"))
    rows = n.nodes.select(F.col("id").alias("node")).join(worst, "node", "left")
    return rows.select("node", F.when((F.col("node") % 4 != 1) & (F.coalesce("m", F.lit(0)) >= 3), 3).otherwise(2).alias("lts"))


@query("current_cost_case", with_net(" SELECT src, dst, CASE WHEN lts > 2 OR (src % 5 = 2 AND src % 10 <> 2) THEN 100 ELSE time END AS cost FROM edges"))
def current_cost_case(spark, sf):
    """Edges too stressful, or that start at a stressful node that is not excluded, cost 100."""
    stressful = (F.col("src") % 5 == 2) & (F.col("src") % 10 != 2)
    return Network(spark, sf).edges.select("src", "dst", F.when((F.col("lts") > 2) | stressful, F.lit(100).cast("long")).otherwise(F.col("time")).alias("cost"))


@query("forced_corridor_lts", with_net(" SELECT src, dst, CASE WHEN least(src, dst) % 6 = 0 AND greatest(src, dst) % 2 = 1 THEN 4 ELSE lts END AS lts FROM edges"))
def forced_corridor_lts(spark, sf):
    """Stress 4 on a listed corridor in both directions."""
    n = Network(spark, sf)
    ends = n.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().filter("a % 6 = 0 and b % 2 = 1")
    both = ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ends.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("forced", F.lit(4).cast("long"))
    return n.edges.join(both, ["src", "dst"], "left").select("src", "dst", F.coalesce("forced", "lts").alias("lts"))


@query("restricted_anti", with_net(" SELECT src, dst FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0 AND (src, dst) NOT IN (SELECT (src, dst) FROM edges WHERE (src + dst) % 7 = 0 UNION SELECT (dst, src) FROM edges WHERE (src + dst) % 7 = 0)"))
def restricted_anti(spark, sf):
    """Subgraph of listed nodes without a symmetric list of excluded pairs."""
    n = Network(spark, sf)
    kept = n.nodes.filter("id % 3 != 0")
    out = n.edges.filter("(src + dst) % 7 = 0").select("src", "dst")
    out = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = n.edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.join(out, ["src", "dst"], "left_anti").select("src", "dst")


@query("origin_edges_at_signals", with_net(" SELECT src, dst, time FROM edges WHERE src % 4 <> 1"))
def origin_edges_at_signals(spark, sf):
    n = Network(spark, sf)
    return n.edges.join(n.nodes.filter("id % 4 != 1").select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "time")


def _barrier(name, sql_case, case):
    @query(name, with_net(f" SELECT src, dst, {sql_case} AS cost FROM edges"))
    def run(spark, sf):
        return Network(spark, sf).edges.select("src", "dst", F.when(F.expr(case), F.lit(100_000_000).cast("long")).otherwise(F.col("time")).alias("cost"))


# Arterial nodes are those whose number divides by 5; nodes of an odd number are stressful.
_barrier("cost_to_arterial", "CASE WHEN src % 5 = 0 OR lts > 2 OR src % 2 = 1 THEN 100000000 ELSE time END", "src % 5 = 0 or lts > 2 or src % 2 = 1")
_barrier("cost_from_arterial", "CASE WHEN dst % 5 = 0 OR lts > 2 OR (src % 5 <> 0 AND src % 2 = 1) THEN 100000000 ELSE time END", "dst % 5 = 0 or lts > 2 or (src % 5 != 0 and src % 2 = 1)")


BARRIERS = """ barrier AS (SELECT src, dst, CASE WHEN src % 5 = 0 OR lts > 3 THEN 100000000 ELSE time END AS time FROM edges),
barrier_back AS (SELECT src, dst, CASE WHEN dst % 5 = 0 OR lts > 3 THEN 100000000 ELSE time END AS time FROM edges)"""


@query("arterial_shortcuts", with_net(" SELECT orig, node, dist, 1 AS lts FROM sp WHERE orig % 5 <> 0 AND node % 5 = 0 UNION ALL SELECT orig, node, dist, 1 FROM sq WHERE orig % 5 = 0 AND node % 5 <> 0", BARRIERS, reach("sp", "barrier", 30), reach("sq", "barrier_back", 30)))
def arterial_shortcuts(spark, sf):
    """Ways from zones to arterial nodes and back that pass no other arterial node."""
    n = Network(spark, sf)

    def found(end: str, origins: str, goals: str):
        far = F.lit(100_000_000).cast("long")
        cost = n.edges.select("src", "dst", F.when((F.col(end) % 5 == 0) | (F.col("lts") > 3), far).otherwise(F.col("time")).alias("time"))
        return n.reach(cost, 30, n.origins.filter(origins)).filter(goals).select("orig", "node", "dist", F.lit(1).alias("lts"))

    return found("src", "orig % 5 != 0", "node % 5 = 0").unionByName(found("dst", "orig % 5 = 0", "node % 5 != 0"))


@query("deadends", with_net(" SELECT node, count(DISTINCT other) AS neighbours FROM (SELECT src AS node, dst AS other FROM cur UNION ALL SELECT dst, src FROM cur) GROUP BY node HAVING count(DISTINCT other) <= 1"))
def deadends(spark, sf):
    return graph.dead_ends(Network(spark, sf).current)


@query("reverse_graph", with_net(" SELECT dst AS src, src AS dst, time FROM edges"))
def reverse_graph(spark, sf):
    return graph.reverse(Network(spark, sf).edges).select("src", "dst", "time")


@query("relevant_subgraph", with_net(", band AS (SELECT o.orig, o.des, f.node FROM od o JOIN f ON f.orig = o.orig JOIN b ON b.orig = o.des AND b.node = f.node WHERE f.dist + b.dist <= 20) SELECT orig, des, node FROM band UNION SELECT band.orig, band.des, CASE WHEN e.src = band.node THEN e.dst ELSE e.src END FROM band JOIN edges e ON band.node IN (e.src, e.dst)", OD, reach("f", "edges", TIME_MAX), " back AS (SELECT dst AS src, src AS dst, time FROM edges)", reach("b", "back", TIME_MAX)))
def relevant_subgraph(spark, sf):
    """Nodes on ways of a pair within the greatest time, and their neighbours."""
    n = Network(spark, sf)
    band = graph.relevant_nodes(n.reach(n.edges, TIME_MAX), n.reach(graph.reverse(n.edges), TIME_MAX), n.od, TIME_MAX)
    return graph.with_neighbours(band, n.edges)


@query("crossing_pairs", with_net(" SELECT e.src AS at, e.dst AS onto, p.src AS p_src, p.dst AS p_dst FROM edges e JOIN project_edges p ON e.src IN (p.src, p.dst) WHERE e.src % 4 = 1 AND NOT (e.src = p.src AND e.dst = p.dst)"))
def crossing_pairs(spark, sf):
    """Edges out of a node without a signal with the project edges that touch the node."""
    n = Network(spark, sf)
    ends = n.project_edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("at"))
    e = n.edges.filter("src % 4 = 1").select(F.col("src").alias("at"), F.col("dst").alias("onto"))
    j = e.join(ends, "at").filter(~((F.col("at") == F.col("src")) & (F.col("onto") == F.col("dst"))))
    return j.select("at", "onto", F.col("src").alias("p_src"), F.col("dst").alias("p_dst"))


@query("edge_record_lookup", with_net(" SELECT orig, node, s.a AS src, s.b AS dst, least(s.a, s.b) * 100 + greatest(s.a, s.b) AS rec FROM (SELECT orig, node, unnest(list_transform(range(1, len(path)), lambda i: {'a': path[i], 'b': path[i + 1]})) AS s FROM paths WHERE len(path) > 1)", PATHS))
def edge_record_lookup(spark, sf):
    """Steps of every shortest path with the record of their road, stored in one direction."""
    n = Network(spark, sf)
    p = graph.shortest_paths(n.origins, n.edges, TIME_MAX)
    steps = p.select("orig", "node", F.explode(C.consecutive_pairs(F.col("path"))).alias("e")).select("orig", "node", F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
    stored = n.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("rec", F.col("src") * 100 + F.col("dst"))
    return graph.edge_lookup(steps, stored).select("orig", "node", "src", "dst", "rec")


@query("compressed_ids", "SELECT row_number() OVER (ORDER BY (s_n IS NOT NULL) DESC, n.n_nationkey) - 1 AS new_id, CAST(n.n_nationkey AS BIGINT) AS node FROM nation n LEFT JOIN (SELECT DISTINCT s_nationkey AS s_n FROM supplier) ON s_n = n.n_nationkey")
def compressed_ids(spark, sf):
    """Dense ids: zone nodes first, then the rest. The numbering is one ordered pass over a node table."""
    from pyspark.sql.window import Window

    n = Network(spark, sf)
    zones = n.table("supplier").select(F.col("s_nationkey").cast("long").alias("id")).distinct().withColumn("zone", F.lit(1))
    rows = n.nodes.join(zones, "id", "left")
    return rows.select((F.row_number().over(Window.orderBy(F.coalesce("zone", F.lit(0)).desc(), "id")) - 1).cast("long").alias("new_id"), F.col("id").alias("node"))


@query("arterial_nodes", with_net(" SELECT DISTINCT node FROM (SELECT src AS node FROM edges WHERE lts >= 3 UNION SELECT dst FROM edges WHERE lts >= 3)"))
def arterial_nodes(spark, sf):
    return graph.touched_nodes(Network(spark, sf).edges.filter("lts >= 3"))


@query("stopping_nodes", with_net(" SELECT src AS node FROM edges WHERE lts >= 3 UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier UNION SELECT id FROM nodes WHERE id % 4 <> 1"))
def stopping_nodes(spark, sf):
    n = Network(spark, sf)
    a = n.edges.filter("lts >= 3").select(F.col("src").alias("node"))
    return a.union(n.table("supplier").select(F.col("s_nationkey").cast("long"))).union(n.nodes.filter("id % 4 != 1").select("id")).distinct()


@query("all_edge_lists", with_net(" SELECT src, dst, time, 'road' AS kind FROM edges UNION ALL SELECT src, dst, time, 'project' FROM project_edges"))
def all_edge_lists(spark, sf):
    n = Network(spark, sf)
    return n.edges.select("src", "dst", "time", F.lit("road").alias("kind")).unionByName(n.project_edges.select("src", "dst", "time", F.lit("project").alias("kind")))


@query("nodes_except_listed", with_net(" SELECT id AS node FROM nodes EXCEPT SELECT CAST(n_nationkey AS BIGINT) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'"))
def nodes_except_listed(spark, sf):
    """Nodes without those of a list that a table holds."""
    n = Network(spark, sf)
    listed = n.table("nation").join(n.table("region").filter("r_name = 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.nodes.select(F.col("id").alias("node")).exceptAll(listed.select(F.col("n_nationkey").cast("long")))


@query("nodes_in_network", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS node FROM customer INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
def nodes_in_network(spark, sf):
    n = Network(spark, sf)
    return n.table("customer").select(F.col("c_nationkey").cast("long").alias("node")).intersect(n.table("supplier").select(F.col("s_nationkey").cast("long").alias("node")))


@query("symmetric_pairs", with_net(" SELECT src, dst FROM edges WHERE lts = 4 UNION SELECT dst, src FROM edges WHERE lts = 4"))
def symmetric_pairs(spark, sf):
    e = Network(spark, sf).edges.filter("lts = 4").select("src", "dst")
    return e.union(e.select("dst", "src")).distinct()


@query("zones_present", "SELECT count(*) AS zones, CAST(count_if(n_nationkey IN (SELECT s_nationkey FROM supplier)) AS BIGINT) AS present FROM nation")
def zones_present(spark, sf):
    n = Network(spark, sf)
    here = n.table("supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.lit(True).alias("here")).distinct()
    return n.nodes.join(here, "id", "left").agg(F.count("*").alias("zones"), F.count_if(F.col("here")).alias("present"))


@query("time_distance", with_net(" SELECT src, dst, CAST(time AS DOUBLE) * 15 * 1000 / 60 AS metres, CAST(time AS DOUBLE) AS minutes FROM edges"))
def time_distance(spark, sf):
    e = Network(spark, sf).edges
    metres = C.minutes_to_metres(F.col("time").cast("double"))
    return e.select("src", "dst", metres.alias("metres"), C.metres_to_minutes(metres).alias("minutes"))


@query("node_potentials", with_net(" SELECT node, population, job FROM pot"))
def node_potentials(spark, sf):
    return Network(spark, sf).potentials
