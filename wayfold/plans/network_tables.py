"""Queries of road-network preparation: one-way expansion, critical nodes, contraction, containment, nearest nodes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import graph, spatial
from wayfold.operators.rows import rows_in_use
from wayfold.plans.base import QUERIES, SQL, query, with_net
from wayfold.plans.network import Network
from wayfold.session import table

#: Road records: each undirected pair once, with a one-way code of -1, 0, 1 or (unknown) 2, a name and a segment number.
ROADS_SQL = """
roads AS (SELECT least(src, dst) AS fnode, greatest(src, dst) AS tnode, (src + dst) % 4 - 1 AS oneway, (least(src, dst) * 3 + greatest(src, dst)) % 6 AS name_id, least(src, dst) * 100 + greatest(src, dst) AS seg_id,
  min(time) * 100 AS length, max(lts) AS lts FROM edges GROUP BY least(src, dst), greatest(src, dst), (src + dst) % 4)"""


def _roads(spark, sf):
    e = Network(spark, sf).edges.select(F.least("src", "dst").alias("fnode"), F.greatest("src", "dst").alias("tnode"), "time", "lts")
    r = e.groupBy("fnode", "tnode").agg((F.min("time") * 100).alias("length"), F.max("lts").alias("lts"))
    f, t = F.col("fnode"), F.col("tnode")
    return r.select("fnode", "tnode", ((f + t) % 4 - 1).alias("oneway"), ((f * 3 + t) % 6).alias("name_id"), (f * 100 + t).alias("seg_id"), "length", "lts")


@query("oneway_expand", with_net(" SELECT fnode AS src, tnode AS dst, length, lts FROM roads WHERE oneway IN (0, 1) UNION ALL SELECT tnode, fnode, length, lts FROM roads WHERE oneway IN (0, -1)", ROADS_SQL))
def oneway_expand(spark, sf):
    """0 gives both directions, 1 the one stored, -1 the other; other codes none. One pass, no shuffle."""
    r = _roads(spark, sf).filter("fnode != tnode")
    end = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"))
    ways = F.array_compact(F.array(F.when(F.col("oneway").isin(0, 1), end("fnode", "tnode")), F.when(F.col("oneway").isin(0, -1), end("tnode", "fnode"))))
    return r.select(F.explode(ways).alias("w"), "length", "lts").select("w.src", "w.dst", "length", "lts")


@query("directed_last_wins", "SELECT CAST(l_partkey % 200 AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, arg_max(l_quantity, l_orderkey * 100 + l_linenumber) AS length FROM lineitem GROUP BY 1, 2")
def directed_last_wins(spark, sf):
    """Of several records of one directed edge the last one counts."""
    t = table(spark, sf, "lineitem")
    return t.groupBy((F.col("l_partkey") % 200).alias("src"), F.col("l_suppkey").alias("dst")).agg(F.max_by("l_quantity", F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("length"))


@query("drop_named", "SELECT p_partkey, p_name FROM part WHERE NOT contains(coalesce(p_name, ''), '7')")
def drop_named(spark, sf):
    """Rows whose name contains a word are left out; rows without a name stay."""
    p = table(spark, sf, "part")
    return p.filter(~F.contains(F.coalesce("p_name", F.lit("")), F.lit("7"))).select("p_partkey", "p_name")


@query("drop_self_loops", "SELECT CAST(l_partkey % 100 AS BIGINT) AS src, CAST(l_suppkey % 100 AS BIGINT) AS dst, count(*) AS n FROM lineitem WHERE l_partkey % 100 <> l_suppkey % 100 GROUP BY 1, 2")
def drop_self_loops(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst"))
    return t.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def critical_nodes_of(roads, include_terminal: bool = False):
    """Nodes where roads of more than one name meet, or more than two segments. With `include_terminal` also nodes that
    only start roads."""
    ends = roads.select(F.col("fnode").alias("node"), "name_id", "seg_id").unionByName(roads.select(F.col("tnode").alias("node"), "name_id", "seg_id"))
    hit = ends.groupBy("node").agg(F.countDistinct("name_id").alias("names"), F.countDistinct("seg_id").alias("segs")).filter("names > 1 or segs > 2").select("node")
    if include_terminal:
        start = roads.select(F.col("fnode").alias("node")).distinct()
        hit = hit.union(start.join(roads.select(F.col("tnode").alias("node")), "node", "left_anti")).distinct()
    return hit


CRIT_SQL = """, ends AS (SELECT fnode AS node, name_id, seg_id FROM roads UNION ALL SELECT tnode, name_id, seg_id FROM roads),
crit AS (SELECT node FROM ends GROUP BY node HAVING count(DISTINCT name_id) > 1 OR count(DISTINCT seg_id) > 2)"""


@query("critical_nodes", with_net(" SELECT node FROM crit", ROADS_SQL + CRIT_SQL))
def critical_nodes(spark, sf):
    return critical_nodes_of(_roads(spark, sf))


@query("critical_nodes_terminal", with_net(" SELECT node FROM crit UNION SELECT fnode FROM roads WHERE fnode NOT IN (SELECT tnode FROM roads)", ROADS_SQL + CRIT_SQL))
def critical_nodes_terminal(spark, sf):
    return critical_nodes_of(_roads(spark, sf), include_terminal=True)


# Chains: the lines of an order follow one another; the first, the last and every fourth are stops.
CHAIN_SQL = """WITH pos AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
last AS (SELECT l_orderkey, max(k) AS n FROM pos GROUP BY l_orderkey),
e AS (SELECT p.l_orderkey, p.k, p.q, 1 + p.k % 4 AS lts, p.k = 1 OR p.k % 4 = 0 AS stop_at FROM pos p JOIN last USING (l_orderkey) WHERE p.k < n),
g AS (SELECT *, sum(CASE WHEN stop_at THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k) AS part FROM e)
SELECT CAST(l_orderkey * 1000 + min(k) AS BIGINT) AS src, CAST(l_orderkey * 1000 + max(k) + 1 AS BIGINT) AS dst, CAST(sum(q) AS BIGINT) AS length, max(lts) AS lts FROM g GROUP BY l_orderkey, part"""


@query("contract_chains", CHAIN_SQL)
def contract_chains(spark, sf):
    w = Window.partitionBy("l_orderkey")
    t = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_quantity")).cast("long")).withColumn("n", F.count("*").over(w))
    at = F.col("l_orderkey") * 1000 + F.col("k")
    edges = t.filter("k < n").select(at.alias("src"), (at + 1).alias("dst"), F.col("l_quantity").cast("long").alias("length"), (1 + F.col("k") % 4).alias("lts"))
    stops = t.filter("k = 1 or k = n or k % 4 = 0").select(at.alias("node"))
    return graph.contract_chains(edges, stops)


@query("undirected_projects", with_net(" SELECT proj, a, b FROM projects"))
def undirected_projects(spark, sf):
    return Network(spark, sf).projects.select("proj", "a", "b")


P1_SQL = """WITH edges_in AS (SELECT id, x, y, loaded_at FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT (x = 0 AND y = 0)),
pts AS (SELECT id, x, y, CAST(floor(x / 12) AS BIGINT) AS gx, CAST(floor(y / 12) AS BIGINT) AS gy FROM edges_in QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, x DESC, y DESC) = 1),
shifts AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
near AS (SELECT a.id AS l, b.id AS r FROM (SELECT p.*, gx + dx AS hx, gy + dy AS hy FROM pts p, shifts) a JOIN pts b ON a.hx = b.gx AND a.hy = b.gy
  WHERE a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144),
poly AS (SELECT poly_id, max(ring) AS ring FROM sig_inter_polygon WHERE len(ring) >= 3 GROUP BY poly_id),
sides AS (SELECT poly_id, ring[k].x AS x1, ring[k].y AS y1, ring[k % len(ring) + 1].x AS x2, ring[k % len(ring) + 1].y AS y2 FROM (SELECT poly_id, ring, unnest(range(1, len(ring) + 1)) AS k FROM poly)),
box AS (SELECT poly_id, min(x1) AS lx, max(x1) AS hx, min(y1) AS ly, max(y1) AS hy FROM sides GROUP BY poly_id),
cand AS (SELECT p.id, p.x, p.y, b.poly_id FROM pts p JOIN box b ON p.x > b.lx AND p.x < b.hx AND p.y > b.ly AND p.y < b.hy),
crossed AS (SELECT c.id, c.poly_id, (s.x2 - s.x1) * (c.y - s.y1) - (s.y2 - s.y1) * (c.x - s.x1) AS k, c.x, c.y, s.* EXCLUDE (poly_id) FROM cand c JOIN sides s USING (poly_id)),
ins AS (SELECT id, poly_id FROM crossed GROUP BY id, poly_id HAVING sum(CASE WHEN (y1 <= y) <> (y2 <= y) AND ((k > 0) = (y2 > y1)) THEN 1 ELSE 0 END) % 2 = 1
  AND max(CASE WHEN k = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0)
"""

QUERIES["p1_found"] = spatial.p1_found
SQL["p1_found"] = P1_SQL + "SELECT 'near' AS rel, l AS left_id, r AS right_id FROM near UNION ALL SELECT 'inside', id, poly_id FROM ins"


def _points(spark, sf):
    x, y = F.col("x"), F.col("y")
    usable = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & ~((x == 0) & (y == 0))
    return rows_in_use(table(spark, sf, "nodes"), ["id"], "loaded_at", ["x", "y"], usable)


@query("point_in_polygon", P1_SQL + "SELECT id, id IN (SELECT id FROM ins) AS signalised FROM pts")
def point_in_polygon(spark, sf):
    """Whether each node lies in any outline."""
    pts = _points(spark, sf)
    shapes = table(spark, sf, "sig_inter_polygon").filter(F.size("ring") >= 3).groupBy("poly_id").agg(F.max("ring").alias("ring"))
    inside = spatial.nearby(pts, spatial.NEAR_METRES, shapes).filter("rel = 'inside'").select(F.col("left_id").alias("id"), F.lit(True).alias("in")).distinct()
    return pts.join(inside, "id", "left").select("id", F.coalesce("in", F.lit(False)).alias("signalised"))


@query("nearest_node", P1_SQL + ", c AS (SELECT poly_id, (lx + hx) / 2 AS cx, (ly + hy) / 2 AS cy FROM box) SELECT poly_id, arg_min(id, ROW((cx - x) * (cx - x) + (cy - y) * (cy - y), id)) AS node FROM c, pts GROUP BY poly_id")
def nearest_node(spark, sf):
    """The node nearest to the middle of each outline, ties to the smaller id."""
    shapes = spatial.circles(table(spark, sf, "sig_inter_polygon").filter(F.size("ring") >= 3).groupBy("poly_id").agg(F.max("ring").alias("ring")))
    return spatial.nearest_points(shapes.select(F.col("poly_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), _points(spark, sf)).select(F.col("id").alias("poly_id"), F.col("nearest").alias("node"))


@query("parallel_lines", "SELECT o.od_id, a.x AS ox, a.y AS oy, b.x AS dx, b.y AS dy FROM (SELECT DISTINCT od_id, orig, des FROM od) o JOIN (SELECT id, x, y FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, x DESC, y DESC, lts DESC) = 1) a ON a.id = o.orig JOIN (SELECT id, x, y FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, x DESC, y DESC, lts DESC) = 1) b ON b.id = o.des WHERE isfinite(a.x) AND isfinite(a.y) AND isfinite(b.x) AND isfinite(b.y)")
def parallel_lines(spark, sf):
    """Sampled pairs as lines between the places of their nodes."""
    pts = rows_in_use(table(spark, sf, "nodes"), ["id"], "loaded_at", ["x", "y"]).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    o = table(spark, sf, "od").select("od_id", "orig", "des").distinct()
    return o.join(pts.toDF("orig", "ox", "oy"), "orig").join(pts.toDF("des", "dx", "dy"), "des").select("od_id", "ox", "oy", "dx", "dy")
