"""Accessibility of origins, piecewise objectives and route utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import columns as C


def accessibility(distances: DataFrame, od: DataFrame, potentials: DataFrame, limit: float, potential: str = "population") -> DataFrame:
    """(orig, accessibility): potential of each origin's listed destinations within `limit`; listed origins without any
    have 0. One join on (orig, des) and one grouped sum."""
    near = distances.filter(F.col("dist") <= limit).select("orig", F.col("node").alias("des"), F.lit(True).alias("near"))
    worth = potentials.select(F.col("node").alias("des"), F.col(potential).alias("worth"))
    rows = od.select("orig", "des").join(near, ["orig", "des"], "left").join(worth, "des", "left")
    return rows.groupBy("orig").agg(F.coalesce(F.sum(F.when(F.col("near"), F.col("worth"))), F.lit(0)).alias("accessibility"))


def od_penalties(distances: DataFrame, od: DataFrame, potentials: DataFrame, beta, limit: float, most: float) -> DataFrame:
    """(od_id, orig, des, worth, dist, penalty, charged): penalty 0 and charge 1 for pairs beyond `most`."""
    near = distances.filter(F.col("dist") <= most).select("orig", F.col("node").alias("des"), F.col("dist").cast("double").alias("dist"))
    rows = od.select("od_id", "orig", "des").join(near, ["orig", "des"], "left").join(potentials.select(F.col("node").alias("des"), F.col("population").alias("worth")), "des", "left")
    p = C.penalty(F.col("dist"), beta, limit, most)
    reached = F.col("dist").isNotNull()
    return rows.withColumn("penalty", F.when(reached, p).otherwise(0.0)).withColumn("charged", F.when(reached, p).otherwise(1.0))


def objective(penalties: DataFrame) -> DataFrame:
    """One row: total potential minus charged potential, and the potential of pairs reached."""
    return penalties.agg(
        F.round(F.sum(F.col("worth") * (1 - F.col("charged"))), 6).alias("obj"),
        F.coalesce(F.sum(F.when(F.col("dist").isNotNull(), F.col("worth"))), F.lit(0)).alias("acc"),
        F.sum("worth").alias("most"),
    )


def route_scores(routes: DataFrame, open_edges: DataFrame, alpha: float) -> DataFrame:
    """(route columns, score): runs of edges that are open. `routes` has route_id and nodes; edges (src, dst)."""
    steps = routes.select("route_id", F.posexplode(C.consecutive_pairs(F.col("nodes"))).alias("pos", "e")).select("route_id", "pos", F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
    marked = steps.join(open_edges.select("src", "dst", F.lit(True).alias("open")).distinct(), ["src", "dst"], "left")
    listed = marked.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("open", F.lit(False)).alias("open")))).alias("s"))
    return routes.join(listed.select("route_id", F.col("s.open").alias("covered")), "route_id", "left").withColumn("score", F.coalesce(C.run_score(F.col("covered"), alpha), F.lit(0.0)))


def expected_utility(scored: DataFrame) -> DataFrame:
    """(od_id, utility): softmax-expected score minus v_bar over the routes of each pair."""
    v = F.transform(F.sort_array(F.collect_list(F.struct("route_id", (F.col("score") - F.col("v_bar")).alias("v")))), lambda s: s["v"])
    return scored.groupBy("od_id").agg(v.alias("v")).select("od_id", C.softmax_expectation(F.col("v")).alias("utility"))


def route_overlap(routes: DataFrame) -> DataFrame:
    """(route_id, v_bar): log of the sum over a route's distinct edges of (1 / edges) / (number of the pair's routes with
    the edge). `routes` has od_id, route_id, nodes."""
    steps = routes.select("od_id", "route_id", F.explode(F.array_distinct(C.consecutive_pairs(F.col("nodes")))).alias("e"))
    shared = steps.groupBy("od_id", "e").agg(F.count("*").alias("sharing"))
    length = routes.select("route_id", (F.size("nodes") - 1).alias("edges"))
    rows = steps.join(shared, ["od_id", "e"]).join(length, "route_id")
    return rows.groupBy("route_id").agg(F.log(F.sum(1.0 / F.col("edges") / F.col("sharing"))).alias("v_bar"))
