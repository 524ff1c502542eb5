"""The network of the driver's tables, as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators import graph
from wayfold.session import table

TIME_LIMIT, TIME_MAX, NOW_LIMIT = 15, 20, 15


class Network:
    """Nodes, edges, potentials, projects and origin-destination pairs derived from the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("region"))

    @cached_property
    def edges(self) -> DataFrame:
        """For each node i the three j with (7i + 13j) mod 25 in 0..2: j = 2(r - 7i) mod 25, as 2 inverts 13."""
        e = self.nodes.select(F.col("id").alias("src"), F.explode(F.array(*[F.lit(r) for r in range(3)])).alias("r"))
        e = e.withColumn("dst", F.pmod(2 * (F.col("r") - 7 * F.col("src")), F.lit(25)).cast("long")).filter("src != dst")
        e = e.join(self.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        return e.select("src", "dst", (3 + (F.col("src") * 31 + F.col("dst") * 17) % 7).alias("time"), (1 + (F.col("src") + 2 * F.col("dst")) % 4).alias("lts"))

    @cached_property
    def potentials(self) -> DataFrame:
        people = self.table("customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("population"))
        jobs = self.table("supplier").groupBy(F.col("s_nationkey").cast("long").alias("node")).agg(F.count("*").alias("job"))
        return self.nodes.select(F.col("id").alias("node")).join(people, "node", "left").join(jobs, "node", "left").na.fill(0)

    @cached_property
    def projects(self) -> DataFrame:
        """(proj, a, b): undirected pairs with a high-stress edge, numbered by their ends. A small table by nature."""
        pairs = self.edges.filter("lts > 2").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        return pairs.withColumn("proj", F.row_number().over(Window.orderBy("a", "b")).cast("long") - 1).select("proj", "a", "b")

    @cached_property
    def project_edges(self) -> DataFrame:
        e = self.edges.filter("lts > 2").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
        return e.join(self.projects, ["a", "b"]).select("proj", "src", "dst", "time")

    @cached_property
    def current(self) -> DataFrame:
        return self.edges.filter("lts <= 2").select("src", "dst", "time")

    @cached_property
    def origins(self) -> DataFrame:
        return self.nodes.select(F.col("id").alias("orig"))

    def reach(self, edges: DataFrame, cutoff: int, origins: DataFrame | None = None) -> DataFrame:
        return graph.reach(self.origins if origins is None else origins, edges, cutoff).withColumn("dist", F.col("dist").cast("long"))

    @cached_property
    def od(self) -> DataFrame:
        whole = self.reach(self.edges, TIME_MAX).filter("orig != node")
        now = self.reach(self.current, NOW_LIMIT).select("orig", "node")
        pairs = whole.join(now, ["orig", "node"], "left_anti")
        numbered = pairs.withColumn("od_id", F.row_number().over(Window.orderBy("orig", "node")).cast("long"))
        return numbered.select("od_id", "orig", F.col("node").alias("des"), F.col("dist").alias("time"))

    def design_edges(self, chosen) -> DataFrame:
        """The current network with the edges of the chosen projects (a condition on proj) put in or replaced."""
        return graph.augment(self.current, self.project_edges.filter(chosen).select("src", "dst", "time"))
