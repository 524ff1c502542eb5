"""Seeded weighted random walks over a graph of similar items, the corpus of an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import checkpointed


def uniform(*keys):
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def random_walks(graph: DataFrame, rounds: int, length: int, seed: int = 0, every: int = 8) -> DataFrame:
    """(round, start, nodes): walks of at most `length` nodes from every node, shorter where a node leads nowhere.

    `graph` is (i, j, w); the next node is drawn in proportion to w by a hash of seed, round, start and step, so walks
    are the same for any partitioning. Each step joins the walks with the neighbour lists, which are short where the
    graph keeps the most similar items only.
    """
    near = graph.filter("w > 0").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("to"))
    near = checkpointed(near.select(F.col("i").alias("at"), "to", F.aggregate("to", F.lit(0.0), lambda s, x: s + x["w"]).alias("total")))
    walks = near.select(F.col("at").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    walks = walks.select("round", "start", F.col("start").alias("at"), F.array("start").alias("nodes"))
    for step in range(1, length):
        draw = uniform(F.lit(seed), "round", "start", F.lit(step)) * F.col("total")
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("pick"))
        pick = F.aggregate("to", state, lambda s, x: F.struct((s["sum"] + x["w"]).alias("sum"), F.when(s["pick"].isNull() & (s["sum"] + x["w"] > F.col("__draw")), x["j"]).otherwise(s["pick"]).alias("pick")))
        joined = walks.join(near, "at", "left").withColumn("__draw", draw)
        nxt = F.coalesce(pick["pick"], F.element_at("to", -1)["j"])
        walks = joined.withColumn("__next", F.when(F.col("to").isNotNull(), nxt)).select("round", "start", F.col("__next").alias("at"), F.when(F.col("__next").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("__next"))).alias("nodes"))
        if step % every == 0:
            walks = checkpointed(walks)
    return walks.select("round", "start", "nodes")


def word_vectors(walks: DataFrame, size: int, window: int = 5, epochs: int = 5, seed: int = 0):
    """(id, vec): skip-gram vectors of the nodes of walks. Training uses hierarchical softmax, so numbers differ from
    those of negative sampling; the structure is the same."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = walks.select(F.col("nodes").cast("array<string>").alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, maxIter=epochs, seed=seed, inputCol="words", outputCol="out").fit(words)
    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec"))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Writes (id, vec), replacing what is there."""
    vectors.select("id", "vec").write.mode("overwrite").parquet(path)


def load_vectors(spark, path: str) -> DataFrame:
    """(id, vec) as `save_vectors` wrote them."""
    return spark.read.parquet(path).select("id", "vec")
