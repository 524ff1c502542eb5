"""Queries of the operators in this subpackage over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import cluster, mixing, mojibake, neighbors, tokens, topn, vectors
from wayfold.operators.rows import rows_in_use
from wayfold.session import checkpointed, finite, spread, table

#: Total of the mix, in tokens of byte_bpe_50k; None: one pass over all named sources.
MIX_TOTAL = None


#: Elements of a good vector and the least cosine, rounded to six decimals, of a link.
DIMENSIONS, LINK = 32, 0.95


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_in_use(table(spark, sf_dir, "embedding"), ["od_id"], "loaded_at", ["feature"], vectors.usable_vector("feature", DIMENSIONS))


def vectors_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(_vectors(spark, sf_dir))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pivot_clusters(_vectors(spark, sf_dir), "od_id", "feature", LINK)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cluster.linked_groups(_clusters(spark, sf_dir), LINK)
    return groups.select(F.col("first_id").alias("first_od"), F.col("id").alias("od_id"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.closest_pivots(_clusters(spark, sf_dir), LINK)
    return rows.select(F.col("id").alias("od_id"), F.col("pivot").alias("cluster"), F.round("cosine", 6).alias("cosine"))


def p2_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.typical_members(checkpointed(cluster.closest_pivots(_clusters(spark, sf_dir), LINK)))


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbors.nearest_vectors(vectors_in_use(spark, sf_dir), "od_id", "feature", 3, LINK)
    return near.select(F.col("id").alias("od_id"), F.col("other").alias("similar_od"), "cosine", "place")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = p3_neighbors(spark, sf_dir)
    return near.select(F.least("od_id", "similar_od").alias("od_a"), F.greatest("od_id", "similar_od").alias("od_b")).distinct()


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in use of complete_pmedian_knn, sizes that agree to six decimals made one."""
    t = table(spark, sf_dir, "complete_pmedian_knn").withColumn("size", F.round("size", 6))
    return rows_in_use(t, ["rec_id"], "loaded_at", ["ins_id", "budget", "size", "obj"], F.col("budget").isNotNull() & F.col("size").isNotNull() & finite(F.col("obj")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(result_rows(spark, sf_dir))
    return topn.top_n_per_group(rows, ["ins_id", "budget", "size"], "obj", ["rec_id"], 3).select("rec_id", "place")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_texts(spread(docs), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").filter("source is not null")
    sized = mixing.sized_documents(spread(docs), ["doc_id", "source"], "text")
    shares = mixing.plan_mix(sized, table(spark, sf_dir, "mix_targets"), MIX_TOTAL)
    return mixing.mix(sized, shares, "doc_id"), shares


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(*_mix(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mojibake.find_garbled(docs, "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mojibake.find_garbled(docs, "doc_id", "text", restore=True)


def queries() -> dict:
    return {"p2_found": p2_found, "p2_clusters": p2_clusters, "p2_typical": p2_typical, "p3_found": p3_found, "p3_neighbors": p3_neighbors, "p4_found": p4_found, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
