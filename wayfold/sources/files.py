"""Reading and writing: tables that may be missing, resumable results, artefacts kept for reuse, plain-text geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system the session knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame | None, bool]:
    """The table and True, or (None, False) where it is missing. CSV by its header, all else as Parquet."""
    if not exists(spark, path):
        return None, False
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), True
    return spark.read.parquet(path), True


def dump(df: DataFrame, path: str) -> None:
    """Replaces the table at the path: CSV for names that end in .csv, Parquet otherwise."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path; made and stored first where it is missing."""
    found, there = load(spark, path)
    if not there:
        dump(make(), path)
        found, _ = load(spark, path)
    return found


def pending(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of `work` whose keys are not among the results so far."""
    return work if done is None else work.join(done.select(*keys), keys, "left_anti")


def resume(spark: SparkSession, path: str, work: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Computes what is not yet stored at the path, appends it and returns all results. A repeated call adds nothing."""
    done, there = load(spark, path)
    fresh = pending(work, done if there else None, keys)
    compute(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of a stored corpus, read lazily."""
    return spark.read.parquet(folder)


def write_chunks(df: DataFrame, path: str, chunk: str) -> None:
    """One folder for each chunk, so that parts can be read alone."""
    df.write.mode("overwrite").partitionBy(chunk).parquet(path)


def line_geometry(df: DataFrame, x1: str, y1: str, x2: str, y2: str, out: str = "geometry") -> DataFrame:
    """Adds a GeoJSON line string between two places."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    return df.withColumn(out, F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(point(x1, y1), point(x2, y2)).alias("coordinates"))))
