"""Session helpers: defaults for local runs, checkpoints and table reading."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wayfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session; they need not have it installed. Spark's own file server
    hands the archive out, so nothing is read from a folder of one machine."""
    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wayfold-"), "wayfold.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("wayfold", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._wayfold_shipped = True


def shipped(query):
    """A query of (spark, sf_dir) that sends the package to the workers first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the session; only a local session that names none gets one of our own (tests).
    A cluster must name one, as a folder of one machine is no use to the others."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"wayfold-checkpoints-{os.getuid()}"))


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def released(*kept: DataFrame) -> None:
    """Removes the files of checkpointed tables that nothing reads any more; else they stay until the driver collects its garbage."""
    for df in kept:
        at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def frees_shuffles(step):
    """A step all of whose tables are checkpointed at once: the shuffle files of each of its jobs are removed when the job ends."""

    @functools.wraps(step)
    def run(df, *args, **more):
        conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name, None)
        conf.set(name, "true")
        try:
            return step(df, *args, **more)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Even out too few input splits before costly Python work; tables of enough splits are left as they are."""
    want = cores(df.sparkSession) * per_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def finite(c: Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
