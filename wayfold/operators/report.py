"""Result tables: gaps, best results so far, as-of lookups, quantile groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def optimality_gap(results: DataFrame, groups: list[str], best_within: list[str], obj: str = "obj") -> DataFrame:
    """Mean and population spread, per group, of 1 - obj / best, the best taken within `best_within`. Two grouped
    aggregates and one join, so no task sees a whole group of results."""
    best = results.groupBy(*best_within).agg(F.max(obj).alias("__best"))
    gap = 1 - F.try_divide(F.col(obj), F.col("__best"))
    rows = results.join(best, best_within).withColumn("__gap", gap)
    return rows.groupBy(*groups).agg(F.avg("__gap").alias("gap"), F.stddev_pop("__gap").alias("spread"), F.count("*").alias("runs"))


def running_best(levels: DataFrame, order: str, value: str) -> DataFrame:
    """Best value up to each level. One row per level is expected, a short table: it is ordered as a whole."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return levels.withColumn("best_so_far", F.max(value).over(w))


def as_of(levels: DataFrame, level: str, steps: DataFrame, key: str, values: list[str], by: list[str]) -> DataFrame:
    """For each level (per `by`) the values of the step with the greatest key not above it; null where there is none.

    Levels and steps are merged into one sequence per `by` and the last step carried forward, so the work is one sort,
    however many levels there are."""
    a = steps.select(*by, F.col(key).alias("__k"), F.struct(*values).alias("__v"), F.lit(0).alias("__side"))
    b = levels.select(*by, F.col(level).alias("__k"), F.lit(None).cast(a.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__side"))
    w = Window.partitionBy(*by).orderBy("__k", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*by, F.col("__k").alias(level), *[F.col(f"__last.{v}").alias(v) for v in values])


def quantile_group(df: DataFrame, value: str, groups: int, out: str) -> DataFrame:
    """Right-closed quantile groups from 1, by linearly interpolated quantiles; equal values share a group. Null values
    have none. The few cut points come from one exact aggregate and are joined back as a single row."""
    cuts = [i / groups for i in range(1, groups)]
    q = df.agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("__q"), F.lit(1).alias("__one"))
    rows = df.withColumn("__one", F.lit(1)).join(F.broadcast(q), "__one")
    above = sum(((F.col(value) > F.col("__q")[i]).cast("int") for i in range(groups - 1)), F.lit(1))
    return rows.withColumn(out, above).drop("__q", "__one")
