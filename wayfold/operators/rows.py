"""Row in use: the newest usable row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_in_use(df: DataFrame, keys: list[str], newest: str, payload: list[str], usable: Column | None = None) -> DataFrame:
    """The row of each key with the greatest `newest`, unusable rows set aside first.

    Rows with a null key or a null `newest` are set aside too. Copies count once. Of two different rows with the
    same `newest` the one with the greater payload (compared left to right, null least) wins, so that the result
    does not depend on the order of rows. Aggregated before the shuffle; one shuffle on the keys, so a key that
    holds a third of all rows arrives as one partial result per input task. Columns: keys, then payload.
    """
    kept = df if usable is None else df.filter(usable)
    for k in [*keys, newest]:
        kept = kept.filter(F.col(k).isNotNull())
    best = F.max(F.struct(F.col(newest).alias("__at"), *[F.col(c) for c in payload])).alias("__best")
    return kept.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in payload])
