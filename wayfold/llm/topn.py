"""Top N rows of every group by partition lower bounds.

1. Every partition finds, per group, its own N-th best score. At least N rows of the group reach that score, so it is a
   valid lower bound for the group's N-th best score overall.
2. The greatest bound of each group is joined to the rows; rows below it cannot be among the N best and are dropped
   before any row is moved.
3. The survivors are ranked by a window per group, at most a few N x partitions rows for a group of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.session import checkpointed

#: Bounds rows up to which the bounds are broadcast (24 bytes each, so at most some 25 MB); beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000


def _keep_best(h1, h2, score, weight, n):
    """The n best rows of each group; the weights of the rest go to the group's best row."""
    order = np.lexsort((-score, h2, h1))
    h1, h2, score, weight = h1[order], h2[order], score[order], weight[order]
    new = np.empty(len(h1), bool)
    new[:1] = True
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(weight, start)
    place = np.arange(len(h1)) - np.repeat(start, np.diff(np.append(start, len(h1))))
    weight = np.zeros_like(weight)
    weight[start] = total
    keep = place < n
    return h1[keep], h2[keep], score[keep], weight[keep]


def local_bounds(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    """One partition's n-th best score of each group that has at least max(n, least) rows here.

    Rows are buffered and compacted whenever the buffer is as large as what was kept, so a partition costs
    O(rows log rows) and holds no more than twice its best rows and one buffer.
    """
    kept = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
    parts, waiting = [], 0

    def compact():
        cols = [np.concatenate([k, *[p[i] for p in parts]]) for i, k in enumerate(kept)]
        return _keep_best(*cols, n) if len(cols[0]) else tuple(cols)

    for b in batches:
        h1, h2, score = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts.append((h1, h2, score, np.ones(len(h1), np.int64)))
        waiting += len(h1)
        if waiting > max(1 << 16, len(kept[0])):
            kept, parts, waiting = compact(), [], 0
    h1, h2, score, weight = compact()
    if len(h1):
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h1)))
        hot = (size == n) & (weight[start] >= least)
        last = start[hot] + n - 1
        yield pa.RecordBatch.from_arrays([pa.array(h1[last]), pa.array(h2[last]), pa.array(score[last])], names=["__h1", "__h2", "__bound"])


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, place: str = "place", hot_rows: int = 64) -> DataFrame:
    """The `n` rows of highest `score` in each group, ties by the least `ties`, with their place from 1.

    Rows whose score is null or NaN are not ranked. Null group values form groups of their own. Rows equal in score
    and ties may take each other's place. A group with fewer rows gives fewer. Other columns pass through, also
    those named like nothing of ours (internal names start with two underscores); an existing column `place` is
    replaced. Groups that have fewer than `hot_rows` rows in every partition get no bound, which drops nothing.
    `df` is read twice: pass a table, or a checkpoint where it is costly.
    """
    if n < 1:
        return df.limit(0).withColumn(place, F.lit(0))
    ranked = df.drop(place) if place not in groups else df
    ranked = ranked.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    keyed = ranked.withColumns({"__h1": F.xxhash64(*groups), "__h2": F.xxhash64(F.lit("second"), *groups), "__score": F.col(score).cast("double")})
    local = keyed.select("__h1", "__h2", "__score").mapInArrow(lambda it: local_bounds(it, n, hot_rows), "__h1 long, __h2 long, __bound double")
    bounds = checkpointed(local.groupBy("__h1", "__h2").agg(F.max("__bound").alias("__bound")))
    known = bounds.limit(BROADCAST_ROWS + 1).count()
    if known:
        bounds = F.broadcast(bounds) if known <= BROADCAST_ROWS else bounds
        keyed = keyed.join(bounds, ["__h1", "__h2"], "left").filter(F.col("__bound").isNull() | (F.col("__score") >= F.col("__bound")))
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *[F.col(t).asc() for t in ties])
    return keyed.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= n).drop("__h1", "__h2", "__score", "__bound")
