"""Scores of all pairs of items that have a vector each, block by block, and graphs of the most similar ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.session import cores

#: Items of a block at most; a task holds two blocks.
BLOCK_ROWS = 4_096
#: Elements of the vectors that are compared at a time.
STRIP = 4_096


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), -1)


def ratio_sum(a: np.ndarray, b: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    """Sum over elements of min(x / (y + eps), y / (x + eps)), for all rows of a with all rows of b."""
    out = np.zeros((len(a), len(b)))
    for x in range(0, a.shape[1], STRIP):
        left, right = a[:, x : x + STRIP], np.ascontiguousarray(b[:, x : x + STRIP])
        for i in range(len(a)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i] += np.minimum(left[i] / (right + eps), right / (left[i] + eps)).sum(1)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of scenarios in which both are connected among those in which either is; 0/1 rows."""
    both = a @ b.T
    return both / (a.sum(1)[:, None] + b.sum(1)[None] - both + 1e-2)


def co_connection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def utility_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ratio sum of increments over the number of scenarios in which either increases."""
    up_a, up_b = (a > 0).astype(float), (b > 0).astype(float)
    return ratio_sum(a, b) / (up_a.sum(1)[:, None] + up_b.sum(1)[None] - up_a @ up_b.T + 1e-3)


def pair_scores(items: DataFrame, score, least: float | None = None) -> DataFrame:
    """(i, j, w), i < j, of all pairs of (id, vec) whose score is more than `least` (None: all).

    Items are dealt to blocks; two blocks meet in one task, so memory is bounded and each pair is computed once. All
    pairs are the operator's meaning, the work is quadratic in the number of items. NaN scores and null ids
    give no row.
    """
    items = items.filter("id is not null")
    n = items.count()
    blocks = max(-(-n // BLOCK_ROWS), min(max(1, n // 64), int(np.ceil(np.sqrt(2 * cores(items.sparkSession))))))
    placed = items.select("id", "vec").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = met.select(F.least("block", "k").alias("p"), F.greatest("block", "k").alias("q"), "block", "id", "vec")

    def run(key, t):
        p, q = (k.as_py() for k in key)
        ids, block, v = t.column("id").to_numpy(), t.column("block").to_numpy(), _matrix(t.column("vec"))
        a, b = np.flatnonzero(block == p), np.flatnonzero(block == q)
        out = []
        for x in range(0, len(a), 512):
            part = a[x : x + 512]
            s = score(v[part], v[b])
            hit = ~np.isnan(s) if least is None else s > least
            r, c = np.nonzero(hit)
            i, j, w = ids[part[r]], ids[b[c]], s[r, c]
            keep = i < j if p == q else i != j
            out.append((i[keep], j[keep], w[keep]))
        i, j, w = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "w": w})

    return tasks.groupBy("p", "q").applyInArrow(run, "i long, j long, w double")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "w").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def top_similar(pairs: DataFrame, k: int) -> DataFrame:
    """(i, j, w, place): for each item its `k` most similar others; ties to the smaller id; zero weights are dropped."""
    order = Window.partitionBy("i").orderBy(F.desc("w"), "j")
    return both_ways(pairs).filter("w != 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def merge_weights(*graphs: DataFrame) -> DataFrame:
    """(i, j, w): weights of the same pair in several graphs added up."""
    out = graphs[0].select("i", "j", "w")
    for g in graphs[1:]:
        out = out.unionByName(g.select("i", "j", "w"))
    return out.groupBy("i", "j").agg(F.sum("w").alias("w"))
