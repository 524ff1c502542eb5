"""Representatives of many items: choosing them, assigning items to them, weighting and judging them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.columns import computed_once, dot
from wayfold.operators.similarity import _matrix
from wayfold.session import checkpointed

#: Representatives sent to every task at a time; more are worked off in chunks of that size.
CHUNK_ROWS = 20_000


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between rows: 'cosine' is 1 minus the cosine (NaN for a zero vector), 'euclidean' the length."""
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None]
    if metric == "euclidean":
        return np.stack([np.sqrt(((a - r) ** 2).sum(1)) for r in b], 1) if len(b) else np.empty((len(a), 0))
    raise ValueError(f"unknown metric {metric}")


def _chunks(reps: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Representatives in chunks of bounded size."""
    n = reps.count()
    parts = max(1, -(-n // CHUNK_ROWS))
    for p in range(parts):
        rows = reps.select("id", "vec").filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).orderBy("id").collect()
        if rows:
            yield np.array([r["id"] for r in rows], np.int64), np.array([r["vec"] for r in rows], float)


def nearest(items: DataFrame, reps: DataFrame, k: int, metric: str = "cosine", decimals: int = 9) -> DataFrame:
    """(id, rep, distance, place): each item's `k` nearest representatives, ties to the smaller id.

    Items stay where they are; representatives come to them in chunks of CHUNK_ROWS, each item keeps its k best of a
    chunk, and with several chunks one grouped ranking merges them. Distances are rounded to `decimals` before ranking.
    """
    parts = []
    for ids, v in _chunks(reps):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, v=v) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, own = _matrix(b.column(1)), b.column(0)
                for s in range(0, len(x), 1024):
                    d = np.round(distances(x[s : s + 1024], v, metric), decimals) + 0.0  # no negative zero
                    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                    m = order.shape[1]
                    who = own.slice(s, len(d)).take(pa.array(np.repeat(np.arange(len(d)), m)))
                    yield pa.RecordBatch.from_arrays([who, pa.array(ids[order].reshape(-1)), pa.array(np.take_along_axis(d, order, 1).reshape(-1)), pa.array(np.tile(np.arange(1, m + 1), len(d)), pa.int32())], names=["id", "rep", "distance", "place"])

        parts.append(items.select(F.col("id").cast("long"), "vec").mapInArrow(run, "id long, rep long, distance double, place int"))
    if not parts:
        return items.sparkSession.createDataFrame([], "id long, rep long, distance double, place int")
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("id").orderBy("distance", "rep")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def assignment_weights(items: DataFrame, reps: DataFrame, assigned: DataFrame, factor=None) -> DataFrame:
    """(rep, weight): a representative's own potential plus its share of the potential of items assigned to it.

    `items` has id and worth; `assigned` id and rep with the same number of rows for each item. Items that are
    representatives keep their potential whole. `factor` may scale what a representative receives, a column of
    `assigned`. Without a factor the weights add up to the potential of all items.
    """
    own = items.join(reps.select("id"), "id", "left_semi").select(F.col("id").alias("rep"), F.col("worth").cast("double").alias("w"))
    k = assigned.groupBy("id").agg(F.count("*").alias("k"))
    others = assigned.join(reps.select("id"), "id", "left_anti").join(k, "id").join(items.select("id", "worth"), "id")
    share = F.col("worth") / F.col("k") * (F.lit(1.0) if factor is None else factor)
    given = others.select("rep", share.alias("w"))
    return own.unionByName(given).groupBy("rep").agg(F.sum("w").alias("weight"))


def out_of_sample_sum(items: DataFrame, reps: DataFrame) -> DataFrame:
    """(dim, value): by dimension, the sum over items that are no representatives of potential times vector."""
    rest = items.join(reps.select("id"), "id", "left_anti").select("worth", F.posexplode("vec").alias("dim", "x"))
    return rest.groupBy("dim").agg(F.sum(F.col("worth") * F.col("x").cast("double")).alias("value"))


def median_objective(items: DataFrame, reps: DataFrame, kappa: int, uneven: float = 0.0, metric: str = "cosine") -> DataFrame:
    """One row (obj, spread): weighted sum of the kappa smallest distances of items that are no representatives, blended
    with the imbalance of the assignment."""
    near = nearest(items, reps, kappa, metric).join(reps.select("id"), "id", "left_anti")
    near = near.join(items.select("id", "worth"), "id")
    cost = near.agg(F.sum(F.col("distance") * F.col("worth")).alias("cost"), F.countDistinct("id").alias("n"))
    counts = near.groupBy("rep").agg(F.count("*").alias("c"))
    both = counts.withColumn("one", F.lit(1)).join(F.broadcast(cost.withColumn("one", F.lit(1))), "one")
    both = both.join(F.broadcast(counts.agg(F.count("*").alias("used"), F.lit(1).alias("one"))), "one")  # single rows
    spread = F.sum(F.abs(F.col("c") - F.col("n") / F.col("used"))).alias("spread")
    return both.agg(F.first("cost").alias("cost"), spread).select(F.round((1 - uneven) * F.col("cost") + uneven * 0.2 * F.col("spread"), 6).alias("obj"), F.round("spread", 6).alias("spread"))


def outlier_count(n: int, tol: float) -> int:
    return max(1, int(n * tol))


#: Rows that are ordered in one task at most; longer lists are narrowed down by counting first.
TOP_ROWS = 10_000
BINS = 1_024


def nth_greatest(df: DataFrame, value: str, key: str, n: int) -> tuple[float, int]:
    """(value, key) of the row at place `n`, counted from 1, by falling value and rising key; `df` has a number `value`
    and a whole-number `key` in each row and at least `n` rows, and is read several times.

    Short lists are ordered; for longer ones values are counted in BINS ranges, then those of the range that holds
    the place, and so on, so no task orders more than TOP_ROWS rows."""
    order = [F.desc("__v"), F.asc("__k")]
    rows = df.select(F.col(value).cast("double").alias("__v"), F.col(key).cast("long").alias("__k"))
    by_key = False
    while n > TOP_ROWS:
        x = -F.col("__k").cast("double") if by_key else F.col("__v")
        lo, hi, m = rows.agg(F.min(x), F.max(x), F.count("*")).first()
        if m <= TOP_ROWS:
            break
        if lo == hi:
            if by_key:
                break  # copies of one row
            by_key = True
            continue
        at = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1)) if hi - lo < float("inf") else (x == F.lit(hi)).cast("int")
        counts = {r[0]: r[1] for r in rows.groupBy(at.alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            if n <= counts[b]:
                rows = rows.filter(at == b)
                break
            n -= counts[b]
    last = rows.orderBy(*order).limit(n).agg(F.min(F.struct("__v", (-F.col("__k")).alias("m"))).alias("e")).first()["e"]
    return last["__v"], -last["m"]


def center_objective(items: DataFrame, reps: DataFrame, tol: float, metric: str = "euclidean") -> DataFrame:
    """One row (farthest, nth_farthest, mean): nearest distances of all items; the n-th farthest leaves outliers out."""
    near = checkpointed(nearest(items, reps, 1, metric).select("id", "distance"))
    s = near.agg(F.max("distance").alias("farthest"), F.avg("distance").alias("mean"), F.count("*").alias("n")).first()
    spark = items.sparkSession
    nth = nth_greatest(near, "distance", "id", outlier_count(s["n"], tol))[0] if s["n"] else None
    return spark.createDataFrame([(s["farthest"], nth, s["mean"])], "farthest double, nth_farthest double, mean double")


def uniform_sample(items: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n items (or all), by seeded hash of the id; the same ones for any order or partitioning of rows. The place
    where the sample ends is found first when it is long, so no task orders the whole sample. `items` has one row for each id."""
    h = F.xxhash64(F.lit(seed), "id")
    if n <= TOP_ROWS:
        return items.orderBy(h, "id").limit(n)
    hashed = checkpointed(items.select(F.col("id").cast("long").alias("id"), h.alias("__h")))
    if hashed.count() <= n:
        return items
    # hashes are whole numbers; their upper half is exact as a number, ties within it are ordered by the rest
    upper = hashed.withColumn("__u", -F.shiftright("__h", 32).cast("double"))
    edge = -nth_greatest(upper, "__u", "id", n)[0]
    below = upper.filter(-F.col("__u") < edge)
    rest = upper.filter(-F.col("__u") == edge).orderBy("__h", "id").limit(n - below.count())
    return items.join(below.select("id").unionByName(rest.select("id")), "id", "left_semi")


def k_center(items: DataFrame, n: int, seed: int = 0, tol: float = 0.1, repeat: int = 1) -> DataFrame:
    """(rank, id, delta): greedy k-center with outliers. Each step takes the item that is n_outliers-th farthest from
    those taken; of `repeat` starts the one with the least final distance. One pass over the items for each step, the
    vector of the last choice travels to the data; distances so far stay with the items."""
    spark = items.sparkSession
    base = checkpointed(items.select(F.col("id").cast("long").alias("id"), "vec"))
    total = base.count()
    skip = outlier_count(total, tol)
    starts = [r["id"] for r in uniform_sample(base.select("id"), repeat, seed).collect()]
    best: tuple[float, list[int]] | None = None
    for start in starts:
        taken, state = [start], base.withColumn("far", F.lit(float("inf")))
        while True:
            v = np.array(base.filter(F.col("id") == taken[-1]).first()["vec"], float)

            def run(batches: Iterator[pa.RecordBatch], v=v) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        d = np.sqrt(((_matrix(b.column(1)) - v) ** 2).sum(1))
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(d, b.column(2).to_numpy()))], names=["id", "vec", "far"])

            state = checkpointed(state.mapInArrow(run, state.schema))
            far, at = nth_greatest(state, "far", "id", skip)
            if len(taken) >= min(n, total):
                break
            taken.append(at)
        if best is None or far < best[0]:
            best = far, taken
    rows = [(i + 1, x, best[0]) for i, x in enumerate(best[1])] if best else []
    return spark.createDataFrame(rows, "rank int, id long, delta double")


def p_median(items: DataFrame, p: int, seed: int = 0, rounds: int = 5, swaps: int = 3, metric: str = "cosine", restarts: int = 1, keep: DataFrame | None = None, never: DataFrame | None = None) -> DataFrame:
    """(id, obj): p-median by alternation (assign items, move each representative to its cluster's best member) and random
    swaps that are kept when they help, until a round does not; the best of `restarts` starts. Representatives in `keep`
    (id) stay, those in `never` (id) are not taken; others than the cosine metric are refused.

    With unit vectors the best member under cosine distance maximises the product with the sum of its cluster's
    vectors, so a cluster of any size costs one grouped sum and one grouped maximum, never all pairs."""
    if metric != "cosine":
        raise ValueError("representatives move by the sum of unit vectors, which is right for cosine distances only")
    plain = items.select(F.col("id").cast("long").alias("id"), "vec", F.col("worth").cast("double").alias("worth"))
    sized = computed_once(plain, length=F.sqrt(dot("vec", "vec")))
    base = checkpointed(sized.select("id", F.transform("vec", lambda x: x / F.col("length")).alias("vec"), "worth"))

    def cost(reps: DataFrame) -> float:
        near = nearest(base, reps, 1, metric)
        return near.join(base.select("id", "worth"), "id").agg(F.sum(F.col("distance") * F.col("worth"))).first()[0] or 0.0

    free = base if never is None else base.join(never.select("id"), "id", "left_anti")
    stay = base.limit(0) if keep is None else checkpointed(base.join(keep.select("id"), "id", "left_semi"))
    kept = stay.count()
    open_ = free if keep is None else free.join(stay.select("id"), "id", "left_anti")
    best: tuple[float, DataFrame] | None = None
    for start in range(restarts):
        own = seed + 104_729 * start
        reps = checkpointed(stay.unionByName(uniform_sample(open_, max(0, p - kept), own).select(base.columns)))
        obj = cost(reps)
        for r in range(rounds):
            before = obj
            near = nearest(base, reps, 1, metric).select("id", "rep").join(base, "id")
            flat = near.select("rep", "worth", F.posexplode("vec").alias("dim", "x")).groupBy("rep", "dim").agg(F.sum(F.col("x") * F.col("worth")).alias("s"))
            sums = flat.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("dim", "s"))).alias("t")).select("rep", F.col("t.s").alias("total"))
            score = F.aggregate(F.zip_with("vec", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            moving = near if keep is None else near.join(stay.select(F.col("id").alias("rep")), "rep", "left_anti")
            moving = moving if never is None else moving.join(never.select("id"), "id", "left_anti")
            moved = moving.join(sums, "rep").groupBy("rep").agg(F.max(F.struct(F.round(score, 9), (-F.col("id")).alias("m"))).alias("b"))
            moved = stay.unionByName(moved.select((-F.col("b.m")).alias("id")).join(base, "id").join(stay.select("id"), "id", "left_anti").select(base.columns))
            moved = checkpointed(moved)
            new = cost(moved)
            if new < obj - 1e-12 and moved.count() == reps.count():
                reps, obj = moved, new
            for s in range(swaps):
                out = reps.join(stay.select("id"), "id", "left_anti").orderBy(F.xxhash64(F.lit(own * 1000 + r * 100 + s), "id")).limit(1).select("id")
                fresh = uniform_sample(open_.join(reps.select("id"), "id", "left_anti"), 1, own * 7919 + r * 100 + s)
                trial = checkpointed(reps.join(out, "id", "left_anti").unionByName(fresh.select(reps.columns)))
                new = cost(trial)
                if new < obj - 1e-12 and trial.count() == reps.count():
                    reps, obj = trial, new
            if obj >= before - 1e-12:
                break
        if best is None or obj < best[0]:
            best = obj, reps
    return best[1].select("id", F.lit(best[0]).alias("obj"))


def exact_median(items: DataFrame, p: int, metric: str = "cosine") -> DataFrame:
    """(ids, obj): the best p representatives by trying all sets; for some twenty items at most. Ties to the first set."""
    from itertools import combinations

    rows = items.orderBy("id").limit(25).collect()
    if len(rows) > 24:
        raise ValueError("too many items to try all sets")
    ids, v = [r["id"] for r in rows], np.array([r["vec"] for r in rows], float)
    w = np.array([float(r["worth"]) for r in rows])
    d = np.round(distances(v, v, metric), 9)
    best = min(combinations(range(len(ids)), p), key=lambda s: (round(float((d[:, list(s)].min(1) * w).sum()), 9), s))
    obj = float((d[:, list(best)].min(1) * w).sum())
    return items.sparkSession.createDataFrame([([ids[i] for i in best], obj)], "ids array<long>, obj double")


def perturbed_median(items: DataFrame, chosen: DataFrame, seed: int = 0, rounds: int = 2, swaps: int = 1) -> DataFrame:
    """(id, kept): half of the chosen stay, the other half is forbidden, and the p-median is searched again under both."""
    chosen = checkpointed(chosen.select("id"))
    n = chosen.count()
    kept = checkpointed(uniform_sample(chosen, n // 2, seed).select("id"))
    again = p_median(items, n, seed + 1, rounds, swaps, keep=kept, never=chosen.join(kept, "id", "left_anti"))
    return again.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def sample_batch(items: DataFrame, sizes: list[float], seeds: list[int]) -> DataFrame:
    """(size, seed, id): one uniform sample for each share and seed, all in one job: items are ranked by hash within each
    seed's hash bins, so no task orders all items."""
    spark = items.sparkSession
    n = items.count()
    bins = 256
    runs = items.select("id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    hashed = runs.withColumn("h", F.xxhash64("seed", "id")).withColumn("bin", F.shiftrightunsigned("h", 56))
    sizes_of = hashed.groupBy("seed", "bin").agg(F.count("*").alias("c"))
    before = sizes_of.withColumn("before", F.sum("c").over(Window.partitionBy("seed").orderBy("bin")) - F.col("c")).select("seed", "bin", "before")
    rank = F.row_number().over(Window.partitionBy("seed", "bin").orderBy("h", "id"))
    ranked = hashed.join(F.broadcast(before), ["seed", "bin"]).withColumn("rank", F.col("before") + rank)
    want = spark.createDataFrame([(float(s), int(n * s)) for s in sizes], "size double, want long")
    assert bins * len(seeds) <= 100_000
    return ranked.withColumn("one", F.lit(1)).join(F.broadcast(want.withColumn("one", F.lit(1))), "one").filter("rank <= want").select("size", "seed", "id")
