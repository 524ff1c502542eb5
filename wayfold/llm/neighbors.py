"""Most similar vectors of every vector: one navigable small-world graph per shard, shard results merged.

Rows are dealt to coarse cells by their most similar pivot; a cell, or each slab of a large one, is a shard. A row searches
its own shard from its own node, and comes down through the levels of the graphs of the other slabs of its cell and of
every cell whose pivot is nearly as similar as its own (within `margin`). While cells fit into a slab, up to MOST_CELLS x
MOST_SHARD_ROWS rows, the number of searches a row needs does not grow with the table; in a larger cell, as a very dense spot
is, it grows with the number of its slabs. A shard's graph is built once, and again for every further QUERY_ROWS rows that
come from elsewhere. The graph finds
candidates; the cosines of all that may round to the k-th or more are then computed in double and rounded before they are
ranked. Rows with equal unit vectors enter as one and are told apart again at the end; a query with many candidates that
tie at the k-th place is compared with its whole shard. Vectors travel as they came, which packs better than their unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.llm.hnsw import HNSW
from wayfold.llm.vectors import DECIMALS, at_least, coarse_pivots, lists, matrix, unit
from wayfold.session import checkpointed, cores

#: Rows a shard is meant to have, rows it has at most, and foreign queries that one task answers.
SHARD_ROWS, MOST_SHARD_ROWS, QUERY_ROWS = 8_000, 32_000, 100_000
#: How much less similar than its own a cell's pivot may be for the cell to be searched. Measured: 0.06 finds the cells
#: of 99.95 percent of neighbours of cosine 0.95 or more, with 30, 300 and 3,000 pivots alike.
MARGIN = 0.06
#: Diverse neighbours of a node, candidates they are chosen from, nodes a search holds, and candidates about the k-th
#: cosine beyond which a query is compared with its whole shard (twice k at least).
LINKS, NEAR, SEARCH_WIDTH, EXACT = 12, 32, 32, 12
#: Most partitions of the graph stage; a task then takes several shards one after the other.
MOST_TASKS = 20_000


def _key_numbers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, (2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys_of(v: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each row, equal for equal rows; for others both agree by a chance of some 1 in 10^38."""
    x = np.ascontiguousarray(v).view(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    r = _key_numbers()
    r = np.tile(r, (1, -(-x.shape[1] // r.shape[1])))[:, : x.shape[1]]
    h = np.stack([(x * k).sum(1, dtype=np.uint64) for k in r], 1)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def unit_of(v: np.ndarray) -> np.ndarray:
    return unit(v) + 0.0  # no negative zeros, so that equal vectors have equal keys


def usable_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vec, h1, h2): vectors as they are with the key of their unit vector. Vectors of infinite length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = matrix(b.column(1)).astype(float)
            v = unit_of(raw)
            ok = np.isfinite(v).all(1)
            if ok.any():
                h = keys_of(v[ok])
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), lists(raw[ok]), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "vec", "h1", "h2"])

    return df.select(F.col(key).cast("long"), vec).mapInArrow(run, "id long, vec array<double>, h1 long, h2 long")


def probe_cells(rows: DataFrame, pivots: np.ndarray, margin: float) -> DataFrame:
    """(id, vec, cell, probes): rows with their own cell and all other cells to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = unit_of(matrix(b.column(1))) @ pivots.T
            own = c.argmax(1)
            ask = c >= c.max(1, keepdims=True) - margin
            ask[np.arange(len(own)), own] = False
            row, cell = np.nonzero(ask)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))])
            probes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), probes], names=["id", "vec", "cell", "probes"])

    return rows.select("id", "vec").mapInArrow(run, "id long, vec array<double>, cell int, probes array<int>")


def _whole_shard(own: np.ndarray, own_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, rounded cosine) of the `k` best of all nodes for each query; `own_ids` ascend, so of equal cosines
    the first is that of the smallest id."""
    out, step = [[], [], []], max(1, 8_000_000 // len(own))
    for i in range(0, len(q), step):
        c = q[i : i + step] @ own.T
        c = np.where(c >= least, np.round(c, DECIMALS), -2)
        c[own_ids[None, :] == q_ids[i : i + step, None]] = -2
        rows = np.arange(len(c))
        for _ in range(min(k, len(own))):
            at = c.argmax(1)
            best = c[rows, at]
            ok = best > -1.5
            for o, x in zip(out, (rows[ok] + i, at[ok], best[ok])):
                o.append(x)
            c[rows, at] = -2
    return tuple(np.concatenate(o) for o in out)


def _answer(graph: HNSW, own: np.ndarray, own_ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, start: np.ndarray | None, k: int, least: float, width: int):
    """(query, other, rounded cosine) of the `k` best of one shard for each query."""
    found, sims = graph.search(q, width, start)
    own_self = (found >= 0) & (own_ids[np.maximum(found, 0)] == q_ids[:, None])
    sims = np.where(own_self | (found < 0), -2, sims)
    # all that may round to the k-th cosine or more, with room for the error of a sum in single precision
    slack = 10.0**-DECIMALS + 2 * (own.shape[1] + 2) * 2.0**-24
    kth = -np.partition(-sims, k - 1, 1)[:, k - 1]
    close = (sims > -1.5) & (sims >= np.maximum(kth, least)[:, None] - slack)
    tied = close.sum(1) > max(EXACT, 2 * k)
    r, c = np.nonzero(close & ~tied[:, None])
    node = found[r, c]
    exact = np.einsum("ij,ij->i", own[node], q[r])
    r, node, cosine = r[exact >= least], node[exact >= least], np.round(exact[exact >= least], DECIMALS)
    if tied.any():
        which = np.flatnonzero(tied)
        more = _whole_shard(own, own_ids, q[which], q_ids[which], k, least)
        r, node, cosine = np.append(r, which[more[0]]), np.append(node, more[1]), np.append(cosine, more[2])
    other = own_ids[node]
    by = np.lexsort((other, -cosine, r))
    r, other, cosine = r[by], other[by], cosine[by]
    start = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, int)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return q_ids[r][place < k], other[place < k], cosine[place < k]


def _search_shard(k: int, least: float, links: int, near: int, width: int):
    width = max(width, 4 * k)

    def run(key, t):
        ids, data, v = t.column("id").to_numpy(), t.column("data").to_numpy(), unit_of(matrix(t.column("vec")))
        own, own_ids, q, q_ids = v[data], ids[data], v[~data], ids[~data]
        # the graph depends on the order of rows: by id, whatever way they came
        order = np.argsort(own_ids, kind="stable")
        own, own_ids = own[order], own_ids[order]
        out = []
        if len(own):
            graph = HNSW(own, links, near)
            if key[2].as_py() == 0:  # the shard's own rows ask once
                for i in range(0, len(own), 8192):
                    out.append(_answer(graph, own, own_ids, own[i : i + 8192], own_ids[i : i + 8192], np.arange(i, min(i + 8192, len(own))), k, least, width))
            for i in range(0, len(q), 8192):
                out.append(_answer(graph, own, own_ids, q[i : i + 8192], q_ids[i : i + 8192], None, k, least, width))
        a, b, c = (np.concatenate(o) if out else np.empty(0, t) for o, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, float)))
        return pa.table({"id": a, "other": b, "cosine": c})

    return run


def nearest_vectors(df: DataFrame, key: str, vec: str, k: int = 3, threshold: float = -1.0, margin: float = MARGIN, links: int = LINKS, near: int = NEAR, width: int = SEARCH_WIDTH) -> DataFrame:
    """(id, other, cosine, place): up to `k` other rows of highest cosine, rounded to six decimals, at `threshold` or
    more; ties to the smaller id. `df` has one row per key and usable vectors of one length; it is read twice.

    Approximate: a neighbour can be missed by the graph or by `margin`; every row is indexed and every row asks. Equal
    vectors are never missed: their smallest id stands for all of them until the end.
    """
    spark = df.sparkSession
    usable = usable_rows(df, key, vec)
    one = usable.groupBy("h1", "h2").agg(F.min(F.struct("id", "vec")).alias("r"), F.count("*").alias("copies"))
    apart = checkpointed(one.select("h1", "h2", "r.id", "r.vec", "copies"))
    pivots, n = coarse_pivots(apart, "id", "vec", SHARD_ROWS)
    if not n or not len(pivots):
        return spark.createDataFrame([], "id long, other long, cosine double, place int")
    rows = checkpointed(probe_cells(apart, pivots, margin))
    sizes = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}  # at most MOST_CELLS rows, as the next
    asked = {r[0]: r[1] for r in rows.select(F.explode("probes").alias("cell")).groupBy("cell").count().collect()}
    plan = [(c, -(-m // MOST_SHARD_ROWS)) for c, m in sizes.items()]
    plan = [(c, s, max(1, -(-(asked.get(c, 0) + (sizes[c] if s > 1 else 0)) // QUERY_ROWS))) for c, s in plan]
    shards = min(MOST_TASKS, max(cores(spark), sum(s * c for _, s, c in plan)))
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, slabs int, chunks int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slab = F.pmod(F.xxhash64("id", F.lit(1)), F.col("slabs")).cast("int")
    data = rows.select("id", "vec", "cell").join(plan, "cell").withColumn("slab", slab)
    data = data.withColumn("chunk", upto("chunks")).select("cell", "slab", "chunk", F.lit(True).alias("data"), "id", "vec")
    ask = rows.select("id", "vec", F.col("cell").alias("home"), F.explode(F.concat("probes", F.array("cell"))).alias("cell")).join(plan, "cell")
    ask = ask.filter("cell <> home or slabs > 1").withColumn("own", slab).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int"))
    ask = ask.withColumn("slab", upto("slabs")).filter("cell <> home or slab <> own").select("cell", "slab", "chunk", F.lit(False).alias("data"), "id", "vec")
    # partitions by number, as merging small ones by their bytes would put many graphs into one task
    dealt = data.unionByName(ask).repartition(shards, "cell", "slab", "chunk")
    found = dealt.groupBy("cell", "slab", "chunk").applyInArrow(_search_shard(k, at_least(threshold), links, near, width), "id long, other long, cosine double")
    best = _first(found, k)
    copied = apart.filter("copies > 1").select("h1", "h2", F.col("id").alias("rep"))
    return best if copied.isEmpty() else _with_copies(best, usable.join(copied, ["h1", "h2"]).select("rep", "id"), k, threshold)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _with_copies(near: DataFrame, members: DataFrame, k: int, threshold: float) -> DataFrame:
    """The neighbours of all rows, from those of the rows that stand for equal ones and their `members` (rep, id).

    The `k` best of a row are among the `k` best vectors with their smallest ids and, as the row itself does not count,
    the k + 1 smallest ids of its own vector.
    """
    members = checkpointed(members)
    smallest = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1).select("rep", F.col("id").alias("head"))
    best = near.join(heads, F.col("other") == F.col("rep"), "left").select("id", F.coalesce("head", "other").alias("other"), "cosine")
    if at_least(threshold) <= 1:
        best = best.unionByName(heads.select(F.col("rep").alias("id"), F.col("head").alias("other"), F.lit(1.0).alias("cosine")))
    best = _first(best, k + 1).withColumnRenamed("id", "of").drop("place")
    every = best.join(members, F.col("of") == F.col("rep"), "left").select(F.coalesce("id", "of").alias("id"), "other", "cosine")
    return _first(every.filter("id <> other"), k)
