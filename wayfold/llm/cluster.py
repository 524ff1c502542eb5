"""Clusters of mutually similar vectors by parallel pivot correlation clustering.

A round: rows are dealt to coarse cells; in each cell (a large one is cut into slabs) the rows are taken in the order of a
hash, and a row that no earlier pivot absorbed becomes a pivot and absorbs all similar rows. Of these pivots, those that
are local minima of the hash among the pivots similar to them stay, found by a blocked join of pivots only. Rows of the
others go to a similar pivot that stayed, or wait for the next round. Rounds end when no row is left. A pivot and its
members are linked, so clusters of any size, a third of all rows too, are never compared pair by pair. Members meet the
pivots near their own in buckets of pivots; a pivot of very many members has its members dealt to several buckets, to each
of which its near pivots go.

At the end members go to the closest of all pivots. Two members similar to pivots p and q at angles of at most t lie on
pivots at most 2t apart, so the pivots near a member's pivot are all that can be closer: the reassignment is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import topn
from wayfold.llm.vectors import at_least, cell_counts, coarse_pivots, lists, matrix, packed_rows, place_in_cells, slabs, unpacked, with_slab
from wayfold.operators.components import components
from wayfold.session import checkpointed, cores, frees_shuffles, released

#: Rows of a cell that one task takes.
SLAB_ROWS = 40_000
#: Pivots of a block of the blocked join, about; two blocks make a task. Rows of either that are compared at once, so that they stay in cache.
BLOCK_ROWS, TILE_ROWS = 32_768, 512
#: Members of either side nearest to the other pivot that are compared first.
NEAREST_FIRST = 32
#: Members of one pivot that go to one bucket, and rows a bucket is meant to have.
PART_ROWS, BUCKET_ROWS = 100_000, 200_000
#: Rows of identifiers that may be broadcast; the count is taken first, beyond it the join is by shuffle.
MOST_BROADCAST = 1_000_000


def greedy_pivots(v: np.ndarray, least: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the given order: each row's pivot (an index) and its cosine to it."""
    owner, cosine = np.full(len(v), -1), np.ones(len(v))
    left = np.arange(len(v))
    while len(left):
        head = left[:batch]
        alike = v[head] @ v[head].T >= least
        covered, chosen = np.zeros(len(head), bool), []
        for i in range(len(head)):
            if not covered[i]:
                chosen.append(i)
                covered |= alike[i]
        pivots = head[chosen]
        keep = []
        for i in range(0, len(left), 8192):
            part = left[i : i + 8192]
            s = v[part] @ v[pivots].T
            best = s.argmax(1)
            top = s[np.arange(len(part)), best]
            hit = top >= least
            owner[part[hit]], cosine[part[hit]] = pivots[best[hit]], top[hit]
            keep.append(part[~hit])
        owner[pivots], cosine[pivots] = pivots, 1.0  # also where rounding leaves a pivot below itself
        left = np.concatenate(keep)
        left = left[owner[left] < 0]
    return owner, cosine


def _local_pivots(least: float):
    def run(key, t):
        ids, h = t.column("id").to_numpy(), t.column("h").to_numpy()
        order = np.lexsort((ids, h))
        t = t.take(pa.array(order))
        owner, cosine = greedy_pivots(unpacked(t.column("vec")), least)
        return pa.table({"id": ids[order], "vec": t.column("vec"), "cell": t.column("cell"), "pivot": ids[order][owner], "cosine": cosine})

    return run


ASSIGNED = "id long, vec binary, cell int, pivot long, cosine double"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as one, widest radius first."""
    t = [b for b in batches if b.num_rows]
    if t:
        t = pa.Table.from_batches(t).sort_by([("radius", "descending"), ("id", "ascending")]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as to:
            to.write_table(t)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])


def _tile_pairs(one: pa.Table, two: pa.Table, same: bool, bound) -> pa.RecordBatch:
    ia, ra, va = one.column("id").to_numpy(), one.column("radius").to_numpy(), unpacked(one.column("vec"))
    ib, rb, vb = (ia, ra, va) if same else (two.column("id").to_numpy(), two.column("radius").to_numpy(), unpacked(two.column("vec")))
    sa, sb = va.astype(np.float32), vb.astype(np.float32)  # find the pairs, with room for their error; cosines are taken in double
    room = 2 * (va.shape[1] + 2) * 2.0**-24
    out = []
    for x in range(0, len(ia), TILE_ROWS):
        for y in range(x if same else 0, len(ib), TILE_ROWS):
            loosest = float(bound(ra[x], rb[y]))  # radii descend
            if loosest > 1:
                continue
            hit = np.flatnonzero(sa[x : x + TILE_ROWS] @ sb[y : y + TILE_ROWS].T >= np.float32(loosest - room))
            if not len(hit):
                continue
            p, q = np.divmod(hit, len(sb[y : y + TILE_ROWS]))
            p, q = p + x, q + y
            c = np.einsum("ij,ij->i", va[p], vb[q])
            keep = c >= bound(ra[p], rb[q])
            if same:
                keep &= p < q
            out.append((ia[p[keep]], ib[q[keep]], c[keep]))
    a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["a", "b", "cosine"])


def _block_pairs(bound):
    """All pairs of rows of two blocks whose cosine reaches bound(radius of one, radius of the other), which falls as radii grow; above 1, none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, one, two in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "one", "two"))):
                yield _tile_pairs(pa.ipc.open_stream(one).read_all(), pa.ipc.open_stream(two).read_all(), i == j, bound)

    return run


def similar_pivots(pivots: DataFrame, bound) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs of rows of (id, vec, radius) within the bound, compared block by block and kept.
    A block is one row of a checkpoint, which each of its tasks reads there: no copies of blocks are written."""
    n = pivots.count()
    blocks = max(-(-n // BLOCK_ROWS), min(max(1, n // 1024), 2 * int(np.sqrt(cores(pivots.sparkSession)))))
    dealt = checkpointed(pivots.select("id", "vec", "radius").repartition(max(1, blocks), "id").mapInArrow(_block, "block int, rows binary"))
    one, two = dealt.select(F.col("block").alias("i"), F.col("rows").alias("one")), dealt.select(F.col("block").alias("j"), F.col("rows").alias("two"))
    once = F.when((F.col("i") + F.col("j")) % 2 == 0, F.col("i") <= F.col("j")).otherwise(F.col("i") > F.col("j"))  # either order, so that tasks are even
    met = one.join(two.hint("shuffle_replicate_nl"), once)
    out = checkpointed(met.select("i", "j", "one", "two").mapInArrow(_block_pairs(bound), "a long, b long, cosine double"))
    released(dealt)
    return out


def _sized(ids: DataFrame) -> DataFrame:
    """Broadcast if counted to be small."""
    return F.broadcast(ids) if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ids


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of the runs of sorted keys."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    yield from zip(keys[at].tolist(), at.tolist(), np.append(at[1:], len(keys)).tolist())


def meet_pivots(members: DataFrame, near: DataFrame, pivots: DataFrame, run, schema: str) -> DataFrame:
    """What `run` gives for each bucket of members (id, vec, cell, pivot, cosine) and the pivots (old, other, vec, radius) near their own
    ones. `near`: (old, pivot); `pivots`: (id, vec, radius). All near pivots of a member's pivot are in its bucket."""
    spark = members.sparkSession
    counted = checkpointed(members.groupBy("pivot").agg(F.count("*").alias("n")))
    n = counted.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * cores(spark), -(-n // BUCKET_ROWS))
    parts = counted.filter(F.col("n") > PART_ROWS).select(F.col("pivot").alias("p"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    parts = F.broadcast(checkpointed(parts))  # one row for each PART_ROWS rows at most
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce("parts", F.lit(1))).cast("int")
    left = members.join(parts, F.col("pivot") == F.col("p"), "left").withColumn("bucket", F.pmod(F.xxhash64("pivot", part), F.lit(buckets)).cast("int"))
    named = near.join(pivots.select(F.col("id").alias("pivot"), "vec", "radius"), "pivot").withColumnRenamed("pivot", "other")
    right = named.join(parts, F.col("old") == F.col("p"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    right = right.withColumn("bucket", F.pmod(F.xxhash64("old", "part"), F.lit(buckets)).cast("int"))
    left = left.select("bucket", "id", "vec", "cell", "pivot", "cosine")
    right = right.select(*[F.col(c).alias(a) for c, a in (("bucket", "to"), ("old", "old"), ("other", "other"), ("vec", "ovec"), ("radius", "radius"))]).distinct()

    def both(key, m, o):
        m, o = m.sort_by([("pivot", "ascending"), ("id", "ascending")]), o.sort_by([("old", "ascending"), ("other", "ascending")])
        theirs = {k: (a, z) for k, a, z in _slices(o.column("old").to_numpy())}
        return run(m, o, theirs)

    return left.groupBy("bucket").cogroup(right.groupBy("to")).applyInArrow(both, schema)


def _choose(least: float, keep: bool):
    """Each member with the closest near pivot, of equal ones the smaller id, null if none is similar. With `keep` its own
    pivot is one to choose from and pivots stay their own."""

    def run(m, o, theirs):
        ids, pivot, cosine, v = m.column("id").to_numpy(), m.column("pivot").to_numpy().copy(), m.column("cosine").to_numpy().copy(), unpacked(m.column("vec"))
        other, ov = o.column("other").to_numpy(), unpacked(o.column("ovec"))
        good = np.full(len(ids), keep)
        for p, a, z in _slices(m.column("pivot").to_numpy()):
            if p not in theirs:
                continue
            x, y = theirs[p]
            for i in range(a, z, 8192):
                rows = np.arange(i, min(i + 8192, z))
                c = v[rows] @ ov[x:y].T
                at = c.argmax(1)  # others ascend, so of equal ones the smaller
                top, who = c[np.arange(len(rows)), at], other[x:y][at]
                if keep:
                    better = ((top > cosine[rows]) | (top == cosine[rows]) & (who < p)) & (ids[rows] != p)
                else:
                    better = top >= least
                pivot[rows[better]], cosine[rows[better]], good[rows[better]] = who[better], top[better], True
        return pa.table({"id": ids, "vec": m.column("vec"), "cell": m.column("cell"), "pivot": pa.array(pivot, mask=~good), "cosine": np.where(good, cosine, -2.0)})

    return run


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("old"), F.col("b").alias("pivot")).unionByName(pairs.select(F.col("b").alias("old"), F.col("a").alias("pivot")))


@frees_shuffles
def pivot_clusters(df: DataFrame, key: str, vec: str, threshold: float, seed: int = 0) -> DataFrame:
    """(id, vec, cell, pivot, cosine): every row with a pivot whose cosine, rounded to six decimals, is `threshold` or
    more. `df` has one row per key; vectors must be of one length, usable ones only. An empty table gives none."""
    spark = df.sparkSession
    least = at_least(threshold)
    wide = float(np.cos(min(np.pi, 2 * np.arccos(least)))) - 1e-9
    rows = checkpointed(packed_rows(df, key, vec))
    centres, n = coarse_pivots(rows, "id", "vec")
    if not n or not len(centres):
        return spark.createDataFrame([], ASSIGNED)
    left = placed = checkpointed(place_in_cells(rows, centres))
    released(rows)
    done, over = [], []
    while counts := cell_counts(left):
        dealt = with_slab(left, slabs(counts, SLAB_ROWS)).withColumn("h", F.xxhash64("id", F.lit(seed)))
        local = checkpointed(dealt.select("cell", "slab", "id", "h", "vec").groupBy("cell", "slab").applyInArrow(_local_pivots(least), ASSIGNED))
        if not done:
            released(placed)
        pivots = local.filter("id = pivot").select("id", "vec", F.lit(0.0).alias("radius"))
        near = similar_pivots(pivots, lambda a, b: np.zeros(np.shape(a)) + wide)
        lose = F.when(F.struct(F.xxhash64("a", F.lit(seed)), "a") < F.struct(F.xxhash64("b", F.lit(seed)), "b"), F.col("b")).otherwise(F.col("a"))
        lost = checkpointed(near.filter(F.col("cosine") >= least).select(lose.alias("pivot")).distinct())
        gone = _sized(lost)
        done.append(local.join(gone, "pivot", "left_anti"))
        moved = local.join(gone, "pivot", "left_semi")
        stayed = pivots.join(_sized(lost.withColumnRenamed("pivot", "id")), "id", "left_anti")
        to = _both_ways(near).join(_sized(lost.withColumnRenamed("pivot", "old")), "old", "left_semi")
        chosen = checkpointed(meet_pivots(moved, to, stayed, _choose(least, False), ASSIGNED))
        done.append(chosen.filter("pivot is not null"))
        left = chosen.filter("pivot is null").select("id", "vec", "cell")
        over += [local, near, lost, chosen]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = checkpointed(out)
    released(*over)
    return out


@frees_shuffles
def closest_pivots(clusters: DataFrame, threshold: float) -> DataFrame:
    """The clusters with each member moved to the closest of all pivots; pivots stay their own."""
    least = at_least(threshold)
    wide = float(np.cos(min(np.pi, 2 * np.arccos(least)))) - 1e-9
    pivots = clusters.filter("id = pivot").select("id", "vec", F.lit(0.0).alias("radius"))
    near = similar_pivots(pivots, lambda a, b: np.zeros(np.shape(a)) + wide)
    return meet_pivots(clusters, _both_ways(near), pivots, _choose(least, True), ASSIGNED)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        p, v = b.column(0).to_numpy(), unpacked(b.column(1))
        who, inv = np.unique(p, return_inverse=True)
        s = np.zeros((len(who), v.shape[1]))
        np.add.at(s, inv, v)
        yield pa.RecordBatch.from_arrays([pa.array(who), lists(s), pa.array(np.bincount(inv, minlength=len(who)), pa.int64())], names=["pivot", "total", "n"])


def _add_sums(key, t):
    return pa.table({"pivot": [key[0].as_py()], "total": lists(matrix(t.column("total")).sum(0, keepdims=True)), "n": [int(t.column("n").to_numpy().sum())]})


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            score = np.einsum("ij,ij->i", unpacked(b.column(3)), matrix(b.column(4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(score)], names=["pivot", "id", "n", "score"])


@frees_shuffles
def typical_members(clusters: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, members, medoid, typical): per cluster its size and its `most` most typical members.

    A member is the more typical the greater the sum of its cosines to all members, which is its product with the sum of
    their unit vectors; the most typical one is the medoid, ties to the smaller id. A cluster is named by its pivot.
    """
    sums = clusters.select("pivot", "vec").mapInArrow(_partial_sums, "pivot long, total array<double>, n long")
    sums = sums.groupBy("pivot").applyInArrow(_add_sums, "pivot long, total array<double>, n long")
    scored = clusters.join(sums, "pivot").select("pivot", "id", "n", "vec", "total").mapInArrow(_scores, "pivot long, id long, n long, score double")
    scored = checkpointed(scored.withColumn("score", F.round("score", 9)))
    best = topn.top_n_per_group(scored, ["pivot"], "score", ["id"], most)
    listed = best.groupBy("pivot", "n").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
    return listed.select(F.col("pivot").alias("cluster"), F.col("n").alias("members"), F.col("t")[0]["id"].alias("medoid"), F.col("t.id").alias("typical"))


BORDER = "a long, b long, first boolean, id long, vec binary"


def _border(theta: float, most: int | None):
    """Members that lie near enough to a neighbouring cluster to have a link into it; with `most` only the nearest of each bucket."""

    def run(m, o, theirs):
        ids, pivot, v = m.column("id").to_numpy(), m.column("pivot").to_numpy(), unpacked(m.column("vec"))
        other, ov, radius = o.column("other").to_numpy(), unpacked(o.column("ovec")), o.column("radius").to_numpy()
        row, to = [np.empty(0, int)], [np.empty(0, np.int64)]
        for p, a, z in _slices(pivot):
            if p not in theirs:
                continue
            x, y = theirs[p]
            far = np.cos(np.minimum(np.pi, radius[x:y] + theta + 1e-7))
            best: list = [None] * (y - x)
            for i in range(a, z, 8192):
                c = v[i : min(i + 8192, z)] @ ov[x:y].T
                if most is None:
                    r, k = np.nonzero(c >= far)
                    row.append(i + r)
                    to.append(other[x:y][k])
                    continue
                for k in np.flatnonzero((c >= far).any(0)):
                    r = np.flatnonzero(c[:, k] >= far[k])
                    new = np.stack([-c[r, k], ids[i + r], i + r], 1)
                    both = new if best[k] is None else np.concatenate([best[k], new])
                    best[k] = both[np.lexsort((both[:, 1], both[:, 0]))[:most]]
            for k, b in enumerate(best):
                if b is not None:
                    row.append(b[:, 2].astype(int))
                    to.append(np.full(len(b), other[x + k]))
        row, to = np.concatenate(row), np.concatenate(to)
        mine = pivot[row]
        return pa.table({"a": np.minimum(mine, to), "b": np.maximum(mine, to), "first": mine < to, "id": ids[row], "vec": m.column("vec").take(pa.array(row))})

    return run


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    return any((x[i : i + 1024] @ y[j : j + 8192].T >= least).any() for i in range(0, len(x), 1024) for j in range(0, len(y), 8192)) if len(x) and len(y) else False


def _any_link(least: float):
    """The pairs of clusters (a, b) of a group that have a link among the rows at hand; `part` keeps apart rows that are not to meet."""

    def run(key, t):
        t = t.sort_by([("a", "ascending"), ("b", "ascending")])
        a, b, first, v = t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("first").to_numpy(), unpacked(t.column("vec"))
        out = []
        for p, x, z in _slices(a):
            for q, y, w in _slices(b[x:z]):
                rows = slice(x + y, x + w)
                if _linked(v[rows][first[rows]], v[rows][~first[rows]], least):
                    out.append((p, q))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


@frees_shuffles
def linked_groups(clusters: DataFrame, threshold: float, least_members: int = 3) -> DataFrame:
    """(first_id, id): the connected components of the graph of all links, of `least_members` rows or more.

    Clusters are connected through their pivots; what is left to find is which clusters have a link between them. Only
    those can whose pivots' angle is at most both radii plus the angle of a link. Of these, the members near the other
    cluster are compared: first the nearest few of each side, then, for pairs of clusters not yet in one component, all
    of them, in slabs. No link between clusters that could join two components is left out.
    """
    least = at_least(threshold)
    theta = float(np.arccos(least))
    stats = clusters.groupBy("pivot").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    heads = clusters.filter("id = pivot").select("id", "vec").join(stats.withColumnRenamed("pivot", "id"), "id")
    # only a pivot without members has no radius; two of these are not linked, as pivots are apart
    wide = F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.lit(1e-7), F.acos(F.least(F.lit(1.0), F.col("least")))))
    heads = checkpointed(heads.select("id", "vec", wide.alias("radius")))
    near = similar_pivots(heads, lambda a, b: np.where(np.maximum(a, b) > 0, np.cos(np.minimum(np.pi, np.asarray(a) + np.asarray(b) + theta)) - 1e-9, 2.0)).select("a", "b")

    def border(pairs: DataFrame, most: int | None) -> DataFrame:
        ends = pairs.select(F.col("a").alias("pivot")).union(pairs.select(F.col("b").alias("pivot"))).distinct()
        return meet_pivots(clusters.join(_sized(ends), "pivot", "left_semi"), _both_ways(pairs), heads, _border(theta, most), BORDER)

    some = border(near, NEAREST_FIRST)
    deal = F.pmod(F.xxhash64("a", "b"), F.lit(4 * cores(clusters.sparkSession)))
    links = checkpointed(some.withColumn("bucket", deal).groupBy("bucket").applyInArrow(_any_link(least), "a long, b long"))
    roots = checkpointed(components(links, "a", "b"))

    def rooted(pairs: DataFrame, col: str) -> DataFrame:
        r = roots.select(F.col("node").alias(col), F.col("root").alias(f"{col}_root"))
        return pairs.join(r, col, "left").withColumn(f"{col}_root", F.coalesce(f"{col}_root", col))

    open_ = checkpointed(rooted(rooted(near, "a"), "b").filter("a_root != b_root").select("a", "b"))
    rest = checkpointed(border(open_, None))
    sizes = rest.groupBy("a", "b").agg(F.count_if("first").alias("x"), F.count_if(~F.col("first")).alias("y")).filter("x > 0 and y > 0")
    sizes = sizes.select("a", "b", F.ceil(F.col("x") / SLAB_ROWS).cast("int").alias("xs"), F.ceil(F.col("y") / SLAB_ROWS).cast("int").alias("ys"))
    rest = rest.join(sizes, ["a", "b"])
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("first"), F.col("xs")).otherwise(F.col("ys"))).cast("int")
    rest = rest.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("ys")).otherwise(F.col("xs")) - 1)))
    rest = rest.select("a", "b", F.when(F.col("first"), F.col("own")).otherwise(F.col("k")).alias("i"), F.when(F.col("first"), F.col("k")).otherwise(F.col("own")).alias("j"), "first", "vec")
    more = checkpointed(rest.groupBy("a", "b", "i", "j").applyInArrow(_any_link(least), "a long, b long").distinct())
    if more.limit(1).count():
        roots = checkpointed(components(links.unionByName(more), "a", "b"))
    named = clusters.select("id", "pivot").join(_sized(roots.select(F.col("node").alias("pivot"), "root")), "pivot", "left").select("id", F.coalesce("root", "pivot").alias("root"))
    named = checkpointed(named)
    groups = checkpointed(named.groupBy("root").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter(F.col("n") >= least_members))
    return named.join(_sized(groups.select("root", "first_id")), "root").select("first_id", "id")
