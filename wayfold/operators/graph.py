"""Graph operators: cutoff shortest paths, augmentation, contraction, dead ends, relevant subgraphs."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import checkpointed, frees_shuffles, released

#: Edges up to which a network is sent to every task as arrays; a larger one is searched by joins, with the same results.
MOST_EDGES = 2_000_000
#: Searches relaxed together in a task.
TOGETHER = 256


@dataclass
class Arrays:
    """A network as flat arrays: nodes in ascending order, edges sorted by their start, `at` where each node's begin."""

    nodes: np.ndarray
    at: np.ndarray
    to: np.ndarray
    time: np.ndarray
    proj: np.ndarray | None = None

    @staticmethod
    def of(src, dst, time, proj=None, nodes=None) -> Arrays:
        nodes = np.unique(np.concatenate([src, dst])) if nodes is None else nodes
        i, j = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
        by = np.lexsort((j, i))
        at = np.searchsorted(i[by], np.arange(len(nodes) + 1))
        return Arrays(nodes, at, j[by], time[by], None if proj is None else proj[by])


def usable_edges(base: DataFrame, cutoff: float, extra: DataFrame | None = None):
    """`base` without edges longer than any search within `cutoff` can take, and `extra` likewise; but an extra edge that
    stands in for one of `base` stays, as it takes the place of that edge however long it is itself."""
    short = base.filter(F.col("time") <= cutoff)
    if extra is None:
        return short
    long = extra.filter(F.coalesce(F.col("time") > cutoff, F.lit(True))).join(short.select("src", "dst"), ["src", "dst"], "left_semi").select(*extra.columns)
    return short, extra.filter(F.col("time") <= cutoff).unionByName(long)


def small_edges(edges: DataFrame, *more: str) -> list[np.ndarray] | None:
    """The columns src, dst, time and `more` as arrays, if there are few enough edges to be sent to every task."""
    t = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("time").cast("double"), *[F.col(m).cast("long") for m in more]).limit(MOST_EDGES + 1).toArrow()
    return None if t.num_rows > MOST_EDGES else [t.column(i).to_numpy() for i in range(t.num_columns)]


def _least(keys: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with its least distance."""
    by = np.lexsort((dist, keys))
    keys, dist = keys[by], dist[by]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return keys[first], dist[first]


def relax(start: np.ndarray, n: int, expand, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, distance) of all keys search * n + node within `cutoff`: `start` holds the keys at distance 0, `expand` gives
    the keys and times one step on from keys and their positions. All searches advance together, a round an edge."""
    best, far = _least(start, np.zeros(len(start)))
    front, front_far = best, far
    while len(front):
        keys, steps, source = expand(front)
        dist = front_far[source] + steps
        ok = dist <= cutoff
        keys, dist = _least(keys[ok], dist[ok])
        at = np.searchsorted(best, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(best)
        known[inside] = best[at[inside]] == keys[inside]
        better = ~known
        better[known] = dist[known] < far[at[known]]
        far[at[known & better]] = dist[known & better]
        front, front_far = keys[better], dist[better]
        fresh = ~known
        if fresh.any():
            best, far = np.insert(best, at[fresh], keys[fresh]), np.insert(far, at[fresh], dist[fresh])
    return best, far


def _ranges(at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edge numbers out of each node, and which node of the list each comes from."""
    count = at[node + 1] - at[node]
    source = np.repeat(np.arange(len(node)), count)
    return np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + at[node][source], source


def _from_origins(net: Arrays, origins: np.ndarray, cutoff: float):
    """(position of origin, node, distance) for origins in any order; those outside the network reach themselves."""
    at = np.searchsorted(net.nodes, origins)
    known = np.zeros(len(origins), bool)
    known[at < len(net.nodes)] = net.nodes[at[at < len(net.nodes)]] == origins[at < len(net.nodes)]
    n = len(net.nodes)

    def expand(front):
        e, source = _ranges(net.at, front % n)
        return (front // n)[source] * n + net.to[e], net.time[e], source

    keys, far = relax(np.flatnonzero(known) * n + at[known], n, expand, cutoff) if n else (np.empty(0, np.int64), np.empty(0))
    alone = np.flatnonzero(~known)
    return np.concatenate([keys // n if n else keys, alone]), np.concatenate([net.nodes[keys % n] if n else keys, origins[alone]]), np.concatenate([far, np.zeros(len(alone))])


def reach(origins: DataFrame, edges: DataFrame | list, cutoff: float) -> DataFrame:
    """(orig, node, dist) of all nodes at a distance of at most `cutoff`, the origin at 0 included.

    Times must be positive; of parallel edges the fastest counts. Origins are worked off in parallel against the network
    in memory while it has MOST_EDGES edges within the cutoff or fewer, and by joins beyond. Null and repeated origins count once or not.
    Edges may be given as `small_edges` returned them.
    """
    if not isinstance(edges, list):
        edges = usable_edges(edges, cutoff)
    rows = edges if isinstance(edges, list) else small_edges(edges)
    if rows is None:
        return reach_by_joins(origins, edges, cutoff)
    shared = origins.sparkSession.sparkContext.broadcast(Arrays.of(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                some = b.column(0).slice(i, TOGETHER).to_numpy()
                which, node, far = _from_origins(net, some, cutoff)
                yield pa.RecordBatch.from_arrays([pa.array(some[which]), pa.array(node), pa.array(far)], names=["orig", "node", "dist"])

    return origins.select(F.col("orig").cast("long")).filter("orig is not null").distinct().mapInArrow(run, "orig long, node long, dist double")


#: Networks beside the first that one search takes, as bits of a number.
MOST_MARKS = 60


def reach_apart(origins: DataFrame, edges: DataFrame, cutoff: float, now_cutoff: float, under: list[int] | None = None) -> DataFrame:
    """(orig, node, dist) of the pairs at most `cutoff` apart on all edges (src, dst, time, mark), but not within `now_cutoff`
    on those whose mark has bit 0; an origin and itself are no pair. With `under`, bits of the mark, (bit, orig, node, dist)
    of these pairs as far as they are within `cutoff` on the edges that have the bit.

    An origin is searched in all networks by one task, so nothing is shuffled but the origins; beyond MOST_EDGES edges
    within the cutoff by pieces, groups of origins with the edges that ways from them can take."""
    edges = usable_edges(edges, cutoff)
    rows = small_edges(edges, "mark")
    if rows is None:
        return _apart_by_pieces(origins, edges, cutoff, now_cutoff, under)
    shared = origins.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _apart((b.column(0).to_numpy() for b in batches), shared.value, cutoff, now_cutoff, under)

    return origins.select(F.col("orig").cast("long")).filter("orig is not null").distinct().mapInArrow(run, _apart_schema(under))


def _apart_schema(under: list[int] | None) -> str:
    return ("" if under is None else "bit int, ") + "orig long, node long, dist double"


def _apart(origins: Iterator[np.ndarray], rows: list[np.ndarray], cutoff: float, now_cutoff: float, under: list[int] | None) -> Iterator[pa.RecordBatch]:
    """The rows of `reach_apart` for some origins on the edges given as arrays src, dst, time, mark."""
    src, dst, time, mark = rows
    nodes = np.unique(np.concatenate([src, dst]))
    n, nets = len(nodes), {}
    for bit in [None, 0, *(under or [])]:
        has = slice(None) if bit is None else (mark >> bit) & 1 == 1
        nets[bit] = Arrays.of(src[has], dst[has], time[has], nodes=nodes)

    def found(bit, some, most):
        which, node, far = _from_origins(nets[bit], some, most)
        return which * n + np.searchsorted(nodes, node), which, node, far

    for all_ in origins:
        for i in range(0, len(all_), TOGETHER):
            some = all_[i : i + TOGETHER]
            some = some[_among(some, nodes)]
            keys, which, node, far = found(None, some, cutoff)
            pair = ~_among(keys, found(0, some, now_cutoff)[0]) & (node != some[which])
            if under is None:
                yield pa.RecordBatch.from_arrays([pa.array(some[which[pair]]), pa.array(node[pair]), pa.array(far[pair])], names=["orig", "node", "dist"])
                continue
            for bit in under:
                mine, which, node, far = found(bit, some, cutoff)
                hit = _among(mine, keys[pair])
                cols = [pa.array(np.full(hit.sum(), bit, np.int32)), pa.array(some[which[hit]]), pa.array(node[hit]), pa.array(far[hit])]
                yield pa.RecordBatch.from_arrays(cols, names=["bit", "orig", "node", "dist"])


#: Edges of the network for each piece it is searched in; a piece also holds those edges of others that its origins reach.
EDGES_A_PIECE = 50_000
#: Numbers in a row that fall to the same piece, as nodes numbered one after another are often near.
RUN_OF_NODES = 256


def _apart_by_pieces(origins: DataFrame, edges: DataFrame, cutoff: float, now_cutoff: float, under: list[int] | None) -> DataFrame:
    """`reach_apart` for networks of any size: the nodes within the cutoff of any origin of a piece are found by joins, once for all
    networks, and their edges sent to the piece, whose origins are searched on them. Pieces of more than MOST_EDGES edges go by joins."""
    edges = checkpointed(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("time").cast("double"), F.col("mark").cast("long")))
    pieces = -(-edges.count() // EDGES_A_PIECE)
    piece = F.pmod(F.xxhash64(F.floor(F.col("orig") / RUN_OF_NODES)), F.lit(pieces)).cast("int")
    linked = origins.select(F.col("orig").cast("long")).join(edges.select(F.col("src").alias("orig")), "orig", "left_semi")  # others reach nothing
    starts = checkpointed(linked.distinct().select(piece.alias("piece"), "orig"))

    def step(frontier: DataFrame) -> DataFrame:
        on = frontier.join(edges, frontier.node == edges.src).select("piece", F.col("dst").alias("node"), (F.col("dist") + F.col("time")).alias("dist"))
        return on.filter(F.col("dist") <= cutoff)

    near = _rounds(starts.select("piece", F.col("orig").alias("node"), F.lit(0.0).alias("dist")), step, ["piece", "node"], "dist")
    own = checkpointed(near.join(edges, near.node == edges.src).filter(F.col("dist") + F.col("time") <= cutoff).select("piece", "src", "dst", "time", "mark"))
    released(near)
    large = [r[0] for r in own.groupBy("piece").count().filter(F.col("count") > MOST_EDGES).select("piece").collect()]
    light = lambda df: df.filter(~F.col("piece").isin(large)) if large else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        edge, start = t.column("dst").is_valid(), t.column("dst").is_null()
        rows = [t.column(c).filter(edge).to_numpy() for c in ("src", "dst", "time", "mark")]
        return _apart(iter([t.column("src").filter(start).to_numpy()]), rows, cutoff, now_cutoff, under)

    both = light(own).unionByName(light(starts).select("piece", F.col("orig").alias("src")), allowMissingColumns=True)
    out = both.groupBy("piece").applyInArrow(run, _apart_schema(under))
    if not large:
        return out
    return out.unionByName(_apart_by_joins(starts.filter(F.col("piece").isin(large)).select("orig"), edges, cutoff, now_cutoff, under))


def _apart_by_joins(origins: DataFrame, edges: DataFrame, cutoff: float, now_cutoff: float, under: list[int] | None) -> DataFrame:
    marked = lambda bit: edges.filter(F.col("mark").bitwiseAND(F.lit(1 << bit)) != 0)
    far = reach_by_joins(origins, edges, cutoff).filter("orig != node")
    pairs = far.join(reach_by_joins(origins, marked(0), now_cutoff).select("orig", "node"), ["orig", "node"], "left_anti")
    if under is None:
        return pairs
    out = pairs.select(F.lit(0).alias("bit"), "orig", "node", "dist").limit(0)
    for bit in under:
        out = out.unionByName(reach_by_joins(origins, marked(bit), cutoff).select(F.lit(bit).alias("bit"), "orig", "node", "dist"))
    return out.join(pairs.select("orig", "node"), ["orig", "node"], "left_semi").select("bit", "orig", "node", "dist")


def reach_by_joins(origins: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """The same by relaxation of a frontier: each round one join on the node and one minimum per (origin, node)."""
    e = checkpointed(edges.groupBy("src", "dst").agg(F.min("time").cast("double").alias("time")))
    start = origins.select(F.col("orig").cast("long")).filter("orig is not null").distinct().select("orig", F.col("orig").alias("node"), F.lit(0.0).alias("dist"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(e, frontier.node == e.src).select("orig", F.col("dst").alias("node"), (F.col("dist") + F.col("time")).alias("dist")).filter(F.col("dist") <= cutoff)

    return _rounds(start, step, ["orig", "node"], "dist")


#: Rows that a round of a search sends to every task instead of shuffling what they are joined to; counted first.
FEW = 100_000
#: Tables that the rows found so far may lie in before they are made one.
MOST_PARTS = 8


@frees_shuffles
def _rounds(start: DataFrame, step, keys: list[str], value: str) -> DataFrame:
    """Rounds of a search: what `step` makes of the rows that improved last, until none does; the least `value` of each key.
    The rows of a round are kept as they are and looked up there, not written again with each round."""
    least = lambda df: df.groupBy(*keys).agg(F.min(value).alias(value))
    frontier, parts = checkpointed(start), []
    while rows := frontier.count():
        parts.append(frontier)
        new = checkpointed(least(step(F.broadcast(frontier) if rows <= FEW else frontier)))
        if len(parts) == MOST_PARTS:
            parts = _merged(parts, least)
        found = functools.reduce(DataFrame.unionByName, parts)
        if new.count() <= FEW:
            found = found.join(F.broadcast(new.select(*keys)), keys, "left_semi").select(*keys, value)
        both = new.withColumn("__new", F.lit(True)).unionByName(found.withColumn("__new", F.lit(False)))
        either = both.groupBy(*keys).agg(F.min(F.when(F.col("__new"), F.col(value))).alias(value), F.min(F.when(~F.col("__new"), F.col(value))).alias("__old"))
        frontier = checkpointed(either.filter(F.col(value).isNotNull() & (F.col("__old").isNull() | (F.col(value) < F.col("__old")))).select(*keys, value))
        released(new)
    return _merged(parts, least)[0] if parts else frontier


def _merged(parts: list[DataFrame], least) -> list[DataFrame]:
    one = checkpointed(least(functools.reduce(DataFrame.unionByName, parts)))
    released(*parts)
    return [one]


def _paths(adjacency: dict[int, dict[int, float]], origin: int, cutoff: float) -> dict[int, tuple[float, tuple[int, ...]]]:
    done: dict[int, tuple[float, tuple[int, ...]]] = {}
    heap = [(0.0, (origin,))]
    while heap:
        d, path = heapq.heappop(heap)
        node = path[-1]
        if node in done:
            continue
        done[node] = (d, path)
        for to, cost in adjacency.get(node, {}).items():
            if d + cost <= cutoff and to not in done:
                heapq.heappush(heap, (d + cost, (*path, to)))
    return done


def _adjacency(rows) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for src, dst, cost in zip(*(r.tolist() for r in rows)):
        to = out.setdefault(src, {})
        to[dst] = min(cost, to.get(dst, cost))
    return out


def shortest_paths(origins: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """(orig, node, dist, path): as `reach`, with the nodes of the path; of equally short ones the least in order of
    nodes. Networks above MOST_EDGES are searched by joins."""
    rows = small_edges(edges)
    if rows is None:
        return shortest_paths_by_joins(origins, edges, cutoff)
    shared = edges.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adjacency = _adjacency(shared.value)
        for b in batches:
            out = [(o, n, d, list(p)) for o in b.column(0).to_pylist() for n, (d, p) in _paths(adjacency, o, cutoff).items()]
            cols = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())))], names=["orig", "node", "dist", "path"])

    return origins.select(F.col("orig").cast("long")).filter("orig is not null").distinct().mapInArrow(run, "orig long, node long, dist double, path array<long>")


def shortest_paths_by_joins(origins: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """The same by rounds of joins: the least (distance, path) of each origin and node."""
    e = checkpointed(edges.groupBy("src", "dst").agg(F.min("time").cast("double").alias("time")))
    way = F.struct(F.lit(0.0).alias("dist"), F.array("orig").alias("path"))
    start = origins.select(F.col("orig").cast("long")).filter("orig is not null").distinct().select("orig", F.col("orig").alias("node"), way.alias("way"))

    def step(frontier: DataFrame) -> DataFrame:
        on = frontier.join(e, frontier.node == e.src).filter(F.col("way.dist") + F.col("time") <= cutoff)
        longer = F.struct((F.col("way.dist") + F.col("time")).alias("dist"), F.concat("way.path", F.array(F.col("dst").cast("long"))).alias("path"))
        return on.select("orig", F.col("dst").cast("long").alias("node"), longer.alias("way"))

    return _rounds(start, step, ["orig", "node"], "way").select("orig", "node", "way.dist", "way.path")


def opened_edges(base: list[np.ndarray], extra: list[np.ndarray], opened: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Base and project edges once the opened projects are part of the base network."""
    now = np.isin(extra[3], opened)
    ends = {*zip(extra[0][now].tolist(), extra[1][now].tolist())}
    kept = np.array([e not in ends for e in zip(base[0].tolist(), base[1].tolist())], bool)
    return [np.concatenate([b[kept], e[now]]) for b, e in zip(base, extra)], [e[~now] for e in extra]


def _among(keys: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which keys are among `those`, which ascend."""
    at = np.searchsorted(those, keys)
    hit = np.zeros(len(keys), bool)
    hit[at < len(those)] = those[at[at < len(those)]] == keys[at < len(those)]
    return hit


class Overlay:
    """A base network under designs: an open project's edges are there, and replace base edges between the same nodes."""

    def __init__(self, base: list[np.ndarray], extra: list[np.ndarray]):
        nodes = np.unique(np.concatenate([base[0], base[1], extra[0], extra[1]]))
        self.base = Arrays.of(*base, nodes=nodes)
        self.extra = Arrays.of(*extra, nodes=nodes)
        self.projects = np.unique(extra[3])
        n = len(nodes)
        ends = lambda a: np.repeat(np.arange(n), np.diff(a.at)) * n + a.to
        over = ends(self.extra)
        self.pairs, self.pair_of = np.unique(over, return_inverse=True)
        mine = ends(self.base)
        at = np.searchsorted(self.pairs, mine)
        hit = np.zeros(len(mine), bool)
        hit[at < len(self.pairs)] = self.pairs[at[at < len(self.pairs)]] == mine[at < len(self.pairs)]
        self.replaced = np.where(hit, at, -1)  # the pair of ends of each base edge that a project may replace
        self.proj = np.searchsorted(self.projects, self.extra.proj)
        self.edges_by = np.argsort(self.proj, kind="stable")  # the extra edges by project, and where each project's begin
        self.edges_at = np.searchsorted(self.proj[self.edges_by], np.arange(len(self.projects) + 1))

    def search(self, origins: np.ndarray, run: np.ndarray, project: np.ndarray, cutoff: float):
        """(position of run, node, distance); run run[i] has project number project[i] of `projects` open. The work goes with
        the open projects and the nodes reached, whatever the number of projects of the network."""
        n, p, pairs = len(self.base.nodes), max(1, len(self.projects)), max(1, len(self.pairs))
        opened = np.unique(run * p + project)
        e, who = _ranges(self.edges_at, opened % p)
        gone = np.unique((opened // p)[who] * pairs + self.pair_of[self.edges_by[e]])
        at = np.searchsorted(self.base.nodes, origins)
        known = np.zeros(len(origins), bool)
        known[at < n] = self.base.nodes[at[at < n]] == origins[at < n]

        def expand(front):
            run, node = front // n, front % n
            e, source = _ranges(self.base.at, node)
            there = ~((self.replaced[e] >= 0) & _among(run[source] * pairs + self.replaced[e], gone))
            x, xs = _ranges(self.extra.at, node)
            now = _among(run[xs] * p + self.proj[x], opened)
            e, source, x, xs = e[there], source[there], x[now], xs[now]
            keys = np.concatenate([run[source] * n + self.base.to[e], run[xs] * n + self.extra.to[x]])
            return keys, np.concatenate([self.base.time[e], self.extra.time[x]]), np.concatenate([source, xs])

        keys, far = relax(np.flatnonzero(known) * n + at[known], n, expand, cutoff)
        alone = np.flatnonzero(~known)
        return np.concatenate([keys // n, alone]), np.concatenate([self.base.nodes[keys % n], origins[alone]]), np.concatenate([far, np.zeros(len(alone))])


def reach_of_designs(runs: DataFrame, base: DataFrame | list, project_edges: DataFrame | list, cutoff: float) -> DataFrame:
    """(scen, orig, node, dist) for runs of (scen, orig, open array of projects): the base network with the edges of the
    open projects put in, replacing edges between the same nodes; of several open projects with one edge the fastest counts.
    Each run is independent of the others. Edges may be given as `small_edges` returned them, for repeated use. Beyond MOST_EDGES the search goes by joins."""
    if not isinstance(base, list) and not isinstance(project_edges, list):
        base, project_edges = usable_edges(base, cutoff, project_edges)
    fixed = base if isinstance(base, list) else small_edges(base)
    extra = project_edges if isinstance(project_edges, list) else small_edges(project_edges, "proj")
    if fixed is None or extra is None:
        return reach_of_designs_by_joins(runs, base, project_edges, cutoff)
    shared = runs.sparkSession.sparkContext.broadcast((fixed, extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Overlay(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                scen, orig = part.column(0).to_numpy(), part.column(1).to_numpy()
                sets = part.column(2).fill_null(pa.scalar([], part.column(2).type)) if part.column(2).null_count else part.column(2)
                which, p = np.repeat(np.arange(len(scen)), pa.compute.list_value_length(sets).to_numpy()), pa.compute.list_flatten(sets).to_numpy(zero_copy_only=False)
                col = np.searchsorted(net.projects, p)
                ok = (col < len(net.projects)) & (net.projects[np.minimum(col, max(0, len(net.projects) - 1))] == p) if len(net.projects) else np.zeros(len(p), bool)
                r, node, far = net.search(orig, which[ok], col[ok], cutoff)
                yield pa.RecordBatch.from_arrays([pa.array(scen[r]), pa.array(orig[r]), pa.array(node), pa.array(far)], names=["scen", "orig", "node", "dist"])

    return runs.select(F.col("scen").cast("long"), F.col("orig").cast("long"), F.col("open").cast("array<long>")).mapInArrow(run, "scen long, orig long, node long, dist double")


def reach_of_designs_by_joins(runs: DataFrame, base: DataFrame, project_edges: DataFrame, cutoff: float) -> DataFrame:
    """The same for networks of any size: a round is a join with the base network less what the design replaces, and one
    with the design's own edges."""
    runs = checkpointed(runs.select(F.col("scen").cast("long"), F.col("orig").cast("long"), F.col("open").cast("array<long>")))
    fixed = checkpointed(base.groupBy("src", "dst").agg(F.min("time").cast("double").alias("time")))
    chosen = runs.select("scen", F.explode("open").alias("proj")).distinct().join(project_edges, "proj")
    own = checkpointed(chosen.groupBy("scen", "src", "dst").agg(F.min("time").cast("double").alias("time")))
    start = runs.select("scen", "orig", F.col("orig").alias("node"), F.lit(0.0).alias("dist")).distinct()

    def step(frontier: DataFrame) -> DataFrame:
        f = frontier.withColumnRenamed("node", "src")
        kept = f.join(fixed, "src").join(own.select("scen", "src", "dst"), ["scen", "src", "dst"], "left_anti")
        both = kept.select("scen", "orig", "dst", "dist", "time").unionByName(f.join(own, ["scen", "src"]).select("scen", "orig", "dst", "dist", "time"))
        return both.select("scen", "orig", F.col("dst").alias("node"), (F.col("dist") + F.col("time")).alias("dist")).filter(F.col("dist") <= cutoff)

    return _rounds(start, step, ["scen", "orig", "node"], "dist")


def augment(base: DataFrame, added: DataFrame) -> DataFrame:
    """(src, dst, time): added edges replace base edges between the same nodes; of several added ones the fastest stays."""
    new = added.groupBy("src", "dst").agg(F.min("time").alias("time"))
    return base.select("src", "dst", "time").join(new, ["src", "dst"], "left_anti").unionByName(new)


def touched_nodes(project_edges: DataFrame) -> DataFrame:
    """Distinct end nodes of edges."""
    return project_edges.select(F.col("src").alias("node")).unionByName(project_edges.select(F.col("dst").alias("node"))).distinct()


def signal_edges(edges: DataFrame, opened: DataFrame, unsignalised: DataFrame, new_signals: DataFrame, heads: DataFrame) -> DataFrame:
    """Out-edges that new signals and unsignalised ends of opened projects make passable, towards `heads` only."""
    at = touched_nodes(opened).join(unsignalised, "node", "left_semi").unionByName(new_signals.select("node")).distinct()
    e = edges.join(at.withColumnRenamed("node", "src"), "src", "left_semi")
    return e.join(heads.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "time")


def dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes with one neighbour at most, whatever the direction of edges; (node, neighbours)."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return ends.groupBy("node").agg(F.countDistinct("other").alias("neighbours")).filter("neighbours <= 1")


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def relevant_nodes(forward: DataFrame, backward: DataFrame, pairs: DataFrame, cutoff: float) -> DataFrame:
    """(orig, des, node): nodes on some way from orig to des of length `cutoff` at most. `forward` holds distances from
    origins, `backward` distances to destinations as (orig, node, dist) of the reversed network."""
    f = forward.select("orig", "node", F.col("dist").alias("ahead"))
    b = backward.select(F.col("orig").alias("des"), "node", F.col("dist").alias("behind"))
    return pairs.select("orig", "des").join(f, "orig").join(b, ["des", "node"]).filter(F.col("ahead") + F.col("behind") <= cutoff).select("orig", "des", "node")


def with_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(orig, des, node): the nodes of each pair and all their neighbours, whatever the direction of edges."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    return nodes.unionByName(nodes.join(ends, "node").select("orig", "des", F.col("other").alias("node"))).distinct()


def subgraphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(orig, des, src, dst, time): the edges between the nodes of each pair."""
    inside = nodes.withColumnRenamed("node", "src").join(edges.select("src", "dst", "time"), "src")
    return inside.join(nodes.withColumnRenamed("node", "dst"), ["orig", "des", "dst"], "left_semi").select("orig", "des", "src", "dst", "time")


def contract_chains(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(src, dst, length, lts): edges between stopping nodes, nodes passed in between merged; length adds up, lts is the
    greatest. `edges` has src, dst, length, lts; of parallel edges the shortest counts. A node that is no stop must have
    one onward neighbour at most besides the one come from, or an error is raised. A chain that ends without a stop gives
    no edge; one that runs into a loop without a stop raises.

    Pointer doubling: every edge that does not end at a stop is joined to the stretch that follows it, which doubles in
    each round, so a chain of n edges takes log2(n) rounds.
    """
    e = edges.groupBy("src", "dst").agg(F.min(F.struct("length", "lts")).alias("r")).select("src", "dst", F.col("src").alias("prev"), "r.length", "r.lts")
    stop = checkpointed(stops.select(F.col("node").alias("dst")).distinct())
    ended = F.broadcast(stop.withColumn("__stop", F.lit(True))) if stop.limit(1_000_001).count() <= 1_000_000 else stop.withColumn("__stop", F.lit(True))
    # a stretch: first edge (src, first), last edge (prev, dst), whether it ends at a stop
    stretch = e.join(ended, "dst", "left").select("src", F.col("dst").alias("first"), "prev", "dst", "length", "lts", F.coalesce("__stop", F.lit(False)).alias("done"))
    stretch = checkpointed(stretch)
    from_stop = stop.withColumnRenamed("dst", "src")
    rounds = max(1, stretch.count()).bit_length() + 1
    for n in range(rounds + 1):
        open_ = stretch.filter(~F.col("done"))
        if open_.isEmpty():
            break
        if n == rounds:
            if not open_.join(from_stop, "src", "left_semi").isEmpty():
                raise ValueError("a chain from a stop runs into a loop without one")
            break
        nxt = stretch.select(F.col("src").alias("dst"), F.col("first").alias("n_first"), F.col("prev").alias("n_prev"), F.col("dst").alias("n_dst"), F.col("length").alias("n_length"), F.col("lts").alias("n_lts"), F.col("done").alias("n_done"))
        on = open_.join(nxt, "dst").filter("n_first <> prev")  # not straight back; an open stretch without a sequel is dropped
        step = on.select("src", "first", F.col("n_prev").alias("prev"), F.col("n_dst").alias("dst"), (F.col("length") + F.col("n_length")).alias("length"), F.greatest("lts", "n_lts").alias("lts"), F.col("n_done").alias("done"))
        step = checkpointed(step)
        if n == 0 and not step.groupBy("src", "first").count().filter("count > 1").isEmpty():
            raise ValueError("a node that is no stop branches")
        stretch = checkpointed(stretch.filter("done").unionByName(step))
    return stretch.filter("done").join(from_stop, "src", "left_semi").select("src", "dst", "length", "lts")


def edge_lookup(steps: DataFrame, records: DataFrame) -> DataFrame:
    """Adds the record of each step's edge, looked up in either direction; a step without one raises when read."""
    same = records.select(F.col("src"), F.col("dst"), F.col("rec").alias("__same"))
    back = records.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rec").alias("__back"))
    found = steps.join(same, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    missing = F.raise_error(F.concat(F.lit("no record of edge "), F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string"))).cast("long")
    return found.withColumn("rec", F.coalesce("__same", "__back", missing)).drop("__same", "__back")
