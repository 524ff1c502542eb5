"""Points near other points, and the outlines that contain them.

Places are divided among pivots (a Voronoi partition; the pivots are a bounded sample of the places, so cells follow the
density). A place within radius r of another lies at most 2r farther from the other's pivot than from its own (triangle
inequality), so it is copied to just those cells, and only to cells of lower number: each pair meets in exactly one
cell. In a cell a vantage-point tree finds the pairs by exact distance. An outline goes to every cell that can hold a
point inside its circumscribed circle, and the points in the circle are tested exactly. A cell of too many rows is cut
into slabs that meet two by two, so no task holds more than two slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.vptree import Pivots, VPTree
from wayfold.operators.rows import rows_in_use
from wayfold.session import checkpointed, finite, table

#: Rows a cell is meant to have, and pivots at most (16 bytes each in every task).
CELL_ROWS, MOST_PIVOTS = 3_000, 16_384
#: Rows of a cell, home and copied, that one task takes as they are; more are cut into slabs of about that size.
SLAB_ROWS = 40_000
PAIRS = "left_id long, right_id long"


def _floats(b, i: int) -> np.ndarray:
    return b.column(i).to_numpy(zero_copy_only=False).astype(float)


def choose_pivots(points: DataFrame, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Every so many places by hash of their id, at most MOST_PIVOTS; and the number of places."""
    n = points.count()
    want = int(min(MOST_PIVOTS, max(1, n // cell_rows)))
    rows = points.orderBy(F.xxhash64("id"), "id").limit(want).select("x", "y").collect()
    return np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float), n


def assign_cells(points: DataFrame, px: np.ndarray, py: np.ndarray, radius: float, metric: str) -> DataFrame:
    """(cell, home, d, id, x, y): each place in its own cell, copies in the cells that may hold a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots(px, py, metric)
        for b in batches:
            x, y = _floats(b, 1), _floats(b, 2)
            home, _, q, p, d = pivots.within_nearest(x, y, 2 * radius)
            keep = p <= home[q]
            q, p, d = q[keep], p[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(p == home[q]), pa.array(d), b.column(0).take(pa.array(q)), pa.array(x[q]), pa.array(y[q])], names=["cell", "home", "d", "id", "x", "y"])

    return points.select("id", "x", "y").mapInArrow(run, "cell int, home boolean, d double, id long, x double, y double")


def cell_sizes(assigned: DataFrame) -> dict[int, tuple[int, int, float]]:
    """Rows, home rows and radius of each cell: at most MOST_PIVOTS rows."""
    rows = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h"), F.max(F.when(F.col("home"), F.col("d"))).alias("r")).collect()
    return {r["cell"]: (r["n"], r["h"], r["r"] if r["r"] is not None else -1.0) for r in rows}


def _slab_table(spark, parts: dict[int, int]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c, s) for c, s in parts.items() if s > 1], "cell int, slabs int"))


def _near_in_cell(radius: float, metric: str):
    def run(key, t):
        _, i, j = (k.as_py() for k in key)
        ids, x, y = (t.column(c).to_numpy() for c in ("id", "x", "y"))
        home, slab = t.column("home").to_numpy(), t.column("slab").to_numpy()
        a, b = np.flatnonzero(slab == i), np.flatnonzero(slab == j)
        q, p = VPTree(x[a], y[a], metric).pairs_within(x[b], y[b], radius)
        q, p = b[q], a[p]
        keep = (home[q] | home[p]) & (ids[q] != ids[p])
        if i == j:
            keep &= q < p
        q, p = q[keep], p[keep]
        return pa.table({"left_id": np.minimum(ids[q], ids[p]), "right_id": np.maximum(ids[q], ids[p])})

    return run


def near_pairs(assigned: DataFrame, sizes: dict, radius: float, metric: str = "euclidean") -> DataFrame:
    """(left_id, right_id) of all places at most `radius` apart, the smaller id left, each pair once."""
    slabs = _slab_table(assigned.sparkSession, {c: -(-n // SLAB_ROWS) for c, (n, _, _) in sizes.items()})
    rows = assigned.join(slabs, "cell", "left").withColumn("slabs", F.coalesce("slabs", F.lit(1)))
    rows = rows.withColumn("slab", F.when(F.col("slabs") > 1, F.pmod(F.xxhash64("id"), F.col("slabs"))).otherwise(0).cast("int"))
    met = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    tasks = met.select("cell", F.least("slab", "k").alias("i"), F.greatest("slab", "k").alias("j"), "slab", "home", "id", "x", "y")
    return tasks.groupBy("cell", "i", "j").applyInArrow(_near_in_cell(radius, metric), PAIRS)


def strictly_inside(px: np.ndarray, py: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """Which points lie within the ring, not on it. Even-odd rule with signs of cross products."""
    x1, y1, x2, y2 = rx, ry, np.roll(rx, -1), np.roll(ry, -1)
    out = np.zeros(len(px), bool)
    step = 1 + 2_000_000 // max(1, len(rx))
    for s in range(0, len(px), step):
        x, y = px[s : s + step, None], py[s : s + step, None]
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = (cross == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
        crossed = ((y1 <= y) != (y2 <= y)) & ((cross > 0) == (y2 > y1))
        out[s : s + step] = (crossed.sum(1) % 2 == 1) & ~on.any(1)
    return out


def _rings(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    sizes = np.diff(col.offsets.to_numpy())
    x, y = (flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in ("x", "y"))
    return x, y, np.concatenate([[0], np.cumsum(sizes)])


def circles(outlines: DataFrame) -> DataFrame:
    """(poly_id, ring, cx, cy, rho): a circle about each outline. Outlines with an undefined corner are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, at = _rings(b.column(1))
            if not len(x):
                continue
            s = at[:-1]
            cx = (np.minimum.reduceat(x, s) + np.maximum.reduceat(x, s)) / 2
            cy = (np.minimum.reduceat(y, s) + np.maximum.reduceat(y, s)) / 2
            n = np.diff(at)
            rho = np.maximum.reduceat(np.sqrt((x - np.repeat(cx, n)) ** 2 + (y - np.repeat(cy, n)) ** 2), s)
            ok = pa.array(np.isfinite(rho) & np.isfinite(cx) & np.isfinite(cy))
            cols = [b.column(0), b.column(1), pa.array(cx), pa.array(cy), pa.array(rho)]
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=["poly_id", "ring", "cx", "cy", "rho"])

    return outlines.select("poly_id", "ring").mapInArrow(run, "poly_id long, ring array<struct<x double, y double>>, cx double, cy double, rho double")


def _outline_cells(px, py, sizes: dict):
    reach = np.full(len(px), -1e300)
    for c, (_, h, r) in sizes.items():
        if h:
            reach[c] = r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots(px, py, "euclidean")
        for b in batches:
            cx, cy, rho = (_floats(b, i) for i in (2, 3, 4))
            _, _, q, p, _ = pivots.within_nearest(cx, cy, 2 * rho, limit=lambda q, p: rho[q] + reach[p])
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *[b.column(i).take(take) for i in range(5)]], names=["cell", "poly_id", "ring", "cx", "cy", "rho"])

    return run


def _inside_in_cell(key, points, outlines):
    empty = pa.table({"left_id": pa.array([], pa.int64()), "right_id": pa.array([], pa.int64())})
    if not points.num_rows or not outlines.num_rows:
        return empty
    ids, x, y = (points.column(c).to_numpy() for c in ("id", "x", "y"))
    cx, cy, rho = (outlines.column(c).to_numpy() for c in ("cx", "cy", "rho"))
    poly = outlines.column("poly_id").to_numpy()
    rx, ry, at = _rings(outlines.column("ring"))
    tree = VPTree(x, y, "euclidean")
    left, right = [], []
    for begin in range(0, len(poly), 64):  # bounds the candidates held at a time
        q, p = tree.pairs_within(cx[begin : begin + 64], cy[begin : begin + 64], rho[begin : begin + 64] * (1 + 1e-9))
        order = np.argsort(q, kind="stable")
        q, p = q[order], p[order]
        for k in np.unique(q):
            a, z = np.searchsorted(q, [k, k + 1])
            o = begin + k
            hit = p[a:z][strictly_inside(x[p[a:z]], y[p[a:z]], rx[at[o] : at[o + 1]], ry[at[o] : at[o + 1]])]
            left.append(ids[hit])
            right.append(np.full(len(hit), poly[o]))
    return pa.table({"left_id": np.concatenate(left), "right_id": np.concatenate(right)}) if left else empty


def inside_pairs(assigned: DataFrame, sizes: dict, px, py, outlines: DataFrame) -> DataFrame:
    """(left_id, right_id): place strictly inside outline. Flat coordinates only."""
    spark = assigned.sparkSession
    placed = circles(outlines).mapInArrow(_outline_cells(px, py, sizes), "cell int, poly_id long, ring array<struct<x double, y double>>, cx double, cy double, rho double")
    placed = checkpointed(placed)
    many = {r["cell"]: -(-r["n"] // SLAB_ROWS) for r in placed.groupBy("cell").count().withColumnRenamed("count", "n").collect()}
    parts = {c: (-(-h // SLAB_ROWS), many.get(c, 1)) for c, (_, h, _) in sizes.items()}
    cut = F.broadcast(spark.createDataFrame([(c, a, b) for c, (a, b) in parts.items() if a > 1 or b > 1], "cell int, cuts int, outline_cuts int"))

    def task(df: DataFrame, key: str, own: str, other: str, cols: list[str]) -> DataFrame:
        df = df.join(cut, "cell", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("cuts", "outline_cuts")})
        df = df.withColumn(f"own_{own}", F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(f"own_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return df.select("cell", F.col("own_cuts").alias("i"), F.col("own_outline_cuts").alias("j"), *cols)

    points = task(assigned.filter("home"), "id", "cuts", "outline_cuts", ["id", "x", "y"])
    shapes = task(placed, "poly_id", "outline_cuts", "cuts", ["poly_id", "ring", "cx", "cy", "rho"])
    by = ["cell", "i", "j"]
    return points.groupBy(*by).cogroup(shapes.groupBy(*by)).applyInArrow(_inside_in_cell, PAIRS)


def nearby(points: DataFrame, radius: float, outlines: DataFrame | None = None, metric: str = "euclidean", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rel, left_id, right_id): 'near' pairs of places at most `radius` apart and, given outlines, 'inside' pairs.

    `points` has id (unique), x and y; rows with a null id or a coordinate that is not finite take no part. `metric`
    'great_circle' takes x, y as longitude and latitude and metres as radius (no outlines then). `outlines` has
    poly_id and ring; null rings and those of fewer than three corners take no part. Empty tables give no row. Other
    columns are not read.
    """
    spark = points.sparkSession
    usable = points.select("id", "x", "y").filter(F.col("id").isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    usable = checkpointed(usable)
    px, py, n = choose_pivots(usable, cell_rows)
    if not n:
        return spark.createDataFrame([], f"rel string, {PAIRS}")
    assigned = checkpointed(assign_cells(usable, px, py, radius, metric))
    sizes = cell_sizes(assigned)
    out = near_pairs(assigned, sizes, radius, metric).select(F.lit("near").alias("rel"), "left_id", "right_id")
    if outlines is None:
        return out
    shapes = outlines.select("poly_id", "ring").filter(F.col("poly_id").isNotNull() & (F.size("ring") >= 3))
    inside = inside_pairs(assigned, sizes, px, py, shapes).select(F.lit("inside").alias("rel"), "left_id", "right_id")
    return out.unionByName(inside)


#: Metres within which two nodes are near, the limit included.
NEAR_METRES = 12.0


def p1_found(spark, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes")
    x, y = F.col("x"), F.col("y")
    usable = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & ~((x == 0) & (y == 0))
    points = rows_in_use(nodes, ["id"], "loaded_at", ["x", "y"], usable)
    shapes = table(spark, sf_dir, "sig_inter_polygon").filter(F.size("ring") >= 3)
    shapes = shapes.groupBy("poly_id").agg(F.max("ring").alias("ring"))
    return nearby(points, NEAR_METRES, shapes)


#: Points of a cell that one task searches for the nearest, and places whose cells are looked for together.
NEAREST_CHUNK, NEAREST_TOGETHER = 40_000, 256


def _reaching_cells(px, py, reach: np.ndarray, metric: str):
    """The cells that may hold the nearest point of each place: a pivot is a point, so none farther than the nearest pivot is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = Pivots(px, py, metric)
        for b in batches:
            for i in range(0, b.num_rows, NEAREST_TOGETHER):
                part = b.slice(i, NEAREST_TOGETHER)
                x, y = _floats(part, 1), _floats(part, 2)
                _, near, *_ = pivots.within_nearest(x, y, 0.0)
                _, _, q, p, _ = pivots.within_nearest(x, y, float(reach.max()), limit=lambda q, p: near[q] + reach[p])  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), part.column(0).take(pa.array(q)), pa.array(x[q]), pa.array(y[q])], names=["cell", "id", "x", "y"])

    return run


def _nearest_in_cell(metric: str):
    def run(key, places, points):
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if places.num_rows and points.num_rows:
            points = points.sort_by("id")
            ids, x, y = (points.column(c).to_numpy() for c in ("id", "x", "y"))
            _, first = np.unique(np.stack([x, y], 1) + 0.0, axis=0, return_index=True)  # of points at one place the smallest id
            first.sort()
            pivots = Pivots(x[first], y[first], metric)
            home, d, *_ = pivots.within_nearest(places.column("x").to_numpy(), places.column("y").to_numpy(), 0.0)
            out = [places.column("id").to_numpy(), ids[first[home]], d]
        return pa.table(dict(zip(("id", "nearest", "distance"), out)))

    return run


def nearest_points(places: DataFrame, points: DataFrame, metric: str = "euclidean", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, nearest, distance): the nearest of `points` (id, x, y) for each of `places` (id, x, y), ties to the smaller id.

    Points lie in cells around pivots, which are a sample of them; a cell of many is cut into slabs. A place goes to the
    cells that can hold a point as near as its nearest pivot, and the least distance wins. Only pivots and the sizes of
    cells go to the driver. Places or points without a finite place take no part.
    """
    ok = finite(F.col("x")) & finite(F.col("y")) & F.col("id").isNotNull()
    number = [F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    points, places = checkpointed(points.filter(ok).select(*number)), places.filter(ok).select(*number)
    spark = points.sparkSession
    px, py, n = choose_pivots(points, cell_rows)
    if not n:
        return spark.createDataFrame([], "id long, nearest long, distance double")
    assigned = checkpointed(assign_cells(points, px, py, 0.0, metric).filter("home").select("cell", "d", "id", "x", "y"))
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()
    reach = np.full(len(px), -1e300)
    for r in sizes:
        reach[r["cell"]] = r["r"]
    slabs = _slab_table(spark, {r["cell"]: -(-r["n"] // NEAREST_CHUNK) for r in sizes})
    cut = lambda df, slab: df.join(slabs, "cell", "left").withColumn("slabs", F.coalesce("slabs", F.lit(1))).withColumn("slab", slab).select("cell", F.col("slab").cast("int").alias("slab"), "id", "x", "y")
    held = cut(assigned, F.pmod(F.xxhash64("id"), F.col("slabs")))
    asked = places.mapInArrow(_reaching_cells(px, py, reach, metric), "cell int, id long, x double, y double")
    asked = cut(asked, F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    found = asked.groupBy("cell", "slab").cogroup(held.groupBy("cell", "slab")).applyInArrow(_nearest_in_cell(metric), "id long, nearest long, distance double")
    return found.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("b")).select("id", "b.nearest", "b.distance")
