"""Unit vectors and their coarse cells, shared by clustering and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a coarse cell is meant to have; pivots at most (a few MB in every task). Pivots are rows of the table.
CELL_ROWS, MOST_CELLS = 2_000, 4_096
DECIMALS = 6


def matrix(col: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 1))


def lists(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d or 1)[: n + 1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1)))


def packed(m: np.ndarray) -> pa.Array:
    """Rows of finite numbers as binaries that hold them exactly: two bytes k and b, then the elements as whole numbers of b bits
    times 2^-k, or as doubles where a row's elements are not such numbers of 25 bits at most."""
    n, d = m.shape
    if not n:
        return pa.array([], pa.binary())
    k = 24 - np.frexp(np.abs(m).max(1))[1]
    with np.errstate(over="ignore", under="ignore"):
        scaled = np.ldexp(m, k[:, None])
    q = np.where(np.isfinite(scaled), scaled, 0).astype(np.int64)
    held = np.bitwise_or.reduce(np.abs(q), axis=1)
    low = np.frexp((held & -held).astype(float))[1] - 1
    low = np.where(held > 0, low, 0)
    q, k = q >> low[:, None], k - low
    fits = (np.abs(k) <= 127) & (held > 0)
    fits &= (np.ldexp(q.astype(float), -np.where(fits, k, 0)[:, None]) == m).all(1)
    bits = np.where(fits, np.maximum(8, np.frexp(np.abs(q).max(1).astype(float))[1] + 1), 64)
    start = np.append(0, np.cumsum(2 + (d * bits + 7) // 8))
    data = np.empty(start[-1], np.uint8)
    data[start[:-1]], data[start[:-1] + 1] = np.where(fits, k, 0).astype(np.int8).view(np.uint8), bits
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        if b == 64:
            body = np.ascontiguousarray(m[rows], "<f8").view(np.uint8)
        else:
            u = (q[rows] + (1 << (b - 1))).astype(np.uint32)
            body = np.packbits((u[:, :, None] >> np.arange(b, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        data[start[rows][:, None] + 2 + np.arange(body.shape[1])] = body
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(data)])


def unpacked(col: pa.Array) -> np.ndarray:
    """Unit vectors of packed rows, all of one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.empty((0, 1))
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    k, bits, out = data[start[:-1]].view(np.int8).astype(int), data[start[:-1] + 1].astype(int), None
    for i in range(0, n, 8192):
        for b in np.unique(bits[i : i + 8192]).tolist():
            rows = i + np.flatnonzero(bits[i : i + 8192] == b)
            long = int(start[rows[0] + 1] - start[rows[0]]) - 2
            d = 8 * long // b
            body = data[start[rows][:, None] + 2 + np.arange(long)]
            if b == 64:
                v = body.view("<f8")
            else:
                body = np.pad(body, ((0, 0), (0, 4))).astype(np.uint32)
                at, shift = np.arange(d) * b >> 3, (np.arange(d) * b & 7).astype(np.uint32)
                word = body[:, at] | body[:, at + 1] << 8 | body[:, at + 2] << 16 | body[:, at + 3] << 24
                v = np.ldexp((word >> shift & np.uint32((1 << b) - 1)).astype(float) - (1 << (b - 1)), -k[rows][:, None])
            out = np.empty((n, d)) if out is None else out
            out[rows] = v
    return unit(out)


def usable_vector(c, length: int):
    """Not null, of that length, no element null or NaN, not all zero."""
    v = F.col(c)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & (F.size(v) == length) & sound, F.lit(False))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows that hold infinity become NaN and are similar to nothing."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        m = m / np.abs(m).max(1, keepdims=True)
        return m / np.sqrt((m * m).sum(1, keepdims=True))


def at_least(threshold: float) -> float:
    """The least cosine that rounds to the threshold or more."""
    return threshold - 0.5 * 10.0**-DECIMALS


def coarse_pivots(df: DataFrame, key: str, vec: str, cell_rows: int = CELL_ROWS, distinct: float = 0.9) -> tuple[np.ndarray, int]:
    """Unit vectors of every so many rows by hash of their key, at most MOST_CELLS, and the number of rows.
    Of pivots with a cosine of `distinct` or more only the first is kept, so a dense spot stays one cell."""
    n = df.count()
    want = int(min(MOST_CELLS, max(1, n // cell_rows)))
    rows = df.orderBy(F.xxhash64(key), key, vec).limit(want).select(vec).collect()
    if df.schema[vec].dataType.typeName() == "binary":
        p = unpacked(pa.array([bytes(r[0]) for r in rows], pa.binary()))
    else:
        p = unit(np.array([r[0] for r in rows], float)) if rows else np.empty((0, 1))
    p = p[np.isfinite(p).all(1)]
    alike, keep = p @ p.T >= distinct, np.ones(len(p), bool)
    for i in range(len(p)):
        if keep[i]:
            keep[i + 1 :] &= ~alike[i, i + 1 :]
    return p[keep], n


def packed_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vec): vectors packed. Vectors of infinite length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = matrix(b.column(1)).astype(float)
            ok = np.isfinite(raw).all(1) & np.isfinite(unit(raw)).all(1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), packed(raw[ok])], names=["id", "vec"])

    return df.select(F.col(key).cast("long"), vec).mapInArrow(run, "id long, vec binary")


def place_in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vec, cell): packed vectors with their most similar pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = (unpacked(b.column(1)) @ pivots.T).argmax(1) if b.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], names=["id", "vec", "cell"])

    return rows.select("id", "vec").mapInArrow(run, "id long, vec binary, cell int")


def slabs(counts: dict[int, int], most: int) -> dict[int, int]:
    return {c: -(-n // most) for c, n in counts.items() if n > most}


def with_slab(df: DataFrame, parts: dict[int, int], key: str = "id") -> DataFrame:
    """Adds `slab` and `slabs`: rows of a large cell are dealt among its slabs by hash."""
    cut = F.broadcast(df.sparkSession.createDataFrame(list(parts.items()), "cell int, slabs int"))
    df = df.join(cut, "cell", "left").withColumn("slabs", F.coalesce("slabs", F.lit(1)))
    return df.withColumn("slab", F.pmod(F.xxhash64(key, F.lit(1)), F.col("slabs")).cast("int"))


def cell_counts(df: DataFrame) -> dict[int, int]:
    """Rows of each cell: at most MOST_CELLS rows come to the driver."""
    return {r[0]: r[1] for r in df.groupBy("cell").count().collect()}
