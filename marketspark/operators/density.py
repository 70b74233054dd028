"""Distance to the k-th neighbour over tiles of points.

Rows are packed into blocks of bounded size, and blocks are dealt round into tiles. Each pair of tiles is one group and
yields only the k nearest distances per point; distances between points never leave the task. A group compares block by
block: a matrix product in single precision with a bound on its error leaves the few pairs that may be among the k
nearest, and only their distances are computed, in double precision, so that the result is exact. The work is quadratic
in the number of points (a point is copied once per tile); no training job stands on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.session import settle, ship_code

BLOCK_ROWS = 2000
#: Numbers in the vectors of a tile (a task holds two tiles), and the least number of tiles where there are as many blocks.
TILE, LEAST_TILES = 1 << 21, 8
#: Numbers of a slice of differences.
SLICE = 2_000_000


def _vectors(column: pa.Array) -> np.ndarray:
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return pc.fill_null(column.flatten(), math.nan).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), sizes[0])


def _blocks(points: DataFrame, block_rows: int) -> DataFrame:
    """Rows packed into blocks: the number of the partition and of the block in it, the ids, the vectors as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                rows = batch.slice(at, block_rows)
                x = _vectors(rows.column("v"))
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), ids, pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "n", "ids", "dims", "data"])
                n += 1

    kinds = dict(points.dtypes)
    packed = points.select("id", F.col("v").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    return packed.mapInArrow(pack, f"part int, n long, ids array<{kinds['id']}>, dims int, data binary")


def _cells(points: DataFrame, block_rows: int) -> DataFrame:
    """Blocks copied to every pair of tiles that includes theirs: columns ``_a`` <= ``_b``, ``_own``."""
    blocks = settle(_blocks(points, block_rows))
    parts = blocks.groupBy("part").agg(F.count("*").alias("blocks"), F.sum(F.size("ids").cast("long") * F.col("dims")).alias("numbers")).orderBy("part").collect()
    total, begins = 0, []
    for p in parts:
        begins.append((p["part"], total))
        total += p["blocks"]
    tiles = max(1, math.ceil(sum(p["numbers"] for p in parts) / TILE), min(total, LEAST_TILES))
    first = points.sparkSession.createDataFrame(begins, "part int, begin long")
    own = F.pmod(F.col("begin") + F.col("n"), F.lit(tiles)).cast("int")
    return (
        blocks.join(F.broadcast(first), "part")
        .select("ids", "dims", "data", own.alias("_own"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})
        .drop("_other")
    )


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of x to the same row of y."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _offer(best: np.ndarray, row: np.ndarray, d: np.ndarray) -> None:
    """Put distances ``d`` of rows ``row`` among the least of each row, in place; NaN comes last."""
    k = best.shape[1]
    order = np.lexsort((d, row))
    row, d = row[order], d[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, d, rank = row[rank < k], d[rank < k], rank[rank < k]
    rows, at = np.unique(row, return_inverse=True)
    new = np.full((len(rows), k), math.nan)
    new[at, rank] = d
    best[rows] = np.sort(np.concatenate([best[rows], new], axis=1), axis=1)[:, :k]


def _where(mask: np.ndarray) -> np.ndarray:
    """Flat positions of the true values, which are few: eight at a time are passed over."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    inside = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[inside >> 3] * 8 + (inside & 7), np.flatnonzero(flat[whole:]) + whole])


class _Tile:
    """Points of a tile in blocks, and the least distances found so far (NaN: none yet)."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, k: int, step: int) -> None:
        self.x, self.best = x, np.full((len(x), k), math.nan)
        z = x - centre
        norm = (z * z).sum(axis=1)[:, None]
        one = np.ones_like(norm)
        self.left = np.hstack([-2 * z, norm, one]).astype(np.float32)
        self.right = np.hstack([z, one, norm]).astype(np.float32)
        self.at = [slice(i, min(i + step, len(x))) for i in range(0, len(x), step)]
        self.reach = [math.sqrt(norm[at].max()) for at in self.at]


def _least(squares: np.ndarray, best: np.ndarray, error: float, axis: int) -> np.ndarray:
    """Up to which square a pair may be among the least of its row (axis 1) or column (axis 0)."""
    k = best.shape[1]
    limit = best[:, -1] ** 2 + error
    limit[best[:, -1] == 0] = -math.inf  # nothing is nearer
    if len(todo := np.flatnonzero(~np.isfinite(best[:, -1]))):
        limit[todo] = math.inf
        if squares.shape[axis] >= k:
            some = squares[todo] if axis else squares[:, todo]
            limit[todo] = np.partition(some, k - 1, axis=axis).take(k - 1, axis=axis) + 2 * error
    return limit.astype(np.float32)


def _compare(a: _Tile, b: _Tile, i: int, j: int) -> None:
    """Offer the distances between block i of a and block j of b to the points of both."""
    x, y = a.x[a.at[i]], b.x[b.at[j]]
    sides = [(a.best[a.at[i]], 1), (b.best[b.at[j]], 0)][: 1 if a is b and i == j else 2]
    reach = a.reach[i] + b.reach[j]
    squares = None
    if 1e-12 < reach < 1e12:  # else single precision does not hold the squares
        squares = a.left[a.at[i]] @ b.right[b.at[j]].T
        error = (2 * x.shape[1] + 16) * 2.0**-24 * reach**2
    for best, axis in sides:
        if squares is None:
            near = np.arange(len(x) * len(y))
        else:
            limit = _least(squares, best, error, axis)
            near = _where(squares <= (limit[:, None] if axis else limit))
        step = max(1, SLICE // max(1, x.shape[1]))
        for at in range(0, len(near), step):
            p, q = np.divmod(near[at : at + step], len(y))
            _offer(best, p if axis else q, _distances(x[p], y[q]))


def nearest_distances(x: np.ndarray, y: np.ndarray | None, k: int, step: int) -> list[np.ndarray]:
    """The k least distances of each row of x to the rows of y, and of y to x; of x to itself where y is None."""
    with np.errstate(all="ignore"):
        finite = np.isfinite(x).all(axis=1)
        centre = x[finite].mean(axis=0) if finite.any() else np.zeros(x.shape[1])
        a = _Tile(x, centre, k, step)
        b = a if y is None else _Tile(y, centre, k, step)
        for i in range(len(a.at)):
            for j in range(i if a is b else 0, len(b.at)):
                _compare(a, b, i, j)
    if y is None:
        return [a.best[:, : len(x)]]
    return [a.best[:, : len(y)], b.best[:, : len(x)]]


def core_distances(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distance to the k-th nearest point, counting the point itself as the first.

    ``points`` has ``id`` and ``v``. Null where there are fewer than k points or no vector; rows of one id are one point
    with the distances of all of them.
    """
    ship_code(points.sparkSession)

    def nearest(cell: pa.Table) -> pa.Table:
        a, b = cell.column("_a")[0].as_py(), cell.column("_b")[0].as_py()
        own = cell.column("_own").to_numpy()
        ids, x = [], []
        for tile in (a, b)[: 1 if a == b else 2]:
            blocks = cell.filter(pa.array(own == tile))
            ids.append(pa.chunked_array([c.flatten() for c in blocks.column("ids").chunks], blocks.column("ids").type.value_type).combine_chunks())
            x.append(np.concatenate([np.frombuffer(data.as_buffer()).reshape(-1, dims.as_py()) if dims.as_py() else np.empty((len(i), 0)) for data, dims, i in zip(blocks.column("data"), blocks.column("dims"), blocks.column("ids"), strict=True)]))
        out = []
        for i, best in zip(ids, nearest_distances(x[0], x[1] if len(x) > 1 else None, k, block_rows), strict=True):
            ends = pa.array(np.arange(len(i) + 1) * best.shape[1], pa.int32())
            out.append(pa.table({"id": i, "d": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(best).ravel()))}))
        return pa.concat_tables(out)

    kinds = dict(points.dtypes)
    found = _cells(points, block_rows).groupBy("_a", "_b").applyInArrow(nearest, f"id {kinds['id']}, d array<double>")
    bare = points.filter("v IS NULL").select("id", F.array().cast("array<double>").alias("d"))
    merged = F.array_sort(F.flatten(F.collect_list("d")))  # at most k values per tile
    return found.union(bare).groupBy("id").agg(F.try_element_at(merged, F.lit(k)).alias("core"))
