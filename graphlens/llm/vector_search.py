"""Exact nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are taken in tiles of a few thousand vectors. A
vector is kept as int8 steps of its own size, with the length of the error that
rounding made. One matrix product of int8 tiles gives all distances of a tile
pair, wrong by the two errors at most: the tenth-smallest upper bound that a
query has seen is its limit, and pairs whose lower bound exceeds it are gone.
The survivors are recomputed from the original vectors in double precision and
merged by heaps.

Vectors meet on a grid of hashed groups: a candidate goes to every group of
queries, a query to every group of candidates, and a cell of the grid is one
group of the join, of bounded size. Small query sets make one column, so
candidates move once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAREST = 10
#: Vectors of a tile.
TILE = 2_048
#: Components of the query vectors and of the candidate vectors of a grid cell (8 and 32 MB).
QUERY_CELL, CANDIDATE_CELL = 1_048_576, 4_194_304


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: one usable vector of each id, the smallest in array order if it has several."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def tiles(table: pa.Table, dim: int) -> list["Tile"]:
    """The vectors ``vec_id, v`` of a cell as tiles."""
    ids = table.column("vec_id").to_numpy()
    values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).reshape(-1, dim)
    return [Tile(ids[k : k + TILE], values[k : k + TILE]) for k in range(0, len(ids), TILE)]


class Tile:
    """Vectors of a tile, their int8 form, step sizes, and exact error lengths."""

    @np.errstate(over="ignore")
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        top = np.abs(self.exact).max(1)
        self.step = np.where(top / 127 > 0, top / 127, 1.0)
        self.q = np.clip(np.rint(self.exact / self.step[:, None]), -127, 127).astype(np.int8)
        near = self.q * self.step[:, None]
        self.error = np.sqrt(np.square(self.exact - near).sum(1))
        self.square = np.square(near).sum(1)
        # Products of int8 are whole numbers below 2^24 up to this many dimensions, hence exact in single precision.
        self.whole = self.q.astype(np.float32 if vectors.shape[1] <= 1_024 else np.float64)


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances, dimension by dimension in order, so that the sum does not depend on the tile.

    Differences whose squares would leave the range of doubles are scaled by a power of two, which loses no digit.
    """
    top = np.abs(rows - query).max(1, initial=0)
    power = np.where((top > 2.0**500) | (top < 2.0**-500), np.frexp(top)[1], 0)
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += np.square(np.ldexp(rows[:, k] - query[k], -power))
    return np.ldexp(np.sqrt(total), power)


#: Distances below this lose digits when they are squared.
_TINY = 1e-150


def search_cell(queries: list[Tile], candidates: list[Tile], nearest: int = NEAREST):
    """The ``nearest`` candidates of each query of a cell: (query id, candidate id, distance)."""
    for tile in queries:
        heaps: list[list] = [[] for _ in tile.ids]
        limit = np.full(len(tile.ids), np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            for other in candidates:
                dots = (tile.whole @ other.whole.T).astype(np.float64) * tile.step[:, None] * other.step[None, :]
                scale = tile.square[:, None] + other.square[None, :]
                rough = np.sqrt(np.maximum(scale - 2 * dots, 0))
                slack = tile.error[:, None] + other.error[None, :] + 1e-7 * np.sqrt(scale) + _TINY
                bounded = np.isfinite(rough) & np.isfinite(slack)  # others have squares beyond the doubles and are recomputed
                own = tile.ids[:, None] == other.ids[None, :]
                if len(other.ids) > nearest:
                    upper = np.where(own | ~bounded, np.inf, rough + slack)
                    limit = np.minimum(limit, np.partition(upper, nearest - 1, axis=1)[:, nearest - 1])
                hit, cand = np.nonzero((~bounded | (rough - slack <= limit[:, None])) & ~own)
                for row, part in zip(*_grouped(hit, cand)):
                    found = distances(tile.exact[row], other.exact[part])
                    heap = heaps[row]
                    for d, i in zip(found.tolist(), other.ids[part].tolist()):
                        entry = (-d, -i)
                        if len(heap) < nearest:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == nearest:
                        limit[row] = min(limit[row], -heap[0][0])
        for query, heap in zip(tile.ids.tolist(), heaps):
            for d, i in heap:
                yield query, -i, -d


def _grouped(rows: np.ndarray, values: np.ndarray):
    if not len(rows):
        return [], []
    cuts = np.flatnonzero(np.diff(rows)) + 1
    return rows[np.append(0, cuts)].tolist(), np.split(values, cuts)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None = None, every: int = 100, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest other vectors of each query, by Euclidean distance, exactly.

    Queries are the rows of ``queries``, by default those of ``vectors`` whose
    id is divisible by ``every``. Ties go to the smaller id. Vectors that are
    missing, zero, or hold missing or non-finite components take no part, nor
    do rows without id; repeated rows of one id count as one, with the smallest
    vector in array order; only vectors of equal dimension meet, so a query
    without partners has no row. An empty table gives no rows; extra columns
    are ignored.
    """
    rows = clean_vectors(vectors).withColumn("dim", F.size("v"))
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else clean_vectors(queries).withColumn("dim", F.size("v"))
    wide = F.coalesce(F.sum(F.size("embedding")), F.lit(0))
    mine = F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, F.size("embedding"))), F.lit(0))
    n_rows, n_all, n_own = vectors.agg(F.count("*"), wide, mine).first()
    n_asked = n_own if queries is None else queries.agg(wide).first()[0]
    parallel = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    q_groups = max(1, -(-n_asked // QUERY_CELL))
    c_groups = max(1, -(-n_all // CANDIDATE_CELL), min(parallel, n_rows // TILE))

    def celled(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def search(left, right):
        found = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            found = list(search_cell(tiles(left, dim), tiles(right, dim), nearest))
        columns = list(zip(*found)) or [[]] * 3
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["dim", "cell_q", "cell_c"]
    grid_q = celled(asked, "cell_q", q_groups, "cell_c", c_groups).groupBy(*keys)
    grid_c = celled(rows, "cell_c", c_groups, "cell_q", q_groups).groupBy(*keys)
    found = grid_q.cogroup(grid_c).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
