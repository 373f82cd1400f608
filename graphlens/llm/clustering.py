"""Centroid clustering by progressive search in Walsh-Hadamard coefficients.

Vectors are whole numbers, and so are their transforms: each of the six steps
adds and subtracts pairs. The transform keeps squared distances up to a factor of
the dimension, so the differences of the first coefficients, summed, never exceed
the whole. For each vector the differences to all centroids are summed from coarse
to fine. After each level the centroid that leads is finished, and every centroid
whose sum so far is strictly above the best finished one is gone. What is left is
finished over all coefficients, so the result is exact, ties included.

Rows are never shuffled: a round reads them once against the centroids, and each
task sends one row of sums per centroid.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import materialize

SIZE = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
#: Bounds of the levels from coarse to fine.
LEVELS = (0, 4, 8, 16, 32, 64)
#: Larger components count as this one, for squared distances would leave the range of a long.
LARGEST = 2**27
#: Up to this component sums of squared coefficients fit into 64 bits; larger ones are worked on as Python numbers.
_FITS = 2**24
#: Vectors that are searched at a time.
TILE = 2_048
_MOST_LONG = 2**63 - 1


def _by_sign_changes(size: int) -> np.ndarray:
    """The transform's coefficients ordered by the sign changes of their rows, fewest first."""
    rows = reduce(np.kron, [np.array([[1, 1], [1, -1]])] * (size.bit_length() - 1))
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


def transform(rows: np.ndarray) -> np.ndarray:
    """Exact Walsh-Hadamard transform of each row, coefficients from coarse to fine."""
    n, size = rows.shape
    x = rows.astype(np.int64 if not rows.size or np.abs(rows).max() <= _FITS else object)
    step = 1
    while step < size:
        pair = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2)
        step *= 2
    return x.reshape(n, size)[:, _by_sign_changes(size)]


def search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each vector, both transformed; ties go to the smaller number."""
    n, size = vectors.shape
    if vectors.dtype != centroids.dtype:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    row, col = np.repeat(np.arange(n), len(centroids)), np.tile(np.arange(len(centroids)), n)
    so_far = np.zeros(len(row), vectors.dtype)
    best = None
    for begin, end in zip(LEVELS, LEVELS[1:]):
        so_far = so_far + np.square(vectors[row, begin:end] - centroids[col, begin:end]).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(so_far, starts)
        leads = np.flatnonzero(so_far == least[row])
        leads = leads[np.flatnonzero(np.diff(row[leads], prepend=-1))]
        if end == size:
            return col[leads], least // size
        whole = least + np.square(vectors[:, end:] - centroids[col[leads], end:]).sum(1)
        best = whole if best is None else np.minimum(best, whole)
        left = so_far <= best[row]
        row, col, so_far = row[left], col[left], so_far[left]
    raise ValueError("the last level must end at the dimension")


def _tiles(batch: pa.RecordBatch):
    for begin in range(0, batch.num_rows, TILE):
        part = batch.slice(begin, TILE)
        yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIZE)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, q``: vectors of 64 finite components as whole numbers of 256ths, rounded down."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = (F.size("v") == SIZE) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.least(F.greatest(x * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return rows.filter(F.col("v").isNotNull() & fine).select("vec_id", F.transform("v", lambda x: F.floor(bounded(x)).cast("int")).alias("q"))


def first_centroids(rows: DataFrame, count: int = CENTROIDS) -> np.ndarray:
    """The ``count`` vectors whose ids have the smallest digests, in the order of these."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.filter("vec_id IS NOT NULL").orderBy(digest, "q").limit(count).select("q").collect()
    return np.array([r["q"] for r in chosen], np.int64).reshape(-1, SIZE)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the mean of its vectors, rounded down; without vectors it stays."""
    known = transform(centroids)

    def sums(batches):
        total, count = np.zeros((len(known), SIZE), np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            for _, q in _tiles(batch):
                near, _ = search(transform(q), known)
                np.add.at(total, near, q)
                count += np.bincount(near, minlength=len(known))
        met = np.flatnonzero(count)
        lists = pa.array([total[k] for k in met], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), lists], ["cluster", "n", "sums"])

    parts = rows.select("q").mapInArrow(sums, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at")
    out = centroids.copy()
    for r in cells.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():  # at most CENTROIDS * SIZE rows
        out[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return out


def clusters(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector of 64 finite components.

    ``distance`` is the squared one, in 256ths of a unit; the inertias are its
    sums over the cluster and over all. Vectors that are missing, of another
    length, or hold missing or non-finite components have no row; zero vectors
    count. Components beyond 524,288 count as this number. A row without
    ``vec_id`` is never a first centroid, but belongs to a cluster. Repeated rows
    count one by one; of equal ids the smaller vector comes first. With fewer
    vectors than centroids every one is a centroid; without any with an id, or
    for an empty table, there are no rows. Sums beyond a long stay at its
    largest value; extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors), "whole_vectors")
    centroids = first_centroids(rows, count)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(rows, centroids)
    known = transform(centroids)

    def assign(batches):
        for batch in batches:
            for part, q in _tiles(batch):
                if len(known):
                    near, far = search(transform(q), known)
                    columns = [part.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    found = materialize(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()
    per_cluster = [(k, min(total, _MOST_LONG), min(sum(sums.values()), _MOST_LONG), digest(k)) for k, total in sorted(sums.items())]
    table = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # ``count`` rows
