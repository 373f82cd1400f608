"""Groups of alike vectors by an epsilon grid order join.

On unit vectors a cosine of ``similarity`` is a distance of ``epsilon``. Vectors
are sorted by the cells, ``epsilon`` wide, of their leading principal
coordinates, and the sorted sequence is cut into intervals. Every interval knows
its bounding box on these coordinates and a ball around its vectors; ``FAN``
intervals in a row make a larger one, up to a single root. The join starts at
the root with itself. A pair of intervals that is provably distant is dropped,
one that is provably alike links as a whole, and any other is joined interval by
interval below. Pairs of lowest intervals that are still open meet in one task
each, which goes on in the same way down to tiles and ends with products.

Equal vectors are one node with a count, so copies are never paired. Tasks send
a count and at most one connecting link per node, never their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import numbered
from graphlens.llm.common import materialize
from graphlens.llm.near_duplicates import components

SIMILARITY = 0.95
#: Leading principal coordinates of the grid.
AXES = 8
#: Axes are fitted for so many of the most frequent dimensions, none larger than this, on at most so many vectors and components
#: of each. Other dimensions use their first coordinates: any axes give the same links.
FITTED, WIDEST, SAMPLE, SAMPLE_VALUES = 16, 2_048, 4_096, 1_048_576
#: Components of an interval of the sequence (4 MB as doubles).
INTERVAL = 524_288
#: Intervals below a larger one, as a power of two.
FAN_BITS = 3
#: Vectors of a tile.
TILE = 256
#: More than rounding can shift a distance or a cosine.
MARGIN = 1e-9

_FITS = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
_NODE = "dim int, id long, lo array<double>, hi array<double>, center array<double>, radius double, weight long, rep long"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow or underflow on the way."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(1, keepdims=True))


def cosine(u: np.ndarray, v: np.ndarray) -> float:
    """Cosine of two vectors with exactly rounded sums."""
    u, v = u / np.abs(u).max(), v / np.abs(v).max()
    return math.fsum(u * v) / math.sqrt(math.fsum(u * u)) / math.sqrt(math.fsum(v * v))


def _matrix(column, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(-1, dim)


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each frequent dimension the leading axes of a bounded sample, chosen by a hash of the vectors."""
    out = {}
    frequent = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(FITTED).collect()
    for dim in (r["dim"] for r in frequent if AXES < r["dim"] <= WIDEST):
        chosen = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("embedding")).limit(min(SAMPLE, SAMPLE_VALUES // dim)).select("embedding")
        rows = unit(np.array([r["embedding"] for r in chosen.collect()], np.float64))
        out[dim] = np.linalg.eigh(np.cov(rows, rowvar=False, bias=True))[1][:, ::-1][:, :AXES] if len(rows) > 1 else _plain(dim)
    return out


def _plain(dim: int) -> np.ndarray:
    return np.eye(dim, min(AXES, dim))


def sequence(nodes: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """``id, dim, interval, embedding, m, least``: nodes in epsilon grid order; ``id`` ascends along it."""
    kind = nodes.schema["embedding"].dataType.simpleString()

    def placed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                points = unit(_matrix(part.column("embedding"), dim)) @ axes.get(dim, _plain(dim))
                lists = [pa.array(list(x), pa.list_(t)) for x, t in ((np.floor(points / epsilon).astype(np.int32), pa.int32()), (points, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "cell", "point"])

    columns = f"dim int, embedding {kind}, m long, least long"
    made = nodes.select("dim", "embedding", "m", "least").mapInArrow(placed, f"{columns}, cell array<int>, point array<double>")
    order = ["dim", "cell", "point", "embedding"]
    ordered = made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    # 2^bits vectors of an interval: the numbers of a partition begin at a multiple of 2^33, so none crosses partitions.
    bits = f"CAST(greatest(0, floor(log2({INTERVAL} / greatest(dim, 1)))) AS int)"
    return materialize(ordered.selectExpr("id", "dim", f"shiftright(id, {bits}) AS interval", "embedding", "m", "least"), "sequence")


def _ball(centers: np.ndarray, radii: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    center = (centers * (weights / weights.sum())[:, None]).sum(0)
    return center, float((np.sqrt(np.square(centers - center).sum(1)) + radii).max())


def _lowest(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``dim, interval`` with box, ball, weight and first node of each interval."""

    def run(table):
        dim = table.column("dim")[0].as_py()
        vectors = unit(_matrix(table.column("embedding"), dim))
        points = vectors @ axes.get(dim, _plain(dim))
        center, radius = _ball(vectors, np.zeros(len(vectors)), np.ones(len(vectors)))
        values = [dim, table.column("interval")[0].as_py(), points.min(0).tolist(), points.max(0).tolist(), center.tolist(), radius]
        values += [sum(table.column("m").to_pylist()), min(table.column("id").to_pylist())]
        return pa.table([pa.array([v], t) for v, t in zip(values, _TYPES)], names=["dim", "interval", *_NAMES[2:]])

    return rows.groupBy("dim", "interval").applyInArrow(run, _NODE.replace(" id ", " interval "))


_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.int64(), pa.int64()]


def _raised(nodes: DataFrame) -> DataFrame:
    """The intervals of ``2**FAN_BITS`` intervals each."""

    def run(table):
        dim = table.column("dim")[0].as_py()
        lo, hi, centers = (np.array(table.column(c).to_pylist()) for c in ("lo", "hi", "center"))
        weights = table.column("weight").to_numpy().astype(float)
        center, radius = _ball(centers, table.column("radius").to_numpy(), weights)
        values = [dim, table.column("parent")[0].as_py(), lo.min(0).tolist(), hi.max(0).tolist(), center.tolist(), radius]
        values += [sum(table.column("weight").to_pylist()), min(table.column("rep").to_pylist())]
        return pa.table([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)

    return materialize(nodes.selectExpr("*", f"shiftright(id, {FAN_BITS}) AS parent").groupBy("dim", "parent").applyInArrow(run, _NODE), "raised")


def _judged(pairs: DataFrame, nodes: DataFrame, epsilon: float) -> DataFrame:
    """The pairs ``dim, a, b`` that are not provably distant; ``alike`` if all their vectors provably link."""
    side = lambda s: nodes.select("dim", *[F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in _NAMES[1:]])
    both = pairs.join(side("a"), ["dim", "a"]).join(side("b"), ["dim", "b"])
    gap = "zip_with(zip_with(lo_a, hi_b, (x, y) -> x - y), zip_with(lo_b, hi_a, (x, y) -> x - y), (x, y) -> power(greatest(x, y, 0D), 2))"
    away = "zip_with(center_a, center_b, (x, y) -> (x - y) * (x - y))"
    total = lambda terms: f"sqrt(aggregate({terms}, 0D, (s, x) -> s + x))"
    both = both.selectExpr("*", f"{total(gap)} AS gap", f"{total(away)} AS away")
    near = both.filter(f"gap <= {epsilon + MARGIN} AND away - radius_a - radius_b <= {epsilon + MARGIN}")
    kept = ["dim", "a", "b", "weight_a", "weight_b", "rep_a", "rep_b"]
    return materialize(near.selectExpr(*kept, f"away + radius_a + radius_b <= {epsilon - MARGIN} AS alike"), "judged")


def _expanded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of the intervals below; of an interval with itself each pair once."""
    below = lambda s: nodes.selectExpr("dim", f"shiftright(id, {FAN_BITS}) AS {s}", f"id AS child_{s}")
    met = pairs.select("dim", "a", "b").join(below("a"), ["dim", "a"]).join(below("b"), ["dim", "b"])
    return met.filter("a <> b OR child_a <= child_b").selectExpr("dim", "child_a AS a", "child_b AS b")


class _Side:
    """Vectors of an interval with the boxes and balls of their tiles."""

    def __init__(self, table: pa.Table, axes: dict[int, np.ndarray]):
        table = table.sort_by("id")
        dim = table.column("dim")[0].as_py()
        self.ids, self.m = table.column("id").to_numpy(), table.column("m").to_numpy().astype(np.float64)
        self.raw = _matrix(table.column("embedding"), dim)
        self.vectors = unit(self.raw)
        points = self.vectors @ axes.get(dim, _plain(dim))
        self.cuts = list(range(0, len(self.ids), TILE)) + [len(self.ids)]
        tiles = list(zip(self.cuts, self.cuts[1:]))
        self.lo, self.hi = (np.array([f(points[a:b], axis=0) for a, b in tiles]) for f in (np.min, np.max))
        self.balls = [_ball(self.vectors[a:b], np.zeros(b - a), np.ones(b - a)) for a, b in tiles]


class _Join:
    """Counts and connections of the vectors of two intervals, or of one with itself."""

    def __init__(self, left: _Side, right: _Side | None, similarity: float, epsilon: float):
        self.left, self.own, self.right = left, right is None, right or left
        self.similarity, self.epsilon = similarity, epsilon
        self.shift = 0 if self.own else len(left.ids)
        self.ids = left.ids if self.own else np.concatenate([left.ids, right.ids])
        self.links, self.root = np.zeros(len(self.ids)), np.arange(len(self.ids))

    def run(self) -> "_Join":
        self._intervals(0, len(self.left.cuts) - 1, 0, len(self.right.cuts) - 1)
        return self

    def _intervals(self, i: int, j: int, k: int, n: int) -> None:
        """Joins tiles [i, j) of the left side and [k, n) of the right side."""
        x, y = self.left, self.right
        if self.own and k >= j:
            return  # the pair is met the other way round
        gap = np.maximum(np.maximum(x.lo[i:j].min(0) - y.hi[k:n].max(0), y.lo[k:n].min(0) - x.hi[i:j].max(0)), 0)
        if np.sqrt(np.square(gap).sum()) > self.epsilon + MARGIN:
            return
        if j - i == 1 and n - k == 1:
            self._tiles(i, k)
        elif j - i >= n - k:
            middle = (i + j) // 2
            self._intervals(i, middle, k, n)
            self._intervals(middle, j, k, n)
        else:
            middle = (k + n) // 2
            self._intervals(i, j, k, middle)
            self._intervals(i, j, middle, n)

    def _tiles(self, i: int, k: int) -> None:
        x, y = self.left, self.right
        a, b = slice(x.cuts[i], x.cuts[i + 1]), slice(y.cuts[k], y.cuts[k + 1])
        (c, r), (d, s) = x.balls[i], y.balls[k]
        if np.sqrt(np.square(c - d).sum()) - r - s > self.epsilon + MARGIN:
            return
        dots = x.vectors[a] @ y.vectors[b].T
        link = dots >= self.similarity
        for p, q in zip(*np.nonzero(np.abs(dots - self.similarity) < MARGIN)):
            link[p, q] = cosine(x.raw[a][p], y.raw[b][q]) >= self.similarity
        if self.own and i == k:
            np.fill_diagonal(link, False)
        found = link.astype(np.float64)
        self.links[a] += found @ y.m[b]
        if not (self.own and i == k):
            self.links[self.shift + b.start : self.shift + b.stop] += found.T @ x.m[a]
        p, q = np.nonzero(link)
        self._unite(p + a.start, q + b.start + self.shift)

    def _unite(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            p_root, q_root = self.root[p], self.root[q]
            apart = p_root != q_root
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(p_root, q_root)[apart], np.minimum(p_root, q_root)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def table(self) -> pa.Table:
        """``id, links, other``: how many vectors of the other side link, and a node that is connected."""
        met = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.root))))
        return pa.table([pa.array(self.ids[met]), pa.array(self.links[met].astype(np.int64)), pa.array(self.ids[self.root[met]])], names=["id", "links", "other"])


def _met(rows: DataFrame, open_: DataFrame, axes, similarity: float, epsilon: float) -> DataFrame:
    """``id, links, other`` of the open pairs ``dim, a, b`` of lowest intervals, each in a task of its own."""

    def run(left, right):
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["id", "links", "other"])
        return _Join(_Side(left, axes), _Side(right, axes) if right.num_rows else None, similarity, epsilon).run().table()

    keys = ["dim", "a", "b"]
    wanted = [*keys, "id", "m", "embedding"]
    left = rows.join(open_.withColumnRenamed("interval_a", "interval"), ["dim", "interval"]).select(*wanted)
    right = rows.join(open_.filter("a <> b").withColumnRenamed("interval_b", "interval"), ["dim", "interval"]).select(*wanted)
    left, right = (side.select(*[F.col(c).alias(c) for c in wanted]) for side in (left, right))  # columns of their own, as both come from ``rows``
    return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "id long, links long, other long"), "met")


def vector_links(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors ``embedding, m, least``: ``id, embedding, m, least, n_links`` and the connecting links ``a, b``.

    ``n_links`` counts other rows: copies of the vector and of linked vectors.
    """
    epsilon = math.sqrt(2 - 2 * similarity)
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")), "vectors")
    axes = principal_axes(nodes)
    rows = sequence(nodes, axes, epsilon)
    intervals = materialize(_lowest(rows, axes).withColumn("_all", F.lit(0)), "intervals")
    named = materialize(numbered(intervals, ["_all"], ["dim", "interval"], "id").drop("_all"), "named")
    levels = [named.select(*_NAMES)]
    while (levels[-1].groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        levels.append(_raised(levels[-1]))

    pairs = levels[-1].selectExpr("dim", "id AS a", "id AS b")
    shared, links = [], []
    for level in reversed(range(len(levels))):
        judged = _judged(pairs, levels[level], epsilon)
        alike = judged.filter("alike")
        links.append(alike.filter("a <> b").selectExpr("rep_a AS a", "rep_b AS b"))
        row = "named_struct('of', {}, 'more', {}, 'own', {}, 'target', {})".format
        each = f"inline(if(a = b, array({row('a', 'weight_a', 1, 'rep_a')}), array({row('a', 'weight_b', 0, 'rep_b')}, {row('b', 'weight_a', 0, 'rep_a')})))"
        shared.append(alike.selectExpr("dim", each).selectExpr(f"{level} AS level", "*"))
        if level:
            pairs = _expanded(judged.filter("NOT alike"), levels[level - 1])

    keys = named.select("dim", "interval", "id")
    open_ = judged.filter("NOT alike").select("dim", "a", "b")
    for s in "ab":
        open_ = open_.join(keys.withColumnRenamed("interval", f"interval_{s}").withColumnRenamed("id", s), ["dim", s])
    met = _met(rows, open_, axes, similarity, epsilon)

    # Vectors of an interval that links as a whole, at any level above them: one sum and one target each.
    whole = shared[0]
    for more in shared[1:]:
        whole = whole.unionByName(more)
    whole = whole.groupBy("level", "dim", "of").agg(F.sum("more").alias("more"), F.sum("own").alias("own"), F.min("target").alias("target"))
    above = keys.selectExpr("dim", "interval", "id", f"explode(sequence(0, {len(levels) - 1})) AS level").selectExpr("dim", "interval", "level", f"shiftright(id, {FAN_BITS} * level) AS of")
    whole = above.join(whole, ["level", "dim", "of"]).groupBy("dim", "interval").agg(F.sum("more").alias("more"), F.sum("own").alias("own"), F.collect_set("target").alias("targets"))
    whole = materialize(whole, "whole")  # one row per interval, a target per level at most

    counted = met.groupBy("id").agg(F.sum("links").alias("links"))
    found = rows.join(counted, "id", "left").join(whole.drop("targets"), ["dim", "interval"], "left")
    n_links = F.col("m") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0)) - F.coalesce("own", F.lit(0)) * F.col("m")
    found = found.select("id", "embedding", "m", "least", n_links.alias("n_links"))
    connect = met.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    connect = connect.unionByName(whole.selectExpr("array_min(targets) AS a", "explode(targets) AS b"))
    connect = connect.unionByName(rows.join(whole, ["dim", "interval"]).selectExpr("id AS a", "array_min(targets) AS b"))
    for more in links:
        connect = connect.unionByName(more)
    return found, connect.filter("a <> b")


def vector_groups(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``n_links`` counts the other rows with a cosine of ``similarity`` or more,
    equal vectors among them; ``component_id`` is the smallest ``vec_id`` that
    links reach, its own included. Vectors that are missing, zero, or hold
    missing or non-finite components link with nothing, and only vectors of one
    length link. Every row counts, also where ids repeat. A row without
    ``vec_id`` links, but is nobody's smallest id; its group has no id if all
    its rows have none. An empty table gives no rows; extra columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = rows.filter(_FITS)
    found, links = vector_links(usable.groupBy("embedding").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")), similarity)
    found = materialize(found, "counted")
    joined = components(links)
    named = found.join(joined, found["id"] == joined["node"], "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = named.join(smallest, "component").select("embedding", "n_links", "component_id")
    linked = usable.join(table, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(F.expr(_FITS), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
