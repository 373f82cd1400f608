"""Sets of seeds as bits: a walk from many seeds keeps one row per node and 64 seeds, not one per pair.

Seeds are numbered; 64 of them are a block. A row ``(block, node, bits)`` holds the seeds of the block that reach the node, so edges
are followed once for all of them and a hop is one ``bit_or``. Neighbouring names share a block. Pairs appear only in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import materialize, numbered
from graphlens.operators.adjacency import Hops
from graphlens.operators.structure import union

#: Seeds of a block: the bits of a long.
BLOCK = 64


@dataclass(frozen=True)
class SeedSets:
    """``rows(block, bits, …)`` and the ``names(block, names)`` of the seeds behind the bits."""

    rows: DataFrame
    names: DataFrame

    def with_rows(self, rows: DataFrame) -> "SeedSets":
        return SeedSets(rows, self.names)

    def folded(self, *columns: str) -> "SeedSets":
        """One row per block and values of ``columns``."""
        return self.with_rows(self.rows.groupBy("block", *columns).agg(F.bit_or("bits").alias("bits")))

    def spread(self, seed: str = "seed") -> DataFrame:
        """One row per seed in a set: the seed, then the other columns of the rows."""
        others = [c for c in self.rows.columns if c not in ("block", "bits")]
        # Most sets are small: up to three seeds are the lowest, the highest and what is left, without a look at all names.
        place = "names[length(bin({})) - 1]".format
        low, high = place("bits & -bits"), place("bits")
        middle = place("bits ^ (bits & -bits) ^ shiftleft(1L, length(bin(bits)) - 1)")
        within = F.expr(
            f"CASE bit_count(bits) WHEN 1 THEN array({high}) WHEN 2 THEN array({low}, {high}) WHEN 3 THEN array({low}, {middle}, {high}) "
            "ELSE filter(names, (name, bit) -> getbit(bits, bit) = 1) END"
        )
        return self.rows.join(self.names, "block").select(F.explode(within).alias(seed), *others)

    def counted(self, seed: str, out: str, *columns: str) -> DataFrame:
        """(seed, *columns, out): rows per seed. Equal sets are counted before their seeds are named, so no row becomes 64."""
        equal = self.rows.groupBy("block", "bits", *columns).agg(F.count("*").alias("_n"))
        return self.with_rows(equal).spread(seed).groupBy(seed, *columns).agg(F.sum("_n").alias(out))

    def of(self, pairs: DataFrame, *columns: str) -> "SeedSets":
        """``pairs(seed, *columns)`` as sets over the same seeds; other seeds are left out."""
        numbers = self.names.select("block", F.posexplode("names").alias("bit", "_seed"))
        found = pairs.join(numbers, F.col("seed").eqNullSafe(F.col("_seed")))
        return self.with_rows(found.select("block", *columns, F.expr("shiftleft(1L, bit)").alias("bits"))).folded(*columns)


def seed_sets(pairs: DataFrame) -> SeedSets:
    """``pairs(seed, node)`` as sets ``(block, node, bits)``, written once."""
    pairs = pairs.select("seed", "node").distinct()
    ids = numbered(pairs.select("seed").distinct(), [], ["seed"], "id")
    placed = ids.select("seed", F.expr(f"id div {BLOCK}").alias("block"), F.expr(f"CAST(id % {BLOCK} AS INT)").alias("bit"))
    # At most 64 names a block.
    names = placed.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bit", "seed"))), lambda s: s["seed"]).alias("names"))
    sets = SeedSets(pairs, materialize(names, "seeds")).of(pairs, "node")
    return sets.with_rows(materialize(sets.rows, "starts"))


def walk(hops: DataFrame | Hops, start: SeedSets, max_depth: int, include_start: bool = False, again: bool = False) -> SeedSets:
    """``rows(block, node, bits, depth)``: the seeds that reach each node at their shortest depth.

    Each hop appends one table of new sets; nothing found earlier is written again. Rows of one node have no seed in common.
    With ``again`` a start is found, too, if a way leads back to it. From the second hop on only nodes that a hop leaves
    are followed, so the hops are not read again when none is left.
    """
    layers = [start.rows.select("block", "node", "bits", F.lit(0).alias("depth"))]
    left = None
    for depth in range(1, max_depth + 1):
        front = layers[-1]
        if depth > 1 and not isinstance(hops, Hops):
            left = materialize(hops.select(F.col("a").alias("node")).distinct(), "left") if left is None else left
            front = materialize(front.join(left, "node", "left_semi"), "front")
            if front.isEmpty():
                break
        nearby = hops.near(front) if isinstance(hops, Hops) else hops
        found = front.join(nearby, F.col("node") == F.col("a")).select("block", F.col("b").alias("node"), F.col("bits").alias("new"), F.lit(0).cast("long").alias("old"))
        for seen in layers[1:] if again else layers:
            found = found.unionByName(seen.select("block", "node", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old")))
        fresh = found.groupBy("block", "node").agg(F.expr("bit_or(new) & ~bit_or(old)").alias("bits"))
        layer = materialize(fresh.filter("bits <> 0").withColumn("depth", F.lit(depth)), "reach")
        if layer.isEmpty():
            break
        layers.append(layer)
    return start.with_rows(union(layers if include_start else layers[1:] or [layers[0].limit(0)]))
