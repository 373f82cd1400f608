"""Merkle manifest of a dataset: a root over all rows and a witness for each of them.

Rows of a group are leaves in the order of their ids; every ``ARITY``
consecutive nodes have one parent, and the roots of the groups are leaves of a
tree of their own. Leaves are appended in aligned blocks of ``ARITY ** LEVELS``,
one block a task. The :class:`Appender` of a block keeps its open subtrees; each
leaf has a partial witness, which grows by the siblings of a subtree whenever a
later append completes the run that the subtree lies in. The root of a block is
then one further append to the blocks above, and so on until one is left. On
the way back a leaf's witness is its block's part and what the block itself has
gathered, so that no witness is stored more than once for a block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import numbered
from graphlens.llm.common import materialize

ARITY = 3
#: Levels of a block: 2,187 leaves.
LEVELS = 7

#: A step of a witness: what stands before and after the own node in its run, as hexadecimal text.
_STEPS = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def fold(node: str, witness: list[tuple[str, str]]) -> str:
    """The root that a node and its witness give."""
    for before, after in witness:
        node = digest(before + node + after)
    return node


def proof(witness: list[tuple[str, str]]) -> str:
    """Digest of all siblings from the leaf to the root, left to right."""
    return digest("".join(before + after for before, after in witness))


class Appender:
    """A tree that grows leaf by leaf and keeps a witness for each leaf."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, int, int]]] = []
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, (leaf, at, at + 1))

    def _add(self, level: int, tree: tuple[str, int, int]) -> None:
        while True:
            if level == len(self.open):
                self.open.append([])
            self.open[level].append(tree)
            if len(self.open[level]) < self.arity:
                return
            tree = self._joined(level)
            level += 1

    def _joined(self, level: int) -> tuple[str, int, int]:
        """The parent of a level's open run; the witnesses below it learn their siblings."""
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _, _ in run]
        for k, (_, begin, end) in enumerate(run):
            step = ("".join(nodes[:k]), "".join(nodes[k + 1 :]))
            for at in range(begin, end):
                self.witnesses[at].append(step)
        return digest("".join(nodes)), run[0][1], run[-1][2]

    def close(self, levels: int) -> str:
        """The root ``levels`` above the leaves; runs that are still open end as they are."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._add(level + 1, self._joined(level))
        return self.open[levels][0][0]


def height(count: int, arity: int = ARITY) -> int:
    """Levels until ``count`` nodes are one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // arity), levels + 1
    return levels


def _grown(table: pa.Table, levels: int) -> tuple[Appender, str, pa.Table]:
    """The block of a table with ``position, node, size``: its tree, its root, the rows in order."""
    table = table.sort_by("position")
    tree = Appender()
    for node in table.column("node").to_pylist():
        tree.append(node)
    return tree, tree.close(min(levels, height(table.column("size")[0].as_py()))), table


def _with_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("size"))
    return nodes.join(sizes, "tree").withColumn("block", F.floor(F.col("position") / ARITY**levels))


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, position, node``: the root of each block of ``nodes``, at the place of its block."""

    def run(table):
        _, root, table = _grown(table, levels)
        return pa.table([table.column("tree").slice(0, 1), table.column("block").slice(0, 1), pa.array([root])], names=["tree", "position", "node"])

    rows = nodes.select("tree", "block", "position", "node", "size").groupBy("tree", "block")
    return materialize(rows.applyInArrow(run, "tree string, position long, node string"), "block_roots")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``tree, position, root, witness`` for rows ``tree, position, node``, their positions gapless from 0 in each tree."""
    most = nodes.agg(F.max("position")).first()[0]
    if not most:
        return nodes.select("tree", "position", F.col("node").alias("root"), F.array().cast(_STEPS).alias("witness"))
    own = materialize(_with_blocks(nodes, levels), "blocks")
    above = climb(_roots(own, levels), levels)

    def run(table, upper):
        tree, _, table = _grown(table, levels)
        gathered = [(s["before"], s["after"]) for s in upper.column("witness")[0].as_py()]
        steps = [[{"before": b, "after": a} for b, a in w + gathered] for w in tree.witnesses]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        root = pa.array([upper.column("root")[0].as_py()] * table.num_rows)
        return pa.table([table.column("tree"), table.column("position"), root, pa.array(steps, kind)], names=["tree", "position", "root", "witness"])

    upper = above.withColumnRenamed("position", "block").groupBy("tree", "block")
    return materialize(own.groupBy("tree", "block").cogroup(upper).applyInArrow(run, f"tree string, position long, root string, witness {_STEPS}"), "climbed")


def _said(name: str) -> F.Column:
    """A value with its length in bytes before it, so that no two rows read alike."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, node, tampered``: each row's digest, and that of the row after tampering, where it differs."""
    ahead = F.concat(*[_said(c) for c in ("doc_id", "source", "lang", "n_chars")])
    rows = docs.withColumn("_shorter", F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    changes = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text").cast("string"), F.lit("\n"))
    made = lambda text: F.sha2(F.concat(ahead, _said(text)).cast("binary"), 256)
    # A name for a group that sorts like its bytes, the missing one first.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), made("text").alias("node"), F.when(changes, made("_shorter")).alias("tampered"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A missing value of a row enters its leaf as ``-`` and an empty one as
    ``0:``; a missing source is a group of its own, the first. Leaves of a
    group ascend by ``doc_id``, a missing one first, and by digest where ids
    repeat; equal rows are equal leaves, each with its own place. A row without
    ``doc_id`` is never tampered with. Long texts are hashed whole, where they
    are read. An empty table gives no rows; extra columns are ignored.
    """
    made = materialize(leaves(docs.select("doc_id", "source", "lang", "n_chars", "text")), "leaves")
    placed = numbered(made, ["tree"], ["doc_id", "node", "tampered"], "position")
    own = materialize(_with_blocks(placed, levels), "placed")
    above = climb(_roots(own, levels), levels)
    subroots = above.filter("position = 0").select(F.col("tree").alias("group"), F.lit("").alias("tree"), F.col("root").alias("node"))
    groups = materialize(numbered(subroots, ["tree"], ["group"], "position"), "groups")
    tops = groups.select("position", F.col("group")).join(climb(groups.select("tree", "position", "node"), levels), "position")
    tops = tops.select(F.col("group").alias("tree"), F.col("root").alias("top"), F.col("witness").alias("over"))
    upper = above.join(tops, "tree").select("tree", F.col("position").alias("block"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("witness", "over").alias("witness"))

    def finish(table, upper):
        tree, _, table = _grown(table, levels)
        gathered = [(s["before"], s["after"]) for s in upper.column("witness")[0].as_py()]
        subroot, root = upper.column("subroot")[0].as_py(), upper.column("root")[0].as_py()
        rows = []
        for leaf, tampered, partial in zip(table.column("node").to_pylist(), table.column("tampered").to_pylist(), tree.witnesses):
            witness = partial + gathered
            folded = fold(tampered or leaf, witness)
            rows.append((leaf, subroot, root, proof(witness), folded, folded == root))
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([table.column("doc_id"), *map(pa.array, zip(*rows))], names=["doc_id", *names])

    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return own.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(finish, result)
