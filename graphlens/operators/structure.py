"""Structure of large graphs: chains by pointer doubling, strong components by colouring, edges inside many overlapping groups."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import materialize
from graphlens.graph import Graph


def union(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def narrowed(graph: Graph, nodes: list[str], edges: list[str], node_kinds: list[str] | None = None, edge_kinds: list[str] | None = None) -> Graph:
    """``graph`` with the named columns and kinds only, each side written once.

    For operators that look at the same nodes and edges from several sides: the
    graph, which may be a long plan itself, is computed once, and every later look
    is a scan of a few columns with the kind pushed down.
    """
    chosen = graph.nodes if node_kinds is None else graph.of_kind(*node_kinds)
    links = graph.edges if edge_kinds is None else graph.edges_of(*edge_kinds)
    return Graph(materialize(chosen.select(*nodes), "nodes"), materialize(links.select(*edges), "edges"))


# --- chains ------------------------------------------------------------------------------


def chains(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, up): every node on the way up from a seed, itself at 0, in about log2(depth) rounds.

    ``parents(child, parent)`` has one row per child, ``seeds(seed)`` any. In
    round k the table of parents holds 2^k-th ancestors: what is known of a
    chain moves up by 2^k, then the table is joined with itself. A chain ends
    before a node that it already holds, so rings end; of a round without a new
    node no later one has any.
    """
    jump = materialize(parents.select("child", "parent"), "jump")
    layers = [materialize(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("up")).distinct(), "chain")]
    for k in count():
        seen = union(layers)
        moved = seen.join(jump, F.col("node") == F.col("child")).select("seed", F.col("parent").alias("node"), (F.col("up") + F.lit(1 << k)).alias("up"))
        fresh = moved.groupBy("seed", "node").agg(F.min("up").alias("up")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        layer = materialize(fresh, "chain")
        if layer.isEmpty():
            return seen
        layers.append(layer)
        above = jump.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jump = materialize(jump.join(above, "parent").select("child", F.col("above").alias("parent")), "jump")


# --- strong components -------------------------------------------------------------------


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: ends without a way in or a way out are peeled off."""
    core = materialize(edges, "core")
    size = core.count()
    while size:
        sources, targets = core.select("src").distinct(), core.select("dst").distinct()
        kept = core.join(targets.withColumnRenamed("dst", "src"), "src", "left_semi").join(
            sources.withColumnRenamed("src", "dst"), "dst", "left_semi"
        )
        core = materialize(kept.select(*edges.columns), "core")
        left = core.count()
        if left == size:
            break
        size = left
    return core


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches a node, itself included; only changed colours travel on."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colours = materialize(nodes.withColumn("colour", F.col("node")).withColumn("fresh", F.lit(True)), "colours")
    while True:
        sent = (
            colours.filter("fresh").join(edges, F.col("node") == F.col("src")).filter("colour < dst")
            .groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("sent"))
        )
        lower = F.col("sent").isNotNull() & (F.col("sent") < F.col("colour"))
        colours = materialize(
            colours.join(sent, "node", "left").select("node", F.when(lower, F.col("sent")).otherwise(F.col("colour")).alias("colour"), lower.alias("fresh")), "colours"
        )
        if colours.filter("fresh").isEmpty():
            return colours.select("node", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges(src, dst)`` that lie on a cycle of two nodes or more; named by the smallest node.

    Forward-backward colouring: a node takes the smallest node that reaches it;
    the nodes of a colour that reach its name are one component, for all colours
    at once. They go, so do edges between colours, and the rest is coloured again.
    """
    rest = cyclic_core(edges.select("src", "dst").filter("src <> dst").distinct())
    found = []
    while not rest.isEmpty():
        colours = _coloured(rest)
        same = rest.join(colours.withColumnRenamed("node", "src"), "src").join(
            colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst"
        ).filter("colour = other")
        same = materialize(same.select("src", "dst", "colour"), "same")
        layers = [materialize(colours.filter("node = colour"), "back")]
        while True:
            step = same.join(layers[-1].withColumnRenamed("node", "dst"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            layer = materialize(step.join(union(layers).select("node"), "node", "left_anti"), "back")
            if layer.isEmpty():
                break
            layers.append(layer)
        closed = union(layers)
        found.append(closed)
        for end in ("src", "dst"):
            same = same.join(closed.select(F.col("node").alias(end)), end, "left_anti")
        rest = cyclic_core(same.select("src", "dst"))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    named = union(found).withColumnRenamed("colour", "component")
    # A root that nothing reaches back to is a component of its own, on no cycle.
    several = named.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return named.join(several, "component", "left_semi").select("node", "component")


# --- edges inside groups -----------------------------------------------------------------


def edges_within(members: DataFrame, edges: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """``edges`` once per ``group`` of ``members(group, node)`` that holds both of their ends.

    Groups overlap, and a node may be in most of them. An edge takes the groups
    of the end that fewer groups hold and looks the other end up there, so it
    costs the smaller of the two numbers, whichever end is the hub.
    """
    members = materialize(members.select(group, "node").distinct(), "members")
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    sized = edges.join(sizes.select(F.col("node").alias(src), F.col("n").alias("_src_groups")), src).join(
        sizes.select(F.col("node").alias(dst), F.col("n").alias("_dst_groups")), dst
    )
    sized = materialize(sized, "sized")
    rarer = F.col("_src_groups") <= F.col("_dst_groups")
    sides = []
    for chosen, near, far in ((rarer, src, dst), (~rarer, dst, src)):
        taken = sized.filter(chosen).join(members.withColumnRenamed("node", near), near)
        sides.append(taken.join(members.withColumnRenamed("node", far), [group, far], "left_semi").select(group, *edges.columns))
    return sides[0].unionByName(sides[1])


def sets_within(members: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(block, *edges, bits): the groups that hold both ends of each of ``edges``, as bits of sets.

    ``members(block, node, bits)`` has one row per block and node: bits stand for the groups of a block that hold the node. An edge
    takes the blocks of the end that fewer blocks hold, as in :func:`edges_within`.
    """
    members = materialize(members.select("block", "node", "bits"), "members")
    sizes = members.groupBy("node").agg(F.count("*").alias("n"))
    sized = edges.join(sizes.select(F.col("node").alias(src), F.col("n").alias("_src_blocks")), src).join(
        sizes.select(F.col("node").alias(dst), F.col("n").alias("_dst_blocks")), dst
    )
    sized = materialize(sized, "sized")
    rarer = F.col("_src_blocks") <= F.col("_dst_blocks")
    sides = []
    for chosen, near, far in ((rarer, src, dst), (~rarer, dst, src)):
        taken = sized.filter(chosen).join(members.withColumnRenamed("node", near), near)
        other = members.select("block", F.col("node").alias(far), F.col("bits").alias("_far"))
        sides.append(taken.join(other, ["block", far]).select("block", *edges.columns, F.expr("bits & _far").alias("bits")).filter("bits <> 0"))
    return sides[0].unionByName(sides[1])
