"""Bounded traversals as frontier joins; every operator serves any number of start nodes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, materialize, numbered
from graphlens.functions.text import transaction_name
from graphlens.graph import Graph
from graphlens.operators.adjacency import Hops, StoredGraph
from graphlens.operators.seed_sets import SeedSets, seed_sets, walk
from graphlens.operators.structure import chains, edges_within, sets_within, strong_components
from graphlens.operators.structure import union as _union
from graphlens.schema import literal_map, node_label

# The edge kinds each question follows.
DOWNSTREAM = ["CALLS", "INJECTS", "IMPLEMENTS", "PRODUCES", "WRITES", "READS", "CONTAINS", "DEPENDS_ON"]
UPSTREAM = ["CALLS", "IMPLEMENTS", "DEPENDS_ON", "INHERITS", "INJECTS", "CONSUMES", "READS", "INCLUDES"]
TRACE = ["CALLS", "HANDLES", "CALLS_API", "PRODUCES", "CONSUMES", "READS", "WRITES", "IMPLEMENTS"]
PATH = [
    "CALLS", "IMPLEMENTS", "DEPENDS_ON", "INJECTS", "INHERITS", "READS", "WRITES", "PRODUCES", "CONSUMES", "STARTS_AT",
]
TRACE_KINDS = ["FUNCTION", "CLASS", "INTERFACE", "API_ENDPOINT", "TABLE", "STORED_PROCEDURE", "ROUTE"]
CONSTRUCTORS = ["<init>", "<clinit>", "__init__"]
TERMINALS = {
    "WRITES": "TABLE_WRITE",
    "READS": "TABLE_READ",
    "PRODUCES": "MESSAGE_PUBLISH",
    "CALLS_API": "EXTERNAL_API_CALL",
}
LAYER_ORDER = ["api", "service", "repository", "database", "other"]


def steps(edges: DataFrame, kinds: Sequence[str] | None, direction: str = "out") -> DataFrame:
    """(a, b) hops of the wanted kinds; ``in`` reverses, ``both`` ignores direction.

    Parallel edges give equal hops: what a walk finds is made distinct anyway,
    which spares a shuffle of the whole edge table.
    """
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def hops_of(graph: Graph, kinds: Sequence[str] | None, direction: str = "out") -> DataFrame | Hops:
    """The hops of a graph: read hop by hop from a stored one, else a table made from its edges."""
    if isinstance(graph, StoredGraph):
        return Hops(graph, None if kinds is None else tuple(kinds), direction)
    return steps(graph.edges, kinds, direction)


def stored_edges(graph: Graph, *kinds: str) -> Graph:
    """The graph with its edges of ``kinds`` (all of them without any) written once, for several walks over them; a stored one as it is."""
    if isinstance(graph, StoredGraph):
        return graph
    edges = graph.edges_of(*kinds) if kinds else graph.edges
    return Graph(graph.nodes, materialize(edges.select("src", "dst", "kind"), "edges"))


def reach(hops: DataFrame | Hops, seeds: DataFrame, max_depth: int, include_start: bool = False, store: bool = True) -> DataFrame:
    """(seed, node, depth) with the shortest depth; breadth-first from every seed at once.

    ``hops(a, b)`` is written once, in place (``store=False``: it is a stored table already). Seeds are bits of sets, 64 a row
    (:mod:`seed_sets`): a hop follows an edge once for all of them, and pairs of a seed and a node appear only in the result.
    """
    if store and not isinstance(hops, Hops):
        hops = materialize(hops, "hops")
    return walk(hops, seed_sets(seeds), max_depth, include_start).spread()


def between(edges: DataFrame, fqns: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose both ends are among ``fqns``; run ahead of a join that fans out."""
    known = fqns.select("fqn").distinct()
    return edges.join(known.withColumnRenamed("fqn", src), src, "left_semi").join(
        known.withColumnRenamed("fqn", dst), dst, "left_semi"
    )


def self_seeds(fqns: DataFrame) -> DataFrame:
    """Seeds that start at themselves; ``fqns(fqn)``."""
    return fqns.select(F.col("fqn").alias("seed"), F.col("fqn").alias("node"))


def describe(found: DataFrame, graph: Graph, *more: str) -> DataFrame:
    """Attach name, label and file of the reached node."""
    info = graph.nodes.select(
        F.col("fqn").alias("node"), "name", node_label(F.col("kind")).alias("type"), F.col("path").alias("file"), *more
    )
    return found.join(info, "node")


# --- impact ------------------------------------------------------------------------------


def impact_downstream(
    graph: Graph, fqns: DataFrame, max_depth: int = 5, kinds: Sequence[str] | None = DOWNSTREAM, store: bool = True,
) -> DataFrame:
    """What each start node reaches: (seed, node, depth, hops)."""
    found = reach(hops_of(graph, kinds), self_seeds(fqns), max_depth, store=store)
    return found.withColumn("hops", F.col("depth"))


def impact_upstream(
    graph: Graph, fqns: DataFrame, max_depth: int = 5, kinds: Sequence[str] | None = UPSTREAM,
    exclude_members: bool = True, store: bool = True,
) -> DataFrame:
    """Dependents of a node or of anything it contains; ``depth`` is 1, ``hops`` is the distance."""
    if store:
        graph = stored_edges(graph, *([] if kinds is None else {"CONTAINS", *kinds}))
    # A contained node starts at distance 0, yet it is a dependent too when a
    # path leads from it back to the contained set.
    found = walk(hops_of(graph, kinds, "in"), contained(graph, seed_sets(self_seeds(fqns))), max_depth, again=True).spread().filter("node <> seed")
    if exclude_members:
        found = found.filter(~F.col("node").startswith(F.concat("seed", F.lit("."))))
    return found.select("seed", "node", F.lit(1).alias("depth"), F.col("depth").alias("hops"))


def contained(graph: Graph, starts: SeedSets) -> SeedSets:
    """The starts and what they contain, at most ten steps down."""
    return walk(hops_of(graph, ["CONTAINS"]), starts, 10, include_start=True)


def impact(
    graph: Graph, fqns: DataFrame, direction: str = "both", max_depth: int = 5,
    down_kinds: Sequence[str] | None = DOWNSTREAM, up_kinds: Sequence[str] | None = UPSTREAM,
    exclude_members: bool = True,
) -> DataFrame:
    """Impact in either or both directions; both keeps the smaller depth."""
    parts = []
    if direction == "both":
        graph = stored_edges(graph, *([] if down_kinds is None or up_kinds is None else {"CONTAINS", *down_kinds, *up_kinds}))
    if direction in ("downstream", "both"):
        parts.append(impact_downstream(graph, fqns, max_depth, down_kinds, store=direction != "both"))
    if direction in ("upstream", "both"):
        parts.append(impact_upstream(graph, fqns, max_depth, up_kinds, exclude_members, store=direction != "both"))
    return _union(parts).groupBy("seed", "node").agg(F.min("depth").alias("depth"), F.min("hops").alias("hops"))


def impact_summary(found: DataFrame, graph: Graph) -> DataFrame:
    """(seed, grouping, value, nodes): total, by type and by depth in one aggregate."""
    typed = describe(found, graph)
    sets = typed.groupingSets(
        [["seed"], ["seed", "type"], ["seed", "depth"]], "seed", "type", "depth"
    ).agg(F.count("*").alias("nodes"), F.grouping_id().alias("_gid"))
    grouping = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "type").otherwise("depth")
    return sets.select(
        "seed", grouping.alias("grouping"), F.coalesce("type", F.col("depth").cast("string")).alias("value"), "nodes"
    )


def impact_graph_export(graph: Graph, fqns: DataFrame, direction: str, max_depth: int) -> DataFrame:
    """Any-edge impact: nodes within reach, depth by the undirected shortest path."""
    way = {"downstream": "out", "upstream": "in", "both": "both"}[direction]
    graph = stored_edges(graph)
    reachable = reach(hops_of(graph, None, way), self_seeds(fqns), max_depth, store=False)
    undirected = reachable if way == "both" else reach(hops_of(graph, None, "both"), self_seeds(fqns), max_depth, store=False)
    return undirected.join(reachable.select("seed", "node"), ["seed", "node"], "left_semi").filter("node <> seed")


def neighbourhood(graph: Graph, fqns: DataFrame, depth: int = 1) -> DataFrame:
    """k-hop neighbours over any edge in either direction."""
    return reach(hops_of(stored_edges(graph), None, "both"), self_seeds(fqns), depth, store=False)


# --- trace -------------------------------------------------------------------------------


def trace_layer(fqn: Column, kind: Column, is_accessor: Column) -> Column:
    """Layer of a traced node; the first matching rule wins."""
    return (
        F.when(kind.isin("TABLE", "STORED_PROCEDURE", "VIEW", "COLUMN"), "database")
        .when(kind.isin("API_ENDPOINT", "ROUTE") | fqn.rlike("(?i)controller"), "api")
        .when(fqn.rlike(r"(?i)repositor|\.repo\b") | is_accessor, "repository")
        .when(fqn.rlike("(?i)service"), "service")
        .otherwise("other")
    )


#: What an edge inside a trace says of its source: hidden behind what it implements, or an accessor of data.
HIDING, ACCESS = ["IMPLEMENTS"], ["READS", "WRITES"]


def _traced(graph: Graph, fqns: DataFrame, max_depth: int) -> tuple[Graph, SeedSets, SeedSets]:
    """The graph with its trace edges written once, the start nodes, and rows (block, node, bits, depth, direction, name, kind) of what is around them.

    A start is never found from itself. Traces stay sets of starts until their nodes or edges are listed.
    """
    kinds = graph.nodes.filter(F.col("kind").isin(*TRACE_KINDS)).select(F.col("fqn").alias("node"), "name", "kind")
    graph = stored_edges(graph, *TRACE)
    starts, ways = seed_sets(self_seeds(fqns)), []
    for direction, way in (("downstream", "out"), ("upstream", "in")):
        found = walk(steps(graph.edges, TRACE, way), starts, max_depth)
        ways.append(found.rows.join(kinds, "node").withColumn("direction", F.lit(direction)))
    return graph, starts, starts.with_rows(materialize(_union(ways), "trace"))


def _inner(graph: Graph, starts: SeedSets, found: SeedSets, types: Sequence[str], shown_only: bool = False) -> SeedSets:
    """Rows (block, source, target, type, bits): trace edges of ``types`` inside each trace; ``shown_only``: those from a node that is found."""
    edges = graph.edges_of(*types).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"))
    members = found.rows.select("block", "node", "bits").unionByName(starts.rows.select("block", "node", "bits"))
    if shown_only:
        known = found.rows.select(F.col("node").alias("source")).distinct()
        edges = materialize(edges.join(known, "source", "left_semi").distinct(), "marking")
        ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
        members = members.join(ends, "node", "left_semi") if not edges.isEmpty() else members.limit(0)
    return found.with_rows(materialize(sets_within(found.with_rows(members).folded("node").rows, edges.distinct(), "source", "target"), "inner"))


def trace_nodes(graph: Graph, fqns: DataFrame, max_depth: int = 5) -> DataFrame:
    """(seed, direction, node, name, kind, depth, layer, sequence) of the execution trace around each start node."""
    graph, starts, found = _traced(graph, fqns, max_depth)
    # A centre is not shown, so only edges from nodes that are found say anything here.
    return _numbered_nodes(found, _inner(graph, starts, found, [*HIDING, *ACCESS], shown_only=True))


def _without(rows: DataFrame, marked: DataFrame, node: str) -> DataFrame:
    """``rows`` without the traces in which ``marked(block, node, mark)`` holds their ``node``; nothing is joined if none is marked."""
    if marked.isEmpty():
        return rows
    held = rows.join(marked.withColumnRenamed("node", node), ["block", node], "left")
    return held.withColumn("bits", F.expr("bits & ~coalesce(mark, 0L)")).drop("mark").filter("bits <> 0")


def _marked(inner: SeedSets, types: Sequence[str]) -> DataFrame:
    """(block, node, mark): the traces in which a node is the source of an edge of ``types``."""
    rows = inner.rows.filter(F.col("type").isin(*types))
    return rows.groupBy("block", F.col("source").alias("node")).agg(F.bit_or("bits").alias("mark"))


def _numbered_nodes(found: SeedSets, inner: SeedSets) -> DataFrame:
    shown = _without(found.rows, _marked(inner, HIDING), "node").withColumn("accessor", F.lit(False))
    accessors = _marked(inner, ACCESS)
    if not accessors.isEmpty():
        held = shown.drop("accessor").join(accessors, ["block", "node"], "left").withColumn("mark", F.expr("coalesce(mark, 0L)"))
        parts = F.expr("array(struct(bits & mark AS bits, true AS accessor), struct(bits & ~mark AS bits, false AS accessor))")
        shown = held.withColumn("part", F.explode(parts)).drop("bits", "mark").select("*", "part.*").drop("part").filter("bits <> 0")
    layer = trace_layer(F.col("node"), F.col("kind"), F.col("accessor"))
    placed = found.with_rows(shown.select("block", "bits", "direction", "node", "name", "kind", "depth", layer.alias("layer")))
    return numbered(placed.spread(), ["seed", "direction"], ["depth", "name", "node"], "sequence", start=1)


def _shown_edges(inner: SeedSets) -> SeedSets:
    """Edges of a trace without those of hidden nodes; ``inner`` holds its ``HIDING`` edges."""
    hidden, rows = _marked(inner, HIDING), inner.rows
    for end in ("source", "target"):
        rows = _without(rows, hidden, end)
    return inner.with_rows(rows)


def trace_access(graph: Graph, fqns: DataFrame, max_depth: int = 5) -> DataFrame:
    """(seed, source, target, type): the edges of each trace that read or write, without their numbers."""
    graph, starts, found = _traced(graph, fqns, max_depth)
    shown = _shown_edges(_inner(graph, starts, found, [*HIDING, *ACCESS]))
    return shown.with_rows(shown.rows.filter(F.col("type").isin(*ACCESS))).spread()


def trace_route(graph: Graph, fqns: DataFrame, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the execution trace around each start node.

    nodes: seed, node, name, kind, direction, depth, sequence, layer;
    edges: seed, source, target, type, sequence. Nodes alone come cheaper from :func:`trace_nodes`.
    """
    graph, starts, found = _traced(graph, fqns, max_depth)
    inner = _inner(graph, starts, found, TRACE)
    nodes = _numbered_nodes(found, inner)

    def numbers(direction, end, out):
        return nodes.filter(F.col("direction") == direction).select(
            "seed", F.col("node").alias(end), F.col("sequence").alias(out)
        )

    numbered_edges = (
        _shown_edges(inner).spread().join(numbers("downstream", "target", "down"), ["seed", "target"], "left")
        .join(numbers("upstream", "source", "up"), ["seed", "source"], "left")
        .select("seed", "source", "target", "type", F.coalesce("down", "up").alias("sequence"))
    )
    return nodes, numbered_edges


# --- shortest path -----------------------------------------------------------------------


def shortest_paths(graph: Graph, pairs: DataFrame, max_depth: int = 10, kinds: Sequence[str] = PATH) -> DataFrame:
    """One shortest undirected path per ``pairs(from_fqn, to_fqn)``.

    Returns (from_fqn, to_fqn, position, node, via, forward): ``via`` is the edge
    kind into the node and ``forward`` whether it points along the path. Among
    equal lengths each step takes the smallest predecessor. Both ends search at
    once, so each side only walks half the distance. The last hop is not opened:
    the other side's outermost nodes are tried in their order instead.
    """
    edges = graph.edges.filter(F.col("kind").isin(*kinds)).select("src", "dst", "kind")
    hops = materialize(
        edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("via"), F.lit(True).alias("forward"))
        .unionByName(
            edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("kind").alias("via"), F.lit(False).alias("forward"))
        )
        .groupBy("a", "b").agg(F.min(F.struct(F.expr("NOT forward").alias("back"), "via")).alias("e"))
        .select("a", "b", "e.via", F.expr("NOT e.back").alias("forward")),
        "hops",
    )
    wanted = pairs.select("from_fqn", "to_fqn").distinct()
    keys = ["from_fqn", "to_fqn"]
    fronts = {
        side: [materialize(wanted.select(*keys, F.col(end).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("prev")), side)]
        for side, end in (("head", "from_fqn"), ("tail", "to_fqn"))
    }
    met = materialize(
        fronts["head"][0].join(fronts["tail"][0].select(*keys, "node"), [*keys, "node"]).select(*keys, "node", F.lit(0).alias("length")),
        "met",
    )
    meetings = [met]
    for hop in range(max_depth):
        side, other = ("head", "tail") if hop % 2 == 0 else ("tail", "head")
        layers = fronts[side]
        open_pairs = layers[-1].join(_union(meetings).select(*keys), keys, "left_anti")
        if hop == max_depth - 1:
            found = _first_meeting(open_pairs, fronts[other][-1], hops, keys)
        else:
            found = (
                open_pairs.join(hops, F.col("node") == F.col("a"))
                .groupBy(*keys, "b").agg(F.min("a").alias("prev"))
                .withColumnRenamed("b", "node")
                .join(_union(layers).select(*keys, "node"), [*keys, "node"], "left_anti")
            )
        layer = materialize(found.select(*keys, "node", F.lit(len(layers)).alias("depth"), "prev"), side)
        if layer.isEmpty():
            break
        layers.append(layer)
        across = _union(fronts[other]).select(*keys, "node", F.col("depth").alias("other_depth"))
        reached = layer.join(across, [*keys, "node"]).groupBy(*keys).agg(
            F.min(F.struct((F.col("depth") + F.col("other_depth")).alias("length"), "node")).alias("m")
        )
        meetings.append(materialize(reached.select(*keys, "m.node", "m.length"), "met"))
    meeting = _union(meetings)
    parts = [meeting.select(*keys, "node", F.lit(0).alias("offset"))]
    for side, sign in (("head", -1), ("tail", 1)):
        back = _union(fronts[side]).select(*keys, "node", "prev")
        current = meeting.select(*keys, "node")
        for distance in range(1, len(fronts[side])):
            current = materialize(
                current.join(back, [*keys, "node"]).filter("prev IS NOT NULL").select(*keys, F.col("prev").alias("node")), "walk"
            )
            parts.append(current.withColumn("offset", F.lit(sign * distance)))
    walked = _union(parts)
    first = walked.groupBy(*keys).agg(F.min("offset").alias("first"))
    path = materialize(
        walked.join(first, keys).select(*keys, (F.col("offset") - F.col("first")).alias("position"), "node"), "path"
    )
    before = path.select(*keys, (F.col("position") + 1).alias("position"), F.col("node").alias("a"))
    return (
        path.join(before, [*keys, "position"], "left")
        .join(hops.withColumnRenamed("b", "node"), ["a", "node"], "left")
        .select(*keys, "position", "node", "via", "forward")
    )


def _first_meeting(front: DataFrame, goals: DataFrame, hops: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, prev): of a pair's ``goals`` the smallest next to its ``front``, with its smallest neighbour there.

    Most pairs meet at one of their first goals, so 1, 4, 16, … are tried and only pairs that are still open go on, to the last goal.
    Of the hops only those from a node of an open pair's front are opened then, so goals that no open pair can reach cost nothing.
    """
    near = front.select(*keys, F.col("node").alias("a"))
    tries = materialize(numbered(goals.select(*keys, "node").join(near.select(*keys).distinct(), keys, "left_semi"), keys, ["node"], "rank"), "goals")
    met, tried, many = [], 0, 1
    while True:
        now = tries.filter((F.col("rank") >= tried) & (F.col("rank") < tried + many))
        beyond = hops.select("a", F.col("b").alias("node"))
        if met:
            now = now.join(_union(met), keys, "left_anti")
            near = materialize(near.join(met[-1], keys, "left_anti"), "near")
            beyond = materialize(beyond.join(near.select("a").distinct(), "a", "left_semi").join(now.select("node").distinct(), "node", "left_semi"), "beyond")
        beside = now.select(*keys, "node").join(beyond, "node").join(near, [*keys, "a"])
        met.append(materialize(beside.groupBy(*keys).agg(F.min(F.struct("node", F.col("a").alias("prev"))).alias("m")).select(*keys, "m.*"), "met"))
        tried, many = tried + many, many * 4
        if tries.filter(F.col("rank") >= tried).join(_union(met), keys, "left_anti").isEmpty():
            return _union(met)


# --- ancestry ----------------------------------------------------------------------------


def ancestry(graph: Graph, fqns: DataFrame) -> DataFrame:
    """(seed, position, node): the containment chain from a root down to the node.

    A node with several parents follows the one under a MODULE first, then the
    smallest name, so the chain is the same on every run. It ends at a node
    without parents, or before a node that it already holds.
    """
    parent_kind = graph.nodes.select(F.col("fqn").alias("src"), F.when(F.col("kind") == "MODULE", 0).when(F.col("kind") == "CLASS", 1).otherwise(2).alias("rank"))
    parents = graph.edges_of("CONTAINS").select("src", "dst").distinct().join(parent_kind, "src")
    one = first_by(parents, ["dst"], ["rank", "src"], ["src"]).select(F.col("dst").alias("child"), F.col("src").alias("parent"))
    chain = chains(one, fqns.select(F.col("fqn").alias("seed")))
    top = chain.groupBy("seed").agg(F.max("up").alias("top"))
    return chain.join(top, "seed").select("seed", (F.col("top") - F.col("up")).alias("position"), "node")


# --- cycles ------------------------------------------------------------------------------


def _walks(first: DataFrame, hop: DataFrame, longest: int, forward: bool = True) -> list[DataFrame]:
    """Walks of 1 to ``longest`` edges that use none twice, grown from ``first`` at their end or at their start."""
    walks = [first]
    while len(walks) < longest:
        step = walks[-1].join(hop, F.col("end" if forward else "start") == F.col("src" if forward else "dst")).filter(~F.array_contains("used", F.col("id")))
        node = F.col("dst" if forward else "src")
        grown = [F.col("start"), node.alias("end"), F.array_append("cycle", node)] if forward else [node.alias("start"), F.col("end"), F.array_prepend("cycle", node)]
        walks.append(materialize(step.select(*grown[:2], grown[2].alias("cycle"), F.array_append("used", F.col("id")).alias("used")), "walk"))
    return walks


def closed_trails(
    edges: DataFrame, min_length: int, max_length: int, starts: DataFrame | None = None
) -> DataFrame:
    """(cycle, cycle_length): closed walks that use no edge twice, every rotation its own row.

    ``edges(src, dst, edge_id)``; lengths from 2 on. Only edges inside strong
    components are walked. A trail is a half that leaves its start and a half
    that returns to it, joined on both ends, so no walk is stored that is longer
    than half of the bound.
    """
    parts = strong_components(edges)
    core = edges.select("src", "dst", "edge_id").join(parts.withColumnRenamed("node", "src"), "src", "left").join(
        parts.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst", "left"
    ).filter("src = dst OR component = other")
    core = materialize(core.select("src", "dst", F.col("edge_id").alias("id")), "core")
    first = core.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("cycle"), F.array("id").alias("used"))
    longest = -(-max_length // 2)
    if starts is None:
        leaving = returning = _walks(first, core, longest)
    else:
        known = starts.select("fqn").distinct()
        leaving = _walks(first.join(known.withColumnRenamed("fqn", "start"), "start", "left_semi"), core, longest)
        returning = _walks(first.join(known.withColumnRenamed("fqn", "end"), "end", "left_semi"), core, max_length // 2, forward=False)
    closed = []
    for length in range(min_length, max_length + 1):
        out = leaving[-(-length // 2) - 1]
        back = returning[length // 2 - 1].select(F.col("end").alias("start"), F.col("start").alias("end"), F.col("cycle").alias("rest"), F.col("used").alias("more"))
        met = out.join(back, ["start", "end"]).filter(~F.arrays_overlap("used", "more"))
        closed.append(met.select(F.concat("cycle", F.expr("slice(rest, 2, size(rest))")).alias("cycle"), F.lit(length).alias("cycle_length")))
    return _union(closed).distinct()


def cycles(graph: Graph, level: str = "module", limit: int | None = 50) -> DataFrame:
    """Circular dependencies, shortest first: module names over IMPORTS or class fqns over DEPENDS_ON."""
    kind, longest = ("IMPORTS", 6) if level == "module" else ("DEPENDS_ON", 4)
    edges = graph.edges_of(kind).select("src", "dst", F.concat_ws(">", "kind", "src", "dst").alias("edge_id")).distinct()
    found = closed_trails(edges, 2, longest)
    if level == "module":
        found = _named(found, graph)
    return found if limit is None else found.orderBy("cycle_length", F.concat_ws(",", "cycle")).limit(limit)


def cycle_count(graph: Graph) -> DataFrame:
    """Number of circular dependencies between modules, as the metrics page counts them."""
    return cycles(graph, "module", limit=None).agg(F.count("*").alias("circular_dependency_count"))


def _named(found: DataFrame, graph: Graph) -> DataFrame:
    """Replace fqns by names inside each cycle; a cycle is bounded, so is its group."""
    names = graph.nodes.select(F.col("fqn").alias("node"), "name")
    keyed = found.withColumn("id", F.concat_ws(">", "cycle"))
    return (
        keyed.select("id", "cycle_length", F.posexplode("cycle").alias("pos", "node"))
        .join(names, "node")
        .groupBy("id", "cycle_length").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("c"))
        .select(F.col("c.name").alias("cycle"), "cycle_length").distinct()
    )


# --- transaction flows -------------------------------------------------------------------


def flow_members(graph: Graph, entries: DataFrame, max_depth: int = 15) -> DataFrame:
    """(entry, node, depth, position) of every flow, all entries at once.

    Only non-constructor functions are walked. Position is breadth-first order:
    by depth, then the parent's position, then the order of the parent's edges.
    """
    walkable = graph.of_kind("FUNCTION").filter(~F.coalesce("name", F.lit("")).isin(*CONSTRUCTORS)).select(F.col("fqn").alias("node"))
    hops = materialize(
        graph.edges_of("CALLS", "INJECTS", "DEPENDS_ON")
        .groupBy(F.col("src").alias("a"), F.col("dst").alias("node")).agg(F.min("seq").alias("seq"))
        .join(walkable, "node", "left_semi"),
        "flow_hops",
    )
    start = entries.select(F.col("fqn").alias("entry"), F.col("fqn").alias("node")).distinct().join(walkable, "node", "left_semi")
    layers = [materialize(start.select("entry", "node", F.lit(0).alias("depth"), F.lit(0).alias("position")), "flow")]
    sizes = layers[0].select("entry", F.lit(1).alias("size"))
    for depth in range(1, max_depth + 1):
        seen = _union(layers)
        arrivals = (
            layers[-1].withColumnRenamed("node", "a").join(hops, "a")
            .select("entry", "node", F.struct(F.col("position").alias("parent"), "seq", "node").alias("arrival"))
            .groupBy("entry", "node").agg(F.min("arrival").alias("arrival"))
            .join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        )
        placed = numbered(arrivals, ["entry"], ["arrival"], "rank")
        layer = materialize(
            placed.join(sizes, "entry").select("entry", "node", F.lit(depth).alias("depth"), (F.col("rank") + F.col("size")).cast("int").alias("position")),
            "flow",
        )
        if layer.isEmpty():
            break
        layers.append(layer)
        sizes = _union(layers).groupBy("entry").agg(F.count("*").alias("size"))
    return _union(layers)


def flow_terminals(graph: Graph, members: DataFrame) -> DataFrame:
    """(entry, node, position, terminal_type): the kind of a member's first terminal edge."""
    ending = graph.edges.filter(F.col("kind").isin(*TERMINALS))
    first = first_by(ending.select("src", "kind", "seq", "dst"), ["src"], ["seq", "kind", "dst"], ["kind"])
    return members.join(first.withColumnRenamed("src", "node"), "node").select(
        "entry", "node", "position", literal_map(TERMINALS)[F.col("kind")].alias("terminal_type")
    )


def flow_tables(graph: Graph, members: DataFrame) -> DataFrame:
    """(entry, table_fqn): tables that a member of the flow reads or writes.

    Flows share their members, so a flow is a bit: an access is followed once for 64 flows, and pairs appear only in the result.
    """
    tables = graph.of_kind("TABLE").select(F.col("fqn").alias("table_fqn"))
    access = graph.edges_of("READS", "WRITES").select(F.col("src").alias("node"), F.col("dst").alias("table_fqn")).distinct()
    flows = seed_sets(members.select(F.col("entry").alias("seed"), "node"))
    touched = flows.rows.join(access, "node").groupBy("block", "table_fqn").agg(F.bit_or("bits").alias("bits"))
    return flows.with_rows(touched.join(tables, "table_fqn", "left_semi").select("block", "bits", "table_fqn")).spread("entry")


def transactions(graph: Graph, entry_points: DataFrame, max_depth: int = 15) -> Graph:
    """TRANSACTION nodes with STARTS_AT, ENDS_AT and INCLUDES edges for all entry points."""
    from graphlens.functions.scale import last_by
    from graphlens.graph import edge_rows, node_rows

    points = entry_points.select(
        F.col("fqn").alias("entry"), transaction_name(F.col("kind"), F.col("fqn"), F.col("metadata")).alias("name"), "metadata"
    )
    members = materialize(flow_members(graph, entry_points, max_depth), "members")
    ends = flow_terminals(graph, members)
    size = members.groupBy("entry").agg(F.count("*").alias("node_count"), F.max("depth").alias("depth"))
    # At most one value per terminal kind, so the collected list has four entries at most.
    types = ends.groupBy("entry", "terminal_type").agg(F.min("position").alias("p")).groupBy("entry").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "terminal_type"))), lambda t: t["terminal_type"]), ",").alias("end_point_types")
    )
    named = points.join(size, "entry").join(types, "entry", "left").withColumn("fqn", F.concat(F.lit("txn:"), "name"))
    rows = last_by(
        named.withColumn("props", F.create_map(
            F.lit("entry_point_fqn"), F.col("entry"), F.lit("end_point_types"), F.coalesce("end_point_types", F.lit("")),
            F.lit("node_count"), F.col("node_count").cast("string"), F.lit("depth"), F.col("depth").cast("string"),
        )),
        ["fqn"], ["entry"], ["name", "props"],
    )
    keyed = named.select("entry", F.col("fqn").alias("src"))

    def link(rows_, target, kind, position=None):
        props = F.create_map(F.lit("position"), F.col("position").cast("string")) if position else F.lit(None)
        return edge_rows(
            rows_.join(keyed, "entry").select(
                "src", F.col(target).alias("dst"), F.lit(kind).alias("kind"),
                F.lit("transaction-discovery").alias("evidence"), props.alias("props"),
            )
        )

    edges = (
        link(named.select("entry").distinct(), "entry", "STARTS_AT")
        .unionByName(link(ends, "node", "ENDS_AT"))
        .unionByName(link(members, "node", "INCLUDES", position=True))
        .unionByName(link(flow_tables(graph, members), "table_fqn", "INCLUDES"))
    )
    return Graph(node_rows(rows.withColumn("kind", F.lit("TRANSACTION"))), edges)


# --- reach across technologies -----------------------------------------------------------


def cross_technology(graph: Graph, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """(seed, kind, name, detail): endpoints, topics and tables behind each of ``seeds(seed, node)``."""
    return cross_technology_sets(graph, seeds, max_depth).spread()


def cross_technology_sets(graph: Graph, seeds: DataFrame, max_depth: int = 5) -> SeedSets:
    """Rows (block, kind, name, detail, bits) of :func:`cross_technology`."""
    functions = graph.of_kind("FUNCTION").select(F.col("fqn").alias("node"))
    starts = seed_sets(seeds)
    hops = stored_edges(graph, "CALLS", "INJECTS").edges
    reached = lambda *kinds: walk(steps(hops, kinds), starts, max_depth, include_start=True).rows
    called = reached("CALLS")
    # Handlers alone are reached by injections as well; a graph without any needs no walk for them.
    injected = called if graph.edges_of("HANDLES").isEmpty() else reached("CALLS", "INJECTS")

    def last_step(found, edge_kinds, node_kind, label, name, detail):
        # Parallel edges give the same bits again, so they need not be made distinct first.
        ends = graph.edges_of(*edge_kinds).select(F.col("src").alias("node"), F.col("dst").alias("fqn"), F.col("kind").alias("edge"))
        target = graph.of_kind(node_kind).select("fqn", name.alias("name"))
        linked = found.select("block", "node", "bits").join(functions, "node", "left_semi").join(ends, "node")
        met = linked.groupBy("block", "fqn", detail.alias("detail")).agg(F.bit_or("bits").alias("bits"))
        return met.join(target, "fqn").select("block", F.lit(label).alias("kind"), "name", "detail", "bits")

    rows = (
        last_step(injected, ["HANDLES"], "API_ENDPOINT", "api_endpoint", F.concat_ws(" ", "method", F.coalesce(F.col("props")["path"], "path")), F.concat(F.lit("via "), "node"))
        .unionByName(last_step(called, ["PRODUCES", "CONSUMES"], "MESSAGE_TOPIC", "message_topic", F.col("name"), F.col("edge")))
        .unionByName(last_step(called, ["READS", "WRITES"], "TABLE", "database_table", F.col("name"), F.col("edge")))
    )
    return starts.with_rows(rows).folded("kind", "name", "detail")
