"""Read questions on a graph: lists, search, details, roll-ups, dead code, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.scale import materialize, numbered
from graphlens.graph import Graph
from graphlens.operators.enrich import class_modules, first_known, method_owners
from graphlens.operators.structure import edges_within, narrowed
from graphlens.schema import NODE_SCHEMA, node_label

# Annotations that keep a function alive, link kinds of the architecture view.
ALIVE_ANNOTATIONS = ["PostConstruct", "EventListener", "Scheduled", "Bean", "Test"]
COMPONENT_LINKS = ["CALLS", "DEPENDS_ON", "INJECTS", "READS", "WRITES", "CALLS_API", "MAPS_TO"]
FLOW_EDGES = ["CALLS", "WRITES", "READS", "INJECTS", "DEPENDS_ON"]

# Stereotype annotation -> layer.
STEREOTYPE_LAYERS = {
    "Controller": "Presentation",
    "RestController": "Presentation",
    "Service": "Business Logic",
    "Repository": "Data Access",
    "Configuration": "Configuration",
}


# --- lists and search --------------------------------------------------------------------


def page(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Stable page: the order must end in a unique column."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def list_nodes(graph: Graph, kind: str | None = None, language: str | None = None) -> DataFrame:
    nodes = graph.nodes
    if kind:
        nodes = nodes.filter(F.col("kind") == kind)
    if language:
        nodes = nodes.filter(F.col("language") == language)
    return nodes


def list_edges(graph: Graph, kind: str | None = None) -> DataFrame:
    return graph.edges if kind is None else graph.edges.filter(F.col("kind") == kind)


def search(graph: Graph, text: str, label: str | None = None) -> DataFrame:
    """Case-insensitive substring search on name or fqn with a constant score."""
    wanted = F.lower(F.lit(text))
    hit = F.contains(F.lower("name"), wanted) | F.contains(F.lower("fqn"), wanted)
    found = graph.nodes.filter(hit).withColumn("type", node_label(F.col("kind")))
    if label:
        found = found.filter(F.col("type") == label)
    return found.select("fqn", "name", "type", F.lit(1.0).alias("score"))


def core_and_extra(graph: Graph, core: Sequence[str] = ("fqn", "name", "kind", "language", "path", "line", "loc")) -> DataFrame:
    """Core columns plus every other property that is set, as one map of text."""
    # Only plain values: lists and structs have their own columns in the answers.
    extra = [f.name for f in NODE_SCHEMA if f.name not in core and f.dataType.simpleString() in ("string", "int", "boolean")]
    stated = F.map_filter(
        F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()
    )
    return graph.nodes.select(*core, F.map_concat(stated, F.coalesce("props", F.create_map().cast("map<string,string>"))).alias("properties"))


def children(graph: Graph, parents: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(parent, fqn, name): contained nodes of the wanted kinds for any number of parents."""
    inside = graph.nodes.filter(F.col("kind").isin(*kinds)).select("fqn", "name", "kind")
    return (
        graph.edges_of("CONTAINS").join(parents.select(F.col("fqn").alias("src")), "src", "left_semi")
        .select(F.col("src").alias("parent"), F.col("dst").alias("fqn")).distinct().join(inside, "fqn")
    )


def classify_by_rules(fqn: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Layer of the first rule whose text occurs in the name."""
    out = F.lit(None).cast("string")
    for pattern, layer in reversed(rules):
        out = F.when(F.contains(fqn, F.lit(pattern)), layer).otherwise(out)
    return out


def stereotype_layer(annotations: Column) -> Column:
    return first_known(annotations, STEREOTYPE_LAYERS)


def has_role(roles: Column, bit: int) -> Column:
    """Role bits of a symbol occurrence: 1 definition, 2 import, 4 write, 8 read."""
    return roles.bitwiseAND(bit) != 0


# --- details -----------------------------------------------------------------------------


def incident_edges(graph: Graph) -> DataFrame:
    """(fqn, direction, kind, neighbour) for every node."""
    out = graph.edges.select(F.col("src").alias("fqn"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("neighbour"))
    into = graph.edges.select(F.col("dst").alias("fqn"), F.lit("in").alias("direction"), "kind", F.col("src").alias("neighbour"))
    return out.unionByName(into).distinct()


def distinct_fans(graph: Graph) -> DataFrame:
    """(fqn, fan_in, fan_out): distinct callers and callees.

    Pairs are deduplicated first, so the counts that follow are plain and the
    hot side of a hub is combined before its shuffle.
    """
    pairs = graph.edges_of("CALLS").select("src", "dst").distinct()
    sides = pairs.groupBy(F.col("dst").alias("fqn")).agg(F.count("*").alias("fan_in")).withColumn("fan_out", F.lit(0)).unionByName(
        pairs.groupBy(F.col("src").alias("fqn")).agg(F.count("*").alias("fan_out")).withColumn("fan_in", F.lit(0))
    )
    return sides.groupBy("fqn").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


def node_details(graph: Graph, kind: str = "FUNCTION") -> DataFrame:
    nodes = graph.of_kind(kind).select("fqn", "name", node_label(F.col("kind")).alias("type"), "loc")
    return nodes.join(distinct_fans(graph), "fqn", "left").select(
        "fqn", "name", "type", "loc", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out")
    )


def call_partners(graph: Graph) -> DataFrame:
    """(fqn, role, partner, partner_name): callers and callees as rows, one per partner."""
    pairs = graph.edges_of("CALLS").select("src", "dst").distinct()
    rows = pairs.select(F.col("dst").alias("fqn"), F.lit("caller").alias("role"), F.col("src").alias("partner")).unionByName(
        pairs.select(F.col("src").alias("fqn"), F.lit("callee").alias("role"), F.col("dst").alias("partner"))
    )
    return rows.join(graph.nodes.select(F.col("fqn").alias("partner"), F.col("name").alias("partner_name")), "partner")


def dead_functions(graph: Graph, min_loc: int = 0, strict: bool = False) -> DataFrame:
    """Functions nobody calls, serves or feeds, largest first.

    Endpoint and topic links count in either direction unless ``strict``.
    """
    def linked(kind: str, other: str) -> DataFrame:
        others = graph.of_kind(other).select(F.col("fqn").alias("other"))
        ends = [graph.edges_of(kind).select(F.col("src").alias("other"), F.col("dst").alias("fqn"))]
        if not strict:
            ends.append(graph.edges_of(kind).select(F.col("dst").alias("other"), F.col("src").alias("fqn")))
        rows = ends[0] if strict else ends[0].unionByName(ends[1])
        return rows.join(others, "other", "left_semi").select("fqn").distinct()

    exempt = F.arrays_overlap(F.coalesce("annotations", F.array().cast("array<string>")), F.array(*[F.lit(a) for a in ALIVE_ANNOTATIONS]))
    quiet = graph.of_kind("FUNCTION").filter(
        (F.col("loc") >= min_loc) & ~F.coalesce("is_constructor", F.lit(False)) & ~exempt
    )
    called = graph.edges_of("CALLS").select(F.col("dst").alias("fqn")).distinct()
    for alive in (called, linked("HANDLES", "API_ENDPOINT"), linked("CONSUMES", "MESSAGE_TOPIC")):
        quiet = quiet.join(alive, "fqn", "left_anti")
    return quiet.select("fqn", "name", "path", "line", "loc")


def dead_classes(graph: Graph, min_loc: int = 0) -> DataFrame:
    used = graph.edges_of("DEPENDS_ON", "CALLS").select(F.col("dst").alias("fqn")).distinct()
    return graph.of_kind("CLASS").filter(F.col("loc") >= min_loc).join(used, "fqn", "left_anti").select("fqn", "name", "path", "line", "loc")


def uncalled_function_count(graph: Graph) -> DataFrame:
    """Dashboard count: the weaker predicate without size and constructor filters."""
    called = graph.edges_of("CALLS").select(F.col("dst").alias("fqn")).distinct()
    endpoints = graph.of_kind("API_ENDPOINT").select(F.col("fqn").alias("src"))
    served = graph.edges_of("HANDLES").join(endpoints, "src", "left_semi").select(F.col("dst").alias("fqn")).distinct()
    quiet = graph.of_kind("FUNCTION").join(called, "fqn", "left_anti").join(served, "fqn", "left_anti")
    return quiet.agg(F.count("*").alias("dead_code_count"))


def top(rows: DataFrame, value: str, limit: int, unique: str = "fqn") -> DataFrame:
    """Largest ``value`` first with a unique tie-break."""
    return rows.filter(F.col(value).isNotNull()).orderBy(F.desc(value), unique).limit(limit)


# --- roll-ups ----------------------------------------------------------------------------


def overview(graph: Graph) -> DataFrame:
    def count(kind):
        return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))

    return graph.nodes.agg(
        count("MODULE").alias("modules"), count("CLASS").alias("classes"), count("FUNCTION").alias("functions"),
        F.sum(F.coalesce("loc", F.lit(0))).alias("total_loc"),
    )


def counts_by_label(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy(node_label(F.col("kind")).alias("type")).agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc")
    )


def communities(members: DataFrame) -> DataFrame:
    """(community_id, size, member): members stay rows; ``members(community_id, name)``."""
    sizes = members.groupBy("community_id").agg(F.count("*").alias("size"))
    return members.join(sizes, "community_id").select("community_id", "size", F.col("name").alias("member"))


def aggregated_class_edges(graph: Graph, parents: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, weight): calls and dependencies between classes of known modules."""
    from graphlens.operators.enrich import class_call_weights

    graph = narrowed(
        graph, ["app_name", "fqn", "name", "kind"], ["app_name", "src", "dst", "kind", "seq"],
        ["MODULE", "CLASS", "INTERFACE", "FUNCTION"], ["CONTAINS", "CALLS", "DEPENDS_ON"],
    )
    owners = materialize(method_owners(graph, ("CLASS", "INTERFACE")), "owners")
    calls = class_call_weights(graph, owners).select("src", "dst", "weight", F.lit("CALLS").alias("kind"))
    typed = graph.of_kind("CLASS", "INTERFACE").select("fqn")
    deps = graph.edges_of("DEPENDS_ON").groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("kind", F.lit("DEPENDS_ON"))
    for end in ("src", "dst"):
        deps = deps.join(typed.withColumnRenamed("fqn", end), end, "left_semi")
    homes = _module_children(graph, None)
    sources = homes if parents is None else _module_children(graph, parents)
    merged = (
        calls.unionByName(deps).filter("src <> dst")
        .join(sources.withColumnRenamed("fqn", "src"), "src", "left_semi")
        .join(homes.withColumnRenamed("fqn", "dst"), "dst", "left_semi")
        .groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))
    )
    return merged.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight")


def _module_children(graph: Graph, parents: DataFrame | None) -> DataFrame:
    modules = graph.of_kind("MODULE").select("fqn") if parents is None else parents
    return children(graph, modules, ["CLASS", "INTERFACE"]).select("fqn").distinct()


def aggregated_module_edges(graph: Graph) -> DataFrame:
    """(source, target, kind, weight): the class roll-up lifted through the module map."""
    homes = children(graph, graph.of_kind("MODULE").select("fqn"), ["CLASS", "INTERFACE"]).select(F.col("parent").alias("module"), "fqn")
    flat = aggregated_class_edges(graph)
    return (
        flat.join(homes.select(F.col("fqn").alias("source"), F.col("module").alias("a")), "source")
        .join(homes.select(F.col("fqn").alias("target"), F.col("module").alias("b")), "target")
        .filter("a <> b").groupBy(F.col("a").alias("source"), F.col("b").alias("target"), "kind").agg(F.sum("weight").alias("weight"))
    )


def architecture_layers(graph: Graph) -> DataFrame:
    """(layer, component, class_count, loc_total, layer_classes, layer_loc): one row per component."""
    layers = graph.of_kind("LAYER").select("fqn", F.col("name").alias("layer"))
    components = graph.of_kind("COMPONENT").select(
        F.col("fqn").alias("dst"), F.col("name").alias("component"),
        F.col("props")["class_count"].cast("bigint").alias("class_count"), F.col("props")["loc_total"].cast("bigint").alias("loc_total"),
    )
    inside = graph.edges_of("CONTAINS").select(F.col("src").alias("fqn"), "dst").distinct().join(components, "dst")
    totals = inside.groupBy("fqn").agg(F.sum("class_count").alias("layer_classes"), F.sum("loc_total").alias("layer_loc"))
    return layers.join(inside, "fqn", "left").join(totals, "fqn", "left").select(
        "layer", "component", "class_count", "loc_total",
        F.coalesce("layer_classes", F.lit(0)).alias("layer_classes"), F.coalesce("layer_loc", F.lit(0)).alias("layer_loc"),
    )


def component_links(graph: Graph) -> DataFrame:
    """(source, target, weight, kinds): edges between members of two components."""
    graph = narrowed(graph, ["fqn", "kind"], ["src", "dst", "kind"], ["COMPONENT"], ["CONTAINS", *COMPONENT_LINKS])
    components = graph.of_kind("COMPONENT").select(F.col("fqn").alias("src"))
    members = graph.edges_of("CONTAINS").join(components, "src", "left_semi").select(
        F.col("src").alias("component"), F.col("dst").alias("fqn")
    ).distinct()
    members = materialize(members, "members")
    pairs = graph.edges_of(*COMPONENT_LINKS).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    return (
        pairs.join(members.select(F.col("fqn").alias("src"), F.col("component").alias("source")), "src")
        .join(members.select(F.col("fqn").alias("dst"), F.col("component").alias("target")), "dst")
        .filter("source <> target").groupBy("source", "target", "kind").agg(F.sum("n").alias("n"))
        # At most seven kinds per pair, so the set stays small.
        .groupBy("source", "target").agg(F.sum("n").alias("weight"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    )


def architecture_extract(graph: Graph, level: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the module view, or of the class view."""
    kind, links = ("MODULE", ["IMPORTS", "DEPENDS_ON"]) if level == "module" else ("CLASS", ["DEPENDS_ON"])
    nodes = graph.of_kind(kind).select("fqn", "name", F.col("kind").alias("type"), "loc")
    edges = graph.edges_of(*links)
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("fqn").alias(end)), end, "left_semi")
    return nodes, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight")


def module_list(graph: Graph) -> DataFrame:
    """Every module with its class count, zero included."""
    counts = class_modules(graph).groupBy(F.col("module_fqn").alias("fqn")).agg(F.count("*").alias("class_count"))
    return graph.of_kind("MODULE").select("fqn", "name").join(counts, "fqn", "left").select("fqn", "name", F.coalesce("class_count", F.lit(0)).alias("class_count"))


def application_list(graph: Graph, projects: DataFrame) -> DataFrame:
    """Applications with module counts, repository and branch; ``unknown`` where not linked."""
    modules = graph.of_kind("MODULE").groupBy("app_name").agg(F.count("*").alias("module_count"))
    apps = graph.of_kind("APPLICATION").select("app_name", "name")
    return (
        apps.join(modules, "app_name", "left").join(projects.select(F.col("id").alias("app_name"), "repository", "branch"), "app_name", "left")
        .select(
            "app_name", F.coalesce("module_count", F.lit(0)).alias("module_count"),
            F.coalesce("repository", F.lit("unknown")).alias("repository"), F.coalesce("branch", F.lit("unknown")).alias("branch"),
        )
    )


def transaction_edges(graph: Graph, transactions: DataFrame) -> DataFrame:
    """(transaction, src, dst, kind): edges with both ends inside a transaction."""
    graph = narrowed(graph, ["fqn", "kind"], ["src", "dst", "kind"], ["TRANSACTION"], ["INCLUDES", *FLOW_EDGES])
    members = graph.edges_of("INCLUDES").join(transactions.select(F.col("fqn").alias("src")), "src", "left_semi").select(
        F.col("src").alias("transaction"), F.col("dst").alias("member")
    ).distinct()
    edges = graph.edges_of(*FLOW_EDGES).select("src", "dst", "kind").distinct()
    return edges_within(members.withColumnRenamed("member", "node"), edges, "transaction")


def affected_transactions(graph: Graph, fqns: DataFrame) -> DataFrame:
    """(fqn, transaction): names of the transactions that include a node."""
    names = graph.of_kind("TRANSACTION").select(F.col("fqn").alias("src"), F.col("name").alias("transaction"))
    return (
        graph.edges_of("INCLUDES").select("src", F.col("dst").alias("fqn")).distinct()
        .join(fqns.select("fqn").distinct(), "fqn", "left_semi").join(names, "src").select("fqn", "transaction").distinct()
    )


def tables_touched(trace_edges: DataFrame) -> DataFrame:
    """(seed, table_name, access_type): last name segment of what a trace reads or writes."""
    return trace_edges.filter(F.col("type").isin("READS", "WRITES")).select(
        "seed", F.substring_index("target", ":", -1).alias("table_name"), F.col("type").alias("access_type")
    ).distinct()


# --- hashes ------------------------------------------------------------------------------


#: Neighbours whose names are joined before they are hashed.
RANGE = 256


def range_texts(rows: DataFrame, size: int = RANGE) -> DataFrame:
    """(key, part, text) of ``rows(key, part, item)``: the sorted items joined by commas, or a tree of digests over them.

    Up to ``size`` items are the text itself. More are cut into ranges of
    ``size``, each of which becomes the SHA-256 of its joined items, and so on
    until one range is left. A hub spreads over its ranges, and no group has more
    than ``size`` rows; repeated items count.
    """
    placed = numbered(rows.select("key", "part", "item"), ["key", "part"], ["item"], "at", start=0)
    texts = placed.groupBy("key", "part", F.floor(F.col("at") / size).alias("run")).agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("text"))
    texts = materialize(texts, "texts")
    while not texts.filter("run > 0").isEmpty():
        last = texts.groupBy("key", "part").agg(F.max("run").alias("last"))
        entry = F.when(F.col("last") > 0, F.sha2("text", 256)).otherwise(F.col("text"))
        above = texts.join(last, ["key", "part"]).select("key", "part", F.floor(F.col("run") / size).alias("next"), F.struct("run", entry.alias("text")).alias("entry"))
        merged = above.groupBy("key", "part", F.col("next").alias("run")).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        texts = materialize(merged.select("key", "part", "run", F.array_join("entries.text", ",").alias("text")), "texts")
    return texts.select("key", "part", "text")


def neighbourhood_hashes(graph: Graph, size: int = RANGE) -> DataFrame:
    """(fqn, graph_hash): SHA-256 of ``fan_in:fan_out:neighbours`` for every calling node, neighbours as in :func:`range_texts`."""
    pairs = graph.edges_of("CALLS").select("src", "dst").distinct()
    into = pairs.select(F.col("dst").alias("key"), F.col("src").alias("item"))
    out = pairs.select(F.col("src").alias("key"), F.col("dst").alias("item"))
    texts = range_texts(into.unionByName(out).withColumn("part", F.lit(0)), size)
    fans = distinct_fans(graph).select(F.col("fqn").alias("key"), "fan_in", "fan_out")
    text = F.concat_ws(":", F.col("fan_in").cast("string"), F.col("fan_out").cast("string"), "text")
    return fans.join(texts, "key").select(F.col("key").alias("fqn"), F.sha2(text, 256).alias("graph_hash"))


def trace_hashes(trace_nodes: DataFrame, size: int = RANGE) -> DataFrame:
    """(seed, trace_hash): SHA-256 of ``centre:upstream:downstream``, both as in :func:`range_texts`."""
    upstream = F.col("direction") == "upstream"
    texts = range_texts(trace_nodes.select(F.col("seed").alias("key"), F.when(upstream, 0).otherwise(1).alias("part"), F.col("node").alias("item")), size)

    def side(part):
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col("text"))), F.lit(""))

    both = texts.groupBy(F.col("key").alias("seed")).agg(side(0).alias("up"), side(1).alias("down"))
    return both.select("seed", F.sha2(F.concat_ws(":", "seed", "up", "down"), 256).alias("trace_hash"))


# --- comparing two graphs ----------------------------------------------------------------


def compare_graphs(before: Graph, after: Graph, fields: Sequence[str] = ("name", "kind", "path", "line", "end_line", "loc")) -> DataFrame:
    """(item, key, change): nodes and edges added, removed or changed between two builds.

    An edge is a source, kind and target; it has changed when the set of weights,
    confidences and evidences under which it is listed has.
    """
    mark = F.xxhash64(*fields)

    def nodes(g, out):
        return g.nodes.select(F.col("fqn").alias("key"), mark.alias(out))

    def edges(g, out):
        listed = g.edges.select(F.concat_ws(" ", "src", "kind", "dst").alias("key"), F.xxhash64("weight", "confidence", "evidence").alias("_mark"))
        return listed.distinct().groupBy("key").agg(F.bit_xor("_mark").alias(out))

    parts = []
    for item, rows in (("node", nodes), ("edge", edges)):
        both = rows(before, "old").join(rows(after, "new"), "key", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        parts.append(both.select(F.lit(item).alias("item"), "key", change.alias("change")).filter("change IS NOT NULL"))
    return parts[0].unionByName(parts[1])


# --- sets and short lists ----------------------------------------------------------------


def capped_partners(graph: Graph, limit: int = 50, kind: str = "CALLS") -> DataFrame:
    """(fqn, partner): the first ``limit`` callers of each node by name.

    The rank filter is pushed below the shuffle, so at most ``limit`` rows per node and task move.
    """
    pairs = graph.edges_of(kind).select(F.col("dst").alias("fqn"), F.col("src").alias("partner")).distinct()
    rank = F.row_number().over(Window.partitionBy("fqn").orderBy("partner"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def without_incoming(graph: Graph, kind: str, *links: str) -> DataFrame:
    """(fqn): nodes of ``kind`` that no edge of the kinds ``links`` points at."""
    targets = graph.edges_of(*links).select(F.col("dst").alias("fqn")).distinct()
    return graph.of_kind(kind).select("fqn").join(targets, "fqn", "left_anti")


def annotated(graph: Graph, names: Sequence[str]) -> DataFrame:
    """(fqn): nodes that carry one of the annotations ``names``."""
    return graph.nodes.filter(F.arrays_overlap("annotations", F.array(*[F.lit(n) for n in names]))).select("fqn")


def distinct_edge_counts(graph: Graph) -> DataFrame:
    """(kind, pairs): different (source, target) pairs of each edge kind."""
    return graph.edges.select("src", "dst", "kind").distinct().groupBy("kind").agg(F.count("*").alias("pairs"))
