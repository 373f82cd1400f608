"""Change sets: diffs to nodes, blast radius, drift, risk and triage for many pull requests at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, materialize, numbered, overlap_join
from graphlens.functions.text import glob_regex, module_of_fqn, module_of_path
from graphlens.graph import Graph
from graphlens.operators import traverse
from graphlens.operators.seed_sets import SeedSets, seed_sets, walk
from graphlens.operators.structure import union
from graphlens.operators.traverse import reach, steps
from graphlens.schema import node_label

# Kinds a diff can touch.
CHANGEABLE = ["CLASS", "FUNCTION", "INTERFACE", "FIELD", "API_ENDPOINT"]
HUB_RANK = 0.05

# File categories in the order they are tried.
FILE_CATEGORIES = [
    ("migration", [
        "*/migrations/*", "*/db/migrate/*", "*flyway*", "*liquibase*", "*/alembic/versions/*", "*/alembic/*",
        "alembic/versions/*", "alembic/*",
    ]),
    ("test", ["*/test_*", "*/tests/*", "*_test.*", "*.test.*", "*.spec.*", "*/test/*", "*/__tests__/*"]),
    ("infra", [
        "Dockerfile", "docker-compose*", "*.dockerfile", ".github/workflows/*", ".gitlab-ci*", "Jenkinsfile",
        "*.tf", "*.tfvars", "helm/*", "k8s/*", "kubernetes/*",
    ]),
    ("config", [
        ".env", ".env.*", "*.yml", "*.yaml", "*.toml", "*.ini", "*.cfg", "*.properties", "application.*",
        "*.config.*", "*.json", "pyproject.toml", "package.json", "tsconfig.json",
    ]),
    ("docs", ["*.md", "*.rst", "*.txt", "docs/*", "README*", "CHANGELOG*", "LICENSE*"]),
]


# --- diffs to nodes ----------------------------------------------------------------------


def _changeable(graph: Graph) -> DataFrame:
    return graph.nodes.filter(F.col("kind").isin(*CHANGEABLE)).select(
        F.col("path").alias("query_path"), "fqn", "name", node_label(F.col("kind")).alias("type"), "line", "end_line", "language"
    )


def nodes_in_hunks(graph: Graph, hunks: DataFrame) -> DataFrame:
    """Nodes whose lines overlap a hunk: ``hunks(query_path, new_start, new_end, …)``."""
    spans = _changeable(graph).filter("line IS NOT NULL AND end_line IS NOT NULL")
    return overlap_join(hunks, spans, ["query_path"], ("new_start", "new_end"), ("line", "end_line"))


def nodes_in_files(graph: Graph, files: DataFrame) -> DataFrame:
    """Every changeable node of the given files: ``files(query_path, …)``."""
    return files.join(_changeable(graph), "query_path")


def map_diffs(graph: Graph, diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, files) of ``diffs(pr_id, path, status, old_path, hunks)``.

    changed: pr_id, path, fqn, name, type, change_type;
    files: pr_id, path, outcome in new, deleted, non_graph.
    """
    target = F.when(F.col("status") == "renamed", F.col("old_path")).otherwise(F.col("path"))
    diffs = diffs.withColumn("query_path", target)
    keep = ["pr_id", "path", "fqn", "name", "type", F.col("status").alias("change_type")]
    has_hunks = F.coalesce(F.size("hunks"), F.lit(0)) > 0
    live = diffs.filter(~F.col("status").isin("added", "deleted"))
    by_hunk = live.filter(has_hunks).select("pr_id", "path", "status", "query_path", F.explode("hunks").alias("h")).select(
        "pr_id", "path", "status", "query_path", F.col("h.new_start").alias("new_start"),
        (F.col("h.new_start") + F.col("h.new_count") - 1).alias("new_end"),
    ).distinct()
    # Equal hunks and repeated files fold before they meet the nodes.
    whole = diffs.filter((F.col("status") == "deleted") | (~F.col("status").isin("added", "deleted") & ~has_hunks)).select(
        "pr_id", "path", "status", "query_path"
    ).distinct()
    changed = materialize(
        nodes_in_hunks(graph, by_hunk).select(*keep).unionByName(nodes_in_files(graph, whole).select(*keep)).distinct(), "changed"
    )
    misses = live.select("pr_id", "path").distinct().join(changed.select("pr_id", "path").distinct(), ["pr_id", "path"], "left_anti")
    listed = diffs.filter(F.col("status").isin("added", "deleted")).select(
        "pr_id", "path", F.when(F.col("status") == "added", "new").otherwise("deleted").alias("outcome")
    )
    return changed, listed.unionByName(misses.withColumn("outcome", F.lit("non_graph")))


def diff_totals(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("pr_id").agg(
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files")
    )


# --- blast radius ------------------------------------------------------------------------


def impact_sets(graph: Graph, changed: DataFrame, max_depth: int = 5) -> SeedSets:
    """Rows (block, fqn, side, depth, bits, first): the pull requests that affect a node on a side at a depth, changed nodes excluded.

    Both sides walk all changed nodes of all requests together, 64 requests a row. ``first`` leaves out what a request affects
    downstream, too. A node's own members are no dependents of it, so what lies under a changed node is looked at once more.
    """
    touched = materialize(changed.select(F.col("pr_id").alias("seed"), F.col("fqn").alias("node")).distinct(), "touched")
    graph = traverse.stored_edges(graph, *{"CONTAINS", *traverse.DOWNSTREAM, *traverse.UPSTREAM})
    starts = seed_sets(touched)
    down = walk(steps(graph.edges, traverse.DOWNSTREAM), starts, max_depth).rows
    up = walk(steps(graph.edges, traverse.UPSTREAM, "in"), traverse.contained(graph, starts), max_depth, again=True).folded("node")
    members = materialize(_under_changed(up, starts).spread().select("seed", "node"), "members")
    if not members.isEmpty():
        members = members.join(_dependents_of_others(graph, touched, members, max_depth), ["seed", "node"], "left_anti")
    own = starts.of(members, "node").rows
    parts = {"touched": starts.rows, "own": own, "up": up.rows} | {f"down{k}": down.filter(F.col("depth") == k) for k in range(1, max_depth + 1)}
    tagged = union([rows.select("block", "node", "bits", F.lit(part).alias("part")) for part, rows in parts.items()])
    bits = lambda part: F.coalesce(F.bit_or(F.when(F.col("part") == part, F.col("bits"))), F.lit(0).cast("long")).alias(part)
    sides = tagged.groupBy("block", F.col("node").alias("fqn")).agg(*[bits(part) for part in parts])
    below = " | ".join(f"down{k}" for k in range(1, max_depth + 1))
    row = "struct('{}' AS side, {} AS depth, {} AS bits, {} AS first)".format
    rows = [row("downstream", k, f"down{k} & ~touched", f"down{k} & ~touched") for k in range(1, max_depth + 1)]
    rows.append(row("upstream", 1, "up & ~own & ~touched", f"up & ~own & ~touched & ~({below})"))
    found = sides.select("block", "fqn", F.explode(F.expr(f"array({', '.join(rows)})")).alias("row")).select("block", "fqn", "row.*").filter("bits <> 0")
    return starts.with_rows(materialize(found, "impact"))


def _under_changed(up: SeedSets, starts: SeedSets) -> SeedSets:
    """The part of ``up`` that lies under a changed node of the same request by its name."""
    pieces = F.expr("transform(sequence(1, size(split(node, '[.]')) - 1), n -> array_join(slice(split(node, '[.]'), 1, n), '.'))")
    dotted = up.rows.filter(F.col("node").contains(".")).select("block", "node", "bits", F.explode(pieces).alias("above"))
    owners = starts.rows.select("block", F.col("node").alias("above"), F.col("bits").alias("owner"))
    return up.with_rows(dotted.join(owners, ["block", "above"]).select("block", "node", F.expr("bits & owner").alias("bits")).filter("bits <> 0")).folded("node")


def _dependents_of_others(graph: Graph, touched: DataFrame, members: DataFrame, max_depth: int) -> DataFrame:
    """The ``members(seed, node)`` that depend on a changed node of the request that they do not lie under."""
    starts = seed_sets(traverse.self_seeds(members.select(F.col("node").alias("fqn"))))
    reached = walk(steps(graph.edges, traverse.UPSTREAM), starts, max_depth, again=True)
    above = walk(steps(graph.edges, ["CONTAINS"], "in"), reached, 10, include_start=True).folded("node").spread("member")
    named = above.select("member", F.col("node").alias("other")).join(touched.select("seed", F.col("node").alias("other")), "other")
    kept = named.filter(~F.col("member").startswith(F.concat("other", F.lit("."))) & (F.col("member") != F.col("other")))
    return kept.select("seed", F.col("member").alias("node")).distinct()


def pull_request_impact(graph: Graph, changed: DataFrame, max_depth: int = 5) -> DataFrame:
    """(pr_id, fqn, depth, side): what each pull request affects, changed nodes excluded."""
    return impact_sets(graph, changed, max_depth).spread("pr_id").select("pr_id", "fqn", "depth", "side")


def unique_affected(impact: DataFrame | SeedSets) -> DataFrame | SeedSets:
    """(pr_id, fqn, depth): both sides as one list; a node found downstream keeps that depth. Sets give sets."""
    if isinstance(impact, SeedSets):
        return impact.with_rows(impact.rows.filter("first <> 0").select("block", "fqn", "depth", F.col("first").alias("bits")))
    ranked = impact.withColumn("rank", F.when(F.col("side") == "downstream", 0).otherwise(1))
    return first_by(ranked, ["pr_id", "fqn"], ["rank", "depth"], ["depth"])


def _counted(affected: DataFrame | SeedSets, out: str, info: DataFrame | None = None, *columns: str) -> DataFrame:
    """(pr_id, *columns, out): affected nodes by the columns of ``info(fqn, …)``; sets meet it and are counted before they become pairs."""
    if isinstance(affected, SeedSets):
        rows = affected.rows if info is None else affected.rows.join(info, "fqn")
        return affected.with_rows(rows).counted("pr_id", out, *columns)
    return (affected if info is None else affected.join(info, "fqn")).groupBy("pr_id", *columns).agg(F.count("*").alias(out))


def impact_breakdown(graph: Graph, affected: DataFrame | SeedSets) -> DataFrame:
    """(pr_id, grouping, value, nodes): totals by type, depth, layer and module in one pass."""
    info = graph.nodes.select("fqn", node_label(F.col("kind")).alias("type"), "layer", "module")
    counted = _counted(affected, "n", info, "type", "depth", "layer", "module")
    named = counted.withColumn(
        "facet",
        F.explode(F.array(
            F.struct(F.lit("total").alias("grouping"), F.lit("all").alias("value")),
            F.struct(F.lit("type").alias("grouping"), F.col("type").alias("value")),
            F.struct(F.lit("depth").alias("grouping"), F.col("depth").cast("string").alias("value")),
            F.struct(F.lit("layer").alias("grouping"), F.col("layer").alias("value")),
            F.struct(F.lit("module").alias("grouping"), F.col("module").alias("value")),
        )),
    )
    rows = named.select("pr_id", "facet.*", "n").filter("value IS NOT NULL")
    return rows.groupBy("pr_id", "grouping", "value").agg(F.sum("n").alias("nodes"))


def changed_enriched(graph: Graph, changed: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(pr_id, fqn, fan_in, is_hub) of changed nodes; ``ranks(fqn, pagerank)``."""
    calls = graph.edges_of("CALLS").select("src", F.col("dst").alias("fqn")).distinct()
    fans = calls.groupBy("fqn").agg(F.count("*").alias("fan_in"))
    rows = changed.select("pr_id", "fqn").distinct().join(fans, "fqn", "left")
    hub = F.lit(False)
    if ranks is not None:
        rows, hub = rows.join(ranks, "fqn", "left"), F.coalesce(F.col("pagerank") > HUB_RANK, F.lit(False))
    return rows.select("pr_id", "fqn", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), hub.alias("is_hub"))


def cross_technology_impacts(graph: Graph, changed: DataFrame) -> DataFrame:
    """(pr_id, kind, name): distinct endpoints, topics and tables behind a pull request."""
    seeds = changed.select(F.col("pr_id").alias("seed"), F.col("fqn").alias("node")).distinct()
    return traverse.cross_technology_sets(graph, seeds).folded("kind", "name").spread("pr_id")


# --- risk --------------------------------------------------------------------------------


def risk_score(blast: Column, has_hub: Column, cross_tech: Column, max_fan_in: Column, layers: Column) -> Column:
    return (
        F.when(blast > 50, 3).when(blast > 20, 2).when(blast > 5, 1).otherwise(0)
        + F.when(has_hub, 3).otherwise(0)
        + F.when(cross_tech > 3, 2).when(cross_tech > 0, 1).otherwise(0)
        + F.when(max_fan_in > 15, 2).when(max_fan_in > 5, 1).otherwise(0)
        + F.when(layers >= 3, 1).otherwise(0)
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 7, "High").when(score >= 3, "Medium").otherwise("Low")


def risk_report(graph: Graph, changed: DataFrame, affected: DataFrame | SeedSets, cross: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """One row per pull request with its risk factors, score and level."""
    nodes = changed_enriched(graph, changed, ranks).groupBy("pr_id").agg(
        F.max("fan_in").alias("max_fan_in"), F.max("is_hub").alias("has_hub"), F.count("*").alias("changed_nodes")
    )
    layers = graph.nodes.filter("layer IS NOT NULL").select("fqn", "layer")
    blast = _counted(affected, "blast_radius")
    spans = _counted(affected, "n", layers, "layer").groupBy("pr_id").agg(F.count("*").alias("layer_span"))
    crossed = cross.groupBy("pr_id").agg(F.count("*").alias("cross_tech"))
    rows = nodes.join(blast, "pr_id", "left").join(spans, "pr_id", "left").join(crossed, "pr_id", "left").na.fill(
        0, ["blast_radius", "layer_span", "cross_tech"]
    )
    score = risk_score(F.col("blast_radius"), F.col("has_hub"), F.col("cross_tech"), F.col("max_fan_in"), F.col("layer_span"))
    return rows.withColumn("score", score).withColumn("risk_level", risk_level(F.col("score")))


# --- drift -------------------------------------------------------------------------------


def containing_modules(graph: Graph) -> DataFrame:
    """(fqn, module): modules at most three containment steps above a node."""
    modules = graph.of_kind("MODULE").select("fqn")
    return reach(steps(graph.edges, ["CONTAINS"]), traverse.self_seeds(modules), 3).select(F.col("node").alias("fqn"), F.col("seed").alias("module"))


def changed_modules(homes: DataFrame, changed: DataFrame) -> DataFrame:
    """(pr_id, module, fqn): changed nodes under each module, one row per node."""
    return changed.select("pr_id", "fqn").distinct().join(homes, "fqn").select("pr_id", "module", "fqn")


def new_module_dependencies(graph: Graph, homes: DataFrame, changed: DataFrame) -> DataFrame:
    """(pr_id, from_module, to_module): module pairs a change connects without an import between them."""
    links = graph.edges_of("CALLS", "DEPENDS_ON", "INJECTS").select(F.col("src").alias("fqn"), "dst").distinct()
    imports = graph.edges_of("IMPORTS").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    names = graph.of_kind("MODULE").select("fqn", "name")
    # Links shrink to (node, target module) before the requests are joined in.
    outgoing = (
        links.join(homes.select(F.col("fqn").alias("dst"), F.col("module").alias("b")), "dst").select("fqn", "b").distinct()
        .join(homes.withColumnRenamed("module", "a"), "fqn").filter("a <> b")
        .join(imports, ["a", "b"], "left_anti")
    )
    pairs = changed.select("pr_id", "fqn").distinct().join(outgoing, "fqn").select("pr_id", "a", "b").distinct()
    return (
        pairs.join(names.select(F.col("fqn").alias("a"), F.col("name").alias("from_module")), "a")
        .join(names.select(F.col("fqn").alias("b"), F.col("name").alias("to_module")), "b")
        .select("pr_id", "from_module", "to_module").distinct()
    )


def drift_cycles(graph: Graph, homes: DataFrame, changed: DataFrame) -> DataFrame:
    """(pr_id, cycle): closed trails through a changed module, as module names."""
    modules = changed_modules(homes, changed).select("pr_id", "module").distinct()
    edges = graph.edges_of("IMPORTS", "DEPENDS_ON").select("src", "dst", F.concat_ws(">", "kind", "src", "dst").alias("edge_id")).distinct()
    trails = traverse.closed_trails(edges, 2, 6, modules.select(F.col("module").alias("fqn")))
    starts = trails.select("cycle", F.element_at("cycle", 1).alias("module")).join(modules, "module").withColumn("id", F.concat_ws(">", "cycle"))
    names = graph.nodes.select(F.col("fqn").alias("node"), "name")
    return (
        starts.select("pr_id", "id", F.posexplode("cycle").alias("pos", "node")).join(names, "node")
        # A cycle has seven stations at most.
        .groupBy("pr_id", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("c"))
        .select("pr_id", F.array_join("c.name", " > ").alias("cycle")).distinct()
    )


def drift_report(graph: Graph, changed: DataFrame, files: DataFrame) -> DataFrame:
    """(pr_id, finding, detail): new dependencies, cycles touched and new files."""
    homes = materialize(containing_modules(graph), "homes")
    deps = new_module_dependencies(graph, homes, changed).select(
        "pr_id", F.lit("new_dependency").alias("finding"), F.concat_ws(" -> ", "from_module", "to_module").alias("detail")
    )
    cycles = drift_cycles(graph, homes, changed).select("pr_id", F.lit("cycle").alias("finding"), F.col("cycle").alias("detail"))
    fresh = files.filter("outcome = 'new'").select("pr_id", F.lit("new_file").alias("finding"), F.col("path").alias("detail"))
    return deps.unionByName(cycles).unionByName(fresh)


class Analysis(Mapping):
    """The parts of a pull request analysis by name; one is worked out when it is first asked for."""

    def __init__(self, parts: dict[str, Callable[[], DataFrame]]):
        self._parts, self._done = parts, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._parts[name]()
        return self._done[name]

    def __iter__(self):
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def analyse_pull_requests(graph: Graph, diffs: DataFrame, ranks: DataFrame | None = None, max_depth: int = 5) -> Analysis:
    """The whole job for every pull request in ``diffs``: nodes, impact, drift and risk.

    ``sizes(pr_id, changed_nodes, blast_radius)`` and ``new_dependencies`` are what risk and drift say of them, without the rest.
    """
    changed, files = map_diffs(graph, diffs)
    impact = cache(lambda: impact_sets(graph, changed, max_depth))
    affected = cache(lambda: unique_affected(impact()))
    homes = cache(lambda: materialize(containing_modules(graph), "homes"))

    def sizes():
        nodes = changed.select("pr_id", "fqn").distinct().groupBy("pr_id").agg(F.count("*").alias("changed_nodes"))
        return nodes.join(_counted(affected(), "blast_radius"), "pr_id", "left").na.fill(0, ["blast_radius"])

    parts = Analysis({
        "changed": lambda: changed, "files": lambda: files, "impact": lambda: impact().spread("pr_id").select("pr_id", "fqn", "depth", "side"),
        "affected": lambda: affected().spread("pr_id"), "cross_technology": lambda: cross_technology_impacts(graph, changed),
        "breakdown": lambda: impact_breakdown(graph, affected()), "drift": lambda: drift_report(graph, changed, files),
        "risk": lambda: risk_report(graph, changed, affected(), parts["cross_technology"], ranks),
        "sizes": sizes, "new_dependencies": lambda: new_module_dependencies(graph, homes(), changed),
    })
    return parts


def mark_stale(analyses: DataFrame, repositories: DataFrame) -> DataFrame:
    """Completed analyses of the given repositories become ``stale``."""
    rebuilt = repositories.select("repository_id").distinct().withColumn("rebuilt", F.lit(True))
    old = analyses.join(rebuilt, "repository_id", "left")
    status = F.when(F.col("rebuilt") & (F.col("status") == "completed"), "stale").otherwise(F.col("status"))
    return old.withColumn("status", status).select(*analyses.columns)


# --- triage ------------------------------------------------------------------------------


def file_category(path: Column) -> Column:
    """Category of a changed file: ordered globs on the whole path or its base name."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.substring_index(clean, "/", -1)
    out = None
    for category, globs in FILE_CATEGORIES:
        regex = "|".join(f"(?:{glob_regex(g)})" for g in globs)
        hit = clean.rlike(regex) | base.rlike(regex)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("source")


def triage_batches(files: DataFrame, changed: DataFrame, chunk: int = 5) -> DataFrame:
    """(pr_id, batch, module, path): source files in batches of at most ``chunk`` per module.

    ``files(pr_id, path, seq)``. A file takes the module of its first changed
    node, else of its path. Batches are numbered by module, then by file order.
    """
    source = files.filter(file_category(F.col("path")) == "source")
    first = first_by(changed.select("pr_id", "path", "fqn"), ["pr_id", "path"], ["fqn"], ["fqn"])
    homed = source.join(first, ["pr_id", "path"], "left").select(
        "pr_id", "path", "seq", F.coalesce(module_of_fqn(F.col("fqn")), module_of_path(F.col("path"))).alias("module")
    )
    placed = materialize(
        numbered(homed, ["pr_id", "module"], ["seq", "path"], "place").withColumn("chunk", F.floor(F.col("place") / chunk)), "placed"
    )
    batches = numbered(placed.select("pr_id", "module", "chunk").distinct(), ["pr_id"], ["module", "chunk"], "batch")
    return placed.join(batches, ["pr_id", "module", "chunk"]).select("pr_id", "batch", "module", "path")


def merge_runs(counts: dict[int, int], target: int) -> list[list[tuple[int, int, int]]]:
    """Merge the two smallest batches until ``target`` remain; batches as (size, first, end) intervals.

    Batches of equal size are interchangeable runs: a run of n equal batches
    becomes n/2 batches of twice the size in one step, so the work is logarithmic
    in the number of batches.
    """
    runs = [[size, n, [(size, 0, 1)]] for size, n in sorted(counts.items()) if n]
    total = sum(run[1] for run in runs)

    def take(run):
        item = run[2]
        run[1] -= 1
        run[2] = [(c, start + width, width) for c, start, width in item]
        return item

    while total > max(target, 1):
        runs = sorted((r for r in runs if r[1]), key=lambda r: r[0])
        small = runs[0]
        if small[1] >= 2:
            pairs = min(small[1] // 2, total - max(target, 1))
            size, start, width = small[2][0]
            runs.append([small[0] * 2, pairs, [(size, start, width * 2)]])
            small[1] -= 2 * pairs
            small[2] = [(size, start + 2 * pairs * width, width)]
            total -= pairs
        else:
            other = runs[1]
            runs.append([small[0] + other[0], 1, take(small) + take(other)])
            total -= 1
    out = []
    for _size, n, item in (r for r in runs if r[1]):
        for i in range(n):
            out.append([(c, start + i * width, start + (i + 1) * width) for c, start, width in item])
    return out


def merged_batches(batches: DataFrame, max_agents: int = 8, reserved: int = 3) -> DataFrame:
    """(pr_id, batch, merged): batches per pull request merged down to the agents left for code.

    The driver of the merge is one row per request, the number of batches of each
    size; the batches themselves only meet the few intervals of the outcome.
    """
    sizes = batches.groupBy("pr_id", "batch").agg(F.count("*").cast("int").alias("size"))
    ranked = materialize(numbered(sizes, ["pr_id", "size"], ["batch"], "rank"), "ranked")
    counts = ranked.groupBy("pr_id", "size").agg(F.count("*").alias("n")).groupBy("pr_id").agg(F.collect_list("size").alias("sizes"), F.collect_list("n").alias("counts"))
    target = max_agents - reserved

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                groups = merge_runs(dict(zip(map(int, row["sizes"]), map(int, row["counts"]))), target)
                rows += [(row["pr_id"], i, c, lo, hi) for i, group in enumerate(groups) for c, lo, hi in group]
            yield pd.DataFrame(rows, columns=["pr_id", "merged", "size", "lo", "hi"])

    kind = dict(batches.dtypes)["pr_id"]
    outcome = counts.mapInPandas(plan, f"pr_id {kind}, merged int, size int, lo bigint, hi bigint")
    return ranked.join(outcome, ["pr_id", "size"]).filter("rank >= lo AND rank < hi").select("pr_id", "batch", "merged")
