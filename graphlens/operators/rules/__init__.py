"""Framework rules: each one reads a graph and returns nodes, edges, layers, entry points and warnings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import last_by
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.schema import MEDIUM


@dataclass(frozen=True)
class RuleResult:
    """What one rule found; an absent part is None."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    layers: DataFrame | None = None
    entry_points: DataFrame | None = None
    warnings: DataFrame | None = None


Rule = Callable[[Graph], RuleResult]


def _stack(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def merge_results(graph: Graph, results: Sequence[RuleResult]) -> tuple[Graph, RuleResult]:
    """Graph with all results folded in: last node wins, a later layer wins, the rest appends.

    A node is known by project and name. A rule's node without a project stands
    for the nodes of its name in every project that has one.
    """
    projects = graph.nodes.select(F.col("fqn").alias("_fqn"), F.col("app_name").alias("_app")).distinct()
    nodes = [node_rows(graph.nodes).withColumn("_rank", F.lit(0))]
    layers = []
    for rank, result in enumerate(results, start=1):
        if result.nodes is not None:
            found = node_rows(result.nodes)
            placed = found.join(projects, found["app_name"].isNull() & (found["fqn"] == projects["_fqn"]), "left")
            placed = placed.withColumn("app_name", F.coalesce("app_name", "_app")).drop("_fqn", "_app")
            nodes.append(placed.withColumn("_rank", F.lit(rank)))
        if result.layers is not None:
            layers.append(result.layers.select("fqn", "layer").withColumn("_rank", F.lit(rank)))
    merged = last_by(_stack(nodes), ["app_name", "fqn"], ["_rank", "seq"]).select(*graph.nodes.columns)
    edges = _stack([graph.edges] + [edge_rows(r.edges) for r in results if r.edges is not None])
    chosen = last_by(_stack(layers), ["fqn"], ["_rank", "layer"], ["layer"]) if layers else None
    rest = RuleResult(
        layers=chosen,
        entry_points=_stack([r.entry_points for r in results if r.entry_points is not None]),
        warnings=_stack([r.warnings for r in results if r.warnings is not None]),
    )
    return Graph(merged, edges), rest


def apply_rules(graph: Graph, rules: Sequence[Rule]) -> tuple[Graph, RuleResult]:
    """Run the rules in their declared order; each sees what the earlier ones added."""
    results = []
    current = graph
    for rule in rules:
        result = rule(current)
        results.append(result)
        current = current.plus(nodes=result.nodes, edges=result.edges)
    return merge_results(graph, results)


def active(detections: DataFrame) -> DataFrame:
    """Detections that switch a rule on: MEDIUM and HIGH do, LOW does not."""
    return detections.filter(F.col("confidence") >= MEDIUM)
