"""The graph questions shared by interactive callers, as functions and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphlens.graph import Graph
from graphlens.operators.change import diff_totals, map_diffs
from graphlens.operators.enrich import fan_metrics
from graphlens.operators.traverse import impact, neighbourhood, shortest_paths, trace_route
from graphlens.operators.views import (
    application_list, architecture_extract, call_partners, counts_by_label, distinct_fans, module_list, node_details, search, transaction_edges,
)

__all__ = [
    "application_list", "architecture_extract", "call_partners", "counts_by_label", "diff_totals", "impact", "map_diffs", "module_list",
    "neighbourhood", "node_details", "register_views", "search", "shortest_paths", "trace_route", "transaction_edges",
]

VIEWS = {
    "graph_nodes": lambda g: g.nodes,
    "graph_edges": lambda g: g.edges,
    "graph_modules": module_list,
    "graph_labels": counts_by_label,
    "graph_fans": distinct_fans,
    "graph_class_fans": fan_metrics,
    "graph_call_partners": call_partners,
}


def register_views(graph: Graph) -> list[str]:
    """Register the questions that need no argument as temporary views; plans stay lazy."""
    for name, question in VIEWS.items():
        rows: DataFrame = question(graph)
        rows.createOrReplaceTempView(name)
    return list(VIEWS)
