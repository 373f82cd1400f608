"""The graph value: two DataFrames, ``nodes`` and ``edges``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.functions.scale import last_by
from graphlens.schema import EDGE_SCHEMA, HIGH, NODE_SCHEMA

EDGE_DEFAULTS = {"confidence": HIGH, "evidence": "tree-sitter"}


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Project to ``schema``; columns that are absent become NULL or the default.

    Built as one text projection: wide schemas cost one call instead of hundreds.
    """
    defaults = defaults or {}
    have = set(df.columns)
    out = []
    for field in schema.fields:
        default = repr(defaults[field.name]) if field.name in defaults else None
        if field.name not in have:
            value = default or "NULL"
        elif default:
            value = f"coalesce(`{field.name}`, {default})"
        else:
            value = f"`{field.name}`"
        out.append(f"CAST({value} AS {field.dataType.simpleString()}) AS `{field.name}`")
    return df.selectExpr(*out)


def node_rows(df: DataFrame) -> DataFrame:
    return conform(df, NODE_SCHEMA)


def edge_rows(df: DataFrame) -> DataFrame:
    return conform(df, EDGE_SCHEMA, EDGE_DEFAULTS)


@dataclass(frozen=True)
class Graph:
    """Nodes keyed by ``(app_name, fqn)`` and a bag of edges."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> "Graph":
        return Graph(node_rows(nodes), edge_rows(edges))

    @staticmethod
    def empty(spark: SparkSession) -> "Graph":
        return Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def of_app(self, app: str) -> "Graph":
        return Graph(self.nodes.filter(F.col("app_name") == app), self.edges.filter(F.col("app_name") == app))

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def plus(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> "Graph":
        return Graph(
            self.nodes if nodes is None else self.nodes.unionByName(node_rows(nodes)),
            self.edges if edges is None else self.edges.unionByName(edge_rows(edges)),
        )


def merge(*graphs: Graph) -> Graph:
    """Fold graphs left to right: the last writer of a node wins, edges append."""
    nodes = edges = None
    for rank, graph in enumerate(graphs):
        ranked = graph.nodes.withColumn("_rank", F.lit(rank))
        nodes = ranked if nodes is None else nodes.unionByName(ranked)
        edges = graph.edges if edges is None else edges.unionByName(graph.edges)
    return Graph(latest_nodes(nodes, ["_rank", "seq"]).drop("_rank"), edges)


def latest_nodes(nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Upsert semantics: one row per ``(app_name, fqn)``, the latest ``seq`` wins.

    Maps are not orderable but they are only carried, never compared.
    """
    columns = nodes.columns
    return last_by(nodes, ["app_name", "fqn"], order or ["seq"]).select(*columns)
