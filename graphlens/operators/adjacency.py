"""A graph whose edges are stored by both ends, for walks that touch only what they meet.

:func:`store_graph` writes the edges twice, bucketed and sorted by ``src`` and by
``dst``, in a folder per project and kind. A hop reads one of the two:

* a frontier of at most ``FEW`` distinct nodes becomes a list in the filter, so
  Spark opens only the buckets of these nodes, and in them only the row groups
  whose range holds one;
* a larger frontier is joined on the bucket column, and only the frontier is
  shuffled.

The kinds of a question select folders, so other edges are not opened at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import materialize, shared_dir
from graphlens.graph import Graph

#: Distinct frontier nodes that go into a filter, some 100 bytes each.
FEW = 512
#: Edges of a bucket, on average, and the fewest buckets.
BUCKET_EDGES, LEAST_BUCKETS = 2_000_000, 8


@dataclass(frozen=True)
class StoredGraph(Graph):
    """Nodes and edges read from storage; ``by_src`` and ``by_dst`` name the two tables of edges."""

    by_src: str = ""
    by_dst: str = ""

    def of_app(self, app: str) -> "StoredGraph":
        own = F.col("app_name") == app
        return StoredGraph(self.nodes.filter(own), self.edges.filter(own), self.by_src, self.by_dst)

    def drop(self) -> None:
        """Takes the two tables out of the catalogue and removes their files."""
        spark = self.nodes.sparkSession
        for name in (self.by_src, self.by_dst):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def store_graph(graph: Graph) -> StoredGraph:
    """Writes the graph once; walks over the result read it in place."""
    spark = graph.nodes.sparkSession
    nodes = materialize(graph.nodes, "nodes")
    edges = materialize(graph.edges, "edges")
    buckets = max(LEAST_BUCKETS, -(-edges.count() // BUCKET_EDGES))
    names = []
    for key in ("src", "dst"):
        name = f"graph_edges_by_{key}_{uuid.uuid4().hex}"
        rows = edges.select("src", "dst", "app_name", "kind").repartition(buckets, key)
        path = f"{shared_dir(spark)}/graphlens/{name}"
        rows.write.partitionBy("app_name", "kind").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        names.append(name)
    return StoredGraph(nodes, edges, *names)


@dataclass(frozen=True)
class Hops:
    """Hops ``a, b`` of some kinds in a stored graph; ``in`` goes against the edges, ``both`` either way."""

    graph: StoredGraph
    kinds: tuple[str, ...] | None
    direction: str = "out"

    def near(self, frontier: DataFrame, node: str = "node") -> DataFrame:
        """The hops that begin at a node of the frontier, others perhaps among them."""
        return self._read(frontier, node, "a")

    def ending(self, frontier: DataFrame, node: str = "node") -> DataFrame:
        """The hops that end at a node of the frontier, others perhaps among them."""
        return self._read(frontier, node, "b")

    def _read(self, frontier: DataFrame, node: str, end: str) -> DataFrame:
        few = [r[0] for r in frontier.select(node).filter(F.col(node).isNotNull()).distinct().limit(FEW + 1).collect()]
        parts = []
        for way in ("out", "in") if self.direction == "both" else (self.direction,):
            key, other = ("src", "dst") if (way == "out") == (end == "a") else ("dst", "src")
            edges = frontier.sparkSession.table(self.graph.by_src if key == "src" else self.graph.by_dst)
            if self.kinds is not None:
                edges = edges.filter(F.col("kind").isin(*self.kinds))
            if len(few) <= FEW:
                edges = edges.filter(F.col(key).isin(few))
            parts.append(edges.select(F.col(key).alias(end), F.col(other).alias("b" if end == "a" else "a")).select("a", "b"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
