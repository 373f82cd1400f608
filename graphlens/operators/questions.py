"""Graph questions with arguments as SQL table functions.

``register_questions(graph)`` makes them callable from any SQL text of the session:

    SELECT * FROM graph_search('order', 'Class') ORDER BY fqn LIMIT 50
    SELECT * FROM graph_details('shop.Order.place')
    SELECT * FROM graph_impact('shop.Order', 'upstream', 3)
    SELECT * FROM graph_path('shop.Order', 'table:orders')
    SELECT * FROM graph_transaction('POST /orders')

A function is plain SQL over temporary views, so Catalyst sees through it: constant arguments reach the scans (and the buckets of a
stored graph), and the levels of a walk beyond the wanted depth fold away. Walks keep one row per node and level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.graph import Graph
from graphlens.operators.adjacency import StoredGraph
from graphlens.operators.tools import register_views
from graphlens.operators.traverse import DOWNSTREAM, PATH, UPSTREAM
from graphlens.schema import node_label

#: Depth of the deepest walk, as the questions bound it.
DEEPEST = 10
#: What counts as upstream here: no membership of transactions.
DEPENDENTS = [k for k in UPSTREAM if k != "INCLUDES"]
#: Connections of a path: a path never starts at a transaction's mark.
CONNECTIONS = [k for k in PATH if k != "STARTS_AT"]


def _kinds(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _levels(name: str, table: str, begin: str, end: str, kinds: list[str], start: str, bound: str | None = None) -> list[str]:
    """CTEs ``name``1 to ``name``DEEPEST: the distinct nodes at each number of hops from ``start``."""
    first = f"{begin} = {start}" if start.isidentifier() else f"{begin} IN ({start})"
    within = lambda k: f" AND {k} <= {bound}" if bound else ""
    out = [f"{name}1 AS (SELECT DISTINCT {end} AS node FROM {table} WHERE kind IN ({_kinds(kinds)}) AND {first}{within(1)})"]
    for k in range(2, DEEPEST + 1):
        out.append(f"{name}{k} AS (SELECT DISTINCT {end} AS node FROM {name}{k - 1} JOIN {table} ON {begin} = node WHERE kind IN ({_kinds(kinds)}){within(k)})")
    return out


def _every(name: str) -> str:
    return " UNION ALL ".join(f"SELECT node, {k} AS depth FROM {name}{k}" for k in range(1, DEEPEST + 1))


def _impact() -> str:
    down = _levels("down", "graph_out", "src", "dst", DOWNSTREAM, "start", "if(direction = 'upstream', 0, most)")
    inside = _levels("inside", "graph_out", "src", "dst", ["CONTAINS"], "start", "if(direction = 'upstream', 10, 0)")
    seeds = f"seeds AS (SELECT start AS node WHERE direction = 'upstream' UNION {' UNION '.join(f'SELECT node FROM inside{k}' for k in range(1, DEEPEST + 1))})"
    up = [f"up1 AS (SELECT DISTINCT src AS node FROM seeds JOIN graph_in ON dst = node WHERE kind IN ({_kinds(DEPENDENTS)}) AND 1 <= most)"]
    for k in range(2, DEEPEST + 1):
        up.append(f"up{k} AS (SELECT DISTINCT src AS node FROM up{k - 1} JOIN graph_in ON dst = node WHERE kind IN ({_kinds(DEPENDENTS)}) AND {k} <= most)")
    found = f"found AS ({_every('down')} UNION ALL SELECT node, 1 FROM ({_every('up')}))"
    return f"""WITH {', '.join([*down, *inside, seeds, *up, found])}
      SELECT fqn, name, type, path, CAST(depth AS INT) FROM (SELECT node, min(depth) AS depth FROM found WHERE node <> start GROUP BY node) JOIN graph_labelled ON fqn = node"""


def _path() -> str:
    """Of the shortest paths the one that is first in node order; level by level, one path for each node."""
    hops = f"hops AS (SELECT src AS a, dst AS b FROM graph_out WHERE kind IN ({_kinds(CONNECTIONS)}) UNION ALL SELECT dst, src FROM graph_in WHERE kind IN ({_kinds(CONNECTIONS)}))"
    levels = ["way1 AS (SELECT DISTINCT b AS node, array(a, b) AS way FROM hops WHERE a = source AND b <> source)"]
    for k in range(2, DEEPEST + 1):
        levels.append(f"way{k} AS (SELECT b AS node, min(concat(way, array(b))) AS way FROM way{k - 1} JOIN hops ON a = node WHERE node <> target AND NOT array_contains(way, b) GROUP BY b)")
    ends = " UNION ALL ".join(f"SELECT way FROM way{k} WHERE node = target" for k in range(1, DEEPEST + 1))
    best = f"best AS (SELECT min_by(way, struct(size(way), way)) AS way FROM ({ends}))"
    nodes = "nodes AS (SELECT posexplode(way) AS (position, node), size(way) - 1 AS hops FROM best)"
    return f"WITH {', '.join([hops, *levels, best, nodes])} SELECT CAST(position AS INT), fqn, name, type, CAST(hops AS INT) FROM nodes JOIN graph_labelled ON fqn = node"


#: Name, arguments, columns and body of each function.
QUESTIONS = {
    "graph_search": (
        "wanted STRING, label STRING DEFAULT NULL", "fqn STRING, name STRING, type STRING, language STRING, path STRING",
        """SELECT fqn, name, type, language, path FROM graph_labelled
        WHERE (contains(lower(name), lower(wanted)) OR contains(lower(fqn), lower(wanted))) AND (label IS NULL OR type = label)""",
    ),
    "graph_details": (
        "node STRING", "role STRING, fqn STRING, name STRING, type STRING, path STRING, loc INT",
        """SELECT 'node', fqn, name, type, path, loc FROM graph_labelled WHERE fqn = node
        UNION ALL SELECT 'caller', fqn, name, type, path, loc FROM (SELECT DISTINCT src FROM graph_in WHERE dst = node AND kind = 'CALLS') JOIN graph_labelled ON fqn = src
        UNION ALL SELECT 'callee', fqn, name, type, path, loc FROM (SELECT DISTINCT dst FROM graph_out WHERE src = node AND kind = 'CALLS') JOIN graph_labelled ON fqn = dst""",
    ),
    "graph_impact": ("start STRING, direction STRING DEFAULT 'both', most INT DEFAULT 5", "fqn STRING, name STRING, type STRING, path STRING, depth INT", _impact()),
    "graph_path": ("source STRING, target STRING", "position INT, fqn STRING, name STRING, type STRING, path_length INT", _path()),
    "graph_transaction": (
        "wanted STRING", "part STRING, fqn STRING, name STRING, type STRING, target STRING",
        """WITH members AS (SELECT DISTINCT dst AS node FROM graph_labelled JOIN graph_out ON src = fqn WHERE type = 'Transaction' AND name = wanted AND graph_out.kind = 'INCLUDES')
        SELECT 'node', fqn, name, type, NULL FROM members JOIN graph_labelled ON fqn = node
        UNION ALL SELECT DISTINCT 'edge', src, NULL, kind, dst FROM members a JOIN graph_out ON src = a.node JOIN members b ON dst = b.node WHERE kind = 'CALLS'""",
    ),
}


def register_questions(graph: Graph, edges: DataFrame | None = None) -> list[str]:
    """Registers the views without arguments and the table functions over ``graph``; a stored graph is asked in place.

    ``edges(src, dst, kind)`` are what the functions follow instead of the graph's own, if the kinds of a question are at hand.

    Impact follows the tool's rule: ``upstream`` gives dependents of the node and of all it contains at depth 1, any other direction
    what the node reaches at its shortest depth. Walks end at ``DEEPEST`` hops. Unknown names give no rows.
    """
    spark = graph.nodes.sparkSession
    register_views(graph)
    graph.nodes.withColumn("type", node_label(F.col("kind"))).select("fqn", "name", "type", "language", "path", "loc").createOrReplaceTempView("graph_labelled")
    stored = isinstance(graph, StoredGraph)
    for view, table in (("graph_out", graph.by_src if stored else None), ("graph_in", graph.by_dst if stored else None)):
        followed = edges if edges is not None else spark.table(table) if table else graph.edges
        followed.select("src", "dst", "kind").createOrReplaceTempView(view)
    for name, (arguments, columns, body) in QUESTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    return list(QUESTIONS)
