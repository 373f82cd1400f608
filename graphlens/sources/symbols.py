"""Symbol index rows and source lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.text import path_glob_regex
from graphlens.graph import Graph

INDEX_SCHEMA = (
    "documents array<struct<relative_path:string, occurrences:array<struct<range:array<int>, symbol:string, symbol_roles:int>>, "
    "symbols:array<struct<symbol:string, documentation:array<string>, relationships:array<struct<symbol:string, is_implementation:boolean>>>>>>"
)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index files as JSON, one index per line."""
    return spark.read.schema(INDEX_SCHEMA).json(path)


def positions(span: Column) -> list[Column]:
    """Start and end of a range: three numbers stay on one line, four span lines."""
    four = F.size(span) == 4
    return [
        F.get(span, F.lit(0)).alias("start_line"), F.get(span, F.lit(1)).alias("start_col"),
        F.when(four, F.get(span, F.lit(2))).otherwise(F.get(span, F.lit(0))).alias("end_line"),
        F.when(four, F.get(span, F.lit(3))).otherwise(F.get(span, F.lit(2))).alias("end_col"),
    ]


def occurrences(index: DataFrame) -> DataFrame:
    docs = index.select(F.posexplode("documents").alias("doc", "d"))
    rows = docs.select("doc", "d.relative_path", F.posexplode("d.occurrences").alias("pos", "o"))
    seq = F.col("doc").cast("bigint") * (1 << 32) + F.col("pos")
    return rows.select("relative_path", "o.symbol", F.col("o.symbol_roles").alias("roles"), *positions(F.col("o.range")), seq.alias("seq"))


def symbol_info(index: DataFrame) -> DataFrame:
    return index.select(F.explode("documents").alias("d")).select(F.explode("d.symbols").alias("s")).select("s.*")


# --- source lines ------------------------------------------------------------------------


def source_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) with line numbers from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


def line_windows(files: DataFrame, wanted: DataFrame, context: int = 30) -> DataFrame:
    """Lines around ``wanted(path, at)``: from ``at - context`` to ``at + context``.

    Slicing happens before the explode, so only the lines asked for become rows.
    """
    lines = F.split("text", "\n", -1)
    start = F.greatest(F.lit(0), F.col("at") - context - 1)
    window = F.slice(lines, start + 1, F.greatest(F.col("at") + context - start, F.lit(0)))
    rows = files.select("path", "text").join(wanted, "path").withColumn("start", start)
    return rows.select("path", "at", "start", F.posexplode(window).alias("pos", "line")).select(
        "path", "at", (F.col("start") + F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def node_source(graph: Graph, files: DataFrame, longest: int = 200) -> DataFrame:
    """(fqn, line_no, line): the lines of each node, at most ``longest``."""
    lines = F.split("text", "\n", -1)
    start = F.greatest(F.coalesce("line", F.lit(1)) - 1, F.lit(0))
    end = F.least(F.coalesce(F.when(F.col("end_line") != 0, F.col("end_line")), F.size(lines)), F.size(lines))
    count = F.greatest(F.least(end - start, F.lit(longest)), F.lit(0))
    spans = graph.nodes.filter("path IS NOT NULL").select("fqn", "path", "line", "end_line")
    rows = spans.join(files.select("path", "text"), "path").withColumn("start", start).withColumn("count", count)
    return rows.select("fqn", "start", F.posexplode(F.slice(lines, F.col("start") + 1, F.col("count"))).alias("pos", "line")).select(
        "fqn", (F.col("start") + F.col("pos") + 1).alias("line_no"), "line"
    )


def find_files(files: DataFrame, pattern: str, limit: int | None = 100) -> DataFrame:
    """(path, modified) of the files whose path matches, newest first and then by path; ``files(path, modified)``."""
    hits = files.filter(F.col("path").rlike(path_glob_regex(pattern))).select("path", "modified")
    return hits if limit is None else hits.orderBy(F.desc("modified"), "path").limit(limit)


def grep(files: DataFrame, pattern: str, path_regex: str = ".*") -> DataFrame:
    """(path, line_no, line) of source lines that match."""
    hits = source_lines(files.filter(F.col("path").rlike(path_regex)))
    return hits.filter(F.col("line").rlike(pattern))
