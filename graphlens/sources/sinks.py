"""Writing graphs: node and edge tables per project, stubs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by, materialize
from graphlens.functions.text import owner_name, short_name
from graphlens.graph import Graph, edge_rows, latest_nodes, node_rows
from graphlens.schema import EDGE_SCHEMA, HIGH, NODE_SCHEMA


def storable_edges(graph: Graph) -> DataFrame:
    """Edges whose both ends exist in the same project; the first of (src, dst, kind) wins."""
    known = materialize(graph.nodes.select("app_name", "fqn").distinct(), "known")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(known.withColumnRenamed("fqn", end), ["app_name", end], "left_semi")
    keys = ["app_name", "src", "dst", "kind"]
    return first_by(edges, keys, ["seq", "confidence", "evidence"]).select(*graph.edges.columns)


def write_graph(graph: Graph, folder: str) -> None:
    """Replace the stored rows of every (project, kind) that the graph has.

    Tables are partitioned by project and kind, so a question about one kind of
    one project reads nothing else, and only touched partitions are rewritten.
    """
    for name, rows in (("nodes", latest_nodes(graph.nodes)), ("edges", storable_edges(graph))):
        (
            rows.repartition("app_name", "kind", F.pmod(F.xxhash64("fqn" if name == "nodes" else "src"), F.lit(64)))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_name", "kind").parquet(f"{folder}/{name}")
        )


def replace_project(graph: Graph, folder: str, app_name: str, spark: SparkSession) -> None:
    """Drop a project's stored partitions, then write its new graph.

    Kinds the new graph no longer has are emptied too.
    """
    for name, schema in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA)):
        stored = _stored(spark, folder, name)
        if stored is None:
            continue
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/app_name={app_name}")
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(root):
            system.delete(root, True)
    write_graph(graph.of_app(app_name), folder)


def _stored(spark: SparkSession, folder: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return name if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def read_graph(spark: SparkSession, folder: str) -> Graph:
    """Stored graph; filters on project and kind prune partitions."""
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/edges")
    return Graph(nodes.select(*NODE_SCHEMA.fieldNames()), edges.select(*EDGE_SCHEMA.fieldNames()))


def application_node(graph: Graph, files: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(app_name, languages, frameworks, total_files, total_loc, total_nodes, total_edges): the root per project.

    ``files(app_name, language, loc)``, ``frameworks(app_name, framework)``. The
    lists hold distinct languages and frameworks, both drawn from fixed tables.
    """
    sized = files.groupBy("app_name").agg(
        F.count("*").alias("total_files"), F.sum("loc").alias("total_loc"),
        F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"),
    )
    known = frameworks.groupBy("app_name").agg(F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))
    nodes = graph.nodes.groupBy("app_name").agg(F.count("*").alias("total_nodes"))
    edges = graph.edges.groupBy("app_name").agg(F.count("*").alias("total_edges"))
    return (
        sized.join(known, "app_name", "left").join(nodes, "app_name", "left").join(edges, "app_name", "left")
        .select(
            "app_name", "languages", F.coalesce("frameworks", F.lit("")).alias("frameworks"), "total_files", "total_loc",
            F.coalesce("total_nodes", F.lit(0)).alias("total_nodes"), F.coalesce("total_edges", F.lit(0)).alias("total_edges"),
        )
    )


def stub_hierarchy(graph: Graph) -> Graph:
    """Stub functions and classes for call targets the graph lacks, placed under their module."""
    known = graph.nodes.select("fqn")
    languages = graph.nodes.select(F.col("fqn").alias("src"), "language")
    missing = graph.edges_of("CALLS").select("src", "dst", "seq").join(known.withColumnRenamed("fqn", "dst"), "dst", "left_anti")
    missing = missing.filter(F.length(owner_name(F.col("dst"))) > 0).join(languages, "src", "left")
    targets = first_by(missing, ["dst"], ["seq", "src"], ["language", "seq", "src"]).withColumn("cls", owner_name(F.col("dst")))
    classes = first_by(targets, ["cls"], ["seq", "src"], ["language"]).join(known.withColumnRenamed("fqn", "cls"), "cls", "left_anti")
    classes = classes.join(targets.select(F.col("dst").alias("cls")), "cls", "left_anti")
    modules = graph.of_kind("MODULE").select(F.col("fqn").alias("module"))
    typed = graph.of_kind("CLASS", "INTERFACE").select(F.col("fqn").alias("dst"))
    homes = (
        graph.edges_of("CONTAINS").select(F.col("src").alias("module"), "dst", "seq").join(modules, "module", "left_semi")
        .join(typed, "dst", "left_semi").withColumn("package", owner_name(F.col("dst"))).filter("package <> ''")
    )
    packages = last_by(homes, ["package"], ["seq", "dst"], ["module"])
    stub = F.create_map(F.lit("stub"), F.lit("true"))

    def rows(df, column, kind):
        return node_rows(df.select(F.col(column).alias("fqn"), short_name(F.col(column)).alias("name"), F.lit(kind).alias("kind"), "language", stub.alias("props")))

    def contains(df, src, dst):
        return edge_rows(
            df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit("CONTAINS").alias("kind"), F.lit(HIGH).alias("confidence"), F.lit("stub-hierarchy").alias("evidence"))
        )

    placed = classes.withColumn("package", owner_name(F.col("cls"))).join(packages, "package")
    return Graph(
        rows(targets, "dst", "FUNCTION").unionByName(rows(classes, "cls", "CLASS")),
        contains(targets, "cls", "dst").unionByName(contains(placed, "module", "cls")),
    )


# --- exports -----------------------------------------------------------------------------


def node_export(graph: Graph, kinds: list[str] | None = None, fields: list[str] = ("fqn", "name", "kind", "language", "loc", "complexity")) -> DataFrame:
    nodes = graph.nodes if kinds is None else graph.of_kind(*kinds)
    return nodes.select(*fields)


def edge_export(graph: Graph, kinds: list[str] | None = None) -> DataFrame:
    """(source, target, type, weight): edges inside the project, weight 1 unless stated."""
    edges = graph.edges if kinds is None else graph.edges_of(*kinds)
    known = graph.nodes.select("app_name", "fqn").distinct()
    for end in ("src", "dst"):
        edges = edges.join(known.withColumnRenamed("fqn", end), ["app_name", end], "left_semi")
    return edges.select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("kind").alias("type"), F.coalesce("weight", F.lit(1)).alias("weight")
    )


def json_lines(graph: Graph, level: str = "class") -> DataFrame:
    """(item, json): the graph as JSON lines; ``module`` keeps only module nodes."""
    nodes = graph.nodes if level == "class" else graph.of_kind("MODULE")
    node = F.to_json(F.struct("fqn", "name", "kind", "language", "loc", "complexity", "layer", "path", "line"))
    edges = edge_export(graph)
    return nodes.select(F.lit("node").alias("item"), node.alias("json")).unionByName(
        edges.select(F.lit("edge").alias("item"), F.to_json(F.struct("source", "target", "type", "weight")).alias("json"))
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
