"""Dependency injection: annotated beans, service registrations, function dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by, materialize, tiled_join
from graphlens.functions.text import owner_name, short_name
from graphlens.graph import Graph, edge_rows
from graphlens.schema import HIGH, LOW, MEDIUM

# Stereotypes that make a class a bean.
STEREOTYPES = ["Component", "Service", "Repository", "Controller", "RestController", "Configuration"]


def _has(names: list[str]):
    return F.coalesce(F.arrays_overlap("annotations", F.array(*[F.lit(n) for n in names])), F.lit(False))


def children_of(graph: Graph, parents: DataFrame, kind: str, *columns: str) -> DataFrame:
    """(owner, fqn, …): contained nodes of one kind below ``parents(owner)``."""
    inside = graph.of_kind(kind).select("fqn", *columns)
    links = graph.edges_of("CONTAINS").select(F.col("src").alias("owner"), F.col("dst").alias("fqn")).distinct()
    return links.join(parents.select("owner").distinct(), "owner", "left_semi").join(inside, "fqn")


def beans(graph: Graph) -> DataFrame:
    """(bean_type, fqn, bean_name, is_primary, seq): stereotyped classes and factory methods."""
    typed = graph.of_kind("CLASS", "INTERFACE").filter(_has(STEREOTYPES))
    direct = typed.select(
        F.col("name").alias("bean_type"), "fqn", F.col("name").alias("bean_name"), _has(["Primary"]).alias("is_primary"),
        F.struct(F.lit(0).alias("rank"), "seq", "fqn").alias("ord"),
    )
    configs = graph.of_kind("CLASS").filter(_has(["Configuration"])).select(F.col("fqn").alias("owner"))
    made = children_of(graph, configs, "FUNCTION", "name", "annotations", "return_type", "seq").filter(_has(["Bean"]))
    made = made.filter(F.coalesce("return_type", F.lit("")) != "").select(
        F.col("return_type").alias("bean_type"), F.col("owner").alias("fqn"), F.col("name").alias("bean_name"),
        F.lit(False).alias("is_primary"), F.struct(F.lit(1).alias("rank"), "seq", "fqn").alias("ord"),
    )
    return direct.unionByName(made)


def injection_sites(graph: Graph) -> DataFrame:
    """(src, wanted, qualifier): types a bean asks for in fields and constructors."""
    owners = graph.of_kind("CLASS", "INTERFACE").filter(_has(STEREOTYPES)).select(F.col("fqn").alias("owner"))
    fields = children_of(graph, owners, "FIELD", "annotations", "annotation_args", "type").filter(_has(["Autowired"]))
    fields = fields.select(F.col("owner").alias("src"), F.col("type").alias("wanted"), F.col("annotation_args")["Qualifier"].alias("qualifier"))
    built = children_of(graph, owners, "FUNCTION", "is_constructor", "params").filter("is_constructor")
    built = built.select(F.col("owner").alias("src"), F.explode("params").alias("p")).select(
        "src", F.col("p.type").alias("wanted"), F.nullif("p.qualifier", F.lit("")).alias("qualifier")
    )
    return fields.unionByName(built).filter(F.coalesce("wanted", F.lit("")) != "").distinct()


def _candidates(sites: DataFrame, pool: DataFrame) -> DataFrame:
    """(src, qualifier, dst): what serves the types of ``sites(src, wanted, qualifier)``, once however many of a site's types it serves.

    Of several types that a bean asks for under one qualifier and that one candidate serves, the smallest names the pair. That is
    decided on types and sites; the pairs themselves are the answer and are neither shuffled nor compared.
    """
    sites = materialize(sites.distinct(), "open")
    served = pool.select("wanted", F.col("fqn").alias("dst")).distinct().join(sites.select("wanted").distinct(), "wanted", "left_semi")
    served = materialize(served, "served")
    smaller = served.join(served.select("dst", F.col("wanted").alias("less")), "dst").filter("less < wanted")
    smaller = materialize(smaller.select("wanted", "dst", "less"), "smaller")
    rival = sites.select("src", "qualifier", F.col("wanted").alias("less"))
    same = F.col("s.qualifier").eqNullSafe(F.col("r.qualifier")) & (F.col("s.src") == F.col("r.src")) & (F.col("s.less") == F.col("r.less"))
    asked = sites.join(smaller.select("wanted", "less").distinct(), "wanted").alias("s").join(rival.alias("r"), same, "left_semi")
    asked = asked.groupBy("src", "wanted", "qualifier").agg(F.collect_set("less").alias("asked"))
    both = sites.alias("s").join(
        asked.alias("r"), F.col("s.qualifier").eqNullSafe(F.col("r.qualifier")) & (F.col("s.src") == F.col("r.src")) & (F.col("s.wanted") == F.col("r.wanted")), "left"
    ).select("s.*", "r.asked")
    also = served.join(smaller.groupBy("wanted", "dst").agg(F.collect_set("less").alias("also")), ["wanted", "dst"], "left")
    met = tiled_join(materialize(both, "open"), materialize(also, "served"), ["wanted"], "src", "dst")
    return met.filter(~F.coalesce(F.arrays_overlap("asked", "also"), F.lit(False))).select("src", "qualifier", "dst")


def bean_injections(graph: Graph, qualifiers: bool = True) -> DataFrame:
    """INJECTS edges from a bean to what it asks for, one per target, confidence and qualifier; without ``qualifiers`` one per target and confidence.

    A type is served by beans of that name, else by beans that implement the
    interface of that name. One candidate, one primary or the one the qualifier
    names is certain; otherwise every candidate is LOW. Types are summed up once,
    so only ambiguous sites ever meet the single candidates.
    """
    known = materialize(beans(graph), "beans")
    interfaces = first_by(graph.of_kind("INTERFACE").select("name", "fqn", "seq"), ["name"], ["seq", "fqn"], ["fqn"])
    interfaces = interfaces.join(known.select(F.col("bean_type").alias("name")).distinct(), "name", "left_anti")
    implementors = (
        graph.edges_of("IMPLEMENTS").select("src", F.col("dst").alias("fqn")).distinct()
        .join(interfaces.select("fqn", F.col("name").alias("bean_type")), "fqn").drop("fqn")
        .join(graph.nodes.filter(_has(STEREOTYPES)).select(
            F.col("fqn").alias("src"), F.col("name").alias("bean_name"), _has(["Primary"]).alias("is_primary"),
            F.struct(F.lit(2).alias("rank"), "seq", "fqn").alias("ord"),
        ), "src")
        .select("bean_type", F.col("src").alias("fqn"), "bean_name", "is_primary", "ord")
    )
    pool = materialize(known.unionByName(implementors).withColumnRenamed("bean_type", "wanted"), "pool")
    summary = pool.groupBy("wanted").agg(
        F.count("*").alias("n"), F.sum(F.col("is_primary").cast("int")).alias("primaries"),
        F.min_by("fqn", F.when(F.col("is_primary"), F.col("ord"))).alias("primary"), F.min("fqn").alias("only"),
    )
    decapitalised = F.concat(F.lower(F.substring("bean_name", 1, 1)), F.substring("bean_name", 2, 1 << 30))
    labels = pool.select("wanted", "fqn", "ord", F.explode(F.array_distinct(F.array("bean_name", decapitalised))).alias("qualifier"))
    labels = first_by(labels, ["wanted", "qualifier"], ["ord"], ["fqn"]).withColumnRenamed("fqn", "named")
    sites = injection_sites(graph).join(summary, "wanted").join(labels, ["wanted", "qualifier"], "left")
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("primaries") == 1, F.col("primary")).otherwise(F.col("named"))
    sites = materialize(sites.withColumn("dst", chosen), "sites")
    label = F.col("qualifier") if qualifiers else F.lit(None).cast("string").alias("qualifier")
    sure = sites.filter("dst IS NOT NULL").select("src", "dst", F.lit(HIGH).alias("confidence"), label).distinct()
    unsure = _candidates(sites.filter("dst IS NULL").select("src", "wanted", label), pool).select("src", "dst", F.lit(LOW).alias("confidence"), "qualifier")
    return edge_rows(
        sure.unionByName(unsure).withColumn("kind", F.lit("INJECTS")).withColumn("evidence", F.lit("spring-di"))
        .withColumn("props", F.when(F.col("qualifier").isNotNull(), F.create_map(F.lit("qualifier"), F.col("qualifier"))))
    )


# --- service registrations ---------------------------------------------------------------


def _names(graph: Graph) -> DataFrame:
    """(name, fqn) of classes and interfaces; the last one of a name wins."""
    return last_by(graph.of_kind("CLASS", "INTERFACE").select("name", "fqn", "seq"), ["name"], ["seq", "fqn"], ["fqn"])


def resolved_registrations(graph: Graph, registrations: DataFrame) -> DataFrame:
    """Registrations with full names; ``registrations(interface, implementation, key, seq)``.

    A registration without implementation serves itself; ``X<>`` is an open generic.
    """
    names = _names(graph)
    generic = F.col("interface").endswith("<>")
    target = F.when(F.coalesce("implementation", F.lit("")) == "", F.col("interface")).otherwise(F.col("implementation"))
    rows = registrations.withColumn("open_generic", generic).withColumn("implementation", target)
    for column in ("interface", "implementation"):
        key = F.when(F.col("open_generic"), F.regexp_replace(column, "[<>]+$", "")).otherwise(F.col(column))
        rows = rows.withColumn("name", key).join(names.withColumnRenamed("fqn", f"{column}_fqn"), "name", "left").drop("name")
    return rows


def registration_edges(graph: Graph, registrations: DataFrame) -> DataFrame:
    """INJECTS from interface to implementation of every resolved registration."""
    rows = resolved_registrations(graph, registrations).filter("interface_fqn IS NOT NULL AND implementation_fqn IS NOT NULL")
    return edge_rows(
        rows.select(F.col("interface_fqn").alias("src"), F.col("implementation_fqn").alias("dst")).distinct()
        .withColumn("kind", F.lit("INJECTS")).withColumn("evidence", F.lit("aspnet-di"))
    )


def registration_layers(graph: Graph, registrations: DataFrame) -> DataFrame:
    """(fqn, layer) of registered implementations by their names; the last registration wins."""
    rows = resolved_registrations(graph, registrations).filter("implementation_fqn IS NOT NULL")
    nodes = graph.nodes.select(F.col("fqn").alias("implementation_fqn"), "name", "base_class")
    data = (
        F.contains(F.coalesce("base_class", F.lit("")), F.lit("DbContext")) | F.col("name").endswith("DbContext")
        | F.contains("name", F.lit("Repository")) | F.contains("interface", F.lit("Repository"))
    )
    layered = rows.join(nodes, "implementation_fqn").select(
        F.col("implementation_fqn").alias("fqn"), F.when(data, "Data Access").otherwise("Business Logic").alias("layer"), "seq"
    )
    return last_by(layered, ["fqn"], ["seq"], ["layer"])


def constructor_injections(graph: Graph, registrations: DataFrame) -> DataFrame:
    """INJECTS from a class to the service behind each constructor parameter.

    Keyed registration first, then the plain one, then the open generic (MEDIUM).
    """
    rows = resolved_registrations(graph, registrations).filter("implementation_fqn IS NOT NULL")
    bound = rows.filter("interface_fqn IS NOT NULL AND NOT open_generic")
    keyed = last_by(bound.filter("key IS NOT NULL"), ["interface", "key"], ["seq"], ["implementation_fqn"]).withColumnRenamed("implementation_fqn", "by_key")
    plain = last_by(bound.filter("key IS NULL"), ["interface"], ["seq"], ["implementation_fqn"]).withColumnRenamed("implementation_fqn", "by_type")
    generic = last_by(
        rows.filter("open_generic").withColumn("base", F.regexp_replace("interface", "[<>]+$", "")), ["base"], ["seq"], ["implementation_fqn"]
    ).withColumnRenamed("implementation_fqn", "by_base")
    classes = graph.of_kind("CLASS").select(F.col("fqn").alias("owner"))
    asked = children_of(graph, classes, "FUNCTION", "is_constructor", "params").filter("is_constructor").select(
        F.col("owner").alias("src"), F.explode("params").alias("p")
    )
    keyed_param = F.array_contains(F.coalesce("p.annotations", F.array().cast("array<string>")), "FromKeyedServices")
    asked = asked.select(
        "src", F.col("p.type").alias("interface"), F.when(keyed_param, F.nullif("p.qualifier", F.lit(""))).alias("key"),
        F.when(F.contains("p.type", F.lit("<")), F.substring_index("p.type", "<", 1)).alias("base"),
    ).filter(F.coalesce("interface", F.lit("")) != "").distinct()
    found = asked.join(keyed, ["interface", "key"], "left").join(plain, "interface", "left").join(generic, "base", "left")
    target = F.coalesce("by_key", "by_type", "by_base")
    confidence = F.when(F.coalesce("by_key", "by_type").isNotNull(), HIGH).otherwise(MEDIUM)
    return edge_rows(
        found.select("src", target.alias("dst"), confidence.alias("confidence")).filter("dst IS NOT NULL")
        .withColumn("kind", F.lit("INJECTS")).withColumn("evidence", F.lit("aspnet-di"))
    )


# --- function dependencies ---------------------------------------------------------------


def resolve_references(graph: Graph, wanted: DataFrame) -> DataFrame:
    """(scope, ref, fqn) of ``wanted(scope, ref)``: scope.ref, then the full name, then any ``.ref``."""
    wanted = wanted.select("scope", "ref").distinct()
    known = graph.nodes.select("fqn")
    local = wanted.withColumn("fqn", F.concat_ws(".", "scope", "ref")).join(known, "fqn", "left_semi").select("scope", "ref", "fqn", F.lit(0).alias("rung"))
    full = wanted.join(known.withColumn("ref", F.col("fqn")), "ref").select("scope", "ref", "fqn", F.lit(1).alias("rung"))
    # Bare names meet one row per last segment; dotted ones one row per two-segment tail.
    tails = graph.nodes.filter(F.contains("fqn", F.lit("."))).select("fqn", "seq", short_name(F.col("fqn")).alias("tail"))
    bare = first_by(tails, ["tail"], ["seq", "fqn"], ["fqn"])
    by_tail = wanted.filter(~F.contains("ref", F.lit("."))).join(bare.withColumnRenamed("tail", "ref"), "ref")
    dotted = wanted.filter(F.contains("ref", F.lit("."))).withColumn("tail", short_name(F.col("ref")))
    by_path = dotted.join(tails, "tail").filter(F.endswith("fqn", F.concat(F.lit("."), "ref")))
    by_path = first_by(by_path, ["scope", "ref"], ["seq", "fqn"], ["fqn"])
    suffix = by_tail.select("scope", "ref", "fqn").unionByName(by_path).withColumn("rung", F.lit(2))
    return first_by(local.unionByName(full).unionByName(suffix), ["scope", "ref"], ["rung"], ["fqn"])


def function_dependencies(graph: Graph) -> DataFrame:
    """INJECTS from a dependency function to the handler whose parameter declares it."""
    params = graph.of_kind("FUNCTION").filter("language = 'python'").select(F.col("fqn").alias("dst"), F.explode("params").alias("p"))
    ref = F.regexp_extract("p.qualifier", r"\bDepends\s*\(\s*(?:dependency\s*=\s*)?([A-Za-z_][\w.]*)\s*[,)]", 1)
    asked = params.select("dst", owner_name(F.col("dst")).alias("scope"), ref.alias("ref")).filter("ref <> ''")
    found = asked.join(resolve_references(graph, asked), ["scope", "ref"])
    return edge_rows(
        found.select(F.col("fqn").alias("src"), "dst").distinct().withColumn("kind", F.lit("INJECTS")).withColumn("evidence", F.lit("fastapi-depends"))
    )
