"""Graph enrichment: ownership maps, fan metrics, roll-ups, layers, technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by, materialize
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.structure import narrowed
from graphlens.schema import HIGH, literal_map

# Class annotation -> framework.
ANNOTATION_FRAMEWORK = {
    "Component": "spring-boot",
    "Service": "spring-boot",
    "Repository": "spring-data-jpa",
    "Controller": "spring-web",
    "RestController": "spring-web",
    "Configuration": "spring-boot",
    "Bean": "spring-boot",
    "Entity": "hibernate",
    "Table": "hibernate",
    "MappedSuperclass": "hibernate",
    "Embeddable": "hibernate",
    "RequestMapping": "spring-web",
    "GetMapping": "spring-web",
    "PostMapping": "spring-web",
    "PutMapping": "spring-web",
    "DeleteMapping": "spring-web",
    "PatchMapping": "spring-web",
}

# Framework -> display name, category, language, layer.
TECHNOLOGIES = {
    "spring-boot": ("Spring Boot", "di_container", "java", "Business Logic"),
    "spring-web": ("Spring Web", "web_framework", "java", "Presentation"),
    "spring-data-jpa": ("Spring Data JPA", "orm", "java", "Data Access"),
    "hibernate": ("Hibernate", "orm", "java", "Data Access"),
    "fastapi": ("FastAPI", "web_framework", "python", "Presentation"),
    "django": ("Django", "web_framework", "python", "Presentation"),
    "django-drf": ("Django REST Framework", "web_framework", "python", "Presentation"),
    "django-orm": ("Django ORM", "orm", "python", "Data Access"),
    "django-settings": ("Django Settings", "configuration", "python", "Configuration"),
    "sqlalchemy": ("SQLAlchemy", "orm", "python", "Data Access"),
    "react": ("React", "frontend_framework", "typescript", "Presentation"),
    "angular": ("Angular", "frontend_framework", "typescript", "Presentation"),
    "express": ("Express.js", "web_framework", "javascript", "Presentation"),
    "nestjs": ("NestJS", "web_framework", "typescript", "Presentation"),
    "aspnet": ("ASP.NET Core", "web_framework", "csharp", "Presentation"),
    "entity-framework": ("Entity Framework", "orm", "csharp", "Data Access"),
}

# Language display names.
LANGUAGE_NAMES = {
    "java": "Java",
    "python": "Python",
    "typescript": "TypeScript",
    "javascript": "JavaScript",
    "csharp": "C#",
    "go": "Go",
    "kotlin": "Kotlin",
    "scala": "Scala",
    "ruby": "Ruby",
    "rust": "Rust",
}

# The framework inventory reports the ORM under another key than the technology table.
FRAMEWORK_ALIASES = {"efcore": "entity-framework"}


# --- ownership maps ----------------------------------------------------------------------


def method_owners(graph: Graph, owner_kinds: tuple[str, ...] = ("CLASS",)) -> DataFrame:
    """(app_name, method, owner, owner_kind); a method contained twice keeps its last owner."""
    contains = graph.edges_of("CONTAINS").select(
        "app_name", F.col("src").alias("owner"), F.col("dst").alias("method"), "seq"
    )
    owners = graph.of_kind(*owner_kinds).select("app_name", F.col("fqn").alias("owner"), F.col("kind").alias("owner_kind"))
    methods = graph.of_kind("FUNCTION").select("app_name", F.col("fqn").alias("method"))
    found = contains.join(owners, ["app_name", "owner"]).join(methods, ["app_name", "method"])
    return last_by(found, ["app_name", "method"], ["seq", "owner"], ["owner", "owner_kind"])


def class_modules(graph: Graph) -> DataFrame:
    """(app_name, class_fqn, module_fqn): containment first, else the ``module_fqn`` property."""
    modules = graph.of_kind("MODULE").select("app_name", F.col("fqn").alias("module_fqn"))
    classes = graph.of_kind("CLASS").select(
        "app_name", F.col("fqn").alias("class_fqn"), F.col("props")["module_fqn"].alias("stated")
    )
    contains = graph.edges_of("CONTAINS").select(
        "app_name", F.col("src").alias("module_fqn"), F.col("dst").alias("class_fqn"), "seq"
    )
    contained = last_by(
        contains.join(modules, ["app_name", "module_fqn"]),
        ["app_name", "class_fqn"], ["seq", "module_fqn"], ["module_fqn"],
    )
    return (
        classes.join(contained, ["app_name", "class_fqn"], "left")
        .select("app_name", "class_fqn", F.coalesce("module_fqn", F.nullif("stated", F.lit(""))).alias("module_fqn"))
        .filter(F.col("module_fqn").isNotNull())
    )


# --- metrics and roll-ups ----------------------------------------------------------------


def fan_metrics(graph: Graph) -> DataFrame:
    """(app_name, class_fqn, fan_in, fan_out) for every class; calls count per row.

    Calls shrink to one row per method before ownership is joined.
    """
    owners = materialize(method_owners(graph), "owners")  # both ends of a call look it up
    calls = graph.edges_of("CALLS")

    def per_class(end: str, out: str) -> DataFrame:
        per_method = calls.groupBy("app_name", F.col(end).alias("method")).agg(F.count("*").alias("n"))
        return per_method.join(owners, ["app_name", "method"]).select(
            "app_name", F.col("owner").alias("class_fqn"), F.lit(out).alias("metric"), "n"
        )

    injected = (
        graph.edges_of("INJECTS")
        .groupBy("app_name", F.col("dst").alias("class_fqn")).agg(F.count("*").alias("n"))
        .select("app_name", "class_fqn", F.lit("in").alias("metric"), "n")
    )
    counts = per_class("dst", "in").unionByName(per_class("src", "out")).unionByName(injected)
    totals = counts.groupBy("app_name", "class_fqn").agg(
        F.sum(F.when(F.col("metric") == "in", F.col("n"))).alias("fan_in"),
        F.sum(F.when(F.col("metric") == "out", F.col("n"))).alias("fan_out"),
    )
    classes = graph.of_kind("CLASS").select("app_name", F.col("fqn").alias("class_fqn"))
    return classes.join(totals, ["app_name", "class_fqn"], "left").select(
        "app_name", "class_fqn",
        F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
    )


def class_call_weights(graph: Graph, owners: DataFrame | None = None) -> DataFrame:
    """(app_name, src, dst, weight): call rows between the classes of two methods, self included."""
    owners = (owners if owners is not None else materialize(method_owners(graph), "owners")).select("app_name", "method", "owner")
    calls = graph.edges_of("CALLS").groupBy("app_name", "src", "dst").agg(F.count("*").alias("n"))
    sources = owners.select("app_name", F.col("method").alias("src"), F.col("owner").alias("src_class"))
    targets = owners.select("app_name", F.col("method").alias("dst"), F.col("owner").alias("dst_class"))
    return (
        calls.join(sources, ["app_name", "src"])
        .groupBy("app_name", "src_class", "dst").agg(F.sum("n").alias("n"))
        .join(targets, ["app_name", "dst"])
        .groupBy("app_name", F.col("src_class").alias("src"), F.col("dst_class").alias("dst"))
        .agg(F.sum("n").alias("weight"))
    )


def _new_pairs(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    return pairs.join(existing.select("app_name", "src", "dst").distinct(), ["app_name", "src", "dst"], "left_anti")


def class_dependencies(graph: Graph) -> DataFrame:
    """New class-level DEPENDS_ON edges; pairs that already depend on each other are left alone."""
    graph = narrowed(
        graph, ["app_name", "fqn", "kind"], ["app_name", "src", "dst", "kind", "seq"], ["CLASS", "FUNCTION"], ["CONTAINS", "CALLS", "DEPENDS_ON"]
    )
    weights = class_call_weights(graph).filter("src <> dst")
    fresh = _new_pairs(weights, graph.edges_of("DEPENDS_ON"))
    return edge_rows(fresh.withColumn("kind", F.lit("DEPENDS_ON")))


def module_imports(graph: Graph) -> DataFrame:
    """New module-level IMPORTS edges; weight sums class dependencies (1 when unweighted)."""
    graph = narrowed(
        graph, ["app_name", "fqn", "kind", "props"], ["app_name", "src", "dst", "kind", "seq", "weight"],
        ["CLASS", "MODULE"], ["CONTAINS", "DEPENDS_ON", "IMPORTS"],
    )
    modules = class_modules(graph)
    known = graph.of_kind("MODULE").select("app_name", F.col("fqn").alias("module_fqn"))
    modules = materialize(modules.join(known, ["app_name", "module_fqn"], "left_semi"), "modules")
    sources = modules.select("app_name", F.col("class_fqn").alias("src"), F.col("module_fqn").alias("src_module"))
    targets = modules.select("app_name", F.col("class_fqn").alias("dst"), F.col("module_fqn").alias("dst_module"))
    weights = (
        graph.edges_of("DEPENDS_ON")
        .groupBy("app_name", "src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("weight"))
        .join(sources, ["app_name", "src"]).join(targets, ["app_name", "dst"])
        .filter("src_module <> dst_module")
        .groupBy("app_name", F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )
    return edge_rows(_new_pairs(weights, graph.edges_of("IMPORTS")).withColumn("kind", F.lit("IMPORTS")))


def orphan_modules(graph: Graph) -> DataFrame:
    """Modules that contain nothing."""
    parents = graph.edges_of("CONTAINS").select("app_name", F.col("src").alias("fqn")).distinct()
    return graph.of_kind("MODULE").select("app_name", "fqn").join(parents, ["app_name", "fqn"], "left_anti")


def prune_orphan_modules(graph: Graph) -> Graph:
    """Drop orphan modules and every edge that touches one."""
    orphans = orphan_modules(graph)
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(orphans.withColumnRenamed("fqn", end), ["app_name", end], "left_anti")
    return Graph(
        graph.nodes.join(orphans, ["app_name", "fqn"], "left_anti"),
        edges.select(*graph.edges.columns),
    )


def virtual_dispatch(graph: Graph) -> DataFrame:
    """CALLS from an interface method to each implementation; IMPLEMENTS may point either way."""
    owners = method_owners(graph, ("CLASS", "INTERFACE")).select("app_name", "method", "owner_kind")
    pairs = (
        graph.edges_of("IMPLEMENTS").select("app_name", "src", "dst").distinct()
        .join(owners.select("app_name", F.col("method").alias("src"), F.col("owner_kind").alias("sk")), ["app_name", "src"])
        .join(owners.select("app_name", F.col("method").alias("dst"), F.col("owner_kind").alias("dk")), ["app_name", "dst"])
        .filter("sk <> dk")
    )
    upward = F.col("sk") == "CLASS"
    oriented = pairs.select(
        "app_name",
        F.when(upward, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(upward, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    ).distinct()
    fresh = _new_pairs(oriented, graph.edges_of("CALLS"))
    return edge_rows(
        fresh.select("*", F.lit("CALLS").alias("kind"), F.lit(HIGH).alias("confidence"), F.lit("virtual-dispatch").alias("evidence"))
    )


# --- layers and technologies -------------------------------------------------------------


def first_known(annotations: Column, table: dict[str, str]) -> Column:
    """Value of the first annotation that the table knows, in annotation order."""
    lookup = literal_map(table)
    return F.get(F.filter(F.transform(annotations, lambda a: lookup[a]), lambda v: v.isNotNull()), F.lit(0))


def apply_layers(graph: Graph, assignments: DataFrame) -> DataFrame:
    """Nodes with layer and framework filled in where unset.

    ``assignments(app_name, fqn, layer, seq)``: later rows win. A framework
    inferred from annotations also gives its layer as a last resort.
    """
    chosen = last_by(assignments, ["app_name", "fqn"], ["seq"], ["layer"]).withColumnRenamed("layer", "assigned")
    typed = F.col("kind").isin("CLASS", "INTERFACE")
    inferred = F.when(typed & F.col("framework").isNull(), first_known(F.col("annotations"), ANNOTATION_FRAMEWORK))
    hint = literal_map({k: v[3] for k, v in TECHNOLOGIES.items()})[F.col("inferred")]
    joined = graph.nodes.join(chosen, ["app_name", "fqn"], "left").withColumn("inferred", inferred)
    filled = joined.withColumn(
        "layer", F.when(typed, F.coalesce("layer", "assigned", hint)).otherwise(F.col("layer"))
    ).withColumn("framework", F.coalesce("framework", "inferred"))
    return filled.select(*graph.nodes.columns)


def layer_nodes(graph: Graph) -> DataFrame:
    """One LAYER node per distinct class layer, with its member count."""
    layered = graph.of_kind("CLASS").filter(F.coalesce("layer", F.lit("")) != "")
    return layered.groupBy("app_name", F.col("layer").alias("name")).agg(F.count("*").alias("node_count")).select(
        "app_name", F.concat_ws(":", F.lit("layer"), "app_name", "name").alias("fqn"), "name",
        F.lit("LAYER").alias("kind"), "node_count",
    )


def layer_contains(graph: Graph) -> DataFrame:
    layered = graph.of_kind("CLASS").filter(F.coalesce("layer", F.lit("")) != "")
    return edge_rows(
        layered.select(
            "app_name", F.concat_ws(":", F.lit("layer"), "app_name", "layer").alias("src"),
            F.col("fqn").alias("dst"), F.lit("CONTAINS").alias("kind"),
        )
    )


def technology_members(graph: Graph) -> DataFrame:
    """(app_name, fqn, loc, tech_layer, tech): the technology group of each class."""
    hint = literal_map({k: v[3] for k, v in TECHNOLOGIES.items()})
    alias = literal_map(FRAMEWORK_ALIASES)
    framework = F.coalesce(alias[F.col("framework")], F.col("framework"))
    known = framework.isin(*TECHNOLOGIES)
    layer = F.nullif("layer", F.lit(""))
    return (
        graph.of_kind("CLASS")
        .select(
            "app_name", "fqn", "loc",
            F.when(known, F.coalesce(layer, hint[framework])).otherwise(layer).alias("tech_layer"),
            F.when(known, framework)
            .otherwise(F.concat(F.lit("lang:"), F.coalesce("language", F.lit("unknown")))).alias("tech"),
        )
        .filter(F.col("tech_layer").isNotNull())
    )


def technology_nodes(graph: Graph) -> DataFrame:
    """COMPONENT rows per (layer, technology) plus one database component when tables exist."""
    members = technology_members(graph)
    endpoints = (
        graph.of_kind("API_ENDPOINT").filter(F.col("framework") != "")
        .groupBy("app_name", F.col("framework").alias("tech")).agg(F.count("*").alias("endpoint_count"))
    )

    def info(position):
        return literal_map({k: v[position] for k, v in TECHNOLOGIES.items()})[F.col("tech")]

    language = F.regexp_replace("tech", "^lang:", "")
    lang_name = F.concat(F.coalesce(literal_map(LANGUAGE_NAMES)[language], F.initcap(language)), F.lit(" Classes"))
    groups = (
        members.groupBy("app_name", "tech_layer", "tech")
        .agg(F.count("*").alias("class_count"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc_total"))
        .join(endpoints, ["app_name", "tech"], "left")
        .select(
            "app_name",
            F.concat_ws(":", F.lit("tech"), "app_name", "tech_layer", "tech").alias("fqn"),
            F.coalesce(info(0), lang_name).alias("name"),
            F.coalesce(info(1), F.lit("language_classes")).alias("category"),
            F.coalesce(info(2), language).alias("language"),
            F.col("tech_layer").alias("layer"), "class_count", "loc_total",
            F.coalesce("endpoint_count", F.lit(0)).alias("endpoint_count"),
            F.lit(0).cast("bigint").alias("table_count"),
        )
    )
    engine = database_engine(graph)
    tables = graph.of_kind("TABLE").groupBy("app_name").agg(F.count("*").alias("table_count"))
    database = tables.join(engine, "app_name").select(
        "app_name", F.concat_ws(":", F.lit("tech"), "app_name", F.lit("Data Access"), F.lit("db"), "engine").alias("fqn"),
        F.col("display_name").alias("name"), F.lit("database").alias("category"), F.lit(None).cast("string").alias("language"),
        F.lit("Data Access").alias("layer"), F.lit(0).cast("bigint").alias("class_count"),
        F.lit(0).cast("bigint").alias("loc_total"), F.lit(0).cast("bigint").alias("endpoint_count"), "table_count",
    )
    return groups.unionByName(database)


def technology_contains(graph: Graph) -> DataFrame:
    """Component -> class edges and layer -> component edges for existing layers."""
    members = technology_members(graph).withColumn(
        "component", F.concat_ws(":", F.lit("tech"), "app_name", "tech_layer", "tech")
    )
    down = members.select("app_name", F.col("component").alias("src"), F.col("fqn").alias("dst"))
    layers = graph.of_kind("LAYER").select("app_name", F.col("name").alias("tech_layer"), F.col("fqn").alias("src"))
    up = (
        members.select("app_name", "tech_layer", F.col("component").alias("dst")).distinct()
        .join(layers, ["app_name", "tech_layer"]).select("app_name", "src", "dst")
    )
    return edge_rows(down.unionByName(up).withColumn("kind", F.lit("CONTAINS")))


def engine_name(engine: Column) -> Column:
    e = F.lower(engine)
    return (
        F.when(e.contains("postgres") | e.contains("psycopg"), "PostgreSQL")
        .when(e.contains("mysql") | e.contains("mariadb"), "MySQL")
        .when(e.contains("sqlite"), "SQLite")
        .when(e.contains("oracle"), "Oracle")
        .when(e.contains("sqlserver") | e.contains("mssql"), "SQL Server")
        .when(e.contains("mongo"), "MongoDB")
        .when(engine == "database", "Database")
        .otherwise(F.initcap(engine))
    )


def database_engine(graph: Graph) -> DataFrame:
    """(app_name, engine, display_name) from tables, settings, then framework hints."""
    n = graph.nodes
    table_engine = F.when(F.col("kind") == "TABLE", F.nullif(F.col("props")["engine"], F.lit("")))
    name = F.lower("name")
    setting = F.when(
        (F.col("kind") == "CONFIG_ENTRY") & name.contains("database") & name.contains("engine"),
        F.nullif("value", F.lit("")),
    )
    frameworks = F.when(
        F.col("kind") == "APPLICATION",
        F.coalesce(F.col("props")["detected_frameworks"], F.col("props")["frameworks"]),
    )

    def earliest(value):
        return F.min_by(value, F.when(value.isNotNull(), F.struct("seq", "fqn")))

    found = n.groupBy("app_name").agg(
        earliest(table_engine).alias("from_table"), earliest(setting).alias("from_setting"),
        earliest(frameworks).alias("listed"),
    )
    hinted = (
        F.when(F.col("listed").contains("hibernate") | F.col("listed").contains("sqlalchemy"), "postgresql")
        .when(F.col("listed").contains("entity-framework") | F.col("listed").contains("efcore"), "sqlserver")
        .otherwise("database")
    )
    engine = F.coalesce("from_table", "from_setting", hinted)
    return found.select("app_name", engine.alias("engine"), engine_name(engine).alias("display_name"))


def enrich(graph: Graph, assignments: DataFrame) -> Graph:
    """All enrichment steps in their fixed order."""
    graph = prune_orphan_modules(graph)
    graph = Graph(apply_layers(graph, assignments), graph.edges)
    graph = graph.plus(edges=virtual_dispatch(graph))
    graph = graph.plus(edges=class_dependencies(graph))
    graph = graph.plus(edges=module_imports(graph))
    layers = layer_nodes(graph)
    graph = graph.plus(
        nodes=layers.withColumn("props", F.create_map(F.lit("node_count"), F.col("node_count").cast("string"))),
        edges=layer_contains(graph),
    )
    counts = ["category", "class_count", "loc_total", "endpoint_count", "table_count"]
    tech = technology_nodes(graph).withColumn(
        "props", F.create_map(*[x for c in counts for x in (F.lit(c), F.col(c).cast("string"))])
    ).withColumn("kind", F.lit("COMPONENT"))
    return graph.plus(nodes=node_rows(tech), edges=technology_contains(graph))


__all__ = [
    "apply_layers", "class_call_weights", "class_dependencies", "class_modules", "database_engine", "enrich",
    "engine_name", "fan_metrics", "first_by", "first_known", "layer_contains", "layer_nodes", "method_owners",
    "module_imports", "orphan_modules", "prune_orphan_modules", "technology_contains", "technology_members",
    "technology_nodes", "virtual_dispatch",
]
