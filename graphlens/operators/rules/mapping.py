"""Models and tables: entities, repositories, request models, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by, materialize, tiled_join
from graphlens.functions.text import (
    camel_to_snake, default_database, derived_query_access, entity_table_name, field_constraints, owner_name, quoted_strings,
    short_name, snake_each_capital, unquote,
)
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.rules import RuleResult
from graphlens.operators.rules.injection import children_of
from graphlens.operators.rules.schema_history import sql_lineage
from graphlens.schema import LOW, MEDIUM

# Repository bases and the methods they bring along.
REPOSITORY_BASES = ["JpaRepository", "CrudRepository", "PagingAndSortingRepository", "ReactiveCrudRepository", "Repository"]
INHERITED_WRITES = ["save", "saveAll", "deleteById", "delete", "deleteAll"]
INHERITED_READS = ["findById", "findAll", "findAllById", "count", "existsById"]
# Language type -> compatible column types.
COLUMN_TYPES = {
    "str": ["VARCHAR", "TEXT", "CHAR", "STRING", "CITEXT"],
    "int": ["INTEGER", "BIGINT", "SMALLINT", "INT"],
    "bool": ["BOOLEAN", "BOOL"],
    "float": ["REAL", "FLOAT", "DOUBLE", "DOUBLE PRECISION", "NUMERIC", "DECIMAL"],
    "datetime": ["TIMESTAMP", "DATETIME", "TIMESTAMPTZ"],
    "date": ["DATE"],
}
MODEL_BASES = ["BaseModel", "pydantic.BaseModel", "pydantic.main.BaseModel", "RootModel", "pydantic.RootModel", "pydantic.main.RootModel"]
VALIDATOR = r"""^@?(field_validator|model_validator|validator|root_validator)\b(?:\(\s*["']([^"']+)["'])?"""
SETTING_KEYS = ["INSTALLED_APPS", "ROOT_URLCONF", "DATABASES", "MIDDLEWARE", "DEFAULT_AUTO_FIELD", "AUTH_USER_MODEL"]


def _marked(*names: str) -> Column:
    return F.coalesce(F.arrays_overlap("annotations", F.array(*[F.lit(n) for n in names])), F.lit(False))


def _named_arg(name: str) -> Column:
    return F.nullif(F.col("annotation_args")[name], F.lit(""))


# --- entities ------------------------------------------------------------------------------


def mapped_tables(entities: DataFrame, columns: DataFrame, orm: str) -> RuleResult:
    """Tables, columns and references of any mapper.

    ``entities(entity, name, table)``; ``columns(entity, column, type, is_pk, ref_entity, ref_column, seq)``:
    a reference names either the entity whose key it points to or a ``table.column``.
    """
    entities = materialize(entities.select("entity", "name", "table"), "entities")
    columns = materialize(columns, "columns")
    rows = columns.join(entities, "entity").withColumn("table_fqn", F.concat(F.lit("table:"), "table")).withColumn("fqn", F.concat_ws(".", "table_fqn", "column"))
    sizes = columns.groupBy("entity").agg(F.count("*").alias("n"))
    tables = entities.join(sizes, "entity", "left").select(
        F.concat(F.lit("table:"), "table").alias("fqn"), F.col("table").alias("name"), F.lit("TABLE").alias("kind"),
        F.create_map(F.lit("column_count"), F.coalesce("n", F.lit(0)).cast("string")).alias("props"),
    )
    cells = rows.select(
        "fqn", F.col("column").alias("name"), F.lit("COLUMN").alias("kind"), "type",
        F.create_map(
            F.lit("is_primary_key"), F.col("is_pk").cast("string"),
            F.lit("is_foreign_key"), (F.col("ref_entity").isNotNull() | F.col("ref_column").isNotNull()).cast("string"),
        ).alias("props"),
    )
    keys = first_by(rows.filter("is_pk"), ["entity"], ["seq", "column"], ["fqn", "name"])
    by_name = last_by(keys.select("name", F.col("fqn").alias("target"), "entity"), ["name"], ["entity"], ["target"])
    by_entity = rows.filter("ref_entity IS NOT NULL").select("fqn", F.col("ref_entity").alias("name")).join(by_name, "name").select("fqn", "target")
    stated = rows.filter("ref_column IS NOT NULL").select("fqn", F.concat(F.lit("table:"), "ref_column").alias("target"))
    links = (
        entities.select(F.col("entity").alias("src"), F.concat(F.lit("table:"), "table").alias("dst"), F.lit("MAPS_TO").alias("kind"))
        .unionByName(rows.select(F.col("table_fqn").alias("src"), F.col("fqn").alias("dst"), F.lit("HAS_COLUMN").alias("kind")))
        .unionByName(by_entity.unionByName(stated).select(F.col("fqn").alias("src"), F.col("target").alias("dst"), F.lit("REFERENCES").alias("kind")))
    )
    layers = entities.select(F.col("entity").alias("fqn"), F.lit("Data Access").alias("layer"))
    return RuleResult(nodes=node_rows(tables).unionByName(node_rows(cells)), edges=edge_rows(links.withColumn("evidence", F.lit(orm))), layers=layers)


def annotated_entities(graph: Graph) -> RuleResult:
    """Entity classes by annotation: snake-plural tables, join columns, junction tables."""
    classes = graph.of_kind("CLASS").filter(_marked("Entity")).select(
        F.col("fqn").alias("entity"), "name", F.coalesce(_named_arg("Table"), entity_table_name(F.col("name"))).alias("table")
    )
    fields = children_of(graph, classes.select(F.col("entity").alias("owner")), "FIELD", "name", "type", "annotations", "annotation_args", "seq")
    loose = _marked("OneToMany", "ManyToMany") & ~_marked("JoinColumn", "JoinTable")
    single = _marked("ManyToOne", "OneToOne")
    named = F.coalesce(_named_arg("Column"), camel_to_snake(F.col("name")))
    column = F.when(single & _marked("JoinColumn"), F.coalesce(_named_arg("JoinColumn"), named)).otherwise(named)
    columns = fields.filter(~loose).select(
        F.col("owner").alias("entity"), column.alias("column"), "type", _marked("Id").alias("is_pk"),
        F.when(single, F.col("type")).alias("ref_entity"), F.lit(None).cast("string").alias("ref_column"), "seq",
    )
    result = mapped_tables(classes, columns, "hibernate")
    joined = fields.filter(_marked("ManyToMany") & _marked("JoinTable") & _named_arg("JoinTable").isNotNull()).select(
        F.col("owner").alias("entity"), _named_arg("JoinTable").alias("junction"), F.trim(F.regexp_extract("type", r"<([^<>]*)>", 1)).alias("target")
    )
    keys = first_by(columns.filter("is_pk"), ["entity"], ["seq", "column"], ["column"])
    owners = classes.join(keys, "entity").select("entity", "name", F.concat(F.lit("table:"), "table", F.lit("."), "column").alias("key"))
    near = joined.join(owners, "entity").select("junction", "name", "key")
    far = joined.join(owners.select(F.col("name").alias("target"), "key"), "target").select("junction", F.col("target").alias("name"), "key")
    ends = near.unionByName(far).select(
        F.concat(F.lit("table:"), "junction").alias("table"), F.concat(F.lit("table:"), "junction", F.lit("."), camel_to_snake(F.col("name")), F.lit("_id")).alias("fk"), "key"
    ).distinct()
    extra = ends.select(F.col("table").alias("src"), F.col("fk").alias("dst"), F.lit("HAS_COLUMN").alias("kind")).unionByName(
        ends.select(F.col("fk").alias("src"), F.col("key").alias("dst"), F.lit("REFERENCES").alias("kind"))
    )
    nodes = ends.select(F.col("table").alias("fqn"), F.lit("TABLE").alias("kind")).distinct().unionByName(ends.select(F.col("fk").alias("fqn"), F.lit("COLUMN").alias("kind")))
    nodes = node_rows(nodes.withColumn("name", F.regexp_extract("fqn", r"([^.:]*)$", 1)))
    return RuleResult(result.nodes.unionByName(nodes), result.edges.unionByName(edge_rows(extra.withColumn("evidence", F.lit("hibernate")))), result.layers)


def declared_columns(graph: Graph, flavour: str) -> RuleResult:
    """Models that declare columns in field values.

    ``table_name``: classes with ``__tablename__``; ``flask``: heirs of ``db.Model``;
    ``django``: heirs of ``models.Model``.
    """
    heirs = graph.edges_of("INHERITS").select(F.col("src").alias("entity"), "dst")
    classes = graph.of_kind("CLASS").select(F.col("fqn").alias("entity"), "name")
    fields = children_of(graph, classes.select(F.col("entity").alias("owner")), "FIELD", "name", "value", "type", "seq").withColumnRenamed("owner", "entity").withColumnRenamed("name", "field")
    named = first_by(fields.filter("field = '__tablename__'"), ["entity"], ["seq", "fqn"], ["value"]).select("entity", unquote(F.col("value")).alias("stated"))
    flask_heirs = heirs.filter(F.col("dst").isin("db.Model", "Model")).select("entity").distinct()
    if flavour == "table_name":
        entities = classes.join(named, "entity").join(flask_heirs, "entity", "left_anti").withColumn("table", F.col("stated"))
    elif flavour == "flask":
        entities = classes.join(flask_heirs, "entity", "left_semi").join(named, "entity", "left").withColumn("table", F.coalesce("stated", snake_each_capital(F.col("name"))))
    else:
        base = heirs.filter(F.contains("dst", F.lit("models.Model"))).select("entity").distinct()
        stated = first_by(fields.filter("field = '_meta_db_table'"), ["entity"], ["seq", "fqn"], ["value"]).select("entity", unquote(F.col("value")).alias("stated"))
        app = F.concat_ws("_", F.substring_index("entity", ".", 1), F.lower("name"))
        entities = classes.join(base, "entity", "left_semi").join(stated, "entity", "left").withColumn("table", F.coalesce("stated", app))
    call = {"table_name": r"(?:Column|mapped_column)\(", "flask": r"db\.Column\(", "django": r"\w*(?:Field|Key)\("}[flavour]
    body = fields.filter(F.coalesce("value", F.lit("")).rlike(call) & ~F.col("field").startswith("_"))
    if flavour == "django":
        kind = F.regexp_extract("value", r"(\w+)\(", 1)
        relation = kind.isin("ForeignKey", "OneToOneField")
        target = F.substring_index(unquote(F.regexp_extract("value", r"\(\s*([^,)]+)", 1)), ".", -1)
        columns = body.filter(kind != "ManyToManyField").select(
            "entity", F.when(relation, F.concat("field", F.lit("_id"))).otherwise(F.col("field")).alias("column"), kind.alias("type"),
            F.contains("value", F.lit("primary_key=True")).alias("is_pk"), F.when(relation, target).alias("ref_entity"), F.lit(None).cast("string").alias("ref_column"), "seq",
        )
        keyed = columns.filter("is_pk").select("entity").distinct()
        implied = entities.join(keyed, "entity", "left_anti").select(
            "entity", F.lit("id").alias("column"), F.lit("AutoField").alias("type"), F.lit(True).alias("is_pk"), F.lit(None).cast("string").alias("ref_entity"),
            F.lit(None).cast("string").alias("ref_column"), F.lit(-1).cast("bigint").alias("seq"),
        )
        columns = columns.unionByName(implied)
    else:
        first = F.trim(F.regexp_extract("value", call + r"\s*([\w.]+(?:\([^)]*\))?)", 1))
        columns = body.select(
            "entity", F.col("field").alias("column"), F.when(first.startswith("ForeignKey") | first.startswith("db.ForeignKey"), F.lit("UNKNOWN")).otherwise(first).alias("type"),
            F.col("value").rlike(r"primary_key\s*=\s*True").alias("is_pk"), F.lit(None).cast("string").alias("ref_entity"),
            F.nullif(F.regexp_extract("value", r"""ForeignKey\(\s*["']([^"']+)["']""", 1), F.lit("")).alias("ref_column"), "seq",
        )
    columns = columns.join(entities.select("entity"), "entity", "left_semi")
    return mapped_tables(entities, columns, {"table_name": "sqlalchemy", "flask": "flask-sqlalchemy", "django": "django-orm"}[flavour])


def context_entities(graph: Graph) -> DataFrame:
    """(context, entity): sets held by a context class or by any class that descends from one.

    A context is known by its base class or by its own name.
    """
    parents = materialize(graph.of_kind("CLASS").filter("base_class IS NOT NULL").select("fqn", "name", "base_class"), "parents")
    layer = graph.of_kind("CLASS").filter(F.contains("base_class", F.lit("DbContext")) | F.endswith("name", F.lit("DbContext"))).select("fqn", "name")
    layers = [materialize(layer, "contexts")]
    while True:
        step = parents.join(layers[-1].select(F.col("name").alias("base_class")).distinct(), "base_class", "left_semi").select("fqn", "name")
        seen = layers[0]
        for x in layers[1:]:
            seen = seen.unionByName(x)
        layer = materialize(step.join(seen.select("fqn"), "fqn", "left_anti"), "contexts")
        if layer.isEmpty():
            break
        layers.append(layer)
    contexts = layers[0]
    for x in layers[1:]:
        contexts = contexts.unionByName(x)
    held = children_of(graph, contexts.select(F.col("fqn").alias("owner")), "FIELD", "type").select(
        F.col("owner").alias("context"), F.regexp_extract("type", r"^DbSet<(\w+)>", 1).alias("name")
    ).filter("name <> ''")
    names = last_by(graph.of_kind("CLASS").select("name", "fqn", "seq"), ["name"], ["seq", "fqn"], ["fqn"])
    return held.join(names, "name").select("context", F.col("fqn").alias("entity")).distinct()


# --- repositories --------------------------------------------------------------------------


def stated_queries(graph: Graph, repos: DataFrame, tables: DataFrame) -> DataFrame:
    """(src, dst, kind) of methods with a query text, in entity names or table names.

    ``tables(entity_name, table)``. A name that no entity has is a table; it is
    read only if the graph knows it, while a write states that it exists.
    """
    methods = children_of(graph, repos.select(F.col("repository").alias("owner")), "FUNCTION", "annotations", "annotation_args").filter(_marked("Query"))
    stated = F.trim(F.coalesce(F.col("annotation_args")["Query"], F.lit("")))
    text = F.when(stated.rlike(r"(?i)^FROM\b"), F.concat(F.lit("SELECT * "), stated)).otherwise(stated)
    named = sql_lineage(methods.select("fqn", text.alias("text"))).withColumnRenamed("table", "entity_name").join(tables, "entity_name", "left")
    known = graph.of_kind("TABLE").select(F.col("fqn").alias("dst"), F.lit(True).alias("known")).distinct()
    found = named.select(F.col("fqn").alias("src"), F.coalesce("table", F.concat(F.lit("table:"), "entity_name")).alias("dst"), F.col("access").alias("kind"), F.col("table").isNotNull().alias("mapped"))
    return found.join(known, "dst", "left").filter("mapped OR known OR kind = 'WRITES'").select("src", "dst", "kind").distinct()


def repositories(graph: Graph, entity_names: DataFrame) -> RuleResult:
    """Repository interfaces: managed entity, inherited method stubs and table access.

    ``entity_names(repository, entity_name)`` names the first type argument.
    """
    based = graph.edges_of("INHERITS").filter(short_name(F.col("dst")).isin(*REPOSITORY_BASES)).select(F.col("src").alias("repository"))
    listed = graph.of_kind("INTERFACE").filter(F.arrays_overlap("implements", F.array(*[F.lit(b) for b in REPOSITORY_BASES]))).select(F.col("fqn").alias("repository"))
    repos = graph.of_kind("INTERFACE").select(F.col("fqn").alias("repository")).join(based.unionByName(listed).distinct(), "repository", "left_semi").join(entity_names, "repository")
    entities = first_by(graph.of_kind("CLASS").filter(_marked("Entity")).select(F.col("name").alias("entity_name"), "fqn", "seq"), ["entity_name"], ["seq", "fqn"], ["fqn"])
    managed = repos.join(entities, "entity_name").select(F.col("repository").alias("src"), F.col("fqn").alias("dst"), F.lit("MANAGES").alias("kind"))
    tables = last_by(
        graph.edges_of("MAPS_TO").select(F.col("src").alias("fqn"), F.col("dst").alias("table"), "seq").join(graph.nodes.select("fqn", F.col("name").alias("entity_name")), "fqn"),
        ["entity_name"], ["seq", "fqn", "table"], ["table"],
    )
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.lit(k).alias("kind")) for k, ms in (("WRITES", INHERITED_WRITES), ("READS", INHERITED_READS)) for m in ms]))
    stubs = repos.select("repository", "entity_name", methods.alias("m")).select("repository", "entity_name", "m.name", "m.kind", F.concat_ws(".", "repository", "m.name").alias("fqn"))
    fresh = stubs.join(graph.nodes.select("fqn"), "fqn", "left_anti")
    contained = fresh.select(F.col("repository").alias("src"), F.col("fqn").alias("dst"), F.lit("CONTAINS").alias("kind"))
    touched = stubs.join(tables, "entity_name").select(F.col("fqn").alias("src"), F.col("table").alias("dst"), "kind")
    declared = children_of(graph, repos.select(F.col("repository").alias("owner")), "FUNCTION", "name", "annotations").filter(~_marked("Query"))
    access = derived_query_access(F.col("name"))
    derived = declared.join(repos.select(F.col("repository").alias("owner"), "entity_name"), "owner").join(tables, "entity_name").select(
        F.col("fqn").alias("src"), F.col("table").alias("dst"), F.when(access == "read", "READS").when(access == "write", "WRITES").alias("kind")
    ).filter("kind IS NOT NULL")
    nodes = node_rows(fresh.select("fqn", "name", F.lit("FUNCTION").alias("kind"), F.lit("java").alias("language")))
    edges = managed.unionByName(contained).unionByName(touched).unionByName(derived).unionByName(stated_queries(graph, repos, tables))
    warnings = repos.join(tables, "entity_name", "left_anti").select(F.concat(F.lit("no table for "), "entity_name").alias("message"))
    return RuleResult(nodes=nodes, edges=edge_rows(edges.withColumn("evidence", F.lit("spring-data"))), warnings=warnings)


# --- request models ------------------------------------------------------------------------


def model_classes(graph: Graph) -> DataFrame:
    """(fqn) of classes that inherit from a known model base."""
    segments = F.split("dst", r"\.")
    base = F.col("dst").isin(*MODEL_BASES) | (F.col("dst").rlike(r"\.(BaseModel|RootModel)$") & F.array_contains(segments, "pydantic"))
    return graph.edges_of("INHERITS").filter(base).select(F.col("src").alias("fqn")).distinct()


def model_name(type_text: Column) -> Column:
    """The model a type annotation names: one wrapper and ``| None`` are taken off."""
    inner = F.regexp_extract(F.trim(type_text), r"^(?:list|List|Optional|Union)\[(.*)\]$", 1)
    inner = F.when(inner == "", F.trim(type_text)).otherwise(F.regexp_replace(inner, ", None$", ""))
    return F.trim(F.substring_index(inner, "|", 1))


def model_links(graph: Graph) -> DataFrame:
    """ACCEPTS and RETURNS edges between endpoints and request models."""
    models = materialize(model_classes(graph), "models")
    handlers = graph.of_kind("FUNCTION").select(F.col("fqn").alias("handler"), "params", "return_type")
    endpoints = graph.of_kind("API_ENDPOINT").select(F.col("fqn").alias("endpoint"))
    served = graph.edges_of("HANDLES").select(F.col("src").alias("handler"), F.col("dst").alias("endpoint")).distinct().join(endpoints, "endpoint", "left_semi").join(handlers, "handler")
    accepted = served.select("endpoint", "handler", F.explode("params.type").alias("text"), F.lit("ACCEPTS").alias("kind"))
    returned = served.select("endpoint", "handler", F.col("return_type").alias("text"), F.lit("RETURNS").alias("kind"))
    asked = accepted.unionByName(returned).withColumn("ref", model_name(F.col("text"))).filter(F.coalesce("ref", F.lit("")) != "").withColumn("scope", owner_name(F.col("handler")))
    wanted = asked.select("scope", "ref").distinct()
    exact = wanted.join(models.withColumn("ref", F.col("fqn")), "ref").select("scope", "ref", "fqn", F.lit(0).alias("rung"))
    local = wanted.withColumn("fqn", F.concat_ws(".", "scope", "ref")).join(models, "fqn", "left_semi").select("scope", "ref", "fqn", F.lit(1).alias("rung"))
    tail = models.groupBy(short_name(F.col("fqn")).alias("ref")).agg(F.min("fqn").alias("fqn"))
    suffix = wanted.join(tail, "ref").select("scope", "ref", "fqn", F.lit(2).alias("rung"))
    found = first_by(exact.unionByName(local).unionByName(suffix), ["scope", "ref"], ["rung"], ["fqn"])
    return edge_rows(asked.join(found, ["scope", "ref"]).select(F.col("endpoint").alias("src"), F.col("fqn").alias("dst"), "kind").withColumn("evidence", F.lit("fastapi-model")))


def field_columns(graph: Graph) -> DataFrame:
    """MAPS_TO edges from model fields to columns of the same name and a compatible type.

    One compatible column is MEDIUM, several are LOW each. Columns are counted per
    (name, type) first, which decides the confidence before any field is paired; the pairs are the answer and are not shuffled.
    """
    fields = children_of(graph, model_classes(graph).withColumnRenamed("fqn", "owner"), "FIELD", "name", "type")
    plain = F.trim(F.substring_index(F.substring_index(F.trim("type"), "[", 1), "|", 1))
    kinds = F.create_map(*[x for k, v in COLUMN_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[plain]
    wanted = materialize(fields.select("fqn", "name", F.explode(kinds).alias("column_type")), "wanted")
    columns = materialize(graph.of_kind("COLUMN").select(F.col("fqn").alias("dst"), "name", F.trim(F.substring_index(F.upper(F.trim("type")), "(", 1)).alias("column_type")), "columns")
    counts = columns.groupBy("name", "column_type").agg(F.count("*").alias("n"))
    totals = wanted.join(counts, ["name", "column_type"]).groupBy("fqn").agg(F.sum("n").alias("candidates"))
    rated = wanted.join(totals, "fqn").withColumn("confidence", F.when(F.col("candidates") == 1, MEDIUM).otherwise(LOW)).drop("candidates")
    pairs = tiled_join(materialize(rated, "fields"), columns, ["name", "column_type"], "fqn", "dst")
    return edge_rows(pairs.select(F.col("fqn").alias("src"), "dst", F.lit("MAPS_TO").alias("kind"), "confidence", F.lit("pydantic-orm").alias("evidence")))


def model_constraints(graph: Graph) -> DataFrame:
    """(fqn, constraints): recognised constraints of model fields, value over type."""
    fields = children_of(graph, model_classes(graph).withColumnRenamed("fqn", "owner"), "FIELD", "type", "value")
    stated, given = field_constraints(F.col("type")), field_constraints(F.col("value"))
    merged = F.map_concat(F.map_filter(stated, lambda k, v: ~F.map_contains_key(given, k)), given)
    return fields.select("fqn", merged.alias("constraints")).filter(F.size("constraints") > 0)


def model_validators(graph: Graph) -> DataFrame:
    """(fqn, validator_kind, target_field) of validator methods of models."""
    methods = children_of(graph, model_classes(graph).withColumnRenamed("fqn", "owner"), "FUNCTION", "annotations")
    first = F.get(F.filter("annotations", lambda a: a.rlike(VALIDATOR)), F.lit(0))
    rows = methods.select("fqn", first.alias("d")).filter("d IS NOT NULL")
    return rows.select("fqn", F.regexp_extract("d", VALIDATOR, 1).alias("validator_kind"), F.nullif(F.regexp_extract("d", VALIDATOR, 2), F.lit("")).alias("target_field"))


# --- settings ------------------------------------------------------------------------------


def settings(graph: Graph) -> RuleResult:
    """CONFIG_FILE per settings module and CONFIG_ENTRY per known key, with parsed values."""
    modules = graph.of_kind("MODULE").select(F.col("fqn").alias("owner"))
    fields = children_of(graph, modules, "FIELD", "name", "value").filter(F.col("name").isin(*SETTING_KEYS))
    marked = fields.filter("name = 'INSTALLED_APPS'").select("owner").distinct()
    rows = fields.join(marked, "owner", "left_semi")
    empty = F.create_map().cast("map<string,string>")
    parsed = (
        F.when(F.col("name").isin("INSTALLED_APPS", "MIDDLEWARE"), F.create_map(F.lit("items"), F.array_join(quoted_strings(F.col("value")), ",")))
        .when(F.col("name") == "DATABASES", default_database(F.col("value")))
        .otherwise(F.create_map(F.lit("text"), unquote(F.col("value"))))
    )
    file = F.concat(F.lit("config:"), "owner")
    entry = F.concat_ws(".", file, "name")
    files = marked.select(file.alias("fqn"), short_name(F.col("owner")).alias("name"), F.lit("CONFIG_FILE").alias("kind"), F.lit("python").alias("language"))
    entries = rows.select(entry.alias("fqn"), "name", F.lit("CONFIG_ENTRY").alias("kind"), F.lit("python").alias("language"), "value", F.coalesce(parsed, empty).alias("props"))
    edges = rows.select(file.alias("src"), entry.alias("dst"), F.lit("CONTAINS").alias("kind"), F.lit("django-settings").alias("evidence"))
    return RuleResult(nodes=node_rows(files).unionByName(node_rows(entries)), edges=edge_rows(edges))
