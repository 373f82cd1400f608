"""Symbol resolution: occurrences to nodes, short names to full names, interface methods to implementations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by, materialize, overlap_join
from graphlens.functions.text import bare_types, owner_name, scip_descriptor_kind, scip_symbol_to_fqn, short_name
from graphlens.graph import Graph, edge_rows
from graphlens.operators.structure import chains, narrowed
from graphlens.schema import HIGH, LOW, MEDIUM

# Node kinds a symbol hint may bind to by position.
HINT_KINDS = {
    "class": ["CLASS", "INTERFACE"],
    "function": ["FUNCTION"],
    "field": ["FIELD"],
    "module": ["MODULE"],
}

# Type names that never become a dependency.
BUILTIN_TYPES = [
    "string", "int", "long", "bool", "float", "double", "decimal", "void", "object", "byte", "char", "short", "uint",
    "ulong", "DateTime", "DateTimeOffset", "Guid", "Task", "IDisposable", "IEnumerable", "IList", "ICollection",
    "IDictionary", "List", "Dictionary", "HashSet", "CancellationToken", "ILogger", "IOptions", "IConfiguration",
    "IServiceProvider", "IMediator", "IMapper",
]


def bare_path(path: Column) -> Column:
    return F.regexp_replace(path, "^[./]+", "")


# --- occurrences to nodes ----------------------------------------------------------------


def enclosing_functions(graph: Graph, places: DataFrame) -> DataFrame:
    """(file, at, fqn): innermost function around each distinct ``places(file, at)``."""
    points = places.select("file", "at").distinct().withColumn("at_end", F.col("at"))
    end = F.coalesce(F.when(F.col("end_line") != 0, F.col("end_line")), F.col("line") + 100)
    spans = graph.of_kind("FUNCTION").filter("path IS NOT NULL AND line IS NOT NULL").select(
        bare_path(F.col("path")).alias("file"), "fqn", "line", end.alias("last"), "seq"
    )
    found = overlap_join(points, spans, ["file"], ("at", "at_end"), ("line", "last"))
    return first_by(found.withColumn("distance", F.col("at") - F.col("line")), ["file", "at"], ["distance", "seq", "fqn"], ["fqn"])


def match_symbols(graph: Graph, definitions: DataFrame) -> DataFrame:
    """(symbol, scip_fqn, fqn, kind, direct) of ``definitions(symbol, relative_path, start_line, seq)``.

    By name first; else by file and line, where a kind hint also admits the next
    line but only nodes of a fitting kind.
    """
    named = definitions.select(
        "symbol", scip_symbol_to_fqn(F.col("symbol")).alias("scip_fqn"), scip_descriptor_kind(F.col("symbol")).alias("hint"),
        bare_path(F.col("relative_path")).alias("file"), F.col("start_line").alias("at"), F.col("seq").alias("def_seq"),
    ).filter("scip_fqn <> ''")
    nodes = graph.nodes.select("fqn", "kind", bare_path(F.col("path")).alias("file"), "line", "seq")
    direct = named.join(nodes.select(F.col("fqn").alias("scip_fqn"), "kind"), "scip_fqn").select(
        "symbol", "def_seq", "scip_fqn", F.col("scip_fqn").alias("fqn"), "kind", F.lit(True).alias("direct")
    )
    lines = F.when(F.col("hint").isNull(), F.array("at")).otherwise(F.array(F.col("at"), F.col("at") + 1))
    missed = named.join(nodes.select(F.col("fqn").alias("scip_fqn")), "scip_fqn", "left_anti").withColumn("line", F.explode(lines))
    fits = F.col("hint").isNull()
    for hint, kinds in HINT_KINDS.items():
        fits = fits | ((F.col("hint") == hint) & F.col("kind").isin(*kinds))
    near = missed.join(nodes.filter("file IS NOT NULL AND line IS NOT NULL"), ["file", "line"]).filter(fits)
    near = first_by(near, ["symbol", "def_seq", "scip_fqn"], ["seq", "fqn"], ["fqn", "kind"]).withColumn("direct", F.lit(False))
    return direct.unionByName(near)


def symbol_renames(graph: Graph, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, renames) of the definitions in ``occurrences``; a node claimed by several symbols takes the longest name."""
    definitions = occurrences.filter(F.col("roles").bitwiseAND(1) != 0)
    matches = materialize(match_symbols(graph, definitions), "matches")
    renames = materialize(
        first_by(
            matches.filter("NOT direct AND length(scip_fqn) > length(fqn)").withColumn("shorter", -F.length("scip_fqn")),
            ["fqn"], ["shorter", "def_seq"], ["scip_fqn"],
        ),
        "renames",
    )
    return matches, renames


def _confirmations(nodes: DataFrame, occurrences: DataFrame, symbol_info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and implementations (src, dst) that the index knows of, between renamed ``nodes``; a callee may be unknown."""
    # The places of the references and their callees are two looks at one table; what an index repeats is dropped with the calls.
    references = materialize(occurrences.filter(F.col("roles").bitwiseAND(1) == 0).select(
        bare_path(F.col("relative_path")).alias("file"), F.col("start_line").alias("at"), scip_symbol_to_fqn(F.col("symbol")).alias("callee")
    ).filter("callee <> ''"), "references")
    callers = enclosing_functions(Graph(nodes, nodes), references)
    calls = references.join(callers, ["file", "at"]).select(F.col("fqn").alias("src"), F.col("callee").alias("dst")).distinct()
    known = nodes.select("fqn")
    implemented = (
        symbol_info.select(scip_symbol_to_fqn(F.col("symbol")).alias("src"), F.explode("relationships").alias("r"))
        .filter("r.is_implementation").select("src", scip_symbol_to_fqn(F.col("r.symbol")).alias("dst")).distinct()
        .join(known.select(F.col("fqn").alias("src")), "src", "left_semi").join(known.select(F.col("fqn").alias("dst")), "dst", "left_semi")
    )
    return calls, implemented


def confirmed_edges(graph: Graph, occurrences: DataFrame, symbol_info: DataFrame) -> DataFrame:
    """(src, dst, kind): the distinct edges that :func:`merge_symbols` confirms or adds, without the rest of the merged graph.

    A call to a known function is confirmed or added, whichever it is, so edges are looked up for other calls only.
    """
    _, renames = symbol_renames(graph, occurrences)
    named = graph.nodes.select("fqn", "kind", "path", "line", "end_line", "seq").join(renames, "fqn", "left")
    nodes = materialize(named.withColumn("fqn", F.coalesce("scip_fqn", "fqn")).drop("scip_fqn"), "nodes")
    calls, implemented = _confirmations(nodes, occurrences, symbol_info)
    calls = materialize(calls, "calls")
    functions = nodes.filter("kind = 'FUNCTION'").select(F.col("fqn").alias("dst"))
    functions = materialize(calls.select("dst").distinct().join(functions, "dst", "left_semi"), "callees")
    other = materialize(calls.join(functions, "dst", "left_anti").select("src", "dst"), "other")
    parts = [calls.join(functions, "dst", "left_semi").select("src", "dst", F.lit("CALLS").alias("kind")), implemented.select("src", "dst", F.lit("IMPLEMENTS").alias("kind"))]
    if not other.isEmpty():
        edges = graph.edges_of("CALLS").select("src", "dst")
        for end in ("src", "dst"):
            new = renames.select(F.col("fqn").alias(end), F.col("scip_fqn").alias("new"))
            edges = edges.join(new, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
        parts.append(other.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").withColumn("kind", F.lit("CALLS")))
    return _union(parts)


def merge_symbols(graph: Graph, occurrences: DataFrame, symbol_info: DataFrame) -> tuple[Graph, dict[str, DataFrame]]:
    """Graph with precise names, documentation and confirmed calls, plus what changed.

    ``occurrences(relative_path, symbol, roles, start_line, seq)`` and
    ``symbol_info(symbol, documentation, relationships)``. All renames are worked
    out first (:func:`symbol_renames`) and applied to nodes and both edge ends once.
    """
    matches, renames = symbol_renames(graph, occurrences)
    docs = symbol_info.filter(F.size("documentation") > 0).select("symbol", F.array_join("documentation", "\n").alias("text"))
    documented = last_by(matches.join(docs, "symbol"), ["fqn"], ["def_seq"], ["text"])
    base = graph.nodes.join(renames, "fqn", "left").join(documented, "fqn", "left")
    props = F.when(
        F.col("text").isNotNull(),
        F.map_concat(
            F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: k != "documentation"),
            F.create_map(F.lit("documentation"), F.col("text")),
        ),
    ).otherwise(F.col("props"))
    nodes = base.withColumn("props", props).withColumn("fqn", F.coalesce("scip_fqn", "fqn")).select(*graph.nodes.columns)
    edges = graph.edges
    for end in ("src", "dst"):
        new = renames.select(F.col("fqn").alias(end), F.col("scip_fqn").alias("new"))
        edges = edges.join(new, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    renamed = Graph(materialize(nodes, "nodes"), materialize(edges.select(*graph.edges.columns), "edges"))

    calls, implemented = _confirmations(renamed.nodes, occurrences, symbol_info)
    known = renamed.nodes.select("fqn", "kind")
    confirmed = materialize(
        calls.withColumn("kind", F.lit("CALLS")).unionByName(implemented.withColumn("kind", F.lit("IMPLEMENTS"))), "confirmed"
    )
    firsts = renamed.edges_of("CALLS", "IMPLEMENTS").groupBy("src", "dst", "kind").agg(F.min("seq").alias("first_seq"))
    upgrades = confirmed.join(firsts, ["src", "dst", "kind"])
    functions = known.filter("kind = 'FUNCTION'").select(F.col("fqn").alias("dst"))
    absent = confirmed.join(firsts, ["src", "dst", "kind"], "left_anti")
    added = absent.filter("kind = 'IMPLEMENTS'").unionByName(absent.filter("kind = 'CALLS'").join(functions, "dst", "left_semi").select(*absent.columns))
    marked = renamed.edges.join(upgrades.withColumn("hit", F.lit(True)), ["src", "dst", "kind"], "left")
    hit = F.coalesce(F.col("hit") & F.col("seq").eqNullSafe(F.col("first_seq")), F.lit(False))
    upgraded = marked.withColumn("confidence", F.when(hit, F.lit(HIGH).cast("tinyint")).otherwise(F.col("confidence"))).withColumn(
        "evidence", F.when(hit, "scip").otherwise(F.col("evidence"))
    ).select(*graph.edges.columns)
    fresh = edge_rows(added.withColumn("evidence", F.lit("scip")))
    report = {"matches": matches, "renames": renames, "upgrades": upgrades, "added": added}
    return Graph(renamed.nodes, upgraded.unionByName(fresh)), report


# --- short names to full names -----------------------------------------------------------


def short_names(graph: Graph, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(name, candidates, first): how many nodes share a short name, and the smallest of them; one row per name."""
    pool = graph.nodes if kinds is None else graph.nodes.filter(F.col("kind").isin(*kinds))
    return pool.groupBy("name").agg(F.count("*").alias("candidates"), F.min("fqn").alias("first"))


def resolve_types(graph: Graph, wanted: DataFrame, unique_kinds: tuple[str, ...] | None = ("CLASS", "INTERFACE")) -> DataFrame:
    """(class_fqn, type_name, resolved) of ``wanted(class_fqn, type_name)``; a missing type name resolves to nothing.

    The using directives of the class in order, then its own namespace, then a
    name that only one node has.
    """
    return _resolved_types(graph, wanted, unique_kinds).drop("is_type")


def _resolved_types(graph: Graph, wanted: DataFrame, unique_kinds: tuple[str, ...] | None) -> DataFrame:
    """What :func:`resolve_types` gives, and whether ``resolved`` is a class or an interface (of use with the default kinds only).

    Only nodes that end on a wanted name are looked at: names are far fewer than nodes.
    """
    wanted = materialize(wanted.select("class_fqn", "type_name").filter("type_name IS NOT NULL").distinct(), "wanted")
    words = materialize(wanted.select("type_name").distinct().select("type_name", short_name(F.col("type_name")).alias("last")), "words")
    known = graph.nodes.join(words.select("last"), short_name(F.col("fqn")) == F.col("last"), "left_semi")
    known = known.groupBy(F.col("fqn").alias("resolved")).agg(F.max(F.col("kind").isin("CLASS", "INTERFACE")).alias("is_type"))
    known = materialize(known.withColumn("last", short_name(F.col("resolved"))), "known")
    named = graph.nodes.join(words.select("type_name"), F.col("name") == F.col("type_name"), "left_semi")
    unique = short_names(Graph(named, graph.edges), unique_kinds).filter("candidates = 1").select(F.col("name").alias("type_name"), F.col("first").alias("unique"))
    ending = known.groupBy("last").agg(F.count("*").alias("n"), F.min("resolved").alias("only"), F.max("is_type").alias("only_is_type"))
    words = materialize(words.join(ending, "last", "left").join(unique, "type_name", "left").drop("last"), "words")

    usings = graph.of_kind("CLASS").filter(F.size("usings") > 0).select(F.col("fqn").alias("class_fqn"), F.posexplode("usings").alias("rung", "namespace"))
    usings = usings.groupBy("class_fqn").agg(F.array_sort(F.collect_list(F.struct("rung", "namespace"))).alias("usings"))
    namespace = owner_name(F.col("class_fqn"))
    spaces = F.concat(F.coalesce(F.col("usings.namespace"), F.array().cast("array<string>")), F.when(namespace != "", F.array(namespace)).otherwise(F.array().cast("array<string>")))
    asked = wanted.join(usings, "class_fqn", "left").withColumn("tried", F.transform(spaces, lambda s: F.concat_ws(".", s, "type_name"))).drop("usings").join(words, "type_name")
    keys = ["class_fqn", "type_name"]

    # One node ends on the name: it is the answer if it is among what the class would try.
    hit = F.coalesce((F.col("n") == 1) & F.array_contains("tried", F.col("only")), F.lit(False))
    is_type = F.when(hit, F.col("only_is_type")).otherwise(F.lit(unique_kinds is not None))
    found = asked.filter("coalesce(n, 0) <= 1").select(*keys, F.when(hit, F.col("only")).otherwise(F.col("unique")).alias("resolved"), is_type.alias("is_type"))
    # Several do: what the class would try is looked up in order.
    several = asked.filter("n > 1").select(*keys, F.posexplode("tried").alias("rung", "resolved")).join(known.drop("last"), "resolved")
    several = several.unionByName(
        asked.filter("n > 1 AND unique IS NOT NULL").select(*keys, F.lit(1 << 21).alias("rung"), F.col("unique").alias("resolved"), F.lit(unique_kinds is not None).alias("is_type"))
    )
    return found.filter("resolved IS NOT NULL").unionByName(first_by(several, keys, ["rung"], ["resolved", "is_type"]))


def _containers(graph: Graph) -> DataFrame:
    """(fqn, parent): the last container of each node."""
    contains = graph.edges_of("CONTAINS").select(F.col("dst").alias("fqn"), F.col("src").alias("parent"), "seq")
    return last_by(contains, ["fqn"], ["seq", "parent"], ["parent"])


def _field_types(fields: DataFrame, contains: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(class_fqn, first_receiver, ...)`` with the ``type_name`` of the last field of that name in the class, if there is one.

    A field that is named after its class is looked up by its full name. The ``odd`` rest, fields with another name or
    container than their full name says, is sorted by container first.
    """
    fields = fields.select("fqn", "name", F.trim(F.substring_index("type", "<", 1)).alias("type_name"), "seq")
    plain = F.col("name").eqNullSafe(short_name(F.col("fqn"))) & F.contains(F.col("fqn"), F.lit("."))
    held = F.col("src").eqNullSafe(owner_name(F.col("dst")))
    odd = materialize(fields.filter(~plain).select("fqn").unionByName(contains.filter(~held).select(F.col("dst").alias("fqn"))).distinct(), "odd")
    some = not odd.isEmpty()

    usual = fields.filter(plain)
    if some:
        usual = usual.join(odd, "fqn", "left_anti")
    usual = usual.join(contains.filter(held).select(F.col("dst").alias("fqn")), "fqn", "left_semi")
    usual = last_by(usual, ["fqn"], ["seq"], ["type_name", "seq"])
    found = asked.withColumn("fqn", F.concat_ws(".", "class_fqn", "first_receiver")).join(usual, "fqn", "left")
    if not some:
        return found.drop("fqn", "seq")
    rest = contains.join(odd.withColumnRenamed("fqn", "dst"), "dst", "left_semi")
    rest = last_by(rest.withColumnRenamed("src", "class_fqn").withColumnRenamed("dst", "fqn"), ["fqn"], ["seq", "class_fqn"], ["class_fqn"])
    rest = fields.withColumnRenamed("name", "first_receiver").join(odd, "fqn", "left_semi").join(rest, "fqn")
    rest = last_by(rest.withColumn("at", F.struct("seq", "fqn")), ["class_fqn", "first_receiver"], ["seq", "fqn"], ["at", "type_name"])
    both = found.join(rest.withColumnRenamed("type_name", "other"), ["class_fqn", "first_receiver"], "left")
    later = F.col("at").isNotNull() & (F.col("type_name").isNull() | (F.col("at") > F.struct("seq", "fqn")))
    return both.withColumn("type_name", F.when(later, F.col("other")).otherwise(F.col("type_name"))).drop("fqn", "seq", "at", "other")


def resolve_calls(graph: Graph) -> DataFrame:
    """(src, dst, resolved, rung): targets found for LOW calls to unknown names.

    Every rung looks names up in a table with one row per key, so a name that a
    million nodes share costs one row, not a million candidates. What depends on
    the called name alone is found once per name; a call goes down the ladder
    only as far as it is open, and no rung is a second row of it.
    """
    nodes = graph.nodes.select("fqn", "name", "kind", "seq")
    low = graph.edges_of("CALLS").filter(F.col("confidence") == LOW).select("src", "dst")
    names = materialize(
        low.select("dst").distinct().select(
            "dst", F.contains(F.col("dst"), F.lit(".")).alias("dotted"), owner_name(F.col("dst")).alias("receiver"), short_name(F.col("dst")).alias("method")
        ),
        "names",
    )
    first_receiver = F.substring_index("receiver", ".", 1)
    ends = materialize(names.select("method").distinct(), "ends")
    known = nodes.select("fqn").join(ends, short_name(F.col("fqn")) == F.col("method"), "left_semi").distinct()
    known = materialize(known.select("fqn", owner_name(F.col("fqn")).alias("owner"), short_name(F.col("fqn")).alias("method")), "known")
    open_names = materialize(names.join(known.select(F.col("fqn").alias("dst")), "dst", "left_anti"), "open")
    dotted, plain = open_names.filter("dotted"), open_names.filter("NOT dotted")

    # A class known by its short name owns the method; ``new Foo()`` without a declared constructor binds to the class.
    receivers = materialize(dotted.select("receiver").distinct(), "receivers")
    classes = nodes.filter(F.col("kind").isin("CLASS", "INTERFACE")).join(receivers, F.col("name") == F.col("receiver"), "left_semi")
    classes = materialize(classes.select(F.col("fqn").alias("owner"), F.col("name").alias("receiver"), "seq"), "classes")
    by_class = known.filter(F.contains(F.col("fqn"), F.lit("."))).join(classes.filter("owner <> ''"), "owner")
    by_class = first_by(by_class, ["receiver", "method"], ["seq", "owner"], ["fqn"]).withColumnRenamed("fqn", "owned")
    first_class = first_by(classes, ["receiver"], ["seq", "owner"], ["owner"]).select("receiver", F.col("receiver").alias("method"), F.col("owner").alias("built"))
    typed_fields = graph.of_kind("FIELD").filter(F.coalesce("type", F.lit("")) != "")
    field_names = typed_fields.select(F.col("name").alias("first_receiver"), F.lit(True).alias("fielded")).distinct()
    plain = materialize(plain.select("dst", "dotted"), "plain")
    named = materialize(nodes.select(F.col("name").alias("dst"), "fqn").join(plain.select("dst"), "dst", "left_semi"), "named")
    unique = named.groupBy("dst").agg(F.count("*").alias("n"), F.min("fqn").alias("only")).filter("n = 1").drop("n")
    info = dotted.withColumn("first_receiver", first_receiver).join(by_class, ["receiver", "method"], "left").join(first_class, ["receiver", "method"], "left")
    info = info.join(field_names, "first_receiver", "left").select("dst", "dotted", "owned", "built", F.coalesce("fielded", F.lit(False)).alias("fielded"))
    info = materialize(info.unionByName(plain.join(unique, "dst", "left").select("dst", "dotted", "only"), allowMissingColumns=True), "info")

    # Every call with what is known of its name, and the class of its caller.
    caller_ends = materialize(low.select(short_name(F.col("src")).alias("end")).distinct(), "caller_ends")
    contains = graph.edges_of("CONTAINS").join(caller_ends, short_name(F.col("dst")) == F.col("end"), "left_semi")
    callers = _containers(Graph(graph.nodes, contains)).select(F.col("fqn").alias("src"), F.col("parent").alias("class_fqn"))
    imports = materialize(graph.edges_of("IMPORTS").select(F.col("src").alias("class_fqn"), F.col("dst").alias("imported"), "seq"), "imports")
    imported = not imports.isEmpty()
    asked = low.distinct().join(info, "dst")
    if imported:
        asked = asked.join(callers, "src", "left")
    else:  # the class is of no use where the name alone decides
        asked = asked.filter("owned IS NULL").join(callers, "src", "left").unionByName(asked.filter("owned IS NOT NULL").withColumn("class_fqn", F.lit(None).cast("string")))
    asked = materialize(asked, "asked")
    rows = asked.filter("dotted AND owned IS NULL").withColumn("receiver", owner_name(F.col("dst"))).withColumn("method", short_name(F.col("dst")))
    by_field = "fielded AND class_fqn IS NOT NULL"

    # The receiver is a field of the caller's class; its type owns the method.
    typed = _field_types(typed_fields, graph.edges_of("CONTAINS").select("src", "dst", "seq"), rows.filter(by_field).withColumn("first_receiver", first_receiver))
    typed = materialize(typed.select("src", "dst", "class_fqn", "built", "type_name"), "typed")
    types = resolve_types(graph, typed, unique_kinds=None).withColumnRenamed("resolved", "type_fqn")
    members = known.filter(F.contains(F.col("fqn"), F.lit("."))).select(F.col("owner").alias("type_fqn"), "method", F.col("fqn").alias("member"))
    tried = typed.join(types, ["class_fqn", "type_name"], "left").withColumn("method", short_name(F.col("dst"))).join(members, ["type_fqn", "method"], "left")
    tried = materialize(tried.select("src", "dst", "class_fqn", "built", "member"), "tried")

    def step(found, resolved, rung):
        return found.select("src", "dst", "class_fqn", F.col(resolved).alias("resolved"), F.lit(rung).alias("rung"))

    others = rows.filter(f"NOT ({by_field})").select("src", "dst", "class_fqn", "built", F.lit(None).cast("string").alias("member")).unionByName(tried)
    left = others.filter("member IS NULL AND built IS NULL AND class_fqn IS NOT NULL")
    ladder = [
        step(asked.filter("dotted AND owned IS NOT NULL"), "owned", 1), step(tried.filter("member IS NOT NULL"), "member", 2),
        step(others.filter("member IS NULL AND built IS NOT NULL"), "built", 3),
    ]

    # The receiver is a type reachable through the using directives.
    if not left.isEmpty():
        through = left.select("src", "dst", "class_fqn", owner_name(F.col("dst")).alias("type_name"), short_name(F.col("dst")).alias("method"))
        through = through.join(resolve_types(graph, through, unique_kinds=None).withColumnRenamed("resolved", "type_fqn"), ["class_fqn", "type_name"])
        through = through.join(members, ["type_fqn", "method"], "left").withColumn("built", F.when(F.col("method") == F.col("type_name"), F.col("type_fqn")))
        through = materialize(through.select("src", "dst", "class_fqn", "member", "built"), "through")
        ladder += [step(through.filter("member IS NOT NULL"), "member", 4), step(through.filter("member IS NULL AND built IS NOT NULL"), "built", 5)]

    # Same package: one row per (name, package prefix) tells whether the name is unique there. Else the name is unique as a whole.
    package = owner_name(F.col("fqn"))
    parts = F.split(package, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    prefixes = F.when(F.contains(package, F.lit(".")) | (package == ""), prefixes).otherwise(F.array_append(prefixes, F.lit("")))
    local = named.select("dst", "fqn", F.explode(F.array_distinct(prefixes)).alias("package"))
    local = local.groupBy("dst", "package").agg(F.count("*").alias("n"), F.min("fqn").alias("near")).filter("n = 1").drop("n")
    unqualified = asked.filter("NOT dotted").withColumn("package", owner_name(F.col("class_fqn"))).join(local, ["dst", "package"], "left")
    nearest = [step(unqualified.filter("near IS NOT NULL"), "near", 6), step(unqualified.filter("near IS NULL AND only IS NOT NULL"), "only", 7)]

    # An import of the caller's class that owns the target beats every other rung.
    found = _union(ladder + nearest).select("src", "dst", "resolved", "rung")
    if not imported:
        return found
    imports = imports.join(nodes.select(F.col("fqn").alias("imported")), "imported", "left_semi")
    importable = asked.filter("NOT dotted").select("src", "dst", "class_fqn").unionByName(_union(ladder).select("src", "dst", "class_fqn"))
    imported = importable.join(imports, "class_fqn").withColumn("fqn", F.concat_ws(".", "imported", "dst")).join(known.select("fqn"), "fqn", "left_semi")
    imported = first_by(imported, ["src", "dst"], ["seq", "imported"], ["fqn"]).withColumnRenamed("fqn", "resolved").withColumn("rung", F.lit(0))
    return first_by(found.unionByName(imported.select(*found.columns)), ["src", "dst"], ["rung"], ["resolved", "rung"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_resolved_calls(graph: Graph) -> Graph:
    """Graph whose LOW calls point at the resolved targets with MEDIUM confidence."""
    found = resolve_calls(graph).select("src", "dst", "resolved")
    joined = graph.edges.join(found, ["src", "dst"], "left")
    hit = (F.col("kind") == "CALLS") & (F.col("confidence") == LOW) & F.col("resolved").isNotNull()
    edges = joined.withColumn("dst", F.when(hit, F.col("resolved")).otherwise(F.col("dst"))).withColumn(
        "confidence", F.when(hit, F.lit(MEDIUM).cast("tinyint")).otherwise(F.col("confidence"))
    )
    return Graph(graph.nodes, edges.select(*graph.edges.columns))


def referenced_types(graph: Graph) -> DataFrame:
    """(class_fqn, type_name): types a class names in constructors, fields, its base and its interfaces."""
    return _referenced(graph, with_usings=False)


def _referenced(graph: Graph, with_usings: bool) -> DataFrame:
    """What :func:`referenced_types` gives, or what it gives of classes ``with_usings``."""
    classes = graph.of_kind("CLASS").filter(F.size("usings") > 0)
    links = graph.edges_of("CONTAINS").select(F.col("src").alias("class_fqn"), F.col("dst").alias("fqn"), "seq")
    # Constructors have few names, so most of what classes contain is left out before it is compared.
    built = graph.of_kind("FUNCTION").filter("is_constructor").select("fqn", "params")
    ends = materialize(built.select(short_name(F.col("fqn")).alias("end")).distinct(), "ends")
    holders = graph.of_kind("CLASS").select(F.col("fqn").alias("class_fqn"))
    owners = links.join(ends, short_name(F.col("fqn")) == F.col("end"), "left_semi").join(holders, "class_fqn", "left_semi")
    owners = last_by(owners, ["fqn"], ["seq", "class_fqn"], ["class_fqn"])
    named = owners.join(built.select("fqn", F.explode("params.type").alias("text")), "fqn").select("class_fqn", "text")
    if with_usings:
        named = named.join(classes.select(F.col("fqn").alias("class_fqn")), "class_fqn", "left_semi")
    held = graph.of_kind("FIELD").select("fqn", F.col("type").alias("text"))
    contained = links.drop("seq").join(held, "fqn").select("class_fqn", "text").join(classes.select(F.col("fqn").alias("class_fqn")), "class_fqn", "left_semi")
    nested = named.unionByName(contained)
    nested = nested.select("class_fqn", F.explode(bare_types(F.col("text"))).alias("type_name"))
    parents = classes.select(
        F.col("fqn").alias("class_fqn"),
        F.explode(F.concat(F.array("base_class"), F.coalesce("implements", F.array().cast("array<string>")))).alias("text"),
    ).select("class_fqn", F.substring_index("text", "<", 1).alias("type_name"))
    rows = nested.unionByName(parents).filter(F.coalesce("type_name", F.lit("")) != "")
    return rows.filter(~F.col("type_name").isin(*BUILTIN_TYPES)).distinct()


def using_dependencies(graph: Graph) -> DataFrame:
    """DEPENDS_ON edges from the types a class names, where no dependency exists yet."""
    pairs = _resolved_types(graph, _referenced(graph, with_usings=True), ("CLASS", "INTERFACE")).filter("is_type")
    pairs = pairs.select(F.col("class_fqn").alias("src"), F.col("resolved").alias("dst")).filter("src <> dst").distinct()
    fresh = pairs.join(graph.edges_of("DEPENDS_ON").select("src", "dst"), ["src", "dst"], "left_anti")
    return edge_rows(
        fresh.select("src", "dst", F.lit("DEPENDS_ON").alias("kind"), F.lit(MEDIUM).alias("confidence"), F.lit("using-resolution").alias("evidence"), F.lit(1).alias("weight"))
    )


# --- interface methods to implementations ------------------------------------------------


def declared_interfaces(graph: Graph) -> DataFrame:
    """(iface, impl): interfaces a class declares, by simple name; the last interface of a name wins."""
    interfaces = last_by(graph.of_kind("INTERFACE").select("name", "fqn", "seq"), ["name"], ["seq", "fqn"], ["fqn"])
    declared = graph.of_kind("CLASS").select(F.col("fqn").alias("impl"), F.explode("implements").alias("text")).select(
        "impl", F.trim(F.substring_index("text", "<", 1)).alias("name")
    )
    return declared.join(interfaces, "name").select(F.col("fqn").alias("iface"), "impl").filter("iface <> impl").distinct()


def method_bridges(graph: Graph, pairs: DataFrame) -> DataFrame:
    """IMPLEMENTS edges from interface methods to the methods that serve them.

    ``pairs(iface, impl)``. Inherited methods count; the class nearest to the
    implementation wins a name.
    """
    functions = graph.of_kind("FUNCTION").select(F.col("fqn").alias("dst"), "name")
    contained = graph.edges_of("CONTAINS").select("src", "dst", "seq").join(functions, "dst")
    parents = first_by(graph.edges_of("INHERITS").select("src", "dst", "seq"), ["src"], ["seq", "dst"], ["dst"])
    lineage = chains(parents.select(F.col("src").alias("child"), F.col("dst").alias("parent")), pairs.select(F.col("impl").alias("seed")))
    lineage = lineage.select(F.col("seed").alias("impl"), F.col("node").alias("cls"), F.col("up").alias("depth"))
    served = lineage.join(contained.withColumnRenamed("src", "cls"), "cls")
    served = first_by(served, ["impl", "name"], ["depth", "seq", "dst"], ["dst"]).withColumnRenamed("dst", "impl_method")
    offered = last_by(contained.withColumnRenamed("src", "iface"), ["iface", "name"], ["seq", "dst"], ["dst"])
    bridges = pairs.distinct().join(offered, "iface").join(served, ["impl", "name"]).select(F.col("dst").alias("src"), F.col("impl_method").alias("dst")).distinct()
    return edge_rows(bridges.select("src", "dst", F.lit("IMPLEMENTS").alias("kind"), F.lit("method-bridge").alias("evidence")))
