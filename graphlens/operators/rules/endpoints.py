"""Endpoints: one endpoint shape for controllers, routes, resources, hubs and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, last_by
from graphlens.functions.text import collapse_slashes, combine_route, controller_route, join_paths, owner_name
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.rules import RuleResult
from graphlens.operators.rules.injection import _names, children_of, resolve_references
from graphlens.schema import literal_map

# Verb annotations in the order they are tried.
MAPPING_VERBS = {
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
}
ATTRIBUTE_VERBS = {
    "HttpGet": "GET",
    "HttpPost": "POST",
    "HttpPut": "PUT",
    "HttpDelete": "DELETE",
    "HttpPatch": "PATCH",
    "HttpOptions": "OPTIONS",
    "HttpHead": "HEAD",
}
BINDINGS = {"FromBody": "body", "FromQuery": "query", "FromRoute": "route"}
CONTROLLER_BASES = ["ControllerBase", "Controller", "ODataController"]
HUB_LIFECYCLE = ["OnConnectedAsync", "OnDisconnectedAsync"]
HTTP_METHOD_NAMES = ["get", "post", "put", "delete", "patch", "options", "head"]
# Route declarations, from the grammar of calls: a Python string has either quote (two groups, one of them empty).
STRING = r"""[rRbBuU]?(?:"([^"]*)"|'([^']*)')"""
IDENTIFIER = r"([A-Za-z_]\w*)"
ARGUMENTS = r"(?:[^()]|\([^()]*\))*?"


def _keyword(call: str, keyword: str) -> str:
    """A string given to ``keyword`` anywhere in the arguments of ``call``."""
    return rf"\b{call}\s*\({ARGUMENTS}\b{keyword}\s*=\s*{STRING}"


def _leading(keyword: str) -> str:
    """A string as first argument, or given to ``keyword``."""
    return rf"\((?:{ARGUMENTS}\b{keyword}\s*=)?\s*{STRING}"


ROUTE_DECORATOR = rf"(?i)^\s*@?\s*{IDENTIFIER}\s*\.\s*({'|'.join(HTTP_METHOD_NAMES)})\s*{_leading('path')}"
ROUTER_PREFIX = _keyword("APIRouter", "prefix")
FLASK_ROUTE = rf"^\s*@?\s*{IDENTIFIER}\s*\.\s*route\s*{_leading('rule')}"
FLASK_METHODS = r"\bmethods\s*=\s*[\[({]([^\])}]*)[\])}]"
URL_RULE = rf"^\s*(?:\w+\s*\.\s*)*add_url_rule\s*{_leading('rule')}"
VIEW_FUNCTION = rf"\bview_func\s*=\s*{IDENTIFIER}"
BLUEPRINT_PREFIX = _keyword("Blueprint", "url_prefix")
REGISTRATION = r"\bregister_blueprint\s*\((?:[^()]|\([^()]*\))*\)"
REGISTERED = rf"\(\s*(?:blueprint\s*=\s*)?(?:\w+\s*\.\s*)*{IDENTIFIER}"
GIVEN_PREFIX = rf"\burl_prefix\s*=\s*{STRING}"
SERVICE_BASE = r"^(\w+)\.\1Base$"
# Generated actions per viewset type as (action, verb, path suffix).
VIEWSET_ACTIONS = {
    "ModelViewSet": [
        ("list", "GET", ""),
        ("create", "POST", ""),
        ("retrieve", "GET", "/{pk}"),
        ("update", "PUT", "/{pk}"),
        ("partial_update", "PATCH", "/{pk}"),
        ("destroy", "DELETE", "/{pk}"),
    ],
    "ReadOnlyModelViewSet": [
        ("list", "GET", ""),
        ("retrieve", "GET", "/{pk}"),
    ],
}
VIEWSET_BASES = ["viewsets.ModelViewSet", "viewsets.ReadOnlyModelViewSet", "viewsets.ViewSet", "generics.", "views.APIView"]


def endpoint_result(
    rows: DataFrame, framework: str, prefixed: bool, handler_entry: bool, entry_kind: str = "http_endpoint", exposes: bool = True,
    layer_of: str = "owner",
) -> RuleResult:
    """Nodes, HANDLES, EXPOSES, layers and entry points of ``rows(owner, handler, verb, url)``."""
    fqn = F.concat_ws(":", F.lit("endpoint"), "verb", "url") if prefixed else F.concat_ws(":", "verb", "url")
    rows = rows.withColumn("endpoint", fqn)
    nodes = node_rows(rows.select("endpoint", "verb", "url").distinct().select(
        F.col("endpoint").alias("fqn"), F.concat_ws(" ", "verb", "url").alias("name"), F.lit("API_ENDPOINT").alias("kind"),
        F.col("verb").alias("method"), F.lit(framework).alias("framework"), F.create_map(F.lit("path"), "url").alias("props"),
    ))

    def links(src, kind):
        return edge_rows(rows.select(F.col(src).alias("src"), F.col("endpoint").alias("dst")).distinct().select(
            "*", F.lit(kind).alias("kind"), F.lit(framework).alias("evidence")
        ))

    edges = links("handler", "HANDLES")
    if exposes:
        edges = edges.unionByName(links("owner", "EXPOSES"))
    points = rows.select(
        F.col("handler" if handler_entry else "endpoint").alias("fqn"), F.lit(entry_kind).alias("kind"),
        F.create_map(F.lit("method"), "verb", F.lit("path"), "url").alias("metadata"),
    )
    layers = rows.select(F.col(layer_of).alias("fqn")).distinct().withColumn("layer", F.lit("Presentation"))
    return RuleResult(nodes=nodes, edges=edges, layers=layers, entry_points=points)


def _string(text, pattern: str, group: int = 1) -> Column:
    """The string that ``pattern`` captures in ``group`` or, with the other quote, the next one."""
    return F.concat(F.regexp_extract(text, pattern, group), F.regexp_extract(text, pattern, group + 1))


def _arg(name: str) -> Column:
    return F.coalesce(F.col("annotation_args")[name], F.lit(""))


def _first_verb(verbs: dict[str, str]) -> Column:
    """The first verb annotation of the table that a method carries."""
    return F.get(F.array_intersect(F.array(*[F.lit(v) for v in verbs]), F.col("annotations")), F.lit(0))


def annotated_controllers(graph: Graph) -> RuleResult:
    """Controller classes with mapping annotations: class prefix plus method path."""
    stereotype = F.arrays_overlap("annotations", F.array(F.lit("Controller"), F.lit("RestController")))
    classes = graph.of_kind("CLASS").filter(stereotype).select(F.col("fqn").alias("owner"), F.regexp_replace(_arg("RequestMapping"), "/+$", "").alias("prefix"))
    methods = children_of(graph, classes, "FUNCTION", "annotations", "annotation_args").join(classes, "owner")
    methods = methods.withColumn("mapping", _first_verb(MAPPING_VERBS))
    generic = F.array_contains("annotations", "RequestMapping")
    verb = F.coalesce(
        literal_map(MAPPING_VERBS)[F.col("mapping")],
        F.when(generic, F.upper(F.coalesce(F.col("annotation_args")["method"], F.lit("GET")))),
    )
    path = F.when(F.col("mapping").isNotNull(), F.coalesce(F.col("annotation_args")[F.col("mapping")], F.lit(""))).otherwise(_arg("RequestMapping"))
    path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    full = F.concat("prefix", path)
    rows = methods.select("owner", F.col("fqn").alias("handler"), verb.alias("verb"), F.when(full == "", "/").otherwise(full).alias("url"))
    return endpoint_result(rows.filter("verb IS NOT NULL"), "spring", prefixed=True, handler_entry=True)


def server_controllers(graph: Graph) -> RuleResult:
    """Attribute-routed controllers with route tokens; bound parameter types become dependencies."""
    marked = F.coalesce(F.array_contains("annotations", "ApiController"), F.lit(False)) | F.coalesce(F.col("base_class").isin(*CONTROLLER_BASES), F.lit(False))
    classes = graph.of_kind("CLASS").filter(marked).select(F.col("fqn").alias("owner"), controller_route(_arg(""), F.col("name")).alias("prefix"))
    methods = children_of(graph, classes, "FUNCTION", "name", "annotations", "annotation_args", "params").join(classes, "owner")
    methods = methods.withColumn("mapping", _first_verb(ATTRIBUTE_VERBS)).filter("mapping IS NOT NULL")
    own = F.coalesce(F.col("annotation_args")[""], F.col("annotation_args")[F.col("mapping")], F.lit(""))
    route = F.when(F.array_contains("annotations", "Route"), F.nullif(_arg("Route"), F.lit("")))
    absolute = route.startswith("/") | route.startswith("~/")
    relative = combine_route(F.col("prefix"), F.coalesce(F.when(~absolute, route), own), F.col("name"))
    fixed = F.regexp_replace(F.regexp_replace(route, "^~+", ""), r"\{(\w+)(?:[?:][^}]*)?\}", ":$1")
    rows = methods.select(
        "owner", F.col("fqn").alias("handler"), literal_map(ATTRIBUTE_VERBS)[F.col("mapping")].alias("verb"),
        F.when(F.coalesce(absolute, F.lit(False)), fixed).otherwise(relative).alias("url"), "params",
    )
    result = endpoint_result(rows, "aspnet", prefixed=True, handler_entry=True)
    return RuleResult(result.nodes, result.edges.unionByName(bound_types(graph, rows)), result.layers, result.entry_points)


def bound_types(graph: Graph, rows: DataFrame) -> DataFrame:
    """DEPENDS_ON from an endpoint to the class of each bound parameter."""
    params = rows.select(F.concat_ws(":", F.lit("endpoint"), "verb", "url").alias("src"), F.explode("params").alias("p"))
    marks = F.array_intersect("p.annotations", F.array(*[F.lit(b) for b in BINDINGS]))
    params = params.select("src", F.col("p.type").alias("name"), F.explode(marks).alias("mark"))
    return edge_rows(
        params.join(_names(graph), "name").select(
            "src", F.col("fqn").alias("dst"), F.lit("DEPENDS_ON").alias("kind"), F.lit("aspnet-web").alias("evidence"),
            F.create_map(F.lit("binding"), literal_map(BINDINGS)[F.col("mark")]).alias("props"),
        )
    )


def mapped_handlers(groups: DataFrame, calls: DataFrame) -> RuleResult:
    """Minimal endpoints: ``calls(owner, handler, verb, path, group_name)`` under ``groups(group_name, prefix)``."""
    rows = calls.join(groups.select("group_name", "prefix"), "group_name", "left").select(
        "owner", "handler", "verb", combine_route(F.col("prefix"), F.col("path"), F.lit("")).alias("url")
    )
    return endpoint_result(rows, "aspnet", prefixed=True, handler_entry=True)


def remote_services(graph: Graph, registered: DataFrame) -> RuleResult:
    """Override methods of registered service classes; ``registered(name)``."""
    service = F.regexp_extract("base_class", SERVICE_BASE, 1)
    classes = graph.of_kind("CLASS").withColumn("service", service).filter("service <> ''").join(registered.select("name").distinct(), "name", "left_semi")
    classes = classes.select(F.col("fqn").alias("owner"), "service")
    methods = children_of(graph, classes, "FUNCTION", "name", "props").filter(F.col("props")["is_override"] == "true").join(classes, "owner")
    rows = methods.select("owner", F.col("fqn").alias("handler"), F.lit("GRPC").alias("verb"), F.concat(F.lit("/"), "service", F.lit("/"), "name").alias("url"))
    return endpoint_result(rows, "grpc", prefixed=True, handler_entry=True, entry_kind="grpc_endpoint")


def socket_hubs(graph: Graph, mapped: DataFrame) -> RuleResult:
    """Hub classes with a mapped path; ``mapped(name, url)``. Client methods become PRODUCES edges."""
    hubs = graph.of_kind("CLASS").filter("base_class = 'Hub' OR base_class LIKE 'Hub<%'").join(
        last_by(mapped.withColumn("o", F.col("url")), ["name"], ["o"], ["url"]), "name"
    ).select(F.col("fqn").alias("owner"), "url", F.regexp_extract("base_class", r"^Hub<(.*)>$", 1).alias("client"))
    methods = children_of(graph, hubs, "FUNCTION", "name", "is_constructor").filter(
        ~F.col("name").isin(*HUB_LIFECYCLE) & ~F.coalesce("is_constructor", F.lit(False))
    ).join(hubs, "owner")
    rows = methods.select("owner", F.col("fqn").alias("handler"), F.lit("WS").alias("verb"), "url")
    result = endpoint_result(rows, "signalr", prefixed=True, handler_entry=True, entry_kind="websocket_endpoint")
    clients = hubs.filter("client <> ''").select(F.col("owner").alias("src"), "url", F.col("client").alias("name")).join(_names(graph), "name")
    told = children_of(graph, clients.select(F.col("fqn").alias("owner")), "FUNCTION", "name").select(F.col("owner").alias("fqn"), F.col("name").alias("event"))
    events = clients.join(told, "fqn").select(
        "src", F.concat(F.lit("endpoint:WS:"), "url").alias("dst"), F.lit("PRODUCES").alias("kind"), F.lit("aspnet-signalr").alias("evidence"),
        F.create_map(F.lit("event"), "event").alias("props"),
    )
    return RuleResult(result.nodes, result.edges.unionByName(edge_rows(events)), result.layers, result.entry_points)


# --- decorated functions -----------------------------------------------------------------


def decorated_routes(graph: Graph) -> RuleResult:
    """Functions under ``@router.verb("path")``; the router's prefix is found by its variable name."""
    fields = graph.of_kind("FIELD").filter("language = 'python'").select("name", _string("value", ROUTER_PREFIX).alias("prefix"), "seq", "fqn")
    prefixes = last_by(fields.filter("prefix <> ''"), ["name"], ["seq", "fqn"], ["prefix"])
    routes = graph.of_kind("FUNCTION").filter("language = 'python'").select("fqn", F.explode("annotations").alias("d")).filter(F.col("d").rlike(ROUTE_DECORATOR))
    rows = routes.select(
        F.col("fqn").alias("owner"), F.col("fqn").alias("handler"), F.regexp_extract("d", ROUTE_DECORATOR, 1).alias("name"),
        F.upper(F.regexp_extract("d", ROUTE_DECORATOR, 2)).alias("verb"), _string("d", ROUTE_DECORATOR, 3).alias("path"),
    ).join(prefixes, "name", "left").withColumn("url", F.concat(F.coalesce("prefix", F.lit("")), "path"))
    return endpoint_result(rows, "fastapi", prefixed=False, handler_entry=False, exposes=False, layer_of="handler")


def blueprint_prefixes(graph: Graph, files: DataFrame) -> DataFrame:
    """(name, prefix): the prefix given at registration wins over the constructor's; ``files(path, text)``."""
    built = graph.of_kind("FIELD").filter("language = 'python'").select("name", _string("value", BLUEPRINT_PREFIX).alias("prefix"), F.lit(0).alias("rank"), F.col("fqn").alias("at"))
    calls = files.filter(F.endswith("path", F.lit(".py"))).select("path", F.posexplode(F.regexp_extract_all("text", F.lit(REGISTRATION), F.lit(0))).alias("pos", "c"))
    given = calls.select(
        F.regexp_extract("c", REGISTERED, 1).alias("name"), _string("c", GIVEN_PREFIX).alias("prefix"), F.lit(1).alias("rank"),
        F.concat_ws("#", "path", F.lpad(F.col("pos").cast("string"), 9, "0")).alias("at"),
    )
    return last_by(built.unionByName(given).filter("prefix <> ''"), ["name"], ["rank", "at"], ["prefix"])


def _methods(text: Column) -> Column:
    inner = F.regexp_extract(text, FLASK_METHODS, 1)
    named = F.transform(F.regexp_extract_all(inner, F.lit("[\"']([A-Za-z]+)[\"']"), F.lit(1)), F.upper)
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("GET")))


def blueprint_routes(graph: Graph, files: DataFrame) -> RuleResult:
    """``@bp.route`` functions and ``add_url_rule`` fields, one endpoint per method."""
    prefixes = blueprint_prefixes(graph, files)
    routes = graph.of_kind("FUNCTION").filter("language = 'python'").select("fqn", F.explode("annotations").alias("d")).filter(F.col("d").rlike(FLASK_ROUTE))
    rows = routes.select(
        F.col("fqn").alias("handler"), F.regexp_extract("d", FLASK_ROUTE, 1).alias("name"), _string("d", FLASK_ROUTE, 2).alias("path"), _methods(F.col("d")).alias("verbs")
    ).join(prefixes.filter("name <> 'app'"), "name", "left").select("handler", "verbs", join_paths(F.col("prefix"), F.col("path")).alias("url"))
    rules = graph.of_kind("FIELD").filter("language = 'python'").filter(F.col("value").rlike(URL_RULE) & F.col("value").rlike(VIEW_FUNCTION)).select(
        owner_name(F.col("fqn")).alias("scope"), F.regexp_extract("value", VIEW_FUNCTION, 1).alias("ref"), _string("value", URL_RULE).alias("url"), _methods(F.col("value")).alias("verbs")
    )
    bound = rules.join(resolve_references(graph, rules), ["scope", "ref"]).select(F.col("fqn").alias("handler"), "verbs", "url")
    both = rows.unionByName(bound.select("handler", "verbs", "url")).select(F.col("handler").alias("owner"), "handler", F.explode("verbs").alias("verb"), "url")
    return endpoint_result(both, "flask", prefixed=False, handler_entry=False, exposes=False, layer_of="handler")


def resource_bindings(files: DataFrame) -> DataFrame:
    """(name, url): resource classes bound in files, under the file's API prefix."""
    api = F.regexp_extract("text", r"\bApi\([^)]*prefix\s*=\s*[\"']([^\"']+)[\"']", 1)
    pattern = r"\.add_resource\(\s*(\w+)\s*,\s*[\"']([^\"']+)[\"']"
    calls = files.filter(F.endswith("path", F.lit(".py"))).select("path", api.alias("api"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "c"))
    rows = calls.select(F.regexp_extract("c", pattern, 1).alias("name"), join_paths(F.col("api"), F.regexp_extract("c", pattern, 2)).alias("url"), "path", "pos")
    return last_by(rows, ["name"], ["path", "pos"], ["url"])


def resource_routes(graph: Graph, files: DataFrame) -> RuleResult:
    """HTTP-named methods of resource classes at their bound path; unbound classes are warned about."""
    base = r"(^|\.)(Resource|MethodView)$"
    bases = graph.edges_of("INHERITS").filter(F.col("dst").rlike(base)).select(F.col("src").alias("owner")).distinct()
    classes = graph.of_kind("CLASS").filter("language = 'python'").select(F.col("fqn").alias("owner"), "name").join(bases, "owner", "left_semi")
    methods = children_of(graph, classes, "FUNCTION", "name").filter(F.lower("name").isin(*HTTP_METHOD_NAMES)).withColumnRenamed("name", "method")
    bound = methods.join(classes, "owner").join(resource_bindings(files), "name", "left")
    rows = bound.filter("url IS NOT NULL").select("owner", F.col("fqn").alias("handler"), F.upper("method").alias("verb"), "url")
    result = endpoint_result(rows, "flask", prefixed=False, handler_entry=False, exposes=False)
    warnings = bound.filter("url IS NULL").select(F.concat(F.lit("resource without binding: "), "name").alias("message")).distinct()
    return RuleResult(result.nodes, result.edges, None, result.entry_points, warnings)


# --- viewsets and URL patterns -----------------------------------------------------------


def viewsets(graph: Graph) -> RuleResult:
    """Viewsets: generated endpoints, the model they manage and the tables behind it."""
    inherits = graph.edges_of("INHERITS").select(F.col("src").alias("owner"), "dst", "seq")
    is_base = F.lit(False)
    for base in VIEWSET_BASES:
        is_base = is_base | F.contains("dst", F.lit(base))
    kind = F.when(F.contains("dst", F.lit("ReadOnlyModelViewSet")), "ReadOnlyModelViewSet").when(F.contains("dst", F.lit("ModelViewSet")), "ModelViewSet")
    owners = inherits.filter(is_base).select("owner").distinct()
    typed = first_by(inherits.withColumn("type", kind).filter("type IS NOT NULL"), ["owner"], ["seq", "dst"], ["type"])
    sets = owners.join(typed, "owner", "left").join(graph.of_kind("CLASS").select(F.col("fqn").alias("owner"), F.col("name").alias("own_name")), "owner").select(
        "owner", "own_name", F.coalesce("type", F.lit("ModelViewSet")).alias("type")
    )
    names = last_by(graph.of_kind("CLASS").select("name", "fqn", "seq"), ["name"], ["seq", "fqn"], ["fqn"])
    held = children_of(graph, graph.of_kind("CLASS").select(F.col("fqn").alias("owner")), "FIELD", "name", "value")

    def field(name, value, out):
        return first_by(held.filter(F.col("name") == name).withColumn(out, value), ["owner"], ["fqn"], [out])

    queryset = field("queryset", F.nullif(F.regexp_extract("value", r"^(\w+)\.objects", 1), F.lit("")), "queried")
    serializer = field("serializer_class", F.col("value"), "serializer")
    meta = field("_meta_model", F.col("value"), "meta_name").join(names.select(F.col("fqn").alias("owner"), F.col("name").alias("serializer")), "owner").select("serializer", "meta_name")
    rows = sets.join(queryset, "owner", "left").join(serializer, "owner", "left").join(meta, "serializer", "left")
    rows = rows.join(names.select(F.col("name").alias("queried"), F.col("fqn").alias("by_query")), "queried", "left")
    rows = rows.join(names.select(F.col("name").alias("meta_name"), F.col("fqn").alias("by_meta")), "meta_name", "left").withColumn("model", F.coalesce("by_query", "by_meta"))
    managed = rows.filter("model IS NOT NULL").select(F.col("owner").alias("src"), F.col("model").alias("dst"), F.lit("MANAGES").alias("kind"))
    tables = graph.edges_of("MAPS_TO").select(F.col("src").alias("model"), F.col("dst").alias("table")).distinct()
    access = F.when(F.col("type") == "ReadOnlyModelViewSet", F.array(F.lit("READS"))).otherwise(F.array(F.lit("READS"), F.lit("WRITES")))
    touched = rows.join(tables, "model").select(F.col("owner").alias("src"), F.col("table").alias("dst"), F.explode(access).alias("kind"))
    actions = literal_actions()
    resource = F.concat(F.lower(F.regexp_replace(F.coalesce("queried", "own_name"), "ViewSet$", "")), F.lit("s"))
    made = rows.select("owner", resource.alias("resource"), F.explode(actions[F.col("type")]).alias("a")).select(
        "owner", F.col("owner").alias("handler"), F.col("a.verb").alias("verb"),
        F.concat(F.lit("/"), "resource", F.lit("/"), F.when(F.col("a.suffix") == "", "").otherwise(F.concat(F.regexp_replace("a.suffix", "^/", ""), F.lit("/")))).alias("url"),
    )
    result = endpoint_result(made, "django-drf", prefixed=False, handler_entry=False, exposes=False)
    links = edge_rows(managed.unionByName(touched).withColumn("evidence", F.lit("django-drf")))
    return RuleResult(result.nodes, result.edges.unionByName(links), result.layers, result.entry_points)


def literal_actions() -> Column:
    """The action table as a map from viewset type to its actions."""
    parts = []
    for name, actions in VIEWSET_ACTIONS.items():
        rows = [F.struct(F.lit(a).alias("action"), F.lit(v).alias("verb"), F.lit(s).alias("suffix")) for a, v, s in actions]
        parts += [F.lit(name), F.array(*rows)]
    return F.create_map(*parts)


def url_patterns(graph: Graph, prefixes: DataFrame) -> RuleResult:
    """Endpoints of ``path("…", view)`` entries; HANDLES points from the endpoint to the view.

    ``prefixes(module, prefix)`` are the include prefixes already joined per module.
    """
    pattern = r"(?:re_)?path\(\s*r?[\"']([^\"']*)[\"']\s*,\s*([\w.]+)"
    fields = graph.of_kind("FIELD").filter("name = 'urlpatterns'").select(owner_name(F.col("fqn")).alias("module"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("c"))
    rows = fields.select(
        "module", F.regexp_extract("c", pattern, 1).alias("path"), F.regexp_replace(F.regexp_extract("c", pattern, 2), r"\.as_view$", "").alias("view")
    ).filter("view <> 'include'").join(prefixes, "module", "left")
    rows = rows.withColumn("url", collapse_slashes(F.concat(F.coalesce("prefix", F.lit("")), "path"))).withColumn("short", F.substring_index("view", ".", -1))
    candidate = rows.withColumn("scoped", F.concat(F.regexp_replace("module", r"\.?urls$", ""), F.lit(".views."), "short"))
    known = graph.nodes.select("fqn")

    def named(kind, out):
        return first_by(graph.of_kind(kind).select(F.col("name").alias("short"), F.col("fqn").alias(out), "seq"), ["short"], ["seq", out], [out])

    resolved = (
        candidate.join(known.select(F.col("fqn").alias("scoped"), F.col("fqn").alias("v0")), "scoped", "left")
        .join(known.select(F.col("fqn").alias("view"), F.col("fqn").alias("v1")), "view", "left")
        .join(named("CLASS", "v2"), "short", "left").join(named("FUNCTION", "v3"), "short", "left")
        .select("url", F.coalesce("v0", "v1", "v2", "v3").alias("target"))
    )
    endpoint = F.concat(F.lit("ANY:"), "url")
    nodes = node_rows(resolved.select("url").distinct().select(
        endpoint.alias("fqn"), F.concat(F.lit("ANY "), "url").alias("name"), F.lit("API_ENDPOINT").alias("kind"), F.lit("ANY").alias("method"), F.create_map(F.lit("path"), "url").alias("props")
    ))
    edges = edge_rows(resolved.filter("target IS NOT NULL").select(endpoint.alias("src"), F.col("target").alias("dst"), F.lit("HANDLES").alias("kind"), F.lit("django-urls").alias("evidence")))
    return RuleResult(nodes=nodes, edges=edges)


def include_prefixes(includes: DataFrame) -> DataFrame:
    """(module, prefix) of ``includes(module, included, prefix)``, nested includes joined to a fixpoint.

    An include of a module that already lies above on its own path ends that
    path, as a ring of includes has no finite prefix.
    """
    from graphlens.functions.scale import materialize

    steps = materialize(includes.select("module", "included", "prefix").distinct(), "includes")
    roots = steps.select("module").distinct().join(steps.select(F.col("included").alias("module")), "module", "left_anti")
    layer = materialize(roots.select("module", F.lit("").alias("prefix"), F.array("module").alias("path")), "prefix")
    layers = [layer]
    while True:
        nxt = layer.withColumnRenamed("prefix", "above").join(steps, "module").filter(~F.array_contains("path", F.col("included"))).select(
            F.col("included").alias("module"), join_paths(F.col("above"), F.col("prefix")).alias("prefix"), F.array_append("path", F.col("included")).alias("path")
        )
        layer = materialize(nxt.distinct(), "prefix")
        if layer.isEmpty():
            break
        layers.append(layer)
    out = layers[0]
    for extra in layers[1:]:
        out = out.unionByName(extra)
    return out.select("module", "prefix").distinct()
