"""Request middleware: components, chains, classes behind them, ordering checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, with_next
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.rules import RuleResult
from graphlens.operators.rules.injection import children_of
from graphlens.schema import literal_map

# Middleware name -> technology.
TECHNOLOGY = {
    "UseAuthentication": "Authentication",
    "UseAuthorization": "Authorization",
    "UseCors": "CORS",
    "UseRateLimiter": "Rate Limiting",
    "UseResponseCaching": "Response Caching",
    "UseHttpsRedirection": "HTTPS Redirection",
    "UseStaticFiles": "Static Files",
    "UseHsts": "HSTS",
}
TERMINAL = r"^(MapControllers|MapRazorPages|(MapHub|MapGrpcService)<\w+>)$"


def _fqn():
    return F.concat("cls", F.lit("::middleware::"), "name")


def chain(calls: DataFrame) -> DataFrame:
    """MIDDLEWARE_CHAIN edges between consecutive ``calls(cls, pos, name)`` of a class."""
    linked = with_next(calls, ["cls"], "pos", {"name": "next"}).filter("next IS NOT NULL")
    return edge_rows(linked.select(
        _fqn().alias("src"), F.concat("cls", F.lit("::middleware::"), "next").alias("dst"), F.lit("MIDDLEWARE_CHAIN").alias("kind"),
        F.lit("aspnet-middleware").alias("evidence"), F.create_map(F.lit("order"), F.col("pos").cast("string")).alias("props"),
    ))


def ordering_violations(calls: DataFrame) -> DataFrame:
    """(cls, issue): authorization before authentication, CORS after it; the last position of a name counts."""
    def place(name):
        return F.max(F.when(F.col("name") == name, F.col("pos")))

    places = calls.groupBy("cls").agg(place("UseAuthentication").alias("a"), place("UseAuthorization").alias("z"), place("UseCors").alias("c"))
    found = F.filter(
        F.array(F.when(F.col("z") < F.col("a"), "authorization before authentication"), F.when(F.col("c") > F.col("a"), "cors after authentication")), lambda x: x.isNotNull()
    )
    return places.select("cls", F.explode(found).alias("issue"))


def middleware(graph: Graph, calls: DataFrame) -> RuleResult:
    """Components per call, chain edges, handlers behind ``UseMiddleware<T>`` and known technologies."""
    components = calls.select(
        _fqn().alias("fqn"), "name", F.lit("COMPONENT").alias("kind"), F.lit("csharp").alias("language"),
        F.create_map(F.lit("order"), F.col("pos").cast("string"), F.lit("terminal"), F.col("name").rlike(TERMINAL).cast("string")).alias("props"),
    )
    known = literal_map(TECHNOLOGY)[F.col("name")]
    tech = calls.select(known.alias("name")).filter("name IS NOT NULL").distinct().select(
        F.concat(F.lit("technology:aspnet:"), F.lower(F.regexp_replace("name", " ", "-"))).alias("fqn"), "name", F.lit("COMPONENT").alias("kind"), F.lit("csharp").alias("language")
    )
    used = calls.select("cls", "name", F.regexp_extract("name", r"^UseMiddleware<(\w+)>$", 1).alias("type_name")).filter("type_name <> ''")
    classes = first_by(graph.of_kind("CLASS").select(F.col("name").alias("type_name"), "fqn", "seq"), ["type_name"], ["seq", "fqn"], ["fqn"])
    invoking = children_of(graph, classes.select(F.col("fqn").alias("owner")), "FUNCTION", "name").filter(F.col("name").isin("Invoke", "InvokeAsync")).select(F.col("owner").alias("fqn")).distinct()
    bound = used.join(classes, "type_name").join(invoking, "fqn", "left_semi")
    handled = edge_rows(bound.select(F.col("fqn").alias("src"), _fqn().alias("dst"), F.lit("HANDLES").alias("kind"), F.lit("aspnet-middleware").alias("evidence")))
    layers = bound.select("fqn").distinct().withColumn("layer", F.lit("Cross-Cutting"))
    warnings = ordering_violations(calls).select(F.concat_ws(": ", "cls", "issue").alias("message"))
    return RuleResult(node_rows(components).unionByName(node_rows(tech)), chain(calls).unionByName(handled), layers, None, warnings)
