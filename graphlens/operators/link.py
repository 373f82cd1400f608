"""Links across technologies: HTTP calls to endpoints, topics, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by, materialize
from graphlens.functions.text import GLOB_CLASS, glob_regex_column, normalize_url_path, third_segment
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.schema import HIGH, MEDIUM

PARAM = ":param"


# --- HTTP --------------------------------------------------------------------------------


def endpoint_index(graph: Graph) -> DataFrame:
    """(method, path, endpoint, ord): one endpoint per method and normalised path.

    The last endpoint of a key wins, but the key keeps the place of its first one.
    """
    url = F.coalesce(F.col("props")["path"], F.col("path"))
    rows = graph.of_kind("API_ENDPOINT").select(
        F.upper(F.coalesce("method", F.lit(""))).alias("method"), normalize_url_path(url).alias("path"), "fqn", "seq"
    )
    return rows.groupBy("method", "path").agg(
        F.max_by("fqn", F.struct("seq", "fqn")).alias("endpoint"), F.min(F.struct("seq", "fqn")).alias("ord")
    )


def http_calls(graph: Graph) -> DataFrame:
    """(caller, url, method, path) for every HTTP call a function makes."""
    calls = graph.of_kind("FUNCTION").select(F.col("fqn").alias("caller"), F.explode("http_calls").alias("call"))
    return calls.select(
        "caller", F.col("call.url").alias("url"), F.upper(F.coalesce("call.method", F.lit(""))).alias("method"),
        normalize_url_path(F.col("call.url")).alias("path"),
    )


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/", -1)


def _mask(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.when(s == PARAM, "1").otherwise("0")), "")


def _masked(segments: Column, mask: Column) -> Column:
    return F.array_join(
        F.transform(segments, lambda s, i: F.when(F.substring(mask, i + 1, F.lit(1)) == "1", PARAM).otherwise(s)), "/"
    )


def parameter_matches(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(method, path, endpoint): first endpoint that equals a path up to parameters on either side.

    Paths are grouped by shape: which segments are parameters. For a call shape
    and an endpoint shape the masked paths must be equal, so each shape pair is an
    equi-join on the masked text. Endpoints are reduced to the first one per
    masked text before the join, so a call meets one row per shape pair.
    """
    def shaped(df):
        return df.withColumn("segments", _segments(F.col("path"))).withColumn("n", F.size("segments")).withColumn("mask", _mask(F.col("segments")))

    calls, ends = shaped(wanted), shaped(index)
    shapes = (
        calls.select("method", "n", F.col("mask").alias("call_mask")).distinct()
        .join(ends.select("method", "n", F.col("mask").alias("end_mask")).distinct(), ["method", "n"])
    )
    either = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.col("n")),
            lambda i: F.when((F.substring(F.col("call_mask"), i, F.lit(1)) == "1") | (F.substring(F.col("end_mask"), i, F.lit(1)) == "1"), "1").otherwise("0"),
        ), "",
    )
    shapes = shapes.withColumn("either", either)
    keys = ["method", "n", "call_mask", "end_mask", "masked"]
    left = calls.withColumnRenamed("mask", "call_mask").join(shapes, ["method", "n", "call_mask"]).withColumn("masked", _masked(F.col("segments"), F.col("either")))
    right = (
        ends.withColumnRenamed("mask", "end_mask").join(shapes, ["method", "n", "end_mask"])
        .withColumn("masked", _masked(F.col("segments"), F.col("either")))
    )
    right = first_by(right, keys, ["ord"], ["endpoint", "ord"])
    return first_by(left.join(right, keys), ["method", "path"], ["ord"], ["endpoint"])


def http_links(graph: Graph) -> DataFrame:
    """CALLS_API edges: exact matches HIGH, matches up to parameters MEDIUM."""
    index = endpoint_index(graph)
    calls = http_calls(graph)
    wanted = calls.select("method", "path").distinct()
    exact = wanted.join(index, ["method", "path"]).select("method", "path", "endpoint", F.lit(HIGH).alias("confidence"))
    misses = wanted.join(index, ["method", "path"], "left_anti")
    loose = parameter_matches(misses, index).withColumn("confidence", F.lit(MEDIUM))
    targets = exact.unionByName(loose)
    return edge_rows(
        calls.join(targets, ["method", "path"]).select(
            F.col("caller").alias("src"), F.col("endpoint").alias("dst"), F.lit("CALLS_API").alias("kind"), "confidence",
            F.lit("cross-tech-linker").alias("evidence"),
            F.create_map(F.lit("url_pattern"), F.col("url"), F.lit("method"), F.col("method")).alias("props"),
        )
    )


# --- topics ------------------------------------------------------------------------------

_ANCHOR = 8
_GRAMS = (3, 6, 12)
_SALTS = 32


def glob_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, pattern) for ``names(name)`` that fit the shell ``patterns(pattern)``.

    A pattern is looked up by one literal piece of it: its head, its tail or a
    piece of any literal run, as long as ``_GRAMS`` has for the run, whichever the
    fewest names share. Runs of digits need the longer pieces: in a large table
    many names share any three characters. A
    pattern with a piece that no name has is dropped at once. Patterns without any
    literal meet every name, spread over salts. No side is broadcast and nothing
    is cross-joined.
    """
    def grams(text, size):
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit("g:"), F.substring(text, i, F.lit(size))))

    def longest_grams(run):
        out = grams(run, _GRAMS[0])
        for size in _GRAMS[1:]:
            out = F.when(F.length(run) >= size, grams(run, size)).otherwise(out)
        return out

    head = F.substring(F.regexp_extract("pattern", r"^[^*?\[\]]+", 0), 1, _ANCHOR)
    tail = F.regexp_extract(F.regexp_replace("pattern", GLOB_CLASS, "*"), rf"[^*?\[\]]{{1,{_ANCHOR}}}$", 0)
    runs = F.split("pattern", rf"{GLOB_CLASS}|[*?\[\]]", -1)
    pieces = F.concat(
        F.when(head != "", F.array(F.concat(F.lit("h:"), head))).otherwise(F.array().cast("array<string>")),
        F.when(tail != "", F.array(F.concat(F.lit("t:"), tail))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform(runs, longest_grams)),
    )
    wanted = materialize(patterns.select("pattern").distinct().withColumn("pieces", F.array_distinct(pieces)), "patterns")
    pieces = wanted.select("pattern", F.explode("pieces").alias("key"))
    # One number per entry of _GRAMS at most: the lengths that some pattern asks for.
    used = pieces.filter(F.startswith("key", F.lit("g:"))).select((F.length("key") - 2).alias("size")).distinct().collect()
    longest = F.least(F.length("name"), F.lit(_ANCHOR))
    sizes = F.coalesce(F.when(longest > 0, F.sequence(F.lit(1), longest)), F.array().cast("array<int>"))
    anchors = F.concat(
        F.transform(sizes, lambda n: F.concat(F.lit("h:"), F.substring(F.col("name"), F.lit(1), n))),
        F.transform(sizes, lambda n: F.concat(F.lit("t:"), F.right(F.col("name"), n))),
        *[F.array_distinct(grams(F.col("name"), r["size"])) for r in used],
    )
    names = names.select("name").distinct()
    # Only keys that some pattern asks for leave the names' side.
    offered = materialize(
        names.select("name", F.explode(anchors).alias("key")).join(pieces.select("key").distinct(), "key", "left_semi"), "offered"
    )
    counts = offered.groupBy("key").agg(F.count("*").alias("n"))
    rarest = pieces.join(counts, "key", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    anchored = rarest.filter("k.n > 0").select("pattern", "k.key").join(offered, "key").select("name", "pattern")
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    bare = wanted.filter(F.size("pieces") == 0).select("pattern", salts.alias("salt"))
    spread = names.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(_SALTS)).cast("int")).join(bare, "salt").select("name", "pattern")
    return anchored.unionByName(spread).filter(F.rlike("name", glob_regex_column(F.col("pattern")))).distinct()


def topic_links(graph: Graph) -> Graph:
    """MESSAGE_TOPIC nodes with PRODUCES and CONSUMES edges.

    A topic takes the broker of its first producer, else of its first exact
    consumer. Wildcard consumers bind to every concrete topic at MEDIUM.
    """
    functions = graph.of_kind("FUNCTION")

    def side(column, rank):
        rows = functions.select("fqn", "seq", F.posexplode(column).alias("pos", "t"))
        return rows.select(
            "fqn", F.col("t.topic").alias("topic"), F.coalesce("t.broker", F.lit("unknown")).alias("broker"),
            F.struct(F.lit(rank).alias("rank"), "seq", "fqn", "pos").alias("ord"),
        )

    producers, consumers = side("mq_produces", 0), side("mq_consumes", 1)
    wild = F.col("topic").rlike(r"[*?]")
    exact, patterns = consumers.filter(~wild), consumers.filter(wild)
    topics = first_by(producers.unionByName(exact), ["topic"], ["ord"], ["broker"])
    fqn = F.concat(F.lit("topic:"), "topic")
    known = graph.nodes.select("fqn")
    nodes = topics.select(
        fqn.alias("fqn"), F.col("topic").alias("name"), F.lit("MESSAGE_TOPIC").alias("kind"),
        F.create_map(F.lit("broker_type"), "broker").alias("props"),
    ).join(known, "fqn", "left_anti")
    matched = glob_matches(topics.select(F.col("topic").alias("name")), patterns.select(F.col("topic").alias("pattern")))
    loose = patterns.withColumnRenamed("topic", "pattern").join(matched, "pattern").select(
        F.col("fqn").alias("src"), F.concat(F.lit("topic:"), "name").alias("dst"), F.lit("CONSUMES").alias("kind"),
        F.lit(MEDIUM).alias("confidence"), F.lit("cross-tech-linker-wildcard").alias("evidence"),
        F.create_map(F.lit("pattern"), "pattern").alias("props"),
    )

    def links(rows, kind):
        return edge_rows(
            rows.select(F.col("fqn").alias("src"), fqn.alias("dst"), F.lit(kind).alias("kind"), F.lit("cross-tech-linker").alias("evidence"))
        )

    return Graph(node_rows(nodes), links(producers, "PRODUCES").unionByName(links(exact, "CONSUMES")).unionByName(edge_rows(loose)))


def canonical_topic(fqn: Column) -> Column:
    """One spelling for the three topic name styles: ``topic:x``, ``topic:broker:x``, ``queue::x``."""
    return F.regexp_extract(fqn, r"^(?:topic:(?:kafka:|rabbitmq:|jms:)?|queue::)?(.*)$", 1)


# --- shared tables -----------------------------------------------------------------------


def shared_table_members(graph: Graph) -> DataFrame:
    """(table_fqn, table_name, module, module_ord, entity): tables mapped from two modules or more.

    This is the coupling in linear size: any two members of one table from
    different modules depend on each other. :func:`shared_table_edges` spells out
    the pairs of chosen entities.
    """
    entities = graph.nodes.select(
        F.col("fqn").alias("entity"), F.coalesce(F.nullif("module", F.lit("")), third_segment(F.col("fqn"))).alias("module")
    )
    mapped = graph.edges_of("MAPS_TO").select(F.col("dst").alias("table_fqn"), F.col("src").alias("entity"), "seq").join(entities, "entity")
    places = mapped.groupBy("table_fqn", "module").agg(F.min(F.struct("seq", "entity")).alias("module_ord"))
    coupled = places.filter("module <> ''").groupBy("table_fqn").agg(F.count("*").alias("modules")).filter("modules >= 2")
    names = graph.nodes.select(F.col("fqn").alias("table_fqn"), F.col("name").alias("table_name"))
    return (
        mapped.join(coupled, "table_fqn", "left_semi").join(places, ["table_fqn", "module"]).join(names, "table_fqn", "left")
        .select("table_fqn", F.coalesce("table_name", "table_fqn").alias("table_name"), "module", "module_ord", "entity").distinct()
    )


def shared_table_warnings(members: DataFrame) -> DataFrame:
    """(table_name, module): the modules to report for each shared table."""
    return members.filter("module <> ''").select("table_name", "module").distinct()


def shared_table_edges(members: DataFrame, entities: DataFrame) -> DataFrame:
    """DEPENDS_ON edges between the chosen ``entities(fqn)`` and their co-members, earlier module first."""
    chosen = members.join(entities.select(F.col("fqn").alias("entity")).distinct(), "entity", "left_semi").select(
        "table_fqn", F.col("entity").alias("a"), F.col("module").alias("ma"), F.col("module_ord").alias("oa")
    )
    pairs = chosen.join(members, "table_fqn").filter("ma <> module")
    first = F.col("oa") < F.col("module_ord")
    return edge_rows(
        pairs.select(
            F.when(first, F.col("a")).otherwise(F.col("entity")).alias("src"),
            F.when(first, F.col("entity")).otherwise(F.col("a")).alias("dst"),
            F.lit("DEPENDS_ON").alias("kind"), F.lit(MEDIUM).alias("confidence"), F.lit("shared-db-coupling").alias("evidence"), "table_name",
        ).distinct().withColumn("props", F.create_map(F.lit("shared_table"), "table_name", F.lit("coupling_type"), F.lit("shared_database")))
    )


def link(graph: Graph) -> Graph:
    """Graph with HTTP and topic links added."""
    topics = topic_links(graph)
    return graph.plus(nodes=topics.nodes, edges=http_links(graph).unionByName(topics.edges))
