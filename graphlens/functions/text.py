"""Scalar functions as Column expressions: all JVM-side, no Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlens.schema import literal_map

# --- URLs ------------------------------------------------------------------------------


def normalize_url_path(url: Column) -> Column:
    """Host-free, query-free, lower-case path with every parameter style as ``:param``."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://[^/]+", "")
    path = F.substring_index(path, "?", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.regexp_replace(path, r"\$\{[^}]+\}|\{[^}]+\}", ":param")
    path = F.regexp_replace(path, r":[a-zA-Z_]\w*", ":param")
    path = F.lower(path)
    stripped = F.regexp_replace(path, r"/+$", "")
    return F.when(F.length(path) == 1, path).otherwise(stripped)


def collapse_slashes(path: Column) -> Column:
    path = F.regexp_replace(path, "/{2,}", "/")
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def join_paths(prefix: Column, path: Column) -> Column:
    """Prefix and path with exactly one slash between them; empty sides vanish."""
    prefix, path = F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit(""))
    tail = F.regexp_replace(path, "^/", "")
    head = F.regexp_replace(prefix, "/$", "")
    return F.when(prefix == "", path).when(path == "", prefix).otherwise(F.concat(head, F.lit("/"), tail))


def controller_route(template: Column, class_name: Column) -> Column:
    """Class route with the ``[controller]`` token replaced."""
    short = F.lower(F.regexp_replace(class_name, "Controller$", ""))
    return F.replace(F.coalesce(template, F.lit("")), F.lit("[controller]"), short)


def combine_route(class_prefix: Column, method_path: Column, method_name: Column) -> Column:
    """Full action route: tokens resolved, leading slash, ``{id:int}`` as ``:id``."""
    action = F.lower(method_name)
    prefix = F.replace(F.coalesce(class_prefix, F.lit("")), F.lit("[action]"), action)
    path = F.replace(F.coalesce(method_path, F.lit("")), F.lit("[action]"), action)
    path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    full = F.concat(prefix, path)
    full = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    return F.regexp_replace(full, r"\{(\w+)(?:[?:][^}]*)?\}", ":$1")


# --- globs -----------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """Anchored regex of a fixed shell pattern; ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        first = i + 2 if pattern[i + 1 : i + 2] == "!" else i + 1
        close = pattern.find("]", first + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[first:close])
            out += "[" + "^" * (first - i - 1) + body + "]"
            i = close
        else:
            out += "\\" + c if c in r"\.^$+(){}|[]" else c
        i += 1
    return f"(?s)^{out}$"


def path_glob_regex(pattern: str) -> str:
    """Anchored regex of a path pattern: ``*`` and ``?`` stay in a segment, a segment ``**`` stands for any number of them."""
    out = "^"
    segments = pattern.split("/")
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        inside = glob_regex(segment)[len("(?s)^") : -1]
        # In what a single segment gives, only the two wildcards are unescaped dots.
        inside = re.sub(r"(?<!\\)\.\*", "[^/]*", inside)
        inside = re.sub(r"(?<!\\)\.(?!\*)", "[^/]", inside)
        out += inside + ("" if last else "/")
    return f"(?s){out}$"


#: A bracket class of a shell pattern: a closing bracket right after the opening one, or after ``!``, is a member.
GLOB_CLASS = r"\[!?+\]?+[^\]]*+\]"


def glob_regex_column(pattern: Column) -> Column:
    """The same translation for patterns that are data: token by token."""
    tokens = F.regexp_extract_all(pattern, F.lit(rf"(?s){GLOB_CLASS}|[^*?\[]+|."), F.lit(0))

    def translated(t):
        inverted = t.startswith("[!")
        members = F.substring(t, F.when(inverted, 3).otherwise(2), F.length(t) - F.when(inverted, 3).otherwise(2))
        members = F.regexp_replace(members, r"([\\\[\]&^])", r"\\$1")
        return (
            F.when(t == "*", F.lit(".*")).when(t == "?", F.lit("."))
            .when((F.length(t) > 1) & t.startswith("["), F.concat(F.when(inverted, F.lit("[^")).otherwise(F.lit("[")), members, F.lit("]")))
            .otherwise(F.regexp_replace(t, r"([\\.^$+(){}|\[\]])", r"\\$1"))
        )

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, translated), ""), F.lit("$"))


# --- names -----------------------------------------------------------------------------


def short_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def owner_name(fqn: Column) -> Column:
    """Everything before the last dot; empty when there is none."""
    return F.regexp_extract(fqn, r"(?s)^(.*)\.[^.]*$", 1)


def camel_to_snake(name: Column) -> Column:
    out = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"([a-z\d])([A-Z])", "$1_$2"))


def snake_each_capital(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def pluralize(name: Column) -> Column:
    return (
        F.when(name.rlike("[sxz]$"), F.concat(name, F.lit("es")))
        .when(name.rlike("[^aeiou]y$"), F.regexp_replace(name, "y$", "ies"))
        .otherwise(F.concat(name, F.lit("s")))
    )


def entity_table_name(class_name: Column) -> Column:
    return pluralize(camel_to_snake(class_name))


def bare_types(type_text: Column) -> Column:
    """``A<B, C<D>>`` as the names it mentions: outer name, then each argument."""
    text = F.coalesce(type_text, F.lit(""))
    outer = F.trim(F.substring_index(text, "<", 1))
    inner = F.regexp_extract(text, r"<(.*)>", 1)
    args = F.transform(F.split(inner, ","), lambda a: F.trim(F.substring_index(F.trim(a), "<", 1)))
    return F.filter(F.concat(F.array(outer), args), lambda t: t != "")


def module_of_path(path: Column) -> Column:
    """Parent directory of a file after its language prefix is dropped."""
    # Prefixes that do not name a module; the first that fits is dropped.
    prefixes = [
        "src/main/java/", "src/main/kotlin/", "src/main/scala/", "src/main/resources/",
        "src/", "app/", "lib/", "pkg/",
    ]
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    clean = F.regexp_replace(clean, "^(?:" + "|".join(prefixes) + ")", "")
    parts = F.split(clean, "/")
    return (
        F.when(F.size(parts) > 2, F.element_at(parts, -2))
        .when(F.size(parts) > 1, F.element_at(parts, 1))
        .otherwise(F.lit("root"))
    )


def module_of_fqn(fqn: Column) -> Column:
    """First three segments of a dotted name."""
    return F.substring_index(fqn, ".", 3)


def third_segment(fqn: Column) -> Column:
    parts = F.split(fqn, r"\.")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 3)).otherwise(F.lit(""))


# --- indexer symbols -------------------------------------------------------------------

_PARAMETER_END = r"\(\)\.(\(.+\)|\[.+\])$"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(symbol: Column) -> Column:
    return F.split(F.coalesce(symbol, F.lit("")), " ", -1)


def _descriptors(parts: Column) -> Column:
    return (
        F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, F.lit(5), F.size(parts)), " "))
        .when(F.size(parts) == 4, F.get(parts, F.lit(3)))
        .otherwise(F.lit(""))
    )


def _symbol_base(parts: Column) -> Column:
    """Package part of the name; Java symbols carry the package in their descriptors."""
    full = F.size(parts) >= 5
    package = F.when(full, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    maven = (full & (F.get(parts, F.lit(1)) == "maven")) | (F.get(parts, F.lit(0)) == "semanticdb") | package.startswith("maven/")
    return F.when(maven, F.lit("")).otherwise(F.replace(F.regexp_replace(package, "^@+", ""), F.lit("/"), F.lit(".")))


def _symbol_name(parts: Column) -> Column:
    def named(text):
        member = F.translate(F.regexp_replace(text, r"(?:\(\)\.)?#*\.*$", ""), "#/", "..")
        joined = F.concat(_symbol_base(parts), F.lit("."), member)
        clean = F.regexp_replace(F.regexp_replace(joined, r"\.{2,}", "."), r"^\.+|\.+$", "")
        return F.when(text.rlike(_PARAMETER_END), F.lit("")).otherwise(clean)

    return _let(F.replace(_descriptors(parts), F.lit("`"), F.lit("")), named)


def scip_symbol_to_fqn(symbol: Column) -> Column:
    """Dotted name of an indexer symbol; empty for locals, parameters and broken input."""
    return _let(
        _parts(symbol),
        lambda parts: F.when((F.size(parts) < 4) | (F.get(parts, F.lit(0)) == "local"), F.lit("")).otherwise(_symbol_name(parts)),
    )


def scip_descriptor_kind(symbol: Column) -> Column:
    """What a symbol names: class, function, field, module, parameter, local or NULL."""
    return _let(
        _descriptors(_parts(symbol)),
        lambda text: F.when(symbol.startswith("local "), "local")
        .when(text.rlike(_PARAMETER_END), "parameter")
        .when(text.rlike(r"\(\)\.?$"), "function")
        .when(text.endswith("#"), "class")
        .when(text.endswith(":"), "module")
        .when(text.endswith("."), "field"),
    )


# --- derived query methods -------------------------------------------------------------

# Method-name grammar of derived repository queries.
READ_VERBS = ["find", "get", "query", "read", "search", "stream", "count", "exists"]
WRITE_VERBS = ["delete", "remove"]
#: Keywords that may follow a property, from the public keyword list of derived queries.
CONDITIONS = [
    "After", "Before", "Containing", "Contains", "Between", "EndingWith", "EndsWith", "Exists", "False", "GreaterThan", "GreaterThanEqual", "In", "Equals", "Empty", "NotEmpty",
    "NotNull", "Null", "LessThan", "LessThanEqual", "Like", "Near", "Not", "NotIn", "NotLike", "NotContaining", "Regex", "Matches", "StartingWith", "StartsWith", "True", "Within",
]
CASE_WORDS = ["AllIgnoringCase", "AllIgnoreCase", "IgnoringCase", "IgnoreCase"]


def derived_query_access(method: Column) -> Column:
    """``read``, ``write`` or ``unknown`` from a method name such as ``findByEmail``."""
    return (
        F.when(method.rlike(f"^(?:{'|'.join(READ_VERBS)}).*?By"), "read")
        .when(method.rlike(f"^(?:{'|'.join(WRITE_VERBS)}).*?By"), "write")
        .otherwise("unknown")
    )


def derived_query_fields(method: Column) -> Column:
    """Column names a derived query filters on."""
    verbs = "|".join(READ_VERBS + WRITE_VERBS)
    rest = F.regexp_extract(method, f"^(?:{verbs}).*?By(.*)$", 1)
    rest = F.regexp_replace(rest, r"(?<![a-z])OrderBy[A-Z].*$|(?<=[a-z0-9])OrderBy[A-Z].*$", "")
    # A part is a property and then keywords to its end, the longest first; And and Or separate only where a property has ended and one begins.
    ends = "|".join(sorted(CONDITIONS, key=len, reverse=True))
    condition = f"(?<=[a-z0-9_])(?:Is)?(?:{ends}|Is)?(?:{'|'.join(CASE_WORDS)})?$"
    words = F.transform(F.split(rest, "(?<=[a-z0-9_])(?:And|Or)(?=[A-Z])"), lambda p: F.trim(F.regexp_replace(p, condition, "")))
    return F.transform(F.filter(words, lambda w: w != ""), camel_to_snake)


# --- transactions ----------------------------------------------------------------------

# Entry-point kinds and their short types.
ENTRY_TYPES = {
    "http_endpoint": "http",
    "http": "http",
    "message_consumer": "message",
    "message": "message",
    "scheduled": "scheduled",
    "main": "main",
}


def entry_type(kind: Column) -> Column:
    return F.coalesce(literal_map(ENTRY_TYPES)[kind], kind)


def transaction_name(kind: Column, fqn: Column, metadata: Column) -> Column:
    kind = entry_type(kind)

    def known(key):
        return F.coalesce(metadata[key], F.lit("?"))

    handler = short_name(fqn)
    return (
        F.when(kind == "http", F.concat(known("method"), F.lit(" "), known("path"), F.lit(" -> "), handler))
        .when(kind == "message", F.concat(F.lit("MSG "), known("topic"), F.lit(" -> "), handler))
        .when(kind == "scheduled", F.concat(F.lit("SCHED "), known("cron"), F.lit(" -> "), handler))
        .otherwise(F.concat(F.lit("TXN -> "), fqn))
    )


# --- files, hunks, migrations ----------------------------------------------------------


def patch_hunks(patch: Column) -> Column:
    """Hunk ranges of a unified diff; a missing count means 1."""
    header = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    found = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(header), F.lit(0))

    def number(text, group):
        digits = F.regexp_extract(text, header, group)
        return F.when(digits == "", F.lit(1)).otherwise(digits.cast("int"))

    return F.transform(
        found,
        lambda h: F.struct(
            number(h, 1).alias("old_start"),
            number(h, 2).alias("old_count"),
            number(h, 3).alias("new_start"),
            number(h, 4).alias("new_count"),
        ),
    )


def flyway_version(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"^V([\d.]+)__(.+)\.sql$", 1), F.lit(""))


def flyway_description(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"^V([\d.]+)__(.+)\.sql$", 2), F.lit(""))


def code_lines(text: Column) -> Column:
    """Lines that carry code: not blank and not opening with a comment marker."""
    # Comment markers, in the order they are listed to users.
    markers = r"^\s*(?://|#|/\*|\*|\*/|--)"
    lines = F.split(text, r"\R")
    return F.filter(lines, lambda l: l.rlike(r"\S") & ~l.rlike(markers))


def count_loc(text: Column) -> Column:
    return F.coalesce(F.size(code_lines(text)), F.lit(0))


def count_loc_bytes(content: Column) -> Column:
    """LOC of raw bytes; content that is not UTF-8 counts 0."""
    text = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(content.cast("string")), count_loc(text)).otherwise(F.lit(0))


# --- literals in settings and model fields ----------------------------------------------

# Field constraints that are kept.
FIELD_CONSTRAINTS = [
    "min_length", "max_length", "ge", "gt", "le", "lt", "multiple_of", "pattern", "default", "max_digits",
    "decimal_places",
]


def quoted_strings(text: Column) -> Column:
    """Contents of the quoted tokens of a literal, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("""'[^']*'|"[^"]*\""""), F.lit(0))
    return F.transform(found, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def unquote(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), """^["' ]+|["' ]+$""", "")


def default_database(text: Column) -> Column:
    """String settings of the ``default`` connection as a map."""
    # Setting keys and the names they are reported under.
    keys = {"ENGINE": "default_engine", "NAME": "default_name", "HOST": "default_host", "PORT": "default_port"}
    block = F.regexp_extract(F.coalesce(text, F.lit("")), """(?s)['"]default['"]\\s*:\\s*\\{([^{}]*)\\}""", 1)
    pairs = [
        F.struct(
            F.lit(out).alias("key"),
            F.regexp_extract(block, f"""['"]{key}['"]\\s*:\\s*(?:'([^']*)'|"([^"]*)")""", 0).alias("value"),
        )
        for key, out in keys.items()
    ]
    present = F.filter(F.array(*pairs), lambda p: p["value"] != "")
    return F.map_from_entries(
        F.transform(present, lambda p: F.struct(p["key"], F.element_at(quoted_strings(p["value"]), 2).alias("value")))
    )


def field_constraints(raw: Column) -> Column:
    """Recognised keyword arguments of a model field as a map."""
    pattern = r"(\w+)\s*=\s*([^,()]+(?:\([^()]*\))?)"
    text = F.coalesce(raw, F.lit(""))
    inside = F.when(text.contains("Field("), F.regexp_extract(text, r"(?s)Field\((.*)\)", 1)).otherwise(text)
    entries = F.arrays_zip(
        F.regexp_extract_all(inside, F.lit(pattern), F.lit(1)).alias("key"),
        F.regexp_extract_all(inside, F.lit(pattern), F.lit(2)).alias("value"),
    )
    kept = F.filter(entries, lambda e: e["key"].isin(*FIELD_CONSTRAINTS))
    clean = F.transform(
        kept,
        lambda e: F.struct(e["key"], F.regexp_replace(F.trim(e["value"]), """^"(.*)"$|^'(.*)'$""", "$1$2")),
    )
    # The last of several entries of one key counts.
    latest = F.reverse(clean)
    keys = F.transform(latest, lambda e: e["key"])
    return F.map_from_entries(F.reverse(F.filter(latest, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))


# --- money -----------------------------------------------------------------------------


def usage_cost(input_tokens: Column, output_tokens: Column, input_price: str, output_price: str) -> Column:
    """Token cost in DECIMAL arithmetic, half-up to six places; prices per million tokens."""

    def part(tokens, price):
        amount = F.lit(price).cast("decimal(10,4)")
        return tokens.cast("decimal(18,0)") * amount

    total = (part(input_tokens, input_price) + part(output_tokens, output_price)) / F.lit(1000000).cast("decimal(7,0)")
    return F.round(total, 6).cast("decimal(18,6)")
