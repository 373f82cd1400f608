"""Schema history from migration text, revision chains and embedded SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import last_by, materialize
from graphlens.functions.text import flyway_version
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.rules import RuleResult

#: A table or column, quoted or not, behind any number of qualifiers; its last part is the name.
QUALIFIED = r"""(?:["`]?\w+["`]?\.)*["`]?\w+["`]?"""
NAME = r"""(?:["`]?\w+["`]?\.)*["`]?(\w+)["`]?"""
CREATE = rf"(?is)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)[^)]*$"
ALTER = rf"(?is)^\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{NAME}\s+(.*)$"
ADD_COLUMN = rf"(?is)(?:^|,)\s*ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?!(?:CONSTRAINT|FOREIGN|PRIMARY|UNIQUE|CHECK|INDEX|KEY)\b){NAME}\s+(\w+(?:\s*\([^)]*\))?)"
FOREIGN = rf"(?is)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}\s*\(([^)]*)\)"
INDEX = rf"(?is)^\s*CREATE\s+(UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+{NAME}\s*\(([^)]*)\)"
COLUMN = r"""(?is)^\s*["`]?(\w+)["`]?\s+(\w+(?:\s*\([^)]*\))?)"""
TABLE_RULES = r"(?i)^\s*(PRIMARY|FOREIGN|CONSTRAINT|UNIQUE|CHECK|KEY|INDEX)\b"


def _clean(text: Column) -> Column:
    """Statements without comments, and with every string literal emptied: nothing here depends on their content."""
    kept = F.regexp_replace(text, r"(?s)('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", "$1")
    return F.regexp_replace(kept, r"'(?:[^']|'')*'", "''")


def _names(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda n: F.regexp_replace(F.trim(n), '["`]', ""))


def statements(files: DataFrame) -> DataFrame:
    """(ord, statement) of migration files ``(name, text)`` in version order; other files are left out."""
    versioned = files.withColumn("version", flyway_version(F.col("name"))).filter("version IS NOT NULL")
    numbers = F.transform(F.split("version", r"\."), lambda n: n.cast("decimal(38,0)"))
    parts = versioned.select(numbers.alias("version"), "name", F.posexplode(F.split(_clean(F.col("text")), ";")).alias("pos", "statement"))
    return parts.filter(F.trim("statement") != "").select(F.struct("version", "name", "pos").alias("ord"), "statement")


def fold_schema(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, references, indexes) after all statements.

    A CREATE replaces the table, a later ADD COLUMN replaces that column: so the
    final columns are the last definitions at or after a table's last CREATE.
    """
    rows = materialize(rows, "statements")
    created = rows.filter(F.col("statement").rlike(CREATE)).select(
        "ord", F.regexp_extract("statement", CREATE, 1).alias("table"), F.regexp_extract("statement", CREATE, 2).alias("body")
    )
    parts = created.select("ord", "table", F.posexplode(F.split("body", r",(?![^()]*\))")).alias("place", "part"))
    defined = parts.filter(~F.col("part").rlike(TABLE_RULES) & F.col("part").rlike(COLUMN)).select(
        "ord", "table", F.regexp_extract("part", COLUMN, 1).alias("column"), F.upper(F.regexp_extract("part", COLUMN, 2)).alias("type"),
        F.col("part").rlike(r"(?i)\bPRIMARY\s+KEY\b").alias("is_primary_key"),
    )
    actions = rows.filter(F.col("statement").rlike(ALTER)).select(
        "ord", F.regexp_extract("statement", ALTER, 1).alias("table"), F.explode(F.regexp_extract_all(F.regexp_extract("statement", ALTER, 2), F.lit(ADD_COLUMN), F.lit(0))).alias("action")
    )
    added = actions.select(
        "ord", "table", F.regexp_extract("action", ADD_COLUMN, 1).alias("column"), F.upper(F.regexp_extract("action", ADD_COLUMN, 2)).alias("type"), F.lit(False).alias("is_primary_key")
    )
    last_create = created.groupBy("table").agg(F.max("ord").alias("born"))
    live = defined.unionByName(added).join(last_create, "table", "left").filter("born IS NULL OR ord >= born")
    columns = last_by(live, ["table", "column"], ["ord"], ["type", "is_primary_key"])
    # Alter statements name their table up front; inside a CREATE the table is known.
    altered = rows.filter(~F.col("statement").rlike(CREATE)).select(
        F.regexp_extract("statement", rf"(?is)^\s*ALTER\s+TABLE\s+(?:ONLY\s+)?{NAME}", 1).alias("table"), F.explode(F.regexp_extract_all("statement", F.lit(FOREIGN), F.lit(0))).alias("fk")
    )
    inside = created.select("table", F.explode(F.regexp_extract_all("body", F.lit(FOREIGN), F.lit(0))).alias("fk"))
    pairs = inside.unionByName(altered).select(
        F.col("table").alias("source_table"), F.regexp_extract("fk", FOREIGN, 2).alias("target_table"),
        F.explode(F.arrays_zip(_names(F.regexp_extract("fk", FOREIGN, 1)).alias("source_column"), _names(F.regexp_extract("fk", FOREIGN, 3)).alias("target_column"))).alias("c"),
    ).select("source_table", "c.source_column", "target_table", "c.target_column")
    inline = rf"(?is)\bREFERENCES\s+{NAME}\s*\(\s*(\w+)\s*\)"
    direct = parts.filter(~F.col("part").rlike(TABLE_RULES) & F.col("part").rlike(inline)).select(
        F.col("table").alias("source_table"), F.regexp_extract("part", COLUMN, 1).alias("source_column"),
        F.regexp_extract("part", inline, 1).alias("target_table"), F.regexp_extract("part", inline, 2).alias("target_column"),
    )
    references = pairs.unionByName(direct).filter("source_column IS NOT NULL AND target_column IS NOT NULL")
    indexes = rows.filter(F.col("statement").rlike(INDEX)).select(
        F.regexp_extract("statement", INDEX, 2).alias("index"), F.regexp_extract("statement", INDEX, 3).alias("table"),
        F.explode(_names(F.regexp_extract("statement", INDEX, 4))).alias("column"), (F.regexp_extract("statement", INDEX, 1) != "").alias("is_unique"),
    )
    return columns, references, indexes


def schema_graph(columns: DataFrame, references: DataFrame) -> Graph:
    """TABLE and COLUMN nodes with HAS_COLUMN and REFERENCES edges."""
    table = F.concat(F.lit("table:"), "table")
    cell = F.concat_ws(".", table, "column")
    keys = references.select(F.col("source_table").alias("table"), F.col("source_column").alias("column"), F.lit(True).alias("fk")).distinct()
    tables = columns.groupBy("table").agg(F.count("*").alias("n")).select(
        table.alias("fqn"), F.col("table").alias("name"), F.lit("TABLE").alias("kind"), F.create_map(F.lit("column_count"), F.col("n").cast("string")).alias("props")
    )
    cells = columns.join(keys, ["table", "column"], "left").select(
        cell.alias("fqn"), F.col("column").alias("name"), F.lit("COLUMN").alias("kind"), "type",
        F.create_map(F.lit("is_primary_key"), F.col("is_primary_key").cast("string"), F.lit("is_foreign_key"), F.coalesce("fk", F.lit(False)).cast("string")).alias("props"),
    )
    held = columns.select(table.alias("src"), cell.alias("dst"), F.lit("HAS_COLUMN").alias("kind"))
    linked = references.select(
        F.concat(F.lit("table:"), "source_table", F.lit("."), "source_column").alias("src"), F.concat(F.lit("table:"), "target_table", F.lit("."), "target_column").alias("dst"), F.lit("REFERENCES").alias("kind")
    )
    return Graph(node_rows(tables).unionByName(node_rows(cells)), edge_rows(held.unionByName(linked).withColumn("evidence", F.lit("migration"))))


def revision_chain(revisions: DataFrame) -> RuleResult:
    """INHERITS from a revision to its known parent; ``revisions(revision, down_revision)``."""
    known = revisions.select(F.col("revision").alias("down_revision")).distinct()
    stated = revisions.filter("down_revision IS NOT NULL")
    node = F.concat(F.lit("alembic:"), "revision")
    edges = stated.join(known, "down_revision", "left_semi").select(node.alias("src"), F.concat(F.lit("alembic:"), "down_revision").alias("dst"), F.lit("INHERITS").alias("kind"), F.lit("alembic-revision-chain").alias("evidence"))
    warnings = stated.join(known, "down_revision", "left_anti").select(F.concat_ws(" ", F.lit("unknown parent"), "down_revision", F.lit("of"), "revision").alias("message"))
    nodes = revisions.select(node.alias("fqn"), F.col("revision").alias("name"), F.lit("CONFIG_FILE").alias("kind"), F.lit("python").alias("language"))
    return RuleResult(nodes=node_rows(nodes), edges=edge_rows(edges), warnings=warnings)


#: A name with its qualifiers, quoted or not, or one other character.
_PART = r"""(?:"(?:[^"]|"")*"|`[^`]*`|[\w$]+)"""
_TOKEN = rf"{_PART}(?:\s*\.\s*{_PART})*|[^\s]"
#: Words that end a list of tables, and words that may stand before a table.
_ENDS = "WHERE GROUP ORDER HAVING LIMIT OFFSET FETCH SET VALUES UNION EXCEPT INTERSECT RETURNING WINDOW QUALIFY FOR".split()
_BEFORE = "ONLY LATERAL TABLE IGNORE OVERWRITE".split()
_START = """named_struct('stack', array('query'), 'found', CAST(array() AS array<struct<name:string,role:string>>), 'local', CAST(array() AS array<string>),
  'verb', CAST(NULL AS string), 'role', 'from', 'before', '', 'fresh', false)"""


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: What a token ``k`` (``u`` in capitals) means in state ``s``, whose innermost scope is ``element_at(s.stack, -1)``:
#: ``query`` (no table list), ``wanted`` (a table comes next), ``listed`` (behind a table), ``call`` (arguments), ``with`` (a local name comes
#: next), ``named`` (behind a local name or its body), ``body`` (the body comes next).
_EVENT = f"""CASE
  WHEN k = '(' THEN CASE WHEN top = 'wanted' THEN 'open_table' WHEN top = 'body' THEN 'open_body' WHEN s.fresh AND s.role = 'from' THEN 'open_function' ELSE 'open' END
  WHEN k = ')' THEN 'close'
  WHEN k = ',' THEN CASE WHEN top = 'listed' THEN 'next' WHEN top = 'named' THEN 'with' ELSE 'other' END
  WHEN top = 'with' THEN CASE WHEN u = 'RECURSIVE' THEN 'other' ELSE 'local' END
  WHEN top = 'named' AND u = 'AS' THEN 'body'
  WHEN u = 'WITH' AND (s.before IN ('', '(') OR top = 'listed' AND s.role = 'into') THEN 'with'
  WHEN u IN ('SELECT', 'INSERT') THEN 'verb'
  WHEN u = 'DELETE' AND top <> 'call' THEN 'delete'
  WHEN u = 'UPDATE' AND top <> 'call' THEN CASE WHEN s.before IN ('FOR', 'KEY', 'DO') THEN 'end' ELSE 'update' END
  WHEN u = 'INTO' AND top <> 'call' THEN 'into'
  WHEN u = 'FROM' AND top IN ('query', 'listed') AND s.before <> 'DISTINCT' THEN 'from'
  WHEN u IN ('JOIN', 'STRAIGHT_JOIN') AND top = 'listed' OR u = 'USING' AND top = 'listed' AND s.verb = 'DELETE' THEN 'next'
  WHEN top IN ('wanted', 'listed') AND u IN ({_listed(_ENDS)}) THEN 'end'
  WHEN top = 'wanted' AND u NOT IN ({_listed(_BEFORE)}) AND k RLIKE '^["`\\\\w$]' THEN 'table'
  ELSE 'other' END"""
_NEXT = """named_struct(
  'stack', CASE WHEN e IN ('open', 'open_function') THEN concat(s.stack, array('call')) WHEN e = 'open_table' THEN concat(below, array('listed', 'wanted'))
      WHEN e = 'open_body' THEN concat(below, array('named', 'query')) WHEN e = 'close' THEN if(size(s.stack) > 1, below, s.stack)
      WHEN e IN ('next', 'from', 'into', 'update') THEN concat(below, array('wanted')) WHEN e IN ('with', 'body') THEN concat(below, array(e)) WHEN e = 'local' THEN concat(below, array('named'))
      WHEN e = 'table' THEN concat(below, array('listed')) WHEN e IN ('verb', 'delete', 'end') THEN concat(below, array('query')) ELSE s.stack END,
  'found', CASE WHEN e = 'table' THEN concat(s.found, array(named_struct('name', k, 'role', s.role))) WHEN e = 'open_function' THEN slice(s.found, 1, size(s.found) - 1) ELSE s.found END,
  'local', if(e = 'local', concat(s.local, array(lower(k))), s.local),
  'verb', if(s.verb IS NULL AND size(s.stack) = 1 AND e IN ('verb', 'delete', 'update'), u, s.verb),
  'role', CASE WHEN e IN ('into', 'update') THEN 'into' WHEN e = 'delete' THEN 'delete' WHEN e = 'from' THEN if(s.role = 'delete', 'into', 'from') WHEN e = 'next' AND s.role <> 'into' OR e = 'next' AND u <> ',' THEN 'from' ELSE s.role END,
  'before', u, 'fresh', e = 'table')"""


def _read_tokens(tokens: str) -> str:
    """The state after all tokens, folded from the left with a stack of scopes."""
    given = "named_struct('s', s, 'k', k, 'u', upper(k), 'top', element_at(s.stack, -1), 'below', slice(s.stack, 1, size(s.stack) - 1))"
    bound = lambda text, row: re.sub(r"\b(s|k|u|top|below|e)\b(?!')", rf"{row}.\1", text)
    step = f"transform(transform(array({given}), g -> named_struct('s', g.s, 'k', g.k, 'u', g.u, 'below', g.below, 'e', {bound(_EVENT, 'g')})), h -> {bound(_NEXT, 'h')})[0]"
    return f"aggregate({tokens}, {_START}, (s, k) -> {step})"


def sql_lineage(texts: DataFrame) -> DataFrame:
    """(fqn, table, access, query_type) of SQL strings ``(fqn, text)``.

    SELECT reads every table; INSERT writes its target and reads the rest, the
    target too where it is also read; UPDATE and DELETE write their target.
    Names defined by WITH, functions in table lists and FROM among the arguments
    of a function are not tables. Quoted names may hold anything.
    """
    tokens = texts.select("fqn", F.regexp_extract_all(_clean(F.col("text")), F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    read = tokens.select("fqn", F.expr(_read_tokens("tokens")).alias("s")).filter("s.verb IS NOT NULL")
    plain = lambda n: F.regexp_replace(F.regexp_extract(n, rf"({_PART})$", 1), '^["`]|["`]$', "")
    known = F.filter("s.found", lambda f: ~F.array_contains("s.local", F.lower(f["name"])))
    of = lambda role: F.array_distinct(F.transform(F.filter(known, lambda f: f["role"] == role), lambda f: plain(f["name"])))
    rows = read.select("fqn", F.col("s.verb").alias("query_type"), of("from").alias("sources"), of("into").alias("targets"))
    reads = F.when(F.col("query_type").isin("SELECT", "INSERT"), F.col("sources")).otherwise(F.array().cast("array<string>"))
    writes = F.when(F.col("query_type") == "SELECT", F.array().cast("array<string>")).otherwise(F.slice("targets", 1, 1))
    access = F.concat(
        F.transform(reads, lambda t: F.struct(t.alias("table"), F.lit("READS").alias("access"))), F.transform(writes, lambda t: F.struct(t.alias("table"), F.lit("WRITES").alias("access")))
    )
    return rows.select("fqn", "query_type", F.explode(access).alias("a")).select("fqn", "a.table", "a.access", "query_type")


def embedded_sql(graph: Graph) -> Graph:
    """TABLE nodes and READS/WRITES edges from SQL strings in functions, whichever way they were tagged."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce("tagged_strings", empty), F.coalesce(F.split(F.col("props")["sql_strings"], "\u0000"), empty))
    texts = graph.of_kind("FUNCTION").select("fqn", F.explode(both).alias("text"))
    lineage = sql_lineage(texts)
    table = F.concat(F.lit("table:"), "table")
    nodes = lineage.select("table").distinct().select(table.alias("fqn"), F.col("table").alias("name"), F.lit("TABLE").alias("kind"))
    edges = lineage.select(F.col("fqn").alias("src"), table.alias("dst"), F.col("access").alias("kind"), F.create_map(F.lit("query_type"), "query_type").alias("props"))
    return Graph(node_rows(nodes), edge_rows(edges))
