"""Kinds, labels and table layouts of the architecture graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Node kinds and the label each one carries in query answers.
NODE_LABELS = {
    "APPLICATION": "Application",
    "MODULE": "Module",
    "CLASS": "Class",
    "INTERFACE": "Interface",
    "FUNCTION": "Function",
    "FIELD": "Field",
    "TABLE": "Table",
    "COLUMN": "Column",
    "VIEW": "View",
    "STORED_PROCEDURE": "StoredProcedure",
    "API_ENDPOINT": "APIEndpoint",
    "ROUTE": "Route",
    "MESSAGE_TOPIC": "MessageTopic",
    "CONFIG_FILE": "ConfigFile",
    "CONFIG_ENTRY": "ConfigEntry",
    "LAYER": "Layer",
    "COMPONENT": "Component",
    "COMMUNITY": "Community",
    "TRANSACTION": "Transaction",
}

# Edge kinds.
EDGE_KINDS = [
    "CALLS", "INHERITS", "IMPLEMENTS", "DEPENDS_ON", "IMPORTS", "CONTAINS", "INJECTS", "READS", "WRITES",
    "MAPS_TO", "HAS_COLUMN", "REFERENCES", "EXPOSES", "HANDLES", "CALLS_API", "RENDERS", "PRODUCES", "CONSUMES",
    "STARTS_AT", "ENDS_AT", "INCLUDES", "PASSES_PROP", "MANAGES", "MIDDLEWARE_CHAIN", "ACCEPTS", "RETURNS",
]

# Ordered confidence levels.
LOW, MEDIUM, HIGH = 1, 2, 3
CONFIDENCE_NAMES = {LOW: "LOW", MEDIUM: "MEDIUM", HIGH: "HIGH"}

_TEXTS = T.ArrayType(T.StringType())
_MAP = T.MapType(T.StringType(), T.StringType())


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _topic_list() -> T.ArrayType:
    return T.ArrayType(_record(topic=T.StringType(), broker=T.StringType()))


PARAM_TYPE = _record(name=T.StringType(), type=T.StringType(), annotations=_TEXTS, qualifier=T.StringType())

NODE_SCHEMA = _record(
    app_name=T.StringType(), fqn=T.StringType(), name=T.StringType(), kind=T.StringType(), language=T.StringType(),
    path=T.StringType(), line=T.IntegerType(), end_line=T.IntegerType(), loc=T.IntegerType(),
    complexity=T.IntegerType(), visibility=T.StringType(), annotations=_TEXTS, annotation_args=_MAP, usings=_TEXTS,
    implements=_TEXTS, params=T.ArrayType(PARAM_TYPE), type=T.StringType(), value=T.StringType(),
    base_class=T.StringType(), return_type=T.StringType(), is_constructor=T.BooleanType(), layer=T.StringType(),
    framework=T.StringType(), module=T.StringType(), method=T.StringType(),
    http_calls=T.ArrayType(_record(method=T.StringType(), url=T.StringType())),
    mq_produces=_topic_list(), mq_consumes=_topic_list(), tagged_strings=_TEXTS, props=_MAP, seq=T.LongType(),
)

EDGE_SCHEMA = _record(
    app_name=T.StringType(), src=T.StringType(), dst=T.StringType(), kind=T.StringType(), confidence=T.ByteType(),
    evidence=T.StringType(), weight=T.LongType(), props=_MAP, seq=T.LongType(),
)

ENTRY_POINT_SCHEMA = _record(fqn=T.StringType(), kind=T.StringType(), metadata=_MAP)

HUNK_TYPE = "array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>"


def literal_map(values: dict) -> Column:
    """A small fixed lookup table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def node_label(kind: Column) -> Column:
    return literal_map(NODE_LABELS)[kind]


def confidence_name(level: Column) -> Column:
    return literal_map(CONFIDENCE_NAMES)[level.cast("int")]
