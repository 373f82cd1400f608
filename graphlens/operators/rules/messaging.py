"""Messages: events, listeners, templates, task queues, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import first_by
from graphlens.functions.text import owner_name, quoted_strings, short_name
from graphlens.graph import Graph, edge_rows, node_rows
from graphlens.operators.rules import RuleResult
from graphlens.schema import literal_map

# Event methods and listener annotations.
EVENT_LISTENERS = ["EventListener", "TransactionalEventListener"]
EVENT_METHODS = ["publishEvent", "publish"]
# Listener annotation -> broker, template type -> broker, sending methods.
LISTENER_BROKERS = {
    "KafkaListener": "kafka",
    "RabbitListener": "rabbitmq",
    "JmsListener": "jms",
}
TEMPLATE_BROKERS = {
    "KafkaTemplate": "kafka",
    "RabbitTemplate": "rabbitmq",
    "JmsTemplate": "jms",
    "StreamBridge": "kafka",
}
SEND_METHODS = ["send", "sendDefault", "convertAndSend", "convertSendAndReceive", "sendAndReceive"]
#: A task decorator: ``shared_task`` with or without its module, or the ``task`` of any application object.
TASK_DECORATOR = r"^@?\s*(?:(?:\w+\s*\.\s*)*shared_task|(?:\w+\s*\.\s*)+task)\s*(?:\(|$)"
#: The keyword argument ``queue`` of a call, its text in the group after the quote.
QUEUE_ARGUMENT = r"""[(,]\s*queue\s*=\s*(["'])(.*?)\1"""
TRIGGER_SUFFIX = r"\.(?:delay|apply_async|s|signature)$"
DEFAULT_QUEUE = "celery"
SCHEDULE_KEYS = ["cron", "fixedRate", "fixedDelay", "initialDelay", "zone"]


def _annotated(names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap("annotations", F.array(*[F.lit(n) for n in names])), F.lit(False))


# --- application events ------------------------------------------------------------------


def event_publishers(graph: Graph) -> DataFrame:
    """(src, event): callers of a publish method with the first event they construct."""
    calls = graph.edges_of("CALLS").select("src", "dst", "seq")
    publishing = calls.filter(short_name(F.col("dst")).isin(*EVENT_METHODS)).select("src").distinct()
    publishing = publishing.join(graph.nodes.select(F.col("fqn").alias("src")), "src", "left_semi")
    built = calls.filter(F.endswith("dst", F.lit(".<init>"))).withColumn("event", short_name(owner_name(F.col("dst"))))
    built = built.filter(F.contains(F.lower("event"), F.lit("event"))).join(publishing, "src", "left_semi")
    return first_by(built, ["src"], ["seq", "dst"], ["event"])


def event_listeners(graph: Graph) -> DataFrame:
    """(listener, event): the class named in the annotation, else the first parameter type."""
    rows = graph.of_kind("FUNCTION").filter(_annotated(EVENT_LISTENERS))
    stated = F.coalesce(*[F.nullif(F.col("annotation_args")[a], F.lit("")) for a in EVENT_LISTENERS])
    param = F.nullif(F.substring_index(F.get(F.col("params.type"), F.lit(0)), "<", 1), F.lit(""))
    event = F.coalesce(F.regexp_replace(stated, r"\.class$", ""), param)
    return rows.select(F.col("fqn").alias("listener"), event.alias("event")).filter("event IS NOT NULL")


def application_events(graph: Graph) -> RuleResult:
    """PRODUCES publisher -> listener by short event name, CONSUMES listener -> event class."""
    publishers = event_publishers(graph).withColumn("short", short_name(F.col("event")))
    listeners = event_listeners(graph).withColumn("short", short_name(F.col("event")))
    produced = publishers.select("src", "short").join(listeners.select(F.col("listener").alias("dst"), "short"), "short").select("src", "dst").distinct()
    known = graph.nodes.select(F.col("fqn").alias("event"), F.col("fqn").alias("exact"))
    classes = first_by(graph.of_kind("CLASS").select(F.col("name").alias("short"), "fqn", "seq"), ["short"], ["seq", "fqn"], ["fqn"])
    consumed = listeners.join(known, "event", "left").join(classes, "short", "left").select(
        F.col("listener").alias("src"), F.coalesce("exact", "fqn").alias("dst")
    ).filter("dst IS NOT NULL")
    edges = edge_rows(produced.withColumn("kind", F.lit("PRODUCES")).withColumn("evidence", F.lit("spring-events"))).unionByName(
        edge_rows(consumed.withColumn("kind", F.lit("CONSUMES")).withColumn("evidence", F.lit("spring-events")))
    )
    points = listeners.select(
        F.col("listener").alias("fqn"), F.lit("event_listener").alias("kind"), F.create_map(F.lit("event_type"), "event").alias("metadata")
    )
    return RuleResult(edges=edges, entry_points=points)


# --- brokers -----------------------------------------------------------------------------


def broker_consumers(graph: Graph) -> DataFrame:
    """(fqn, topic, broker) of annotated listeners; a list of topics gives several rows."""
    rows = graph.of_kind("FUNCTION").filter(_annotated(list(LISTENER_BROKERS))).select(
        "fqn", "annotation_args", F.explode(F.array_intersect("annotations", F.array(*[F.lit(n) for n in LISTENER_BROKERS]))).alias("annotation")
    )
    value = F.col("annotation_args")[F.col("annotation")]
    topics = F.when(value.rlike("""["']"""), quoted_strings(value)).otherwise(F.array(value))
    found = rows.select("fqn", F.explode(topics).alias("topic"), literal_map(LISTENER_BROKERS)[F.col("annotation")].alias("broker"))
    return found.filter(F.coalesce("topic", F.lit("")) != "")


def broker_producers(graph: Graph) -> DataFrame:
    """(fqn, topic, broker): sending calls on a template, or inside a class that holds one."""
    calls = graph.edges_of("CALLS").filter(short_name(F.col("dst")).isin(*SEND_METHODS)).select("src", "dst").distinct()
    brokers = literal_map(TEMPLATE_BROKERS)
    fields = graph.of_kind("FIELD").select(owner_name(F.col("fqn")).alias("cls"), F.substring_index("type", "<", 1).alias("base"), "seq", "fqn")
    held = first_by(
        fields.filter(F.col("base").isin(*TEMPLATE_BROKERS)).withColumn("held", brokers[F.col("base")]), ["cls"], ["seq", "fqn"], ["held"]
    )
    sending = calls.select("src", owner_name(F.col("src")).alias("cls"), brokers[short_name(owner_name(F.col("dst")))].alias("direct")).join(held, "cls", "left")
    sending = sending.select("src", F.coalesce("direct", "held").alias("broker")).filter("broker IS NOT NULL")
    plain = F.filter("tagged_strings", lambda s: ~F.upper(s).rlike("SELECT|INSERT|UPDATE|DELETE"))
    topics = graph.nodes.select(F.col("fqn").alias("src"), F.get(plain, F.lit(0)).alias("topic")).filter(F.coalesce("topic", F.lit("")) != "")
    return sending.join(topics, "src").select(F.col("src").alias("fqn"), "topic", "broker")


def broker_messages(graph: Graph) -> RuleResult:
    """Topics ``topic:broker:name`` with their producers and consumers."""
    consumers, producers = broker_consumers(graph), broker_producers(graph)
    topic = F.concat_ws(":", F.lit("topic"), "broker", "topic")
    both = consumers.select("topic", "broker").unionByName(producers.select("topic", "broker")).distinct()
    nodes = node_rows(both.select(
        topic.alias("fqn"), F.concat("broker", F.lit("://"), "topic").alias("name"), F.lit("MESSAGE_TOPIC").alias("kind"), F.lit("config").alias("language"),
        F.create_map(F.lit("broker"), "broker", F.lit("topic_name"), "topic").alias("props"),
    ))

    def links(rows, kind):
        return edge_rows(rows.select(F.col("fqn").alias("src"), topic.alias("dst"), F.lit(kind).alias("kind"), F.lit("spring-messaging").alias("evidence")))

    points = consumers.select("fqn", F.lit("message_consumer").alias("kind"), F.create_map(F.lit("topic"), "topic", F.lit("broker"), "broker").alias("metadata"))
    return RuleResult(nodes=nodes, edges=links(consumers, "CONSUMES").unionByName(links(producers, "PRODUCES")), entry_points=points)


# --- task queues -------------------------------------------------------------------------


def task_functions(graph: Graph) -> DataFrame:
    """(fqn, queue, seq): decorated tasks; the queue is named by the first task decorator."""
    first = F.get(F.filter("annotations", lambda a: a.rlike(TASK_DECORATOR)), F.lit(0))
    rows = graph.of_kind("FUNCTION").filter("language = 'python'").select("fqn", first.alias("decorator"), "seq").filter("decorator IS NOT NULL")
    queue = F.coalesce(F.nullif(F.regexp_extract("decorator", QUEUE_ARGUMENT, 2), F.lit("")), F.lit(DEFAULT_QUEUE))
    return rows.select("fqn", queue.alias("queue"), "seq")


def task_triggers(graph: Graph, tasks: DataFrame) -> DataFrame:
    """PRODUCES from the caller of a trigger to the queue: exact task, else the first task of a bare name."""
    calls = graph.edges_of("CALLS").filter(F.col("dst").rlike(TRIGGER_SUFFIX)).select("src", F.regexp_replace("dst", TRIGGER_SUFFIX, "").alias("task"))
    exact = tasks.select(F.col("fqn").alias("task"), F.col("queue").alias("exact"))
    bare = first_by(tasks.withColumn("task", short_name(F.col("fqn"))), ["task"], ["seq", "fqn"], ["queue"]).withColumnRenamed("queue", "loose")
    found = calls.distinct().join(exact, "task", "left").join(bare, "task", "left")
    queue = F.coalesce("exact", F.when(~F.contains("task", F.lit(".")), F.col("loose")))
    return edge_rows(
        found.select("src", F.concat(F.lit("queue::"), queue).alias("dst")).filter("dst IS NOT NULL").distinct()
        .withColumn("kind", F.lit("PRODUCES")).withColumn("evidence", F.lit("celery-producer"))
    )


def task_queues(graph: Graph) -> RuleResult:
    tasks = task_functions(graph)
    queue = F.concat(F.lit("queue::"), "queue")
    nodes = node_rows(tasks.select("queue").distinct().select(queue.alias("fqn"), F.col("queue").alias("name"), F.lit("MESSAGE_TOPIC").alias("kind")))
    consumed = edge_rows(tasks.select(F.col("fqn").alias("src"), queue.alias("dst"), F.lit("CONSUMES").alias("kind"), F.lit("celery-task-decorator").alias("evidence")))
    points = tasks.select("fqn", F.lit("message_consumer").alias("kind"), F.create_map(F.lit("queue"), "queue").alias("metadata"))
    layers = tasks.select("fqn", F.lit("Business Logic").alias("layer"))
    return RuleResult(nodes=nodes, edges=consumed.unionByName(task_triggers(graph, tasks)), layers=layers, entry_points=points)


# --- schedules ---------------------------------------------------------------------------


def schedules(graph: Graph) -> RuleResult:
    """Entry points of scheduled and asynchronous methods; their classes do background work."""
    timed = graph.of_kind("FUNCTION").filter(_annotated(["Scheduled", "Schedules"]))
    known = F.array(*[F.lit(k) for k in SCHEDULE_KEYS])
    empty = F.create_map().cast("map<string,string>")
    named = F.map_filter(F.coalesce("annotation_args", empty), lambda k, v: F.array_contains(known, k))
    bare = F.col("annotation_args")["Scheduled"]
    metadata = F.when(bare.isNotNull(), F.create_map(F.lit("cron"), bare)).otherwise(named)
    points = timed.select("fqn", F.lit("scheduled").alias("kind"), metadata.alias("metadata"))
    loose = graph.of_kind("FUNCTION").filter(_annotated(["Async"]))
    executor = F.col("annotation_args")["Async"]
    points = points.unionByName(loose.select(
        "fqn", F.lit("async").alias("kind"), F.when(F.coalesce(executor, F.lit("")) != "", F.create_map(F.lit("executor"), executor)).otherwise(empty).alias("metadata")
    ))
    layers = timed.select(owner_name(F.col("fqn")).alias("fqn")).distinct().withColumn("layer", F.lit("Background Processing"))
    return RuleResult(layers=layers, entry_points=points)


def async_calls(graph: Graph) -> DataFrame:
    """Calls that go to an asynchronous method."""
    targets = graph.of_kind("FUNCTION").filter(_annotated(["Async"])).select(F.col("fqn").alias("dst"))
    return graph.edges_of("CALLS").join(targets, "dst", "left_semi").select("src", "dst")
