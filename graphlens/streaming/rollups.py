"""Windowed roll-ups, progress and notification suppression as streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphlens.functions.scale import last_by, materialize
from graphlens.operators.structure import union
from graphlens.operators.usage import DEDUP_HOURS


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the written rows with their ``batch`` number.

    Every batch goes to its own folder and a retried batch replaces it, so a
    restart after a lost executor neither loses nor repeats rows.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    job = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    job.awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*").select(
        *schema.fieldNames(), F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("bigint").alias("batch")
    )


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode result."""
    return last_by(rows, keys, ["batch"]).drop("batch")


def activity_per_day(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, action, n) of an activity stream ``(created_at, action)``."""
    windowed = log.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "action").agg(F.count("*").alias("n"))
    return windowed.select(F.to_date("w.start").alias("day"), "action", "n")


def usage_per_day(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, source, calls, input_tokens, output_tokens, cost) of a model usage stream."""
    windowed = log.withWatermark("created_at", delay).groupBy(F.window("created_at", "1 day").alias("w"), "source").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("estimated_cost_usd").alias("cost"),
    )
    return windowed.select(F.to_date("w.start").alias("day"), "source", "calls", "input_tokens", "output_tokens", "cost")


def run_progress(events: DataFrame) -> DataFrame:
    """(run_id, at, stage, status): latest progress event per analysis run."""
    newest = F.max(F.struct("at", "stage", "status")).alias("e")
    return events.groupBy("run_id").agg(newest).select("run_id", "e.at", "e.stage", "e.status")


# --- suppression -------------------------------------------------------------------------


def suppress_stream(events: DataFrame) -> DataFrame:
    """Accepted events of ``(subject, trigger, sent_at)``: at most one per key in 24 hours, in time order within a micro-batch.

    State is one timestamp per key and expires after a day of event time.
    """
    hours = DEDUP_HOURS

    def accept(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gap = pd.Timedelta(hours=hours)
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        # The rows of a key come in file order; the rule is about time order.
        times, kept = pd.concat([chunk["sent_at"] for chunk in chunks]).sort_values(), []
        for at in times:
            if last is None or at - last > gap:
                kept.append(at)
                last = at
        if kept:
            yield pd.DataFrame({"subject": key[0], "trigger": key[1], "sent_at": kept})
        state.update((int(last.value // 1000),))
        expiry = int(last.value // 1_000_000) + hours * 3_600_000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)
    return (
        events.withWatermark("sent_at", "1 hour").groupBy("subject", "trigger")
        .applyInPandasWithState(
            accept, f"subject {kind['subject']}, trigger {kind['trigger']}, sent_at timestamp", "last bigint", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def suppress_batch(events: DataFrame, slot_minutes: int = 10) -> DataFrame:
    """The same rule over a whole table; a key of any size is spread over time slots.

    An event after a pause of more than a day is accepted whatever came before, so
    such events start runs. Inside a run the event accepted after ``t`` is the first
    one later than ``t`` plus a day: every event gets that pointer, and pointers of
    pointers reach all accepted events of all runs in log2(longest run) rounds.
    Slots of a key are summed up in one row each, so a window over a key sees as
    many rows as its time span has slots, and a window over events only one slot.
    Repeated events count once, NULL subjects and triggers are keys of their own,
    and events without a time take no part.
    """
    kinds = dict(events.dtypes)
    day, width = DEDUP_HOURS * 3_600_000_000, slot_minutes * 60_000_000
    if day % width:
        raise ValueError("a slot has to divide the suppression time")
    key, slot = ["subject", "trigger"], F.floor(F.col("at") / width)
    times = events.filter("sent_at IS NOT NULL").select(*key, F.unix_micros(F.col("sent_at").cast("timestamp")).alias("at")).distinct()
    times = materialize(times.withColumn("slot", slot), "times")
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = times.groupBy(*key, "slot").agg(F.max("at").alias("last")).withColumn("before", F.max("last").over(earlier)).drop("last")
    previous = F.coalesce(F.lag("at").over(Window.partitionBy(*key, "slot").orderBy("at")), F.col("before"))
    marked = _same(times, before, [*key, "slot"]).withColumn("starts", F.coalesce(F.col("at") - previous > day, F.lit(True))).drop("before")
    marked = materialize(marked, "marked")

    # Every event asks for the first one later than a day after it: in the slot of that time, or in the next one that has events.
    event = F.struct("at", "starts")
    asks = marked.select(*key, (F.col("at") + day).alias("at"), (F.col("slot") + day // width).alias("slot"), F.lit(None).cast("boolean").alias("starts"))
    both = marked.select(*key, "at", "slot", "starts").unionByName(asks)
    present = F.when(F.col("starts").isNotNull(), event)
    later = Window.partitionBy(*key).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    after = both.groupBy(*key, "slot").agg(F.min(present).alias("first")).withColumn("after", F.min("first").over(later)).drop("first")
    downward = Window.partitionBy(*key, "slot").orderBy(F.desc("at"), F.col("starts").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("next", F.min(present).over(downward)).filter("starts IS NULL").drop("starts")
    pointers = _same(within, after, [*key, "slot"]).withColumn("next", F.coalesce("next", "after"))
    jumps = materialize(pointers.filter("NOT next.starts").select(*key, (F.col("at") - day).alias("at"), F.col("next.at").alias("to")), "jumps")

    accepted = [materialize(marked.filter("starts").select(*key, "at"), "accepted")]
    while True:
        reached = union(accepted)
        step = _same(reached, jumps, [*key, "at"], "inner").select(*key, F.col("to").alias("at"))
        step = materialize(step, "accepted")
        if step.isEmpty():
            break
        accepted.append(step)
        second = jumps.select(*key, F.col("at").alias("to"), F.col("to").alias("end"))
        jumps = materialize(_same(jumps, second, [*key, "to"], "inner").select(*key, "at", F.col("end").alias("to")), "jumps")
    at = F.timestamp_micros("at").cast(kinds["sent_at"])
    return union(accepted).select(*key, at.alias("sent_at"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal ``keys``, NULL keys included; ``right`` gives its other columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
