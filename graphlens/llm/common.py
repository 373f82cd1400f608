"""What several operators share: clean inputs, stored intermediate tables, batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.scale import materialize

__all__ = ["documents", "forget", "held", "map_batches", "materialize", "mixed", "segments", "slices", "small_batches", "text_bytes", "tidy"]

#: Rows of an Arrow batch: texts of some KB make batches of a few MB, on both sides of the pipe.
BATCH_ROWS = 1_000


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` of any table with these columns; a missing text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def small_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of this session: they hold whole texts, and Spark's default of 10,000 rows is made for numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: What stays in a worker between tasks: a function that drops it, and the modules whose tasks still use it.
_held: list[tuple[Callable[[], None], tuple[str, ...]]] = []


def held(drop: Callable[[], None], *users: str) -> None:
    """Tells of memory that a worker keeps for tasks of the modules ``users`` of this package."""
    _held.append((drop, tuple(f"{__package__}.{name}" for name in users)))


def forget(module: str) -> None:
    """Drops what this module's tasks have no use for; a worker outlives its stage."""
    for drop, users in _held:
        if module not in users:
            drop()


def tidy() -> None:
    """Gives freed memory back to the machine; a worker would keep it until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, most_bytes: int = 4_000_000) -> DataFrame:
    """``fn`` over pieces of Arrow batches that hold at most about ``most_bytes`` of data, or one row."""
    small_batches(df.sparkSession)

    def run(batches):
        forget(fn.__module__)
        for batch in batches:
            for part in slices(batch, most_bytes):
                yield from fn(part)
        tidy()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    if batch.nbytes <= most_bytes or rows == 1:
        yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), most_bytes)
    yield from slices(batch.slice(half), most_bytes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, missing ones empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


#: Bytes of a long text that are split into words at a time.
SEGMENT = 1_000_000


def segments(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``SEGMENT`` bytes, cut at ASCII spaces, so that no word is cut; all of it if it has none."""
    begin = 0
    while len(text) - begin > SEGMENT:
        end = text.find(b" ", begin + SEGMENT)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
