"""Token counts through a digest cache.

Every text is reduced to its SHA-256 digest. Digests that the cache of the same
tokenizer version lacks are the misses; one text of every missed digest is
encoded, its count is appended to the cache, and the documents are joined to
the cache by digest. Copies, however many, cost one digest each.

Texts travel once and compressed: a map-side pass keeps the first text of each
digest, so a text that a third of the rows share leaves each task once.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.scale import shared_dir
from graphlens.llm.common import documents, materialize
from graphlens.llm.encoding import ID_BYTES, encoder, portions

CACHE = "digest binary, n_tokens long"
#: Digests that a map task remembers to leave out copies; beyond it some copies are sent twice and dropped later.
SEEN = 200_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never meets this one's counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


def _packed(rows: DataFrame) -> DataFrame:
    """One compressed text per digest and map task."""

    def pack(batches):
        squeeze, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            digests, texts = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
                if digest in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                digests.append(digest)
                texts.append(squeeze.compress(text.as_py().encode()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["digest", "packed"])

    return rows.mapInArrow(pack, "digest binary, packed binary")


def _counted(misses: DataFrame, path: str) -> DataFrame:
    """Counts of packed texts, each digest of a partition once; all rows of a digest are in one partition."""

    def count(batches):
        loose, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            digests, texts = [], []
            for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("packed")):
                if digest != last:
                    digests.append(digest)
                    texts.append(packed.as_py())
                last = digest
            for begin, end in portions(texts, 1_000_000):
                ids = encoder(path).encode([loose.decompress(x).decode() for x in texts[begin:end]])
                yield pa.RecordBatch.from_arrays([pa.array(digests[begin:end], pa.binary()), pa.array([len(x) // ID_BYTES for x in ids], pa.int64())], ["digest", "n_tokens"])

    return misses.repartition("digest").sortWithinPartitions("digest").mapInArrow(count, CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs``.

    ``cache`` is a folder that all executors reach; counts are kept in a
    subfolder per tokenizer version and a later call encodes only what is new.
    Without it the call starts from an empty cache of its own.

    A missing text counts as an empty one: 0 bytes, 0 tokens. A missing
    ``doc_id`` stays missing. Repeated rows give repeated results, an empty
    table an empty one; other columns are not looked at. Special strings inside
    texts become special tokens, as is the library's default.
    """
    spark = docs.sparkSession
    folder = f"{cache or f'{shared_dir(spark)}/graphlens/tokens-{uuid.uuid4().hex}'}/{tokenizer_version(tokenizer)}"
    rows = documents(docs).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = rows.select("digest", "text")
    if cache and _exists(spark, folder):
        known = spark.read.schema(CACHE).parquet(folder)
        packed = _packed(texts).join(known.select("digest"), "digest", "left_anti")
    else:
        packed = _packed(texts)
    _counted(packed, tokenizer).write.mode("append").parquet(folder)
    counts = spark.read.schema(CACHE).parquet(folder)
    if cache:  # calls that ran at the same time may both have added a digest
        counts = materialize(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    # A join straight on its two shuffles: Spark splits the partition of a digest that many rows share.
    sizes = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
