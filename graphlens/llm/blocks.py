"""Hash tables of all word windows of a corpus, built and asked block by block.

A corpus has as many windows as words, and a plain row per window costs several
times the text in shuffles. Here documents are dealt into blocks by a hash of
their row, and a block sends one packed row to each hash bucket: the distinct
window hashes it holds, pre-aggregated over its documents. So a window that a
third of all documents share reaches its bucket once per block. The bucket
answers each row with one value per hash, in the order it was sent; the block
computes the same hashes again and reads the answers off.

Blocks and buckets have a target size, and their numbers follow the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import documents, forget, held, map_batches, mixed, segments, tidy

#: Text bytes of a block and windows of a bucket, on average.
BLOCK_BYTES = 4_000_000
BUCKET_WINDOWS = 1_000_000
#: Words that a worker remembers with their hashes.
WORDS = 300_000
#: Odd base of the rolling hash over 64-bit numbers, and its inverse.
BASE = 0xD1B54A32D192ED03
INVERSE = pow(BASE, -1, 2**64)


class WordHashes(dict):
    """Word to 64-bit hash, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers


def _drop() -> None:
    _words.clear()
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


held(_drop, "blocks", "substring_dedup", "language_model")


def _tidied(fn):
    """``fn`` of a group, after which its memory goes back to the machine."""

    def run(*tables):
        forget(__name__)
        found = fn(*tables)
        tidy()
        return found

    return (lambda left, right: run(left, right)) if fn.__code__.co_argcount == 2 else (lambda table: run(table))


def rolling(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of each ``window`` consecutive word hashes, modulo 2^64, from one pass of prefix sums."""
    n = len(words)
    if n < window:
        return np.empty(0, np.uint64)
    up, down = _grown(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=prefix[1:], dtype=np.uint64)
    return (prefix[window:] - prefix[: n - window + 1]) * down[: n - window + 1]


def two_hashes(words: np.ndarray, window: int, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, ``bits`` of a second hash) of each window; together they tell windows apart."""
    salt = np.uint64(window)
    first = mixed(rolling(words, window) + salt)
    second = mixed(rolling(mixed(words), window) + salt)
    bucket = ((first >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return bucket, second & np.uint64(2**bits - 1)


class Block:
    """The documents of a block in a fixed order, with their words in a row."""

    def __init__(self, table: pa.Table, split: Callable[[bytes], list[bytes]]):
        ids = table.column("doc_id").to_pylist()
        loose = zstandard.ZstdDecompressor()
        packed = table.column("packed").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, packed[i]))
        self.order = order
        self.doc_ids = [ids[i] for i in order]
        self.packed = [packed[i] for i in order]
        parts = []
        for p in self.packed:
            parts.append(np.concatenate([word_hashes(split(s)) for s in segments(loose.decompress(p))]))
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(parts)), self.lengths)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def texts(self):
        loose = zstandard.ZstdDecompressor()
        for p in self.packed:
            yield loose.decompress(p)

    def whole(self, window: int) -> np.ndarray:
        """Positions at which a window begins that ends in the same document."""
        at = np.arange(max(0, len(self.words) - window + 1))
        return at[self.owner[at] == self.owner[at + window - 1]]


def blocks(docs: DataFrame, per_word: int = 1, keep: dict[str, str] | None = None) -> tuple[DataFrame, int]:
    """(``block, doc_id, packed``, number of buckets) for ``per_word`` windows a word.

    ``keep`` names more columns of ``docs`` that go along, by the names they get.
    """
    keep = keep or {}
    rows = documents(docs, *[F.col(c).alias(name) for name, c in keep.items()])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    buckets = min(2**31 - 1, max(1, -(-size * per_word // (6 * BUCKET_WINDOWS))))

    def pack(batch):
        squeeze = zstandard.ZstdCompressor(level=3)
        packed = [squeeze.compress(t.as_py().encode()) for t in batch.column("text")]
        more = [batch.column(c) for c in keep]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("doc_id"), pa.array(packed, pa.binary()), *more], ["block", "doc_id", "packed", *keep])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return map_batches(keyed, pack, "block long, doc_id long, packed binary" + types), int(buckets)


def ask(packed: DataFrame, send: Callable[[pa.Table], pa.Table], sent: str, answer: Callable[[pa.Table], pa.Table], finish: Callable[[pa.Table, pa.Table], pa.Table], result: str) -> DataFrame:
    """Blocks send rows to buckets, buckets answer with ``block, bucket, reply``, blocks finish with their answers.

    Both uses of the blocks read the same shuffle of the packed texts.
    """
    replies = (
        packed.groupBy("block").applyInArrow(_tidied(send), sent).groupBy("bucket").applyInArrow(_tidied(answer), "block long, bucket long, reply binary")
    )
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_tidied(finish), result)


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as compressed byte planes, which are small where numbers are sorted and dense or mostly alike."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def from_planes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    full = np.zeros((raw.shape[1], 8), np.uint8)
    full[:, :width] = raw.T
    return full.view("<u8").ravel()
