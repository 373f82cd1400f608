"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: ``window`` consecutive
words, or all words of a shorter item. Patterns of one length share a table.
For the block of ``BLOCK`` words that ends at a text position, the shift table
tells how far the search may jump without missing an occurrence (unseen blocks
jump over nearly a whole window); where it says 0, the bucket of that suffix
names the patterns to compare word by word.

Documents are only scanned, never shuffled. The patterns reach the tasks in
portions of a fixed number of windows, one stage for each portion, under a
number each. The numbers that a document contains are joined to the ids of the
items afterwards, so no task holds the items of a passage that many share.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import map_batches, materialize, segments, text_bytes

WINDOW = 10
#: Words of a block; patterns of one word have blocks of one.
BLOCK = 2
#: Windows that one broadcast holds (about 150 bytes each), so 30 MB at most.
PORTION = 200_000

#: A-Z become a-z; ASCII bytes that belong to no word become spaces; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z: digits, a-z and everything outside ASCII."""
    return text.translate(_FOLD).split()


class WuManber:
    """Shift tables, suffix buckets and comparison for a set of word patterns."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.items = list(patterns.values())
        self.tables = []
        by_length = defaultdict(list)
        for number, pattern in enumerate(patterns):
            by_length[len(pattern)].append((pattern, number))
        for m, group in sorted(by_length.items()):
            b = min(BLOCK, m)
            shift: dict = {}
            bucket = defaultdict(list)
            for pattern, number in group:
                for end in range(b, m + 1):
                    block = pattern[end - 1] if b == 1 else pattern[end - b : end]
                    shift[block] = min(shift.get(block, m), m - end)
                bucket[pattern[m - 1] if b == 1 else pattern[m - b :]].append((list(pattern), number))
            self.tables.append((m, b, m - b + 1, shift, dict(bucket)))

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Words of a whole text, their intervals inside occurrences, and the items that occur; long texts in overlapping parts."""
        spans, items, before, kept = [], set(), 0, []
        longest = max((m for m, *_ in self.tables), default=1)
        for segment in segments(text):
            part = kept + words(segment)
            found, more = self.find(part)
            spans += [(a + before, b + before) for a, b in found]
            items |= more
            kept = part[max(0, len(part) - longest + 1) :]
            before += len(part) - len(kept)
        return before + len(kept), spans, items

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Intervals of words inside occurrences, and the numbers of the items that occur."""
        spans, found = [], set()
        n = len(text)
        for m, b, far, shift, bucket in self.tables:
            get, at = shift.get, m - 1
            while at < n:
                block = text[at] if b == 1 else (text[at - 1], text[at])
                jump = get(block, far)
                if jump:
                    at += jump
                    continue
                begin = at - m + 1
                for pattern, number in bucket[block]:
                    if text[begin : at + 1] == pattern:
                        spans.append((begin, at + 1))
                        found |= self.items[number]
                at += 1
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside at least one interval."""
    total, reach = 0, 0
    for begin, end in sorted(spans):
        total += max(0, end - max(begin, reach))
        reach = max(reach, end)
    return total


def patterns(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, pattern``: the windows of every item with an id and at least one word."""

    def cut(batch):
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text"))):
            w = words(text)
            rows += [(item, b" ".join(w[i : i + window])) for i in range(max(1, len(w) - window + 1)) if w]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "pattern"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows.filter("item_id IS NOT NULL"), cut, "item_id string, pattern binary").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), portion: int = PORTION, items: bool = True) -> DataFrame:
    """The columns ``keep`` and ``n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    A missing or empty text has no words and no hits; its digest is that of the
    empty string. Items without an id or without words never occur. Repeated
    documents are judged alike, repeated items count once, an empty benchmark
    leaves every document clean. Columns besides ``keep`` are ignored. Without
    ``items`` the columns about them are left out, and so is the join that
    finds their ids.
    """
    stored = materialize(patterns(benchmark, window), "patterns")
    numbered = stored.select("pattern").distinct().withColumn("number", F.monotonically_increasing_id())
    numbered = materialize(numbered, "pattern_numbers")
    groups = max(1, -(-numbered.count() // portion))
    numbered = numbered.withColumn("_portion", F.pmod(F.xxhash64("pattern"), F.lit(groups)))
    rows = docs.select(*[F.col(c) for c in keep], *([] if "text" in keep else [F.col("text").cast("string").alias("_text")]))
    for k in range(groups):
        rows = _scan(rows, keep, numbered.filter(F.col("_portion") == k), k == 0, k == groups - 1)
        if k < groups - 1:
            rows = materialize(rows, "scanned")  # so that no stage holds two portions
    counts = ["n_words", "n_hit", (F.col("n_hit") > 0).alias("contaminated")]
    if not items:
        return rows.select(*keep, *counts)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "judged")
    ids = stored.join(numbered, "pattern").select("number", "item_id")
    found = rows.filter("size(_numbers) > 0").select("_row", F.explode("_numbers").alias("number")).join(ids, "number")
    named = found.select("_row", "item_id").distinct().groupBy("_row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("_ids"))
    digest = F.sha2(F.coalesce(F.concat_ws(",", "_ids"), F.lit("")).cast("binary"), 256).alias("items_sha256")
    judged = rows.join(named, "_row", "left")
    return judged.select(*keep, "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), digest, counts[-1])


def _scan(rows: DataFrame, keep, part: DataFrame, first: bool, last: bool) -> DataFrame:
    """One pass with one portion of the patterns; a row carries the spans and the numbers of the patterns found so far."""
    found = {tuple(bytes(r["pattern"]).split(b" ")): {r["number"]} for r in part.select("pattern", "number").toLocalIterator()}
    shared = rows.sparkSession.sparkContext.broadcast(found)
    text = "text" if "text" in keep else "_text"
    carried = [*keep, *([] if text in keep or last else [text])]

    def judge(batch):
        if "search" not in made:
            made["search"] = WuManber(shared.value)
        lengths, spans, numbers = [], [], []
        earlier = ([[]] * batch.num_rows,) * 2 if first else (batch.column("_spans").to_pylist(), batch.column("_numbers").to_pylist())
        for words_, flat, before in zip(text_bytes(batch.column(text)), *earlier):
            n, new_spans, new_numbers = made["search"].search(words_)
            lengths.append(n)
            spans.append(list(zip(flat[::2], flat[1::2])) + new_spans)
            numbers.append(sorted(new_numbers.union(before)))
        base = [batch.column(c) for c in carried]
        lists = [pa.array(numbers, pa.list_(pa.int64()))]
        if last:
            counts = [pa.array(x, pa.int64()) for x in (lengths, [covered(s) for s in spans])]
            yield pa.RecordBatch.from_arrays([*base, *counts, *lists], [*carried, "n_words", "n_hit", "_numbers"])
        else:
            flat = pa.array([[x for pair in s for x in pair] for s in spans], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*base, flat, *lists], [*carried, "_spans", "_numbers"])

    made: dict[str, WuManber] = {}  # one search of a task, built with its first batch
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in carried)
    return map_batches(rows, judge, schema + (", n_words long, n_hit long, _numbers array<long>" if last else ", _spans array<long>, _numbers array<long>"))
