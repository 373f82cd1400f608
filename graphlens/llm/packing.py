"""Best-fit packing of documents into token sequences by bin completion.

All documents of one token length are alike, so the search runs on the
histogram of lengths: at most ``capacity`` rows, whatever the corpus. Around the
largest remaining length it enumerates undominated fillings, takes the one with
the least waste as often as the counts allow, and branches over the others
while the waste bound leaves room below the incumbent, which starts as the
best-fit-decreasing solution. The answer is a plan of *runs*, "this filling, so
many times". Spark then numbers the pieces of every length and reads each
piece's place off the plan, with no data on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import documents, map_batches, materialize
from graphlens.llm.encoding import ID_BYTES, crc32, encoder, portions

CAPACITY = 2048
#: Nodes that the search may open before it returns its incumbent.
NODES = 3_000
#: Fillings looked at around one largest length, and kept as branches.
LOOK, BRANCHES = 400, 6
#: Pieces of one length that one task numbers, on average.
NUMBERED = 1_000_000

Filling = tuple[int, ...]


@dataclass
class Run:
    """``times`` sequences that hold one piece of each length in ``filling``."""

    filling: Filling
    times: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit-decreasing, all pieces of a length at a time."""
    bins: dict[Filling, int] = {}
    space: dict[int, set[Filling]] = {}

    def move(filling, times, size):
        bins[filling] = bins.get(filling, 0) + times
        space.setdefault(capacity - size, set()).add(filling)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [s for s in space if s >= length and space[s]]
            if fits:
                tight = min(fits)
                filling = next(iter(space[tight]))
                times = min(left, bins[filling])
                bins[filling] -= times
                if not bins[filling]:
                    del bins[filling]
                    space[tight].discard(filling)
                move((*filling, length), times, capacity - tight + length)
            else:
                times = max(1, left // (capacity // length))
                move((length,), times, length)
            left -= times
    return [Run(f, n) for f, n in bins.items()]


def _fillings(lengths: list[int], counts: dict[int, int], room: int) -> list[Filling]:
    """Sets of pieces that fit into ``room``, found largest first; lengths are in descending order."""
    found, looked = [], 0

    def extend(at: int, room: int, chosen: Filling) -> Iterator[Filling]:
        fitted = False
        used = dict.fromkeys(chosen, 0)
        for x in chosen:
            used[x] += 1
        for i in range(at, len(lengths)):
            x = lengths[i]
            if x <= room and counts[x] > used.get(x, 0):
                fitted = True
                yield from extend(i, room - x, (*chosen, x))
        if not fitted:
            yield chosen

    for filling in extend(0, room, ()):
        looked += 1
        found.append(filling)
        if looked >= LOOK or (sum(filling) == room and len(found) >= BRANCHES):
            break
    return found


def dominated(filling: Filling, room: int, counts: dict[int, int]) -> bool:
    """Whether one unused piece could take the place of one or two chosen ones and fill at least as much."""
    waste = room - sum(filling)
    used = {x: filling.count(x) for x in filling}
    free = lambda x: counts.get(x, 0) > used.get(x, 0)
    singles = any(free(y) for x in set(filling) for y in range(x + 1, x + waste + 1))
    return singles or any(free(y) for a, b in set(combinations(filling, 2)) for y in range(a + b, a + b + waste + 1))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for some ``small``, pieces over half the capacity stand alone and the rest fills their gaps."""
    sizes = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        sizes[x] += n
    number, tokens = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    half, most = capacity // 2, 0
    for small in range(1, half + 1):
        alone = number[-1] - number[half]
        gaps = (number[capacity - small] - number[half]) * capacity - (tokens[capacity - small] - tokens[half])
        rest = tokens[half] - tokens[small - 1]
        most = max(most, int(alone + max(0, -(-(rest - gaps) // capacity))))
    return most


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Run]:
    """Bin completion over a histogram ``{length: pieces}``; every length is 1 to ``capacity``."""
    counts = {int(x): int(n) for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    incumbent = best_fit(counts, capacity)
    fewest, least = sum(r.times for r in incumbent), lower_bound(counts, capacity)
    if fewest <= least:
        return incumbent

    def branches(left: dict[int, int]) -> list[tuple[Filling, int]]:
        lengths = sorted(left, reverse=True)
        big = lengths[0]
        rest = left | {big: left[big] - 1}
        room = capacity - big
        found = [f for f in _fillings([x for x in lengths if x <= room], rest, room)]
        best = sorted((f for f in found if not dominated(f, room, rest)), key=lambda f: (room - sum(f), len(f)))
        out = []
        for f in (best or found)[:BRANCHES]:
            filling = (big, *f)
            out.append((filling, min(left[x] // filling.count(x) for x in set(filling))))
        return out

    def without(left: dict[int, int], filling: Filling, times: int) -> dict[int, int]:
        left = dict(left)
        for x in filling:
            left[x] -= times
            if not left[x]:
                del left[x]
        return left

    # Depth first; an entry holds what is left, the bins and waste so far, and its runs as a linked list.
    stack = [(counts, 0, 0, None)]
    tried = len(counts)
    while stack and nodes and fewest > least:
        left, bins, waste, runs = stack.pop()
        if -(-(total + waste) // capacity) >= fewest:
            continue
        nodes -= 1
        if not left or len(left) <= 0.5 * tried:  # the rest by best fit: a new incumbent, if it needs fewer
            tried = len(left) or len(counts)
            rest = best_fit(left, capacity)
            if bins + sum(r.times for r in rest) < fewest:
                fewest, incumbent = bins + sum(r.times for r in rest), rest
                chain = runs
                while chain:
                    incumbent.append(Run(chain[0], chain[1]))
                    chain = chain[2]
        if not left:
            continue
        for filling, times in reversed(branches(left)):
            more = waste + times * (capacity - sum(filling))
            if -(-(total + more) // capacity) < fewest:
                stack.append((without(left, filling, times), bins + times, more, (filling, times, runs)))
    return incumbent


def _placed(runs: list[Run], capacity: int) -> dict[str, np.ndarray]:
    """The plan as sorted columns: pieces ``first`` and later of a length go ``each`` to a sequence from ``base`` on, at ``offset``."""
    rows, taken, base = [], {}, 0
    for run in sorted(runs, key=lambda r: sorted(r.filling, reverse=True), reverse=True):
        offset = 0
        for x in sorted(set(run.filling), reverse=True):
            each = run.filling.count(x)
            rows.append((x, taken.get(x, 0), base, each, offset))
            taken[x] = taken.get(x, 0) + each * run.times
            offset += each * x
        base += run.times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "each", "offset"), columns.T))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``capacity``: only the first piece of a long document is shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch):
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for begin, stop in portions(texts):
            rows = []
            for doc_id, ids in zip(doc_ids[begin:stop], encoder(tokenizer).encode(texts[begin:stop])):
                ids += end
                n = len(ids) // ID_BYTES
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[a * ID_BYTES : b * ID_BYTES]
                    rows.append((doc_id, k, a, b - a, crc32(part), *([part] if keep_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names[: 5 + keep_ids])

    return map_batches(documents(docs), cut, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Places of all documents in sequences of at most ``capacity`` tokens.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``,
    and ``ids`` (little-endian 32-bit) with ``keep_ids``. A missing text is an
    empty document: its closing id alone. A missing ``doc_id`` stays missing;
    repeated rows are packed as often as they occur; an empty table gives no
    rows; extra columns are dropped.

    What the driver holds is the histogram (``capacity`` rows) and the plan,
    which has at most one row per length for each of its runs.
    """
    spark = docs.sparkSession
    parts = materialize(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(_placed(complete(counts, capacity), capacity))
    # Equal lengths are numbered in slices, as one length may hold a third of all pieces.
    salts = max(8, -(-sum(counts.values()) // NUMBERED))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = salted.withColumn("_rank", rank.cast("long")).join(shift, ["length", "_salt"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    numbered = numbered.select(*kept, (F.col("_rank") + F.col("_before") - 1).alias("_at"))

    def place(batches):
        key = None
        for batch in batches:
            p = plan.value
            if key is None:
                key = (p["length"] << 44) | p["first"]
            length, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_at"))
            row = np.searchsorted(key, (length << 44) | at, "right") - 1
            nth = at - p["first"][row]
            sequence = p["base"][row] + nth // p["each"][row]
            offset = p["offset"][row] + nth % p["each"][row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, doc_ids, ids`` in place order; a sequence has ``capacity`` ids at most."""
    rows = packed(docs, tokenizer, capacity, end_id, keep_ids=True)
    held = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held"))
    joined = F.aggregate("held.ids", F.to_binary(F.lit(""), F.lit("utf-8")), lambda a, x: F.concat(a, x))
    return held.select("sequence_id", F.col("held.doc_id").alias("doc_ids"), joined.alias("ids"))
