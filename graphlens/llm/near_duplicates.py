"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint is the bitwise majority over the hashes of its word
shingles. Equal fingerprints are one node. Each fingerprint gets a row of the
pivot table: its Hamming distances to ``PIVOTS`` reference fingerprints. Two
fingerprints at distance d differ by d at most in every coordinate, so a pair
whose largest coordinate difference exceeds ``most`` is discarded unseen; the
survivors are compared bit by bit.

Distances to a reference have a spread of 4 bits, as much as the threshold, so
the table alone cannot say which pairs to bring together. Pairs meet by blocks:
the 64 bits are cut into more blocks than ``most``, and ``most`` differing bits
leave some blocks untouched. Every choice of that many blocks is a key, which
makes the search exact. A key that many fingerprints share is cut again, over
its remaining bits, until groups are small, so a ball of near copies is spread
over many tasks. Groups only keep the links that connect something new.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import documents, map_batches, materialize, mixed, segments, text_bytes

SHINGLE = 4
MOST = 4
BITS = 64
SEED = 42
#: References of the pivot table.
PIVOTS = 16
#: Fingerprints under one key that are compared directly.
DIRECT = 2_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, spread, the same on every machine."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over all shingles of a UTF-8 text, 0 without words."""
    counts, total, words = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for segment in segments(text.translate(_FOLD)):
        words = words[max(0, len(words) - shingle + 1) :] + segment.split()
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())), np.uint64, len(begins))
        counts += set_bits(hashes)
        total += len(hashes)
    if not total and words:  # fewer words than a shingle has
        counts, total = set_bits(np.array([digest(b" ".join(words), SEED)], np.uint64)), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit number) of every document."""

    def run(batch):
        fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(documents(docs), run, "doc_id long, fp long")


def scheme(n: int, most: int = MOST) -> tuple[int, int]:
    """(blocks, blocks of a key): keys as long as ``n`` fingerprints need to meet few others."""
    need = max(1.0, np.log2(max(n, 2)))
    for blocks in range(most + 1, 2 * most + 3):
        if BITS * (blocks - most) / blocks >= need:
            return blocks, blocks - most
    return 2 * most + 2, most + 2


def masks(free: int, blocks: int, chosen: int) -> list[int]:
    """Bit masks of all choices of ``chosen`` out of ``blocks`` equal shares of the bits in ``free``."""
    bits = [b for b in range(BITS) if free >> b & 1]
    shares = [sum(1 << b for b in bits[k::blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(shares, chosen)]


def near_pairs(fps: np.ndarray, most: int = MOST) -> np.ndarray:
    """Links (i, j) that connect all fingerprints of the array within ``most`` bits of each other.

    The pivot table discards, the exact distance confirms. Pairs already
    connected through other links may be left out, others never are.
    """
    n = len(fps)
    if n < 2:
        return np.empty((0, 2), np.int64)
    if n > DIRECT:
        varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
        bits = bin(varying).count("1")
        if bits > 2 * most + 2:
            return _divided(fps, varying, most)
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)
    stop = np.searchsorted(first, first + most, "right")
    label, links = np.arange(n), []
    for begin in range(0, n, 512):
        end = min(n, begin + 512)
        far = int(stop[end - 1])
        apart = np.abs(table[begin:end, None, 0] - table[None, begin:far, 0]) <= most
        left, right = np.nonzero(apart)
        left, right = left + begin, right + begin
        keep = left < right
        left, right = left[keep], right[keep]
        for k in range(1, table.shape[1]):
            keep = np.abs(table[left, k] - table[right, k]) <= most
            left, right = left[keep], right[keep]
        keep = np.bitwise_count(fps[left] ^ fps[right]) <= most
        for a, b in zip(left[keep].tolist(), right[keep].tolist()):
            a0, b0 = _root(label, a), _root(label, b)
            if a0 != b0:
                label[max(a0, b0)] = min(a0, b0)
                links.append((order[a], order[b]))
    return np.array(links, np.int64).reshape(-1, 2)


def _root(label: np.ndarray, x: int) -> int:
    while label[x] != x:
        label[x] = label[label[x]]
        x = label[x]
    return x


def _divided(fps: np.ndarray, varying: int, most: int) -> np.ndarray:
    """Links of a large group through keys over its varying bits."""
    blocks = most + 2
    found = []
    for mask in masks(varying, blocks, blocks - most):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                found.append(group[near_pairs(fps[group], most)])
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` of ``nodes``, enough to connect every close pair."""
    n = nodes.count()
    blocks, chosen = scheme(n, most)
    choices = masks(2**BITS - 1, blocks, chosen)
    numbers = F.array(*[F.lit(_signed(m)) for m in choices])
    keyed = nodes.select("fp", F.posexplode(numbers).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # Keys that too many share get a second key over the other bits, in Spark, before anything is gathered.
    heavy = keyed.groupBy("choice", "key").count().filter(F.col("count") > 4 * DIRECT).select("choice", "key", F.lit(True).alias("heavy"))
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks((2**BITS - 1) & ~c, most + 2, 2)]) for c in choices])
    marked = keyed.join(heavy, ["choice", "key"], "left")
    light = marked.filter("heavy IS NULL").select("fp", "choice", F.lit(-1).alias("finer"), "key", F.lit(0).cast("long").alias("key2"))
    split = (
        marked.filter("heavy").select("fp", "choice", "key", F.posexplode(finer[F.col("choice")]).alias("finer", "mask"))
        .select("fp", "choice", "finer", "key", F.col("fp").bitwiseAND(F.col("mask")).alias("key2"))
    )
    keys = ["choice", "finer", "key", "key2"]
    together = light.unionByName(split).repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        held, group = [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp")]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:4]], 0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            fps, out = columns[4].view(np.uint64), []
            many = np.diff(bounds)
            for k, (begin, end) in enumerate(zip(bounds, bounds[1:])):
                edge = k == 0 or k == len(many) - 1
                if not edge and end - begin == 1:
                    continue
                now = tuple(c[begin] for c in columns[:4])
                if now != group:
                    out += _linked(held, most)
                    held, group = [], now
                held.append(fps[begin:end])
            yield _edges(out)
        yield _edges(_linked(held, most))

    return together.mapInArrow(compare, "a long, b long").distinct()


def _linked(held: list[np.ndarray], most: int) -> list[np.ndarray]:
    fps = np.concatenate(held) if held else np.empty(0, np.uint64)
    if len(fps) < 2:
        return []
    if len(fps) == 2:
        near = int(fps[0] ^ fps[1]).bit_count() <= most
        return [fps[None, :]] if near and np.ptp(pivot_table(fps), axis=0).max() <= most else []
    return [fps[near_pairs(fps, most)]]


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
    low, high = np.sort(pairs.view(np.int64), axis=1).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(low)), pa.array(np.ascontiguousarray(high))], ["a", "b"])


def _signed(x: int) -> int:
    return x - 2**BITS if x >= 2 ** (BITS - 1) else x


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``edges`` (``a, b``): the smallest node that can be reached.

    Alternating steps: every node's larger neighbours move to its smallest one,
    then every node's smaller neighbours do. Each step is a join with one row
    per node, and the number of steps grows with the logarithm of the size.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small, "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document with an id.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the smallest
    ``doc_id`` reachable over links of ``most`` differing bits or fewer, itself
    included. Missing, empty and blank texts have fingerprint zero and link
    like any other. Rows without ``doc_id`` keep their fingerprint, are nobody's
    smallest id, and get the component of their fingerprint (none if no row of
    it has an id). Repeated rows give repeated results; an empty table gives no
    rows; extra columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp"), most))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    table = named.join(smallest, "component").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(table, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
