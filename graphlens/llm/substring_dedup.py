"""Removal of repeated passages by Rabin-Karp hashes of every token window.

All windows of ``window`` consecutive words are hashed and counted over the
corpus (see :mod:`graphlens.llm.blocks`). A window is repeated for a document if
a document with a smaller id has it too. Repeated windows of a document merge
into maximal intervals, and the words inside them go. Windows are judged on the
input, so the smallest document keeps every passage it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.blocks import Block, ask, blocks, from_planes, planes, two_hashes
from graphlens.llm.common import segments

WINDOW = 13
#: Bits of a hash inside its bucket.
_BITS = 56
_NO_ID = np.iinfo(np.int64).max


def _windows(table: pa.Table, window: int, buckets: int):
    """The block, its window positions, and its distinct windows with their smallest document.

    Distinct windows are sorted by bucket, document and hash: ``ranks`` maps
    each position to one of them.
    """
    block = Block(table, bytes.split)
    at = block.whole(window)
    bucket, low = two_hashes(block.words, window, buckets, _BITS)
    bucket, low = bucket[at], low[at]
    ids = np.array([_NO_ID if i is None else i for i in block.doc_ids], np.int64)
    doc = ids[block.owner[at]] if len(at) else np.empty(0, np.int64)
    order = np.lexsort((doc, low, bucket))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (low[order][1:] != low[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    again = np.lexsort((low[first], doc[first], bucket[first]))
    rank = np.empty(len(first), np.int64)
    rank[again] = np.arange(len(first))
    first = first[again]
    return block, at, doc, rank[number] if len(first) else number, bucket[first], low[first], doc[first]


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(values, prepend=values[:1] - 1, append=values[-1:] + 1)) if len(values) else np.zeros(1, np.int64)


def repeated(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document.

    With ``keep`` the result has these columns of ``docs`` besides, ``text``
    among them or not, and ``kept``: the text left, or the whole text as it is
    where nothing goes.

    Words are runs of anything but ASCII white space and stay unchanged; kept
    words are joined by one space. Missing and empty texts, and texts of fewer
    than ``window`` words, keep everything. A row without ``doc_id`` loses
    nothing that only such rows share, and counts as larger than every id.
    Rows of one ``doc_id`` never remove each other's words. An empty table
    gives no rows; extra columns are ignored.
    """
    carried = {f"_{k}": c for k, c in enumerate(keep or ()) if c != "text"}
    packed, buckets = blocks(docs, keep=carried)
    with_text = keep is not None

    def send(table):
        _, _, _, _, bucket, low, doc = _windows(table, window, buckets)
        cuts = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)) if len(bucket) else []
        name, rows, begin = table.column("block")[0].as_py(), [], 0
        for end in cuts:
            runs = _runs(doc[begin:end])
            holders, sizes = doc[begin:end][runs[:-1]], np.diff(runs)
            hashes = low[begin:end].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8].tobytes()
            rows.append((int(bucket[begin]), name, hashes, planes(np.diff(holders, prepend=0).view(np.uint64), 8), planes(sizes.astype(np.uint64), 4)))
            begin = end
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["bucket", "block", "hashes", "holders", "sizes"])

    def answer(table):
        hashes, docs_, lengths = [], [], []
        for h, d, s in zip(*(table.column(c).to_pylist() for c in ("hashes", "holders", "sizes"))):
            raw = np.frombuffer(h, np.uint8).reshape(-1, _BITS // 8)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, : _BITS // 8] = raw
            hashes.append(full.view("<u8").ravel())
            holders = np.cumsum(from_planes(d, 8).view(np.int64))
            docs_.append(np.repeat(holders, from_planes(s, 4).astype(np.int64)))
            lengths.append(len(raw))
        low, doc = np.concatenate(hashes), np.concatenate(docs_)
        order = np.argsort(low, kind="stable")
        begins = np.flatnonzero(np.diff(low[order], prepend=low[order][:1] ^ np.uint64(1)))
        smallest = np.minimum.reduceat(doc[order], begins)
        later = np.empty(len(low), bool)
        later[order] = doc[order] > np.repeat(smallest, np.diff(np.append(begins, len(low))))
        rows, begin = [], 0
        for block, n in zip(table.column("block").to_pylist(), lengths):
            part = later[begin : begin + n]
            if part.any():
                rows.append((block, planes(np.packbits(part).astype(np.uint64), 1)))
            begin += n
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "reply": pa.array([r[1] for r in rows], pa.binary())})

    def finish(left, right):
        block, at, doc, rank, bucket, low, holder = _windows(left, window, buckets)
        later = np.zeros(len(bucket), bool)
        for b, reply in zip(right.column("bucket").to_pylist(), right.column("reply").to_pylist()):
            begin, end = np.searchsorted(bucket, np.uint64(b)), np.searchsorted(bucket, np.uint64(b), "right")
            later[begin:end] = np.unpackbits(from_planes(reply, 1).astype(np.uint8), count=end - begin).astype(bool)
        hit = later[rank] | (doc > holder[rank]) if len(at) else np.zeros(0, bool)
        edge = np.zeros(len(block.words) + 1, np.int32)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for doc_id, text, begin, n in zip(block.doc_ids, block.texts(), block.begins.tolist(), block.lengths.tolist()):
            removed, parts = int(gone[begin : begin + n].sum()), []
            for segment in segments(text):
                words = segment.split()
                mask = gone[begin : begin + len(words)]
                begin += len(words)
                part = b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if removed else words)
                parts += [part] if part else []
            kept = b" ".join(parts)
            rows.append((doc_id, n, removed, hashlib.sha256(kept).hexdigest(), *([kept if removed else text] if with_text else [])))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
        table = pa.table([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)][: len(names)], names=names)
        if with_text:
            table = table.set_column(4, "kept", table.column("kept").cast(pa.string()))
            for name in carried:
                table = table.append_column(name, left.column(name).take(pa.array(block.order, pa.int64())))
        return table

    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in carried)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text + types
    out = ask(packed, send, "bucket long, block long, hashes binary, holders binary, sizes binary", answer, finish, result)
    own = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    named = [F.col(name).alias(c) for name, c in carried.items() if c not in own]
    return out.select(*own, "kept", *named) if with_text else out
