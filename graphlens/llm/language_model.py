"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

The count table holds every n-gram of one to ``ORDER`` words with its number of
occurrences, partitioned by hash. The documents' n-grams are joined to it and
their scores summed per document. A document is scored with the counts of all
*other* documents: its own occurrences are taken off, or every n-gram would have
been seen. Both relations travel as packed rows (:mod:`graphlens.llm.blocks`),
pre-aggregated per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphlens.llm.blocks import Block, ask, blocks, from_planes, planes, two_hashes

ORDER = 3
BACKOFF = 0.4
_BITS, _BYTES = 48, 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def _grams(table: pa.Table, order: int, buckets: int):
    """The block, the end positions of its n-grams per order, and its distinct n-grams by (bucket, hash)."""
    block = Block(table, words)
    ends, bucket, low = [], [], []
    for n in range(1, order + 1):
        at = block.whole(n)
        b, h = two_hashes(block.words, n, buckets, _BITS)
        ends.append(at + n - 1)
        bucket.append(b[at])
        low.append(h[at])
    bucket, low = np.concatenate(bucket), np.concatenate(low)
    if buckets < 2 ** (64 - _BITS):
        keys, number, counts = np.unique(bucket << np.uint64(_BITS) | low, return_inverse=True, return_counts=True)
        return block, ends, number, keys >> np.uint64(_BITS), keys & np.uint64(2**_BITS - 1), counts
    order_ = np.lexsort((low, bucket))
    fresh = np.ones(len(order_), bool)
    fresh[1:] = (low[order_][1:] != low[order_][:-1]) | (bucket[order_][1:] != bucket[order_][:-1])
    number = np.empty(len(order_), np.int64)
    number[order_] = np.cumsum(fresh) - 1
    return block, ends, number, bucket[order_][fresh], low[order_][fresh], np.bincount(number)


def scores(totals: list[np.ndarray], contexts: list[np.ndarray], n_others: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """Natural logarithms of the scores of positions.

    ``totals[k]`` are counts of the (k+1)-gram that ends at each position, -1
    where the document begins later, ``contexts[k]`` those of its first k words;
    ``n_others`` the number of words of the other documents.
    """
    result = np.full(len(n_others), np.nan)
    steps = np.zeros(len(n_others))
    for k in range(len(totals) - 1, -1, -1):
        possible = totals[k] >= 0
        base = contexts[k] if k else n_others
        seen = possible & (totals[k] > 0) & np.isnan(result)
        result[seen] = np.log(totals[k][seen] / base[seen]) + steps[seen] * np.log(backoff)
        steps += possible & np.isnan(result)
    unseen = np.isnan(result)
    result[unseen] = steps[unseen] * np.log(backoff) - np.log(n_others[unseen] + 1)
    return result


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every document.

    A word scores count(n-gram) / count(its first n-1 words) for the longest
    n-gram that other documents have, times ``backoff`` for each shorter step;
    an unseen word takes one step more from 1 / (words of other documents + 1).
    ``log_score`` is the sum of natural logarithms, ``mean_log_score`` its share
    per word. Missing, empty and blank texts have 0 words, score 0 and no mean.
    Rows are documents, whatever their ids: repeated rows support each other.
    An empty table gives no rows; extra columns are ignored.
    """
    packed, buckets = blocks(docs, per_word=order)

    def send(table):
        block, _, _, bucket, low, counts = _grams(table, order, buckets)
        name = table.column("block")[0].as_py()
        rows = [(buckets, name, b"", planes(np.array([len(block.words)], np.uint64), 8))]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
        for begin, end in zip(cuts, cuts[1:]):
            rows.append((int(bucket[begin]), name, planes(np.diff(low[begin:end], prepend=np.uint64(0)), _BYTES), planes(counts[begin:end], 5)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["bucket", "block", "hashes", "counts"])

    def answer(table):
        bucket, names = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        if bucket == buckets:  # the words of the corpus
            total = sum(int(from_planes(c, 8)[0]) for c in table.column("counts").to_pylist())
            replies = [planes(np.array([total], np.uint64), 8)] * len(names)
        else:
            sent = [np.cumsum(from_planes(h, _BYTES), dtype=np.uint64) for h in table.column("hashes").to_pylist()]
            counts = np.concatenate([from_planes(c, 5) for c in table.column("counts").to_pylist()]).astype(np.int64)
            _, number = np.unique(np.concatenate(sent), return_inverse=True)
            total = np.zeros(number.max() + 1, np.int64)
            np.add.at(total, number, counts)
            total, begin, replies = total[number], 0, []
            for s in sent:
                replies.append(planes(total[begin : begin + len(s)], 5))
                begin += len(s)
        return pa.table({"block": pa.array(names, pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int64()), "reply": pa.array(replies, pa.binary())})

    def finish(left, right):
        block, ends, number, bucket, _, _ = _grams(left, order, buckets)
        totals, n_all = np.zeros(len(bucket), np.int64), 0
        for b, reply in zip(right.column("bucket").to_pylist(), right.column("reply").to_pylist()):
            if b == buckets:
                n_all = int(from_planes(reply, 8)[0])
            else:
                begin = np.searchsorted(bucket, np.uint64(b))
                values = from_planes(reply, 5)
                totals[begin : begin + len(values)] = values
        n = len(block.words)
        owner = block.owner
        grams = np.concatenate([owner[e] for e in ends]) if n else np.empty(0, np.int64)
        _, mine, own = np.unique(number * max(1, len(block.doc_ids)) + grams, return_inverse=True, return_counts=True)
        others = totals[number] - own[mine] if n else np.empty(0, np.int64)
        by_end, begin = [], 0
        for e in ends:
            full = np.full(n, -1, np.int64)
            full[e] = others[begin : begin + len(e)]
            by_end.append(full)
            begin += len(e)
        contexts = [None] + [np.append(np.zeros(1, np.int64), c)[:n] for c in by_end[:-1]]  # the shorter n-gram one word earlier
        logs = scores(by_end, contexts, n_all - block.lengths[owner], backoff) if n else np.empty(0)
        sums = np.bincount(owner, logs, len(block.doc_ids))
        lengths = block.lengths.tolist()
        mean = [s / k if k else None for s, k in zip(sums.tolist(), lengths)]
        return pa.table({"doc_id": pa.array(block.doc_ids, pa.int64()), "n_words": pa.array(lengths, pa.int64()), "log_score": pa.array(sums.tolist(), pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    result = "doc_id long, n_words long, log_score double, mean_log_score double"
    return ask(packed, send, "bucket long, block long, hashes binary, counts binary", answer, finish, result)
