"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def benchmark_hits(docs, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = []
    for item, text in items:
        w = pattern.findall(lower(text or ""))
        if item is not None and w:
            windows += [(str(item), w[i : i + window]) for i in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, found = pattern.findall(lower(text or "")), set(), set()
        for item, p in windows:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def kept_words(docs, window=13):
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in docs]
    out = []
    for doc_id, w in split:
        earlier = {tuple(v[i : i + window]) for d, v in split if d is not None and (doc_id is None or d < doc_id) for i in range(len(v) - window + 1)}
        gone = {i + k for i in range(len(w) - window + 1) if tuple(w[i : i + window]) in earlier for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs, most=4):
    fps = [simhash(t) for _, t in docs]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (fps[i] ^ fps[j]).bit_count() <= most and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for (d, _), k in zip(docs, label):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [(d, f"{f:016x}", least.get(k)) for (d, _), f, k in zip(docs, fps, label)]


def pieces(docs, tokenizer, capacity):
    out = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def backoff(docs, order=3, factor=0.4):
    split = [re.findall("[^\x20\x09-\x0d]+", lower(t or "")) for _, t in docs]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in split]
    total = sum(grams, Counter())
    words = sum(map(len, split))
    out = []
    for (doc_id, _), w, own in zip(docs, split, grams):
        others, logs = words - len(w), 0.0
        for i in range(len(w)):
            steps = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if total[g] > own[g]:
                    base = others if n == 1 else total[g[:-1]] - own[g[:-1]]
                    logs += math.log((total[g] - own[g]) / base) + steps * math.log(factor)
                    break
                steps += 1
            else:
                logs += steps * math.log(factor) - math.log(others + 1)
        out.append((doc_id, len(w), round(logs, 6)))
    return out


def nearest(rows, every=100, k=10):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            clean[i] = min(clean.get(i, v), v)
    out = []
    for q in sorted(clean):
        if q % every == 0:
            found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(clean[q], v))), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))
            out += [(q, r, i, d) for r, (d, i) in enumerate(found[:k], 1)]
    return out
