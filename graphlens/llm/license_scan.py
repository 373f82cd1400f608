"""License scans by patience alignment of texts with license templates.

Words that occur once in the text and once in the template are anchors; the
longest increasing run of anchors is kept, and the gaps between them are
aligned in the same way. Coverage is the share of template words aligned.

A template is short and a text may be long and repeat a notice, so stretches of
the text that begin at a template word and hold enough of them, over twice the
template's length at most, are aligned, and the best of overlapping ones counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import text_bytes

#: Share of template words that makes a notice.
COVERAGE = 0.8
#: Notices that name a license; ``shipped`` adds full texts and headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}


def shipped() -> dict[str, str]:
    """The short notices, and the license texts and headers of the folder ``licenses`` under ``<license>.text`` and ``<license>.header``."""
    files = sorted((f for f in (resources.files("graphlens.llm") / "licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files}


#: A-Z become a-z; ASCII bytes besides letters, digits, full stops and hyphens become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c in b".-" or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(b".-") for x in text.translate(_FOLD).split()) if w]


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, in order on both sides: anchors, then their gaps."""
    pairs, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        chosen = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not chosen:
            continue
        pairs += chosen
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *chosen], [*chosen, (a1, b1)]):
            work.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(pairs)


class Scanner:
    """Templates by their words, and words without which a notice cannot reach the threshold."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words(text.encode()) for name, text in templates.items()}
        # Whoever lacks this many words of a template misses the coverage: one of them must occur. Long words are rare.
        self.wanted = {name: Counter(t) for name, t in self.templates.items()}
        self.needed = {name: set(sorted(t, key=len)[-(int((1 - coverage) * len(t) + 1e-9) + 1) :]) for name, t in self.templates.items()}

    def scan(self, text: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, end word, notices) of every license found: its best notice, the first of equals."""
        counts, out = Counter(text), []
        for name, template in self.templates.items():
            need, wanted = self.coverage * len(template) - 1e-9, self.wanted[name]
            if len(text) < need or self.needed[name].isdisjoint(counts):
                continue
            if sum(min(counts[w], wanted[w]) for w in counts.keys() & wanted.keys()) < need:
                continue
            best, notices = None, 0
            for share, begin, end in self._notices(text, template):
                notices += 1
                if best is None or share > best[0]:
                    best = (share, begin, end)
            if best:
                out.append((name, *best, notices))
        return sorted(out)

    def _notices(self, text, template):
        """Aligned stretches, the best of those that overlap the first that reaches the threshold."""
        wanted, need = Counter(template), self.coverage * len(template) - 1e-9
        at, begin, end, best = [i for i, w in enumerate(text) if w in wanted], 0, 0, None
        held, total = Counter(), 0

        def drop():
            w = text[at[begin]]
            held[w] -= 1
            return held[w] < wanted[w]

        # The stretch of a later beginning ends no earlier, so both ends only move on.
        while begin < len(at):
            if best and (at[begin] >= best[2] or best[0] == 1):
                yield best
                stop, best = bisect_left(at, best[2]), None
                while begin < stop:
                    if begin < end:
                        total -= drop()
                    begin += 1
                end = max(end, begin)
                continue
            while end < len(at) and at[end] < at[begin] + 2 * len(template) and total < len(template):
                w = text[at[end]]
                total += held[w] < wanted[w]
                held[w] += 1
                end += 1
            # No more words than the stretch has of the template can be aligned.
            hopeful = total >= need and (best is None or total / len(template) > best[0])
            pairs = align(text[at[begin] : at[end - 1] + 1], template) if hopeful else []
            if pairs and len(pairs) >= need and (best is None or len(pairs) / len(template) > best[0]):
                best = (len(pairs) / len(template), at[begin] + pairs[0][0], at[begin] + pairs[-1][0] + 1)
            total -= drop()
            begin += 1
        if best:
            yield best


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, first_word, end_word, notices``: one row per document and template, one without license where none is found.

    ``coverage`` is the aligned share of the template's words in the best
    notice, which spans the text's words from ``first_word`` to before
    ``end_word``; ``notices`` counts the regions that reach the threshold.
    Missing and empty texts hold no license. A missing ``doc_id`` stays missing,
    repeated rows give repeated results, an empty table no rows; extra columns
    are ignored. One pass, no shuffle; the templates are a parameter of the job.
    """
    known = dict(shipped() if templates is None else templates)
    if any(not words(t.encode()) for t in known.values()):
        raise ValueError("every template needs words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches):
        scanner = Scanner(known, coverage)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                out += [(doc_id, *found) for found in scanner.scan(words(text)) or [(None, 0.0, None, None, 0)]]
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["doc_id", "license", "coverage", "first_word", "end_word", "notices"])

    return rows.mapInArrow(scan, "doc_id long, license string, coverage double, first_word long, end_word long, notices long")
