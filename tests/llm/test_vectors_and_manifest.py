"""Clusters, vector groups and the manifest against plain versions, on nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from graphlens.llm import clustering, manifest, vector_groups

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, q string, id long, m long, dim int, node long"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, position long, block long, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "q", 3, 4, 5, 6) for i, v in rows], VECTORS).repartition(3)


def made_up(dim, groups=9, per_group=22, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    rows = [(g * 100 + k, [float(np.float32(x)) for x in centers[g] + rng.normal(size=dim) * (0.02 if g < 3 else 0.22)]) for g in range(groups) for k in range(per_group)]
    rows += [(2_000 + k, rows[0][1]) for k in range(30)] + [rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1])]
    rows += [(3_000, None), (3_001, [0.0] * dim), (3_002, [math.nan] * dim), (3_003, [None] * dim), (3_004, [math.inf] + [1.0] * (dim - 1)), (3_005, []), (3_006, [1.0, 2.0]), (3_007, [2.0, 4.0]), (None, None)]
    return rows


def plain_clusters(rows, count, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centroids = [q for _, _, q in sorted((digest(i), q, q) for i, q in kept if i is not None)[:count]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        near = [nearest(q)[1] for _, q in kept]
        for k in range(len(centroids)):
            own = [q for (_, q), c in zip(kept, near) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *nearest(q)) for i, q in kept]
    per = Counter()
    for _, d, k in last:
        per[k] += d
    return [(i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in last]


def test_clusters(spark):
    rows = made_up(64)
    found = clustering.clusters(table(spark, rows))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(plain_clusters(rows, 40, 5))
    few = rows[:5]
    assert Counter(map(tuple, clustering.clusters(table(spark, few)).collect())) == Counter(plain_clusters(few, 40, 5))
    assert clustering.clusters(table(spark, [])).count() == 0


def test_search_is_exact_also_for_ties_and_large_components():
    rng = np.random.default_rng(1)
    for high in (3, 300, 2**27):
        rows, centroids = rng.integers(-high, high + 1, (300, 64)), rng.integers(-high, high + 1, (17, 64))
        centroids[9] = centroids[4]
        rows[:20] = centroids[[4, 9] * 10]
        near, far = clustering.search(clustering.transform(rows), clustering.transform(centroids))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]
        assert far.tolist() == [min(x) for x in exact] and near.tolist() == [x.index(min(x)) for x in exact]


def plain_groups(rows, similarity=0.95):
    fit = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    linked = [[j for j, (_, w) in enumerate(rows) if j != i and fit(v) and fit(w) and len(v) == len(w) and vector_groups.cosine(np.array(v), np.array(w)) >= similarity] for i, (_, v) in enumerate(rows)]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(linked[j]), least, rows[j][0] == least)
    return Counter(out)


@pytest.mark.parametrize("interval", [vector_groups.INTERVAL, 12 * 8])
def test_vector_groups(spark, monkeypatch, interval):
    """Also with intervals of 8 vectors and several levels above them, some of which link as a whole."""
    monkeypatch.setattr(vector_groups, "INTERVAL", interval)
    rows = made_up(12)
    found = vector_groups.vector_groups(table(spark, rows))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    expected = plain_groups(rows)
    assert Counter(map(tuple, found.collect())) == expected
    assert max(n for _, n, _, _ in expected) > 30 and len({c for _, _, c, _ in expected}) > 20


def test_vector_groups_of_huge_numbers_and_of_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [-1e300, -1e300]), (4, [5.0, 0.0])]
    assert Counter(map(tuple, vector_groups.vector_groups(spark.createDataFrame(rows, kind)).collect())) == Counter([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)])
    assert vector_groups.vector_groups(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in vector_groups.vector_groups(spark.createDataFrame([(7, None)], kind)).collect()] == [(7, 0, 7, True)]


def plain_manifest(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_source = {}
    for doc_id, text, lang, source, n_chars in docs:
        leaf = lambda t: sha("".join(map(said, (doc_id, source, lang, n_chars, t))))  # noqa: B023, E731
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        by_source.setdefault(source, []).append((doc_id, leaf(text), leaf(text.replace("\n", "") if bad and text is not None else text)))

    def tree(nodes):
        """The root, and for each node its path of (before, after)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            runs = [level[k : k + 3] for k in range(0, len(level), 3)]
            for path, k in zip(paths, at):
                path.append(("".join(runs[k // 3][: k % 3]), "".join(runs[k // 3][k % 3 + 1 :])))
            at, level = [k // 3 for k in at], [sha("".join(r)) for r in runs]
        return level[0], paths

    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    trees = [tree([r[1] for r in by_source[s]]) for s in order]
    root, over = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), above in zip(order, trees, over):
        for (doc_id, leaf, start), path in zip(by_source[s], paths):
            folded = start
            for before, after in path + above:
                folded = sha(before + folded + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(b + a for b, a in path + above)), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("levels", [manifest.LEVELS, 1, 2])
def test_manifest(spark, levels):
    """Also with blocks of 3 and 9 leaves, so that block roots are appended again and again."""
    docs = [(k, f"line {k}\nof {k % 7}\n" if k % 3 else "one", "en" if k % 5 else None, ["a", "b", "b", "b", "é", "Z", ""][k % 7], k if k % 4 else None) for k in range(200)]
    docs += [(7, "line\n", "en", "b", 1), (7, "line\n", "en", "b", 1), (None, "x\ny", "en", "a", 1), (None, None, None, None, None), (300, "", "", None, 0), (301, "漢\n" * 30_000, "ja", "long", 9), (302, None, "en", "b", 2)]
    frame = spark.createDataFrame([(*d, "t", "n", 1, 2, 3) for d in docs], DOCS).repartition(3)
    found = manifest.manifest(frame, levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = Counter(map(tuple, found.collect()))
    assert rows == plain_manifest(docs)
    assert {r[-1] for r in rows} == {True, False}


def test_manifest_of_little(spark):
    frame = lambda docs: spark.createDataFrame([(*d, "t", "n", 1, 2, 3) for d in docs], DOCS)
    assert manifest.manifest(frame([])).count() == 0
    one = [(4, "a\nb", "en", "s", 3)]
    assert Counter(map(tuple, manifest.manifest(frame(one)).collect())) == plain_manifest(one)


def test_witnesses_grow_with_later_appends():
    leaves = [manifest.digest(str(k)) for k in range(23)]
    tree = manifest.Appender()
    grown = []
    for leaf in leaves:
        tree.append(leaf)
        grown.append(len(tree.witnesses[0]))
    assert grown == [0] * 2 + [1] * 6 + [2] * 15
    root = tree.close(manifest.height(len(leaves)))
    assert all(manifest.fold(leaf, w) == root for leaf, w in zip(leaves, tree.witnesses))
