"""Vectors at the ends of the range of doubles, training rows of repeated ids."""

import math

import numpy as np
import pytest

from graphlens.llm.toxicity import training_rows
from graphlens.llm.vector_search import Tile, distances, nearest_neighbours, search_cell


def _true(a, b):
    return math.hypot(*(x - y for x, y in zip(a, b)))


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-155, 1.0])
def test_cells_of_any_magnitude(size):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5)) * size
    vectors[40:] = rng.normal(size=(20, 5)) * np.array([1e-170, 1.0, 1e160, 1e200])[np.arange(20) % 4, None]
    ids = np.arange(60)
    found = {}
    for q, i, d in search_cell([Tile(ids[:30], vectors[:30])], [Tile(ids[:25], vectors[:25]), Tile(ids[25:], vectors[25:])], 10):
        found.setdefault(q, []).append((d, i))
    for q in range(30):
        want = sorted((_true(vectors[q], vectors[i]), i) for i in range(60) if i != q)[:10]
        got = sorted(found[q])
        assert [d for d, _ in got] == pytest.approx([d for d, _ in want], rel=1e-9, abs=0)


def test_plain_distances_keep_their_digits():
    rng = np.random.default_rng(4)
    query, rows = rng.normal(size=8), rng.normal(size=(50, 8))
    want = np.zeros(50)
    for k in range(8):
        want += np.square(rows[:, k] - query[k])
    assert (distances(query, rows) == np.sqrt(want)).all()


def test_large_vectors_have_neighbours(spark):
    rows = [(i, [1e200 * (i + 1), 1e200]) for i in range(120)]
    found = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), nearest=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 1), (0, 2, 2), (100, 1, 99), (100, 2, 101)]
    assert all(r["score"] == pytest.approx(1e200 * (2 if (r["query_id"], r["rank"]) == (0, 2) else 1)) for r in found)


def test_training_rows_are_bounded_whatever_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(30) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, rows=5).collect()
    assert len(rows) == 5 == len({r["doc_id"] for r in rows}) and all(r["text"] == f"text {r['doc_id']} 0" for r in rows)
