"""Suppression by pointer doubling against the sequential rule."""

import datetime
import random

from graphlens.streaming.rollups import suppress_batch

START = datetime.datetime(2024, 3, 1)
DAY = datetime.timedelta(hours=24)


def frame(spark, rows):
    return spark.createDataFrame(rows, "subject string, trigger string, sent_at timestamp")


def sequential(rows):
    out, last = [], {}
    for subject, trigger, at in sorted({r for r in rows if r[2] is not None}, key=lambda r: r[2]):
        if (subject, trigger) not in last or at - last[subject, trigger] > DAY:
            last[subject, trigger] = at
            out.append((subject, trigger, at))
    return sorted(out, key=str)


def accepted(df, **options):
    return sorted((tuple(r) for r in suppress_batch(df, **options).collect()), key=str)


def test_random_times_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = []
    for subject in ("a", "b", None):
        for trigger in ("x", None):
            for _ in range(150):
                rows.append((subject, trigger, START + datetime.timedelta(minutes=rng.randrange(0, 60 * 24 * 25))))
    assert accepted(frame(spark, rows)) == sequential(rows)


def test_exact_distances_ties_and_rows_without_time(spark):
    us = datetime.timedelta(microseconds=1)
    rows = [("a", "x", START), ("a", "x", START), ("a", "x", START + DAY), ("a", "x", START + DAY + us), ("a", "x", START + 2 * DAY + us),
            ("a", "x", START + 2 * DAY + 2 * us), ("a", "x", None), ("b", "x", None), ("b", "y", datetime.datetime(1969, 12, 31, 23, 59)), ("b", "y", START)]
    assert accepted(frame(spark, rows)) == sequential(rows)
    assert accepted(frame(spark, [])) == []


def test_one_hot_key_over_many_days_needs_few_rounds(spark):
    """A third of all rows share a key whose run lasts 90 days without a pause."""
    rows = [("hot", "x", START + datetime.timedelta(minutes=17 * i)) for i in range(90 * 85)]
    rows += [(f"s{i % 900}", "x", START + datetime.timedelta(minutes=37 * i)) for i in range(2 * len(rows))]
    out = accepted(frame(spark, rows))
    assert out == sequential(rows)
    assert sum(r[0] == "hot" for r in out) == 90


def test_windows_are_bounded_by_slots(spark):
    """No window over whole keys reads events: only slots of a key meet there."""
    rows = [("a", "x", START + datetime.timedelta(hours=i)) for i in range(60)]
    assert accepted(frame(spark, rows), slot_minutes=60) == accepted(frame(spark, rows), slot_minutes=1) == sequential(rows)
