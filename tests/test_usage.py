"""Quota figures at the borders of rounding."""

import pytest

from graphlens.operators import usage


def test_percent_rounds_halves_up_like_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pairs = [(4500, 1000000), (18500, 1000000), (71500, 1000000), (4499, 1000000), (22000000, 7000000), (0, 3000000), (5, 0)]
    rows = ", ".join(f"({used}L, {limit}L)" for used, limit in pairs)
    quotas = spark.sql(f"SELECT used AS subject, timestamp '2024-02-10' AS expires_at, loc_limit, used FROM VALUES {rows} AS t(used, loc_limit)")
    got = {r["subject"]: r["percent"] for r in usage.usage_report(quotas, "2024-01-31 00:00:00").collect()}
    wanted = duckdb.sql(
        f"SELECT used, CASE WHEN lim > 0 THEN round(used / lim * 100, 1) ELSE 0.0 END FROM (VALUES {rows.replace('L', '')}) t(used, lim)"
    ).fetchall()
    assert got == dict(wanted)
    assert got[4500] == 0.5 and got[4499] == 0.4
