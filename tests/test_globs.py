"""Shell patterns whose literal runs are digits meet few names."""

import fnmatch

from pyspark.sql import functions as F

from graphlens.operators import link


def test_long_runs_are_looked_up_by_long_pieces(spark, monkeypatch):
    # Few digits make every three characters common.
    keys = ["".join("12"[i >> b & 1] for b in range(10)) for i in range(1024)]
    names = [f"{p}.{s}.{k}" for k in keys for p, s in (("low", "F"), ("high", "O"))] + ["a.b", "ab", ""]
    patterns = [f"*.[FO].{k}*" for k in keys[::20]] + ["*.F.111111111?", "h*gh*1111111112", "a?b", "*b", "*[.]*1111111121", "low.F.1111111111", "*1212121212*F*"]
    name_rows, pattern_rows = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = {tuple(r) for r in link.glob_matches(name_rows, pattern_rows).select("name", "pattern").collect()}
    assert got == {(n, p) for n in names for p in patterns if fnmatch.fnmatchcase(n, p)}
    monkeypatch.setattr(F, "rlike", lambda text, regex: F.lit(True))
    assert link.glob_matches(name_rows, pattern_rows).count() < 15_000
