"""Places, ranks and medians against sorting."""

import statistics
from collections import defaultdict

import numpy as np

from quarrykit.operators.ordering import medians, numbered, ranks


def _rows(n=3000):
    rng = np.random.default_rng(2)
    # a value of a third of all rows, ties, nulls, a group of one row and one of nulls only
    return [(i, "ab"[int(rng.integers(0, 2))], None if x > 95 else 7.0 if x < 33 else float(rng.integers(0, 40))) for i, x in enumerate(rng.integers(0, 100, n))] + [(n, "c", 1.5), (n + 1, "d", None), (n + 2, None, 2.0)]


def test_numbered(spark):
    rows = _rows()
    got = {r["i"]: r["place"] for r in numbered(spark.createDataFrame(rows, "i int, g string, v double").where("v is not null"), "v", "i").collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((v, i) for i, _, v in rows if v is not None))}
    assert got == want
    assert numbered(spark.createDataFrame([], "i int, v double"), "v").count() == 0


def test_ranks_and_medians(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "i int, g string, v double")
    by = defaultdict(list)
    for _, g, v in rows:
        if v is not None:
            by[g].append(v)
    got = {(r["g"], r["v"]): (r["n"], r["below"], r["total"]) for r in ranks(df, ["g"], "v").collect()}
    assert got == {(g, x): (v.count(x), sum(y < x for y in v), len(v)) for g, v in by.items() for x in set(v)}
    assert {r["g"]: r["median"] for r in medians(df, ["g"], "v").collect()} == {g: statistics.median(v) for g, v in by.items()}
    assert medians(df.limit(0), ["g"], "v").count() == 0
