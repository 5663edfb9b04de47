"""Joins with hot keys equal plain joins."""

import numpy as np
import pytest

from quarrykit.operators.skew import lookup


@pytest.mark.parametrize("floor", [1, 1000, 10_000])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup(spark, how, floor):
    rng = np.random.default_rng(1)
    key = [None if x > 990 else "hot" if x < 400 else f"k{x}" for x in rng.integers(0, 1000, 5000).tolist()]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(key)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("k500", 2), ("k501", 3), ("k501", 4), ("absent", 5)], "k string, v int")
    got = sorted(map(tuple, lookup(rows, table, ["k"], how, floor).select("i", "k", *(["v"] if how in ("inner", "left") else [])).collect()), key=str)
    want = sorted(map(tuple, rows.join(table, ["k"], how).select("i", "k", *(["v"] if how in ("inner", "left") else [])).collect()), key=str)
    # a hot or null key that meets nothing is kept or dropped as in a plain join
    assert got == want
    assert lookup(rows.limit(0), table, ["k"], how, floor).count() == 0
