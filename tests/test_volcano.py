"""Adjusted p values of 0 have a place in the volcano's table."""

from __future__ import annotations

import math

from phenogrid.operators import views


def test_zero_lies_above_all_others(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.0), ("c", 1.0), ("d", None)], "feature_id string, adj_p_value double")
    got = {r.feature_id: r.neg_log10 for r in views.volcano(tests).collect()}
    assert got["b"] == math.inf and got["a"] == 2.0 and got["c"] == 0.0 and got["d"] is None
