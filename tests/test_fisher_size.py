"""Fisher's test of large tables costs what its spread is, not what its counts are."""

from __future__ import annotations

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import stats


def _exact(a, b, c, d, alternative):
    m, n, k = a + b, c + d, a + c
    weights = {x: math.comb(m, x) * math.comb(n, k - x) for x in range(max(0, k - n), min(k, m) + 1)}
    far = {"greater": lambda x: x >= a, "less": lambda x: x <= a, "two.sided": lambda x: weights[x] * 10**7 <= weights[a] * (10**7 + 1)}[alternative]
    return float(Fraction(sum(w for x, w in weights.items() if far(x)), sum(weights.values())))


@pytest.mark.parametrize("alternative", stats.ALTERNATIVES)
def test_tables_whose_range_is_far_wider_than_their_spread(spark, alternative):
    # With a range of millions of tables, an array of all of them would need gigabytes.
    large = [(3_000_000, 5_000_000, 3_001_000, 4_999_000), (2_000_000, 1, 5, 2_000_000), (0, 0, 0, 0), (900, 4_000_000, 1000, 3_999_000)]
    small = [(3, 1, 1, 3), (0, 9, 4, 2), (40, 10, 12, 70), (150, 2, 3, 180), (1, 0, 0, 0)]
    df = spark.createDataFrame(large + small, "a long, b long, c long, d long").withColumn("p", stats.fisher_p(*[F.col(x) for x in "abcd"], alternative))
    got = {tuple(r)[:4]: r.p for r in df.collect()}
    for t in small:
        assert got[t] == pytest.approx(_exact(*t, alternative), rel=1e-9)
    z = (3_000_000 - 3_000_500 + (0.5 if alternative != "greater" else -0.5)) / math.sqrt(8e6 * 8e6 * 6_001_000 * 9_999_000 / 16e6**3)
    normal = {"less": 0.5 * math.erfc(-z / math.sqrt(2)), "greater": 0.5 * math.erfc(z / math.sqrt(2)), "two.sided": math.erfc(-z / math.sqrt(2))}[alternative]
    assert got[large[0]] == pytest.approx(normal, rel=1e-3)
    assert got[large[1]] == (1.0 if alternative == "less" else 0.0)
    assert got[large[2]] == 1.0
    assert all(0 <= p <= 1 for p in got.values())
