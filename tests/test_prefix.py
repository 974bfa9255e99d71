"""Running sums and minima in ranges of values, and what is built on them, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import prefix, stats
from phenogrid.operators import metrics, views


def rows_of(spark, seed, n=300, distinct=40):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(distinct) / 7 - 2, rng.randrange(5)) for _ in range(n)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 100])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_and_minima(spark, ranges, by):
    """Groups of equal numbers are as large as ranges here, and some ranges are empty for a group."""
    rows = rows_of(spark, ranges)
    df = spark.createDataFrame(rows, "g string, x double, v long").groupBy("g" if by else F.lit("z").alias("g"), "x").agg(F.sum("v").alias("v"))
    ranged = prefix.in_ranges(df, "x", ranges)
    out = prefix.running_min_from_end(prefix.running_sum(ranged, by, "x", "v", "total"), by, "x", "v", "least").collect()
    assert len(out) == df.count()
    for r in out:
        own = [q for q in out if q.g == r.g]
        assert r.total == sum(q.v for q in own if q.x <= r.x)
        assert r.least == min(q.v for q in own if q.x >= r.x)
    if ranges == 7:
        assert len({r._range for r in out}) > 4


def test_odd_numbers_have_a_range(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.0,), (2.0,)], "x double")
    assert prefix.in_ranges(df, "x", 3).count() == 6
    empty = prefix.in_ranges(df.where("false").withColumn("v", F.lit(1)), "x", 3)
    assert prefix.running_sum(empty, [], "x", "v", "t").count() == 0


def adjust(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, least = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        least = min(least, ps[i] * len(ps) / rank)
        out[i] = least
    return out


@pytest.mark.parametrize("by", [None, ["g"]])
def test_false_discovery_control(spark, by):
    """A third of all tests have p = 1, and others repeat in every group."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), f"f{i}", 1.0 if i % 3 == 0 else rng.choice([0.0001, 0.001, 0.01, 0.02, 0.04, rng.random()])) for i in range(400)]
    tests = spark.createDataFrame(rows, "g string, feature_id string, p_value double")
    found = stats.benjamini_hochberg(tests, by=by)
    got = {r.feature_id: r for r in found.collect()}
    for g in "ab" if by else [None]:
        own = [r for r in rows if g in (None, r[0])]
        for r, adjusted in zip(own, adjust([r[2] for r in own]), strict=True):
            assert got[r[1]].adj_p_value == pytest.approx(adjusted, rel=1e-12)
            assert got[r[1]].significant == (adjusted <= 0.05)
    assert 0 < sum(r.significant for r in got.values()) < len(got)


def test_the_volcano_and_curves_use_no_global_window(spark):
    tests = spark.createDataFrame([(f"f{i}", (i % 5) / 10 + 0.01) for i in range(60)], "feature_id string, adj_p_value double")
    predictions = spark.createDataFrame([("Resistant" if i % 3 else "Susceptible", (i * 7 % 20) / 20, "Resistant" if i % 2 else "Susceptible") for i in range(100)], "phenotype string, pred_resistant double, pred_class string")
    for df in (views.volcano(tests), views.top_variables(tests.withColumnRenamed("adj_p_value", "importance")), metrics.pr_curve(predictions), stats.benjamini_hochberg(tests.withColumnRenamed("adj_p_value", "p_value"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            assert "Window [" not in line or "_range" in line
    labels = {r.feature_id: (r.rank, r.label) for r in views.volcano(tests, 3).collect() if r.label}
    assert labels == {"f0": (1, "f0"), "f10": (2, "f10"), "f15": (3, "f15")}


def test_curves_of_groups_are_those_of_each(spark):
    rows = [("ab"[i % 2], "Resistant" if (i * i) % 3 else "Susceptible", (i * 7 % 13) / 13, "Resistant") for i in range(80)]
    predictions = spark.createDataFrame(rows, "g string, phenotype string, pred_resistant double, pred_class string")
    both = {r.g: r.auprc for r in metrics.pr_auc(predictions, ["g"]).collect()}
    for g in "ab":
        assert metrics.pr_auc(predictions.where(F.col("g") == g)).first().auprc == pytest.approx(both[g], rel=1e-12)


@pytest.mark.parametrize("alternative", stats.ALTERNATIVES)
def test_the_table_of_log_factorials_and_the_series_agree(spark, alternative):
    rng = random.Random(1)
    df = spark.createDataFrame([tuple(rng.randrange(60) for _ in range(4)) for _ in range(200)], "a long, b long, c long, d long")
    args = [F.col(c) for c in "abcd"]
    for r in df.select(stats.fisher_p(*args, alternative, 240).alias("table"), stats.fisher_p(*args, alternative).alias("series")).collect():
        assert r.table == pytest.approx(r.series, abs=1e-8)
