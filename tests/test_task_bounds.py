"""What a task of the matrix queries holds stays the same as tables grow."""

from __future__ import annotations

import os

from phenogrid.plans import cohort, matrix
from phenogrid.sources import adapter


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_have_more_parts_for_more_rows(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    small = "/root/testdata/sf0.001"
    try:
        for f in os.listdir(small):
            if f.endswith(".parquet") and f != "orders.parquet":
                os.symlink(f"{small}/{f}", tmp_path / f)
        orders = spark.read.parquet(f"{small}/orders.parquet")
        orders.crossJoin(spark.range(200).select()).write.parquet(str(tmp_path / "orders.parquet"))
        adapter.relation(spark, str(tmp_path), "meta_obs")
        assert int(spark.conf.get(name)) >= 200 * orders.count() // 40_000
    finally:
        spark.conf.set(name, before)


def test_cohort_sorts_no_rows(spark):
    rows = spark.createDataFrame([("drug", "d", "", f"g{i // 2}", p) for i, p in enumerate(["Susceptible", "Resistant", "Other", "Resistant", "Other", None])], "group_type string, drug_or_class string, strat_value string, genome_id string, phenotype string")
    own = cohort.cohort(rows)
    assert "SortAggregate" not in _plan(own)
    assert {(r.genome_id, r.phenotype) for r in own.collect()} == {("g0", "Susceptible"), ("g1", "Resistant")}


def test_cells_are_not_sorted_to_meet_their_jobs(spark):
    features = spark.createDataFrame([("gene", f"g{i}", "f", float(i)) for i in range(9)], "feature_type string, genome_id string, feature_id string, value double")
    jobs = spark.createDataFrame([("d", f"g{i}") for i in range(6)], "drug string, genome_id string")
    study = matrix.with_jobs(matrix.packed(features), jobs)
    assert "SortMergeJoin" not in _plan(study)
    assert study.count() == 6
