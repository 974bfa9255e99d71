"""Fisher's tests of several groups in one plan."""

from __future__ import annotations

from phenogrid.functions import stats


def test_each_group_equals_its_own_run(spark):
    rows = [("P1", f"{i}", "Resistant" if i % 2 else "Susceptible") for i in range(12)] + [("P2", f"{i}", "Resistant" if i < 5 else "Susceptible") for i in range(4, 15)]
    genomes = spark.createDataFrame(rows, "drug string, genome_id string, phenotype string")
    features = spark.createDataFrame([(f"{i}", f"f{k}", float(i % (k + 2) == 0)) for i in range(15) for k in range(4)], "genome_id string, feature_id string, value double")
    got = stats.run_fishers(features, genomes, by=["drug"])
    for drug in ("P1", "P2"):
        one = stats.run_fishers(features, genomes.where(f"drug = '{drug}'").drop("drug"))
        assert sorted(map(tuple, got.where(f"drug = '{drug}'").drop("drug").select(one.columns).collect())) == sorted(map(tuple, one.collect()))
    assert got.count() == 8
