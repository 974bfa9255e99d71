"""Memberships and sums of a matrix come from its genomes and equal those of its rows."""

from __future__ import annotations

from phenogrid.plans import holdout, matrix
from phenogrid.plans.cohort import GROUP


def test_parts_say_what_rows_say(spark):
    groups = [("drug", d) for d in ("P1", "P2", "P3")]
    members = [(*g, s, f"g{i}", "Resistant" if (i // 3 + k) % 3 else "Susceptible") for k, g in enumerate(groups) for i in range(24) for j, s in enumerate(("a", "b", "c")) if i % 3 == j and (i + k) % 4]
    features = [(t, f"g{i}", f"f{f}", float((i * f) % 4)) for t in ("gene", "struct") for i in range(24) for f in range(4) if (i + f) % 5]
    # A feature's second row is no cell of its own.
    features += [("gene", "g1", "f1", 7.0)]
    m = spark.createDataFrame(members, "group_type string, drug_or_class string, strat_value string, genome_id string, phenotype string")
    f = spark.createDataFrame(features, "feature_type string, genome_id string, feature_id string, value double")
    parts = matrix.matrix_parts(f, m, GROUP, "phenotype")
    rows = matrix.rows_of(*parts, GROUP, "phenotype")
    key = [*holdout.KEY, "strat_value", "genome_id", "phenotype"]
    own = matrix.members_of_parts(*parts, GROUP, "phenotype").select(key)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, holdout.members_of(rows).select(key).collect()))
    by = [*holdout.KEY, "leaveout"]
    membership = holdout.stratum_out_members(own)
    got, want = (holdout.feature_sums(x, membership, "leaveout", by) for x in (parts, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert got.count() > 0
