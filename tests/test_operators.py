from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.functions import codec, stats, validate
from phenogrid.operators import importance, metrics, model, views
from phenogrid.plans import cohort, holdout, matrix, merge, runs
from phenogrid.sources import tables

LONG = "genome_id string, feature_id string, value double, phenotype string"


# Exact tests.


def fisher_fixture(spark):
    rows = [(f"g{i}", "Resistant" if i < 4 else "Susceptible") for i in range(8)]
    cells = [(g, "feat_good", 1.0 if p == "Resistant" else 0.0) for g, p in rows] + [(g, "feat_bad", float(i % 2)) for i, (g, _) in enumerate(rows)]
    return spark.createDataFrame(cells, "genome_id string, feature_id string, value double"), spark.createDataFrame(rows, "genome_id string, phenotype string")


def test_fisher_p_values(spark):
    got = {r.feature_id: r for r in stats.run_fishers(*fisher_fixture(spark)).collect()}
    assert got["feat_good"].p_value == pytest.approx(1 / 35, abs=1e-9) and got["feat_bad"].p_value == pytest.approx(1.0)
    assert got["feat_good"].freq_resistant == 1 and got["feat_good"].freq_susceptible == 0


@pytest.mark.parametrize("alternative", stats.ALTERNATIVES)
def test_fisher_against_enumeration(spark, alternative):
    rng = random.Random(1)
    tables_ = [tuple(rng.randint(0, 12) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(tables_, "a long, b long, c long, d long").withColumn("p", stats.fisher_p(*[F.col(x) for x in "abcd"], alternative))

    def plain(a, b, c, d):
        m, n, k = a + b, c + d, a + c
        p = {x: math.comb(m, x) * math.comb(n, k - x) / math.comb(m + n, k) for x in range(max(0, k - n), min(k, m) + 1)}
        pick = {"two.sided": lambda x: p[x] <= p[a] * (1 + 1e-7), "greater": lambda x: x >= a, "less": lambda x: x <= a}[alternative]
        return min(1.0, sum(v for x, v in p.items() if pick(x)))

    for r in df.collect():
        assert r.p == pytest.approx(plain(r.a, r.b, r.c, r.d), abs=1e-9)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.01), ("c", 0.04), ("d", 0.2), ("e", 0.5)], "feature_id string, p_value double")
    got = {r.feature_id: (round(r.adj_p_value, 6), r.significant) for r in stats.benjamini_hochberg(df).collect()}
    assert got == {"a": (0.005, True), "b": (0.025, True), "c": (0.066667, False), "d": (0.25, False), "e": (0.5, False)}


# Metrics.


def test_metrics_of_one_class_are_null(spark):
    df = spark.createDataFrame([("g", "Resistant", "Resistant", 0.9)], "genome_id string, phenotype string, pred_class string, pred_resistant double")
    r = metrics.class_metrics(df).first()
    assert r.sens == 1 and r.spec is None and r.bal_acc is None and r.mcc is None


def test_area_starts_at_full_precision(spark):
    df = spark.createDataFrame([("Resistant", 0.9), ("Susceptible", 0.9), ("Resistant", 0.2), ("Susceptible", 0.1)], "phenotype string, pred_resistant double")
    # (0, 1) -> (0.5, 0.5) -> (1, 2/3) -> (1, 0.5)
    assert metrics.pr_auc(df).first().auprc == pytest.approx(0.5 * 0.75 + 0.5 * (0.5 + 2 / 3) / 2)


@pytest.mark.parametrize(("prior", "word"), [(0.5, "balanced"), (0.9, "imbalanced")])
def test_warnings_of_balance(prior, word):
    with pytest.warns(UserWarning, match=word):
        metrics.warn_of_balance(prior)


def test_two_class_mcc_agrees_with_many_class(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["Resistant", "Susceptible"]), rng.choice(["Resistant", "Susceptible"])) for _ in range(80)]
    df = spark.createDataFrame(rows, "phenotype string, pred_class string")
    assert metrics.class_metrics(df).first().mcc == pytest.approx(metrics.mcc_multiclass(df).first().mcc)


# Cohorts and gates.


def test_min_samples():
    assert validate.calculate_min_samples(0.5, 5) == 10
    assert validate.calculate_min_samples(0.5, 5, smallest_n_obs=3) == 30
    assert validate.calculate_min_samples(0.25, 5) == 20
    assert validate.calculate_min_samples(0.0, 5) == math.inf
    assert validate.calculate_min_samples(0.5, None, (0.6, 0.2)) == 10


def test_conflicting_phenotypes(spark):
    meta = spark.createDataFrame([("g", "AMP", "BL", "Resistant"), ("g", "AMP", "BL", "Susceptible"), ("h", "AMP", "BL", "Susceptible"), ("h", "CIP", "BL", "Intermediate"), ("i", None, None, "Resistant")], "genome_id string, drug_abbr string, class_abbr string, phenotype string")
    got = {(r.group_type, r.drug_or_class, r.genome_id): r.phenotype for r in cohort.cohort(cohort.group_rows(meta)).collect()}
    assert got == {("drug", "AMP", "g"): "Susceptible", ("drug", "AMP", "h"): "Susceptible", ("drug_class", "BL", "g"): "Resistant"}


def test_features_must_vary_and_struct_is_presence(spark):
    f = spark.createDataFrame([("gene", "g", "a", 2.0), ("gene", "h", "a", 1.0), ("gene", "g", "b", 1.0), ("gene", "h", "b", 0.0), ("struct", "g", "s", 1.0), ("struct", "h", "s", 0.0)], "feature_type string, genome_id string, feature_id string, value double")
    members = spark.createDataFrame([("g", "Resistant"), ("h", "Susceptible")], "genome_id string, phenotype string")
    got = {(r.feature_type, r.encoding, r.feature_id) for r in matrix.long_matrix(f, members, [], "phenotype").collect()}
    assert got == {("gene", "counts", "a"), ("gene", "counts", "b"), ("gene", "binary", "b"), ("struct", "binary", "s")}


def test_cross_drug_loo_is_refused():
    with pytest.raises(NotImplementedError, match="not supported yet"):
        holdout.loo_drug_cross_jobs()


# Models.


def signal(spark, n=30, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(2 * n):
        p = "Resistant" if i < n else "Susceptible"
        for f in range(5):
            chance = 0.5 if f > 2 else 0.85 if p == "Resistant" else 0.15
            rows.append((f"g{i:03}", f"feat_{'inf' if f < 3 else 'noise'}_{f}", float(rng.random() < chance), p))
    return spark.createDataFrame(rows, LONG).withColumn("job", F.lit("j"))


def test_fit_finds_signal_and_shuffled_labels_do_not_change_counts(spark):
    long = signal(spark)
    settings = runs.Settings(grid=model.tuning_grid([0.001, 0.01, 0.1], [0.0, 0.5, 1.0]))
    members = runs.assign(long, ["job"], "phenotype", settings)
    fits = runs.fit(long, ["job"], settings, members=members).persist()
    row = runs.performance(fits, ["job"], settings, members).first()
    assert row.nmcc > 0.6 and row.n_feat == 5 and row.num_obs == 60 and row.n_fold == 5
    top = [r.variable for r in importance.top_features(model.feature_importances(fits, ["job"]), ["job"], n_top_feats=3).orderBy("rank").collect()]
    assert sum("inf" in v for v in top) >= 2
    signs = {r.variable: r.sign for r in model.feature_importances(fits, ["job"]).collect()}
    assert all(s == "POS" for v, s in signs.items() if "inf" in v and v in top[:2])
    padded = importance.pad_with_unused(model.feature_importances(fits, ["job"]).where("variable like '%inf_0'"), long, 3, 1)
    assert padded.count() == 3
    members.unpersist()
    plain = long.select("job", "genome_id", "phenotype").distinct()
    once, again = (sorted((r.genome_id, r.phenotype) for r in model.shuffle_labels(plain, ["job"]).collect()) for _ in range(2))
    assert once == again and [p for _, p in once] != [r.phenotype for r in plain.orderBy("genome_id").collect()]
    assert sorted(p for _, p in once) == sorted(r.phenotype for r in plain.collect())


def test_splits_are_stratified_and_disjoint(spark):
    members = spark.createDataFrame([(str(i), "Resistant" if i % 4 == 0 else "Susceptible") for i in range(200)], "genome_id string, phenotype string").withColumn("job", F.lit("j"))
    got = {(r.split, r.phenotype): r["count"] for r in model.split_genomes(members, ["job"], split=(0.6, 0.2), n_fold=None).groupBy("split", "phenotype").count().collect()}
    assert got == {("train", "Resistant"): 30, ("val", "Resistant"): 10, ("test", "Resistant"): 10, ("train", "Susceptible"): 90, ("val", "Susceptible"): 30, ("test", "Susceptible"): 30}
    folds = model.split_genomes(members, ["job"]).where("split = 'train'").groupBy("fold").count().collect()
    assert len(folds) == 5 and all(r["count"] == 32 for r in folds)


def test_paths_solve_the_objective():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=200) > 0).astype(int)
    hot = np.eye(2)[1 - y]
    for lam, mixture in ((0.05, 0.0), (0.05, 0.5), (0.02, 1.0)):
        b, b0, settled = model.fit_path(x, hot, [lam], mixture, rounds=5000, tolerance=1e-10)[0]
        p = 1 / (1 + np.exp(-(x @ b + b0)))
        slope = x.T @ (p - hot[:, :1]) / len(x) + lam * (1 - mixture) * b
        live = b != 0
        assert np.abs(slope[live] + lam * mixture * np.sign(b[live])).max() < 1e-5
        assert (np.abs(slope[~live]) <= lam * mixture + 1e-6).all() and abs((p - hot[:, :1]).mean()) < 1e-6


def test_components_reach_the_threshold():
    x = np.random.default_rng(1).normal(size=(30, 80))
    scale = model.Scaler(x, True, 0.9)
    z = scale(x)
    assert z.shape[1] < 30 and np.allclose(z.std(axis=0, ddof=1), 1, atol=1e-6)


def test_three_classes(spark):
    rng = random.Random(2)
    rows = [(f"g{i}", f"feat_{f}", float(f % 3 == i % 3 or rng.random() < 0.2), "ABC"[i % 3], "j") for i in range(60) for f in range(8)]
    long = spark.createDataFrame(rows, "genome_id string, feature_id string, value double, resistant_classes string, job string")
    settings = runs.Settings(grid=[(0.01, 0.5)])
    members = runs.assign(long, ["job"], "resistant_classes", settings)
    fits = runs.fit(long, ["job"], settings, "resistant_classes", members)
    assert runs.performance(fits, ["job"], settings, members, "resistant_classes").first().mcc > 0.6
    wide = model.class_importances(fits, ["job"])
    assert {"A", "B", "C"} <= set(wide.columns)


def test_failed_jobs_are_rows(spark):
    long = spark.createDataFrame([("g", "f", 1.0, "Resistant", "j"), ("h", "f", 0.0, "Resistant", "j")], LONG + ", job string")
    assert [r.kind for r in runs.fit(long, ["job"], runs.Settings(grid=[(0.1, 0.0)])).collect()] == ["failed"]


def test_elimination(spark):
    got = runs.iterative_elimination(signal(spark).drop("job"), runs.Settings(grid=[(0.01, 0.0)]), [20, 60]).orderBy("step").collect()
    assert [r.n_feat for r in got] == [5, 4, 2] and got[0].nmcc > got[-1].nmcc
    with pytest.raises(ValueError, match="no features"):
        runs.iterative_elimination(signal(spark).drop("job"), runs.Settings(grid=[(0.01, 0.0)]), [0.0001], by_vi=True)


def test_runs_can_be_repeated_and_resumed(spark, tmp_path):
    out, settings = f"{tmp_path}/ML", runs.Settings(n_fold=3, grid=[(0.01, 0.5)])
    long = signal(spark).unionByName(signal(spark, seed=1).withColumn("job", F.lit("k")))
    read = lambda name: sorted(str(r.asDict()) for r in tables.read_result(spark, f"{out}_{name}").drop("run_time_sec").select(sorted(c for c in tables.read_result(spark, f"{out}_{name}").columns if c != "run_time_sec")).collect())
    runs.run_models(long.where("job = 'j'"), ["job"], out, settings)
    runs.run_models(long, ["job"], out, settings, resume=True)
    resumed = [read("performance"), read("pred"), read("top_features")]
    runs.run_models(long, ["job"], out, settings)
    assert [read("performance"), read("pred"), read("top_features")] == resumed
    assert len(resumed[0]) == 2 and len(resumed[1]) == 24


def test_selection_needs_a_rule(spark):
    with pytest.raises(ValueError):
        importance.top_features(spark.createDataFrame([], "variable string, importance double"), [], None, None)


# Names.


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Csp_drug_AMX_genes_binary_42_top_features.parquet", (False, "drug", "AMX", 42)),
        ("shuffled_Csp_drug_AMX_genes_binary_42_performance.parquet", (True, "drug", "AMX", 42)),
        ("Csp_drug_class_BETA_genes_counts_7_performance.parquet", (False, "drug_class", "BETA", 7)),
        ("Csp_drug_AMX_genes_binary_pca0.99_42_performance.parquet", (False, "drug", "AMX", 42)),
    ],
)
def test_names(spark, name, want):
    p = codec.parse_result_name(name)
    assert (p["shuffled"], p["drug_label"], p["drug_or_class"], p["seed"]) == want
    r = spark.createDataFrame([(name,)], "name string").select(*codec.standard_fields(F.col("name"))).first()
    assert r.asDict() == p


def test_stratified_names_are_refused_by_the_standard_parser(spark):
    with pytest.raises(ValueError, match="year"):
        codec.parse_result_name("Csp_drug_year_AMX_2010-2015_genes_binary_42_performance.parquet")
    name = "Csp_drug_class_country_AMINOGLYCOSIDES_USA_genes_binary_7_performance.parquet"
    r = spark.createDataFrame([(name,)], "name string").select(*codec.extract(F.col("name"), "stratified")).first()
    assert (r.drug_label, r.strat_label, r.drug_or_class, r.strat_value) == ("drug_class", "country", "AMINOGLYCOSIDES", "USA")


def test_species_codes(spark):
    df = spark.createDataFrame([("Shigella flexneri",), ("Campylobacter",)], "n string")
    assert [r[0] for r in df.select(codec.species_code(F.col("n"))).collect()] == ["Sfl", "Csp"]


# Sources.


def test_discovery_and_parameters(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("g", "a", 1.0)], "genome_id string, gene string, value double").write.parquet(f"{d}/gene_count.parquet")
    with pytest.raises(FileNotFoundError, match="metadata parquet not found"):
        tables.read_metadata(spark, d)
    spark.createDataFrame([("g", "Resistant")], "`genome.genome_id` string, `genome_drug.resistant_phenotype` string").write.parquet(f"{d}/metadata.parquet")
    assert tables.read_metadata(spark, d).columns == ["genome_id", "phenotype"]
    assert tables.read_features(spark, d).first().feature_type == "gene"
    spark.createDataFrame([("g", 1.0)], "genome_id string, value double").write.parquet(f"{d}/odd_count.parquet")
    with pytest.raises(ValueError, match="exactly one id column"):
        tables.feature_tables(spark, d)
    tables.write_parameters(spark, f"{d}/run", 5, (1, 0), 1)
    assert tables.read_parameters(spark, f"{d}/run/matrix")["n_fold"] == 5
    tables.write_parameters(spark, f"{d}/run2", None, (0.6, 0.2), 1)
    assert tables.read_parameters(spark, f"{d}/run2")["mode"] == "splits"


def test_merging_results(spark, tmp_path):
    d = str(tmp_path)
    for seed in (1, 2):
        spark.createDataFrame([(0.5 * seed,)], "mcc double").toPandas().to_parquet(_made(f"{d}/ML_performance/Csp_drug_AMX_genes_binary_{seed}_performance.parquet"))
    spark.createDataFrame([(0.1,)], "mcc double").toPandas().to_parquet(_made(f"{d}/LOO_ML_performance/LOO_Csp_drug_leaveout_AMP_genes_binary_1_performance.parquet"))
    assert merge.merge_results(spark, d, f"{d}/out") == ["all_perf", "LOO_drug_perf"]
    got = {(r.seed, r.mcc, r.drug_or_class) for r in spark.read.parquet(f"{d}/out/all_perf.parquet").collect()}
    assert got == {(1, 0.5, "AMX"), (2, 1.0, "AMX")}
    assert spark.read.parquet(f"{d}/out/LOO_drug_perf.parquet").first().leaveout == "AMP"


def _made(path):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def test_whole_run(spark, tmp_path):
    """From files to merged tables on a small study of two drugs."""
    rng = random.Random(5)
    d = str(tmp_path)
    meta, gene = [], []
    for i in range(90):
        for drug in ("AMP", "CIP"):
            if rng.random() < 0.75:
                meta.append((f"g{i}", "Resistant" if i % 2 else "Susceptible", drug, drug, "BL", str(2000 + i % 3), "USA", "BL" if i % 2 else "Susceptible"))
        for f in range(6):
            gene.append((f"g{i}", f"f{f}", float(rng.random() < (0.8 if i % 2 and f < 3 else 0.3))))
    spark.createDataFrame(meta, "`genome.genome_id` string, `genome_drug.resistant_phenotype` string, `genome_drug.antibiotic` string, drug_abbr string, class_abbr string, year_bin string, country_abbr string, resistant_classes string").write.parquet(f"{d}/in/metadata.parquet")
    spark.createDataFrame(gene, "genome_id string, gene string, value double").write.parquet(f"{d}/in/gene_count.parquet")
    runs.generate_inputs(spark, f"{d}/in", f"{d}/out", n_fold=3)
    settings = runs.Settings(n_fold=3, grid=[(0.01, 0.5)])
    runs.run_family(spark, f"{d}/out", settings)
    perf = spark.read.parquet(f"{d}/out/ML_performance")
    assert {(r.group_type, r.drug_or_class, r.encoding) for r in perf.collect()} == {("drug", "AMP", "binary"), ("drug", "CIP", "binary"), ("drug_class", "BL", "binary"), ("drug", "AMP", "counts"), ("drug", "CIP", "counts"), ("drug_class", "BL", "counts")}
    assert runs.unfinished(tables.read_matrix(spark, f"{d}/out/matrix").select(*runs.JOB).distinct(), perf, runs.JOB, settings.seed).count() == 0
    runs.run_cross(spark, f"{d}/out", settings)
    assert spark.read.parquet(f"{d}/out/cross_test_ML_performance").count() == tables.read_matrix(spark, f"{d}/out/cross_drug_test").select("feature_type", "encoding", "ref_drug", "test_drug").distinct().count()
    runs.run_mdr(spark, f"{d}/out", settings)
    assert spark.read.parquet(f"{d}/out/MDR_ML_performance").count() == 2


# Argument checks.


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (validate.check_seed, 1, "x"), (validate.check_n_fold, 2, 1), (validate.check_n_fold, 5, 2.5), (validate.check_split, (1, 0), (0.8, 0)), (validate.check_split, (0.6, 0.2), (0.6, 0.4)),
        (validate.check_res_prop, 0.5, 1.5), (validate.check_smallest_n_obs, 1, 0), (validate.check_pca_threshold, 0.95, 2), (validate.check_model, "LR", "RF"), (validate.check_penalties, [0.1], [-1]),
        (validate.check_mixtures, [0, 1], [1.1]), (validate.check_metric, "mcc", "auc"), (validate.check_predicted, ["pred_class"], ["x"]), (validate.check_n_top_feats, 3, 0),
        (validate.check_prop_vi, (0, 1), (1, 0)), (validate.check_percent_removal, [10, 20], [20, 10]), (validate.target_of, ["phenotype"], ["phenotype", "resistant_classes"]), (validate.check_path, "/tmp", "/no/such/path"),
    ],
)
def test_argument_checks(check, good, bad):
    check(good)
    with pytest.raises(ValueError):
        check(bad)


def test_modes():
    assert validate.check_mode((1, 0), 5) == "cv" and validate.check_mode((0.6, 0.2), None) == "splits"
    for split, n_fold in (((1, 0), None), ((0.6, 0.2), 5)):
        with pytest.raises(ValueError):
            validate.check_mode(split, n_fold)
    assert validate.normalise_split(0) == (1, 0)


@pytest.mark.parametrize(("options", "want"), [({}, ("matrix", "ML")), ({"stratify_by": "year"}, ("matrix_year", "ML_year")), ({"loo": True}, ("LOO_matrix_drug", "LOO_ML")), ({"loo": True, "stratify_by": "country"}, ("LOO_matrix_country", "LOO_ML_country")), ({"cross_test": True}, ("cross_drug_test", "cross_test_ML")), ({"mdr": True}, ("MDR_matrix", "MDR_ML"))])
def test_folders(options, want):
    assert runs.result_folder("p", **options) == (f"p/{want[0]}", f"p/{want[1]}")


def test_views(spark):
    top = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "variable string, importance double")
    assert {r.variable for r in views.top_variables(top, 2).collect()} == {"a", "b", "c"}
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.5)], "feature_id string, adj_p_value double")
    assert {r.feature_id: (round(r.neg_log10, 3), r.label) for r in views.volcano(tests, 1).collect()} == {"a": (2.0, "a"), "b": (0.301, None)}
