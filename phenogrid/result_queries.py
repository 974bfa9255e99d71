"""Queries over result tables: files under their names, merged again, and genomes scored by stored models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import codec
from phenogrid.operators import importance, scoring, views
from phenogrid.plans import merge, results
from phenogrid.sources import tables
from phenogrid.sources.adapter import ctes, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


# Stand-ins for what a run writes. File names take letters alone for drugs, so digits become letters.
_LETTERS = "translate({c}, '12345', 'ABCDE')"
_DRUG, _TEST = _LETTERS.format(c="drug_or_class"), _LETTERS.format(c="test_drug")
_KIND = "case feature_type when 'genes' then 'gene' when 'proteins' then 'protein' else 'domain' end"
_YEAR = "case {k} % 4 when 0 then '1995-1998' when 1 then '1999-2002' when 2 then '2003-2006' else '2007-2010' end"
_COUNTRY = "case {k} % 3 when 0 then 'AFR' when 1 then 'ASI' else 'EUR' end"


def _run(spark: SparkSession, d: str, source: str, columns: str) -> DataFrame:
    return spark.sql(f"select {columns} from {{t}}", t=relation(spark, d, source))


def _merged(rows: DataFrame, family: str, kind: str, name: str) -> DataFrame:
    """rows exported as files of their family, and merged from these."""
    spark = rows.sparkSession
    folder = tables.shared_path(spark, "files")
    results.export_table(rows, results.FAMILIES[family], kind, "Tpc", folder)
    return merge.build(spark, folder, name).drop("filename")


_PERF = f"{_KIND} as feature_type, feature_subtype as encoding, cast(k % 3 as int) as seed, shuffled, k, mcc"


@query("merged_perf", ctes("perf") + f"select shuffled, species, drug_label, {_DRUG} as drug_or_class, feature_type, feature_subtype, cast(k % 3 as int) as seed, k, mcc from perf")
def merged_perf(spark, d):
    return _merged(_run(spark, d, "perf", f"drug_label as group_type, {_DRUG} as drug_or_class, {_PERF}"), "standard", "performance", "all_perf")


_TOPS = f"{_KIND} as feature_type, feature_subtype as encoding, seed, shuffled, variable, importance, sign"


@query("merged_top_features", ctes("top_features") + f"select shuffled, species, drug_label, {_DRUG} as drug_or_class, feature_type, feature_subtype, seed, variable as Variable, importance as Importance, sign as Sign from top_features")
def merged_top_features(spark, d):
    return _merged(_run(spark, d, "top_features", f"drug_label as group_type, {_DRUG} as drug_or_class, {_TOPS}"), "standard", "top_features", "all_top_features")


@query("merged_year_perf", ctes("perf") + f"select species, drug_label, 'year' as strat_label, {_DRUG} as drug_or_class, {_YEAR.format(k='k')} as strat_value, feature_type, feature_subtype, cast(k % 3 as int) as seed, k, mcc from perf where not shuffled")
def merged_year_perf(spark, d):
    rows = _run(spark, d, "perf", f"'drug_year' as group_type, {_DRUG} as drug_or_class, {_YEAR.format(k='k')} as strat_value, {_PERF}").where("not shuffled")
    return _merged(rows, "year", "performance", "year_perf")


@query("merged_cross_drug_perf", ctes("perf") + f"select species, {_DRUG} as drug, {_TEST} as test_drug, feature_type, feature_subtype, cast(k % 3 as int) as seed, k, mcc from perf")
def merged_cross_drug_perf(spark, d):
    return _merged(_run(spark, d, "perf", f"{_DRUG} as ref_drug, {_TEST} as test_drug, {_PERF}"), "cross_drug", "performance", "cross_drug_perf")


@query("merged_cross_country_perf", ctes("perf") + f"select species, drug_label, {_DRUG} as drug_or_class, {_COUNTRY.format(k='k')} as strat_value, {_COUNTRY.format(k='(k + 1)')} as strat_value_test, feature_type, feature_subtype, cast(k % 3 as int) as seed, k, mcc from perf")
def merged_cross_country_perf(spark, d):
    columns = f"'drug_country' as group_type, {_DRUG} as drug_or_class, {_COUNTRY.format(k='k')} as train_strat, {_COUNTRY.format(k='(k + 1)')} as test_strat, {_PERF}"
    return _merged(_run(spark, d, "perf", columns), "cross_country", "performance", "cross_country_perf")


@query("merged_loo_drug_perf", ctes("perf") + f"select species, {_TEST} as leaveout, feature_type, feature_subtype, cast(k % 3 as int) as seed, k, mcc from perf")
def merged_loo_drug_perf(spark, d):
    return _merged(_run(spark, d, "perf", f"{_TEST} as leaveout, {_PERF}"), "loo_drug", "performance", "LOO_drug_perf")


@query("merged_loo_year_top_features", ctes("top_features") + f"select species, drug_label, {_DRUG} as drug_or_class, {_YEAR.format(k='seed')} as leaveout, feature_type, feature_subtype, variable as Variable, importance as Importance, sign as Sign from top_features")
def merged_loo_year_top_features(spark, d):
    rows = _run(spark, d, "top_features", f"'drug_year' as group_type, {_DRUG} as drug_or_class, {_YEAR.format(k='seed')} as leaveout, {_TOPS}")
    return _merged(rows, "loo_year", "top_features", "LOO_year_top_features")


@query("merged_mdr_pred", ctes("predictions") + "select genome_id, phenotype as resistant_classes, pred_class, pred_resistant, case when cast(genome_id as bigint) % 2 = 0 then 'genes' else 'proteins' end as feature_type, 'binary' as feature_subtype, cast(cast(genome_id as bigint) % 3 as varchar) as seed from predictions")
def merged_mdr_pred(spark, d):
    columns = "case when cast(genome_id as bigint) % 2 = 0 then 'gene' else 'protein' end as feature_type, 'binary' as encoding, cast(genome_id as bigint) % 3 as seed, false as shuffled, genome_id, phenotype, pred_class, pred_resistant"
    return _merged(_run(spark, d, "predictions", columns), "mdr", "pred", "MDR_pred")


# The names themselves, by all eight grammars.

_NAMES = {
    "stratified": f"concat('Tpc_', case when k % 2 = 0 then 'drug' else 'drug_class' end, '_year_', {_DRUG}, '_', {_YEAR.format(k='k')}, '_', feature_type, '_', feature_subtype, '_', cast(k % 3 as string), '_performance.parquet')",
    "cross_drug": f"concat('cross_test_Tpc_drug_', {_DRUG}, '_cross_tested_on_', {_TEST}, '_', feature_type, '_', feature_subtype, '_1_performance.parquet')",
    "cross_year": f"concat('cross_test_Tpc_drug_class_', {_DRUG}, '_cross_', {_YEAR.format(k='k')}, '_tested_on_', {_YEAR.format(k='(k + 1)')}, '_', feature_type, '_', feature_subtype, '_1_performance.parquet')",
    "cross_country": f"concat('shuffled_cross_test_Tpc_drug_', {_DRUG}, '_cross_', {_COUNTRY.format(k='k')}, '_tested_on_', {_COUNTRY.format(k='(k + 1)')}, '_', feature_type, '_', feature_subtype, '_1_performance.parquet')",
    "loo_drug": f"concat('LOO_Tpc_drug_leaveout_', {_DRUG}, '_', feature_type, '_', feature_subtype, '_1_top_features.parquet')",
    "loo_country": f"concat('LOO_Tpc_drug_class_country_', {_DRUG}, '_leaveout_', {_COUNTRY.format(k='k')}, '_', feature_type, '_', feature_subtype, '_1_performance.parquet')",
    "loo_year": f"concat('LOO_Tpc_drug_year_', {_DRUG}, '_leaveout_', {_YEAR.format(k='k')}, '_', feature_type, '_', feature_subtype, '_pca0.95_1_performance.parquet')",
    "mdr": "concat('MDR_resistant_classes_', feature_type, '_', feature_subtype, '_', cast(k % 3 as string), '_prediction.parquet')",
}
_ALL_NAMES = " union all ".join(f"select '{kind}' as kind, {name} as name from {{t}}" for kind, name in _NAMES.items())


#: What each grammar finds in all names, its own and the others', one row for each field that is found.
_FOUND = " union all ".join(
    f"select name, '{kind}' as grammar, '{f}' as field, nullif(regexp_extract(name, '{codec.PATTERNS[kind]}', {i}), '') as value from names" for kind, fields in codec.FIELDS.items() for i, f in enumerate(fields, 1)
)


@query("name_grammars", ctes("perf", more=f"all_names as ({_ALL_NAMES.format(t='perf')}), names as (select distinct name from all_names), found as ({_FOUND})") + "select name, grammar, field, value from found where value is not null")
def name_grammars(spark, d):
    names = spark.sql(_ALL_NAMES, t=relation(spark, d, "perf")).select("name").distinct()
    cells = [F.struct(F.lit(kind).alias("grammar"), F.lit(f).alias("field"), c.alias("value")) for kind, fields in codec.FIELDS.items() for f, c in zip(fields, codec.extract(F.col("name"), kind), strict=True)]
    return names.select("name", F.explode(F.array(*cells)).alias("c")).select("name", "c.*").where("value is not null")


# Scoring by models that are tables: coefficients are made of importances, every genome tested for a drug is scored.

_WEIGHTS = """select drug_or_class, variable, avg(case when sign = 'POS' then importance else -importance end) / 20000 as coefficient, 0.5 as mean, 2.0 as scale
from {t} where feature_type in ('genes', 'proteins') group by drug_or_class, variable"""


@query(
    "model_scores",
    ctes("features", "top_features", more=f"""w as ({_WEIGHTS.format(t='top_features')}),
off as (select drug_or_class, 0.25 - sum(coefficient / scale * mean) as base from w group by 1),
asked as (select distinct drug_abbr as drug_or_class, genome_id from meta_obs where drug_abbr in (select drug_or_class from w)),
s as (select a.drug_or_class, a.genome_id, sum(f.value * w.coefficient / w.scale) as part from asked a join features f using (genome_id) join w on w.drug_or_class = a.drug_or_class and w.variable = f.feature_id group by 1, 2),
z as (select a.drug_or_class, a.genome_id, base + coalesce(part, 0) as z from asked a join off using (drug_or_class) left join s using (drug_or_class, genome_id))""")
    + "select drug_or_class, genome_id, case when z >= 0 then 'Resistant' else 'Susceptible' end as pred_class, round(1 / (1 + exp(-z)), 9) as pred_event from z",
)
def model_scores(spark, d):
    weights = spark.sql(_WEIGHTS, t=relation(spark, d, "top_features"))
    none = lambda kind: F.lit(None).cast(kind)
    of = weights.select("drug_or_class", F.lit(0).alias("level"), F.lit("Resistant").alias("class"), "variable", "coefficient", F.col("mean").cast("double").alias("mean"), F.col("scale").cast("double").alias("scale"), none("double").alias("intercept"))
    level = lambda i, name, intercept: weights.select("drug_or_class").distinct().select("drug_or_class", F.lit(i).alias("level"), F.lit(name).alias("class"), none("string").alias("variable"), none("double").alias("coefficient"), none("double").alias("mean"), none("double").alias("scale"), F.lit(intercept).alias("intercept"))
    models = of.unionByName(level(0, "Resistant", 0.25)).unionByName(level(1, "Susceptible", 0.0))
    members = relation(spark, d, "meta_obs").select(F.col("drug_abbr").alias("drug_or_class"), "genome_id").distinct()
    scored = scoring.score(models, members, relation(spark, d, "features"), ["drug_or_class"])
    return scored.select("drug_or_class", "genome_id", "pred_class", F.round("pred_event", 9).alias("pred_event"))


# Small parts of reports and runs.


@query("tsv_table", ctes("perf") + "select k, drug_or_class, test_drug, feature_type, mcc, case when shuffled then 'true' else 'false' end as shuffled from perf")
def tsv_table(spark, d):
    """A table written as tab-separated text and read again by its path."""
    rows = relation(spark, d, "perf").select("k", "drug_or_class", "test_drug", "feature_type", "mcc", "shuffled")
    path = f"{tables.shared_path(spark, 'tsv')}/perf.tsv"
    tables.write_tsv(rows, path, ["k"])
    return tables.read_table(spark, path).select(F.col("k").cast("long").alias("k"), "drug_or_class", "test_drug", "feature_type", F.col("mcc").cast("double").alias("mcc"), F.col("shuffled").cast("string").alias("shuffled"))


@query("pair_keys", ctes("perf") + "select concat(least(drug_or_class, test_drug), '||', greatest(drug_or_class, test_drug)) as pair, count(*) as n, median(mcc) as median_mcc from perf group by 1")
def pair_keys(spark, d):
    """Results of drugs tested on one another, whichever was trained on."""
    return relation(spark, d, "perf").groupBy(codec.pair_key(F.col("drug_or_class"), F.col("test_drug")).alias("pair")).agg(F.count("*").alias("n"), F.median("mcc").alias("median_mcc"))


@query("removed_features", ctes("features", "top_features", more="gone as (select variable from top_features where feature_type <> 'domains' group by 1 order by max(importance) desc, variable limit 20)") + "select feature_type, feature_id, count(*) as n, sum(value) as total from features where feature_id not in (select variable from gone) group by 1, 2")
def removed_features(spark, d):
    best = relation(spark, d, "top_features").where("feature_type <> 'domains'").groupBy("variable").agg(F.max("importance").alias("importance"))
    gone = best.orderBy(F.desc("importance"), "variable").limit(20).select(F.col("variable").alias("feature_id"))
    return importance.remove_features(relation(spark, d, "features"), gone).groupBy("feature_type", "feature_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("class_levels", ctes("predictions") + "select phenotype as class from predictions union select pred_class from predictions")
def class_levels(spark, d):
    return views.class_levels(relation(spark, d, "predictions"), "phenotype", "pred_class")


@query("heatmap_classes", ctes("perf", "meta_obs", more="used as (select drug_or_class as drug from perf union select test_drug from perf)") + "select distinct class_abbr as class from used join meta_obs on drug = drug_abbr where class_abbr is not null")
def heatmap_classes(spark, d):
    """The classes of either axis of the cross-drug heat map, which share one legend."""
    perf = relation(spark, d, "perf")
    heat = views.cross_drug_heatmap(perf.withColumnRenamed("drug_or_class", "drug"), perf, relation(spark, d, "meta_obs"))
    return views.class_levels(heat, "drug_class", "test_class")


@query("drug_order", ctes("meta_obs", more="t as (select antibiotic, count(distinct genome_id) as n from meta_obs group by 1)") + "select antibiotic, n as \"by\", row_number() over (order by n, antibiotic) as place from t")
def drug_order(spark, d):
    """The drugs of an axis in order of the genomes tested for them."""
    return views.level_order(relation(spark, d, "meta_obs"), "antibiotic", F.countDistinct("genome_id"))
