"""The tables behind the reports' figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.operators.metrics import top_two_margin


def drug_distribution(meta: DataFrame) -> DataFrame:
    """Genomes by antibiotic and phenotype, and in total."""
    n = meta.select("antibiotic", "drug_abbr", "phenotype", "genome_id").distinct().groupBy("antibiotic", "drug_abbr", "phenotype").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("antibiotic", "drug_abbr")))


def drug_performance(perf: DataFrame, meta: DataFrame) -> DataFrame:
    """Median MCC of each drug's models by kind of feature, with the number of genomes tested."""
    medians = perf.where("not shuffled and drug_label = 'drug'").groupBy("drug_or_class", "feature_type", "feature_subtype").agg(F.median("mcc").alias("median_mcc"))
    totals = meta.groupBy(F.col("drug_abbr").alias("drug_or_class")).agg(F.countDistinct("genome_id").alias("total"))
    return medians.join(totals, "drug_or_class", "left")


def cross_drug_heatmap(cross: DataFrame, perf: DataFrame, meta: DataFrame) -> DataFrame:
    """Median MCC of models trained on one drug and tested on another, the same drug from its own models, with both classes."""
    pairs = cross.where("drug is not null and test_drug is not null").groupBy("drug", "test_drug").agg(F.median("mcc").alias("median_mcc"))
    drugs = cross.select(F.col("drug").alias("drug_or_class")).distinct()
    own = perf.where("drug_label = 'drug'").join(drugs, "drug_or_class", "left_semi").groupBy(F.col("drug_or_class").alias("drug")).agg(F.median("mcc").alias("median_mcc")).select("drug", F.col("drug").alias("test_drug"), "median_mcc")
    classes = meta.select("drug_abbr", "class_abbr").distinct()
    of = lambda c, name: classes.select(F.col("drug_abbr").alias(c), F.col("class_abbr").alias(name))
    return pairs.unionByName(own).join(of("drug", "drug_class"), "drug", "left").join(of("test_drug", "test_class"), "test_drug", "left").select("drug", "test_drug", "median_mcc", "drug_class", "test_class")


def heatmap_matrix(heatmap: DataFrame) -> DataFrame:
    """The heat map with a column for each test drug: a small table, so a pivot will do."""
    return heatmap.groupBy("drug_class", "drug").pivot("test_drug").agg(F.first("median_mcc")).orderBy("drug_class", "drug")


def stratified_performance(perf: DataFrame, cross: DataFrame) -> DataFrame:
    """Results within a stratum and across strata, told apart by category."""
    columns = ["drug_label", "drug_or_class", "strat_value", "strat_value_test", "feature_type", "feature_subtype", "mcc"]
    rows = perf.withColumn("strat_value_test", F.col("strat_value")).select(*columns).unionByName(cross.select(*columns))
    return rows.withColumn("category", F.when(F.col("strat_value") == F.col("strat_value_test"), "same").otherwise("different"))


def mdr_margins(probabilities: DataFrame, classes: Column) -> DataFrame:
    """probabilities with the margin between the two likeliest classes."""
    return probabilities.withColumn("margin", top_two_margin(classes))


def mdr_prediction_share(predictions: DataFrame) -> DataFrame:
    """By true and predicted class and feature type: mean margin, count, and share of the true class."""
    n = predictions.groupBy("truth", "feature_type", "estimate").agg(F.avg("margin").alias("mean_margin"), F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth", "feature_type")))


def class_levels(predictions: DataFrame, truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    """(class): all classes that occur as true or predicted ones."""
    return predictions.select(F.explode(F.array(truth, estimate)).alias("class")).where("class is not null").distinct()


def level_order(rows: DataFrame, level: str, of: Column) -> DataFrame:
    """(level, by, place): the levels of a figure's axis in ascending order of an aggregate, names breaking ties; one row for each level."""
    totals = rows.where(F.col(level).isNotNull()).groupBy(level).agg(of.alias("by"))
    everything = totals.agg(F.array_sort(F.collect_list(F.struct("by", level))).alias("_all"))
    return totals.crossJoin(F.broadcast(everything)).select(level, "by", F.array_position("_all", F.struct("by", level)).alias("place"))


def shuffle_vs_real(perf: DataFrame) -> DataFrame:
    """What a box plot of real and shuffled runs shows."""
    label = F.when(F.col("shuffled"), "shuffled").otherwise("real").alias("run")
    return perf.groupBy("drug_or_class", label).agg(F.count("mcc").alias("n"), F.median("mcc").alias("median_mcc"), F.min("mcc").alias("min_mcc"), F.max("mcc").alias("max_mcc"))


def baseline_comparison(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Balanced accuracy of models and baselines side by side, by antibiotic."""
    return model.select("antibiotic", F.col("bal_acc").alias("model")).join(baseline.select("antibiotic", F.col("bal_acc").alias("baseline")), "antibiotic", "full")


def volcano(tests: DataFrame, label_top_n: int = 10) -> DataFrame:
    """Tests with -log10 of the adjusted p value, and rank and label of the first by it, names breaking ties."""
    first = tests.orderBy("adj_p_value", "feature_id").limit(label_top_n).agg(F.collect_list(F.struct("adj_p_value", "feature_id")).alias("_rows"))
    # One row of as many names as get a label.
    place = F.array_position(F.transform(F.array_sort("_rows"), lambda r: r["feature_id"]), F.col("feature_id"))
    ranked = tests.crossJoin(F.broadcast(first)).withColumn("rank", F.when(place > 0, place)).drop("_rows")
    # Spark's log of 0 is null; a p value too small for its digits lies above all others.
    height = F.when(F.col("adj_p_value") == 0, float("inf")).otherwise(-F.log10("adj_p_value"))
    return ranked.withColumn("neg_log10", height).withColumn("label", F.when(F.col("rank").isNotNull(), F.col("feature_id")))


def top_variables(top: DataFrame, n: int = 10) -> DataFrame:
    """The n most important variables, and any that tie with the last; equal ones have equal ranks."""
    first = top.where("importance is not null").orderBy(F.desc("importance")).limit(n).agg(F.collect_list("importance").alias("_first"))
    kept = top.crossJoin(F.broadcast(first)).where(F.col("importance") >= F.array_min("_first"))
    return kept.withColumn("rank", F.size(F.filter("_first", lambda x: x > F.col("importance"))) + 1).drop("_first")


def top_clusters(top: DataFrame, clusters: DataFrame, names: DataFrame, top_n: int = 10) -> DataFrame:
    """The clusters that contribute most to each drug and feature type, and how many types share them."""
    run = Window.partitionBy("drug_or_class", "feature_type", "feature_subtype", "seed").orderBy(F.desc("importance"), "variable", "sign")
    best = top.where("not shuffled and feature_type <> 'struct' and drug_label = 'drug'").withColumn("_k", F.row_number().over(run)).where(F.col("_k") <= top_n)
    name = F.regexp_replace(F.regexp_replace("variable", ".NCBIFAM", ""), "^X", "")
    name = F.when(F.col("feature_type") == "domains", F.regexp_replace(name, "_.*", "")).when(F.col("feature_type") == "proteins", F.regexp_replace(name, "fig.", "fig|")).otherwise(name)
    best = best.withColumn("variable", name).join(clusters.withColumnRenamed("feature", "variable"), "variable", "left").withColumn("cluster", F.coalesce("cluster", "variable"))
    share = best.groupBy("drug_or_class", "feature_type", "cluster").agg(F.median("importance").alias("abs_imp"))
    kind = Window.partitionBy("drug_or_class", "feature_type")
    share = share.withColumn("contribution", F.col("abs_imp") / F.sum("abs_imp").over(kind))
    share = share.withColumn("_k", F.row_number().over(kind.orderBy(F.desc("contribution"), "cluster"))).where(F.col("_k") <= top_n).drop("_k")
    share = share.withColumn("n_feat_types", F.count("*").over(Window.partitionBy("drug_or_class", "cluster")))
    short = F.when(F.length("protein_name") > 50, F.concat(F.substring("protein_name", 1, 47), F.lit("..."))).otherwise(F.col("protein_name"))
    return share.join(names.select(F.col("protein_id").alias("cluster"), short.alias("protein_name")), "cluster", "left")
