"""Rescoring of features over runs: ranks, contributions, clusters and a robustness score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["species", "drug_label", "drug_or_class", "feature_type", "feature_subtype", "seed"]


def clean_variable(feature_type: Column, variable: Column) -> Column:
    """A variable's name as cluster maps have it: domains without their suffix, proteins with their bar, args without a leading X."""
    return (
        F.when(feature_type == "domains", F.regexp_replace(variable, "_.*$", ""))
        .when(feature_type == "proteins", F.regexp_replace(variable, r"^(.*?)fig\.", r"$1fig|"))
        .when(feature_type == "args", F.regexp_replace(variable, "^X", ""))
        .otherwise(variable)
    )


def feature_improvement(top: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each row of top with its rank, contribution and rescaled importance in its run, and medians of ranks
    by feature, scale, and cluster. clusters: (feature, cluster)."""
    rows = top.withColumn("variable", clean_variable(F.col("feature_type"), F.col("variable")))
    run = ["drug_label", "drug_or_class", "feature_type", "feature_subtype", "seed"]
    w = Window.partitionBy(*run)
    low, high, total = F.min("importance").over(w), F.max("importance").over(w), F.sum("importance").over(w)
    rows = rows.withColumn("rank", F.dense_rank().over(w.orderBy(F.desc("importance")))).withColumn("contribution", F.when(total > 0, F.col("importance") / total).otherwise(0.0)).withColumn("rescaled", F.when(high - low > 0, (F.col("importance") - low) / (high - low)).otherwise(0.0))

    def median(of: str, name: str, by: list[str]) -> None:
        nonlocal rows
        rows = rows.withColumn(name, F.median(of).over(Window.partitionBy(*by)))

    where = ["drug_label", "drug_or_class"]
    median("rank", "median_datatype", [*where, "feature_type", "feature_subtype", "variable"])
    median("median_datatype", "median_scale", [*where, "feature_type", "shuffled", "variable"])
    rows = rows.join(clusters.select(F.col("feature").alias("variable"), "cluster"), "variable", "left")
    median("rank", "median_drug_or_class", [*where, "shuffled", "cluster"])
    c = Window.partitionBy(*where, "shuffled", "cluster")
    kinds = F.array_sort(F.collect_set("feature_type").over(c))
    rows = rows.withColumn("count_scales_for_cluster", F.size(kinds).cast("long")).withColumn("feature_types_csv", F.array_join(kinds, ",")).withColumn("lowest_contri", F.min("contribution").over(c)).withColumn("highest_contri", F.max("contribution").over(c))
    median("median_drug_or_class", "median_cluster", [*where, "cluster"])
    # Windows take no distinct counts, so these come by an aggregate.
    keys = [*where, "cluster"]
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct("variable").alias("count_features_for_cluster"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(counts, on).drop(*[f"_{k}" for k in keys])


def ranked_features(top: DataFrame) -> DataFrame:
    """Per feature over seeds: how it ranks, how steadily, and its sign."""
    w = Window.partitionBy(*RUN, "shuffled")
    rows = top.withColumn("contribution", F.try_divide("importance", F.sum("importance").over(w)))
    rows = rows.withColumn("rank", F.dense_rank().over(w.orderBy(F.desc("contribution")))).withColumn("n_features", F.count("*").over(w))
    rows = rows.withColumn("rank_score", F.when(F.col("n_features") > 1, (F.col("n_features") - F.col("rank")) / (F.col("n_features") - 1)).otherwise(1.0))
    key = ["species", "drug_label", "drug_or_class", "feature_type", "feature_subtype", "variable", "shuffled"]
    return rows.groupBy(*key).agg(
        F.countDistinct("seed").alias("n_seeds"), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.avg("rank_score").alias("mean_rank_score"), F.min("rank").alias("best_rank"),
        (F.min("rank") == F.max("rank")).alias("rank_consistent"), F.stddev_samp("rank").alias("rank_sd"), F.try_divide(F.stddev_samp("rank_score"), F.avg("rank_score")).alias("rank_score_cv"),
        F.when(F.min("sign") == F.max("sign"), F.min("sign")).otherwise("mixed").alias("sign"), F.median("contribution").alias("contribution"),
    )


def _percent_rank(of: Column, by: list[str], among: Column) -> Column:
    """percent_rank over the rows where `among` holds, null elsewhere."""
    flag = F.when(among, 1).otherwise(0)
    return F.when(among, F.percent_rank().over(Window.partitionBy(*by, flag).orderBy(of)))


def feature_score(top: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster its contribution, stability, scale and shuffle scores, and their product."""
    group = ["species", "drug_label", "drug_or_class"]
    capability = top.groupBy("feature_type").agg(F.countDistinct("feature_subtype").alias("expected_types"))
    rows = ranked_features(top).withColumn("variable", clean_variable(F.col("feature_type"), F.col("variable"))).join(clusters.select(F.col("feature").alias("variable"), "cluster"), "variable", "left").where("cluster is not null")
    real = rows.where("not shuffled")
    scales = real.groupBy(*group, "cluster", "feature_type").agg(F.countDistinct("feature_subtype").alias("observed_types")).join(capability, "feature_type")
    full, part = F.col("observed_types") == F.col("expected_types"), F.col("observed_types") < F.col("expected_types")
    summary = scales.groupBy(*group, "cluster").agg(F.count("*").alias("n_scales"), F.sum(F.when(full, 1).otherwise(0)).alias("full"), F.sum(F.when(part, 1).otherwise(0)).alias("part"))
    most = summary.agg(F.max("n_scales").alias("most"))
    summary = summary.crossJoin(F.broadcast(most)).withColumn("scale_factor", (F.col("full") + 0.5 * F.col("part")) / (F.col("full") + F.col("part")) * F.col("n_scales") / F.col("most")).select(*group, "cluster", "n_scales", "scale_factor")
    mean = lambda shuffled: F.avg(F.when(F.col("shuffled") == F.lit(shuffled), F.col("mean_rank")))
    delta = rows.groupBy(*group, "cluster").agg(mean(False).alias("own"), mean(True).alias("chance")).withColumn("delta_rank", F.col("chance") - F.col("own"))
    improved = F.coalesce(F.col("chance"), F.lit(float("inf"))) - F.col("own")
    delta = delta.select(*group, "cluster", "delta_rank", F.coalesce(F.col("own").isNotNull() & (improved > 0), F.lit(False)).alias("good_feature"))
    out = real.groupBy(*group, "cluster").agg(F.median("contribution").alias("median_contribution"), F.median("mean_rank").alias("median_rank")).join(summary, [*group, "cluster"], "left").join(delta, [*group, "cluster"], "left")
    d = F.col("delta_rank")
    out = out.withColumn("contrib_score", _percent_rank(F.col("median_contribution"), group, F.col("median_contribution").isNotNull()))
    out = out.withColumn("stability_score", 1 - _percent_rank(F.col("median_rank"), group, F.col("median_rank").isNotNull()))
    up, away = _percent_rank(d, group, d.isNotNull()), _percent_rank(F.abs(d), group, d.isNotNull())
    # A cluster that never shows among shuffled runs has no delta: the strongest case.
    out = out.withColumn("delta_score", F.when(d.isNull(), 1.0).when(d > 0, up).when(d == 0, 0.0).otherwise(-away))
    return out.withColumn("robustness_score", F.col("contrib_score") * F.col("stability_score") * F.col("scale_factor") * F.col("delta_score"))
