"""Groups of observations, their cohorts of genomes, and the gates that decide which get a matrix.

All groups (drugs and drug classes, whole or by stratum) are keys of one plan: each observation is
exploded into the groups that it belongs to, and everything after is an aggregate by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.labels import PHENOTYPES, RESISTANT, STRATA, SUSCEPTIBLE

GROUP = ["group_type", "drug_or_class", "strat_value"]
MIN_TOTAL_OBS = 40


def group_rows(meta: DataFrame, stratify_by: str | None = None) -> DataFrame:
    """(group_type, drug_or_class, strat_value, genome_id, phenotype); strat_value is '' without strata.

    Rows without a group or stratum belong to none.
    """
    if stratify_by not in (None, *STRATA):
        raise ValueError(f"stratify_by must be one of {sorted(STRATA)} or None")
    suffix = "" if stratify_by is None else f"_{stratify_by}"
    strat = F.lit("") if stratify_by is None else F.col(STRATA[stratify_by])
    level = lambda name, c: F.struct(F.lit(name + suffix).alias("group_type"), F.col(c).alias("drug_or_class"))
    rows = meta.select(F.explode(F.array(level("drug", "drug_abbr"), level("drug_class", "class_abbr"))).alias("g"), strat.alias("strat_value"), "genome_id", "phenotype")
    rows = rows.select("g.group_type", "g.drug_or_class", "strat_value", "genome_id", "phenotype").where("drug_or_class is not null and strat_value is not null")
    return rows if stratify_by is None else rows.where("strat_value <> ''")


def cohort(rows: DataFrame) -> DataFrame:
    """One row per group and genome that takes part, with the phenotype it counts as.

    Of a drug: genomes tested resistant or susceptible; with both, the later name in the alphabet
    holds, which is susceptible. Of a class: resistant if any test was, susceptible if all were.
    has_resistant and has_susceptible tell which phenotypes the genome was observed with.
    """
    # By its place among the names: a hash aggregate keeps numbers, but not texts.
    names = sorted(PHENOTYPES)
    tested = F.coalesce(*[F.when(F.col("phenotype") == p, i) for i, p in enumerate(names)])
    by = rows.groupBy(*GROUP, "genome_id").agg(
        F.max(F.when(F.col("phenotype") == RESISTANT, 1).otherwise(0)).alias("has_resistant"),
        F.max(F.when(F.col("phenotype") == SUSCEPTIBLE, 1).otherwise(0)).alias("has_susceptible"),
        F.min(F.when(F.col("phenotype") == SUSCEPTIBLE, 1).otherwise(0)).alias("all_susceptible"),
        F.max(tested).alias("latest"),
    )
    of_class = F.when(F.col("has_resistant") == 1, RESISTANT).when(F.col("all_susceptible") == 1, SUSCEPTIBLE)
    phenotype = F.when(F.col("group_type").startswith("drug_class"), of_class).otherwise(F.get(F.array(*[F.lit(p) for p in names]), F.col("latest")))
    return by.withColumn("phenotype", phenotype).where("phenotype is not null").select(*GROUP, "genome_id", "phenotype", "has_resistant", "has_susceptible")


def genomes_with_all_features(features: DataFrame) -> DataFrame:
    """Genomes that occur in every feature table: one aggregate instead of a chain of intersections.

    Packed genomes (matrix.packed) tell their tables themselves.
    """
    if "cells" in features.columns:
        own = features.select("genome_id", F.col("feature_types").alias("_types"))
        every = own.select(F.explode("_types").alias("_t")).agg(F.countDistinct("_t").alias("kinds"))
        return own.join(F.broadcast(every), F.size("_types") == F.col("kinds")).select("genome_id")
    kinds = features.select(F.countDistinct("feature_type").alias("kinds"))
    per = features.groupBy("genome_id").agg(F.countDistinct("feature_type").alias("n"))
    return per.join(F.broadcast(kinds), per["n"] == kinds["kinds"]).select("genome_id")


def min_samples(res_prop: Column, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0)) -> Column:
    """The least number of samples that leaves each part of each class one; null if a class is empty."""
    rarer = F.least(res_prop, 1 - res_prop)
    if n_fold is not None:
        need = F.ceil(F.lit(float(n_fold)) / rarer)
    else:
        parts = [*split, 1 - sum(split)]
        need = F.ceil(F.lit(1.0) / (rarer * float(min(parts))))
    return F.when(rarer > 0, need)


def gate_report(rows: DataFrame, chosen: DataFrame, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0), least: int = MIN_TOTAL_OBS) -> DataFrame:
    """For each group its counts, and the reason why it gets no matrix, or null if it gets one."""
    census = chosen.groupBy(*GROUP).agg(F.count("*").alias("n_genomes"), F.sum("has_resistant").alias("n_resistant"), F.sum("has_susceptible").alias("n_susceptible"))
    classes = rows.where(F.col("phenotype").isin(*PHENOTYPES)).groupBy(*GROUP).agg(F.countDistinct("phenotype").alias("n_classes"))
    all_groups = rows.select(*GROUP).distinct()
    out = all_groups.join(census, GROUP, "left").join(classes, GROUP, "left").na.fill(0, ["n_genomes", "n_resistant", "n_susceptible", "n_classes"])
    out = out.withColumn("total_obs", F.col("n_resistant") + F.col("n_susceptible"))
    share = F.coalesce(F.try_divide("n_resistant", "total_obs"), F.lit(0.0))
    out = out.withColumn("min_samples", min_samples(share, n_fold, split))
    few = (F.col("total_obs") < least) | F.col("min_samples").isNull() | (F.col("n_genomes") < F.col("min_samples"))
    reason = F.when(few, "Too few samples for CV/split").when(F.col("n_genomes") < least, "Too few observations").when(F.col("n_classes") < 2, "Only one phenotype class")
    return out.withColumn("reason", reason).select(*GROUP, "n_genomes", "n_resistant", "n_susceptible", "total_obs", "n_classes", "min_samples", "reason")


def skip_log(gates: DataFrame) -> DataFrame:
    """(Drug, Reason, Total_obs, Phenotype_distribution) of each group without a matrix."""
    part = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    label = F.concat_ws("_", "drug_or_class", F.when(F.col("strat_value") != "", F.col("strat_value")))
    return gates.where("reason is not null").select(F.col("group_type").alias("group_type"), label.alias("drug"), "reason", F.col("n_genomes").alias("total_obs"), F.concat_ws("; ", part(RESISTANT, "n_resistant"), part(SUSCEPTIBLE, "n_susceptible")).alias("phenotype_distribution"))
