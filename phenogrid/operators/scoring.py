"""Fitted models as tables, and scoring of genomes by joins with them.

A model is rows: one for each class with its place and intercept, and one for each class and feature
whose coefficient isn't 0, with the mean and scale that its values were centred and scaled by. Of two
classes the second has intercept 0 and no features. Genomes that were never seen in training are scored
by a join on features and a sum; no matrix is built, and a genome without a row for a feature has 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["level", "class", "variable", "coefficient", "mean", "scale", "intercept"]


def model_table(results: DataFrame, by: list[str]) -> DataFrame:
    """The models among the rows of fit_jobs()."""
    return results.where("kind in ('level', 'weight')").select(*by, *COLUMNS)


def score(models: DataFrame, members: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, genome_id, pred_class, pred_event, probabilities) of the genomes that each job is to score.

    members: (by, genome_id). cells: (genome_id, feature_id, value) and those columns of `by` that its rows
    depend on. pred_event is the probability of a model's first class, probabilities maps classes to theirs.
    Genomes of a job without a model are left out.
    """
    levels = models.where("variable is null").select(*by, "level", "class", "intercept")
    weights = models.where("variable is not null").select(*by, "level", F.col("variable").alias("feature_id"), (F.col("coefficient") / F.col("scale")).alias("_w"), "mean")
    shift = weights.groupBy(*by, "level").agg(F.sum(F.col("_w") * F.col("mean")).alias("_shift"))
    base = levels.join(shift, [*by, "level"], "left").select(*by, "level", "class", (F.col("intercept") - F.coalesce("_shift", F.lit(0.0))).alias("_base"))
    asked = members.select(*by, "genome_id").distinct()
    own = [c for c in by if c in cells.columns]
    filled = cells.where("value <> 0").select(*own, "genome_id", "feature_id", "value")
    # Cells are shared between jobs until here; each job then takes those of its genomes and features.
    parts = filled.join(asked, [*own, "genome_id"]).join(weights.drop("mean"), [*by, "feature_id"])
    sums = parts.groupBy(*by, "genome_id", "level").agg(F.sum(F.col("value") * F.col("_w")).alias("_sum"))
    scored = asked.join(base, by).join(sums, [*by, "genome_id", "level"], "left").withColumn("_z", F.col("_base") + F.coalesce("_sum", F.lit(0.0)))
    # A row for each class is all that a genome has here.
    rows = scored.groupBy(*by, "genome_id").agg(F.array_sort(F.collect_list(F.struct("level", "class", "_z"))).alias("_rows"))
    most = F.array_max(F.transform("_rows", lambda r: r["_z"]))
    rows = rows.withColumn("_most", most).withColumn("_e", F.transform("_rows", lambda r: F.exp(r["_z"] - F.col("_most"))))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("_p", F.transform("_e", lambda x: x / total))
    first = F.element_at(F.filter("_rows", lambda r: r["_z"] == F.col("_most")), 1)["class"]
    return rows.select(*by, "genome_id", first.alias("pred_class"), F.element_at("_p", 1).alias("pred_event"), F.map_from_arrays(F.transform("_rows", lambda r: r["class"]), F.col("_p")).alias("probabilities"))
