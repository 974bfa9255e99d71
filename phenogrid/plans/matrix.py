"""Long matrices (genome, feature, value, target) for all groups in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.labels import RESISTANT
from phenogrid.plans.cohort import GROUP, cohort, gate_report, genomes_with_all_features, group_rows
from phenogrid.sources import tables

JOB = [*GROUP, "feature_type", "encoding"]


def encode(features: DataFrame, encodings: tuple[str, ...] = ("counts", "binary")) -> DataFrame:
    """A row for each feature row and encoding; struct features are presence alone."""
    present = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    both = [F.struct(F.lit(e).alias("encoding"), (F.col("value").cast("double") if e == "counts" else present).alias("value")) for e in encodings]
    rows = features.select("feature_type", "genome_id", "feature_id", F.explode(F.array(*both)).alias("e"))
    return rows.select("feature_type", "genome_id", "feature_id", "e.encoding", "e.value").where("feature_type <> 'struct' or encoding = 'binary'")


def gates(meta: DataFrame, features: DataFrame, stratify_by: str | None = None, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0)) -> tuple[DataFrame, DataFrame]:
    """(cohorts of all groups: genomes in every feature table, with phenotypes; the gate report of the groups)."""
    rows = group_rows(meta, stratify_by)
    chosen = tables.written(cohort(rows).join(genomes_with_all_features(features), "genome_id", "left_semi"), "cohort")
    return chosen, gate_report(rows, chosen, n_fold, split)


def kept_cohort(meta: DataFrame, features: DataFrame, stratify_by: str | None = None, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0)) -> DataFrame:
    """The cohorts of the groups that pass the gates."""
    chosen, report = gates(meta, features, stratify_by, n_fold, split)
    passed = report.where("reason is null").select(*GROUP)
    return chosen.join(passed, GROUP, "left_semi").select(*GROUP, "genome_id", "phenotype")


def varying_features(rows: DataFrame, by: list[str]) -> DataFrame:
    """The features of each group whose values differ over the rows there are (population variance above zero).

    Least and greatest are combined before the shuffle, and differ exactly if the variance isn't zero.
    """
    return rows.groupBy(*by, "feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*by, "feature_id")


def _present(value: str) -> Column:
    return F.when(F.col(value) > 0, 1.0).otherwise(0.0)


#: Genomes of a task that packs them, and varying features of all groups that every task may hold.
TASK_GENOMES, BROADCAST_FEATURES = 4000, 1_000_000


def packed(features: DataFrame, genomes: int | None = None) -> DataFrame:
    """(genome_id, cells, feature_types): a row for each genome with all that its features say, written once.

    cells are (feature_type, feature_id, lo, value, lo_b): least and greatest value of the rows of a feature, and whether
    all are present. Feature rows are shuffled here alone; groups are joined to genomes from then on, however many
    they are in. genomes: how many there are about, which keeps what a task holds the same as tables grow.
    """
    if "cells" in features.columns:
        return features
    tables.bound_tasks(features.sparkSession)
    parts = [] if genomes is None else [max(1 + genomes // TASK_GENOMES, int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")))]
    rows = features.select("genome_id", "feature_type", "feature_id", "value").repartition(*parts, "genome_id")
    cells = rows.groupBy("genome_id", "feature_type", "feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("value"), F.min(_present("value")).alias("lo_b"))
    rows = cells.groupBy("genome_id").agg(F.collect_list(F.struct("feature_type", "feature_id", "lo", "value", "lo_b")).alias("cells"))
    return tables.written(rows.withColumn("feature_types", F.array_distinct("cells.feature_type")), "genomes")


def with_jobs(genomes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(genome_id, cells, jobs): each packed genome that has rows in `jobs`, with those rows."""
    columns = [c for c in jobs.columns if c != "genome_id"]
    own = jobs.groupBy("genome_id").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("jobs"))
    # Jobs are hashed and cells go by: a sort would hold a task's cells.
    return genomes.select("genome_id", "cells").join(own.hint("shuffle_hash"), "genome_id")


def job_cells(study: DataFrame) -> DataFrame:
    """(genome_id, a job's columns, a cell's): no row of it is shuffled yet."""
    return study.select("genome_id", "cells", F.explode("jobs").alias("_j")).select("genome_id", "_j.*", F.explode("cells").alias("_c")).select("*", "_c.*").drop("_c")


def job_sums(study: DataFrame, *sums: Column) -> DataFrame:
    """(_p1, _p2, a job's columns, feature_type, feature_id, sums) of the cells of the genomes that have one and the same jobs.

    What genomes of the same jobs say is summed up before it goes to each of these jobs. Two hashes stand for them.
    """
    keys = ["_p1", "_p2"]
    own = study.withColumn("_p1", F.xxhash64("jobs")).withColumn("_p2", F.xxhash64(F.lit(1), "jobs"))
    part = own.select(*keys, F.explode("cells").alias("_c")).select(*keys, "_c.*").groupBy(*keys, "feature_type", "feature_id").agg(*sums)
    jobs = own.groupBy(*keys).agg(F.first("jobs").alias("jobs"))
    return part.join(jobs, keys).select(*part.columns, F.explode("jobs").alias("_j"))


def spread(study: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature_id, lo, hi, lo_b, hi_b) over the rows of all jobs."""
    rows = job_sums(study, F.min("lo").alias("lo"), F.max("value").alias("value"), F.min("lo_b").alias("lo_b")).select("feature_type", "feature_id", "lo", "value", "lo_b", "_j.*")
    return rows.groupBy(*by, "feature_id").agg(F.min("lo").alias("lo"), F.max("value").alias("hi"), F.min("lo_b").alias("lo_b"), F.max(_present("value")).alias("hi_b"))


def matrix_parts(features: DataFrame, members: DataFrame, group: list[str], target: str, encodings: tuple[str, ...] = ("counts", "binary")) -> tuple[DataFrame, DataFrame]:
    """(study, varying): what all rows of a long matrix come from without a shuffle.

    study is with_jobs() of the members; varying (group, feature_type, feature_id, _encodings) tells the encodings in which a
    feature varies within a group. Both are written.
    """
    by = [*group, "feature_type"]
    study = tables.written(with_jobs(packed(features), members.select("genome_id", *group, target)), "study")
    own = {"counts": (F.col("lo") != F.col("hi")) & (F.col("feature_type") != "struct"), "binary": F.col("lo_b") != F.col("hi_b")}
    wanted = F.array_compact(F.array(*[F.when(own[e], F.lit(e)) for e in encodings]))
    return study, tables.written(spread(study, by).select(*by, "feature_id", wanted.alias("_encodings")).where(F.size("_encodings") > 0), "varying")


def small(varying: DataFrame) -> DataFrame:
    """varying, handed to every task unless there are too many features."""
    return F.broadcast(varying) if varying.count() <= BROADCAST_FEATURES else varying


def coded_value() -> Column:
    return F.when(F.col("encoding") == "counts", F.col("value").cast("double")).otherwise(_present("value"))


def long_matrix(features: DataFrame, members: DataFrame, group: list[str], target: str, encodings: tuple[str, ...] = ("counts", "binary")) -> DataFrame:
    """members: (group..., genome_id, target). Features that don't vary within a group are left out.

    The gates have been applied to members before. Which encodings of a feature vary is settled by one aggregate
    over the genomes' rows as they are, and a row is encoded after all shuffles.
    """
    return rows_of(*matrix_parts(features, members, group, target, encodings), group, target)


def rows_of(study: DataFrame, varying: DataFrame, group: list[str], target: str) -> DataFrame:
    """The rows of matrix_parts()."""
    by = [*group, "feature_type"]
    coded = job_cells(study).join(small(varying), [*by, "feature_id"]).select(*by, "genome_id", "feature_id", "value", target, F.explode("_encodings").alias("encoding"))
    return coded.select(*by, "encoding", "genome_id", "feature_id", coded_value().alias("value"), target)


def members_of_parts(study: DataFrame, varying: DataFrame, group: list[str], target: str) -> DataFrame:
    """(group, feature_type, encoding, genome_id, target): the genomes of each matrix, from sets of features, without its rows."""
    sets = varying.groupBy(*group, "feature_type").agg(*[F.collect_set(F.when(F.array_contains("_encodings", e), F.col("feature_id"))).alias(e) for e in ("counts", "binary")])
    kinds = sets.groupBy(*group).agg(F.collect_list(F.struct("feature_type", "counts", "binary")).alias("_kinds"))
    jobs = study.select("genome_id", "cells", F.explode("jobs").alias("_j")).select("genome_id", "cells", "_j.*")
    found = jobs.join(F.broadcast(kinds), group) if group else jobs.crossJoin(F.broadcast(kinds))
    each = found.select(*group, "genome_id", target, "cells", F.explode("_kinds").alias("_k"))
    own = F.transform(F.filter("cells", lambda c: c["feature_type"] == F.col("_k.feature_type")), lambda c: c["feature_id"])
    each = each.select(*group, "genome_id", target, "_k.*", own.alias("_own"))
    held = F.array_compact(F.array(*[F.when(F.arrays_overlap("_own", e), F.lit(e)) for e in ("counts", "binary")]))
    return each.select(*group, "feature_type", F.explode(held).alias("encoding"), "genome_id", target)


def drug_parts(meta: DataFrame, features: DataFrame, stratify_by: str | None = None, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0), encodings: tuple[str, ...] = ("counts", "binary")) -> tuple[DataFrame, DataFrame]:
    features = packed(features)
    return matrix_parts(features, kept_cohort(meta, features, stratify_by, n_fold, split), GROUP, "phenotype", encodings)


def drug_matrices(meta: DataFrame, features: DataFrame, stratify_by: str | None = None, n_fold: int | None = 5, split: tuple[float, ...] = (1, 0), encodings: tuple[str, ...] = ("counts", "binary")) -> DataFrame:
    return rows_of(*drug_parts(meta, features, stratify_by, n_fold, split, encodings), GROUP, "phenotype")


def class_proportion(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, num_obs, res_prop): genomes of each group, and the share of resistant ones to two places."""
    share = F.avg(F.when(F.col("phenotype") == RESISTANT, 1.0).otherwise(0.0))
    return members.groupBy(*by).agg(F.count("*").alias("num_obs"), F.bround(share, 2).alias("res_prop"))


def mdr_classes(classes: DataFrame, min_n: int = 25) -> DataFrame:
    """(resistant_classes, n): combinations of at least min_n genomes, but for intermediate ones."""
    counts = classes.select("genome_id", "resistant_classes").distinct().groupBy("resistant_classes").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= min_n) & (F.col("resistant_classes") != "Intermediate"))


def mdr_matrix(classes: DataFrame, features: DataFrame, min_n: int = 25, encodings: tuple[str, ...] = ("counts", "binary")) -> DataFrame:
    members = classes.select("genome_id", "resistant_classes").distinct().join(mdr_classes(classes, min_n), "resistant_classes", "left_semi")
    return long_matrix(features, members, [], "resistant_classes", encodings)
