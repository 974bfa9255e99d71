"""Exact tests and false-discovery control."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import prefix
from phenogrid.labels import PHENOTYPES, RESISTANT
from phenogrid.plans import matrix
from phenogrid.sources import tables

ALTERNATIVES = ("two.sided", "greater", "less")


def _with_totals(per: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    return per.join(totals, by) if by else per.crossJoin(F.broadcast(totals))


def _present(features: DataFrame, genomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature_id, a, c): resistant and susceptible genomes that have a feature, of packed genomes (matrix.packed)."""
    study = tables.written(matrix.with_jobs(features, genomes), "study")
    rows = matrix.job_sums(study, F.count(F.when(F.col("value") > 0, 1)).alias("n")).select("feature_type", "feature_id", "n", "_j.*")
    of = lambda is_r: F.sum(F.when((F.col("phenotype") == RESISTANT) == F.lit(is_r), F.col("n")).otherwise(0))
    return rows.groupBy(*by, "feature_id").agg(of(True).alias("a"), of(False).alias("c"))


def contingency(features: DataFrame, genomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, feature_id, a, b, c, d): present and absent among resistant, present and absent among susceptible.

    genomes: (genome_id, phenotype) and columns of `by`, one row each of a group, both phenotypes alone. Features
    are long, the same for all groups, and may have columns of `by` that genomes haven't (a type); a genome without a row for a feature hasn't it. Values other than zero and one
    are left out of the table.
    """
    by = by or []
    own = [c for c in by if c in genomes.columns]
    totals = genomes.groupBy(*own).agg(F.sum(F.when(F.col("phenotype") == RESISTANT, 1).otherwise(0)).alias("res"), F.count("*").alias("every"))
    if "cells" in features.columns:
        both = _with_totals(_present(features, genomes, by), totals, own)
        return both.select(*by, "feature_id", "a", (F.col("res") - F.col("a")).alias("b"), "c", (F.col("every") - F.col("res") - F.col("c")).alias("d"))
    rows = features.join(genomes, "genome_id")
    one = lambda phenotype, cond: F.sum(F.when((F.col("phenotype") == RESISTANT) == F.lit(phenotype), F.when(cond, 1)).otherwise(0))
    odd = ~F.col("value").isin(0.0, 1.0)
    per = rows.groupBy(*by, "feature_id").agg(
        F.coalesce(one(True, F.col("value") == 1), F.lit(0)).alias("a"), F.coalesce(one(False, F.col("value") == 1), F.lit(0)).alias("c"),
        F.coalesce(one(True, odd), F.lit(0)).alias("odd_r"), F.coalesce(one(False, odd), F.lit(0)).alias("odd_s"),
    )
    both = _with_totals(per, totals, own)
    return both.select(*by, "feature_id", "a", (F.col("res") - F.col("a") - F.col("odd_r")).alias("b"), "c", (F.col("every") - F.col("res") - F.col("c") - F.col("odd_s")).alias("d"))


#: Logs by which a table may be less likely than the seen one and still count in double precision, and the least log that isn't zero.
_NEGLIGIBLE, _LEAST = 60.0, -745.0


def _fisher_one(a: int, b: int, c: int, d: int, alternative: str) -> float:
    """fisher_p() of one table.

    Chances fall off on both sides of the most likely table faster and faster, so that those left of the first
    and right of the last table worth counting come to less than a double holds: some forty standard
    deviations at most are summed up, however large the counts are.
    """
    m, n, k = a + b, c + d, a + c
    lo, hi = max(0, k - n), min(k, m)
    mode = min(max((m + 1) * (k + 1) // (m + n + 2), lo), hi)
    log_f = lambda x: math.lgamma(x + 1)
    weight = lambda x: log_f(x) + log_f(m - x) + log_f(k - x) + log_f(n - k + x)
    top = weight(mode)
    floor = max(min(0.0, top - weight(a)), _LEAST) - _NEGLIGIBLE
    first = bisect_left(range(lo, mode), True, key=lambda x: top - weight(x) >= floor) + lo
    last = bisect_left(range(mode + 1, hi + 1), True, key=lambda x: top - weight(x) < floor) + mode
    x = np.arange(first, last, dtype="float64")
    # Each log is that of the one before and a ratio, which keeps equal chances equal where sums of large logs don't.
    logs = np.concatenate([[0.0], np.cumsum(np.log((m - x) * (k - x)) - np.log((x + 1) * (n - k + x + 1)))])
    p = np.exp(logs - logs[mode - first])
    at = a - first
    if alternative == "greater":
        far = p[max(at, 0) :]
    elif alternative == "less":
        far = p[: max(at + 1, 0)]
    else:
        far = p[logs <= logs[at] + math.log1p(1e-7)] if 0 <= at < len(p) else p[:0]
    return min(1.0, float(far.sum() / p.sum()))


def fisher_p(a: Column, b: Column, c: Column, d: Column, alternative: str = "two.sided", most: int | None = None) -> Column:
    """The p value of Fisher's exact test: of tables with the same margins, those as unlikely or as far out.

    most: the largest total of a table; tables of all totals are summed up alike, so it changes nothing.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")

    def work(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        known = lambda t: all(x is not None and x == x and x >= 0 for x in t)
        return pd.Series([_fisher_one(*map(int, t), alternative) if known(t) else None for t in zip(a, b, c, d, strict=True)], dtype="float64")

    return F.pandas_udf(work, "double")(a, b, c, d)


def fisher_tests(features: DataFrame, genomes: DataFrame, alternative: str = "two.sided", by: list[str] | None = None) -> DataFrame:
    """(by, feature_id, a, b, c, d, p_value)."""
    t = tables.written(contingency(features, genomes, by), "contingency")
    # Tables repeat between features; each is summed up once.
    distinct = t.select("a", "b", "c", "d").distinct()
    scored = distinct.withColumn("p_value", fisher_p(*[F.col(x) for x in "abcd"], alternative))
    return t.join(scored, ["a", "b", "c", "d"]).select(*(by or []), "feature_id", "a", "b", "c", "d", "p_value")


def benjamini_hochberg(tests: DataFrame, q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """tests with adj_p_value and significant: the step-up procedure over each group of `by`, or all tests.

    Equal p values have one adjusted value, that of the last of them, and all up to the last rejected one
    are rejected; so the procedure runs over distinct p values with their counts, in ranges of them.
    """
    by = by or []
    counts = tables.written(tests.where("p_value is not null").groupBy(*by, "p_value").agg(F.count("*").alias("_k")), "p-values")
    every = counts.groupBy(*by).agg(F.sum("_k").alias("_n"))
    ranked = prefix.running_sum(prefix.in_ranges(counts, "p_value"), by, "p_value", "_k", "_rank")
    ranked = ranked.join(every, by) if by else ranked.crossJoin(F.broadcast(every))
    stepped = prefix.running_min_from_end(ranked.withColumn("_step", F.col("p_value") * F.col("_n") / F.col("_rank")), by, "p_value", "_step", "_least")
    adjusted = stepped.select(*by, "p_value", F.least(F.lit(1.0), "_least").alias("adj_p_value"))
    return tests.join(adjusted, [*by, "p_value"], "left").select(*tests.columns, "adj_p_value", (F.col("adj_p_value") <= q).alias("significant"))


def feature_freq(features: DataFrame, genomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, feature_id, freq_resistant, freq_susceptible): the share of each phenotype's genomes with value one."""
    by = by or []
    own = [c for c in by if c in genomes.columns]
    totals = genomes.groupBy(*own).agg(F.sum(F.when(F.col("phenotype") == RESISTANT, 1).otherwise(0)).alias("res"), F.sum(F.when(F.col("phenotype") == RESISTANT, 0).otherwise(1)).alias("sus"))
    if "cells" in features.columns:
        per = _present(features, genomes, by).withColumnsRenamed({"a": "r", "c": "s"})
    else:
        per = features.join(genomes, "genome_id").groupBy(*by, "feature_id").agg(*[F.sum(F.when((F.col("phenotype") == p) & (F.col("value") == 1), 1).otherwise(0)).alias(n) for p, n in zip(PHENOTYPES, ("r", "s"), strict=True)])
    both = _with_totals(per, totals, own)
    return both.select(*by, "feature_id", F.try_divide("r", "res").alias("freq_resistant"), F.try_divide("s", "sus").alias("freq_susceptible"))


def run_fishers(features: DataFrame, genomes: DataFrame, q: float = 0.05, alternative: str = "two.sided", by: list[str] | None = None) -> DataFrame:
    """Tests, adjusted p values and frequencies of every feature, in one plan."""
    tested = benjamini_hochberg(fisher_tests(features, genomes, alternative, by), q, by)
    return tested.join(feature_freq(features, genomes, by), [*(by or []), "feature_id"])
