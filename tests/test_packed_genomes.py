"""Packed genomes of the driver's tables come from purchases and say what the feature table's rows say."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid import queries
from phenogrid.plans import matrix
from phenogrid.sources import adapter, tables


def test_genomes_are_packed_without_rows_of_zeros(spark, small, monkeypatch):
    want = matrix.packed(adapter.relation(spark, small, "features"), 100)
    # No row of the feature table is made.
    monkeypatch.setattr(queries, "_features", None)
    got = queries._packed(spark, small)
    assert got.columns == want.columns
    key = lambda df: {r.genome_id: (sorted(map(tuple, r.cells)), sorted(r.feature_types)) for r in df.collect()}
    assert key(got) == key(want) != {}


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_keeps_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = tables.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert _shuffle_files(spark) <= before and out.count() == 7
