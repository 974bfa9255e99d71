"""What a table of the shared folder leaves behind."""

from __future__ import annotations

import time

from phenogrid.llm.common import written


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_keeps_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), _shuffle_files(spark)
    out = written(spark.range(1000).selectExpr("id % 100 as k").groupBy("k").count(), "t")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 100 and spark.conf.get(name) == setting
