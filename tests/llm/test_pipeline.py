from __future__ import annotations

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import entries
from phenogrid.llm.common import new_folder, written


@pytest.fixture(scope="module")
def docs(docs):
    """With the names that stages might give to columns of their own."""
    return docs.withColumns({c: F.lit("x") for c in ("rate", "copies", "n_tokens", "posterior", "_gone", "doc", "id", "found", "text_key")})


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def folder(spark, docs, rows):
    """A folder of tables with every odd case there is."""
    path = new_folder(spark, "test-tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[14][1].split()[:30])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 1 if i == 20 else 0) for i in range(10, 30)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_run_one_after_another(spark, folder, docs):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, df, folder), name)
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
            # What stays is as it was, in all columns; mixing alone may repeat a row.
            before, after = ({}, {})
            for counts, rows in ((before, df.collect()), (after, out.collect())):
                for r in rows:
                    counts[tuple(r)] = counts.get(tuple(r), 0) + 1
            assert set(after) <= set(before)
            assert name == "mixing" or all(n <= before[r] for r, n in after.items())
        seen.append((name, df.count(), out.count()))
        df = out
    assert dict((n, a > b) for n, a, b in seen)["language_id"] and seen[-1][1] == seen[-1][2] > 0 and dict((n, a != b) for n, a, b in seen)["mixing"]


def test_stages_on_an_empty_table(spark, folder, no_docs):
    for _, stage in cp.STAGES:
        assert stage(spark, no_docs, folder).count() == 0


def test_whole_run(spark, small):
    out = cp.run(spark, small).collect()
    assert out and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_queries_are_all_there():
    numbers = sorted(int(n.split("_")[0][2:]) for n in entries.QUERIES)
    assert numbers == list(range(1, 11))
