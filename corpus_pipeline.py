"""A pipeline that makes training tokens of the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import decontaminate, language_id, mixing, near_dedup, token_files
from phenogrid.llm.common import small_batches, table, written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those of null, without text or without letters go; rows are judged one by one."""
    small_batches(spark)
    told = language_id.identify_rows(docs)
    return told.where(F.col("language.lang") != language_id.UNKNOWN).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts, that of the smallest id: five-word shingles, similarity 0.8.

    Rows with a null id and texts without words stay.
    """
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, size=5, threshold=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a passage of the benchmark; those without words stay."""
    small_batches(spark)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    found = decontaminate.find_contamination(packed, table(spark, sf_dir, "benchmark"), result_col="found")
    return found.where(~decontaminate.is_contaminated("found")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A quarter more tokens of good text, as many of poor text as there are, and none of toxic text.

    A document comes as many times as its rate says, drawn by a hash of its id, but at least once unless
    it is more likely toxic than not: fitting totals must not cost clean documents. A null or empty text
    has the rate of a text without words; without labels all documents stay as they are.
    """
    small_batches(spark)
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    rated = mixing.rate_documents(docs, domains, {"high": 1.25, "low": None, "toxic": 0.0}, relative=True)
    least = F.when(F.element_at("posterior", 3) < 0.5, 1).otherwise(0)
    times = F.greatest(F.col("copies").cast("int"), least)
    repeated = rated.select("doc", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, repeats included; returns where each document lies in them."""
    small_batches(spark)
    return token_files.token_digest(spark, docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", keep_uncontaminated),
    ("mixing", mix_domains),
    ("token_files", write_tokens),
]

#: SQL expresses no learned stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
