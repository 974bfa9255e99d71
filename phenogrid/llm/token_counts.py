"""Token counts by a map-side two-tier lookup.

The first tier is a compact hash table from frequent pre-tokens to their lengths in tokens, which is
broadcast; it is made of a bounded sample of documents and only saves time: no count depends on it.
The second tier is each worker's cache, filled by the tokenizers library with what the first misses.
Every document is counted where it is read: no pre-token is shuffled.

Defined cases: null and empty texts have no tokens; special strings inside a text are single tokens,
which is the library's default; repeated rows are counted one by one; other columns are kept, and a
column with the name of the result column is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import resident, small_batches, table
from phenogrid.llm.pretokens import PretokenCoder, default_path

#: Documents of which the table of frequent pre-tokens is made, and its entries, both at most.
SAMPLE_DOCUMENTS = 4000
TABLE_ENTRIES = 32_768


def frequent_lengths(docs: DataFrame, text_col: str, path: str, sample_documents: int = SAMPLE_DOCUMENTS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample of documents, with their lengths in tokens."""
    n = docs.count()
    if not n:
        return {}
    some = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").sample(min(1.0, sample_documents / n), seed=7).limit(2 * sample_documents)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, seen = PretokenCoder(path, len, sum), Counter()
        for part in parts:
            for t in part["t"]:
                seen.update(coder.pretokens(t))
        top = seen.most_common(entries)
        yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    seen: Counter = Counter()
    for row in some.mapInPandas(count, "piece string, n long").toLocalIterator():
        seen[row.piece] += row.n
    lengths = PretokenCoder(path, len, sum).pieces
    return {p: lengths[p] for p, _ in seen.most_common(entries)}


class TwoTiers:
    """Lengths of texts: each pre-token is asked of the table first, and of this worker's cache if that hasn't it."""

    def __init__(self, path: str, table: dict[str, int]):
        self.table, self.coder = table, PretokenCoder(path, len, sum)
        self.hits = self.misses = 0

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.coder.by_pretoken:
            return self.coder(text)
        pieces = self.coder.pretokens(text)
        found = list(map(self.table.get, pieces))
        missing = found.count(None)
        self.hits, self.misses = self.hits + len(found) - missing, self.misses + missing
        if not missing:
            return sum(found)
        slow = self.coder.pieces
        return sum(slow[p] if n is None else n for p, n in zip(pieces, found, strict=True))


def _coder(path: str, tag: str, table) -> TwoTiers:
    """This worker's coder; it outlives a task, so that its cache serves the next one."""
    return resident(("lengths", path, tag), lambda: TwoTiers(path, table.value))


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, result_col: str = "n_tokens", sample_documents: int = SAMPLE_DOCUMENTS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """docs with the number of tokens of each text under the tokenizers file at `path`."""
    path = path or default_path()
    tag = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, path, sample_documents, entries))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, tag, shared)
        for texts in parts:
            yield pd.Series(list(map(coder, texts)), dtype="int64")

    return docs.withColumn(result_col, count(F.col(text_col).cast("string")))


def op8_token_counts(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )
