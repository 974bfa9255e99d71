"""Token ids in ORC files.

Documents are dealt by ranges of their ids, so that files follow one another in ascending order of
id; each task encodes its range and knows how many ids came before each document within its shard.
A row has (doc_id, shard, shard_start, n_tokens, ids). ORC stores ids with integer run-length
encoding, keeps minima and maxima of doc_id in its row indexes and a Bloom filter on it, so readers
take stripes in parallel and skip those without the ids they look for. Where a shard starts in the
whole follows from the shards' totals, one number for each.

Defined cases: a null or empty text has only the end id; documents of equal id follow one another in
the order of a hash of their text; null ids come first; other columns aren't written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import new_folder, small_batches, table
from phenogrid.llm.pretokens import byte_coder, default_path, id_bytes

END_ID = 2
#: Shards whose starts are broadcast at most: 12 bytes each.
BROADCAST_SHARDS = 1_000_000
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def encode_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    path = path or default_path()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, start = byte_coder(path), TaskContext.get().partitionId(), 0
        end = id_bytes([end_id])
        for part in parts:
            rows = [coder(t) + end for t in part.column("text").to_pylist()]
            sizes = np.array([len(r) // 4 for r in rows], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(rows), shard, np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ties = F.xxhash64("text")
    return rows.repartitionByRange("doc_id", ties).sortWithinPartitions("doc_id", ties).mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    encoded = encode_shards(docs, id_col, text_col, path, end_id)
    encoded.write.options(**{"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_stride), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}).orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    offsets, at = [], 0
    for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row for each file
        offsets.append((r.shard, at))
        at += r.n
    starts = spark.createDataFrame(offsets, "shard int, shard_from long")
    # A row for each file: where files are so many that this isn't small, the join shuffles instead.
    return rows.join(F.broadcast(starts) if len(offsets) <= BROADCAST_SHARDS else starts, "shard").select("doc_id", (F.col("shard_from") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    data = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64) * 4
    view = memoryview(data)
    return pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write docs as token files, read them back and return a digest of each document."""
    folder = new_folder(spark, "tokens")
    write_token_files(docs, folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


def op9_token_files(spark, sf_dir):
    small_batches(spark)
    return token_digest(spark, table(spark, sf_dir, "documents"))
