"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned onto their principal axes and by a rotation that brings them as
near as it can to the corners of a cube (iterative quantisation), and each coordinate's sign is a bit.
Axes and rotation are learned from a bounded sample; every vector is indexed. Index: a code is split
into substrings of 16 bits, and each shard of the vectors has for each substring a table from its
values to rows. Search: if two codes differ in at most r bits, then by the pigeonhole principle they
differ in few bits of some substring, so probing the values near the query's substrings retrieves
every code within the radius; those are ranked by their exact cosine.

The radius is taken from the sample: the least one within which the wanted share of its own exact
neighbours lies. Neighbours in the whole table are nearer than in a sample, so this errs on the safe
side. A query that finds fewer than k searches again without a radius.

Vectors are dealt into shards of a bounded size by a hash of their ids, and queries into blocks of a
bounded size; a task has one shard and one block at a time. Equal and near vectors spread over all
shards, and each shard returns k rows a query at most.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id; equal scores are ranked by id; rows that share an
id aren't neighbours of each other, count once as a neighbour, with the nearest of them, and ask with
the least of their vectors; vectors are scaled by powers of two, so that no length over- or underflows; with fewer than k others all are returned; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import table, written

#: Vectors from which axes, rotation and radius are learned, at most.
SAMPLE_VECTORS = 6000
#: Neighbours of the sample's own queries that its radius must reach.
SAMPLE_RECALL = 0.975
SUBSTRING = 16
SHARD_ROWS = 100_000
QUERY_ROWS = 20_000
LEAST_SHARDS = 16

_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)
_MASKS = np.argsort(_POPCOUNT, kind="stable").astype(np.uint16)

FOUND = "query_id long, vec_id long, score double"


def learn(sample: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection): the signs of (x - centre) @ projection are a code's bits."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre, dim = x.mean(axis=0), x.shape[1]
    _, axes = np.linalg.eigh(np.cov((x - centre).T).reshape(dim, dim))
    rng, parts = np.random.default_rng(seed), []
    for start in range(0, bits, dim):
        k = min(dim, bits - start)
        top = axes[:, ::-1][:, :k]
        flat = (x - centre) @ top
        turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        parts.append(top @ turn)
    return centre, np.concatenate(parts, axis=1)


def encode(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """A row of 16-bit substrings for each vector."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = np.packbits((unit - centre) @ projection > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint16)


def _distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _POPCOUNT[codes ^ code].sum(axis=1)


def cosines(x: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed row by row, so that equal vectors score equally wherever they stand."""
    return (x * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


def radius_for(sample: np.ndarray, codes: np.ndarray, k: int, recall: float, most_queries: int = 500) -> int:
    norms = np.sqrt((sample * sample).sum(axis=1))
    seen = []
    for i in range(0, len(sample), max(1, len(sample) // most_queries)):
        s = cosines(sample, norms, sample[i])
        s[i] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1))[:k]
        seen.append(_distances(codes[near[near != i]], codes[i]))
    d = np.sort(np.concatenate(seen)) if seen else np.zeros(0)
    return int(d[min(len(d) - 1, int(np.ceil(recall * len(d))))]) if len(d) else codes.shape[1] * SUBSTRING


class MultiIndex:
    """The tables of one shard: for each substring, its values in order and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from this one in at most `radius` bits."""
        m = len(self.tables)
        least, rest = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for i, (values, starts, order) in enumerate(self.tables):
            near = least if i <= rest else least - 1
            if near < 0:
                continue
            probes = np.searchsorted(_POPCOUNT[_MASKS], near, side="right")
            if probes < len(values):
                wanted = _MASKS[:probes] ^ code[i]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                at = at[values[at] == wanted]
            else:
                at = np.flatnonzero(_POPCOUNT[values ^ code[i]] <= near)
            sizes = starts[at + 1] - starts[at]
            if sizes.sum():
                hit[order[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[_distances(self.codes[rows], code) <= radius]


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # By a power of two, which changes no cosine.
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _search_cells(base: DataFrame, queries: DataFrame, k: int, dim: int, centre: np.ndarray, projection: np.ndarray, radius: int) -> DataFrame:
    n, q = base.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-q // QUERY_ROWS))
    of = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = base.select("vec_id", "v", of("vec_id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("query_id", "v", of("query_id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, scores, who = [], [], []
        if rows.num_rows and asked.num_rows:
            x, names = _matrix(rows, dim), rows.column("vec_id").to_numpy()
            norms = np.sqrt((x * x).sum(axis=1))
            index = MultiIndex(encode(x, centre, projection))
            y = _matrix(asked, dim)
            for query, code, name in zip(y, encode(y, centre, projection), asked.column("query_id").to_numpy(), strict=True):
                at = index.within(code, radius)
                at = at[names[at] != name]
                s = cosines(x[at], norms[at], query)
                best = np.lexsort((names[at], -s))
                best = best[np.sort(np.unique(names[at][best], return_index=True)[1])[:k]]
                ids.append(names[at][best])
                scores.append(s[best])
                who.append(np.full(len(best), name))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query_id": join(who, pa.int64()), "vec_id": join(ids, pa.int64()), "score": join(scores, pa.float64())})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, but for those of a rare length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64, sample_vectors: int = SAMPLE_VECTORS, recall: float = SAMPLE_RECALL, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its k nearest others found."""
    spark = vectors.sparkSession
    valid = usable(vectors, id_col, vector_col)
    lengths = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0].dim
    valid = valid.where(F.size("v") == dim)
    some = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_vectors).select("v").toArrow()
    sample = _matrix(some, dim)
    centre, projection = learn(sample, bits)
    if radius is None:
        radius = radius_for(sample, encode(sample, centre, projection), k, recall)
    queries = written(valid.where(is_query).select(F.col("vec_id").alias("query_id"), "v").groupBy("query_id").agg(F.min("v").alias("v")), "ann-queries")
    first = written(_search_cells(valid, queries, k, dim, centre, projection, radius), "ann")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = written(queries.join(full, "query_id", "left_anti"), "ann-short")
    if not short.isEmpty():
        rest = _search_cells(valid, short, k, dim, centre, projection, bits)
        first = first.join(full, "query_id", "left_semi").unionByName(rest)
    return first.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
