"""Near-duplicate documents by SuperMinHash.

Each shingle of a document draws a random permutation of the signature's positions and puts its j-th
draw, made larger than all of its earlier ones by j, at the j-th position of the permutation; a
position keeps the least. Draws of one shingle at different positions are thus correlated, which makes
similarity estimates vary less than those of independent hashes, and once every position holds a
draw of a round before j, rounds from j on cannot matter: a long document stops after one or two.
Signatures are cut into bands; documents that share a band are candidates; candidates are confirmed
on their full shingle sets, and groups are the connected components of confirmed links.

Documents with one and the same shingle set are one node throughout, whatever their ids. A node is compared with one
member of each of its buckets at a time (see linking). What then still shares a bucket but no group is
compared if it shares one of its rarest shingles: of two sets as similar as asked for, each has one of
the other's shingles among so many of its own as the other may lack, and one more, whatever the order
of shingles, and after the first that they share enough must be left. So a large group of copies costs what its size is, not its square.

Defined cases: null, empty and word-less texts have no shingles and are linked with nothing; rows
with a null id take no part and have no component, but are kept; rows that share an id are one
document, linked if any of them is, so an id joins the groups of its texts in near_duplicates();
drop_near_duplicates() groups by texts alone, so that no text goes for an id's sake, and rows of one id
and one text stay or go together; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import release, small_batches, table, written
from phenogrid.llm.components import connected_components
from phenogrid.llm.linking import cross_pairs, link_buckets
from phenogrid.llm.shingles import mix, shingle_set, word_hashes

POSITIONS = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TRACED = 6
SIGNED = "doc_id long, text_key long, n_shingles long, fingerprint binary, bands array<long>"


def signature(shingles: np.ndarray, m: int = POSITIONS) -> np.ndarray:
    """The SuperMinHash signature of a non-empty set: at each position, round << 24 | draw."""
    sig = np.full(m, 0xFFFFFFFF, np.uint32)
    swaps: list[np.ndarray] = []
    perm = rows = None
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix(shingles + _STEP * np.uint64(j + 1))
        k = (np.uint64(j) + (((draw >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int64)
        if j < _TRACED:
            at = k
            for i in range(j - 1, -1, -1):
                at = np.where(at == swaps[i], i, at)
            swaps.append(k)
        else:
            if perm is None:
                rows = np.arange(len(shingles))
                perm = np.tile(np.arange(m, dtype=np.int16), (len(shingles), 1))
                for i, s in enumerate(swaps):
                    was = perm[rows, s]
                    perm[rows, s] = perm[:, i]
                    perm[:, i] = was
            at = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = at
            at = at.astype(np.int64)
        np.minimum.at(sig, at, (np.uint32(j << 24)) | (draw & np.uint64(0xFFFFFF)).astype(np.uint32))
        if int(sig.max()) < (j + 1) << 24:
            break
    return sig


def banding(threshold: float, m: int = POSITIONS, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows) with the longest bands by which a pair at the threshold is missed with at most this probability."""
    for rows in range(m, 0, -1):
        bands = m // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return m, 1


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
        for i in range(rows):
            h = mix(h ^ part[:, i]) + _STEP
    return h.view(np.int64)


def _shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def sign(docs: DataFrame, size: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    bands, rows = banding(threshold)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for part in parts:
            counts, prints, keys = [], [], []
            for words in word_hashes(part.column("text").to_pylist()):
                s = shingle_set(words, size)
                counts.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s), bands, rows) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                names=["doc_id", "text_key", "n_shingles", "fingerprint", "bands"],
            )

    return _shingled(docs, id_col, text_col).mapInArrow(work, SIGNED)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in parts:
            sets = [shingle_set(w, size).view(np.int64) for w in word_hashes(part.column("text").to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["node", "shingles"])

    return docs.mapInArrow(work, "node long, shingles array<long>")


def _judged(docs: DataFrame, size: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, stays) per row of docs; stays marks the rows of one document of each group of texts."""
    percent = round(threshold * 100)
    signed = written(sign(docs, size, threshold, id_col, text_col), "near-signed")
    with_set = signed.where("fingerprint is not null and doc_id is not null")
    found = with_set.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = written(found.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    several = nodes.where("copies > 1").select("node", "copies")
    members = written(buckets.join(shared, "bucket").join(several, "node", "left").na.fill(1, ["copies"]), "near-members")
    candidates = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_text"))
    rows = _shingled(docs, id_col, text_col)
    texts = rows.join(candidates, (rows["doc_id"] == candidates["of_id"]) & (rows["text_key"] == candidates["of_text"])).select("node", "text")
    sets = written(shingle_sets(texts, size), "near-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(two, "b").join(one, "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    def may(x, y):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def rest(still: DataFrame) -> DataFrame:
        nodes = still.select("node", "n", "component").distinct()
        one = sets.join(nodes, "node").select("node", "n", "component", F.explode("shingles").alias("key")).distinct()
        common = one.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        # Shingles of one node alone come first in the order and match nothing, so their number is enough.
        shared = one.join(common, "key").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))
        spare = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("keys"))
        first = shared.where(spare > 0).select("node", "n", "component", F.size("keys").alias("size"), F.posexplode(F.slice("keys", F.lit(1), spare.cast("int"))).alias("at", "k"))
        placed = first.select(F.col("k.key").alias("key"), "node", "n", "component", (F.col("n") - F.col("size") + F.col("at") + 1).alias("place"))
        # If this is the first shingle that two sets share, they share no more than come after it in either.
        most = 1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
        return cross_pairs(placed, may, (100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y")))

    groups = link_buckets(members, verify, rest, may, tag="near")
    # Texts that one id has in common tie their groups together.
    texts_of = with_set.select("doc_id", "fingerprint").distinct()
    many = texts_of.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    tied = texts_of.join(many, "doc_id").join(nodes.select("fingerprint", "node"), "fingerprint").join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("b"))
    ties = written(tied.join(tied.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a < b").select("a", "b").distinct(), "near-ties")
    labels = nodes.join(groups, "node", "left").select("fingerprint", "first", F.coalesce("component", "node").alias("texts"))
    if ties.isEmpty():
        labels = labels.withColumn("ids", F.col("texts"))
    else:
        over = connected_components(ties, "near-ids").select(F.col("node").alias("texts"), F.col("component").alias("over"))
        labels = labels.join(over, "texts", "left").withColumn("ids", F.coalesce("over", "texts")).drop("over")
    labels = written(labels, "near-labels")
    stay = labels.groupBy("texts").agg(F.min("first").alias("stay"))
    least = labels.groupBy("ids").agg(F.min("first.doc_id").alias("component_id"))
    labels = labels.select("fingerprint", "texts", "ids").join(stay, "texts").join(least, "ids").select("fingerprint", "stay", "component_id")
    out = signed.select("doc_id", "text_key", "n_shingles", "fingerprint").join(labels, "fingerprint", "left")
    # A row without words belongs where other rows of its id do.
    blank = F.col("fingerprint").isNull() & F.col("doc_id").isNotNull()
    elsewhere = with_set.join(signed.where(blank).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "fingerprint").join(labels, "fingerprint").groupBy("doc_id").agg(F.min("component_id").alias("elsewhere"))
    out = out.join(elsewhere, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "elsewhere", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.struct("doc_id", "text_key") == F.col("stay"), F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs; kept marks the document of smallest id of each group."""
    out = _judged(docs, size, threshold, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicate texts, that of the smallest id; rows with a null id stay."""
    gone = _judged(docs, size, threshold, id_col, text_col).where("not stays").select("doc_id", "text_key").distinct()
    return docs.join(gone, (docs[id_col].cast("long") == gone["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["text_key"]), "left_anti")


def op5_near_dedup(spark, sf_dir):
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, threshold=0.85)


SQL = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i + 1 : i + least(3, len(ws))], ' ') as shingle from d, unnest(range(len(ws) - least(3, len(ws)) + 1)) t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b),
g as (select a as doc_id, min(b) as component_id from r group by a)
select g.doc_id, coalesce(n.n, 0) as n_shingles, component_id, g.doc_id = component_id as kept from g left join n on n.doc_id = g.doc_id
"""
