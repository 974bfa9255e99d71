"""Alignment of two tokenizers' tokens, and how often their tokens are linked in the whole corpus.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece BPE model. Both read a
text with a space before it. Where tokens of both end at the same byte, the text is cut into groups,
and the two tokens that end there are linked.

Texts are encoded once and their ids written, two bytes each where the vocabulary allows. A pass over
them counts links: two ids are packed into one 64-bit key, np.unique counts the keys, and each
partition writes its distinct keys once. These partial counts are dealt by
ranges of keys, sorted, and summed over runs of equal keys. The sums are written as shards of
fixed-width records that tasks map into memory, so that another pass over the ids finds the counts of
their links by binary search and no link is shuffled. The best count of each B id is as long as B's vocabulary,
and is broadcast.

Neither tokenizer joins what white space parts, so each worker keeps the tokens of the pieces of text
that it has met, up to a bound.

Defined cases: a text that is null or empty, or that the tokens don't spell byte by byte, has no
tokens; strings of special tokens inside texts are plain text; repeated rows count as often as they
come; other columns are kept, and a column with the name of the result column is replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import forget, new_folder, release, resident, small_batches, table, written
from phenogrid.llm.pretokens import PretokenCoder, _Uneven, default_path, id_bytes

#: Pieces of text that a worker keeps at most, and letters of the longest that it keeps.
CACHE_PIECES, CACHE_LETTERS = 200_000, 64
#: Distinct keys that a task gathers before it writes them, and pairs of a shard, at most.
GATHERED_KEYS, SHARD_PAIRS = 1_000_000, 1 << 19
#: Letters of texts whose pieces are encoded together.
BLOCK_LETTERS = 1_000_000
#: Bits of an id in a key.
ID_BITS = 24

ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
COUNTED = f"struct<{ALIGNED.replace(' array', ': array')}, counts: array<bigint>, best: array<boolean>>"

# What B's texts are cut into: white space and what follows it.
_PIECES = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+").findall
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class _Recent(dict):
    """A cache in two halves: when the younger one is full it becomes the older one, from which what is asked for again comes back."""

    def __init__(self, make: Callable[[str], bytes], half: int):
        super().__init__()
        self.make, self.half, self.old = make, half, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LETTERS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) << ID_BITS) | a


@dataclass(frozen=True)
class Lengths:
    """Bytes of each token of A and of B, and how their ids are stored."""

    a: np.ndarray
    b: np.ndarray
    kinds: tuple[np.dtype, np.dtype]


class Aligner:
    """Tokens of both tokenizers and the sizes of their groups, for the files at two paths."""

    def __init__(self, a_path: str, b_path: str, entries: int = CACHE_PIECES):
        import sentencepiece

        self.a = PretokenCoder(a_path, id_bytes, b"".join, entries=entries)
        # Strings of special tokens are plain text here.
        self.a.added, self.a.special, self.a.tokenizer.encode_special_tokens = {}, None, True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        kind = json.loads(self.a.tokenizer.to_str())
        byte_of = {c: i for i, c in self.a.byte_names.items()}
        added = {t["content"] for t in kind.get("added_tokens") or []}
        names = {i: bytes(map(byte_of.__getitem__, t)) for t, i in kind["model"]["vocab"].items() if t not in added}
        self.a_bytes = [names.get(i) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(pieces)) > 1 << ID_BITS or b"" in self.b_bytes or b"" in self.a_bytes:
            raise ValueError("ids must have fewer bits and tokens must not be empty")
        a_length, b_length = (np.array([len(t or b"") for t in x], np.int32) for x in (self.a_bytes, self.b_bytes))
        self.kinds = tuple(np.dtype(np.uint16 if len(x) <= 1 << 16 else np.uint32) for x in (self.a_bytes, self.b_bytes))
        self.lengths = Lengths(a_length, b_length, self.kinds)
        # B's texts can be cut before white space if none of its tokens reaches over such a place and it takes texts as they are.
        probe = " Áﬁ  x\t\n "
        crossing = any(re.search("[^▁]▁", p) or (len(p) > 1 and re.search("[\t\n]", p)) for p in pieces)
        self.cut = not crossing and self.b.normalize(probe) == ("▁" + probe).replace(" ", "▁") and len(self.b.encode("\n")) == 2
        self.entries, self.young, self.old = entries // 2, {}, {}
        self.a.words, self.a.pieces = _Recent(self.a._word, entries // 2), _Recent(self.a._encode, entries // 4)

    def _fresh(self, piece: str, ids: list[int]) -> bytes | None:
        return id_bytes(ids) if b"".join(map(self.b_bytes.__getitem__, ids)) == _text(piece).encode() else None

    def _b_rows(self, texts: list[str], words: list[list[str] | None]) -> list[bytes | None]:
        """B's ids of each text; None where they don't spell the text with a space before it."""
        if not self.cut:
            return [self._fresh(" " + t, ids) for t, ids in zip(texts, self.b.encode(texts), strict=True)]
        rows = [w if w and "\t" not in t else list(map(_key, _PIECES(" " + t))) for t, w in zip(texts, words, strict=True)]
        young, new = self.young, []
        for p in set().union(*rows):
            if p not in young:
                if p in self.old:
                    young[p] = self.old[p]
                else:
                    new.append(p)
        # A line end before a piece keeps the model from adding a space to it.
        for p, ids in zip(new, self.b.encode(["\n" + _text(p) for p in new], num_threads=1), strict=True):
            young[p] = self._fresh(p, ids[2:])
        found = [list(map(young.__getitem__, row)) for row in rows]
        for p in new:
            if len(p) > CACHE_LETTERS:
                del young[p]
        if len(young) > self.entries:
            self.young, self.old = {}, young
        return [None if None in row else b"".join(row) for row in found]

    def _a_row(self, text: str, words: list[str] | None) -> bytes:
        if words:
            try:
                return b"".join(map(self.a.words.__getitem__, words))
            except _Uneven:
                pass
        a = self.a(" " + text)
        if not self.a.by_pretoken and b"".join(map(self.a_bytes.__getitem__, np.frombuffer(a, np.int32))) != (" " + text).encode():
            return b""
        return a

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids of A and of B of each text, as bytes of 32-bit integers."""
        a_rows, b_rows, at = [], [], 0
        while at < len(texts):
            block, letters = [], 0
            while at < len(texts) and (not block or letters < BLOCK_LETTERS):
                letters += len(texts[at] or "")
                block.append(texts[at] or "")
                at += 1
            # Words after single spaces, and after line ends; texts with other white space between words go another way.
            words = [t.replace("\n", " \n").split(" ") for t in block]
            words = [None if "" in w or not self.a.by_pretoken else w for w in words]
            for text, own, b in zip(block, words, self._b_rows(block, words), strict=True):
                a = self._a_row(text, own) if text and b else b""
                a_rows.append(a)
                b_rows.append(b if a else b"")
        return a_rows, b_rows

    def stored(self, texts: list[str | None]) -> list[pa.Array]:
        """The ids as they are written, of A and of B."""
        out = []
        for rows, kind in zip(self(texts), self.kinds, strict=True):
            ids = np.frombuffer(b"".join(rows), np.int32).astype(kind)
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32) * kind.itemsize
            out.append(pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())]))
        return out


def _key(piece: str) -> str:
    """By what a piece is kept: a word without the space before it, anything else as it is."""
    return piece[1:] if piece[0] == " " and piece[1:2] not in ("", " ", "\t", "\n") else piece


def _text(key: str) -> str:
    return key if key[0] in " \t\n" else " " + key


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner."""
    return resident(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


class Aligned:
    """Ids, groups and links of some texts, one after another."""

    def __init__(self, own: Lengths, a: pa.Array, b: pa.Array):
        (self.a, self.a_docs), (self.b, self.b_docs) = (self._read(x, kind) for x, kind in zip((a, b), own.kinds, strict=True))
        # Bytes from the first text on: every text ends at the same byte for both.
        a_ends, b_ends = np.cumsum(own.a[self.a], dtype=np.int64), np.cumsum(own.b[self.b], dtype=np.int64)
        at = np.searchsorted(b_ends, a_ends)
        self.a_last = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(a_ends) else np.zeros(0, np.int64)
        self.b_last = at[self.a_last]
        self.groups = np.searchsorted(self.a_last, self.a_docs)

    @staticmethod
    def _read(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), kind).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) // kind.itemsize for r in rows])])

    def keys(self) -> np.ndarray:
        """The key of each group's link: that of its last tokens."""
        return pack(self.a[self.a_last], self.b[self.b_last])

    def columns(self) -> list[pa.Array]:
        """a_ids, b_ids, a_sizes, b_sizes, a list for each text."""
        sizes = [np.diff(x, prepend=-1).astype(np.int32) for x in (self.a_last, self.b_last)]
        return [lists(self.a_docs, self.a), lists(self.b_docs, self.b), *(lists(self.groups, x) for x in sizes)]


def lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _shared_lengths(spark: SparkSession, a_path: str, b_path: str):
    """The tokens' lengths, broadcast: they are as many as the vocabularies have tokens."""
    return spark.sparkContext.broadcast(Aligner(a_path, b_path, 0).lengths)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokenize(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(doc, ids): the columns to keep (all, unless said) as a struct, and the ids of both tokenizers as they are stored; written."""
    a_path, b_path = _paths(a_path, b_path)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(a_path, b_path)
        for part in parts:
            yield pa.StructArray.from_arrays(own.stored(part.to_pylist()), names=["a", "b"])

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, T.StructType().add("a", "binary").add("b", "binary"))
    kept = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)])
    return written(docs.select(kept.alias("doc"), udf(F.col(text_col).cast("string")).alias("ids")), "tokens")


def partial_counts(tokens: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(key, n): the links of each partition of tokenize(), counted there; a partition may have a key more than once."""
    a_path, b_path = _paths(a_path, b_path)

    lengths = _shared_lengths(tokens.sparkSession, a_path, b_path)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own, held, size = lengths.value, [], 0
        rows = lambda pair: pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["key", "n"])
        for part in parts:
            keys, n = np.unique(Aligned(own, part.column(0), part.column(1)).keys(), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size >= GATHERED_KEYS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size >= GATHERED_KEYS // 2:
                    yield rows(held.pop())
                    size = 0
        if held:
            yield rows(_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return tokens.select("ids.a", "ids.b").mapInArrow(count, "key long, n long")


def digits(values: np.ndarray) -> np.ndarray:
    """Eight letters for each number below 2**48, the lowest six bits first: read as a little-endian integer they keep the order."""
    return ((values.astype(np.int64)[:, None] >> (6 * np.arange(8))) & 63).astype(np.uint8) + np.uint8(0x30)


def undigits(words: np.ndarray) -> np.ndarray:
    letters = (words.view(np.uint8).reshape(-1, 8) - np.uint8(0x30)).astype(np.int64)
    return (letters << (6 * np.arange(8))).sum(axis=1)


def write_pair_counts(partials: DataFrame, folder: str, shard_pairs: int = SHARD_PAIRS) -> None:
    """Sum partial counts into files of sorted keys followed by their counts, in records of eight letters.

    Files are Spark's text files, so they can lie in any file system that Spark writes and are complete
    even if executors are lost meanwhile; in order of their names they hold ascending ranges of keys.
    """

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def shard(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(digits(keys).tobytes() + digits(counts).tobytes()).decode("ascii")])], names=["value"])

        for part in parts:
            if not part.num_rows:
                continue
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) > 2 * shard_pairs:
                keys, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                # The last run may go on in the next batch.
                whole = (len(keys) - 1) // shard_pairs * shard_pairs
                for at in range(0, whole, shard_pairs):
                    yield shard(keys[at : at + shard_pairs], counts[at : at + shard_pairs])
                held = [(keys[whole:], counts[whole:])]
        if held:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(keys), shard_pairs):
                yield shard(keys[at : at + shard_pairs], counts[at : at + shard_pairs])

    ordered = partials.repartitionByRange("key").sortWithinPartitions("key")
    ordered.mapInArrow(sums, "value string").write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


class PairCounts:
    """Shards of write_pair_counts(), mapped into memory."""

    def __init__(self, folder: str):
        names = sorted(n for n in os.listdir(folder) if n.startswith("part-") and os.path.getsize(f"{folder}/{n}") > 16)
        self.shards = []
        for name in names:
            n = os.path.getsize(f"{folder}/{name}") // 16
            words = np.memmap(f"{folder}/{name}", "<u8", "r", shape=(2 * n,))
            self.shards.append((words[:n], words[n:]))
        self.firsts = np.array([k[0] for k, _ in self.shards], np.uint64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of some ascending keys, 0 for those that no shard has."""
        wanted = digits(keys).view("<u8").ravel()
        out = np.zeros(len(keys), np.int64)
        of = np.searchsorted(self.firsts, wanted, "right") - 1
        for s in np.unique(of[of >= 0]):
            mine = np.flatnonzero(of == s)
            held, counts = self.shards[s]
            at = np.minimum(np.searchsorted(held, wanted[mine]), len(held) - 1)
            found = held[at] == wanted[mine]
            out[mine[found]] = undigits(np.ascontiguousarray(counts[at[found]]))
        return out


def _place(spark: SparkSession, folder: str) -> tuple[bool, str]:
    """How tasks find a folder: by its path where all have it, else as files that Spark brings to each executor."""
    scheme, _, path = folder.rpartition(":")
    if scheme in ("", "file"):
        return True, "/" + path.lstrip("/") if scheme else path
    spark.sparkContext.addFile(folder, recursive=True)
    return False, folder.rstrip("/").rpartition("/")[2]


def _opened(place: tuple[bool, str]) -> PairCounts:
    from pyspark import SparkFiles

    return PairCounts(place[1] if place[0] else SparkFiles.get(place[1]))


def read_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(a_id, b_id, n) of all shards; a task for each."""
    place = _place(spark, folder)
    names = [r.path.rpartition("/")[2] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").where("length > 16").select("path").collect()]  # a row for each shard

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _opened(place)
        for part in parts:
            for s in part.column(0).to_pylist():
                keys, n = (undigits(np.ascontiguousarray(x)) for x in counts.shards[s])
                yield pa.RecordBatch.from_arrays([pa.array((keys & ((1 << ID_BITS) - 1)).astype(np.int32)), pa.array((keys >> ID_BITS).astype(np.int32)), pa.array(n)], names=["a_id", "b_id", "n"])

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(read, "a_id int, b_id int, n long")


def count_pairs(tokens: DataFrame, a_path: str | None = None, b_path: str | None = None) -> str:
    """Count the links of tokenize(); returns the folder of the shards."""
    # Written first, as dealing by ranges reads its input twice.
    partials = written(partial_counts(tokens, a_path, b_path), "pairs")
    folder = new_folder(tokens.sparkSession, "pair-counts")
    write_pair_counts(partials, folder)
    forget(partials)
    return folder


def align_tokens(tokens: DataFrame, counts: str, a_path: str | None = None, b_path: str | None = None, result_col: str = "aligned") -> DataFrame:
    """The columns kept by tokenize() and a struct: a_ids, b_ids, a_sizes and b_sizes (tokens of each
    group), and of each group's link, counts (how often its pair is linked in the corpus whose counts lie
    in the folder `counts`) and best (whether no pair with that B id has a higher count).
    """
    a_path, b_path = _paths(a_path, b_path)
    spark = tokens.sparkSession
    place = _place(spark, counts)
    highest = np.zeros(0, np.int64)
    rows = read_pair_counts(spark, counts).groupBy("b_id").agg(F.max("n").alias("n")).toPandas()  # a row for each id of B at most
    if len(rows):
        highest = np.zeros(int(rows["b_id"].max()) + 1, np.int64)
        highest[rows["b_id"]] = rows["n"]
    shared, lengths = spark.sparkContext.broadcast(highest), _shared_lengths(spark, a_path, b_path)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        own, seen = lengths.value, resident(("pair counts", place[1]), lambda: _opened(place))
        found = Aligned(own, a, b)
        distinct, at = np.unique(found.keys(), return_inverse=True)
        n = seen.lookup(distinct)
        # Texts of another corpus may have pairs and ids that were never counted.
        known, top = shared.value, np.zeros(len(n), np.int64)
        own_b = distinct >> ID_BITS
        top[own_b < len(known)] = known[own_b[own_b < len(known)]]
        columns = [*found.columns(), *(lists(found.groups, x[at]) for x in (n, n >= top))]
        return pa.StructArray.from_arrays(columns, names=["a_ids", "b_ids", "a_sizes", "b_sizes", "counts", "best"])

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    # What Python makes of the result is made in the same worker.
    udf = F.arrow_udf(run, COUNTED)
    kept = [F.col("doc")[c].alias(c) for c in tokens.schema["doc"].dataType.names if c != result_col]
    return tokens.select(*kept, udf("ids.a", "ids.b").alias(result_col))


def align(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, result_col: str = "aligned", keep: list[str] | None = None) -> DataFrame:
    """align_tokens() of docs with the counts of docs themselves."""
    tokens = tokenize(docs, text_col, a_path, b_path, keep)
    return align_tokens(tokens, count_pairs(tokens, a_path, b_path), a_path, b_path, result_col)


def group_text(aligned: str = "aligned"):
    """A column of the groups as text: `a1,a2|b1;a3|b2,b3`."""

    def joined(ids: pa.Array, sizes: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False))])
        return pc.binary_join(lists(ends, ids.flatten().cast(pa.string())), ",")

    def write(found: pa.Array) -> pa.Array:
        a, b, m, n = (found.field(c) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
        groups = pc.binary_join_element_wise(joined(a, m), joined(b, n), "|")
        ends = np.concatenate([[0], np.cumsum(m.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pc.binary_join(lists(ends, groups), ";")

    write.__annotations__ = {"found": pa.Array, "return": pa.Array}
    return F.arrow_udf(write, T.StringType())(aligned)


def op12_alignment(spark, sf_dir):
    small_batches(spark, 256)
    rows = align(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "aligned", group_text().alias("groups"))
    size = lambda c: F.size(f"aligned.{c}").cast("long")
    return rows.select(
        "doc_id",
        size("a_ids").alias("n_a"),
        size("b_ids").alias("n_b"),
        size("a_sizes").alias("n_groups"),
        size("counts").alias("n_links"),
        F.size(F.filter("aligned.best", lambda x: x)).cast("long").alias("n_best"),
        F.aggregate("aligned.counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("count_sum"),
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )
