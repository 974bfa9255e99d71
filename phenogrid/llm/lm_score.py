"""Language-model scores by context-tree weighting over bytes.

A text's symbols are the bytes of its lower-cased words, single spaces between them, and an end. Each
byte is eight binary decisions; each decision has a tree of contexts, the 0 to `depth` bytes before.
A node of a tree estimates the next bit by the Krichevsky-Trofimov rule from its counts of zeros and
ones, and is weighted half against the product of its children, that is against all deeper contexts
of it together. So the probability of a bit is a mixture of the estimates along its context, each
weighted by how well it has coded the training texts as against what lies below it.

All of it is counts of distinct runs of depth + 1 bytes ("grams"). Tasks count theirs before anything
is shuffled; contexts of each length, their trees' probabilities from the leaves to the root, and the
mixed log-probability of every gram that occurs in any document, trained or not, are joins and
aggregates over grams. Documents are scored by looking their grams up in two tiers: the most
frequent, up to a stated number, are broadcast as sorted arrays; what a document has of the others is
counted, joined and summed. The baseline's word counts are looked up in the same way.

Defined cases: a null or word-less text is its end alone; a row with a null id is neither held out nor
left out of training; without training texts every bit has probability one half; repeated rows are
scored one by one; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import crc_mod, forget, release, size_in_memory, small_batches, table, written
from phenogrid.llm.shingles import word_hashes

DEPTH = 5
#: Entries of a broadcast table at most, of 16 bytes each.
TABLE_ENTRIES = 500_000
END, START = 0xFF, 0xFE
#: Grams of a group of leaves, about.
GROUP_GRAMS = 100_000
#: Symbols that a task sorts at a time.
_CHUNK = 2_000_000


def symbols(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + b"\xff"


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """The gram that ends at each symbol, in order, over all texts: the farthest byte first."""
    padded = (b"\xfe" * depth).join([b"", *texts])
    a = np.frombuffer(padded, np.uint8)
    key = np.zeros(len(a) - depth, np.uint64)
    for i in range(depth + 1):
        key <<= np.uint64(8)
        key |= a[i : len(a) - depth + i]
    return key[a[depth:] != START]


def _chunks(texts: list[bytes], most: int = 4096) -> Iterator[list[int]]:
    """Numbers of texts in turn, of about _CHUNK symbols together and not more than `most`."""
    some, size = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t)
        if size >= _CHUNK or len(some) == most:
            yield some
            some, size = [], 0
    if some:
        yield some


class _Counter:
    """Sums counts of 64-bit keys; merges what it has gathered whenever that has grown twofold."""

    def __init__(self):
        self.parts, self.rows, self.kept = [], 0, 0

    def add(self, keys: np.ndarray, all_n: np.ndarray, train_n: np.ndarray) -> None:
        self.parts.append((keys, all_n, train_n))
        self.rows += len(keys)
        if self.rows > 2 * self.kept + 1_500_000:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, a, t = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            self.parts = [(keys, np.bincount(at, a).astype(np.int64), np.bincount(at, t).astype(np.int64))]
        self.rows = self.kept = len(self.parts[0][0]) if self.parts else 0


COUNTED = "key long, n_all long, n_train long"
#: Set in the keys of words, which makes them negative; grams of up to seven bytes are positive.
_WORD_BIT = np.uint64(1 << 63)


def _count_unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_keys(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n_all, n_train): grams and words in all and in training texts."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        gram, word = _Counter(), _Counter()
        for part in parts:
            texts, train = part.column("text").to_pylist(), part.column("train").to_numpy(zero_copy_only=False).astype(bool)
            coded = [symbols(t) for t in texts]
            for some in _chunks(coded):
                for learn in (True, False):
                    own = [i for i in some if train[i] == learn]
                    if own:
                        keys, n = _count_unique(grams([coded[i] for i in own], depth))
                        gram.add(keys.view(np.int64), n, n if learn else n * 0)
                        keys, n = _count_unique(np.concatenate([*word_hashes([texts[i] for i in own]), np.full(len(own), 2**64 - 1, np.uint64)]) | _WORD_BIT)
                        word.add(keys.view(np.int64), n, n if learn else n * 0)
        for c in (gram, word):
            c.merge()
            for keys, a, t in c.parts:
                for at in range(0, len(keys), 100_000):
                    k = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k]), pa.array(a[k]), pa.array(t[k])], names=["key", "n_all", "n_train"])

    counted = docs.select("text", "train").mapInArrow(work, COUNTED)
    return counted.groupBy("key").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def _lgamma(x: Column) -> Column:
    """log of the gamma function for positive x, by Stirling's series from eight on."""
    rise = x
    for i in range(1, 8):
        rise = rise * (x + i)
    y = F.when(x < 8, x + 8).otherwise(x)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x < 8, series - F.log(rise)).otherwise(series)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)


def _mask(depth: int) -> int:
    return (1 << (8 * (depth + 1))) - 1


def _log_kt_arrays(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    def log_gamma(x: np.ndarray) -> np.ndarray:
        rise = np.ones_like(x)
        for i in range(8):
            rise *= np.where(x < 8, x + i, 1.0)
        y = np.where(x < 8, x + 8, x)
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(rise)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context and node together, bit) of the eight decisions of each gram, a column each."""
    byte, context = keys & np.uint64(255), keys & ~np.uint64(255)
    k = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << k) | (byte[:, None] >> (np.uint64(8) - k))
    return context[:, None] | node, ((byte[:, None] >> (np.uint64(7) - k)) & np.uint64(1)).astype(bool)


def _node_counts(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, zeros, ones) of these grams' trees, and for each gram and decision its node's number and bit."""
    place, bit = _bits(keys)
    nodes, at = np.unique(place, return_inverse=True)
    at, times = at.reshape(place.shape), np.repeat(n, 8).reshape(place.shape).astype(float)
    count = lambda of: np.bincount(at.ravel(), (times * of).ravel(), len(nodes))
    return nodes, count(~bit), count(bit), at, bit


def leaf_sums(leaves: DataFrame, depth: int) -> DataFrame:
    """(context, node, below): log-probability of the leaves below each node one level up.

    Grams are dealt so that all leaves of a node meet in one group; groups are of a bounded size, as
    no context has more than 65536 grams one byte longer.
    """

    def work(_, t):
        nodes, zeros, ones, _, _ = _node_counts(t.column("key").to_numpy().view(np.uint64), t.column("n_train").to_numpy())
        up, at = np.unique(nodes & np.uint64(_mask(depth - 1)), return_inverse=True)
        below = np.bincount(at, _log_kt_arrays(zeros, ones), len(up))
        return pa.table({"context": (up >> np.uint64(8)).astype(np.int64), "node": (up & np.uint64(255)).astype(np.int32), "below": below})

    return leaves.groupBy("deal").applyInArrow(work, "context long, node int, below double")


def leaf_scores(leaves: DataFrame, mixed: DataFrame) -> DataFrame:
    """(key, n_all, score) from the grams and what the shorter contexts make of each decision of theirs."""

    def work(_, own: pa.Table, above: pa.Table) -> pa.Table:
        keys = own.column("key").to_numpy().view(np.uint64)
        if not len(keys):
            return pa.table({"key": pa.array([], pa.int64()), "n_all": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        _, zeros, ones, at, bit = _node_counts(keys, own.column("n_train").to_numpy())
        kt = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
        # Eight decisions in a row for each gram of the shorter contexts.
        name, digit = above.column("key").to_numpy().view(np.uint64), above.column("bit").to_numpy()
        order = np.lexsort((digit, name))
        name = name[order][::8]
        so_far, left_over = (above.column(c).to_numpy()[order].reshape(-1, 8) for c in ("so_far", "left_over"))
        shorter = np.searchsorted(name, own.column("parent").to_numpy().view(np.uint64))
        score = np.log10(so_far[shorter] + left_over[shorter] * kt).sum(axis=1)
        return pa.table({"key": own.column("key"), "n_all": own.column("n_all"), "score": score})

    return leaves.groupBy("deal").cogroup(mixed.groupBy("deal")).applyInArrow(work, "key long, n_all long, score double")


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(key, n_all, score): log10 of the weighted probability of each gram's last byte after the others."""
    byte = F.col("key").bitwiseAND(0xFF)
    groups = max(32, -(-counts.count() // GROUP_GRAMS))
    # Leaves are dealt by the context that they share but for its farthest byte.
    deal = lambda key: F.pmod(F.xxhash64(F.shiftrightunsigned(key, 8)), F.lit(groups)).cast("int").alias("deal")
    parent = F.col("key").bitwiseAND(_mask(depth - 1))
    leaves = counts.select("key", "n_train", "n_all", parent.alias("parent"), deal(parent))
    runs, by_depth = counts.select("key", "n_train"), []
    for level in range(depth - 1, -1, -1):
        runs = written(runs.select(F.col("key").bitwiseAND(_mask(level)).alias("key"), "n_train").groupBy("key").agg(F.sum("n_train").alias("n_train")), f"ctw-runs-{level}")
        by_depth.insert(0, runs)

    def decisions(d: int) -> DataFrame:
        rows = by_depth[d].select("key", "n_train", F.shiftrightunsigned("key", 8).alias("context"), byte.alias("byte"), F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("bit"))
        # The node of bit k: a leading one and the k bits before.
        return rows.withColumn("node", F.expr("(1 << bit) | (byte >> (8 - bit))").cast("int")).withColumn("one", F.expr("(byte >> (7 - bit)) & 1"))

    below = leaf_sums(leaves, depth)
    nodes: list[DataFrame] = []
    for d in range(depth - 1, -1, -1):
        node = decisions(d).groupBy("context", "node").agg(F.sum(F.col("n_train") * (1 - F.col("one"))).alias("zeros"), F.sum(F.col("n_train") * F.col("one")).alias("ones"))
        node = node.join(below, ["context", "node"], "left").withColumn("own", _log_kt(F.col("zeros"), F.col("ones"))).withColumn("below", F.coalesce("below", F.lit(0.0)))
        gap = F.col("own") - F.col("below")
        # weight = beta / (1 + beta) with beta = own / below; log_w = log((own + below) / 2), without overflow.
        node = node.withColumn("weight", 1 / (1 + F.exp(F.least(-gap, F.lit(700.0))))).withColumn("log_w", F.greatest("own", "below") + F.log1p(F.exp(-F.abs(gap))) - math.log(2))
        nodes.insert(0, written(node.select("context", "node", "zeros", "ones", "weight", "log_w"), f"ctw-{d}"))
        below = nodes[0].groupBy(F.col("context").bitwiseAND(_mask(d - 2) if d > 1 else 0).alias("context"), "node").agg(F.sum("log_w").alias("below"))
    mixed = None
    for d in range(depth):
        kt = (F.when(F.col("one") == 1, F.col("ones")).otherwise(F.col("zeros")) + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        here = decisions(d).join(nodes[d].drop("log_w"), ["context", "node"]).withColumn("kt", kt)
        if mixed is None:
            here = here.withColumn("so_far", F.lit(0.0)).withColumn("left_over", F.lit(1.0))
        else:
            upper = mixed.select(F.col("key").alias("parent"), "bit", "so_far", "left_over")
            here = here.withColumn("parent", F.col("key").bitwiseAND(_mask(d - 1))).join(upper, ["parent", "bit"])
        old, mixed = mixed, written(here.select("key", "bit", (F.col("so_far") + F.col("left_over") * F.col("weight") * F.col("kt")).alias("so_far"), (F.col("left_over") * (1 - F.col("weight"))).alias("left_over")), f"ctw-mix-{d}")
        for used in (old, nodes[d], by_depth[d]):
            if used is not None:
                forget(used)
    scores = written(leaf_scores(leaves, mixed.withColumn("deal", deal(F.col("key")))), "lm-grams")
    forget(mixed)
    return scores


def frequent(values: DataFrame, columns: list[str], entries: int) -> tuple[list[np.ndarray], DataFrame | None]:
    """The most frequent rows of (key, n_all, ...), at most `entries`, as arrays sorted by key, and the rest.

    Rows are taken down to the least power of two that n_all reaches such that they are few enough.
    """
    power = F.floor(F.log2(F.col("n_all").cast("double"))).cast("int")
    sizes = {r.p: r.n for r in values.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    took, least = 0, 64
    for p in sorted(sizes, reverse=True):
        if took + sizes[p] > entries:
            break
        took, least = took + sizes[p], p
    top = values.where(power >= least).select("key", *columns).toArrow()
    arrays = [top.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", *columns)]
    order = np.argsort(arrays[0].view(np.uint64)) if len(arrays[0]) else np.zeros(0, int)
    return [a[order] for a in arrays], (values.where(power < least) if took < sum(sizes.values()) else None)


def _look_up(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each asked key stands, whether it is there); both are unsigned and keys are sorted."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


PARTLY = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_counts double, score double, miss_key array<long>, miss_n array<int>"


def score_known(docs: DataFrame, gram_table: list[np.ndarray], word_table: list[np.ndarray], depth: int) -> DataFrame:
    """A row for each document: sums over what the broadcast tables have, and counts of what they haven't."""
    shared = docs.sparkSession.sparkContext.broadcast((gram_table, word_table))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (gram_keys, gram_score), (word_keys, word_n) = shared.value
        gram_keys, word_keys = gram_keys.view(np.uint64), word_keys.view(np.uint64)
        row = TaskContext.get().partitionId() << 33
        spare = min(12, 64 - 8 * (depth + 1))  # bits that a gram leaves for the number of its text
        low = np.uint64(spare)
        for part in parts:
            texts = part.column("text").to_pylist()
            coded = [symbols(t) for t in texts]
            out = []
            for some in _chunks(coded, 1 << spare):
                where = np.repeat(np.arange(len(some), dtype=np.uint64), [len(coded[i]) for i in some])
                pairs, times = _count_unique(grams([coded[i] for i in some], depth) << low | where)
                of, key = (pairs & np.uint64((1 << spare) - 1)).astype(np.int64), pairs >> low
                new = np.concatenate([[True], key[1:] != key[:-1]])
                at, there = _look_up(gram_keys, key[new])
                index = np.cumsum(new) - 1
                value = np.where(there, gram_score[at] if len(gram_score) else 0.0, 0.0)[index]
                total = np.bincount(of, value * times, len(some))
                missing = np.flatnonzero(~there[index])
                missing = missing[np.argsort(of[missing], kind="stable")]
                bounds = np.searchsorted(of[missing], np.arange(len(some) + 1))
                for k, (i, words) in enumerate(zip(some, word_hashes([texts[i] for i in some]), strict=True)):
                    asked, n = _count_unique(np.append(words, np.uint64(2**64 - 1)) | _WORD_BIT)
                    at, there = _look_up(word_keys, asked)
                    c = np.where(there, word_n[at] if len(word_n) else 0, 0)
                    m = missing[bounds[k] : bounds[k + 1]]
                    out.append((i, len(words) + 1, int(n[c > 0].sum()), float((n * np.log10(c + 1.0)).sum()), float(total[k]), np.concatenate([key[m].view(np.int64), asked[~there].view(np.int64)]), np.concatenate([times[m], n[~there]]).astype(np.int32)))
            out.sort(key=lambda r: r[0])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in out])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.concatenate([r[5] for r in out] or [np.zeros(0, np.int64)]), np.concatenate([r[6] for r in out] or [np.zeros(0, np.int32)]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(out))), part.column("doc_id"), part.column("held_out"), *[pa.array([r[j] for r in out], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))], *lists],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "log_counts", "score", "miss_key", "miss_n"],
            )
            row += len(out)

    return docs.select("doc_id", "text", "held_out").mapInArrow(work, PARTLY)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, entries: int = TABLE_ENTRIES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out")).withColumn("train", ~F.col("held_out"))
    counts = written(count_keys(rows, depth), "lm-counts")
    words = counts.where("key < 0")
    facts = words.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.count(F.when(F.col("n_train") > 0, 1)).alias("v")).first()
    scored = gram_scores(counts.where("key >= 0"), depth)
    gram_table, gram_rest = frequent(scored, ["score"], entries)
    word_table, word_rest = frequent(words, ["n_train"], entries)
    partly = written(score_known(rows, gram_table, word_table, depth), "lm-partly")
    nothing = partly.select("row", F.lit(0.0).alias("add_score"), F.lit(0.0).alias("add_logs"), F.lit(0).cast("long").alias("add_known"), "doc_id", "held_out", "n_tokens", "known", "log_counts", "score")
    rest = [d for d in (gram_rest and gram_rest.select("key", F.col("score").alias("value")), word_rest and word_rest.select("key", F.col("n_train").cast("double").alias("value"))) if d is not None]
    if rest:
        misses = partly.where(F.size("miss_key") > 0).select("row", F.explode(F.arrays_zip("miss_key", "miss_n")).alias("m")).select("row", F.col("m.miss_key").alias("key"), F.col("m.miss_n").alias("n"))
        is_word = F.col("key") < 0
        found = misses.join(rest[0] if len(rest) == 1 else rest[0].unionByName(rest[1]), "key").groupBy("row").agg(
            F.sum(F.when(is_word, 0.0).otherwise(F.col("n") * F.col("value"))).alias("add_score"),
            F.sum(F.when(is_word, F.col("n") * F.log10(F.col("value") + 1)).otherwise(0.0)).alias("add_logs"),
            F.sum(F.when(is_word & (F.col("value") > 0), F.col("n")).otherwise(0)).alias("add_known"),
        )
        nothing = nothing.drop("add_score", "add_logs", "add_known").join(found, "row", "left").na.fill(0, ["add_score", "add_logs", "add_known"])
    spread = math.log10(facts.n + facts.v + 1)
    return nothing.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("add_known")).alias("n_known"),
        F.lit(facts.n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.col("add_logs") - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("score") + F.col("add_score")).alias("score"),
    )


def op6_lm_score(spark, sf_dir):
    small_batches(spark)
    size_in_memory(spark)
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
