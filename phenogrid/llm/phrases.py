"""Collocations: phrases of two words and more that occur more often together than apart.

Phrases are counted level by level. While a pass over the texts counts phrases of k words, it also
counts those of k + 1 words into a fixed number of hash buckets. Buckets that reach the least count
become a bitmap, and so do the hashes of the phrases of k words that are frequent. The next pass
counts a phrase exactly only if its bucket is set and both phrases that it consists of but for one
word are frequent. Both bitmaps are of a fixed size and are broadcast; a bit that is set by chance
costs a count and changes no result, as what is counted exactly is compared with the least count again.

Bucket counts stop at the least count, which is all that is asked of them; so a task's counts are a
byte for each bucket however large the corpus is. Tasks count what they read before anything is
shuffled, and texts are read where they are.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows count as
often as they come; other columns aren't read. Words end at a space or a tab, and no phrase reaches
over `.,;:!?` or an end of line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import release, small_batches, table, written

MIN_COUNT, LONGEST, SHARE, FIRST = 10, 3, 50, 2000
#: Buckets are 2 to the power of this: a task holds a byte for each, and a bitmap a bit. They prune well while distinct phrases are up to a few times as many; a larger corpus wants more.
BUCKET_BITS = 26
#: Bytes of text that a task looks at together, and distinct words and phrases that it holds before it writes them.
BLOCK_BYTES, HELD_WORDS, HELD_PHRASES = 8 << 20, 1_000_000, 1_000_000
SEGMENT = 1 << 16

COUNTS = "lang string, phrase string, n long, segment int, places binary, counts binary"
NO_LANG = "und"

# One letter for another: lower case, spaces, and ends of pieces.
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_NOTHING, _BREAK = 0, 1


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def joined_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and a word after it."""
    x = (phrase ^ (phrase >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Buckets:
    """Counts of hashes by bucket, up to a least count."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least = bits, least
        self.counts = np.zeros(1 << bits, np.min_scalar_type(least))

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(places(hashes, self.bits), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n, self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The buckets that aren't empty, by segment: places within it and counts."""
        width = min(SEGMENT, len(self.counts))
        for s in range(len(self.counts) // width):
            part = self.counts[s * width : (s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield _rows(segment=[s], places=[at.astype(np.uint16).tobytes()], counts=[part[at].tobytes()])


def _rows(**given) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "segment": pa.int32(), "places": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Lang:
    """The words of a language that a task has met, and its phrases so far."""

    def __init__(self, name: str):
        self.name, self.ids = name, _Ids({b"": _NOTHING, b"\n": _BREAK})
        self.hashes, self.held, self.size = np.zeros(2, np.uint64), [], 0

    def read(self, texts: list[bytes]) -> np.ndarray:
        """The numbers of the words of some texts in order, breaks between pieces."""
        words = b"\n".join(texts).translate(_LETTERS).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        known = len(self.hashes)
        if len(self.ids) > known:
            new = [word_hash(self.name, w) for w in list(self.ids)[known:]]
            self.hashes = np.append(self.hashes, np.array(new, np.uint64))
        return found[found != _NOTHING]

    def add(self, phrases: np.ndarray) -> None:
        """Count the rows of an array of word numbers."""
        self.held.append(_distinct(phrases, np.ones(len(phrases), np.int64)))
        self.size += len(self.held[-1][0])
        if self.size > HELD_PHRASES:
            self.held = [_distinct(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    def rows(self, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        phrases, n = _distinct(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        words = pa.array(list(self.ids), pa.binary()).cast(pa.string())
        for at in range(0, len(n), most):
            some = phrases[at : at + most]
            text = pc.binary_join_element_wise(*(words.take(pa.array(some[:, j])) for j in range(some.shape[1])), " ")
            yield _rows(lang=pa.repeat(self.name, len(some)), phrase=text, n=n[at : at + most])


def _distinct(phrases: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    code = phrases[:, 0]
    for j in range(1, phrases.shape[1]):
        # Numbers of the phrase so far are below the number of rows, so that two fit one integer.
        code = np.unique(code, return_inverse=True)[1] << 32 | phrases[:, j]
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return phrases[first], np.bincount(at, n, len(first)).astype(np.int64)


class Level:
    """What a task counts in the pass for phrases of `words` words: these exactly, and longer ones by bucket if there is another pass."""

    def __init__(self, words: int, least: int, bits: int, frequent: np.ndarray | None, full: np.ndarray | None, more: bool):
        self.words, self.frequent, self.full = words, frequent, full
        self.bits, self.next = bits, Buckets(bits, least) if more else None
        self.langs: dict[str, _Lang] = {}
        self.waiting: dict[str, list[bytes]] = {}
        self.bytes = 0

    def feed(self, langs: list[str], texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        for lang, text in zip(langs, texts, strict=True):
            if text:
                self.waiting.setdefault(lang, []).append(text)
                self.bytes += len(text)
                if self.bytes >= BLOCK_BYTES:
                    yield from self.work()

    def work(self) -> Iterator[pa.RecordBatch]:
        for lang, texts in self.waiting.items():
            own = self.langs.setdefault(lang, _Lang(lang))
            self.count(own, own.read(texts))
        self.waiting, self.bytes = {}, 0
        if sum(len(x.ids) for x in self.langs.values()) > HELD_WORDS or sum(x.size for x in self.langs.values()) > HELD_PHRASES // 2:
            yield from self.release()

    def release(self) -> Iterator[pa.RecordBatch]:
        for own in self.langs.values():
            yield from own.rows()
        self.langs = {}

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.work()
        yield from self.release()
        if self.next:
            yield from self.next.rows()

    def count(self, own: _Lang, ids: np.ndarray) -> None:
        single, k = own.hashes[ids], self.words
        fits, hashes, shorter = ids != _BREAK, single, None
        for j in range(1, k):
            shorter, hashes = hashes, joined_hash(hashes[:-1], single[j:])
            fits = fits[:-1] & (ids[j:] != _BREAK)
        if k > 1:
            was = np.zeros(len(shorter), bool)
            own_place = np.flatnonzero(fits)
            near = np.union1d(own_place, own_place + 1)
            was[near] = is_set(self.frequent, places(shorter[near], self.bits))
            fits = fits & was[:-1] & was[1:]
            at = np.flatnonzero(fits)
            fits[at] = is_set(self.full, places(hashes[at], self.bits))
        at = np.flatnonzero(fits)
        if len(at):
            own.add(ids[at[:, None] + np.arange(k)])
        if self.next and len(fits) > 1:
            # A longer phrase consists of two that may be frequent.
            at = np.flatnonzero(fits[:-1] & fits[1:])
            self.next.add(joined_hash(hashes[at], single[at + k]))


def count_level(docs: DataFrame, words: int, frequent: np.ndarray | None, full: np.ndarray | None, more: bool, least: int = MIN_COUNT, bits: int = BUCKET_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One pass: rows of partial counts of phrases, and of buckets by segment."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((frequent, full))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        level = Level(words, least, bits, *shared.value, more)
        for part in parts:
            yield from level.feed(part.column(0).to_pylist(), part.column(1).to_pylist())
        yield from level.end()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)), F.col(text_col).cast("string").cast("binary"))
    return rows.mapInArrow(count, COUNTS)


def bitmap(rows: DataFrame, least: int = MIN_COUNT, bits: int = BUCKET_BITS) -> np.ndarray:
    """The buckets whose counts reach the least count, a bit each; what reaches the driver is these bits alone."""
    width = min(SEGMENT, 1 << bits)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, sums = None, np.zeros(width, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["segment", "bits"])
        for part in parts:
            for s, places, counts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if s != segment:
                    if segment is not None:
                        yield done()
                    segment, sums = s, np.zeros(width, np.int64)
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.min_scalar_type(least))
        if segment is not None:
            yield done()

    segments = rows.where("segment is not null").select("segment", "places", "counts")
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in segments.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold, "segment int, bits binary").collect():
        own = np.frombuffer(r.bits, np.uint8)
        out[r.segment * width // 8 : r.segment * width // 8 + len(own)] = own
    return out


def phrase_bitmap(phrases: DataFrame, words: int, least: int = MIN_COUNT, bits: int = BUCKET_BITS) -> np.ndarray:
    """A bit for the hash of each phrase."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Buckets(bits, least)
        for part in parts:
            if part.num_rows:
                split = [(lang, p.encode().split(b" ")) for lang, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                single = np.array([[word_hash(lang, w) for w in p] for lang, p in split], np.uint64)
                hashes = single[:, 0]
                for j in range(1, words):
                    hashes = joined_hash(hashes, single[:, j])
                seen.counts[places(hashes, bits)] = least
        yield from seen.rows()

    return bitmap(phrases.select("lang", "phrase").mapInArrow(hashed, COUNTS), least, bits)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, bits: int = BUCKET_BITS, text_col: str = "text", lang_col: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """(phrases of one word, of two, ...; each with lang, phrase, n of at least `least`), and (lang, n): all words of each language."""
    levels, totals, frequent, full = [], None, None, None
    for k in range(1, longest + 1):
        counted = written(count_level(docs, k, frequent, full, k < longest, least, bits, text_col, lang_col), f"phrases-{k}")
        partial = counted.where("phrase is not null")
        if k == 1:
            totals = written(partial.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        levels.append(written(partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"frequent-{k}"))
        if k < longest:
            frequent, full = phrase_bitmap(levels[-1], k, least, bits), bitmap(counted, least, bits)
    return levels, totals


def collocations(levels: list[DataFrame], share: int = SHARE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words and more that no longer one makes superfluous.

    A phrase cut after its first k words has l, r and a score, a million times a * a / (l * r) without
    its fraction; the cut of the lowest score counts, of equal ones the first. A phrase is dropped if
    one with a word more has at least `share` in a hundred of its occurrences: what is longer still is
    no more frequent, and lies in such a one.
    """
    one = lambda k, df: df.select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("a"))
    found = [one(k, df) for k, df in enumerate(levels, 1)]
    every, candidates = found[0], None
    for df in found[1:]:
        every, candidates = every.unionByName(df), df if candidates is None else candidates.unionByName(df)
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    words = lambda n: F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)
    first, rest = words(F.col("k")), words(F.col("k") - F.col("words"))
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cut = cut.withColumns({"first": first, "rest": rest}).join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    scored = cut.withColumns({"top": million * wide("a") * wide("a"), "below": wide("l") * wide("r")}).withColumn("score", F.expr("top div below"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("words > 2")
    held = longer.select("lang", F.explode(F.array(words(F.col("words") - 1), words(1 - F.col("words")))).alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a")))
    return kept.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def top_collocations(docs: DataFrame, first: int = FIRST, longest: int = LONGEST, least: int = MIN_COUNT, share: int = SHARE, bits: int = BUCKET_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first collocations of each language: (lang, rank, phrase, a, l, r, n, score)."""
    levels, totals = frequent_phrases(docs, longest, least, bits, text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(levels, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    # A row for each language.
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir):
    small_batches(spark)
    return top_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from worded where len(ws) > 0),
totals as (select lang, sum(len(ws)) as n from worded group by lang),
grams as (
  select lang, words, array_to_string(ws[i:i + words - 1], ' ') as phrase, cast(count(*) as hugeint) as a
  from places, (select unnest([1, 2, 3]) as words) where i + words - 1 <= len(ws)
  group by 1, 2, 3 having count(*) >= 10),
split as (select lang, words, phrase, a, string_split(phrase, ' ') as ws from grams where words > 1),
cuts as (select lang, words, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:words], ' ') as tail
  from split, (select unnest([1, 2]) as k) where k < words),
scored as (select c.lang, c.phrase, c.words, c.a, c.k, h.a as l, t.a as r, (1000000::hugeint * c.a * c.a) // (h.a * t.a) as score
  from cuts c join grams h on h.lang = c.lang and h.phrase = c.head and h.words = c.k
  join grams t on t.lang = c.lang and t.phrase = c.tail and t.words = c.words - c.k),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored),
held as (select lang, phrase, max(a) as held from (
  select lang, array_to_string(ws[1:2], ' ') as phrase, a from split where words = 3
  union all select lang, array_to_string(ws[2:3], ' '), a from split where words = 3) group by 1, 2),
kept as (select b.* from best b left join held h on h.lang = b.lang and h.phrase = b.phrase and b.words = 2
  where b.place = 1 and (h.held is null or 100 * h.held < 50 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, cast(r.rank as bigint) as rank, r.phrase, cast(r.a as bigint) as a, cast(r.l as bigint) as l, cast(r.r as bigint) as r, cast(t.n as bigint) as n, cast(r.score as bigint) as score
from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
