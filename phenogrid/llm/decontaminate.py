"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of every benchmark item: `window` consecutive words, or the whole item if
it has fewer. All patterns of one length share a shift table over blocks of two words, which says
how far the search may jump when a block ends at the current word, and a suffix table, whose bucket
for a block that ends some pattern holds the patterns to compare directly.

Words are maximal runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII.

Defined cases: a null or word-less text has no words and is never contaminated; null or word-less
benchmark items have no windows, nor has an item without id; repeated rows and ids are judged row by
row; an empty benchmark leaves every document clean; a column of the input with the name of the
result column is replaced, all other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import lower_ascii, small_batches, table, written

#: A broadcast holds about so many windows, half a kilobyte each in a worker; a larger benchmark is searched block by block.
BLOCK_WINDOWS = 200_000
#: Windows of a piece that an item is cut into, so that an item may be larger than a block.
PIECE_WINDOWS = 5_000

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(low if (low := ord(chr(b).lower()) if b < 0x80 else b) in _WORD_BYTES else 0x20 for b in range(256))

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Patterns:
    """The tables of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of(text)
            if item is None or not w:
                continue
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                owners.setdefault(tuple(w[i : i + size]), set()).add(item)
        self.by_length: dict[int, tuple[dict, dict]] = {}
        for pattern, who in owners.items():
            size = len(pattern)
            block = min(2, size)
            shift, bucket = self.by_length.setdefault(size, ({}, {}))
            for end in range(block, size + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            bucket.setdefault(pattern[-block:], {})[pattern] = sorted(who)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of each occurrence."""
        n = len(words)
        for size, (shift, bucket) in self.by_length.items():
            block, get = min(2, size), shift.get
            most = size - block + 1
            end = size
            while end <= n:
                key = tuple(words[end - block : end])
                jump = get(key, most)
                if jump:
                    end += jump
                    continue
                who = bucket[key].get(tuple(words[end - size : end]))
                if who:
                    yield end - size, size, who
                end += 1


def _scan(patterns, text: pd.Series, spans: pd.Series | None, items: pd.Series | None) -> pd.DataFrame:
    rows = []
    for i, t in enumerate(text):
        words = words_of(t)
        found: list[tuple[int, int]] = [] if spans is None else [(s["first"], s["last"]) for s in spans.iloc[i]]
        who: set[str] = set() if items is None else set(items.iloc[i])
        for first, size, owners in patterns.search(words):
            found.append((first, first + size - 1))
            who.update(owners)
        merged: list[list[int]] = []
        for first, last in sorted(found):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        hit = sum(last - first + 1 for first, last in merged)
        rows.append((len(words), hit, sorted(who), [{"first": a, "last": b} for a, b in merged]))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])


def pieces_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, text, n): the items' words in pieces of n windows that each lie whole in one piece."""
    words = F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("words")).where("item is not null and size(words) > 0")
    last = F.greatest(F.lit(0), F.size("words") - window)
    cut = items.select("item", "words", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(PIECE_WINDOWS))).alias("at"))
    return cut.select("item", F.array_join(F.slice("words", F.col("at") + 1, F.lit(PIECE_WINDOWS + window - 1)), " ").alias("text"), F.least(F.lit(PIECE_WINDOWS), F.col("last") - F.col("at") + 1).alias("n"))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_windows: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's windows in blocks of a checked size."""
    pieces = pieces_of(benchmark, item_col, text_col, window)
    size = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = 1 + size // block_windows
    for k in range(n):
        part = pieces if n == 1 else pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def _first_search(shared):
    @F.pandas_udf(RESULT)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            yield _scan(shared.value, text, None, None)

    return search


def _next_search(shared):
    @F.pandas_udf(RESULT)
    def search(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, spans, items in parts:
            yield _scan(shared.value, text, spans, items)

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, result_col: str = "contamination", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a struct column: words, hit words, the items found and the merged spans of hit words."""
    sc = docs.sparkSession.sparkContext
    text = F.col(text_col).cast("string")
    out = docs
    for k, items in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_windows)):
        shared = sc.broadcast(Patterns(items, window))
        if k == 0:
            out = out.withColumn(result_col, _first_search(shared)(text))
        else:
            # A table between two blocks keeps a worker from holding more than one block's tables.
            out = written(out, "decontaminate")
            out = out.withColumn(result_col, _next_search(shared)(text, F.col(f"{result_col}.spans"), F.col(f"{result_col}.items")))
    return out


def is_contaminated(result_col: str = "contamination", share: int = 20):
    """At least one word in `share` is hit."""
    c = F.col(result_col)
    return (c["n_hit"] > 0) & (share * c["n_hit"] >= c["n_words"])


def op10_decontaminate(spark, sf_dir):
    small_batches(spark)
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
with d as (select doc_id, coalesce({_WORDS.format(t="text")}, []) as ws from documents),
b as (select item_id, {_WORDS.format(t="text")} as ws from benchmark where item_id is not null and text is not null),
bs as (select item_id, ws, least(13, len(ws)) as size from b where len(ws) > 0),
bw as (select distinct item_id, size, array_to_string(ws[i + 1 : i + size], ' ') as win from bs, unnest(range(len(ws) - size + 1)) t(i)),
dw as (select doc_id, s.size, i, array_to_string(ws[i + 1 : i + s.size], ' ') as win from d, (select distinct size from bw) s, unnest(range(greatest(0, len(ws) - s.size + 1))) t(i)),
hits as (select doc_id, i, dw.size, item_id from dw join bw on dw.size = bw.size and dw.win = bw.win),
spots as (select doc_id, count(distinct i + k) as n_hit from hits, unnest(range(hits.size)) t(k) group by doc_id),
who as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join spots using (doc_id) left join who using (doc_id)
"""
