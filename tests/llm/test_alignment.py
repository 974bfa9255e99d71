from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from phenogrid.llm import alignment
from phenogrid.llm.alignment import Aligned, Aligner, default_path


@pytest.fixture(scope="module")
def own():
    return Aligner(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain(own):
    """The two libraries on whole texts, aligned by offsets."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True

    def align(text):
        if not text:
            return [], [], [], []
        whole = (" " + text).encode()
        a, b = library.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        a_bytes, b_bytes = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], [], [], []
        ends = [{}, {}]
        for side, tokens in enumerate((a_bytes, b_bytes)):
            at = 0
            for k, t in enumerate(tokens):
                at += len(t)
                ends[side][at] = k + 1
        common = sorted(ends[0].keys() & ends[1].keys())
        sizes = [np.diff([0, *(e[c] for c in common)]).tolist() for e in ends]
        return a, b, *sizes

    return align


def columns(own, texts):
    return [x.to_pylist() for x in Aligned(own.lengths, *own.stored(texts)).columns()]


def digest(text, plain, counts, best):
    a, b, m, n = plain(text)
    i, j = np.cumsum(m) - 1, np.cumsum(n) - 1
    links = [(a[x], b[y]) for x, y in zip(i, j, strict=True)]
    parts = []
    for x, y, k, l in zip(i, j, m, n, strict=True):
        parts.append(",".join(map(str, a[x - k + 1 : x + 1])) + "|" + ",".join(map(str, b[y - l + 1 : y + 1])))
    sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
    return len(a), len(b), len(m), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha


def brute(texts, plain):
    counts: Counter = Counter()
    for t in texts:
        a, b, m, n = plain(t)
        counts.update((a[x], b[y]) for x, y in zip(np.cumsum(m) - 1, np.cumsum(n) - 1, strict=True))
    best: dict = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return counts, best


def test_fuzzed_texts(own, plain):
    rng = random.Random(1)
    letters = [*"  abcdeÉİı日本語 \t\n\x0b\x85\xa0 　'0123²½.,;!?-_<|>​́Å가😀\x00\x1c\r▁  ", "  ", "\n\n", "</s>", "<s>", "<0x41>", "<|endoftext|>", " the", "The", ");\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "▁", " ", "   ", "a ", "\n", "x" * 5000, "word " * 3000]
    assert own.cut
    expected = [tuple(plain(t)) for t in texts]
    got = columns(own, texts)
    assert [tuple(g[k] for g in got) for k in range(len(texts))] == expected
    assert 50 < sum(not e[0] for e in expected) < 4000
    whole = Aligner(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
    whole.cut = False
    assert columns(whole, texts[:500]) == columns(own, texts[:500])


def test_small_cache_and_blocks(own, plain, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LETTERS", 10)
    small = Aligner(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"), entries=3)
    texts = ["one two three four", None, "one two five six seven eight", "one", ""] * 3
    assert columns(small, texts) == [list(x) for x in zip(*map(plain, texts), strict=True)]
    assert len(small.young) + len(small.old) < 12 and len(small.a.words) + len(small.a.words.old) <= 3


def test_records_keep_the_order():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000))
    words = alignment.digits(values).view("<u8").ravel()
    assert (np.diff(words.astype(object)) >= 0).all()
    assert (alignment.undigits(words) == values).all()


def test_pair_counts_over_many_shards(spark, tmp_path):
    rng = np.random.default_rng(5)
    keys = alignment.pack(rng.integers(0, 50, 20_000), rng.integers(0, 40, 20_000))
    rows = [(int(k), int(n)) for k, n in zip(keys, rng.integers(1, 9, len(keys)), strict=True)]
    folder = f"file://{tmp_path}/counts"
    alignment.write_pair_counts(spark.createDataFrame(rows, "key long, n long").repartition(5), folder, shard_pairs=70)
    expected: Counter = Counter()
    for k, n in rows:
        expected[k] += n
    counts = alignment.PairCounts(f"{tmp_path}/counts")
    assert len(counts.shards) > 20
    asked = np.unique([*keys, *(keys + 1), 0, 1 << 47])
    assert counts.lookup(asked).tolist() == [expected[int(k)] for k in asked]
    got = {(r.a_id, r.b_id): r.n for r in alignment.read_pair_counts(spark, folder).collect()}
    assert got == {(k & (1 << 24) - 1, k >> 24): n for k, n in expected.items()}


def test_shards_hold_the_sums_of_partial_counts(spark, docs):
    tokens = alignment.tokenize(docs)
    whole = {r.key: r.n for r in alignment.partial_counts(tokens).groupBy("key").sum("n").toDF("key", "n").collect()}
    assert sum(whole.values()) > 30_000
    folder = alignment.count_pairs(tokens)
    read = {alignment.pack(np.int64(r.a_id), np.int64(r.b_id)).item(): r.n for r in alignment.read_pair_counts(spark, folder).collect()}
    assert read == whole


def test_operator_keeps_columns(spark, docs, rows, plain):
    counts, best = brute([r[1] for r in rows], plain)
    got = alignment.align(docs, result_col="language").collect()
    for r in got:
        a, b, m, n = plain(r.text)
        links = [(a[x], b[y]) for x, y in zip(np.cumsum(m) - 1, np.cumsum(n) - 1, strict=True)]
        x = r.language
        assert (x.a_ids, x.b_ids, x.a_sizes, x.b_sizes) == (a, b, m, n) and r._mix == "y"
        assert x.counts == [counts[p] for p in links] and x.best == [counts[p] == best[p[1]] for p in links]
    assert len(got) == len(rows)


def test_texts_of_another_corpus(spark, docs, no_docs):
    other = spark.createDataFrame([("never seen before: zyzzyva",)], "text string")
    row = alignment.align_tokens(alignment.tokenize(other), alignment.count_pairs(alignment.tokenize(no_docs))).first().aligned
    assert row.a_ids and set(row.counts) == {0} and set(row.best) == {True}


def test_query_is_brute_force(spark, docs, no_docs, rows, plain, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    counts, best = brute([r[1] for r in rows], plain)
    key = lambda r: (r[0] is None, *map(str, r))
    expected = sorted(((r[0], *digest(r[1], plain, counts, best)) for r in rows), key=key)
    assert sorted(map(tuple, alignment.op12_alignment(spark, f"file://{tmp_path}").collect()), key=key) == expected
    no_docs.write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert alignment.op12_alignment(spark, f"file://{tmp_path}/none").count() == 0


def test_query_on_the_small_tables(spark, small, plain):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    counts, best = brute([r.text for r in texts], plain)
    got = {r[0]: tuple(r)[1:] for r in alignment.op12_alignment(spark, small).collect()}
    assert got == {r.doc_id: digest(r.text, plain, counts, best) for r in texts}
