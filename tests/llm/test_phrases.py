from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from phenogrid.llm import phrases


def brute(rows, longest=3, least=10, share=50, first=2000):
    """(lang, text) rows; every phrase counted in a dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        over = [x for (o, q), x in f.items() if o == lang and len(q) > len(p) and x >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= share * a for x in over):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def make(seed=1, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "(x)", "a\x00b", "\x85", "it's"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None]), text))
    return [*rows, ("en", None), ("en", ""), ("fr", "   "), (None, "New York City " * 2000), ("en", "x" * 30_000), *rows[:3], ("de", "a b c d e. " * 30), ("de", "b c d. " * 10)]


@pytest.mark.parametrize(("bits", "longest", "least"), [(24, 3, 10), (3, 3, 10), (16, 4, 3), (10, 2, 300)])
def test_brute_force(spark, bits, longest, least):
    rows = make()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, rank int").repartition(4)
    got = phrases.top_collocations(docs, longest=longest, least=least, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, longest, least)
    assert len(expected) > 2 and sorted(map(tuple, got.collect())) == expected


def test_bounded_blocks_and_holdings(spark, monkeypatch):
    """Tasks that write what they hold again and again count the same."""
    rows = make(7)
    whole = phrases.Level(1, 10, 12, None, None, True)
    small = phrases.Level(1, 10, 12, None, None, True)
    feed = lambda level: [b for at in range(0, len(rows), 10) for b in level.feed([r[0] or "und" for r in rows[at : at + 10]], [r[1].encode() if r[1] else None for r in rows[at : at + 10]])]
    one = [*feed(whole), *whole.end()]
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 300)
    monkeypatch.setattr(phrases, "HELD_WORDS", 15)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 10)
    two = [*feed(small), *small.end()]

    def summed(batches):
        out = Counter()
        for b in batches:
            for r in b.to_pylist():
                if r["phrase"] is not None:
                    out[r["lang"], r["phrase"]] += r["n"]
        return out

    assert len(two) > len(one) and summed(one) == summed(two)
    assert (whole.next.counts == small.next.counts).all()


def test_pruning_leaves_rare_phrases_uncounted():
    """With bitmaps of what is frequent, a pass counts no phrase whose parts or bucket are rare."""
    text = b" ".join([b"new york"] * 20 + [b"rare%d words%d" % (i, i) for i in range(200)])
    seen = phrases.Buckets(20, 10)
    for w in (b"new", b"york"):
        seen.counts[phrases.places(np.array([phrases.word_hash("en", w)], np.uint64), 20)] = 10
    frequent = np.packbits(seen.counts >= 10, bitorder="little")
    level = phrases.Level(2, 10, 20, frequent, np.full(1 << 17, 255, np.uint8), False)
    out = {r["phrase"] for b in [*level.feed(["en"], [text]), *level.end()] for r in b.to_pylist()}
    assert {"new york", "york new"} <= out and len(out) < 5


def test_numbers_beyond_64_bits(spark):
    """A phrase of 4e9 occurrences: a million times its square passes 64 bits."""
    n = 4_000_000_000
    one = spark.createDataFrame([("en", "a", n), ("en", "b", n + 1)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", n - 1)], "lang string, phrase string, n long")
    row = phrases.collocations([one, two]).first()
    assert (row.score, row.l, row.r) == (1_000_000 * (n - 1) ** 2 // (n * (n + 1)), n, n + 1)


def test_empty_table(spark, no_docs):
    assert phrases.top_collocations(no_docs).count() == 0


def test_first_of_each_language(spark):
    rows = make(3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, phrases.top_collocations(docs, first=2, least=5).collect()))
    assert got == brute(rows, least=5, first=2)
