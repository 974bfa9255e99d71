from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, contamination string, _mix string, language string"


def make_docs() -> list[tuple]:
    """Nulls everywhere, empty and very long texts, ties, repeats and near copies, and columns with clashing names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = []

    def add(i, text, lang="en"):
        rows.append((i, text, lang, "s0", 3, "x", "y", "z"))

    base = [rng.choice(words) for _ in range(120)]
    for i in range(12):  # near copies of one text
        w = list(base)
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = rng.choice(words)
        add(i, " ".join(w) + ("\nSame line here, number one.\nsame LINE here number one" if i % 2 else ""), "en" if i % 2 else "fr")
    for i in range(12, 30):
        add(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))), rng.choice(["en", "fr", "de", None]))
    add(30, None, "en")
    add(31, "")
    add(32, " \t\n ")
    add(33, "one")
    add(34, "one two")
    add(35, "ONE   two")
    add(36, "12 34 !! ??", "de")
    add(37, " ".join(rng.choice(words) for _ in range(30_000)))  # very long
    add(38, "x" * 40_000)
    add(39, "Caffè déjà <|endoftext|> 日本語　テキスト\x85 é\tü\r\n  '' don't", "fr")
    add(None, "no id at all for this text", None)
    add(40, rows[0][1])
    add(40, rows[0][1])  # a repeated row
    add(41, None, None)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
