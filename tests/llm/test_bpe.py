from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from phenogrid.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.WordCoder(bpe.default_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))


def ids(coder, texts):
    return [np.frombuffer(b, np.int32).tolist() for b in coder.encode(texts)]


def by_library(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fuzzed_texts(coder, library):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÉİıßǅȺñ日本語 \t\n\x0b\x85\xa0 　'0123456789²½.,;!?-_<|>́̇Å가각Ω£😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("aeionstrh") for _ in range(rng.randint(1, 400))) for _ in range(600)]
    texts += [c * k for c in ("a", "ab", "!", "日", "aab") for k in range(1, 60)]
    texts += [None, "", " \n", "<|endoftext|>" * 2 + "x <|startoftext|>'s<|endo <|ENDOFTEXT|>"]
    expected = by_library(library, texts)
    assert ids(coder, texts) == expected
    assert [coder.decode(i) for i in expected[:2000]] == [library.decode(i, skip_special_tokens=False) for i in expected[:2000]]
    assert 0 < coder.failed < coder.proposed


def test_pairs_are_compatible_exactly_if_merging_keeps_them(coder):
    rng = np.random.default_rng(3)
    inner, last = list(coder.inner.items()), list(coder.last.items())
    pairs = [(inner[i], (inner if k % 2 else last)[j]) for k, (i, j) in enumerate(zip(rng.integers(0, len(inner), 4000), rng.integers(0, len(last) - 1, 4000), strict=True)) if j < len(inner)]
    short = [x for x in inner if len(x[0]) <= 2][:60]
    pairs += [(x, y) for x in short for y in short]
    found = coder.merges.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    for ((a, i), (b, j)), ok in zip(pairs, found, strict=True):
        letters = [coder.single[c][0] for c in a + b]
        if coder.names[j].endswith(coder.suffix):
            letters[-1] = coder.single[b[-1]][1]
        assert ok == (coder.merges.merge(letters) == [i, j])
    assert 0 < found.sum() < len(found)


def test_merging_without_verification_is_the_same(coder):
    """A file whose merges aren't sound goes by exact merging alone."""
    texts = ["tokenisation of uncommonly spelled words", "aaaa aaaaaaa abababab"]
    plain = bpe.WordCoder(bpe.default_path("word_bpe_49k.json"))
    plain.merges.sound = False
    assert ids(plain, texts) == ids(coder, texts)


def test_small_cache_and_blocks(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_LETTERS", 10)
    small = bpe.WordCoder(bpe.default_path("word_bpe_49k.json"), entries=3)
    texts = ["one two three four", None, "one two five six seven eight", "one"] * 3
    assert ids(small, texts) == by_library(library, texts)
    assert len(small.cache) <= 3


def test_a_file_without_word_ends():
    from tokenizers import Tokenizer

    path = bpe.default_path("byte_bpe_50k.json")
    texts = ["Hello  World's\n<|endoftext|> 日本 été 123", None, "aaaa   \t b" * 40]
    assert ids(bpe.WordCoder(path), texts) == by_library(Tokenizer.from_file(path), texts)


def test_what_is_not_supported_is_refused(tmp_path):
    import json

    kind = json.load(open(bpe.default_path("word_bpe_49k.json")))
    kind["model"]["unk_token"] = "!"
    (tmp_path / "odd.json").write_text(json.dumps(kind))
    with pytest.raises(ValueError, match="unk_token"):
        bpe.WordCoder(str(tmp_path / "odd.json"))


def test_operator_keeps_columns(spark, docs, rows, library):
    got = bpe.encode_bpe(docs, result_col="language").select("*", bpe.decode_bpe("language").alias("back")).collect()
    expected = sorted((r[0] is None, r[0] or 0, tuple(e)) for r, e in zip(rows, by_library(library, [r[1] for r in rows]), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.language)) for r in got) == expected
    assert all(r._mix == "y" and r.back == library.decode(list(r.language), skip_special_tokens=False) for r in got)
    null = spark.range(1).selectExpr("cast(null as array<int>) ids").select(bpe.decode_bpe("ids").alias("t")).first()
    assert null.t is None


def test_query_is_the_library(spark, docs, no_docs, rows, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r, i in zip(rows, by_library(library, [r[1] for r in rows]), strict=True):
        expected.append((r[0], len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, bpe.op11_bpe(spark, str(tmp_path)).collect()), key=key) == sorted(expected, key=key)
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op11_bpe(spark, f"{tmp_path}/none").count() == 0


def test_query_on_the_small_tables(spark, small, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.op11_bpe(spark, small).collect()}
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    for r, i in zip(texts, by_library(library, [r.text for r in texts]), strict=True):
        assert got[r.doc_id] == (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest())
