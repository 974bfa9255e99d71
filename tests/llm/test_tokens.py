from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from phenogrid.llm import token_counts, token_files
from phenogrid.llm.common import new_folder
from phenogrid.llm.pretokens import PretokenCoder, default_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_coder_equals_library_on_odd_strings(library):
    coder = PretokenCoder(default_path(), tuple, lambda x: sum(x, ()), entries=500)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "1", "é", "²", ".", ",", "<|endoftext|>", "日", "\xa0", "\r\n", "the", "\x1c", "ß", "😀", "​", "٣"]
    for _ in range(5000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert list(coder(s)) == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_other_tokenizers_are_used_whole():
    path = default_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    coder = PretokenCoder(path, tuple, lambda x: sum(x, ()))
    assert not coder.by_pretoken
    assert list(coder("Some Words, here")) == library.encode("Some Words, here", add_special_tokens=False).ids


def test_counts(docs, rows, library):
    got = token_counts.count_tokens(docs, sample_documents=10, entries=50)
    assert got.columns == [*docs.columns, "n_tokens"]
    want = sorted((str(r[0]), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want


def test_the_table_is_asked_first(library):
    table = {" the": 1, "the": 1, " cat": 1}
    counter = token_counts.TwoTiers(default_path(), table)
    text = "the cat saw the unusualcatword"
    assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert (counter.hits, counter.misses) == (3, 2)
    assert counter(text) and (counter.hits, counter.misses) == (6, 4)
    assert not set(table) & set(counter.coder.pieces)


def test_the_queries_themselves(spark, docs, rows, library, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    want = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op8_token_counts(spark, f"file://{tmp_path}").collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(w), len(w) > 512) for r, w in zip(rows, want, strict=True))
    digest = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_files.op9_token_files(spark, f"file://{tmp_path}").collect())
    assert digest == sorted((str(r[0]), len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for r, w in zip(rows, want, strict=True))


def test_counts_of_nothing(no_docs):
    assert token_counts.count_tokens(no_docs).count() == 0


def test_files_round_trip(spark, docs, rows, library):
    folder = new_folder(spark, "test-tokens")
    token_files.write_token_files(docs, folder)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at, ids_of = 0, {}
    for r in rows:
        ids_of.setdefault(r[0], []).append([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in ids_of[r.doc_id]
        at += r.n_tokens
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    crc = token_files.read_token_files(spark, folder).select("doc_id", "ids", token_files.ids_crc32("ids").alias("c")).collect()
    assert all(r.c == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in crc)


def test_files_of_nothing(spark, no_docs):
    assert token_files.token_digest(spark, no_docs).count() == 0


def test_files_prune_by_id(spark, docs):
    folder = new_folder(spark, "test-tokens")
    token_files.write_token_files(docs, folder)
    plan = spark.read.schema(token_files.SCHEMA).orc(folder).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_mixing_counts_words_that_it_knows_whole(spark, docs, rows, monkeypatch):
    from phenogrid.llm import mixing, token_counts

    path = default_path()
    text = "Known words stay known, whatever comes between them."
    first = mixing.text_lengths([text, None, ""], path)
    monkeypatch.setattr(PretokenCoder, "pretokens", lambda *_: pytest.fail("a known word was taken apart"))
    monkeypatch.setattr(PretokenCoder, "_word", lambda *_: pytest.fail("a known word was asked again"))
    assert mixing.text_lengths([text, None, ""], path) == first == [first[0], 0, 0]
    monkeypatch.undo()
    key = ["doc_id", "text"]
    one, two = (sorted(map(str, f(docs.select(*key), "text").collect())) for f in (mixing.with_lengths, token_counts.count_tokens))
    assert one == two


def test_learning_languages_gives_back_what_a_worker_kept():
    import pandas as pd

    from phenogrid.llm import common, language_id

    common.resident(("some", "cache"), dict)
    list(language_id.sparse_features.func(iter([pd.Series(["a text"])])))
    assert not common._resident
    common.resident(("some", "cache"), dict)
    language_id._mean_vector(pd.DataFrame({"lang": ["en"], "x": [b""]}))
    assert not common._resident


def test_printable_words_are_looked_up_without_the_general_way(monkeypatch):
    """Words of printable ASCII are matched at once; counts are the library's."""
    from phenogrid.llm.pretokens import PretokenCoder, default_path

    coder = PretokenCoder(default_path(), len, sum)
    texts = ["so a1b2 (x)... don't $5.00 we're 'tis x''s --y__ 3rd ~ \\ a<b", "so e.g. 0x7f'll #1!? [z]'d"]
    want = [len(coder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert coder("so ") == len(coder.tokenizer.encode("so ", add_special_tokens=False).ids)
    coder("so")  # a text's first word goes the general way
    monkeypatch.setattr(coder, "pretokens", lambda text: 1 / 0)
    assert [coder(t) for t in texts] == want
