from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm import ann, decontaminate, language_id, lm_score, mixing, warc
from phenogrid.llm.common import new_folder

# Decontamination.


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute_hits(text, items, window):
    w, hit, who = words(text), set(), set()
    for item, t in items:
        q = words(t)
        size = min(window, len(q))
        if item is None or not size:
            continue
        patterns = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in patterns:
                hit.update(range(i, i + size))
                who.add(str(item))
    return len(w), len(hit), sorted(who)


@pytest.mark.parametrize(("block_windows", "piece"), [(1 << 20, 5000), (20, 7)])
def test_decontamination_equals_brute_force(spark, docs, rows, monkeypatch, block_windows, piece):
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", piece)
    t = [r[1] for r in rows]
    items = [(7, " ".join(t[0].split()[5:40]).upper()), (8, "one two"), (9, "one"), (10, None), (None, t[3]), (11, "!!"), (12, t[12]), (13, " ".join(t[0].split()[20:60])), (13, "a b c"), (14, " ".join(t[37].split()[29_000:29_040]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, block_windows=block_windows)
    assert sorted(got.columns) == sorted(docs.columns)  # the clashing column is replaced
    some = 0
    want = {(r[0], r[1]): brute_hits(r[1], items, 13) for r in rows}
    for r in got.withColumn("c", decontaminate.is_contaminated()).collect():
        n, hit, who = want[r.doc_id, r.text]
        assert (r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) == (n, hit, who)
        assert r.c == (hit > 0 and 20 * hit >= n)
        some += r.c
    assert some


def test_decontamination_of_nothing(spark, docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(no_docs, empty).count() == 0
    assert all(r.contamination.n_hit == 0 for r in decontaminate.find_contamination(docs, empty).collect())


# Nearest neighbours.


def vectors(n=700, dim=12):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[50:60] = x[50]  # ties
    x[60:90] = x[60] + rng.normal(size=(30, dim)) * 1e-3
    return [(i, v.tolist(), "e") for i, v in enumerate(x)]


def truth(rows, k=5):
    x = np.array([v for _, v, _ in rows])
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in range(0, len(rows), 50):
        s = (x * x[q]).sum(axis=1) / (n * n[q])
        s[q] = -9
        out[q] = [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(s)), -s))[:k]]
    return out


def test_nearest(spark):
    rows = vectors()
    odd = [(1000, None, "e"), (1050, [0.0] * 12, "e"), (1100, [1.0, None] + [0.0] * 10, "e"), (1150, [float("nan")] * 12, "e"), (1200, [1.0, 2.0], "e"), (None, rows[0][1], "e"), (1250, [float("inf")] * 12, "e")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, query_id string").repartition(3)
    want = truth(rows)
    for radius, least in ((64, 1.0), (None, 0.9), (0, 0.9)):
        got = collections.defaultdict(list)
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, radius=radius).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
        hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
        if least == 1.0:
            assert got == want
        elif radius is None:
            assert hits >= least * 5 * len(want)


def test_nearest_of_tiny_huge_and_repeated(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e190]), (2, [1.0, 1.0]), (2, [1.0, 0.5]), (50, [3e-310, 3e-310]), (50, [0.0, 1.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    half = round(math.sqrt(0.5), 6)
    # The least of 50's vectors asks, (0, 1); rows of 2 count once, with the nearer.
    assert got[:4] == [(0, 1, 1.0), (0, 2, round(1 / math.sqrt(1.25), 6)), (0, 50, half), (0, 7, -1.0)]
    assert [g[1] for g in got[4:]] == [2, 1, 0, 7]


def test_the_query_of_nearest(spark, small):
    rows = [(r.vec_id, r[1], "e") for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()]
    want = {q: v for q, v in truth(rows).items()}
    got = collections.defaultdict(list)
    for r in ann.op1_ann(spark, small).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert {q % 50 for q in got} == {0} and set(got) == set(want)
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.nearest(spark.createDataFrame([], df.schema), F.col("vec_id") == 0).count() == 0


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[100:140] = codes[0] ^ np.array([1, 0, 3, 0], np.uint16)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 9, 26, 64):
        for q in (0, 5, 120):
            assert set(index.within(codes[q], radius)) == set(np.flatnonzero(ann._distances(codes, codes[q]) <= radius))


# WARC.


def test_warc_round_trip(spark):
    long = "é" * 3000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a.example/x?q=1", "<p>" + "a" * 200, "k"), (2, "http://b.example", "<p>" + "a" * 200, "k"), (3, "ftp odd\r\nurl", long, "k"), (5, None, None, "k"), (6, "http://c/", "", "k"), (7, "http://c/", "tiny", "k"), (8, "http://d/", "tiny", "k"), (9, "http://e/", long, "k"), (9, "http://e/", long, "k"), (None, "http://n/", long, "k"), (1, "http://a.example/y", "<p>" + "a" * 200, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    folder = new_folder(spark, "test-warc")
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records).collect()
    assert len(captures) == len(rows) and all(c.requests and c.metadata for c in captures)
    for c in captures:
        if c.response.type == "response":
            assert c.response.payload_digest == "sha256:" + c.response.payload_sha256
            assert hashlib.sha256(c.response.block.partition(b"\r\n\r\n")[2]).hexdigest() == c.response.payload_sha256
    kinds = collections.Counter(c.response.type for c in captures)
    assert kinds == {"response": 8, "revisit": 3}  # 2 revisits 1; both rows of 9 revisit 3; both rows of 1 are responses


def test_warc_links_of_other_writers(spark):
    text = "\r\n\r\n".join(
        ["\r\n".join(h) + "\r\n\r\n" + b for h, b in [
            (["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <i>", "Content-Length: 2"], "ab"),
            (["WARC/1.0", "WARC-Type: request", "WARC-Record-ID: <q>", "Content-Length: 0"], ""),
            (["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <r>", "WARC-Concurrent-To: <q>", "Content-Type: application/http; msgtype=response", "Content-Length: 7"], "H\r\n\r\nxy"),
            (["WARC/1.0", "WARC-Type: metadata", "WARC-Record-ID: <m>", "WARC-Concurrent-To: <q>", "Content-Type: application/warc-fields", "Content-Length: 8"], "a: b\r\n\r\n"),
        ]]
    ) + "\r\n\r\n"
    rows = [r | {"fields": dict(r["fields"])} for r in warc._parse(text.encode(), True)]
    assert [r["type"] for r in rows] == ["warcinfo", "request", "response", "metadata"]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert len(got) == 1 and got[0].response.payload_bytes == 2
    assert [r.record_id for r in got[0].requests] == ["<q>"] and [m.record_id for m in got[0].metadata] == ["<m>"]


def test_warc_of_nothing(spark):
    folder = new_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0


# Language.


def test_language_held_out_accuracy(spark, medium):
    got = language_id.op4_language_id(spark, medium).join(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(docs, no_docs, rows):
    out = language_id.with_language(docs)
    assert out.columns == docs.columns
    got = {r.text: r.language for r in out.collect()}
    for r in rows:
        assert (got[r[1]].lang == "und") == (not r[1] or not any(c.isalpha() for c in r[1]))
    assert language_id.with_language(no_docs).count() == 0
    nothing = language_id.identify(docs, None)
    assert {r.language.lang for r in nothing.collect()} == {"und"}
    alone = language_id.with_language(docs.where("lang = 'en'")).where("text like '%a%'").collect()
    assert {r.language.lang for r in alone} == {"en"}


def test_features_of_pieces(monkeypatch):
    text = "Ein längerer Text, über Dörfer und Städte. " * 40
    whole = language_id.features(text)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert np.allclose(language_id.features(text), whole, atol=1e-6)


def test_families_are_learned():
    rng = np.random.default_rng(1)
    base = rng.random((3, 50))
    means = np.concatenate([b + rng.random((3, 50)) / 20 for b in base])
    names = [f"{f}{i}" for f in "xyz" for i in range(3)]
    assert language_id.group_languages(names, means) == {f + "0": [f + str(i) for i in range(3)] for f in "xyz"}
    assert language_id.group_languages(["a"], means[:1]) == {"a": ["a"]}


def test_machines_come_within_half_a_percent_of_the_optimum():
    """Against plain gradient descent on the same objective."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(80, 5)), np.ones((80, 1))], axis=1).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0.2, 1, -1)
    share = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * (w @ w) + 10 * (share * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = np.zeros(6)
    for _ in range(60_000):
        w -= 1e-4 * (w - 20 * ((share * np.maximum(0, 1 - y * (x @ w)) * y) @ x))
    got = language_id.train_svm(x, y, rounds=400)
    assert loss(got.astype(float)) <= loss(w) * 1.005


# Language-model scores.


def plain_ctw(texts, train, depth):
    """Scores by the definition: a tree for each node of the byte's binary code."""
    count, kids = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(s):
        s = b"\xfe" * depth + s
        for j in range(depth, len(s)):
            for k in range(8):
                yield s[j - depth : j], (1 << k) | (s[j] >> (8 - k)), s[j] >> (7 - k) & 1

    for t, learn in zip(texts, train, strict=True):
        if learn:
            for c, node, bit in steps(t):
                for d in range(depth + 1):
                    count[c[depth - d :], node][bit] += 1
                    if d < depth:
                        kids[c[depth - d :], node].add(c[depth - d - 1 :])
    memo = {}

    def log_w(c, node):
        if (c, node) not in count:
            return 0.0
        if (c, node) not in memo:
            a, b = count[c, node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(c) == depth:
                memo[c, node] = (1.0, own)
            else:
                below = sum(log_w(x, node) for x in kids[c, node])
                most = max(own, below)
                memo[c, node] = (1 / (1 + math.exp(min(700, below - own))), most + math.log(math.exp(own - most) + math.exp(below - most)) - math.log(2))
        return memo[c, node][1]

    def prob(c, node, bit, d=0):
        s = c[depth - d :]
        if (s, node) not in count:
            return 0.5
        log_w(s, node)
        a, b = count[s, node]
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        w = memo[s, node][0]
        return kt if d == depth else w * kt + (1 - w) * prob(c, node, bit, d + 1)

    return [sum(math.log10(prob(*x)) for x in steps(t)) for t in texts]


@pytest.mark.parametrize("entries", [2_000_000, 40])
def test_scores_equal_plain_ones(spark, docs, rows, entries):
    some = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    df = spark.createDataFrame(some, docs.schema).repartition(2)
    out = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    got = lm_score.score_texts(df, out, depth=3, entries=entries).collect()
    held = [r[0] is not None and r[0] % 3 == 1 for r in some]
    plain = plain_ctw([lm_score.symbols(r[1]) for r in some], [not h for h in held], 3)
    tokens = [[*(r[1] or "").encode().lower().split(), 0] for r in some]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r, t, s in zip(some, tokens, plain, strict=True):
        want[str(r[0]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5), round(s, 5)] += 1
    assert want == collections.Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got)
    assert {r.train_tokens for r in got} == {n}


def test_scores_beat_the_baseline_on_held_out_text(spark, medium):
    rows = lm_score.op6_lm_score(spark, medium).where("held_out").collect()
    assert sum(r.score for r in rows) < 0 and all(r.n_known <= r.n_tokens for r in rows)


def test_scores_of_nothing(no_docs):
    assert lm_score.score_texts(no_docs, F.lit(False)).count() == 0


# Mixing.


def test_mixing_meets_targets(spark, medium):
    got = mixing.op7_mixing(spark, medium).toPandas()
    total = got.n_tokens.sum()
    share = [(got.n_tokens * got.rate * got[c]).sum() / total for c in ("p_high", "p_low", "p_toxic")]
    assert abs(share[0] - 0.7) < 0.02 and abs(share[1] - 0.3) < 0.02 and share[2] < 0.02
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    labels = spark.read.parquet(f"{medium}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert ((both.p_toxic > 0.5) == (both.toxic == 1)).mean() > 0.97


@pytest.mark.parametrize("want", [(300.0, 250.0, 0.0), (0.0, 0.0, 2000.0)])
def test_rates_are_as_near_as_can_be(spark, want):
    """Against plain projected gradient steps, very many of them; the last targets can't be met."""
    rng = np.random.default_rng(4)
    n, p = rng.integers(0, 30, 60).astype(float), rng.dirichlet([0.7, 0.7, 0.7], 60)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    steps = mixing.fit_rates(rows, list(want))
    got = rows.withColumn("rate", mixing.rate_of(F.col("posterior"), steps)).toPandas()
    a = (n[:, None] * p).T
    has = a.sum(axis=1)
    goal = np.array([h if w is None else w for h, w in zip(has, want, strict=True)])
    off = lambda r: (((a @ r - goal) ** 2) / np.maximum(has, 1)).sum()
    r = np.ones(60)
    for _ in range(60_000):
        r = np.maximum(0, r - 0.01 * (((a @ r - goal) / np.maximum(has, 1)) @ (a / np.maximum(n, 1))))
    assert (got.rate >= 0).all() and off(got.rate.to_numpy()) <= 1.01 * off(r) + 1e-3 * max(1.0, goal.sum()) and len(steps) < mixing.MOST_STEPS


def test_a_fit_that_does_not_settle_fails(spark):
    rows = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.4, 0.6])], "n_tokens long, posterior array<double>")
    with pytest.raises(RuntimeError, match="settle"):
        mixing.fit_rates(rows, [0.0, 3.0], most_steps=1)


def test_mixing_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(12, 30)] + [(None, "a"), (999, "b"), (5, None)], "id long, domain string")
    out = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert out.columns == [*docs.columns, "n_tokens", "posterior", "rate", "copies"]
    got = out.collect()
    assert len(got) == docs.count() and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in got)
    assert mixing.mix(no_docs, labels, {"a": 1.0, "b": 0.0}).count() == 0
    alike = mixing.mix(docs, labels.limit(0), {"a": None, "b": None}).collect()
    assert all(list(r.posterior) == [0.5, 0.5] and r.rate == 1.0 and r.copies == 1 for r in alike)


def test_crc_is_of_the_id_as_text(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in df.where(language_id.held_out()).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_tables_of_language_scores_fit_a_small_driver():
    entries = 2 * lm_score.TABLE_ENTRIES  # of grams and of words
    assert entries * 16 <= 16 << 20
