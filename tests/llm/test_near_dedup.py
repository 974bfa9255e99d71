from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.llm.components import connected_components
from phenogrid.llm.near_dedup import banding, drop_near_duplicates, near_duplicates, signature
from phenogrid.llm.shingles import _hash_words, shingle_set, word_hashes


def sets_of(rows, size):
    out = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        s = {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        if r[0] is not None:
            out[r[0]] = s
    return out


def brute_force(sets, percent):
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.85), (5, 0.8)])
def test_groups_equal_brute_force(docs, rows, size, threshold):
    sets = sets_of(rows, size)
    want = brute_force(sets, round(100 * threshold))
    got = near_duplicates(docs, size, threshold).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(set(want.values())) < len(want)


def test_drop_keeps_columns_and_rows_without_id(docs):
    left = drop_near_duplicates(docs, 3, 0.85)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert None in ids and 0 in ids and 40 not in ids


def test_nothing(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (40, 300, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 10] = rng.integers(0, 2**63, n // 10).astype(np.uint64)
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((signature(np.unique(a)) == signature(np.unique(b))).mean() - truth) < 0.1
    few = rng.integers(0, 2**63, 3).astype(np.uint64)
    assert (signature(few) == signature(few)).all() and signature(few).max() < 0xFFFFFFFF


def test_early_stop_changes_nothing():
    from phenogrid.llm import near_dedup

    h = np.unique(np.random.default_rng(1).integers(0, 2**63, 60).astype(np.uint64))
    # Drawn one after another over all rounds, as the definition has it.
    slow = np.full(near_dedup.POSITIONS, 0xFFFFFFFF, np.int64)
    for e in h:
        p = list(range(near_dedup.POSITIONS))
        for j in range(near_dedup.POSITIONS):
            with np.errstate(over="ignore"):
                draw = int(near_dedup.mix(np.array([e + near_dedup._STEP * np.uint64(j + 1)], np.uint64))[0])
            k = j + ((draw >> 32) * (near_dedup.POSITIONS - j) >> 32)
            p[j], p[k] = p[k], p[j]
            slow[p[j]] = min(slow[p[j]], j << 24 | draw & 0xFFFFFF)
    assert (slow == signature(h)).all()


def test_banding_misses_few():
    for t in (0.8, 0.85, 0.9):
        bands, rows = banding(t)
        assert bands * rows <= 256 and (1 - t**rows) ** bands <= 1e-5


def test_words_across_pieces_and_batches():
    texts = ["A b\x0bc", None, "", "x" * 2_000_000 + " tail", "B a"]
    h = word_hashes(texts)
    assert [len(x) for x in h] == [3, 0, 0, 2, 2] and h[0][0] == h[4][1] and h[0][1] == h[4][0]
    assert _hash_words(b"tail")[0][0] == h[3][1]
    assert len(shingle_set(h[0], 3)) == 1 and len(shingle_set(h[1], 3)) == 0 and len(shingle_set(h[4], 3)) == 1


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_with_several_texts(spark):
    """One id joins the groups of its texts; dropping goes by texts, and none is lost."""
    t, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuv")
    rows = [(3, t), (5, t), (5, u), (9, u), (9, ""), (11, v), (None, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("text_key", F.lit("x"))
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 3, 0.85).collect()]
    assert sorted(g for g in got if g[0] is not None) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (11, 11, True)]
    left = drop_near_duplicates(df, 3, 0.85)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == sorted([(3, t), (5, u), (9, ""), (11, v), (-1, u)])
