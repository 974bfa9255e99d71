"""Language identification in two steps.

First the language's family is predicted, by one linear support vector machine per family against the
rest; then one-versus-one linear support vector machines vote between the languages of that family.
Families are learned, too: languages whose mean feature vectors lie nearest are joined, by average
linkage, until there are about as many families as languages in each (the root of their number).
Features are hashed counts of one to three letters in a row, scaled to length one, of the whole
lower-cased text; everything that isn't a letter is a word boundary.

The machines are trained by Spark tasks, one each, on a bounded number of labelled texts per language
drawn by a hash of their ids; every document is predicted.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if
nothing could be learned; labels of null teach nothing; a row with a null id can teach nothing and isn't held
out; equal votes go to the larger sum of margins, then to the first name; repeated rows are predicted
one by one; other columns are kept, and one with the name of the result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import crc_mod, release, small_batches, table, written

#: Labelled texts per language that a machine learns from, at most.
TEXTS_PER_LANGUAGE = 1000
DIMENSIONS = 4096
UNKNOWN = "und"

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


#: Characters of a text that are looked at together.
PIECE = 1 << 18


def features(text: str) -> np.ndarray:
    counts, before = np.zeros(DIMENSIONS), np.zeros(0, np.uint32)
    for start in range(0, len(text), PIECE):
        c = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (c >= 0xC0) | ((c >= 0x61) & (c <= 0x7A)) | (c == 0xAA) | (c == 0xB5) | (c == 0xBA)
        k, c = len(before), np.concatenate([before, np.where(letter, c, np.uint32(0x20))])
        h = c * _MIX[0]
        two = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[1] + c[1:] * _MIX[2]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[0] + c[2:] * _MIX[1]
        for x, seen in ((h, k), (two, max(0, k - 1)), (three, max(0, k - 2))):
            counts += np.bincount((x[seen:] * _MIX[2] >> _SHIFT).astype(np.int64), minlength=DIMENSIONS)
        before = c[-2:]
    x = np.sqrt(counts).astype(np.float32)
    size = np.sqrt((x * x).sum())
    return x / size if size else x


def group_languages(names: list[str], means: np.ndarray) -> dict[str, list[str]]:
    """Families of languages by the cosines of their mean vectors: {first language: languages}."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike, groups = unit @ unit.T, [[i] for i in range(len(names))]
    while len(groups) > math.ceil(math.sqrt(len(names))):
        pairs = [(float(alike[np.ix_(groups[a], groups[b])].mean()), -a, -b) for a in range(len(groups)) for b in range(a)]
        _, a, b = max(pairs)
        groups[-b] += groups.pop(-a)
    return {names[min(g)]: [names[i] for i in sorted(g)] for g in groups}


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; y is 1 or -1. The last column is one, for the bias."""
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * share)
    square = (x * x).sum(axis=1) + diagonal
    w, alpha, rng = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * float(x[i] @ w) - 1 + alpha[i] * diagonal[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Machines:
    """family: a machine for each family; pairs: for each family (languages, pairs of their numbers, weights)."""

    def __init__(self, weights: dict[str, np.ndarray], by: dict[str, list[str]]):
        self.names = sorted(by)
        zero = np.zeros(DIMENSIONS + 1, np.float32)
        self.family = np.array([weights.get(f"f|{f}", zero) for f in self.names])
        self.pairs = []
        for f in self.names:
            pairs = list(combinations(range(len(by[f])), 2))
            self.pairs.append((by[f], pairs, np.array([weights.get(f"p|{by[f][a]}|{by[f][b]}", zero) for a, b in pairs]).reshape(-1, DIMENSIONS + 1)))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        out = []
        of_family = x @ self.family[:, :-1].T + self.family[:, -1]
        for row, margins in zip(x, of_family, strict=True):
            f = int(np.argmax(margins))
            p = sure(margins)
            score = float(p[f] / p.sum()) if len(margins) > 1 else 1.0
            langs, pairs, w = self.pairs[f]
            votes, total, trust = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
            for (a, b), m in zip(pairs, w[:, :-1] @ row + w[:, -1], strict=True):
                votes[a if m > 0 else b] += 1
                total[a] += m
                total[b] -= m
                trust[a] += sure(m)
                trust[b] += sure(-m)
            best = max(range(len(langs)), key=lambda i: (votes[i], total[i], -i))
            out.append((langs[best], score * (float(trust[best]) / (len(langs) - 1) if pairs else 1.0)))
        return out


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TEXTS_PER_LANGUAGE) -> Machines | None:
    """Train on labelled rows: at most per_language texts of each language, drawn by a hash of the id."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    # About a half more than wanted passes by the hash alone; the window then has few rows to rank.
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.5 * per_language / n))])
    draw = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < F.element_at(share, F.col("lang"))).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).where(F.col("k") <= per_language)
    # What is shuffled is the vectors of the drawn texts, which are of a bounded size, not the texts.
    vectors = written(some.select("lang", sparse_features("text").alias("x")), "lang-vectors")
    means = {r.lang: np.array(r.mean) for r in vectors.groupBy("lang").applyInPandas(_mean_vector, "lang string, mean array<double>").collect()}
    names = sorted(means)
    by = group_languages(names, np.array([means[n] for n in names])) if names else {}
    # (machine, language, side) for each language that a machine learns from.
    plan = [(f"f|{f}", lang, 1 if lang in by[f] else -1) for f in by for lang in names if len(by) > 1]
    plan += [(f"p|{a}|{b}", lang, side) for langs in by.values() for a, b in combinations(langs, 2) for lang, side in ((a, 1), (b, -1))]
    if not plan:
        return Machines({}, by) if by else None
    machines = labelled.sparkSession.createDataFrame(plan, "machine string, lang string, side int")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        release()
        x = np.ones((len(part), DIMENSIONS + 1), np.float32)
        x[:, :-1] = _dense(part["x"])
        w = train_svm(x, part["side"].to_numpy())
        return pd.DataFrame({"machine": [part["machine"].iloc[0]], "weights": [w.astype(float)]})

    trained = vectors.join(F.broadcast(machines), "lang").groupBy("machine").applyInPandas(train, "machine string, weights array<double>")
    return Machines({r.machine: np.array(r.weights, np.float32) for r in trained.collect()}, by)


@F.pandas_udf(T.BinaryType())
def sparse_features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The places and values of features() that aren't zero, six bytes each."""
    release()
    for texts in parts:
        out = []
        for t in texts:
            x = features(t)
            at = np.flatnonzero(x)
            out.append(x[at].tobytes() + at.astype(np.uint16).tobytes())
        yield pd.Series(out, dtype=object)


def _dense(packed: pd.Series) -> np.ndarray:
    out = np.zeros((len(packed), DIMENSIONS), np.float32)
    for row, data in zip(out, packed, strict=True):
        n = len(data) // 6
        row[np.frombuffer(data, np.uint16, n, 4 * n)] = np.frombuffer(data, np.float32, n)
    return out


def _mean_vector(part: pd.DataFrame) -> pd.DataFrame:
    release()
    return pd.DataFrame({"lang": [part["lang"].iloc[0]], "mean": [_dense(part["x"]).mean(axis=0).astype(float)]})


def identify(docs: DataFrame, machines: Machines | None, text_col: str = "text", result_col: str = "language") -> DataFrame:
    """docs with a struct column (lang, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        known = shared.value
        for texts in parts:
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            asked = [i for i, t in enumerate(texts) if known is not None and t and any(map(str.isalpha, t))]
            for at in range(0, len(asked), 256):
                some = asked[at : at + 256]
                for i, found in zip(some, known.predict(np.array([features(texts.iloc[i]) for i in some])), strict=True):
                    out[i] = found
            yield pd.DataFrame(out, columns=["lang", "score"])

    return docs.withColumn(result_col, predict(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id", modulus: int = 4) -> Column:
    return F.coalesce(crc_mod(id_col, modulus) == 2, F.lit(False))


def with_language(docs: DataFrame, result_col: str = "language") -> DataFrame:
    """Learn from the labelled rows that aren't held out, and predict all."""
    return identify(docs, learn(docs.where(~held_out()), "doc_id", "text", "lang"), result_col=result_col)


def identify_rows(docs: DataFrame) -> DataFrame:
    """(doc, text, language): with_language() where doc is a struct of the row, so that no name can clash."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    return identify(packed, learn(docs.where(~held_out()), "doc_id", "text", "lang"))


def op4_language_id(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_language(docs).select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
