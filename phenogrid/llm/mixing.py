"""Mixing sources to target weights with soft membership.

A softmax regression over hashed words, learned from a bounded sample of the labelled table, gives
each document's posterior over domains. Each document gets a nonnegative rate, the expected number of
its copies, such that the expected tokens of each domain, rate times tokens times posterior, come as
near as can be to their targets. Tokens are those of a tokenizer, by token_counts. The least-squares
problem is solved by projected gradient steps: rates start at one, and a step changes a document's rate
by the domains' shortfalls weighted by its posterior, and never below zero. Shortfalls are scaled by the
inverse of the domains' Gram matrix over the documents above zero, so that few steps do; where such a
step gains little, three of four steps are plain ones, which always gain. A step takes one
aggregate over all documents, of a few numbers for each domain; rates are columns and never leave the
executors. Steps are taken until the targets are met or the shortfalls no longer change, which is
where no rates come nearer; should neither happen, the fit fails.

Defined cases: null and empty texts have no tokens, and keep the rate that their posterior, that of no
words, asks for; labels that are null or of unknown documents teach nothing; without any label all
posteriors are equal; targets that can't be met are met as nearly as nonnegative rates allow; an empty
table gives an empty result; repeated rows have a rate each; other columns are kept, and those with
the names of the result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.llm.common import forget, resident, small_batches, table, written
from phenogrid.llm.pretokens import PretokenCoder, default_path
from phenogrid.llm.shingles import word_hashes

#: Labelled documents of each domain that the classifier learns from, at most (about: they are drawn by a hash).
LABELLED_PER_DOMAIN = 2500
DIMENSIONS = 1 << 15
#: Targets are met when no domain is off by more than this share of all tokens. Posteriors are never quite zero, so a
#: closer fit, say of a domain to be left out, would take all documents but those that the classifier is surest of.
TOLERANCE = 1e-2
#: No step is taken at all if none is off by more than this.
MET = 1e-4
#: Steps after which a fit that neither meets its targets nor settles is an error.
MOST_STEPS = 300
STEPS_A_TABLE = 8
#: A plain step gains little if it lessens the squared shortfalls by a smaller share; three of these in a row end the fit.
LITTLE = 3e-3

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def word_keys(texts) -> list[tuple[np.ndarray, int]]:
    """(distinct hashed words, number of words) of each text; a word has letters and digits alone."""
    out = []
    for h in word_hashes([t if t else "" for t in texts], _LETTERS):
        out.append((np.unique((h >> np.uint64(40)).astype(np.int64) & (DIMENSIONS - 1)), len(h)))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_softmax(rows: list[np.ndarray], y: np.ndarray, classes: int, rounds: int = 150, ridge: float = 2e-5, rate: float = 0.5) -> np.ndarray:
    """(classes, DIMENSIONS + 1) weights, bias last, of a ridge softmax regression by adaptive gradient descent; classes weigh equally."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    w, seen = np.zeros((classes, DIMENSIONS + 1)), np.full((classes, DIMENSIONS + 1), 1e-8)
    hot = np.eye(classes)[y]
    balance = (len(y) / classes / np.maximum(hot.sum(axis=0), 1))[y]
    for _ in range(rounds):
        z = np.stack([np.bincount(of, w[c][flat], len(rows)) * scale + w[c][-1] for c in range(classes)], axis=1)
        off = (softmax(z) - hot) * balance[:, None]
        for c in range(classes):
            g = np.append(np.bincount(flat, (off[:, c] * scale)[of], DIMENSIONS), off[:, c].sum()) / len(y) + ridge * w[c]
            seen[c] += g * g
            w[c] -= rate * g / np.sqrt(seen[c])
    return w


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def hashed_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([k.astype(np.int32) for k, _ in word_keys(texts)])


def learn_domains(docs: DataFrame, domains: DataFrame, names: list[str], id_col: str, text_col: str, per_domain: int = LABELLED_PER_DOMAIN) -> np.ndarray | None:
    """Weights of the classifier. domains: (id, domain) of labelled documents."""
    known = domains.where(F.col("id").isNotNull() & F.col("domain").isin(names))
    counts = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit("domain")), F.lit(1 << 30)) / float(1 << 30)
    most = F.create_map(*[F.lit(v) for d, n in counts.items() for v in (d, min(1.0, per_domain / n))])
    some = known.where(draw < F.element_at(most, F.col("domain")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # About per_domain ids for each domain, so the drawn labels are a few hundred kB at most.
    drawn = texts.join(F.broadcast(some), "id").select("domain", hashed_words("text").alias("keys"))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        y = np.array([names.index(d) for d in part["domain"]])
        w = train_softmax([np.asarray(k, np.int64) for k in part["keys"]], y, len(names))
        prior = np.array([counts.get(n, 0) for n in names], float)
        w[:, -1] += np.log(np.maximum(prior / prior.sum(), 1e-6))
        return pd.DataFrame({"domain": range(len(names)), "weights": list(w)})

    trained = {r.domain: np.array(r.weights) for r in drawn.groupBy().applyInPandas(train, "domain int, weights array<double>").collect()}
    return np.array([trained[k] for k in range(len(names))]) if trained else None


def posteriors(docs: DataFrame, weights: np.ndarray | None, classes: int, text_col: str, result_col: str = "mix") -> DataFrame:
    """docs with a struct column (tokens, posterior)."""
    shared = docs.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

    @F.pandas_udf("tokens long, posterior array<double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for texts in parts:
            rows = word_keys(texts)
            if w is None:
                p = np.full((len(rows), classes), 1 / classes)
            else:
                z = [w[:, k].sum(axis=1) / np.sqrt(max(1, len(k))) + w[:, -1] for k, _ in rows]
                p = softmax(np.array(z, float).reshape(-1, classes))
            yield pd.DataFrame({"tokens": [n for _, n in rows], "posterior": list(p)})

    return docs.withColumn(result_col, predict(F.col(text_col).cast("string")))


def text_lengths(texts: Iterable[str | None], path: str) -> list[int]:
    """Tokens of each text; this worker's cache of whole words answers most of them, without taking words apart."""
    return list(map(resident(("text-lengths", path), lambda: PretokenCoder(path, len, sum)), texts))


def with_lengths(docs: DataFrame, text_col: str, path: str | None = None, result_col: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text."""
    path = path or default_path()

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(text_lengths(texts, path), dtype="int64")

    return docs.withColumn(result_col, count(F.col(text_col).cast("string")))


def rate_of(posterior: Column, pulls: list[list[float]], start: Column | float = 1.0) -> Column:
    """The rate after these steps: less, at each, what the document's posterior makes of its pull, never below zero."""
    start = F.lit(start) if isinstance(start, float) else start
    if not pulls:
        return start

    def step(x: Column, pull: Column) -> Column:
        return F.greatest(F.lit(0.0), x - sum((posterior[d] * pull[d] for d in range(len(pulls[0]))), F.lit(0.0)))

    return F.aggregate(F.array(*[F.array(*[F.lit(float(v)) for v in pull]) for pull in pulls]), start, step)


def fit_rates(rows: DataFrame, targets: list[float | None], tokens: str = "n_tokens", posterior: str = "posterior", most_steps: int | None = None) -> list[list[float]]:
    """The pulls of rate_of(); targets are tokens of each domain, None for as many as it has.

    Only tokens and posteriors are read, and every few steps written with the rates so far.
    """
    k = len(targets)
    p = [F.element_at(posterior, d + 1) for d in range(k)]

    def sums(base: DataFrame, x: Column) -> tuple[np.ndarray, np.ndarray]:
        """What the domains come to at rates x, and their Gram matrix over the rows above zero."""
        got = [F.coalesce(F.sum(F.col(tokens) * p[d] * F.col("x")), F.lit(0.0)) for d in range(k)]
        gram = [F.coalesce(F.sum(F.when(F.col("x") > 0, F.col(tokens) * p[a] * p[b])), F.lit(0.0)) for a in range(k) for b in range(k)]
        row = list(base.select(tokens, posterior, x.alias("x")).agg(*[c.alias(f"s{i}") for i, c in enumerate([*got, *gram])]).first())
        return np.array(row[:k]), np.array(row[k:]).reshape(k, k)

    base, old, pulls, pending = rows.select(tokens, posterior, F.lit(1.0).alias("rate")), None, [], []
    has, gram = sums(base, F.col("rate"))
    want = np.array([has[d] if targets[d] is None else targets[d] for d in range(k)])
    weight = 1 / np.maximum(has, 1.0)  # shortfalls count relative to what a domain has
    off = lambda got: float((((got - want) ** 2) * weight).sum())
    every = max(1.0, float(want.sum()))
    root = np.sqrt(weight)
    steepest = max(float(np.linalg.eigvalsh(gram * root[:, None] * root[None, :]).max()), 1e-12)
    got, length, settled, plain = has, 1.0, 0, False
    for n in range(most_steps or MOST_STEPS):
        if np.abs(got - want).max() <= (TOLERANCE if pulls or pending else MET) * every or settled >= 3:
            break
        ridge = 1e-9 * max(1.0, float(np.trace(gram))) * np.eye(k)
        move = weight * (got - want) / steepest if plain else length * np.linalg.solve(gram + ridge, got - want)
        pull = [float(v) for v in move]
        new, new_gram = sums(base, rate_of(F.col(posterior), [*pending, pull], F.col("rate")))
        gain = (off(got) - off(new)) / off(got)
        if plain:
            settled, plain = settled + 1 if gain <= LITTLE else 0, n % 4 != 0
        elif gain <= 0.01:
            plain, length = True, max(length / 4, 0.01)
        else:
            length = min(1.0, 2 * length)
        if gain <= 0:
            continue
        got, gram = new, new_gram
        pending.append(pull)
        if len(pending) >= STEPS_A_TABLE:
            base = written(base.select(tokens, posterior, rate_of(F.col(posterior), pending, F.col("rate")).alias("rate")), "mix-rates")
            pulls, pending = pulls + pending, []
            if old is not None:
                forget(old)
            old = base
    else:
        raise RuntimeError(f"rates did not settle; the domains' tokens are {got.tolist()}, their targets {want.tolist()}")
    return pulls + pending


def copies(rate: Column, id_col: str) -> Column:
    """Whole copies of a rate, by a hash of the id, so that the expected number is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(id_col, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30))


def rate_documents(docs: DataFrame, domains: DataFrame, weights: dict[str, float | None], id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, relative: bool = False, per_domain: int = LABELLED_PER_DOMAIN) -> DataFrame:
    """(doc, n_tokens, posterior, rate, copies): doc is a struct of the row as it was.

    weights: each domain's share of the budget, which is all tokens unless given; if relative, what its
    expected tokens are to be multiplied by; None for the tokens that it is expected to have.
    """
    names = list(weights)
    learned = learn_domains(docs, domains, names, id_col, text_col, per_domain)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    scored = with_lengths(posteriors(packed, learned, len(names), "text"), "text")
    scored = written(scored.select("doc", "id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("mix.posterior").alias("posterior")), "mix")
    k = len(names)
    if relative:
        sums = scored.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.element_at("posterior", d + 1)), F.lit(0.0)) for d in range(k)]).first()
        targets = [None if w is None else w * sums[d] for d, w in enumerate(weights.values())]
    else:
        if budget is None:
            budget = float(scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
        targets = [None if w is None else w * budget for w in weights.values()]
    steps = fit_rates(scored, targets)
    rated = scored.withColumn("rate", rate_of(F.col("posterior"), steps))
    return rated.select("doc", "n_tokens", "posterior", "rate", copies(F.col("rate"), "id").alias("copies"))


def mix(docs: DataFrame, domains: DataFrame, weights: dict[str, float | None], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """docs, or their columns `keep`, with n_tokens, posterior, rate and copies; options are those of rate_documents()."""
    rated = rate_documents(docs, domains, weights, id_col, text_col, **options)
    result = ["n_tokens", "posterior", "rate", "copies"]
    return rated.select(*[F.col("doc")[c].alias(c) for c in keep or docs.columns if c not in result], *result)


def label_domains(labels: DataFrame) -> DataFrame:
    """(id, domain) of the labels table: toxic, high or low."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").cast("long").alias("id"), domain.alias("domain")).where("id is not null and domain is not null").distinct()


def op7_mixing(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, label_domains(table(spark, sf_dir, "labels")), {"high": 0.7, "low": 0.3, "toxic": 0.0}, keep=["doc_id"])
    p = [F.element_at("posterior", k + 1).alias(n) for k, n in enumerate(("p_high", "p_low", "p_toxic"))]
    return mixed.select("doc_id", "n_tokens", *p, "rate", "copies")
