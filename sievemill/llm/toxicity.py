"""Toxicity by a classifier chain of linear models (operator 1)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievemill.llm.boosting import labels, learnable
from sievemill.llm.common import documents, map_texts, q

#: The most labelled rows that the chain is fitted on.
MAX_LABELLED = 6_000
#: A word is a feature if it is in so many documents, and the likelihood ratio of its counts is so large (half of G, which
#: has one degree of freedom: p < 0.001).
MIN_DOCUMENTS, LEAST_RATIO = 8, 5.4
FOLDS = 5
#: Word beginnings of these lengths are features beside whole words.
STEMS = (4, 5, 6)
L2 = 0.1
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")

#: Seed words by which a toxic document is also an example of a category.  The chain learns further words.
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "trash", "fool", "jerk"),
    "contempt": ("stupid", "pathetic", "worthless", "disgusting", "dumb", "useless", "hate"),
}
#: In the order of the chain; the last is the label itself.
CHAIN = (*CATEGORIES, "toxic")


def words(text: str) -> set[str]:
    """The words of a text in lower case, and the beginnings of longer ones (with a hyphen), which inflected forms share."""
    found = set(_WORD.findall(text.lower()))
    return found.union(*({w[:k] + "-" for w in found if len(w) > k} for k in STEMS))


@dataclass
class Chain:
    """Linear models in a row: each sees the words and the probabilities of those before it."""

    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def predict(self, texts: list[str]) -> np.ndarray:
        """Probabilities, a column for each category of CHAIN."""
        x = presence(texts, self.vocabulary)
        for w in self.weights:
            x = np.c_[x, _probability(x, w)]
        return x[:, len(self.vocabulary) :]


def presence(texts: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    for k, text in enumerate(texts):
        hits = [vocabulary[w] for w in words(text) if w in vocabulary]
        x[k, hits] = 1
    return x


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 30) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with an L2 penalty on the others."""
    rate = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    full = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], l2), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = full @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w))

    now = loss(w)
    for _ in range(steps):
        p = _probability(x, w)
        gradient = full.T @ (p - y) + penalty * w
        hessian = full.T @ (full * (p * (1 - p))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
        if now - after < 1e-6 * max(1.0, now):
            break
        now = after
    return w


def vocabulary_of(texts: list[str], toxic: np.ndarray) -> dict[str, int]:
    """The words whose presence tells of the label, by a likelihood ratio of at least LEAST_RATIO, of those in at least
    MIN_DOCUMENTS documents, however many they are; seed words always.  Words of toxic documents only are counted, a text
    at a time."""
    n1, n0 = max(1.0, toxic.sum()), max(1.0, (1 - toxic).sum())
    one: Counter[str] = Counter()
    for text, t in zip(texts, toxic, strict=True):
        if t:
            one.update(words(text))
    zero = dict.fromkeys(one, 0)
    for text, t in zip(texts, toxic, strict=True):
        if not t:
            for w in words(text):
                if w in zero:
                    zero[w] += 1
    score = {}
    for w, a in one.items():
        b = zero[w]
        if a + b >= MIN_DOCUMENTS and a / n1 > b / n0:
            p, q0, r = a / n1, b / n0, (a + b) / (n1 + n0)
            score[w] = a * np.log(p / r) + (b * np.log(q0 / r) if b else 0)
    best = sorted((w for w in score if score[w] >= LEAST_RATIO), key=lambda w: (-score[w], w))
    seeds = [w for ws in CATEGORIES.values() for w in ws]
    chosen = dict.fromkeys(seeds + best)
    return {w: k for k, w in enumerate(chosen)}


def fit(texts: list[str], toxic: np.ndarray) -> Chain:
    """The chain.  In training, a later model sees out-of-fold probabilities of the earlier ones: those that models
    fitted without the row's fold give it, so it learns how far they can be trusted on new rows.  The seed words of
    a category, which its labels come from, and their beginnings aren't inputs of its own model: it tells the category
    by what else is said."""
    vocabulary = vocabulary_of(texts, toxic)
    x = presence(texts, vocabulary)
    fold = np.arange(len(texts)) % FOLDS
    weights = []
    for name in CHAIN:
        seeds = [vocabulary[w] for w in CATEGORIES.get(name, ())]
        y = toxic * (x[:, seeds].any(1) if seeds else 1.0)
        seen = x.copy()
        seen[:, [vocabulary[w] for s in CATEGORIES.get(name, ()) for w in words(s) if w in vocabulary]] = 0
        out_of_fold = np.zeros(len(texts))
        for k in range(FOLDS):
            rest = fold != k
            out_of_fold[~rest] = _probability(seen[~rest], logistic(seen[rest], y[rest]))
        weights.append(logistic(seen, y))
        x = np.c_[x, out_of_fold]
    return Chain(vocabulary, weights)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", limit: int = MAX_LABELLED) -> Chain:
    """A chain fitted on at most `limit` labelled documents, those of the smallest hash of their id; each set of words
    once, and of rows that share an id one (that of the least words).  Rows whose crc32(id as text) mod 5 is 0 are left out, so they can measure it."""
    sample = learnable(labelled, "toxic", id_col, limit)
    rows = docs.select(F.col(q(id_col)).alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "_id")
    found = map_texts(
        rows,
        lambda texts: {"words": [" ".join(sorted(set(_WORD.findall(x.lower())))) for x in texts]},
        [T.StructField("words", T.StringType())],
        keep=["_id", "label"],
    )
    got = found.groupBy("_id").agg(F.first("label").alias("label"), F.min("words").alias("words")).orderBy("_id")
    once = {r["words"]: r["label"] for r in reversed(got.collect())}
    return fit(list(once), np.array(list(once.values()), dtype=np.float64))


def score_toxicity(df: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with a probability p_<category> for each category of the chain, and predicted_toxic (1 if that of the
    last, toxic, is at least the threshold, else 0), from the whole text.  Null texts count as empty; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(texts: list[str]) -> dict[str, list]:
        p = np.concatenate([shared.value.predict(texts[k : k + 512]) for k in range(0, len(texts), 512)])
        return {f"p_{c}": p[:, k] for k, c in enumerate(CHAIN)} | {"predicted_toxic": (p[:, -1] >= threshold).astype(np.int32)}

    added = [T.StructField(f"p_{c}", T.DoubleType()) for c in CHAIN] + [T.StructField("predicted_toxic", T.IntegerType())]
    return map_texts(df, run, added, text, keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_toxicity(docs, train(docs, labels(spark, sf_dir)), keep=["doc_id"])
