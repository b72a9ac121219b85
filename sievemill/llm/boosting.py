"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 3)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievemill.llm.common import documents, map_texts, q

#: The most labelled rows that a model is fitted on (those of the smallest hash of their id).
MAX_LABELLED = 20_000
THRESHOLD = 0.3
BINS = 64
_MARKS = "|#$%&*.,;:!?<>{}[]()=_/\\\"'@"
_LAST = re.compile(r"[.!?…]$")

FEATURES = [
    "log_chars", "log_words", "log_lines", "word_mean", "word_std", "word_max", "distinct_words", "top_word", "repeat_word",
    "longest_run", "distinct_pairs", "top_pair", "alpha", "digit", "upper", "blank", "symbol", "wide", "marked_words",
    "symbol_words", "distinct_lines", "repeated_line_chars", "line_mean", "short_lines", "ended_lines", "packed", "entropy",
    *[f"mark_{ord(c):02x}" for c in _MARKS],
]


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; all are finite, also for an empty one."""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counted = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    longest = run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        if run > longest:
            longest = run
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    raw = text.encode()
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = octets[octets > 0] / max(1, len(raw))
    alpha = int(octets[65:91].sum() + octets[97:123].sum())
    digit, upper, blank = int(octets[48:58].sum()), int(octets[65:91].sum()), int(octets[9:14].sum() + octets[32])
    wide = int(octets[128:].sum())
    symbol = int(octets[33:127].sum()) - alpha - digit
    by_line = Counter(lines)
    total = max(1, len(raw))
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), float(sizes.mean()), float(sizes.std()),
        min(1e6, float(sizes.max())), len(counted) / m, max(counted.values(), default=0) / m, same / m, longest / m,
        len(pairs) / m, max(pairs.values(), default=0) / m, alpha / total, digit / total, upper / total, blank / total,
        symbol / total, wide / total, sum(not w.isalpha() for w in words) / m, sum(not w[:1].isalnum() for w in words) / m,
        len(by_line) / k, sum(len(x) * (c - 1) for x, c in by_line.items()) / n, n / k,
        sum(len(x) < 30 for x in lines) / k, sum(bool(_LAST.search(x.rstrip())) for x in lines) / k,
        len(zlib.compress(raw, 1)) / total, float(-(share * np.log2(share)).sum()) if len(share) else 0.0,
        *[octets[ord(c)] / total for c in _MARKS],
    ]


@dataclass
class Trees:
    """All trees in flat arrays: node k tests values[:, feature[k]] > threshold[k] and goes on at child[k] or the
    node after it; a leaf is its own child, with an infinite threshold."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probabilities: all rows go down all trees at once, a level at a time."""
        if not len(self.root):
            return np.full(len(values), 1 / (1 + math.exp(-self.base)))
        out = np.empty(len(values))
        for start in range(0, len(values), 1024):
            part = values[start : start + 1024]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.root, (len(part), len(self.root))).copy()
            for _ in range(self.depth):
                node = self.child[node] + (part[rows, self.feature[node]] > self.threshold[node])
            out[start : start + 1024] = self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(out + self.base, -500, 500)))


def fit(
    values: np.ndarray, labels: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, leaf: int = 20, l2: float = 1.0
) -> Trees:
    """Boosted trees for the logistic loss on features cut at quantiles into at most BINS bins.

    Without rows, or with labels of one kind, the score is a constant: the smoothed share of label 1.
    """
    n = len(labels)
    rate_of = (labels.sum() + 1) / (n + 2)
    base = math.log(rate_of / (1 - rate_of))
    empty = np.zeros(0, dtype=np.int64)
    if n < 2 or labels.min() == labels.max():
        return Trees(empty, empty, np.zeros(0), empty, np.zeros(0), depth, base)
    leaf = min(leaf, max(1, n // 20))
    width = values.shape[1]
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], values[:, f], side="left") for f in range(width)], 1).astype(np.int64)
    offset = np.arange(width) * BINS
    slots = binned + offset
    margin = np.full(n, base)
    root, feature, threshold, child, value = [], [], [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = labels - p, p * (1 - p)
        root.append(len(feature))

        def add() -> int:
            k = len(feature)
            feature.append(0)
            threshold.append(math.inf)
            child.append(k)
            value.append(0.0)
            return k

        level = [(add(), np.arange(n))]
        for d in range(depth + 1):
            following = []
            for k, rows in level:
                g, h = grad[rows], hess[rows]
                step = rate * g.sum() / (h.sum() + l2)
                split = None
                if d < depth and len(rows) >= 2 * leaf:
                    at = slots[rows].ravel()
                    size = width * BINS
                    hg = np.bincount(at, np.repeat(g, width), size).reshape(width, BINS).cumsum(1)
                    hh = np.bincount(at, np.repeat(h, width), size).reshape(width, BINS).cumsum(1)
                    hn = np.bincount(at, minlength=size).reshape(width, BINS).cumsum(1)
                    tg, th, tn = g.sum(), h.sum(), len(rows)
                    gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                    gain[(hn < leaf) | (tn - hn < leaf)] = -1
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        split = f, b
                if split is None:
                    value[k] = step
                    margin[rows] += step
                    continue
                f, b = split
                feature[k], threshold[k] = f, edges[f][b]
                left, right = add(), add()
                child[k] = left
                goes = binned[rows, f] > b
                following += [(left, rows[~goes]), (right, rows[goes])]
            level = following
    return Trees(
        np.array(root), np.array(feature), np.array(threshold), np.array(child), np.array(value), depth, base
    )


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return map_texts(df, lambda texts: {"stats": [statistics(x) for x in texts]}, [T.StructField("stats", T.ArrayType(T.DoubleType()))], text, keep)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", limit: int = MAX_LABELLED) -> Trees:
    """A model fitted on the labelled documents whose crc32(id as text) mod 5 isn't 0, at most `limit` of them, those with
    the smallest hash of their id.  Rows with a null id or label aren't used; of conflicting labels the mean counts, rounded.
    Of rows that share an id one is used (that of the least statistics), so no more than `limit` come to the driver."""
    sample = learnable(labels, label, id_col, limit)
    rows = docs.select(F.col(q(id_col)).alias("_id"), F.col("text")).join(F.broadcast(sample), "_id")
    got = measured(rows, keep=["_id", "label"]).groupBy("_id").agg(F.first("label").alias("label"), F.min("stats").alias("stats")).orderBy("_id").collect()
    if not got:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r["stats"] for r in got]), np.array([r["label"] for r in got], dtype=np.float64))


def learnable(labels: DataFrame, label: str, id_col: str, limit: int) -> DataFrame:
    """(_id, label) of at most `limit` labelled rows that aren't held out."""
    ids = F.col(q(id_col))
    rows = labels.where(ids.isNotNull() & F.col(q(label)).isNotNull() & (F.crc32(ids.cast("string")) % 5 != 0))
    rows = rows.groupBy(ids.alias("_id")).agg(F.round(F.avg(F.col(q(label)))).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def score_quality(df: DataFrame, model: Trees, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold, else 0), for every row, from its whole text.

    Null texts count as empty; equal texts get equal scores; columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        score = shared.value.score(np.array([statistics(x) for x in texts]))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(df, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text, keep)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, labels(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
