"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other: a logistic model over hashed features of the
text, then, for each later category, one that also sees the probabilities of all earlier
ones.  In training those are out-of-fold predictions, so a later model learns from
probabilities as unsure as the ones that it will meet.

Features of a text, each once: its lower-cased words, and their first four, five and six
characters, which carry inflected forms.  They are hashed into 2^20 buckets.  Each model
weighs the buckets that tell its category apart in its own training rows (a chi-squared
statistic of at least ``CHI2``, the ``MOST`` highest; the rest have weight 0), so one such
word counts the same in a short text and in a long one.

The label table knows one category, ``toxic``.  The chain predicts that first and then
``severe``, derived from it (weakly labelled, see ``severe_of``): toxic documents in which
words that mark toxic documents are no rarer than in the median toxic document.  ``fit``
takes any list of 0/1 columns.

The training sample holds at most ``max_rows`` labelled documents, chosen by hash of
doc_id; every document of the corpus is scored, whole.

Defined cases: null doc_id: no row.  Null or empty text: no features, so the intercepts'
probabilities.  Repeated rows: scored and returned each.  A label row with a null is
ignored; contradicting labels count as toxic.  A sample in which a category is constant:
that constant's smoothed rate for every document.  Empty tables: no rows; without labels all
probabilities are 0.5 and nothing is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_sample, project, table

BUCKETS = 1 << 20
MAX_ROWS = 6_000
FOLDS = 4
FLAG = 0.5
CHI2, MOST = 15.0, 8_192
_WORD = re.compile(r"\w+")
CATEGORIES = ("toxic", "severe")


class Hashed(dict):
    """word -> the buckets of its features, remembered for as long as there is room."""

    def __missing__(self, word: str) -> list[int]:
        parts = {word, word[:4] + "*", word[:5] + "*", word[:6] + "*"}
        found = [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in sorted(parts)]
        if len(self) < 200_000:
            self[word] = found
        return found


def features(texts: list[str], known: Hashed | None = None) -> list[np.ndarray]:
    """Sorted distinct buckets of each text."""
    known = Hashed() if known is None else known
    out = []
    for text in texts:
        buckets: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            buckets.update(known[word])
        out.append(np.array(sorted(buckets), np.int64))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Link:
    """One model of the chain: weights of buckets, of earlier categories' log-odds, intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        scores = np.array([self.weights[r].sum(dtype=np.float64) for r in rows], np.float64)
        return _sigmoid(scores + before @ self.earlier + self.bias)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Whether each bucket is one of those that the models may weigh."""
    n, pos = len(y), y.sum()
    inside = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t]), minlength=BUCKETS).astype(np.float64)
    every = np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(np.float64)
    expected = every * pos / n
    chi2 = (inside - expected) ** 2 / np.maximum(expected * (1 - pos / n) * (1 - every / n), 1e-9)
    chi2[(every < 3) | (every == n)] = 0
    best = np.argsort(-chi2, kind="stable")[:MOST]
    mask = np.zeros(BUCKETS, bool)
    mask[best[chi2[best] >= CHI2]] = True
    return mask


def fit_link(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.3, decay: float = 1e-4) -> Link:
    """Logistic regression by mini-batch AdaGrad, in the order of the rows."""
    link = Link(np.zeros(BUCKETS, np.float32), np.zeros(before.shape[1]), 0.0)
    if not len(y) or y.min() == y.max():
        rate_ = (y.sum() + 0.5) / (len(y) + 1)
        link.bias = float(np.log(rate_ / (1 - rate_)))
        return link
    mask = telling(rows, y)
    rows = [r[mask[r]] for r in rows]
    share = y.mean()
    link.bias = float(np.log(share / (1 - share)))
    square, square_e, square_b = np.full(BUCKETS, 1e-6, np.float32), np.full(before.shape[1], 1e-6), 1e-6
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            at = np.concatenate([rows[i] for i in some])
            lengths = np.array([len(rows[i]) for i in some])
            owner = np.repeat(np.arange(len(some)), lengths)
            score = np.bincount(owner, link.weights[at], len(some)) + before[some] @ link.earlier + link.bias
            error = _sigmoid(score) - y[some]
            used, where = np.unique(at, return_inverse=True)
            g = np.bincount(where, error[owner], len(used)) / len(some) + decay * link.weights[used]
            square[used] += g * g
            link.weights[used] -= rate * g / np.sqrt(square[used])
            ge = before[some].T @ error / len(some)
            square_e += ge * ge
            link.earlier -= rate * 0.3 * ge / np.sqrt(square_e)
            gb = error.mean()
            square_b += gb * gb
            link.bias -= rate * 0.1 * gb / np.sqrt(square_b)
    return link


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """labels: (rows, categories).  Later links are trained on out-of-fold probabilities of earlier ones."""
    chain, before = [], np.zeros((len(rows), 0))
    fold = np.arange(len(rows)) % folds
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        chain.append(fit_link(rows, before, y))
        if c + 1 < labels.shape[1]:
            unseen = np.full(len(rows), 0.5)
            for k in range(folds):
                learn, ask = np.nonzero(fold != k)[0], np.nonzero(fold == k)[0]
                if len(learn) and len(ask):
                    unseen[ask] = fit_link([rows[i] for i in learn], before[learn], y[learn]).predict([rows[i] for i in ask], before[ask])
            before = np.column_stack([before, _odds(unseen)])
    return chain


def predict_chain(chain: list[Link], rows: list[np.ndarray]) -> np.ndarray:
    """(rows, categories) probabilities."""
    before, found = np.zeros((len(rows), 0)), []
    for link in chain:
        p = link.predict(rows, before)
        found.append(p)
        before = np.column_stack([before, _odds(p)])
    return np.column_stack(found) if found else np.zeros((len(rows), 0))


def severe_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Toxic rows whose share of buckets that mark toxic rows (five times as common there, in 1 % of them at least) is at least the median."""
    if not toxic.any() or toxic.all():
        return np.zeros(len(rows), np.int64)
    inside, outside = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, t in zip(rows, toxic):
        (inside if t else outside)[r] += 1
    inside, outside = inside / toxic.sum(), (outside + 0.5) / (len(rows) - toxic.sum())
    marks = (inside > 5 * outside) & (inside >= 0.01)
    share = np.array([marks[r].mean() if len(r) else 0.0 for r in rows])
    return (toxic.astype(bool) & (share >= np.median(share[toxic.astype(bool)])) & (share > 0)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Link]:
    marks = project(labels, doc_id=("doc_id", "long"), toxic=("toxic", "int")).where("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = bounded_sample(marks, labels.count(), max_rows, "doc_id")
    texts = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = {r["doc_id"]: (r["text"], r["toxic"]) for r in found.toLocalIterator()}
    order = sorted(sample, key=lambda i: (xxhash.xxh3_64_intdigest(str(i)), i))
    rows = features([sample[i][0] for i in order])
    toxic = np.array([sample[i][1] for i in order], np.int64)
    return fit_chain(rows, np.column_stack([toxic, severe_of(rows, toxic)])) if order else [Link(np.zeros(BUCKETS, np.float32), np.zeros(k), 0.0) for k in range(2)]


def score(docs: DataFrame, chain: list[Link], flag: float = FLAG) -> DataFrame:
    """(doc_id, toxic_probability, severe_probability, toxic, severe) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                some = pdf.iloc[k : k + 1000]
                p = predict_chain(shared.value, features([t if isinstance(t, str) else "" for t in some["text"]], known))
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "toxic_probability": p[:, 0], "severe_probability": p[:, 1], "toxic": p[:, 0] > flag, "severe": (p[:, 0] > flag) & (p[:, 1] > flag)})

    rows = project(docs, doc_id=("doc_id", "long"), text=("text", "string")).where("doc_id is not null")
    return rows.mapInPandas(look, "doc_id long, toxic_probability double, severe_probability double, toxic boolean, severe boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
