"""A quality classifier learned from trusted positives and unlabelled text.

Positive-unlabelled learning minimises the non-negative unbiased risk: with class prior p, the risk
of calling positives positive, weighted by p, plus the risk of calling negatives negative, which is
that of the unlabelled text less p times that of the positives and is kept from falling below zero.
The prior is estimated from the two samples alone: classifiers that tell positives from unlabelled
text are fitted on all folds but one and score that one, and the prior is the ratio of the shares of
unlabelled and of positive text above a threshold, which is picked as that with the smallest ratio,
confidence bounds included.

A text is described by what can be counted in one reading of it: bytes by kind, words, lines, and how
often they repeat. The network is small and is sent to the executors with the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, held_out, learnable, small_batches, unit_hash

#: Documents of each sample that the model is fitted on, about: those with the smallest hashes.
TRAIN_DOCS = 8000
#: Parts that each sample is cut into to estimate the class prior.
FOLDS = 5
#: A document is called good from this score on.
GOOD = 0.7
SEED = 20

SIGNS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def features(text: str) -> np.ndarray:
    """What a text is judged by; an empty one gives zeros."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return np.zeros(len(SIGNS) + 16, np.float32)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    upper, lower, digits, high = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[128:].sum()
    letters = max(1, upper + lower)
    distinct, pairs = len(set(words)), len(set(zip(words, islice(words, 1, None), strict=False)))
    again = sum(map(eq, words, islice(words, 1, None)))
    rest = [
        math.log1p(n),
        math.log1p(len(words)),
        upper / letters,
        digits / n,
        high / n,
        letters / n,
        (h[32] + h[9]) / n,
        h[10] / n,
        h[SIGNS].sum() / n,
        (n / m) ** 0.5,
        distinct / m,
        math.log1p(distinct) / math.log1p(m),
        pairs / m,
        again / m,
        len(set(lines)) / len(lines),
        h[:32].sum() / n,
    ]
    return np.concatenate([np.sqrt(h[SIGNS] / n), rest]).astype(np.float32)


class Net:
    """One hidden layer over standardised features; the output is a log-odds."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def gradient(self, z: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of the sum of outputs, each weighted by its slope."""
        h = np.tanh(z @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.odds(self.prepared(x)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float, decay: float):
        self.w, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m, self.v = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]

    def step(self, gradient: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.w, gradient, self.m, self.v, strict=True):
            g = g + self.decay * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, hidden: int = 16, rate: float = 0.01, decay: float = 1e-3) -> Net:
    """The network with the least non-negative unbiased risk under the logistic loss."""
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    net = Net(every.mean(0), every.std(0) + 1e-6, hidden, np.random.default_rng(SEED))
    p, u = net.prepared(positive), net.prepared(unlabelled)
    adam = Adam(net.w, rate, decay)
    for _ in range(steps):
        gp, gu = net.odds(p), net.odds(u)
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        of_u, of_p = net.gradient(u, sigmoid(gu) / len(u)), net.gradient(p, sigmoid(gp) / len(p))
        if negative < 0:  # step back until the risk of the negatives is a risk again
            adam.step([prior * b - a for a, b in zip(of_u, of_p, strict=True)])
        else:
            good = net.gradient(p, -sigmoid(-gp) / len(p))
            adam.step([prior * g + a - prior * b for g, a, b in zip(good, of_u, of_p, strict=True)])
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 60, folds: int = FOLDS) -> float:
    """The share of positives in the unlabelled sample, from the two samples alone.

    It takes two of each to fit on one and score the other; with fewer nothing can be estimated, and
    the prior is one half.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    scored: tuple[list, list] = ([], [])
    for fold in range(folds):
        parts = [(x[np.arange(len(x)) % folds != fold], x[np.arange(len(x)) % folds == fold]) for x in (positive, unlabelled)]
        if not all(len(x) for x, _ in parts):
            continue
        every = np.concatenate([x for x, _ in parts]).astype(np.float64)
        net = Net(every.mean(0), every.std(0) + 1e-6, 16, np.random.default_rng(SEED))
        p, u = (net.prepared(x) for x, _ in parts)
        adam = Adam(net.w, 0.01, 1e-3)
        for _ in range(steps):
            a, b = net.gradient(p, -sigmoid(-net.odds(p)) / len(p)), net.gradient(u, sigmoid(net.odds(u)) / len(u))
            adam.step([x + y for x, y in zip(a, b, strict=True)])
        for k, (_, rest) in enumerate(parts):
            scored[k].append(net.odds(net.prepared(rest)))
    p, u = (np.sort(np.concatenate(x)) for x in scored)
    over_p, over_u = 1 - np.searchsorted(p, p) / len(p), 1 - np.searchsorted(u, p) / len(u)
    slack = sum(math.sqrt(math.log(4 / 0.1) / 2 / len(x)) for x in (p, u))
    best = int(np.argmin((over_u + 1.01 * slack) / np.maximum(over_p, 1e-9)))
    return float(np.clip(over_u[best] / over_p[best], 0.01, 0.99))


class Model:
    """A fitted network with its class prior; without a network every text scores 0.5."""

    def __init__(self, net: Net | None = None, prior: float = 0.5):
        self.net, self.prior = net, prior

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), 0.5)
        return self.net.score(np.stack([features(t) for t in texts]))


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model from the learnable documents that `labels` calls good, and from learnable documents as such.

    Each sample has about `train_docs` documents at most, read whole: those whose id hashes low
    enough. A document that labels contradict each other about isn't trusted. The driver gets the
    samples' features, a few dozen numbers for each document.
    """
    spark = docs.sparkSession
    known = labels.filter(learnable("doc_id") & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = known.filter("quality = 1").select("doc_id")
    own = docs.select("doc_id", "text").filter(learnable("doc_id"))
    n_trusted, n_own = trusted.count(), own.count()
    if not n_trusted or not n_own:
        return Model()
    few = trusted.filter(unit_hash("doc_id", F.lit(1)) < train_docs / n_trusted).withColumn("trusted", F.lit(True))  # about train_docs ids
    sample = own.join(F.broadcast(few), "doc_id", "left").withColumn("web", unit_hash("doc_id", F.lit(2)) < train_docs / n_own).filter("trusted or web")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trusted"), batch.column("web"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "trusted", "web", "x"])

    small_batches(spark)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = sample.select("doc_id", "trusted", "web", "text").mapInArrow(describe, f"doc_id {kind}, trusted boolean, web boolean, x array<float>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model()
    x = np.stack(rows.column("x").to_numpy(zero_copy_only=False))
    positive, unlabelled = (x[rows.column(k).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)] for k in ("trusted", "web"))
    if not len(positive) or not len(unlabelled):
        return Model()
    prior = class_prior(positive, unlabelled)
    return Model(fit(positive, unlabelled, prior), prior)


def scores(text: Column, model: Model) -> Column:
    """The score of each text, from 0 to 1; null texts count as empty."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(model.score([t or "" for t in batch.to_pylist()]).astype(np.float64))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, good: float = GOOD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from `good` on, else 0).

    Without a model, it is learned from the documents and labels. Null and empty texts are scored
    as texts without anything; if nothing could be learned (no trusted positives), every score is
    0.5. Repeated rows are scored each; other columns are not read, so clashing names do not matter.
    """
    small_batches(docs.sparkSession)
    model = model or learn(docs, labels)
    return docs.select("doc_id", held_out().alias("held_out"), scores(F.col("text"), model).alias("score")).withColumn("predicted", (F.col("score") >= good).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, that are likelier good than not.

    The bound is below that of `predicted`: a filter of a corpus should let doubtful texts pass. Null
    and empty texts are judged as texts without anything, repeated rows each; if nothing could be
    learned, all stay. An empty table gives no rows, and columns of any name are passed through.
    """
    small_batches(docs.sparkSession)
    model = model or learn(docs, labels)
    s = fresh(docs, "_quality")
    return docs.withColumn(s, scores(F.col("text"), model)).filter(F.col(s) >= least).drop(s)
