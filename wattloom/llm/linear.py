"""Logistic regression on small dense samples, word features and calibration, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tasks import settled


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one the intercept (unpenalised), by Newton steps on the penalised log-likelihood."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-6:
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def folds(n: int, k: int) -> np.ndarray:
    return np.arange(n) % k


def out_of_fold(x: np.ndarray, y: np.ndarray, k: int = 5, penalty: float = 1.0) -> np.ndarray:
    """Each row's probability by the model that was fitted without its fold."""
    out, fold = np.empty(len(y)), folds(len(y), k)
    for f in range(k):
        own = fold == f
        out[own] = predict(fit(x[~own], y[~own], penalty), x[own]) if own.any() and not own.all() else y.mean()
    return out


def platt(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept that calibrate log-odds of ``p`` to ``y``."""
    return fit(logit(p)[:, None], y, 1e-3)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def telling(rows: DataFrame, most: int, least: int = 5, sure: float = 6.0) -> np.ndarray:
    """Of ``rows`` (words array<long>, ys array<double>): sorted hashes of the words that tell most about any of the ys.

    A word must be in ``least`` texts and 0.2 % of them or more, and at least ``sure`` standard deviations from what
    chance gives. Spark counts; at most ``most`` words for each y reach the driver.
    """
    k = rows.agg(F.max(F.size("ys"))).first()[0] or 0
    total = rows.agg(F.count("*"), *[F.avg(F.col("ys")[i]) for i in range(k)]).first()
    n, means = total[0], total[1:]
    counts = rows.select(F.explode(F.array_distinct("words")).alias("word"), "ys").groupBy("word").agg(F.count("*").alias("df"), *[F.sum(F.col("ys")[i]).alias(f"s{i}") for i in range(k)])
    counts = counts.where((F.col("df") >= max(least, n / 500)) & (F.col("df") < n))
    far = {f"z{i}": F.abs(F.col(f"s{i}") - F.col("df") * m) / F.sqrt(F.greatest(F.col("df") * (m * (1 - m)) * (1 - F.col("df") / n), F.lit(1e-9))) for i, m in enumerate(means)}
    z = settled(counts.withColumns(far).where(" or ".join(f"{c} >= {sure}" for c in far)).select("word", *far)) if k and n else None
    words = {r[0] for c in far for r in z.where(F.col(c) >= sure).orderBy(F.desc(c), "word").limit(most).select("word").collect()} if z is not None else set()
    return np.sort(np.array(sorted(words), np.int64).view(np.uint64))


def presence(vocabulary: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A row for each text: the binary logarithm of 1 + how often its ``words`` have each of the vocabulary."""
    x = np.zeros((len(words), len(vocabulary)))
    for i, w in enumerate(words):
        if len(vocabulary) and len(w):
            at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
            x[i] = np.bincount(at[vocabulary[at] == w], minlength=len(vocabulary))
    return np.log2(1 + x)
