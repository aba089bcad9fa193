"""Quality by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and unlabelled texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import held_out

#: Bounds of the samples that the classifier is fitted on, both taken by hash of the id.
POSITIVES, UNLABELLED = 8_000, 16_000
THRESHOLD = 0.5

WORDS = re.compile(r"\S+")


def _classes() -> np.ndarray:
    """A class for each byte: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence end, 7 comma, 8 mark of
    decoration or markup, 9 other ASCII, 10 and 11 bytes beyond ASCII."""
    c = np.zeros(256, dtype=np.int64)
    c[33:127] = 9
    for first, last, k in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (128, 191, 10), (192, 255, 11)):
        c[first : last + 1] = k
    for marks, k in ((b" \t", 4), (b"\n\r", 5), (b".!?", 6), (b",;:'-", 7), (b"|*#$%&@=~^_+<>\\/{}[]", 8)):
        c[list(marks)] = k
    return c


CLASSES, K = _classes(), 12
N_FEATURES = K + K * K + 8


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of pairs of them over the whole text, and shares of repeated words and lines; zeros for an empty text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    c = CLASSES[np.frombuffer(data, np.uint8)]
    n = len(c)
    out[:K] = np.sqrt(np.bincount(c, minlength=K) / n)
    out[K : K + K * K] = np.sqrt(np.bincount(c[:-1] * K + c[1:], minlength=K * K) / n)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    out[K + K * K :] = (
        len(set(words)) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(w) / 10,
        np.log1p(n / w) / 3,
        np.log1p(n / max(len(lines), 1)) / 10,
        (np.log1p(w) / 10) * len(set(words)) / w,
        1.0 if n < 64 else 0.0,
    )
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts) -> np.ndarray:
        x = (np.array([features(t) for t in texts]).reshape(-1, N_FEATURES) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.clip(x, -8, 8) @ self.weights + self.bias, -60, 60)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Clipped standard scores in single precision, and a last column of ones."""
    out = np.ones((len(x), x.shape[1] + 1), dtype=np.float32)
    np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -8, 8, out=out[:, :-1])
    return out


def _descend(gradient, n: int, steps: int, rate: float = 0.05) -> np.ndarray:
    theta, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, steps + 1):
        g = gradient(theta.astype(np.float32)).astype(float)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in ``u``: best bin estimation. A classifier of positives against unlabelled rows is fitted on
    one half; on the other, the least ratio of unlabelled to positive rows above a threshold, with a margin for chance."""
    p1, p2, u1, u2 = (np.ascontiguousarray(x) for x in (p[::2], p[1::2], u[::2], u[1::2]))
    if min(map(len, (p1, p2, u1, u2))) < 5:
        return 0.5

    def gradient(t):
        gp, gu = -_sigmoid(-(p1 @ t)) / len(p1), _sigmoid(u1 @ t) / len(u1)
        return p1.T @ gp + u1.T @ gu + 1e-3 * t

    t = _descend(gradient, p.shape[1], 150)
    sp, su = np.sort(p2 @ t), np.sort(u2 @ t)
    at = np.unique(np.quantile(sp, np.linspace(0, 0.98, 200)))
    above_p = 1 - np.searchsorted(sp, at) / len(sp)
    above_u = 1 - np.searchsorted(su, at) / len(su)
    chance = np.sqrt(np.log(4 / delta) / (2 * len(su))) + 1.01 * np.sqrt(np.log(4 / delta) / (2 * len(sp)))
    best = np.argmin((above_u + chance) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.98))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, l2: float = 2e-4) -> np.ndarray:
    """Weights that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss. While the estimate
    of the negatives' risk is below 0, steps go against it, as the non-negative estimator asks."""

    def gradient(t):
        zp, zu = p @ t, u @ t
        plus, minus_p, minus_u = -_sigmoid(-zp) / len(p), _sigmoid(zp) / len(p), _sigmoid(zu) / len(u)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = u.T @ minus_u - prior * (p.T @ minus_p)
        if negative < 0:
            return -g_negative
        return prior * (p.T @ plus) + g_negative + l2 * t

    return _descend(gradient, p.shape[1], steps)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Fit on at most ``positives`` trusted documents (label 1, not held out) and ``unlabelled`` ones of all documents,
    whose labels aren't looked at. An id of several texts counts with the least. Without positives, every score is 0.5."""
    trusted = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(positives)
    web = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(unlabelled)
    chosen = trusted.withColumn("part", F.lit(1)).unionByName(web.withColumn("part", F.lit(0)))  # bounded, so it can be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "part").agg(F.min("text").alias("text"))

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts], dtype=object)

    got = sample.select("doc_id", "part", vector("text").alias("x")).toArrow()  # packed floats: no object for each number
    part = got["part"].to_numpy()
    if not (part == 1).any() or not (part == 0).any():
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    del got
    order = order[np.random.default_rng(5).permutation(len(order))]
    web = x[part == 0]
    mean, scale = web.mean(0, dtype=np.float64), np.maximum(web.std(0, dtype=np.float64), 0.01)
    del web
    p, u = (_standard(x[order[part[order] == k]], mean, scale) for k in (1, 0))
    del x
    prior = estimate_prior(p, u)
    t = fit_nnpu(p, u, prior)
    return QualityModel(mean, scale, t[:-1], float(t[-1]), prior)


def quality(text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1 of each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.score(texts[k : k + 512]) for k in range(0, len(texts), 512)]) if len(texts) else [], dtype="float64")

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) for every row of ``docs``.

    Only texts are inputs of a score. Null and empty texts get the score of no features; null ids aren't held out;
    repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    model = fit(docs, labels, **options)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents of score 0.5 or more, as they are, with all their columns. Null texts count as empty; without positives every
    score is 0.5 and all stay; repeated rows are judged alike; an empty table gives an empty one."""
    model = fit(docs, labels, **options)
    return docs.where(quality(F.col("text"), model) >= THRESHOLD)
