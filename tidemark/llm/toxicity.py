"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from labels of whole documents."""

from __future__ import annotations

import array
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import held_out

#: The bounded sample that the classifier is fitted on: so many labelled documents, by hash of their ids.
TRAIN_DOCS = 20_000
#: At most so many features have weights, those with the highest statistic.
MAX_FEATURES = 4_096
#: A feature's log-likelihood ratio against the label, and its rate in toxic over its rate in other documents.
LEAST_RATIO, LEAST_LIFT = 10.8, 3.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
MEMO_WORDS = 300_000

PIECE = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """A lower-cased word's features: itself, and its beginnings of 4, 5 and 6 letters, which inflected forms share."""
    return [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


@dataclass
class SentenceModel:
    """A sentence without any known feature isn't evidence: its probability is 0. Others: sigmoid(bias + sum of weights)."""

    weights: dict[str, float]
    bias: float = 0.0
    memo: dict[str, float | None] = field(default_factory=dict, repr=False, compare=False)

    def word(self, word: str) -> float | None:
        if word not in self.memo:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            known = [self.weights[f] for f in features(word) if f in self.weights]
            self.memo[word] = sum(known) if known else None
        return self.memo[word]

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Noisy-or over the sentences, and the sentences of probability 0.5 or more as code point spans."""
        memo, get, total, spans = self.memo, self.word, 0.0, []
        z, known, start = self.bias, False, 0
        low = text or ""
        lowered = low.lower()
        if len(lowered) != len(low):  # a few letters lower to two; spans are of the text as it is
            lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in low)
        for m in itertools.chain(PIECE.finditer(lowered), (None,)):
            if m is None or (piece := m.group()) in ENDS:
                end = m.end() if m else len(low)
                if known:
                    total += math.log1p(math.exp(-abs(z))) + max(z, 0.0)
                    if z >= 0:
                        spans.append({"start": start, "end": end, "score": 1 / (1 + math.exp(-z))})
                z, known, start = self.bias, False, end
            elif (w := memo[piece] if piece in memo else get(piece)) is not None:
                z, known = z + w, True
        return -math.expm1(-total), spans


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, label): at most ``size`` labelled documents that aren't held out, chosen by hash of the id. A
    document with several labels counts with the greatest, an id of several texts with the least; null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # bounded, so it can be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _counted(batches):
    for batch in batches:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = {p for p in PIECE.findall((text or "").lower()) if p not in ENDS}
            seen[min(label, 1)].update({f for w in words for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([seen[1][n] for n in names], pa.int64()), "other": pa.array([seen[0][n] for n in names], pa.int64())})


def select_features(sample: DataFrame, limit: int = MAX_FEATURES) -> list[str]:
    """Features that are in toxic documents far more often than in others, by log-likelihood ratio."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    counts = sample.mapInArrow(_counted, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    a, b = F.col("a"), F.col("b")
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    rate, out = (a + b) / float(n1 + n0), float(n1 + n0) - a - b
    ratio = 2 * (term(a, n1 * rate) + term(b, n0 * rate) + term(n1 - a, n1 * out / float(n1 + n0)) + term(n0 - b, n0 * out / float(n1 + n0)))
    lift = (a / float(n1)) / ((b + 0.5) / float(n0))
    best = counts.where((a >= 2) & (lift >= LEAST_LIFT)).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(limit)
    return [r["feature"] for r in best.select("feature").collect()]


def fit_weights(labels: np.ndarray, bag_sizes: np.ndarray, sentence_sizes: np.ndarray, ids: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-3, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the noisy-or log loss by Adam. Bags end to end: each bag's label and number of
    sentences, each sentence's number of features, and the features' ids; bags and sentences aren't empty."""
    if not len(ids):
        return np.zeros(n_features), 0.0
    bags, sentences = len(labels), len(sentence_sizes)
    bag_of, of, y = np.repeat(np.arange(bags), bag_sizes), np.repeat(np.arange(sentences), sentence_sizes), labels.astype(float)
    theta = np.concatenate([np.full(n_features, 2.0), [-1.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(of, theta[ids], sentences) + theta[-1]
        total = np.maximum(np.bincount(bag_of, np.logaddexp(0, z), bags), 1e-9)
        outer = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / bags
        slope = outer[bag_of] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(ids, slope[of], n_features), [slope.sum()]]) + l2 * theta / len(theta)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = TRAIN_DOCS) -> SentenceModel:
    """Learn from ``labels.<label>`` of documents that aren't held out. Without both labels, every score is 0.

    Spark counts the features and reduces each sampled document to its sentences' feature ids; only those bags, of at
    most ``train_docs`` documents and ``MAX_FEATURES`` features, are fitted on the driver.
    """
    sample = training_sample(docs, labels, label, train_docs)
    names = select_features(sample)
    index = {n: k for k, n in enumerate(names)}
    if not index:
        return SentenceModel({})

    def bags(batches):
        for batch in batches:
            rows = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                ids, sizes, now = array.array("i"), array.array("i"), 0
                for m in itertools.chain(PIECE.finditer((text or "").lower()), (None,)):
                    if m is None or (piece := m.group()) in ENDS:
                        if len(ids) > now:
                            sizes.append(len(ids) - now)
                        now = len(ids)
                    else:
                        ids.extend(index[f] for f in features(piece) if f in index)
                if ids:
                    rows.append((min(label, 1), sizes.tobytes(), ids.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["label", "sizes", "ids"])

    found = sample.mapInArrow(bags, "label int, sizes binary, ids binary").toArrow()
    packed = lambda name: np.frombuffer(b"".join(found[name].to_pylist()), np.int32)
    bag_sizes = np.array([len(x) // 4 for x in found["sizes"].to_pylist()], dtype=np.int64)
    weights, bias = fit_weights(found["label"].to_numpy(), bag_sizes, packed("sizes"), packed("ids"), len(names))
    return SentenceModel(dict(zip(names, map(float, weights), strict=True)), bias)


def toxicity(text: Column, model: SentenceModel) -> Column:
    """Struct of ``score`` (0 to 1) and ``spans``: the offending sentences. Null and empty texts score 0."""

    @F.pandas_udf("score double, spans array<struct<start int, end int, score double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        found = [model.score(t) for t in texts]
        return pd.DataFrame({"score": [s for s, _ in found], "spans": [p for _, p in found]})

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), and ``spans`` of offending sentences, for every row of ``docs``.

    Only texts are inputs of a score. Null and empty texts: 0. Null ids: not held out. Repeated rows each get a row;
    an empty table gives an empty one; other columns are ignored.
    """
    model = fit(docs, labels, **options)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model).alias("toxicity"))
    return out.select("doc_id", "held_out", F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't judged toxic, as they are, with all their columns. Null and empty texts score 0 and stay; without
    both labels all stay; repeated rows are judged alike; an empty table gives an empty one."""
    model = fit(docs, labels, **options)
    return docs.where(toxicity(F.col("text"), model)["score"] < THRESHOLD)
