"""Target-distribution importance resampling: documents are drawn by how much likelier their features are in a target than in the
corpus, with Gumbel noise. Equal texts are collapsed first: features and weight of a text are computed once, its counts are
multiplied by its copies, and weights are joined back to the rows before each document's own noise."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.operators.ordered import running_sums

BUCKETS = 10_000
#: Documents of fewer words aren't drawn; so many of a hundred others are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of 0-9, A-Z (lower-cased), a-z and of characters beyond ASCII, of UTF-8 bytes."""
    return text.translate(_WORD_BYTES).split()


def feature_buckets(tokens: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and of all pairs of consecutive words, joined by one space, repeats kept."""
    crc = zlib.crc32
    ones = [crc(w) for w in tokens]
    twos = [crc(b" " + w, c) for w, c in zip(tokens[1:], ones, strict=False)]
    return np.array(ones + twos, np.int64) % buckets


_FEATURES = "text_id binary, copies long, n_words long, n_features long, cells binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_features, cells = [], [], []
        for text in batch["text"]:
            tokens = words(text.as_buffer().to_pybytes())
            at, times = np.unique(feature_buckets(tokens), return_counts=True)
            n_words.append(len(tokens))
            n_features.append(max(0, 2 * len(tokens) - 1))
            cells.append(zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch["text_id"], batch["copies"], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(cells, pa.binary())], names=["text_id", "copies", "n_words", "n_features", "cells"])


def _cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _text_id(text: Column) -> Column:
    """SHA-256 of the text, the name that its weight is joined back by."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def collapsed(docs: DataFrame) -> DataFrame:
    """One row for each different text, null being empty: its name, copies, and features by bucket. Texts are grouped whole, first in
    each task, so a text on very many rows is one row a task."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(_text_id(F.col("text")).alias("text_id"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(_featured, _FEATURES)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS, parts: int = 8) -> np.ndarray:
    """Features of all rows by bucket, each text's times its copies. A task's sums are a packed row for each part of the buckets,
    and Spark adds the rows of a part; the driver gets ``buckets`` numbers, whatever the corpus."""

    def summed(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, data in zip(batch["copies"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                at, times = _cells(data)
                total[at] += times * copies
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, parts)], pa.binary())], names=["part", "counts"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x, np.int64) for batch in batches for x in batch["counts"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    rows = features.select("copies", "cells").mapInArrow(summed, "part int, counts binary").groupBy("part").applyInArrow(added, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(buckets, np.int64)


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log of its smoothed share in the target over that in the corpus, floored."""
    n, t_all, s_all = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def text_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(text_id, n_words, n_features, weight): the floored mean gain of a text's features, 0 without any."""

    def weighed(batches):
        for batch in batches:
            weights = []
            for n, data in zip(batch["n_features"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                at, times = _cells(data)
                weights.append(int((gains[at] * times).sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch["text_id"], batch["n_words"], batch["n_features"], pa.array(weights, pa.int64())], names=["text_id", "n_words", "n_features", "weight"])

    return features.drop("copies").mapInArrow(weighed, "text_id binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel draw, floored, from the first 32 bits of SHA-256 of seed and id; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``rank`` is null for rows that aren't drawn.

    The join of weights back to rows meets hot texts; its other side has one row a text, and Spark splits the skewed rows.
    Ranks come from running sums by ranges of the score, so no task sorts the table.

    Null texts have no feature and weight 0; ties of the score go to the smaller id, null ids last; repeated rows are each
    drawn or not, those of one id with one score by their text; an empty corpus or target counts as no features; other
    columns are ignored."""
    features = written(collapsed(docs), "resample-features")
    wanted = written(collapsed(target), "resample-target")  # a table between them, so that a task has one Python worker
    gains = bucket_gains(bucket_counts(wanted), bucket_counts(features))
    weights = text_weights(features, gains)
    rows = docs.select("doc_id", _text_id(F.coalesce(F.col("text"), F.lit(""))).alias("text_id")).join(weights, "text_id")
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("likely", F.col("n_words") >= least_words)
    scored = written(scored.select("doc_id", "text_id", "n_features", "weight", "score", "likely"), "resample-scored")
    n = scored.where("likely").count()
    order = scored.where("likely").withColumn("_at", -F.col("score")).withColumn("_last", F.col("doc_id").isNull())
    ranked = running_sums(order, "_at", {"rank": F.lit(1).cast("long")}, ["_last", "doc_id", "text_id"])
    rank = F.when(F.col("rank") <= percent * n // 100, F.col("rank")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where("not likely").select(*columns, F.lit(None).cast("long").alias("rank")))
