"""Tabular learning: column profiles, leakage, preparation, gradient-boosted trees, validation, calibration and comparison with what happened."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, QuantileDiscretizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import calendar_features
from tidemark.functions.scratch import written
from tidemark.operators.ordered import average_ranks, running_sums, with_key

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
MOST_LEVELS = 250


def column_profile(df: DataFrame, target: str) -> DataFrame:
    """(column, missing_share, distinct_values, reason): why a column shouldn't be a feature, or null. One pass for all columns.

    Reasons: almost_empty (98 % missing), constant, row_number (whole numbers 1..n or 0..n-1), almost_unique (text with 95 %
    distinct values), same_as_target (correlation of 0.999 or more)."""
    kinds = dict(df.dtypes)
    cells = []
    for c in [c for c in df.columns if c != target]:
        number = kinds[c] in NUMERIC
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        y = F.col(target).cast("double") if kinds[target] in NUMERIC else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(number).alias("number"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.count_distinct(c).alias("distinct_values"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.corr(x, y).alias("r")))
    all_ = df.agg(F.array(*cells).alias("all"), F.count(F.lit(1)).alias("n")).select(F.inline("all"), "n")
    n = F.col("n")
    sequence = F.col("number") & (F.col("distinct_values") == n) & (F.col("lo").isin(0.0, 1.0)) & (F.col("hi") - F.col("lo") == n - 1)
    reason = F.when(F.col("missing") >= 0.98 * n, "almost_empty").when(F.col("distinct_values") <= 1, "constant").when(sequence, "row_number")
    reason = reason.when(~F.col("number") & (F.col("distinct_values") >= 0.95 * (n - F.col("missing"))), "almost_unique").when(F.abs(F.coalesce("r", F.lit(0.0))) >= 0.999, "same_as_target")
    return all_.select("column", (F.col("missing") / n).alias("missing_share"), "distinct_values", reason.alias("reason"))


def problem_kind(df: DataFrame, target: str) -> str:
    """classification for texts, flags, two values, or up to 20 whole numbers; else regression."""
    kind = dict(df.dtypes)[target]
    if kind in ("string", "boolean"):
        return "classification"
    got = df.agg(F.count_distinct(target).alias("d"), F.count(F.when(F.col(target) != F.floor(target), 1)).alias("f")).first()
    return "classification" if got["d"] <= 2 or got["d"] <= 20 and not got["f"] else "regression"


def category_purity(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """(column, levels, purity, majority, leak): how well each category tells the class. A leak from purity 0.995 on, 0.02 above
    the majority, with 2 to 50 levels of 20 rows or more on average."""
    cells = df.select(F.col(target).cast("string").alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("cell")).select("y", "cell.*")
    counts = cells.groupBy("column", "level", "y").agg(F.count(F.lit(1)).alias("n"))
    level = counts.groupBy("column", "level").agg(F.max("n").alias("best"), F.sum("n").alias("rows"))
    pure = level.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("best").alias("_best"), F.sum("rows").alias("_rows"))
    major = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    out = pure.join(F.broadcast(major)).withColumn("purity", F.col("_best") / F.col("_rows"))
    leak = (F.col("purity") >= 0.995) & (F.col("purity") >= F.col("majority") + 0.02) & F.col("levels").between(2, 50) & (F.col("_rows") >= 20 * F.col("levels"))
    return out.select("column", "levels", "purity", "majority", leak.alias("leak"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (k n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(counts.join(F.broadcast(totals)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))), label)


def with_folds(df: DataFrame, row: str, folds: int = 3, how: str = "random", seed: int = 0, target: str | None = None, time: str | None = None, group: str | None = None, out: str = "_fold") -> DataFrame:
    """Adds the fold of each row, without passing the table through one task.

    random: by hash of the row; group: by hash of its group, so no group is in two folds; stratified: rows of each class are
    numbered in order of their hash and dealt in turn; time: in order of time, folds + 1 equal parts, of which number 0 is
    only learnt from and part k is tested on what comes before it. Rows without a time are in part 0."""
    dealt = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(folds)).cast("int")
    if how == "random":
        return df.withColumn(out, dealt(row))
    if how == "group":
        if df.select(group).distinct().limit(5).count() < 5:
            raise ValueError(f"{group} has under five different values to part by")
        return df.withColumn(out, dealt(group))
    if how == "stratified":
        keyed = df.withColumn("_key", F.xxhash64(F.col(row), F.lit(seed)).cast("double")).withColumn("_class", F.col(target).cast("string"))
        return running_sums(keyed, "_key", {"_place": F.lit(1)}, [row], by=["_class"]).withColumn(out, F.pmod(F.col("_place"), F.lit(folds)).cast("int")).drop("_key", "_class", "_place")
    if how == "time":
        placed = running_sums(with_key(df, "_key", time), "_key", {"_place": F.lit(1)}, [row])
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        part = F.least(F.floor((F.col("_place") - 1) * (folds + 1) / F.col("_n")), F.lit(folds)).cast("int")
        return placed.join(F.broadcast(n)).withColumn(out, F.when(F.col("_key").isNull(), 0).otherwise(part)).drop("_key", "_place", "_n")
    raise ValueError(f"no way {how!r} to part rows; there are random, stratified, group and time")


#: The rarest class that needs no weights has this share.
RARE_CLASS, MOST_CLASSES = 0.1, 100


def prepare_target(df: DataFrame, row: str, target: str, kind: str, log: bool = False, most_classes: int = MOST_CLASSES, most_rows: int | None = None, seed: int = 0, time: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with ``_label``, classes, notes). Rows without a target go. Classification: classes by name, at most ``most_classes``,
    numbered from 0. Regression: numbers, or log(1 + number) of non-negative ones. ``most_rows``: a sample by hash of the row, of
    exactly so many, where a bound is wanted. Notes: what was left out, exact duplicates, rows without a date."""
    notes = []
    kinds = dict(df.dtypes)
    missing = F.col(target).isNull() | (F.isnan(target) if kinds[target] in ("double", "float") else F.lit(False))
    rows = df.where(~missing)
    n, kept = df.count(), rows.count()
    if kept < n:
        notes.append(f"{n - kept} rows without {target} left out")
    copies = kept - rows.drop(row).dropDuplicates().count()
    if copies:
        notes.append(f"{copies} rows repeat another but for {row}")
    if time and (undated := rows.where(F.col(time).isNull()).count()):
        notes.append(f"{undated} rows without {time}")
    if most_rows and kept > most_rows:
        rows = rows.join(rows.select(row).orderBy(F.xxhash64(row, F.lit(seed)), row).limit(most_rows), row, "left_semi")
        notes.append(f"a sample of {most_rows} of {kept} rows")
    if kind == "regression":
        y = F.col(target).try_cast("double") if kinds[target] == "string" else F.col(target).cast("double")
        if log and rows.where(y < 0).limit(1).count():
            raise ValueError(f"{target} has negative values, so it has no logarithm of 1 + itself")
        return rows.withColumn("_label", F.log1p(y) if log else y), [], notes
    out, classes = labelled(rows, target, most_classes)
    return out, classes, notes


def labelled(rows: DataFrame, target: str, most_classes: int = MOST_CLASSES) -> tuple[DataFrame, list[str]]:
    """(rows with ``_label``, the class's number; classes by name, whole numbers in their order)."""
    text = F.col(target).cast("string")
    found = sorted(r[0] for r in rows.select(text).where(text.isNotNull()).distinct().limit(most_classes + 1).collect())
    if len(found) > most_classes:
        raise ValueError(f"{target} has more than {most_classes} classes")
    if all(c.lstrip("-").isdigit() for c in found):
        found.sort(key=int)
    codes = F.create_map(*[F.lit(x) for k, c in enumerate(found) for x in (c, float(k))]) if found else None
    return rows.withColumn("_label", F.element_at(codes, text) if found else F.lit(None).cast("double")), found


@dataclass
class Preparation:
    """What turns a table's columns into features: numbers with a flag for missing ones, calendar parts of dates, codes of
    categories by frequency, and the share of rows of categories with too many levels."""

    numbers: list[str]
    dates: list[str]
    categories: list[str]
    shares: dict[str, DataFrame] = field(default_factory=dict)
    levels: int = 0  # the most levels of a category

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str]) -> Preparation:
        kinds = dict(df.dtypes)
        texts = [c for c in columns if kinds[c] == "string"]
        levels = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first().asDict() if texts else {}
        many = [c for c in texts if levels[c] > MOST_LEVELS]
        n = df.count() if many else 0
        shares = {c: df.groupBy(c).agg((F.count(F.lit(1)) / float(n)).alias(f"{c}_share")).where(F.col(c).isNotNull()) for c in many}
        return Preparation([c for c in columns if kinds[c] in NUMERIC or kinds[c] == "boolean"], [c for c in columns if kinds[c].startswith(("timestamp", "date"))], [c for c in texts if c not in many], shares, max([levels[c] for c in texts if c not in many], default=0))

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        made, names = {}, []
        for c in self.numbers:
            made |= {f"{c}_value": F.col(c).cast("double"), f"{c}_missing": F.col(c).isNull().cast("double")}
        for c in self.dates:
            made |= {f"{c}_{k}": v.cast("double") for k, v in calendar_features(F.col(c)).items()}
        for c, side in self.shares.items():
            df = df.join(side, c, "left").withColumn(f"{c}_share", F.when(F.col(c).isNull(), None).otherwise(F.coalesce(f"{c}_share", F.lit(0.0))))
            names.append(f"{c}_share")
        return df.withColumns(made), [*made, *names]


BINS = 64
# Rows and rows of each class from which calibration can be judged, its tolerance's parts, and what a calibrator must gain.
CALIBRATION_ROWS, CALIBRATION_EACH, CALIBRATION_SLACK, CALIBRATION_GAIN = 200, 20, (0.05, 0.5), 0.8


def _features(df: DataFrame, columns: Sequence[str]) -> tuple[Preparation, list, list[str], list[str]]:
    """(preparation, the first steps of a pipeline: imputation and codes of categories, names of numbers, names of codes)."""
    prep = Preparation.of(df, columns)
    _, names = prep.apply(df.limit(0))
    filled, coded = [f"{c}_filled" for c in names], [f"{c}_code" for c in prep.categories]
    steps = [Imputer(inputCols=names, outputCols=filled, strategy="median")] if names else []
    if coded:
        steps.append(StringIndexer(inputCols=prep.categories, outputCols=coded, handleInvalid="keep"))
    return prep, steps, filled, coded


#: Numbers of more different values than the trees' bins are parted into as many by quantiles that are off by this share at most.
BIN_ERROR = 0.001


def _binned(ready: DataFrame, fitted: PipelineModel, filled: Sequence[str], bins: int) -> tuple[list, list[str]]:
    """(stages that part numbers into bins, as trees do; names of the numbers, of which those that are parted are bins)."""
    numbers = fitted.transform(ready).select(*filled)
    kinds = numbers.agg(*[F.approx_count_distinct(c).alias(c) for c in filled]).first().asDict() if filled else {}
    many = [c for c in filled if kinds[c] > bins]
    if not many:
        return [], list(filled)
    parted = QuantileDiscretizer(inputCols=many, outputCols=[f"{c}_bin" for c in many], numBuckets=bins, relativeError=BIN_ERROR, handleInvalid="keep")
    return [parted.fit(numbers)], [f"{c}_bin" if c in many else c for c in filled]


def _cells(rows: DataFrame, inputs: Sequence[str], weight: str | None = None, by: Sequence[str] = (), mean: bool = False) -> DataFrame:
    """Rows that are equal in ``inputs``, ``_label`` and ``by`` as one, with ``_n``: how many, or the sum of their ``weight``. ``mean``: rows of
    all labels are one, with the labels' mean, which squared errors can't tell from the rows. Written, as learners read it often."""
    # A bin is a number, not a class, so what says so of its column goes.
    kept = [F.col(c).alias(c, metadata={}) if c.endswith("_bin") else F.col(c) for c in inputs]
    n = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    if mean:
        w = F.lit(1.0) if weight is None else F.col(weight)
        made = rows.select(*kept, *by, "_label", *([weight] if weight else [])).groupBy(*inputs, *by).agg((F.sum(F.col("_label") * w) / F.sum(w)).alias("_label"), n.alias("_n"))
    else:
        made = rows.select(*kept, *by, "_label", *([weight] if weight else [])).groupBy(*inputs, *by, "_label").agg(n.alias("_n"))
    return written(made, "cells")


#: A share of rows tells when to stop boosting: once a round lowers their loss by less than this part of it.
VALIDATION_SHARE, LEAST_GAIN, MOST_ROUNDS, LEAST_ROUNDS = 0.1, 0.001, 200, 10


def learner(df: DataFrame, columns: Sequence[str], kind: str, classes: int, seed: int = 0, iterations: int = 20, weight: str | None = None, validation: str | None = None) -> tuple[Preparation, PipelineModel, list[str] | None]:
    """(preparation, fitted pipeline of imputation, category codes and boosted trees, their inputs); a forest, without inputs, for more than two
    classes. With a ``validation`` column, trees stop where rows that it marks gain no more; ``iterations`` is the most there can be.

    All rows are learnt from, but trees are boosted over cells: rows equal in their inputs (large numbers in bins) and label are one row that weighs as
    many, so each of the many passes is over cells. A forest resamples rows, so it takes them one by one."""
    prep, steps, filled, coded = _features(df, columns)
    bins = max(BINS, prep.levels + 2)
    assembled = lambda names: VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")
    common = {"featuresCol": "_features", "labelCol": "_label", "seed": seed, "maxBins": bins}
    ready, _ = prep.apply(df)
    if kind != "regression" and classes > 2:
        steps += [assembled(filled + coded), RandomForestClassifier(numTrees=50, **common, **({"weightCol": weight} if weight else {}))]
        return prep, Pipeline(stages=steps).fit(ready), None
    fitted = Pipeline(stages=steps).fit(ready)
    parted, numbers = _binned(ready, fitted, filled, bins)
    inputs = numbers + coded
    first = PipelineModel(stages=[*fitted.stages, *parted])
    cells = _cells(first.transform(ready), inputs, weight, [validation] if validation else [], mean=kind == "regression" and not validation)
    boost = {"maxIter": iterations, "weightCol": "_n"} | ({"validationIndicatorCol": validation, "validationTol": LEAST_GAIN} if validation else {})
    trees = (GBTRegressor if kind == "regression" else GBTClassifier)(**boost, **common)
    return prep, PipelineModel(stages=[*first.stages, assembled(inputs), trees.fit(assembled(inputs).transform(cells))]), inputs


@dataclass
class Model:
    prep: Preparation
    fitted: PipelineModel
    kind: str
    classes: list[str] = field(default_factory=list)
    log: bool = False
    inputs: list[str] | None = None  # what boosted trees see of a row

    @property
    def rounds(self) -> int | None:
        """How many trees were boosted; None for other models."""
        last = self.fitted.stages[-1]
        return last.getNumTrees if isinstance(last, GBTRegressionModel | GBTClassificationModel) else None

    def cells(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep``, what ``predict`` tells, and ``_n``: rows that are equal in ``keep`` and in what the trees see are told once, and counted."""
        if self.inputs is None:
            return self.predict(df).withColumn("_n", F.lit(1))
        *first, assembler, trees = self.fitted.stages
        cells = PipelineModel(stages=first).transform(self.prep.apply(df)[0]).groupBy(*keep, *self.inputs).agg(F.count(F.lit(1)).alias("_n"))
        return self._told(PipelineModel(stages=[assembler, trees]).transform(cells), [*keep, "_n"])

    def predict(self, df: DataFrame) -> DataFrame:
        """``prediction`` (a class's number for classification), and ``probability`` of the last class, with ``said``, the class's name."""
        return self._told(self.fitted.transform(self.prep.apply(df)[0]), df.columns)

    def _told(self, out: DataFrame, columns: Sequence[str]) -> DataFrame:
        keep = [*columns, "prediction"]
        if self.kind == "regression":
            return out.withColumn("prediction", F.expm1("prediction") if self.log else F.col("prediction")).select(*keep)
        p = vector_to_array("probability")
        names = F.element_at(F.lit(self.classes), F.col("prediction").cast("int") + 1) if self.classes else F.lit(None).cast("string")
        return out.select(*keep, p[F.size(p) - 1].alias("probability"), names.alias("said"))


def use_weights(df: DataFrame, label: str) -> bool:
    """Whether the rarest of several classes has under a tenth of the rows."""
    least, n, k = df.groupBy(label).count().agg(F.min("count"), F.sum("count"), F.count(F.lit(1))).first()
    return bool(k and k > 1 and least / n < RARE_CLASS)


def train(df: DataFrame, target: str, columns: Sequence[str], kind: str | None = None, seed: int = 0, iterations: int = 20, weights: str = "auto", log: bool = False, stop_early: bool = False) -> Model:
    """Boosted trees, or a forest for several classes. ``weights``: classes count alike with "yes", and with "auto" where one
    is rare. ``log``: learn log(1 + target). ``stop_early``: a tenth of the rows, by hash of what is in them, isn't learnt from
    and says after how many of up to ``iterations`` rounds to stop."""
    kind = kind or problem_kind(df, target)
    rows = df.where(F.col(target).isNotNull())
    if kind == "regression":
        rows, classes = rows.withColumn("_label", F.log1p(F.col(target).cast("double")) if log else F.col(target).cast("double")), []
    else:
        rows, classes = labelled(rows, target)
    weighted = kind != "regression" and (weights == "yes" or weights == "auto" and use_weights(rows, "_label"))
    if weighted:
        rows = balanced_weights(rows, "_label").withColumnRenamed("weight", "_weight")
    if stop_early:
        chance = F.pmod(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], F.lit(seed)), F.lit(1_000))
        rows = rows.withColumn("_validation", chance < int(1_000 * VALIDATION_SHARE))
    prep, fitted, inputs = learner(rows, columns, kind, len(classes), seed, iterations, "_weight" if weighted else None, "_validation" if stop_early else None)
    return Model(prep, fitted, kind, classes, log, inputs)


def splits(df: DataFrame, row: str, folds: int = 3, how: str = "random", seed: int = 0, target: str | None = None, time: str | None = None, group: str | None = None, one_split_from: int | None = None):
    """Pairs (learnt from, tested on); every row is tested once, but in order of time, where tests are always on later rows than
    those learnt from. ``one_split_from``: from so many rows on, a caller may have a single split, a fifth (in order of
    time, the last) for tests; by default there is none at any size."""
    once = one_split_from is not None and df.count() > one_split_from
    if how == "time":
        marked = written(with_folds(df, row, 4 if once else folds, how, seed, target, time, group), "folds")
        for k in [4] if once else range(1, folds + 1):
            yield marked.where(F.col("_fold") < k).drop("_fold"), marked.where(F.col("_fold") == k).drop("_fold")
        return
    marked = with_folds(df, row, 5 if once else folds, how, seed, target, time, group)
    if how == "stratified":
        marked = written(marked, "folds")
    for k in [0] if once else range(folds):
        yield marked.where(F.col("_fold") != k).drop("_fold"), marked.where(F.col("_fold") == k).drop("_fold")


def _known(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target, written: models read them many times, and what they come from is worked out once."""
    return written(df.where(F.col(target).isNotNull()), "known")


def out_of_fold(df: DataFrame, row: str, target: str, columns: Sequence[str], folds: int = 3, seed: int = 0, iterations: int = 20, how: str = "random", time: str | None = None, group: str | None = None, kind: str | None = None, **options) -> DataFrame:
    """Rows predicted by models that haven't seen them (see ``splits``): every row; by time, those after the first part."""
    df = _known(df, target)
    kind = kind or problem_kind(df, target)
    some = on_splits(splits(df, row, folds, how, seed, target, time, group), lambda learnt, tested: train(learnt, target, columns, kind, seed, iterations, **options).predict(tested))
    return reduce(DataFrame.unionByName, some)


def final_fit(df: DataFrame, row: str, target: str, columns: Sequence[str], folds: int = 3, seed: int = 0, most_rounds: int = MOST_ROUNDS, how: str = "random", time: str | None = None, group: str | None = None, kind: str | None = None, **options) -> tuple[DataFrame, Model, list[int]]:
    """(rows predicted by models that haven't seen them, the model of all rows, the rounds of each fold's model). Boosting stops
    early in each fold; the last model learns from all rows for as many rounds as the folds' median, ten at least."""
    rows = _known(df, target)
    kind = kind or problem_kind(rows, target)

    def one(learnt: DataFrame, tested: DataFrame):
        model = train(learnt, target, columns, kind, seed, most_rounds, stop_early=True, **options)
        return model.predict(tested), model.rounds

    found = on_splits(splits(rows, row, folds, how, seed, target, time, group), one)
    rounds = [n for _, n in found if n is not None]
    median = max(LEAST_ROUNDS, sorted(rounds)[len(rounds) // 2]) if rounds else most_rounds
    return reduce(DataFrame.unionByName, [p for p, _ in found]), train(rows, target, columns, kind, seed, median, **options), rounds


def on_splits(parts, work) -> list:
    """``work`` of each pair of parts; their Spark jobs run side by side, as one model's many small jobs leave a cluster idle."""
    parts = list(parts)
    with ThreadPoolExecutor(len(parts)) as pool:
        return list(pool.map(lambda p: work(*p), parts))


def linear_reference(df: DataFrame, row: str, target: str, columns: Sequence[str], folds: int = 3, seed: int = 0, how: str = "random", time: str | None = None, group: str | None = None, penalty: float = 1.0) -> DataFrame:
    """The simple model to compare with, on the same splits: medians for missing cells, standard scores, categories as flags, then
    ridge or logistic regression. Rows with ``prediction`` (and ``probability`` of the last of two classes). Rare classes get weights
    as in ``train``. ``penalty`` is that of the sum of squares, so its weight falls with the number of rows."""
    df = _known(df, target)
    kind = problem_kind(df, target)

    def one(learnt: DataFrame, tested: DataFrame) -> DataFrame:
        rows, classes = labelled(learnt, target) if kind != "regression" else (learnt.withColumn("_label", F.col(target).cast("double")), [])
        prep, steps, filled, coded = _features(rows, columns)
        early, parts = len(steps), []
        if filled:
            steps += [VectorAssembler(inputCols=filled, outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
            parts.append("_scaled")
        if coded:
            steps.append(OneHotEncoder(inputCols=coded, outputCols=[f"{c}_flags" for c in coded], handleInvalid="keep"))
            parts += [f"{c}_flags" for c in coded]
        steps.append(VectorAssembler(inputCols=parts, outputCol="_features"))
        weight = None
        if kind != "regression" and use_weights(rows, "_label"):
            rows, weight = balanced_weights(rows, "_label").withColumnRenamed("weight", "_weight"), "_weight"
        n = max(rows.count(), 1)
        ready, _ = prep.apply(rows)
        stages = Pipeline(stages=steps).fit(ready).stages
        cells = _cells(PipelineModel(stages=stages[:early]).transform(ready), filled + coded, weight)  # as many passes as rounds
        common = {"featuresCol": "_features", "labelCol": "_label", "weightCol": "_n", "regParam": penalty / n, "standardization": False}
        line = LinearRegression(**common) if kind == "regression" else LogisticRegression(maxIter=300, **common)
        return Model(prep, PipelineModel(stages=[*stages, line.fit(PipelineModel(stages=stages[early:]).transform(cells))]), kind, classes).predict(tested)

    return reduce(DataFrame.unionByName, on_splits(splits(df, row, folds, how, seed, target, time, group), one))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, rmse, mae, r2, bias, and the error of predicting the mean."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    mean = df.agg(F.avg(y).alias("_m"))
    both = df.join(F.broadcast(mean))
    e = p - y
    return both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.sum((y - F.col("_m")) * (y - F.col("_m"))))).alias("r2"), F.avg(e).alias("bias"), F.avg(F.abs(y - F.col("_m"))).alias("mae_of_mean"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, balanced accuracy and macro F1 from one table of counts."""
    pairs = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_a = pairs.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("real"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = pairs.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said"))
    both = by_a.join(by_p, "c", "full").na.fill(0)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("real") + F.col("said")), F.lit(0.0))
    return both.agg((F.sum("hit") / F.sum("real")).alias("accuracy"), F.avg(F.try_divide(F.col("hit").cast("double"), F.when(F.col("real") > 0, F.col("real")))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc of a 0/1 label from average ranks of the scores."""
    ranked = average_ranks(df.select(F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s")), "_s", "_r")
    sums = ranked.agg(F.sum(F.when(F.col("_y") == 1, F.col("_r"))).alias("r"), F.count(F.when(F.col("_y") == 1, 1)).alias("p"), F.count(F.when(F.col("_y") == 0, 1)).alias("q"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p").cast("double") * F.col("q")).alias("auc"))


def probability_metrics(df: DataFrame, label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """n, positives, log_loss, brier, brier_of_rate (always telling the overall rate), average_precision, and recall and precision
    of the 1s from ``threshold`` on. Rows without either are left out.

    Average precision sweeps the different probabilities from the greatest on, equal ones in one step; its running counts go
    by ranges, so no task sorts all rows."""
    y, p = F.col(label).cast("double").alias("y"), F.col(probability).cast("double").alias("p")
    rows = df.select(y, p).where("y is not null and p is not null and not isnan(p)")
    inside = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    said = F.col("p") >= threshold
    plain = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).cast("long").alias("positives"), F.avg(-F.when(F.col("y") == 1, F.ln(inside)).otherwise(F.ln(1 - inside))).alias("log_loss"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), (F.avg("y") * (1 - F.avg("y"))).alias("brier_of_rate"),
        F.try_divide(F.sum(F.when(said, F.col("y"))), F.sum("y")).alias("recall"), F.avg(F.when(said, F.col("y"))).alias("precision"),
    )
    steps = rows.groupBy("p").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y")).withColumn("_at", -F.col("p"))
    swept = running_sums(written(steps, "sweep"), "_at", {"_seen": F.col("_n"), "_hit": F.col("_y")})
    area = swept.agg(F.try_divide(F.sum(F.col("_y") * F.col("_hit") / F.col("_seen")), F.sum("_y")).alias("average_precision"))
    return plain.join(F.broadcast(area)).select("n", "positives", "log_loss", "brier", "brier_of_rate", "average_precision", "recall", "precision")


def several_class_auc(df: DataFrame, actual: str, probabilities: dict[str, str]) -> DataFrame:
    """(class, auc): each class against the others by its own probability's column, all ranked in one pass; the mean of the classes
    that occur is the measure of all."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("s")) for k, c in probabilities.items()])).alias("e")
    rows = df.select(F.col(actual).cast("string").alias("_a"), each).select("_a", "e.*").where("s is not null")
    ranked = average_ranks(rows, "s", "_r", by=["class"]).withColumn("_is", F.col("_a") == F.col("class"))
    of = ranked.groupBy("class").agg(F.sum(F.when(F.col("_is"), F.col("_r"))).alias("r"), F.count(F.when(F.col("_is"), 1)).cast("double").alias("p"), F.count(F.lit(1)).alias("n"))
    return of.select("class", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def calibration(df: DataFrame, label: str, probability: str, tie: str) -> DataFrame:
    """n, bins, ece, brier, tolerance, calibrated (ece within the tolerance; null where under 200 rows or 20 of a class can't tell).
    Bins of equal counts, one for each 50 rows, from 2 to 10; the tolerance is 0.05 + 0.5 / sqrt(n)."""
    rows = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull())
    n, ones, brier = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)), F.avg(F.pow(F.col(probability) - F.col(label).cast("double"), F.lit(2)))).first()
    bins = min(max(n // 50, 2), 10)
    told = n >= CALIBRATION_ROWS and min(ones, n - ones) >= CALIBRATION_EACH
    tolerance = CALIBRATION_SLACK[0] + CALIBRATION_SLACK[1] / max(n, 1) ** 0.5
    ece = calibration_error(reliability(rows, label, probability, tie, bins))
    judged = (F.col("ece") <= tolerance) if told else F.lit(None).cast("boolean")
    return ece.select(F.lit(n).cast("long").alias("n"), F.lit(bins).alias("bins"), "ece", F.lit(brier).cast("double").alias("brier"), F.lit(tolerance).alias("tolerance"), judged.alias("calibrated"))


def helpful_calibrator(df: DataFrame, row: str, label: str, probability: str):
    """(calibrator or None, before, after): one that has proved itself. Each half of the rows (by hash) is judged by a calibrator of
    the other half; only if their error is within the tolerance and under 0.8 of what it was is one fitted on all rows."""
    half = F.pmod(F.xxhash64(F.col(row), F.lit(1)), F.lit(2))
    rows = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).withColumn("_half", half)
    before = calibration(rows, label, probability, row).first()
    if before["calibrated"] is None:
        return None, before["ece"], None
    parts = [rows.where(F.col("_half") == k) for k in (0, 1)]
    crossed = reduce(DataFrame.unionByName, [calibrator(parts[1 - k], label, probability)(parts[k]).select(row, label, "calibrated") for k in (0, 1)])
    after = calibration(crossed, label, "calibrated", row).first()
    helps = after["ece"] <= after["tolerance"] and after["ece"] < CALIBRATION_GAIN * before["ece"]
    return (calibrator(rows, label, probability) if helps else None), before["ece"], after["ece"]


def reliability(df: DataFrame, label: str, probability: str, tie: str, bins: int) -> DataFrame:
    """(bin, n, mean_p, rate): equal counts in order of probability, larger bins first. Positions come from range-wise sums."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(probability).cast("double").alias("p"), F.col(tie).alias("tie"))
    placed = running_sums(rows, "p", {"i": F.lit(1)}, ["tie"])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    size, more = F.floor(F.col("n") / bins), F.col("n") % bins
    large = more * (size + 1)
    at = F.col("i") - 1
    number = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1))))
    return placed.join(F.broadcast(n)).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    """ece: the mean distance of a bin's probability from its rate, by rows."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def calibrator(df: DataFrame, label: str, probability: str):
    """Isotonic from 1000 rows with 50 of each class; else logistic over the logit. Returns a function of a DataFrame that adds ``calibrated``."""
    y, p = F.col(label).cast("double"), F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    n, ones = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    if n >= 1000 and min(ones, n - ones) >= 50:
        fitted = IsotonicRegression(featuresCol="_p", labelCol="_y").fit(df.select(y.alias("_y"), p.alias("_p")))
        return lambda rows: fitted.setPredictionCol("calibrated").transform(rows.withColumn("_p", p)).drop("_p")
    assemble = VectorAssembler(inputCols=["_l"], outputCol="_v")
    logit = F.ln(p / (1 - p))
    fitted = LogisticRegression(featuresCol="_v", labelCol="_y").fit(assemble.transform(df.select(y.alias("_y"), logit.alias("_l"))))
    slope, level = float(fitted.coefficients[0]), float(fitted.intercept)
    return lambda rows: rows.withColumn("calibrated", 1 / (1 + F.exp(-(slope * logit + level))))


def permutation_importance(df: DataFrame, row: str, target: str, columns: Sequence[str], folds: int = 3, repeats: int = 5, seed: int = 0, iterations: int = 20) -> DataFrame:
    """(column, importance, spread): by how much the mean absolute error of rows that the model hasn't seen grows when a column is
    dealt anew among them; the mean and standard deviation of ``repeats`` seeded dealings, over all folds.

    All tested rows take part. They're first put in order of a hash, so any run of them is a chance sample; a task deals a column among the rows of each of its batches,
    marks copies with column and repeat, and one prediction of all copies gives the errors: of each cell of equal copies once."""
    df = _known(df, target)
    kind = problem_kind(df, target)
    kinds, names = dict(df.dtypes), list(columns)
    keep = [row, target, *names]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_column string, _repeat int"])

    def dealt(batches):
        for batch in batches:
            rng = np.random.default_rng([seed, batch.num_rows, *(xxhash.xxh32_intdigest(str(batch.column(0)[k].as_py())) for k in (0, batch.num_rows - 1))] if batch.num_rows else seed)
            for c, k in [(None, 0), *((c, k) for c in names for k in range(repeats))]:
                arrays = [batch.column(x).take(pa.array(rng.permutation(batch.num_rows))) if x == c else batch.column(x) for x in keep]
                tags = [pa.array([c] * batch.num_rows, pa.string()), pa.array([k] * batch.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *tags], [*keep, "_column", "_repeat"])

    def one(learnt: DataFrame, tested: DataFrame) -> DataFrame:
        model = train(learnt, target, columns, kind, seed, iterations)
        copies = tested.select(*keep).withColumn("_h", F.xxhash64(row, F.lit(seed))).repartition("_h").sortWithinPartitions("_h").drop("_h").mapInArrow(dealt, schema)
        if kind == "regression":
            error = F.abs(F.col("prediction") - F.col(target).cast("double"))
        elif len(model.classes) == 2:
            error = F.abs(F.col("probability") - (F.col(target).cast("string") == model.classes[1]).cast("double"))
        else:
            error = (F.col("said") != F.col(target).cast("string")).cast("double")
        seen = model.cells(copies, [target, "_column", "_repeat"])
        return seen.groupBy("_column", "_repeat").agg(F.sum(error * F.col("_n")).alias("e"), F.sum("_n").alias("n"))

    errors = reduce(DataFrame.unionByName, on_splits(splits(df, row, folds, seed=seed), one))
    mean = errors.groupBy("_column", "_repeat").agg((F.sum("e") / F.sum("n")).alias("e"))
    base = mean.where("_column is null").select(F.col("e").alias("_base"))
    grown = mean.where("_column is not null").join(F.broadcast(base)).groupBy(F.col("_column").alias("column")).agg(F.avg(F.col("e") - F.col("_base")).alias("importance"), F.coalesce(F.stddev_pop("e"), F.lit(0.0)).alias("spread"))
    return grown


def explain_rows(model: Model, df: DataFrame, row: str, columns: Sequence[str], top: int = 2, typical_of: DataFrame | None = None) -> DataFrame:
    """(row, column, effect): the columns whose replacement by their median (or most frequent value) in ``typical_of`` lowers a row's score most."""
    guess = "prediction" if model.kind == "regression" else "probability"
    kinds = dict(df.dtypes)
    whole = typical_of if typical_of is not None else df
    number = lambda c: kinds[c] in NUMERIC
    typical = whole.agg(*[(F.median(c) if number(c) else F.mode(c, True)).cast(kinds[c]).alias(c) for c in columns]).first()
    base = model.predict(df).select(F.col(row).alias("row"), F.col(guess).alias("base"))
    out = None
    for c in columns:
        one = model.predict(df.withColumn(c, F.lit(typical[c]).cast(kinds[c]))).select(F.col(row).alias("row"), F.lit(c).alias("column"), F.col(guess).alias("without"))
        out = one if out is None else out.unionByName(one)
    effect = out.join(base, "row").select("row", "column", (F.col("base") - F.col("without")).alias("effect")).where("effect > 0")
    return effect.withColumn("_k", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("effect"), "column"))).where(F.col("_k") <= top).drop("_k")


def review_list(df: DataFrame, row: str, actual: str, predicted: str, n: int = 50) -> DataFrame:
    """The rows with the greatest errors."""
    return df.select(F.col(row).alias("row"), F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.abs(F.col(actual) - F.col(predicted)).alias("error")).orderBy(F.desc("error"), "row").limit(n)


def verdict(error: float, reference: float, top_share: float = 0.0) -> str:
    """By how much better than the reference: from 0.8 very good, 0.5 good, 0.2 fair; suspicious if near perfect or one column decides."""
    better = 1 - error / reference if reference else 0.0
    if better >= 0.995 or top_share >= 0.85:
        return "suspicious"
    return "very good" if better >= 0.8 else "good" if better >= 0.5 else "fair" if better >= 0.2 else "no better"


def returns_regression(pairs: DataFrame, actual: str, predicted: str, promised_mae: float) -> DataFrame:
    """n, mae, bias, ratio to the promised error, level: info under 30 cases, well up to 1.25 times, watch up to 2, else alert."""
    out = regression_metrics(pairs, actual, predicted).select("n", "mae", "bias").withColumn("ratio", F.col("mae") / F.lit(promised_mae))
    return out.withColumn("level", F.when(F.col("n") < 30, "info").when(F.col("ratio") <= 1.25, "well").when(F.col("ratio") <= 2, "watch").otherwise("alert"))


def _against(measured: Column, promised: float | None, n: Column) -> Column:
    """info under 30 cases or without a promise; well down to a tolerance of 0.05 + 0.5 / sqrt(n) below it, watch down to twice, else alert."""
    if promised is None:
        return F.lit("info")
    slack = CALIBRATION_SLACK[0] + CALIBRATION_SLACK[1] / F.sqrt(n)
    return F.when(n < 30, "info").when(measured >= promised - slack, "well").when(measured >= promised - 2 * slack, "watch").otherwise("alert")


def _least(level: Column, worse: Column) -> Column:
    """``level``, but no better than watch where ``worse``."""
    return F.when(worse & level.isin("info", "well"), "watch").otherwise(level)


def returns_classes(pairs: DataFrame, actual: str, predicted: str, promised: float | None = None) -> DataFrame:
    """n, accuracy, balanced_accuracy, majority (of always saying the most frequent class), level: the balanced accuracy against what was
    promised; watch at best where the accuracy is no better than the majority's."""
    real = pairs.where(F.col(actual).isNotNull())
    counts = real.groupBy(F.col(actual).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("majority"))
    out = class_metrics(real, actual, predicted).join(F.broadcast(counts))
    level = _least(_against(F.col("balanced_accuracy"), promised, F.col("n")), F.col("accuracy") <= F.col("majority") + 0.005)
    return out.select("n", "accuracy", "balanced_accuracy", "majority", level.alias("level"))


def returns_probabilities(pairs: DataFrame, row: str, label: str, probability: str) -> DataFrame:
    """n, brier, brier_of_rate, ece, tolerance, level: well while the probabilities hold to the tolerance, watch to twice of it, else
    alert, and info where too few cases tell; watch at best where always telling the overall rate does as well."""
    told = calibration(pairs, label, probability, row)
    rate = probability_metrics(pairs, label, probability).select("brier_of_rate")
    out = told.join(F.broadcast(rate))
    level = F.when(F.col("calibrated").isNull(), "info").when(F.col("ece") <= F.col("tolerance"), "well").when(F.col("ece") <= 2 * F.col("tolerance"), "watch").otherwise("alert")
    return out.select("n", "brier", "brier_of_rate", "ece", "tolerance", _least(level, F.col("brier") >= F.col("brier_of_rate")).alias("level"))


def returns_ranking(pairs: DataFrame, label: str, score: str, promised: float | None = None) -> DataFrame:
    """n, auc, level: against the promised one; watch at best up to 0.55. Null, and info, with one class alone."""
    known = pairs.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    out = rank_auc(known, label, score).join(F.broadcast(known.agg(F.count(F.lit(1)).alias("n"))))
    level = F.when(F.col("auc").isNull(), "info").otherwise(_least(_against(F.col("auc"), promised, F.col("n")), F.col("auc") <= 0.55))
    return out.select("n", "auc", level.alias("level"))


def unseen_values(train_rows: DataFrame, test_rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unseen_rows, unseen_values): cells of the test's categories whose value no training row has."""
    cells = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = cells(test_rows).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    new = counts.join(cells(train_rows).distinct(), ["column", "value"], "left_anti")
    every = test_rows.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(new.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")), "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("unseen_rows"), F.coalesce("v", F.lit(0)).alias("unseen_values"))


def confident_mistakes(df: DataFrame, row: str, actual: str, said: str, confidence: str, n: int = 50) -> DataFrame:
    """(row, actual, said, confidence): rows whose class was told wrongly, the most confident first."""
    wrong = df.where(F.col(actual).cast("string") != F.col(said).cast("string"))
    return wrong.select(F.col(row).alias("row"), F.col(actual).alias("actual"), F.col(said).alias("said"), F.col(confidence).alias("confidence")).orderBy(F.desc("confidence"), "row").limit(n)
