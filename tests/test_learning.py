"""Early stopping, calibration that must help, returns and their levels on planted data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learning as ml
from tidemark.operators import prepared as pr


def test_all_rows_are_folded_at_any_size(spark):
    df = spark.range(160_000).withColumn("y", F.col("id") % 2)
    tested = [t.count() for _, t in ml.splits(df, "id")]
    assert len(tested) == 3 and sum(tested) == 160_000
    once = list(ml.splits(df, "id", one_split_from=150_000))
    assert len(once) == 1 and 0.15 < once[0][1].count() / 160_000 < 0.25


def test_boosting_stops_where_more_rounds_hurt(spark):
    rng = random.Random(2)
    rows = [(k, rng.random(), rng.random(), float(rng.random() < 0.5)) for k in range(900)]
    noise = spark.createDataFrame(rows, "id long, a double, b double, y double").withColumn("y", F.col("y").cast("int"))
    stopped = ml.train(noise, "y", ["a", "b"], "classification", iterations=30, stop_early=True)
    assert stopped.rounds < 30 == ml.train(noise, "y", ["a", "b"], "classification", iterations=30).rounds
    judged, model, rounds = ml.final_fit(noise, "id", "y", ["a", "b"], most_rounds=30, kind="classification")
    assert judged.count() == 900 and len(rounds) == 3 and model.rounds == max(ml.LEAST_ROUNDS, sorted(rounds)[1])
    assert ml.final_fit(noise.limit(0).unionByName(noise.limit(60)), "id", "y", ["a"], folds=2, most_rounds=3, kind="classification")[0].count() == 60


def test_a_calibrator_stays_only_if_it_helps(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.02, 0.98, 3_000)
    y = (rng.random(3_000) < p).astype(int)
    squeezed = [(k, int(a), float(0.4 + 0.2 * b)) for k, (a, b) in enumerate(zip(y, p, strict=True))]
    df = spark.createDataFrame(squeezed, "id long, y int, p double")
    fitted, before, after = ml.helpful_calibrator(df, "id", "y", "p")
    assert fitted is not None and after < 0.8 * before and fitted(df).select("calibrated").count() == 3_000
    honest = spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "id long, y int, p double")
    assert ml.helpful_calibrator(honest, "id", "y", "p")[0] is None and ml.calibration(honest, "y", "p", "id").first()["calibrated"]
    assert ml.helpful_calibrator(honest.limit(150), "id", "y", "p")[0] is None and ml.calibration(honest.limit(150), "y", "p", "id").first()["calibrated"] is None


def test_levels_of_returns(spark):
    rows = [(k, "a" if k % 4 else "b", "a" if k % 4 else ("b" if k % 8 else "a"), k % 4 == 0, 0.9 if k % 8 == 0 else 0.1) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, real string, said string, bad boolean, p double").withColumn("bad", F.col("bad").cast("int"))
    level = lambda promised: ml.returns_classes(df, "real", "said", promised).first()["level"]
    assert (level(None), level(0.75), level(0.88), level(0.99)) == ("info", "well", "watch", "alert")
    assert ml.returns_classes(df.withColumn("said", F.lit("a")), "real", "said", 0.5).first()["level"] == "watch"
    assert ml.returns_classes(df.limit(20), "real", "said", 0.99).first()["level"] == "info"
    assert ml.returns_ranking(df, "bad", "p", 0.75).first()["level"] == "well" and ml.returns_ranking(df.where("bad = 1"), "bad", "p", 0.7).first()["auc"] is None
    got = ml.returns_probabilities(df, "id", "bad", "p").first()
    assert got["n"] == 400 and got["level"] in ("watch", "alert") or got["ece"] <= got["tolerance"]
    worst = ml.confident_mistakes(df, "id", "real", "said", "p", 3).collect()
    assert [(r["row"], r["confidence"]) for r in worst] == [(0, 0.9), (8, 0.9), (16, 0.9)]


def test_unseen_values_and_widths(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None)], "c string, d string")
    b = spark.createDataFrame([("x", "2"), ("z", "2"), ("z", None)], "c string, d string")
    assert {(r[0], r[1], r[2]) for r in ml.unseen_values(a, b, ["c", "d"]).collect()} == {("c", 2, 1), ("d", 2, 1)}
    child = spark.range(30).select((F.col("id") % 3).alias("key"), *[(F.col("id") * k).cast("double").alias(f"v{k}") for k in range(1, 16)])
    tables = {"base": spark.range(3).withColumnRenamed("id", "key"), "child": child}
    few = pr.widen(tables, "base", [pr.Link("base", "key", "child", "key")], "key")
    every = pr.widen(tables, "base", [pr.Link("base", "key", "child", "key")], "key", widths=pr.Widths(None, None, None))
    assert any("v13, v14, v15" in n for n in few[2]) and not every[2]
    assert sum("v15" in c for c in every[1]) and not sum("v15" in c for c in few[1])


def test_models_after_a_ranged_sum(spark):
    """A ranged sum before it in the same session doesn't keep a fitted model from being sent to tasks."""
    from tidemark.operators.ordered import running_sums

    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assert running_sums(df, "a", {"s": F.lit(1)}, ["id"]).count() == 300
    assert len(ml.linear_reference(df, "id", "y", ["a"]).collect()) == 300


def test_metrics_by_hand(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (None, 0.3), (1, None)]
    got = ml.probability_metrics(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert (got["n"], got["positives"]) == (4, 2) and got["average_precision"] == pytest.approx((1 * 0.5 + 1 * 2 / 3) / 2)
    assert got["log_loss"] == pytest.approx(-np.mean(np.log([0.9, 0.1, 0.5, 0.8]))) and got["recall"] == 1 and got["precision"] == pytest.approx(2 / 3)
    assert ml.probability_metrics(spark.createDataFrame([], "y int, p double"), "y", "p").first()["n"] == 0


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_boosting_over_cells_gives_the_trees_of_all_rows(spark, monkeypatch, kind):
    """Trees see equal rows as one row that weighs as many, and come out as from the rows one by one."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    u = F.pmod(F.xxhash64("id"), F.lit(1_000)) / 1_000
    df = spark.range(20_000).select("id", (F.col("id") % 8).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("double").alias("b"), u.alias("u"))
    y = F.col("a") * F.col("b") + F.col("u") if kind == "regression" else (F.col("u") * 12 < F.col("a") + F.col("b")).cast("int")
    df = df.withColumn("y", y)
    seen = []
    monkeypatch.setattr(ml, "_cells", lambda *a, cells=ml._cells, **k: seen.append(cells(*a, **k)) or seen[-1])
    got = ml.train(df, "y", ["a", "b"], kind, iterations=4).predict(df)
    assert seen[0].count() <= 80 and seen[0].agg(F.sum("_n")).first()[0] == 20_000
    plain = (GBTRegressor if kind == "regression" else GBTClassifier)(featuresCol="f", labelCol="y", maxIter=4, seed=0, maxBins=64, predictionCol="plain")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df.withColumn("y", F.col("y").cast("double")))
    both = plain.fit(rows).transform(rows).select("id", "plain").join(got.select("id", "prediction"), "id")
    assert both.where(F.abs(F.col("plain") - F.col("prediction")) > 1e-6).count() == 0


def test_large_numbers_are_learnt_from_in_bins(spark):
    df = spark.range(30_000).select("id", F.col("id").cast("double").alias("a"), (F.col("id") >= 15_000).cast("int").alias("y"))
    model = ml.train(df, "y", ["a"], "classification", iterations=2)
    assert "a_value_filled_bin" in model.inputs and model.predict(df).where("prediction != y").count() <= 2 * ml.BIN_ERROR * 30_000
    cells = model.cells(df, ["y"])
    assert cells.count() <= 2 * ml.BINS and cells.agg(F.sum("_n")).first()[0] == 30_000


def test_the_linear_reference_learns_from_cells(spark, monkeypatch):
    df = spark.range(6_000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(9)) < F.col("id") % 7).cast("int").alias("y"))
    seen = []
    monkeypatch.setattr(ml, "_cells", lambda *a, cells=ml._cells, **k: seen.append(cells(*a, **k)) or seen[-1])
    got = ml.linear_reference(df, "id", "y", ["a"], folds=2)
    assert len(seen) == 2 and all(c.count() <= 14 for c in seen) and sum(c.agg(F.sum("_n")).first()[0] for c in seen) == 6_000
    assert got.count() == 6_000 and ml.rank_auc(got, "y", "probability").first()["auc"] > 0.7
