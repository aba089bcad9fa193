"""Exact quantiles, modes and running sums against plain Python, with tiny buffers, so that brackets and ranges are really used."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.anomalies import robust_statistics
from tidemark.operators.indicators import Indicator, box_plot, compute, describe


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "ACCURACY", 200)
    monkeypatch.setattr(ordered, "MARGIN", 0.05)
    monkeypatch.setattr(ordered, "FEW_ROWS", 40)


@pytest.mark.parametrize("window", [10, 1_000_000])
@pytest.mark.parametrize("few", [40, 1_000_000])
def test_quantiles_of_hot_and_small_groups(spark, small, monkeypatch, window, few):
    monkeypatch.setattr(ordered, "WINDOW_VALUES", window)
    monkeypatch.setattr(ordered, "FEW_ROWS", few)
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6_000)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [(None, 4.0), (None, 1.0), ("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["q"]) for r in ordered.quantiles(df, {"x": F.col("x")}, [0.0, 0.25, 0.5, 1.0], ["g"]).collect()}
    want = {}
    for g, x in rows:
        if x is not None:
            want.setdefault(g, []).append(x)
    assert got.keys() == want.keys()
    for g, xs in want.items():
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(np.quantile(xs, [0.0, 0.25, 0.5, 1.0]).tolist())


def test_several_columns_and_no_rows(spark, small):
    df = spark.createDataFrame([(float(k % 7), k) for k in range(900)], "a double, b long")
    got = {r["column"]: r["q"] for r in ordered.quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5, 0.9]).collect()}
    assert got["a"] == pytest.approx(np.quantile([k % 7 for k in range(900)], [0.5, 0.9])) and got["b"] == pytest.approx([449.5, 809.1])
    assert ordered.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]).count() == 0
    assert robust_statistics(df.limit(0), "a").count() <= 1
    assert describe(df.limit(0), "a").first()["n"] == 0 and describe(df.limit(0), "a").first()["mode"] is None


def test_statistics_on_top_of_it(spark, small):
    rng = random.Random(5)
    xs = [rng.expovariate(1) for _ in range(3_000)] + [2.0] * 40
    df = spark.createDataFrame([(x, "a" if k % 3 else "b") for k, x in enumerate(xs)], "x double, g string")
    s = robust_statistics(df, "x").first()
    assert (s["n"], s["median"]) == (len(xs), pytest.approx(np.median(xs))) and s["mad"] == pytest.approx(np.median(np.abs(np.array(xs) - np.median(xs))))
    by = {r["g"]: r["mad"] for r in robust_statistics(df, "x", ["g"]).collect()}
    for g in "ab":
        of = np.array([x for k, x in enumerate(xs) if ("a" if k % 3 else "b") == g])
        assert by[g] == pytest.approx(np.median(np.abs(of - np.median(of))))
    assert describe(df, "x").first()["mode"] == 2.0
    assert box_plot(df, "x").first()["q3"] == pytest.approx(np.quantile(xs, 0.75))


@pytest.mark.parametrize(("rows_a_range", "halves"), [(1_000_000, 128), (50, 128), (50, 4)])
def test_running_sums_by_ranges(spark, monkeypatch, rows_a_range, halves):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", rows_a_range)
    monkeypatch.setattr(ordered, "BORDERS_BY_HALVES", halves)
    rng = random.Random(7)
    rows = [(rng.choice([None, float("nan"), 1.0, 1.0, 1.0, rng.random()]), k, k % 4) for k in range(2_000)]
    df = spark.createDataFrame(rows, "x double, k long, v long")
    got = {r["k"]: r["s"] for r in ordered.running_sums(df, "x", {"s": F.col("v")}, ["k"]).collect()}
    total, want = 0, {}
    for _, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] is not None and r[0] != r[0], r[0] if r[0] == r[0] and r[0] is not None else 0, r[1])):
        total += v
        want[k] = total
    assert got == want
    assert ordered.running_sums(df.limit(0), "x", {"s": F.col("v")}, ["k"]).count() == 0


def test_trailing_windows_of_a_hot_key(spark):
    """One key holds nearly all rows; no window has more than those of two buckets of its time."""
    rng = random.Random(9)
    rows = [("hot" if k % 50 else f"k{k}", rng.randrange(10_000), k, float(k % 5)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    out = ordered.trailing(df, "k", "t", 100, {"n": F.count("v"), "s": F.sum("v")})
    got = {r["id"]: (r["n"], r["s"]) for r in out.collect()}
    assert len(got) == 3_000
    for k, t, i, _ in rows[::37]:
        before = [v for k2, t2, _, v in rows if k2 == k and t - 100 <= t2 < t]
        assert got[i] == (len(before), sum(before) if before else None)
    both = df.withColumn("b", F.explode(F.array(F.floor(F.col("t") / 100), F.floor(F.col("t") / 100) + 1)))
    assert both.groupBy("k", "b").count().agg(F.max("count")).first()[0] < 120


def test_medians_of_indicators_are_selected(spark, monkeypatch):
    """No aggregate of an indicator holds a whole column, and no rows or no numbers still give a null."""
    monkeypatch.setattr(ordered, "FEW_ROWS", 100)
    df = spark.range(5_001).select((F.pmod(F.xxhash64("id"), F.lit(9_973)) / 7).alias("a"), F.when(F.col("id") < 0, 1.0).alias("none"))
    k = [Indicator("n", "count", "a"), Indicator("middle", "median", "a"), Indicator("nothing", "median", "none")]
    made = compute(df, k)
    assert "median(" not in made._jdf.queryExecution().analyzed().toString()
    want = float(np.median([r[0] for r in df.select("a").collect()]))
    assert {r["name"]: r["value"] for r in made.collect()} == {"n": 5_001.0, "middle": pytest.approx(want, rel=1e-12), "nothing": None}
    assert [r["value"] for r in compute(df.where("a < 0"), k).collect()] == [None, None, None]
