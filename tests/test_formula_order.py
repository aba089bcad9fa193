"""Formulas that follow the order of rows: by ranges, with the results of one ordered pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.formula import calculated_column
from tidemark.operators import ordered
from tidemark.operators.ordered import strictly_before

RNG = np.random.default_rng(7)
VALUES = [None if k % 11 == 0 else float(x) for k, x in enumerate(RNG.choice([-1.5, -1.0, 0.5, 1.0, 1.25, 2.0], 500))]
ROWS = [(int(k), f"k{k:05d}", v) for k, v in zip(RNG.permutation(500), VALUES, strict=True)]


@pytest.mark.parametrize("order", ["k", "name"])
@pytest.mark.parametrize("call", ["cumsum()", "cumprod()", "rank()", "shift(1)", "shift(-3)", "diff(2)", "pct_change()"])
def test_ordered_methods(spark, call, order):
    df = spark.createDataFrame(ROWS, "k int, name string, v double")
    v = pd.DataFrame(ROWS, columns=["k", "name", "v"]).set_index("k").sort_index()["v"].astype(float)
    want = v.pct_change(fill_method=None) if call == "pct_change()" else eval(f"v.{call}")
    got = calculated_column(df, "x", f"[v].{call}", [order])
    assert got.columns == [*df.columns, "x"]
    x = pd.Series({r["k"]: r["x"] for r in got.collect()}, dtype=float).sort_index()
    assert len(x) == len(v) and np.allclose(x, want, equal_nan=True)


def test_no_single_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = calculated_column(spark.range(5_000).withColumn("v", F.col("id") * 1.0), "x", "[v].cumsum()", ["id"])
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows_a_range", [100, 1_000_000])
def test_strictly_before_under_one_key(spark, monkeypatch, rows_a_range):
    """A key that holds most rows, with many equal times, against a plain pass; in many ranges and in one."""
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", rows_a_range)
    rng = np.random.default_rng(9)
    rows = [(k, "hot" if rng.random() < 0.9 else "cold", int(rng.integers(0, 400)), None if rng.random() < 0.1 else float(rng.integers(-9, 9))) for k in range(3_000)]
    df = spark.createDataFrame(rows, "id int, k string, t long, v double")
    made = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.struct("t", "v"))}
    got = strictly_before(df, "k", "t", made)
    assert got.count() == 3_000 and got.columns == ["id", "k", "t", "v", *made]
    table = pd.DataFrame(rows, columns=["id", "k", "t", "v"])
    for r in got.collect():
        if r["id"] % 7 == 0:
            past = table[(table["k"] == r["k"]) & (table["t"] < r["t"])]
            known = past["v"].dropna()
            assert r["n"] == len(known)
            assert (r["s"], r["lo"]) == ((known.sum(), known.min()) if len(known) else (None, None))
            assert (r["hi"]["t"] if r["hi"] else None) == (past["t"].max() if len(past) else None)


@pytest.mark.parametrize("keys", [1, 2_000])
def test_strictly_before_tasks_of_bounded_rows(spark, monkeypatch, keys):
    """A task's rows don't grow with the table, by whatever ``spark.sql.shuffle.partitions``; with many keys and with one."""
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 200)
    df = spark.range(20_000).select((F.col("id") % keys).cast("string").alias("k"), F.col("id").alias("t"))
    got = strictly_before(df, "k", "t", {"n": ("count", F.col("t")), "last": ("max", F.col("t"))})
    held = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in held) == 20_000 and max(r["n"] for r in held) < 1_600
    last = F.when(F.col("t") >= keys, F.col("t") - keys)
    assert got.where((F.col("n") != F.floor(F.col("t") / keys)) | ~F.col("last").eqNullSafe(last)).count() == 0


@pytest.mark.parametrize("rows_a_range", [100, 1_000_000])
def test_previous_under_one_group(spark, monkeypatch, rows_a_range):
    """A group that holds most rows, a null group and null keys, against a plain pass; in many ranges and in one."""
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", rows_a_range)
    rng = np.random.default_rng(3)
    rows = [(k, None if rng.random() < 0.05 else "hot" if rng.random() < 0.9 else "cold", None if rng.random() < 0.02 else int(rng.integers(0, 200)), None if rng.random() < 0.1 else float(k)) for k in range(3_000)]
    df = spark.createDataFrame(rows, "id int, k string, t long, v double").repartition(7)
    got = {r["id"]: r["before"] for r in ordered.previous(df, ["k"], ["t", "id"], F.col("v"), "before").collect()}
    assert len(got) == 3_000
    last = {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        assert got[i] == last.get(k)
        last[k] = v
    empty = ordered.previous(df.where("false"), ["k"], ["t", "id"], F.col("v"), "before")
    assert empty.count() == 0 and empty.columns == ["id", "k", "t", "v", "before"]


def test_previous_spreads_one_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(20_000).withColumn("k", F.lit("all"))
        got = ordered.previous(one, ["k"], ["id"], F.col("id"), "before").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(got) > 2 and max(r["n"] for r in got) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
