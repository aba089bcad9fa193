"""Forecasts and questions about series: planted structure, intervals that hold, limits and scenarios against arithmetic."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecasts as fo
from tidemark.operators import questions as qu
from tidemark.operators import series as se


def made(kind, n, rng):
    t = np.arange(n)
    return {"walk": np.cumsum(rng.normal(0, 1, n)) + 100, "season": 50 + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, n), "trend": 20 + 0.5 * t + rng.normal(0, 3, n), "times": (20 + 0.3 * t) * (1 + 0.4 * np.sin(2 * np.pi * t / 7)) * np.exp(rng.normal(0, 0.03, n))}[kind]


def forecasts(spark, many, m, h, **options):
    """Frames of forecasts by name, all series in one call."""
    rows = [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), None if v is None else float(v)) for name, y in many.items() for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "name string, period timestamp_ntz, y double")
    out = pd.DataFrame([r.asDict() for r in fo.project(df, ["name"], m or 7, 10**9 if m is None else 3 * m, h, **options).collect()])
    return {k: v.sort_values("step").reset_index(drop=True) for k, v in out.groupby("name", dropna=False)}


def test_intervals_hold_on_what_came_after(spark):
    kinds = {"walk": (0.65, 0.95), "season": (0.68, 0.95), "trend": (0.65, 0.99)}
    whole = {f"{kind} {seed}": made(kind, 160, np.random.default_rng(seed)) for kind in kinds for seed in range(10)}
    got = forecasts(spark, {k: y[:150] for k, y in whole.items()}, 7, 10)
    for kind, (low, high) in kinds.items():
        hit = []
        for name, f in got.items():
            if name.startswith(kind):
                later = whole[name][150:]
                hit.append(((f["low"] <= later) & (later <= f["high"])).mean())
                assert f["method"].nunique() == 1 and (f["sigma"].diff().dropna() >= -1e-12).all() and 0 <= f["coverage"][0] <= 1 and f["origins"][0] == 16
        assert low <= np.mean(hit) <= high, kind


def test_methods_fit_their_series(spark):
    rng = np.random.default_rng(5)
    many = {"season": made("season", 200, rng), "times": made("times", 200, rng), "line": 2.0 * np.arange(60), "one": [4.0], "gaps": [5, None, 5, float("nan"), 5], None: [1.0, 2.0, 3.0]}
    got = forecasts(spark, many, 7, 14)
    assert "season" in got["season"]["method"][0]
    assert got["times"]["method"][0].endswith("season multiplied") and got["times"]["improvement"][0] > 0.4
    assert np.allclose(got["line"]["forecast"], 2.0 * np.arange(60, 74))
    assert list(got["one"]["forecast"]) == [4.0] * 14 and list(got["gaps"]["forecast"]) == [5.0] * 14
    assert len(got) == 6 and (next(v for k, v in got.items() if k is None or k != k)["forecast"] == 3.0).all()
    assert fo.project(spark.createDataFrame([], "period timestamp_ntz, y double"), [], 7, 21, 5).count() == 0


def plain_candidates(y, m, h):
    """Each candidate's forecast in plain numpy."""
    n, t = len(y), np.arange(len(y))

    def line(z, w):
        w = min(w, n)
        slope, cut = np.polyfit(t[-w:], z[-w:], 1) if w > 1 else (0.0, z[-1])
        return cut + slope * np.arange(n, n + h)

    def damped(z):
        best = None
        for a in fo.LEVEL_RATES:
            for b in fo.SLOPE_RATES:
                for p in fo.DAMPINGS:
                    level, slope, missed = z[0], (z[3] - z[0]) / 3, 0.0
                    for v in z[1:]:
                        guess = level + p * slope
                        missed += (v - guess) ** 2
                        fresh = a * v + (1 - a) * guess
                        slope, level = b * (fresh - level) + (1 - b) * p * slope, fresh
                    if best is None or missed < best[0]:
                        best = missed, [level + slope * sum(p**j for j in range(1, k + 1)) for k in range(1, h + 1)]
        return np.array(best[1])

    methods = lambda z: {"last": np.full(h, z[-1]), "recent mean": np.full(h, z[-max(m, 6) :].mean()), "recent trend": line(z, max(14, 4 * m, n // 3)), "long trend": line(z, 500), "damped": damped(z)}
    level = np.array([y[max(0, k - m // 2) : k + (m - 1) // 2 + 1].mean() for k in t])
    add = np.array([(y - level)[t % m == p].mean() for p in range(m)])
    times = np.array([(y / level)[t % m == p].mean() for p in range(m)])
    add, times, ahead = add - add.mean(), times / times.mean(), np.arange(n, n + h) % m
    out = {(k, ""): v for k, v in methods(y).items()} | {("seasonal", ""): np.resize(y[-m:], h), ("historic mean", ""): np.full(h, y.mean())}
    out |= {(k, "added"): v + add[ahead] for k, v in methods(y - add[t % m]).items()}
    return out | {(k, "multiplied"): v * times[ahead] for k, v in methods(y / times[t % m]).items()}


def test_every_candidate_against_numpy(spark):
    y = made("times", 90, np.random.default_rng(2))
    rows = [(k, float(v), 90) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "i int, y double, n int").select(F.struct(F.lit("x").alias("name")).alias("_series"), "i", "y", "n")
    points = fo._origins(df, 7, 21, 5, 16)
    assert [r["t"] for r in points.where("turn is not null").orderBy("turn").collect()] == sorted({14 + int(np.floor(k * 71 / 15 + 0.5)) for k in range(16)})
    got = {}
    for r in fo._ahead(df, points, 7, 600, 500).collect():
        got.setdefault(r["t"], {}).setdefault((r["method"], r["form"]), {})[r["step"]] = r["value"]
    for t in (14, 90, 14 + int(np.floor(7 * 71 / 15 + 0.5))):
        want = plain_candidates(y[:t], 7, 5)
        assert got[t].keys() == want.keys()
        for c, v in want.items():
            assert np.allclose([got[t][c][k] for k in range(1, 6)], v), (t, c)


def test_history_bounds_are_the_callers(spark):
    y = {"x": np.concatenate([np.zeros(150), np.arange(60.0)])}
    assert forecasts(spark, y, None, 2, most_periods=40)["x"]["forecast"][0] == pytest.approx(60)


def test_seasonal_strength(spark):
    rng, rows = np.random.default_rng(8), []
    for name in ("season", "walk"):
        rows += [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(v)) for k, v in enumerate(made(name, 70, rng))]
    df = spark.createDataFrame(rows, "name string, period timestamp_ntz, y double")
    got = {r["name"]: r["strength"] for r in se.seasonal_strength(df, 7, ["name"]).collect()}
    assert got["season"] > 0.8 > 0.4 > got["walk"]
    assert sum(r["effect"] for r in se.season_indices(df.where("name = 'season'"), 7, ["name"]).collect()) == pytest.approx(0)


def daily(spark, y, start="2024-01-01", **more):
    days = pd.date_range(start, periods=len(y))
    return spark.createDataFrame([(d.to_pydatetime(), float(v)) for d, v in zip(days, y, strict=True)], "day timestamp_ntz, sales double")


def test_prepare(spark):
    y = np.arange(1.0, 41)
    df = daily(spark, y).where("dayofmonth(day) not in (5, 6)").unionByName(spark.createDataFrame([(None, 3.0), (dt.datetime(2024, 1, 5), float("nan"))], "day timestamp_ntz, sales double"))
    ready = qu.prepare(df, "day", "sales")
    got = {r["period"].day + 31 * (r["period"].month - 1): r["y"] for r in ready.series.collect()}
    assert (ready.freq, ready.op, len(got)) == ("D", "sum", 40)
    assert got[6] == 0 and got[36] == 0 and got[37] == 0 and got[7] == 7  # no rows: nothing was sold
    assert got[5] == pytest.approx(2.0)  # a row without a value: between its neighbours 4 and 0
    assert any("without a date" in n for n in ready.notes)
    weeks = qu.prepare(daily(spark, np.ones(100)), "day", "sales", freq="W")
    assert [r["y"] for r in weeks.series.orderBy("period").collect()] == [7.0] * 14 and any("isn't over" in n for n in weeks.notes)
    assert qu.prepare(daily(spark, np.ones(5)), "day", "sales").series.count() == 0
    with pytest.raises(ValueError, match="no numbers"):
        qu.prepare(df.select("day", F.lit("x").alias("sales")), "day", "sales")
    assert [qu.suggested_operation(c)[0] for c in ("temperature", "saldo", "cpuUsage", "Ventas_Total", None, "thing")] == ["mean", "mean", "max", "sum", "count", "sum"]
    cut = qu.prepare(daily(spark, y), "day", "sales", cut="2024-01-20", most_periods=15)
    assert [r["y"] for r in cut.series.orderBy("period").collect()] == list(range(6, 21))


def test_threshold_and_saturation(spark):
    ready = qu.prepare(daily(spark, 10 + 2.0 * np.arange(60)), "day", "sales")
    r = qu.threshold_crossing(ready, 148.0, 30).first()
    assert (r["current"], r["upwards"], r["passed"], r["streak"]) == (128.0, True, False, 0)
    assert r["expected"] == 10 and r["earliest"] <= 10 <= r["latest"] and r["urgency"] == "alert"
    over = qu.threshold_crossing(ready, 100.0, 30, direction="up").first()
    assert over["passed"] and over["streak"] == 15 and over["urgency"] == "alert"  # 100, 102, ... 128
    s = qu.saturation(ready, 255.9, 90).first()
    assert s["use"] == pytest.approx(128 / 255.9) and s["history_share"] == 0 and s["likely"] == 64 and s["possible"] <= 64
    flat = qu.saturation(qu.prepare(daily(spark, 50 + np.random.default_rng(1).normal(0, 1, 80)), "day", "sales"), 500.0).first()
    assert flat["likely"] is None and flat["possible"] is None and flat["urgency"] == "info"
    z = [-4.0, -1.0, 0.0, 0.3, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(qu.normal_share(F.col("z"))).collect()]
    assert np.allclose(got, [NormalDist().cdf(v) for v in z], atol=1e-7)


def test_scenario_finds_a_known_elasticity(spark):
    rows, series = [], {}
    for seed in range(10):
        rng = np.random.default_rng(seed)
        x = np.exp(rng.normal(2, 0.3, 120))
        y = np.exp(3 - 1.5 * np.log(x) + rng.normal(0, 0.1, 120))
        series[f"s{seed}"] = x, y
    for name, (x, y) in series.items():
        rows += [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), float(y[k]), float(x[k])) for k in range(120)]
    df = spark.createDataFrame(rows, "name string, day timestamp_ntz, sales double, price double")
    ready = qu.prepare(df, "day", "sales", by=["name"])
    got = {r["name"]: r for r in qu.scenario(ready, df, "day", "price", 0.10).collect()}
    inside = 0
    for name, (x, y) in series.items():
        r = got[name]
        inside += r["low"] <= 1.1**-1.5 - 1 <= r["high"]
        assert r["logs"] and r["distinct"] and r["share"] > 0.5 and r["periods"] == 120
        t, columns = np.arange(120), [np.ones(120), np.log(x), np.arange(120)]
        if r["seasonal"]:
            columns += [(t % 7 == p).astype(float) for p in range(1, 7)]
        assert r["slope"] == pytest.approx(np.linalg.lstsq(np.column_stack(columns), np.log(y), rcond=None)[0][1])
        assert r["effect"] == pytest.approx(1.1 ** r["slope"] - 1)
    assert inside >= 7
    flat = df.withColumn("price", F.lit(3.0))
    assert qu.scenario(qu.prepare(flat, "day", "sales", by=["name"]), flat, "day", "price").count() == 0
    with pytest.raises(ValueError):
        qu.scenario(ready, df, "day", "price", -1.0)


def test_ask(spark):
    df = daily(spark, 10 + 2.0 * np.arange(60))
    out = qu.ask("projection", df, date="day", value="sales", horizon=3).orderBy("period").collect()
    assert [r["period"] for r in out] == [dt.date(2024, 3, 1), dt.date(2024, 3, 2), dt.date(2024, 3, 3)] and out[0]["forecast"] == pytest.approx(130)
    assert qu.ask("trend", df, date="day", value="sales").first()["direction"] == "up"
    for wrong, settings in (("nothing", {}), ("threshold", {"date": "day"}), ("trend", {"date": "never"})):
        with pytest.raises(ValueError):
            qu.ask(wrong, df, **settings)
    business = qu.Prepared(spark.createDataFrame([(dt.datetime(2024, 3, 7), 1.0)], "period timestamp_ntz, y double"), "B", "sum", ())
    steps = spark.createDataFrame([(k, 1.0, 1.0, 1.0, "last") for k in range(1, 4)], "step int, forecast double, low double, high double, method string")
    assert [r["period"] for r in qu.forecast_table(business, steps).orderBy("period").collect()] == [dt.date(2024, 3, 8), dt.date(2024, 3, 11), dt.date(2024, 3, 12)]
    assert math.isfinite(out[0]["low"])


def test_suggested_settings(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), dt.datetime(2024, 2, 1), float(k), k * 2.0, f"s{k % 7}", k % 5, "ok" if k % 3 else "bad", f"t{k}", None) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, opened timestamp_ntz, closed timestamp_ntz, width double, total_price double, zone string, shop_id long, status string, free string, none string")
    assert qu.suggested_settings(df) == {"date": "opened", "value": "total_price", "entity": "shop_id", "event": "status"}
    assert qu.suggested_settings(df, "duration") == {"date": "opened", "value": "total_price", "entity": "shop_id", "event": "status", "start": "opened", "end": "closed"}
    assert qu.suggested_settings(df.drop("shop_id", "opened", "total_price")) == {"date": "closed", "value": "width", "entity": "status"}
    assert qu.suggested_settings(df.select("free", "none")) == {} and qu.suggested_settings(df.limit(0)) == {"date": "opened", "value": "total_price", "event": "status"}
    # A third of the rows is still an entity, one value more isn't.
    n = spark.range(3_000).select((F.col("id") % 1_000).alias("a_id"), (F.col("id") % 1_001).alias("b_id"))
    assert qu.suggested_settings(n) == {"entity": "a_id"} and qu.suggested_settings(n.select("b_id")) == {}
    with pytest.raises(ValueError):
        qu.suggested_settings(df, "weather")
