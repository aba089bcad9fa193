"""Operators that no query reaches, on small tables whose answers are known."""

import datetime as dt
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tidemark import queries as own
from tidemark.functions import dates
from tidemark.functions.pvalues import correlation_p, fisher_p
from tidemark.operators import anomalies as an
from tidemark.operators import cleaning as cl
from tidemark.operators import filters as flt
from tidemark.operators import findings as fi
from tidemark.operators import learning as ml
from tidemark.operators import lineage as lin
from tidemark.operators import ordered
from tidemark.operators import prepared as pr
from tidemark.operators import relational as rel
from tidemark.operators import series as se
from tidemark.operators import state as st
from tidemark.operators.filters import Condition
from tidemark.operators.indicators import Indicator


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_dates_and_text(spark):
    at = dt.datetime(2024, 3, 6, 14, 30, 30)
    r = spark.createDataFrame([(at,)], "t timestamp_ntz").select(dates.minutes_since_midnight(F.col("t")), dates.sunday_label(F.col("t"))).first()
    assert tuple(r) == (870.5, dt.date(2024, 3, 10))
    t = spark.createDataFrame([(1, " a b ", "x#y", "doce"), (2, "  ", None, "3 kg")], "id int, a string, b string, c string")
    assert pairs(cl.trim_columns(t, ["a"]), "id", "a") == [(1, "a b"), (2, "  ")]


def test_business_days(spark):
    weekdays = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=k),) for k in range(40)], "d timestamp_ntz").where(F.weekday("d") < 5)
    assert se.is_business(weekdays, "d") and not se.is_business(weekdays.limit(10), "d")
    assert not se.is_business(weekdays.union(spark.createDataFrame([(dt.datetime(2024, 1, 6),)], "d timestamp_ntz")), "d")
    assert rel.window_lengths(weekdays, "d") == (2, 7)


def test_filters(spark):
    df = spark.createDataFrame([(k, f"v{k % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for k in range(10)], "row long, v string, d timestamp_ntz")
    assert pairs(flt.pick_rows(df, "row", [1, 4]), "row") == [(0,), (3,)]
    odd = spark.createDataFrame([("a", 2), ("b", 5), ("a", 2)], "kind string, row long")
    assert pairs(flt.anomalous_rows(df, odd, "row"), "row") == [(2,), (5,)] and pairs(flt.anomalous_rows(df, odd, "row", "b"), "row") == [(5,)]
    assert pairs(flt.pick_entity(df, "v", "v1"), "row") == [(1,), (4,), (7,)]
    chosen = flt.BaseFilter((Condition("v", "in", ("v2",)),), anomaly=(odd, None), entity=("v", "v2"), last_day=("d", "2024-01-05"))
    assert pairs(chosen.apply(df, "row"), "row") == [(2,)]
    assert pairs(flt.BaseFilter(rows=(1, 9), conditions=(Condition("v", "in", ("none",)),)).apply(df, "row"), "row") == [(0,), (8,)]


def test_anomaly_statistics(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), float(2 * v + rng.normal(0, 0.1)), float(w), "abc"[k % 3]) for k, (v, w) in enumerate(zip(rng.normal(0, 1, 200), rng.normal(0, 1, 200), strict=True))]
    rows[7] = (7, 50.0, rows[7][2], rows[7][3], "a")
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, g string")
    found = an.responsible_columns(df, spark.createDataFrame([(7,)], "row long"), "id", ["x", "y", "z"], 1).first()
    assert found["columns"] == ["x"]
    strong = an.significant_correlations(df, "id", ["x", "y", "z"])
    assert [(p["a"], p["b"]) for p in strong] == [("x", "y")] and strong[0]["strength"] == "very strong" and strong[0]["p"] < 1e-6
    assert correlation_p(0.5, 10) == pytest.approx(0.1411, abs=1e-3) and fisher_p(3, 4, 4, 8) == pytest.approx(0.4857, abs=1e-3)
    marks = spark.createDataFrame([(c, k) for k in range(12) for c in ("a", "b")] + [("c", k) for k in range(100, 110)], "column string, row long")
    both = an.significant_cooccurrence(marks, 1_000)
    assert [(p["a"], p["b"], p["both"]) for p in both] == [("a", "b", 12)]
    spread = spark.createDataFrame([(float(100 * k + j), f"g{k}", "one") for k in range(4) for j in range(20)], "v double, g string, flat string")
    assert an.choose_segment(spread, "v", ["g", "flat"]) == "g"
    good = fi.detector_reliability(df.where("id <> 7"), "id", ["x", "y", "z"])
    assert good["tests"] == 19 or good["tests"] == 20 and 0 <= good["rate"] <= 1
    assert fi.detector_reliability(df.limit(20), "id", ["x", "y"]) is None


def test_memory_and_alarms(spark):
    history = spark.createDataFrame([("a", dt.date(2024, 1, 1), 3, True), ("a", dt.date(2024, 1, 2), 4, False)], "identity string, day date, rows long, resolved boolean")
    findings = spark.createDataFrame([("a", 5), ("a", 7), ("b", 1)], "identity string, rows long")
    grown = st.remember(history, findings, "2024-01-03")
    assert pairs(grown.where("day = '2024-01-03'"), "identity", "rows") == [("a", 7), ("b", 1)] and st.remember(grown, findings, "2024-01-03").count() == grown.count()
    assert pairs(st.mark(grown, "a").where("resolved"), "identity", "day") == [("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 3))]
    assert pairs(st.mark(grown, "a", False, "2024-01-01").where("resolved"), "day") == []
    known = st.mark_false_positive(st.mark_false_positive(spark.createDataFrame([], "identity string"), "b"), "b")
    assert pairs(known, "identity") == [("b",)] and st.mark_false_positive(known, "b", False).count() == 0
    assert pairs(st.without_false_positives(findings, known), "identity") == [("a",), ("a",)]
    now, before = (spark.createDataFrame(x, "name string, value double, fires boolean") for x in ([("p", 1.0, True), ("q", 1.0, True), ("r", 1.0, False)], [("p", 1.0, True), ("r", 1.0, True)]))
    assert pairs(st.newly_firing(now, before), "name") == [("q",)]
    alarms = [st.Alarm("busy", "indicator", ">", 2.0, indicator=Indicator("n", "count", "x", conditions=(Condition("x", "in", ("a",)),)), conditions=(Condition("x", "not_blank"),)), st.Alarm("rows", "rows", "<", 0.0, "x")]
    stored = st.alarms_to_dicts(alarms)
    assert st.alarms_from_dicts(__import__("json").loads(__import__("json").dumps(stored)) + [{"name": "broken"}]) == alarms
    assert pairs(st.last_known(history, "identity", ["day"]), "day") == [(dt.date(2024, 1, 2),)]


def test_schema_provenance_notes(spark):
    a, b = (spark.createDataFrame([], s) for s in ("`Año` int, fecha date, n string", "n string, ano double, FECHA timestamp"))
    assert st.schema_fingerprint(a) == st.schema_fingerprint(b) != st.schema_fingerprint(a.drop("n"))
    log = st.Provenance()
    log.add("calculated", "t", "total", ["price", "net"])
    log.add("calculated", "t", "net", ["gross", "total"])
    assert log.base_columns("t", "total") == {"price", "gross"} and not log.stale("t", "total")
    log.add("edited", "t", "gross")
    assert log.stale("t", "total") and not log.stale("u", "total")
    indicators = [Indicator("a", "sum", "total"), Indicator("f", "formula", formula="[gross].sum() + 1"), Indicator("o", "sum", "other")]
    assert st.affected_by(["gross"], indicators, log, "t") == {"indicators": ["a", "f"], "columns": ["total", "net"]}
    df = spark.createDataFrame([(1, 2)], "gross int, other int")
    out, conditions, named, notes = st.rename_column(df, "gross", "bruto", log, "t", [Condition("gross", ">", (1,))], indicators, [(0, "gross", "look")])
    assert out.columns == ["bruto", "other"] and conditions[0].column == "bruto" and named[1].formula == "[bruto].sum() + 1" and notes == [(0, "bruto", "look")]
    assert log.base_columns("t", "total") == {"price", "bruto"}
    with pytest.raises(ValueError):
        st.rename_column(df, "gross", "other")
    found = spark.createDataFrame([("k", [1, 2, 3], ["a", "b"])], "kind string, rows array<int>, columns array<string>")
    assert pairs(st.cell_notes(found, 2), "row", "column") == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    with pytest.raises(ValueError):
        st.currency_columns(df, ["other"], lambda: 0.0)


def test_board(spark):
    board, df = st.Board(), spark.createDataFrame([(1,), (2,)], "id int")
    board.publish("t", df)
    assert not board.outdated("t", df, "id") and board.outdated("t", df.limit(1), "id") and not board.outdated("u", df, "id")
    for k in range(15):
        board.answer(f"k{k}", "x", ("info", "watch", "alert")[k % 3], [{"label": f"w{k}"}], "t" if k % 2 else "u")
    assert len(board.answers) == 12 and [a["urgency"] for a in board.answers[:5]] == ["alert"] * 5 and len(board.windows) == 12
    board.answer("k2", "again", "info", table="t")
    assert [a["title"] for a in board.answers if a["key"] == "k2"] == ["again"]
    board.discard("t")
    assert not board.predictions and all(a["table"] == "u" for a in board.answers) and board.future_windows("t") == []


def test_sentences_and_questions(spark):
    assert "doesn't spread" in fi.contagion_sentence({}) and "mend 1 row: 1 in a" in fi.contagion_sentence({"a": 1}) and "1,002 rows: 1,000 in a, 2 in b" in fi.contagion_sentence({"b": 2, "a": 1_000})
    found = spark.createDataFrame([("outlier", ["x"], 1, "extreme", 1, "t"), ("nulls", ["y"], None, "low", 9, "t")], "kind string, columns array<string>, row long, severity string, affected long, text string")
    df = spark.createDataFrame([(k, None if k % 2 else 1.0, "ab"[k % 2]) for k in range(200)], "id long, half double, side string")
    assert fi.suggested_questions(found, df) == ["Why did x leave its usual range?", "Why is 50 % of half missing?", "How do results differ by side?"]
    assert fi.is_id("id") and fi.is_id("customer_id") and fi.is_id("id_venta") and not fi.is_id("paid") and not fi.is_id("idea")
    assert fi.analysis_key({"keyword": "trend", "value": "x", "horizon": 3}) == fi.analysis_key({"value": "x", "keyword": "trend", "horizon": 9, "entity": ""}) != fi.analysis_key({"keyword": "trend", "value": "y"})


def test_links_parents_and_pairs(spark):
    sales = spark.createDataFrame([(k, k % 3, dt.datetime(2024, 1, 1 + k), float(k), "no") for k in range(9)], "row long, client_id long, fecha timestamp_ntz, target double, note string")
    clients = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "id long, name string")
    assert pr.infer_parents({"sales": sales, "clients": clients})["sales"] == [("client_id", "clients", "id")]
    assert pr.infer_parents({"sales": sales, "clients": clients.union(clients)})["sales"] == [] and pr.infer_parents({"sales": sales, "clients": clients.limit(1)})["sales"] == []
    assert pr.reachable("a", {"a": [("k", "b", "k")], "b": [("k", "c", "k"), ("k", "a", "k")], "c": [("k", "d", "k")]}) == ["b", "c"]
    assert pr.date_column(sales) == "fecha" and pr.date_column(sales, none=True) is None and pr.date_column(clients) is None
    assert pr.date_column(spark.createDataFrame([("a", "2024-01-02"), ("b", None)], "t string, when string")) == "when"
    test = sales.drop("client_id", "target")
    pair = pr.prepare_pair({"train": sales, "test": test, "clients": clients}, "train", "test", "target", [pr.Link("train", "client_id", "clients", "id")], "row")
    assert pair.new_columns == ["clients.name"] and pair.date == "fecha" and any("lacks a key" in n for n in pair.notes)
    assert pair.train.count() == pair.test.count() == 9 and pair.test.where("`clients.name` is not null").count() == 0
    leak = pr.prepare_pair({"train": sales, "clients": clients.withColumn("target", F.lit(1.0))}, "train", None, "target", [pr.Link("train", "client_id", "clients", "id")], "row")
    assert leak.new_columns == ["clients.name"] and leak.test is None
    past = sales.select("client_id", F.col("fecha").alias("date"), (F.col("target") + 1).alias("amount"))
    dated = pr.prepare_pair({"train": sales, "past": past}, "train", None, "target", [pr.Link("past", "client_id", "train", "client_id")], "row").train
    assert {r["row"]: (r["past.count"], r["past.amount.sum"]) for r in dated.collect()}[7] == (2, 2.0 + 5.0)
    with pytest.raises(ValueError):
        pr.explicit_resume(sales, clients, "clients", "client_id", "id", [])


def planted(spark, n=600):
    rng = np.random.default_rng(3)
    rows = [(k, float(a), float(b), "uvw"[int(c)], int(a > 0.3) if rng.random() < 0.97 else int(rng.random() < 0.5), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), f"g{k % 12}", float(3 * a + rng.normal(0, 0.1))) for k, (a, b, c) in enumerate(zip(rng.normal(0, 1, n), rng.normal(0, 1, n), rng.integers(0, 3, n), strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int, at timestamp_ntz, g string, z double")


def test_folds(spark):
    df = planted(spark)
    by_group = ml.with_folds(df, "id", 3, "group", group="g").groupBy("g").agg(F.count_distinct("_fold").alias("n"))
    assert {r["n"] for r in by_group.collect()} == {1}
    timed = ml.with_folds(df, "id", 3, "time", time="at").groupBy("_fold").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("_fold").collect()
    assert [r["n"] for r in timed] == [150] * 4 and all(x["b"] < y["a"] for x, y in zip(timed, timed[1:], strict=False))
    for learnt, tested in ml.splits(df, "id", 3, "time", time="at"):
        assert learnt.agg(F.max("at")).first()[0] < tested.agg(F.min("at")).first()[0]
    once = list(ml.splits(df, "id", 3, one_split_from=100))
    assert len(once) == 1 and 60 < once[0][1].count() < 180 and once[0][0].count() + once[0][1].count() == 600
    with pytest.raises(ValueError):
        ml.with_folds(df.where("g = 'g1'"), "id", 3, "group", group="g")


def test_target(spark):
    df = planted(spark).select("id", "c", "y", "z", "at")
    rows, classes, notes = ml.prepare_target(df.union(df.limit(5)).union(df.limit(1).withColumn("c", F.lit(None))), "id", "c", "classification")
    assert classes == ["u", "v", "w"] and rows.select("_label").distinct().count() == 3 and len(notes) == 2
    assert ml.prepare_target(df, "id", "z", "regression", most_rows=100)[0].count() == 100
    with pytest.raises(ValueError):
        ml.prepare_target(df, "id", "z", "regression", log=True)
    with pytest.raises(ValueError):
        ml.prepare_target(df, "id", "id", "classification")


def test_models_on_planted_structure(spark):
    df = planted(spark)
    judged = ml.out_of_fold(df, "id", "y", ["a", "b", "c"], iterations=5)
    assert judged.count() == 600 and ml.rank_auc(judged, "y", "probability").first()["auc"] > 0.9
    straight = ml.linear_reference(df, "id", "z", ["a", "b", "c"])
    metrics = ml.regression_metrics(straight, "z", "prediction").first()
    assert metrics["n"] == 600 and metrics["r2"] > 0.99
    logit = ml.linear_reference(df, "id", "y", ["a", "b", "c"])
    assert ml.rank_auc(logit, "y", "probability").first()["auc"] > 0.9
    importance = {r["column"]: r["importance"] for r in ml.permutation_importance(df, "id", "y", ["a", "b", "c"], folds=2, repeats=2, iterations=3).collect()}
    assert importance["a"] > 0.2 > 10 * abs(importance["b"]) and abs(importance["c"]) < 0.02
    model = ml.train(df, "y", ["a", "b"], iterations=5)
    reasons = ml.explain_rows(model, df.where("a > 1").limit(5), "id", ["a", "b"], 1, typical_of=df)
    assert {r["column"] for r in reasons.collect()} == {"a"}
    several = ml.train(df, "c", ["a", "b"], "classification").predict(df)
    assert {r["said"] for r in several.select("said").distinct().collect()} <= {"u", "v", "w"}
    assert ml.use_weights(df.select((F.col("id") < 30).cast("int").alias("r")), "r") and not ml.use_weights(df, "y")
    logged = ml.train(df.withColumn("p", F.exp("a")), "p", ["a"], "regression", iterations=5, log=True).predict(df)
    assert logged.agg(F.min("prediction")).first()[0] >= 0


def test_calibration(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(p), int(rng.random() < p**2)) for k, p in enumerate(rng.random(3_000))]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    before = ml.calibration_error(ml.reliability(df, "y", "p", "id", 10)).first()["ece"]
    for some in (df, df.limit(600)):  # isotonic, then logistic
        after = ml.calibration_error(ml.reliability(ml.calibrator(some, "y", "p")(df), "y", "calibrated", "id", 10)).first()["ece"]
        assert after < 0.6 * before
    weights = {r["y"]: r["weight"] for r in ml.balanced_weights(df, "y").select("y", "weight").distinct().collect()}
    ones = sum(y for *_, y in rows)
    assert weights == pytest.approx({1: 1_500 / ones, 0: 1_500 / (3_000 - ones)})
    review = ml.review_list(df.withColumn("e", F.col("y") - F.col("p")), "id", "y", "p", 3).collect()
    assert [r["error"] for r in review] == sorted((abs(y - p) for _, p, y in rows), reverse=True)[:3]
    assert [ml.verdict(e, 1.0) for e in (0.1, 0.4, 0.7, 0.9, 0.001)] == ["very good", "good", "fair", "no better", "suspicious"]


def test_queries_without_sql(spark):
    q = own.queries()
    orders = [(r["o_orderkey"], r["o_totalprice"]) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    first = q["content_signature"](spark, SF).first()
    assert first["n"] == len(orders)
    shuffled = st.content_signature(spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").repartition(5, "o_totalprice"), ["o_orderkey", "o_totalprice"]).first()
    changed = st.content_signature(spark.createDataFrame([(orders[0][0], -1.0), *orders[1:]], "o_orderkey long, o_totalprice double"), ["o_orderkey", "o_totalprice"]).first()
    assert tuple(shuffled) == tuple(first) != tuple(changed)
    odd = {r["row"] for r in q["anom_multivariate"](spark, SF).collect()}
    assert 0 < len(odd) <= 0.03 * len(orders)
    sample = q["sample_exact"](spark, SF).collect()
    assert len(sample) == min(1_000, len(orders)) == len({r["o_orderkey"] for r in sample})


def test_relations_by_brute_force(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    values = {(n, c): {str(r[0]).strip().lower() for r in df.select(c).distinct().collect() if r[0] is not None} for n, df in tables.items() for c in df.columns}
    got = lin.infer_relations(tables).collect()
    assert {(r["table_a"], r["column_a"], r["table_b"], r["column_b"]) for r in got} >= {("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey")}
    for r in got:
        a, b = values[r["table_a"], r["column_a"]], values[r["table_b"], r["column_b"]]
        assert r["overlap"] == pytest.approx(len(a & b) / min(len(a), len(b)))
        keys = lin.looks_like_key(r["column_a"]) and lin.looks_like_key(r["column_b"])
        assert r["confidence"] == pytest.approx(0.4 * lin.name_similarity(r["column_a"], r["column_b"]) + 0.5 * r["overlap"] + 0.1 * keys)


def test_lineage_by_hand(spark):
    edges = [rel.Edge("b", "a_id", "a", "id"), rel.Edge("c", "b_id", "b", "id")]
    tables = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, a_id long"), "c": spark.createDataFrame([(100, 10), (101, 12)], "id long, b_id long")}
    got = {(r["level"], r["direction"], r["table"], r["value"]) for r in lin.lineage(tables, edges, "a", "id", 1).collect()}
    assert {(0, "root", "a", "1"), (1, "child", "b", "10"), (1, "child", "b", "11")} <= got and not any(v == "12" for *_, v in got)
    assert lin.ancestors(edges, "c") == {"a", "b"} and lin.descendants(edges, "a") == {"b", "c"}
    assert "a" in lin.sentence(edges, "b") and "c" in lin.sentence(edges, "b") and "stands alone" in lin.sentence(edges, "x")
    assert lin.primary_column(edges, "b") == "id" and math.isfinite(zlib.crc32(b"x"))


def test_sampled_overlaps_find_what_exact_ones_do(spark, monkeypatch):
    """Columns of 20,000 values and of few, with known overlaps, from samples of 512; and the same relations as without samples."""
    monkeypatch.setattr(lin, "SAMPLED_VALUES", 512)
    ids = spark.range(20_000)
    tables = {
        "a": ids.select(F.col("id").alias("item_id"), (F.col("id") % 40).alias("shop_id"), F.concat(F.lit("x"), "id").alias("label")),
        "b": ids.select((F.col("id") + 10_000).alias("item_id"), F.concat(F.lit(" X"), F.col("id") * 2).alias("label"), F.lit(None).cast("long").alias("none_id")),
        "c": spark.range(40).select(F.col("id").alias("shop_id"), (F.col("id") + 39_990).alias("item_id")),
    }
    columns = [(t, c) for t, df in sorted(tables.items()) for c in df.columns]
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[k + 1 :] if x[0] != y[0]]
    about, exact = lin.sampled_overlaps(tables, columns, pairs), lin.value_overlaps(tables, columns)
    for p in pairs:
        assert about[p] == pytest.approx(exact.get(p, 0.0), abs=lin.MARGIN)
    assert exact[("a", "item_id"), ("b", "item_id")] == 0.5 and exact[("a", "shop_id"), ("c", "shop_id")] == 1.0
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    sampled = key(lin.infer_relations(tables).collect())
    monkeypatch.setattr(lin, "sampled_overlaps", lambda t, c, p: dict.fromkeys(p, 1.0))
    assert sampled == key(lin.infer_relations(tables).collect()) and sampled
    assert lin.infer_relations({"a": tables["a"].limit(0), "c": tables["c"]}).count() >= 0


@pytest.mark.parametrize("rows_a_range", [60, 1_000_000])
def test_prior_resume_keeps_base_rows(spark, monkeypatch, rows_a_range):
    """Repeated and missing row ids, missing keys and dates, keys of equal text: each base row once, against a plain pass."""
    monkeypatch.setattr(ordered, "ROWS_A_RANGE", rows_a_range)
    rng = np.random.default_rng(5)
    day = lambda: None if rng.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 90)))
    name = lambda: None if rng.random() < 0.05 else 7 if rng.random() < 0.6 else int(rng.integers(0, 9))
    base = [(k, None if k % 50 == 0 else k // 2, name(), day()) for k in range(400)]
    child = [(None if (n := name()) is None else f" {n}.0 ", day(), None if rng.random() < 0.1 else float(rng.integers(-9, 9)), str(rng.integers(0, 3))) for _ in range(600)]
    b = spark.createDataFrame(base, "`of.id` int, row int, k int, at timestamp_ntz")
    c = spark.createDataFrame(child, "key string, day timestamp_ntz, v double, c string")
    got = rel.prior_resume(b, c, "k", "key", "at", "day", "row", ["v"], ["c"], (7, 30), "p").collect()
    assert sorted(r["of.id"] for r in got) == list(range(400))
    for r in got:
        past = [x for x in child if r["k"] is not None and r["at"] and x[0] and x[1] and int(float(x[0])) == r["k"] and x[1] < r["at"]]
        known = [x[2] for x in past if x[2] is not None]
        within = lambda days, past=past, r=r: [x for x in past if x[1] >= r["at"] - dt.timedelta(days=days)]
        assert tuple(r)[:4] == base[r["of.id"]] and r["p.count"] == len(past)
        assert (r["p.v.sum"], r["p.v.min"], r["p.v.max"]) == ((sum(known), min(known), max(known)) if known else (None, None, None))
        assert r["p.c.last"] == (max((x[1], x[3]) for x in past)[1] if past else None)
        assert r["p.days_since"] == ((r["at"] - max(x[1] for x in past)).days if past else None)
        assert (r["p.count_7d"], r["p.count_30d"]) == (len(within(7)), len(within(30)))
        recent = [x[2] for x in within(30) if x[2] is not None]
        assert r["p.v.sum_30d"] == (sum(recent) if recent else None)
