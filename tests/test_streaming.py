"""Streams of two batches against what the same rows give at once."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators.state import newly_firing
from tidemark.streaming import events

START = datetime(2024, 1, 1)
ROWS = [[("a", 0, 1.0), ("a", 1, 5.0), ("b", 1, 7.0), ("a", 2, 6.0), ("b", 2, None)], [("a", 25, 1.0), ("a", 26, 9.0), ("b", 27, 8.0), (None, 27, 3.0)]]


@pytest.fixture
def stream(spark, tmp_path):
    for k, rows in enumerate(ROWS):
        spark.createDataFrame([(n, START + timedelta(hours=h), v) for n, h, v in rows], "k string, at timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema("k string, at timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def ran(spark, df, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("got").collect()


def test_period_totals(spark, stream, tmp_path):
    got = ran(spark, events.period_totals(stream, "at", "v", late="2 hours"), tmp_path, "complete")
    assert sorted((r.n, r.total) for r in got) == [(4, 19.0), (4, 21.0)]


def test_edges(spark, stream, tmp_path):
    got = ran(spark, events.edge_alarms(stream, "k", "at", "v", ">", 4), tmp_path, "append")
    assert sorted((r.key, (r.ts - START).seconds // 3600 + 24 * (r.ts - START).days, r.value) for r in got) == [("a", 1, 5.0), ("a", 26, 9.0), ("b", 1, 7.0), ("b", 27, 8.0)]


def test_baseline(spark, stream, tmp_path):
    got = ran(spark, events.drifting_baseline(stream, "k", "at", "v", weight=0.5, tolerance=0.5), tmp_path, "append")
    assert [(r.value, r.baseline, r.drifts) for r in sorted(got, key=lambda r: r.ts) if r.key == "b"] == [(7.0, None, False), (8.0, 7.0, False)]
    assert [(r.value, r.baseline, r.drifts) for r in sorted(got, key=lambda r: r.ts) if r.key == "a"][:3] == [(1.0, None, False), (5.0, 1.0, True), (6.0, 3.0, True)]


@pytest.fixture
def shuffled(spark, tmp_path):
    """A hot key with most rows and some others, each row up to two hours late and in no order, in six batches; then a row that's far
    too late, and two that push the watermark on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.integers(3)}", int(m), None if rng.random() < 0.05 else float(rng.integers(0, 10))) for m in range(3_000)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.integers(0, 120))
    batches = [arrival[k * 500 : (k + 1) * 500] for k in range(6)] + [[("end", 4_000, 0.0)], [("hot", 10, 9.0), ("end", 4_001, 0.0)], [("end", 9_000, 0.0)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame([(n, START + timedelta(minutes=m), v) for n, m, v in batch], "k string, at timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/late/{k}")
        time.sleep(0.05)  # files are taken by age
    yield rows, spark.readStream.schema("k string, at timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/late")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def minute(r):
    return round((r.ts - START).total_seconds() / 60)


def test_ordered_edges_are_those_of_all_rows_at_once(spark, shuffled, tmp_path):
    rows, stream = shuffled
    got = ran(spark, events.ordered_edge_alarms(stream, "k", "at", "v", ">", 6, late="2 hours", grain="20 minutes"), tmp_path, "append")
    want, was = [], {}
    for k, m, v in sorted(rows, key=lambda r: r[1]):
        now = v is not None and v > 6
        if now and not was.get(k):
            want.append((k, m, v))
        was[k] = now
    assert sorted((r.key, minute(r), r.value) for r in got) == sorted(want)
    batch = spark.createDataFrame([(k, was_last) for k, was_last in was.items()], "name string, fires boolean")
    assert newly_firing(batch, batch).count() == 0  # an alarm that goes on isn't new, in batch as in the stream


def test_ordered_baseline(spark, shuffled, tmp_path):
    rows, stream = shuffled
    got = {(r.key, minute(r)): r for r in ran(spark, events.ordered_baseline(stream, "k", "at", "v", weight=0.5, tolerance=0.5, late="2 hours", grain="20 minutes"), tmp_path, "append") if r.key != "end"}
    level, n = {}, 0
    for k, m, v in sorted(rows, key=lambda r: r[1]):
        if v is not None:
            r, b = got[k, m], level.get(k)
            assert r.baseline == (None if b is None else pytest.approx(b)) and r.drifts == (b is not None and abs(v - b) > 0.5 * abs(b))
            level[k], n = v if b is None else 0.5 * v + 0.5 * b, n + 1
    assert len(got) == n


def test_silent_keys_are_forgotten(spark, tmp_path):
    """A key stays true over a long silence: with ``forget`` it fires anew, without it doesn't."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, batch in enumerate([[("a", 0, 9.0), ("b", 0, 1.0)], [("b", 5_000, 1.0)], [("a", 5_001, 9.0)], [("b", 9_000, 1.0)], [("b", 9_001, 1.0)]]):
        spark.createDataFrame([(n, START + timedelta(minutes=m), v) for n, m, v in batch], "k string, at timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    for forget, want in (("1 day", [0, 5_001]), (None, [0])):
        stream = spark.readStream.schema("k string, at timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        (tmp_path / str(forget)).mkdir()
        got = ran(spark, events.ordered_edge_alarms(stream, "k", "at", "v", ">", 6, late="1 hour", forget=forget), tmp_path / str(forget), "append")
        assert [minute(r) for r in sorted(got, key=minute)] == want
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
