"""Streaming versions: totals by period, alarms on their rising edge, and a baseline that follows each key's level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TESTS = {">": lambda v, b: v > b, ">=": lambda v, b: v >= b, "<": lambda v, b: v < b, "<=": lambda v, b: v <= b, "=": lambda v, b: v == b}


def period_totals(stream: DataFrame, ts: str, value: str, period: str = "1 day", late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, start, n, total, mean) of each period, final once ``late`` has passed after its end; later rows are dropped."""
    when: Column = F.col(ts).cast("timestamp")
    rows = stream.withColumn("_at", when).withWatermark("_at", late)
    totals = rows.groupBy(F.window("_at", period), *by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return totals.select(*by, F.col("window.start").alias("start"), "n", "total", "mean")


def trailing_totals(stream: DataFrame, ts: str, value: str, days: int, late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """The last ``days`` days as of each midnight."""
    rows = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    totals = rows.groupBy(F.window("_at", f"{days} days", "1 day"), *by).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return totals.select(*by, F.col("window.end").alias("until"), "n", "total")


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order of time; they're in memory together, so bound batches at the source
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) where a key may be very frequent."""
    return pd.concat(list(frames)).sort_values("ts", kind="stable")


class InOrder(StatefulProcessor):
    """Takes each key's rows in order of event time, whatever order they come in.

    Rows wait in state, packed by ``grain`` of time, and a timer takes a grain once the watermark is past its end. So a task holds
    one grain of one key, however frequent the key and however large a micro-batch. Rows of grains that are over are late and
    dropped. ``forget``: a key without rows for so long loses its level, and its next row starts anew.

    ``step(level, at, values)`` gets sorted times (micros) and values (NaN: missing) and gives the new level (None: still none) and
    its rows (ts, value and others)."""

    def __init__(self, step: Callable, columns: list[str], grain: int, forget: int | None):
        self.step, self.columns, self.grain, self.forget = step, columns, grain, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "grain long", "times binary, numbers binary")
        self.carried = handle.getValueState("carried", "next long, known boolean, level double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        over = self.carried.get()[0] if self.carried.exists() else None
        for frame in rows:
            at, v = frame["ts"].to_numpy("int64"), frame["value"].to_numpy("float64")
            grains = at // self.grain
            for g in map(int, np.unique(grains)):
                if over is None or g >= over:
                    mine = grains == g
                    times, numbers = self.waiting.getValue((g,)) if self.waiting.containsKey((g,)) else (b"", b"")
                    if not times:
                        self.handle.registerTimer((g + 1) * self.grain // 1000)
                    self.waiting.updateValue((g,), (bytes(times) + at[mine].tobytes(), bytes(numbers) + v[mine].tobytes()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        g = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.grain - 1
        over, known, level = self.carried.get() if self.carried.exists() else (None, False, 0.0)
        if self.waiting.containsKey((g,)):
            times, numbers = self.waiting.getValue((g,))
            at, v = np.frombuffer(times, "int64"), np.frombuffer(numbers, "float64")
            order = np.lexsort((v, at))
            level, rows = self.step(level if known else None, at[order], v[order])
            self.waiting.removeKey((g,))
            self.carried.update((g + 1, level is not None, 0.0 if level is None else float(level)))
            if self.forget:
                self.handle.registerTimer((g + 1 + self.forget) * self.grain // 1000)
            rows.insert(0, "key", key[0])
            if len(rows):
                yield rows[["key", *self.columns]]
        elif self.forget and over is not None and over + self.forget <= g + 1:
            self.carried.clear()


def _in_order(stream: DataFrame, key: str, ts: str, value: str, step: Callable, columns: dict[str, str], late: str, grain: str, forget: str | None) -> DataFrame:
    """Event-time state needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which also keeps waiting rows
    out of the executors' heaps."""
    width = pd.Timedelta(grain) // pd.Timedelta(microseconds=1)
    if width <= 0 or width % 1000:
        raise ValueError(f"a grain must be whole milliseconds: {grain!r}")
    idle = -(-(pd.Timedelta(forget) // pd.Timedelta(microseconds=1)) // width) if forget else None
    at = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).cast("string").alias("key"), at.alias("_at"), F.unix_micros(at).alias("ts"), F.col(value).cast("double").alias("value"))
    rows = rows.where("ts is not null").withWatermark("_at", late)
    kinds = ", ".join(f"{c} {kind}" for c, kind in columns.items())
    found = rows.groupBy("key").transformWithStateInPandas(InOrder(step, list(columns), width, idle), f"key string, {kinds}", "append", "eventTime")
    return found.withColumn("ts", F.timestamp_micros("ts"))


def ordered_edge_alarms(stream: DataFrame, key: str, ts: str, value: str, op: str, bound: float, late: str = "1 hour", grain: str = "1 minute", forget: str | None = None) -> DataFrame:
    """(key, ts, value) of each row at which its key's test turns true, in order of event time: the same alarms in whatever order
    rows come, as long as none is later than ``late``; an alarm is told once the watermark is past its ``grain``. A missing
    value is false; of equal times the lesser value is first. ``forget``: a key that was silent so long fires anew."""
    test = TESTS[op]

    def step(level, at, v):
        now = test(v, bound) & ~np.isnan(v)
        hit = now & ~np.concatenate([[bool(level)], now[:-1]])
        return float(now[-1]), pd.DataFrame({"ts": at[hit], "value": v[hit]})

    return _in_order(stream, key, ts, value, step, {"ts": "long", "value": "double"}, late, grain, forget)


def ordered_baseline(stream: DataFrame, key: str, ts: str, value: str, weight: float = 0.3, tolerance: float = 0.3, late: str = "1 hour", grain: str = "1 minute", forget: str | None = None) -> DataFrame:
    """``drifting_baseline`` in order of event time, whatever order rows come in; see ``ordered_edge_alarms``. A key's first value has
    no baseline."""

    def step(level, at, v):
        known = ~np.isnan(v)
        at, v, levels = at[known], v[known], []
        for x in v:
            levels.append(level)
            level = x if level is None else weight * x + (1 - weight) * level
        before = np.array([np.nan if x is None else x for x in levels])
        drifts = np.abs(v - before) > tolerance * np.abs(before)
        return level, pd.DataFrame({"ts": at, "value": v, "baseline": before.astype("float64"), "drifts": drifts.astype(bool)})

    found = _in_order(stream, key, ts, value, step, {"ts": "long", "value": "double", "baseline": "double", "drifts": "boolean"}, late, grain, forget)
    return found.withColumn("baseline", F.nanvl("baseline", F.lit(None).cast("double")))


def edge_alarms(stream: DataFrame, key: str, ts: str, value: str, op: str, bound: float) -> DataFrame:
    """(key, ts, value) of each row at which its key's test turns true, told at once (``ordered_edge_alarms`` waits for late rows and
    holds less of a frequent key); a missing value is false. A key's rows are taken in
    order of time within a batch; its state is one truth value and the latest time. Rows older than that time are late and
    fire nothing."""
    test = TESTS[op]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, latest = state.get if state.exists else (False, -(2**62))
        rising = []
        rows = _ordered(frames)
        for at, v in zip(rows["ts"], rows["value"], strict=True):
            if at >= latest:
                now = bool(pd.notna(v) and test(v, bound))
                if now and not was:
                    rising.append((k[0], at, v))
                was, latest = now, at
        state.update((was, int(latest)))
        yield pd.DataFrame(rising, columns=["key", "ts", "value"])

    return _by_key(stream, key, ts, value, step, "key string, ts long, value double", "was boolean, latest long")


def drifting_baseline(stream: DataFrame, key: str, ts: str, value: str, weight: float = 0.3, tolerance: float = 0.3) -> DataFrame:
    """(key, ts, value, baseline, drifts): each value beside the exponentially weighted mean of its key's earlier ones, and
    whether it's off by more than ``tolerance`` of it. Rows come in order of time within a batch; missing values are passed over."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else None
        out = []
        rows = _ordered(frames)
        for at, v in zip(rows["ts"], rows["value"], strict=True):
            if pd.notna(v):
                out.append((k[0], at, v, level, level is not None and abs(v - level) > tolerance * abs(level)))
                level = v if level is None else weight * v + (1 - weight) * level
        if level is not None:
            state.update((float(level),))
        yield pd.DataFrame(out, columns=["key", "ts", "value", "baseline", "drifts"])

    return _by_key(stream, key, ts, value, step, "key string, ts long, value double, baseline double, drifts boolean", "level double")


def _by_key(stream: DataFrame, key: str, ts: str, value: str, step, output: str, state: str) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(value).cast("double").alias("value"))
    found = rows.where("ts is not null").groupBy("key").applyInPandasWithState(step, output, state, "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("ts", F.timestamp_micros("ts"))
