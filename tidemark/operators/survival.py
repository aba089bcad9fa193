"""Events and durations with censoring: spans, Kaplan-Meier curves, event features, priorities, depletion."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import micros
from tidemark.functions.scratch import written
from tidemark.operators.ordered import previous, running_sums, strictly_before

DAY = 86_400_000_000.0

# Consumption moves clearly beyond so many standard errors, over or under these shares, told from so many days on.
CLEAR_ERRORS, RISING_FROM, FALLING_TO, TREND_DAYS = 2.0, 1.25, 0.75, 9


def spans(df: DataFrame, entity: str, date: str, is_event: Column, until: str | None = None) -> DataFrame:
    """(entity, days, event): times between consecutive different event times of an entity, and its censored rest to the end of
    observation: ``until``, else its own last row. Spans of no length are left out. An entity may hold most rows (``ordered.previous``)."""
    rows = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).select(F.col(entity).alias("entity"), micros(F.col(date)).alias("t"), F.coalesce(is_event, F.lit(False)).alias("e"))
    end = F.max("t").alias("end") if until is None else F.lit(until).cast("timestamp").cast("double").cast("long").alias("end") * 1_000_000
    last = rows.groupBy("entity").agg(F.max("t").alias("end")) if until is None else rows.groupBy("entity").agg(F.max("t").alias("_")).select("entity", end.alias("end"))
    times = rows.where("e").select("entity", "t").distinct()
    ended = previous(times, ["entity"], ["t"], F.col("t"), "from").where("from is not null").select("entity", ((F.col("t") - F.col("from")) / DAY).alias("days"), F.lit(True).alias("event"))
    rest = times.groupBy("entity").agg(F.max("t").alias("t")).join(last, "entity").select("entity", ((F.col("end") - F.col("t")) / DAY).alias("days"), F.lit(False).alias("event"))
    return ended.unionByName(rest).where("days > 0")


def durations(df: DataFrame, start: str, end: str, cut: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, days, event): finished rows, and open ones censored at ``cut``; same-day ones last half a day; negative ones go."""
    stop = F.coalesce(F.col(end), F.lit(cut).cast("timestamp_ntz"))
    days = (micros(stop) - micros(F.col(start))) / DAY
    return df.where(F.col(start).isNotNull()).select(*by, F.when(days == 0, 0.5).otherwise(days).alias("days"), F.col(end).isNotNull().alias("event")).where("days > 0")


def survival_curve(rows: DataFrame, by: Sequence[str] = (), weight: str | None = None, entry: str | None = None) -> DataFrame:
    """(by, days, at_risk, events, survival): Kaplan-Meier. Rows leave the risk set after the events of their own time.

    ``weight``: how often a row counts. ``entry``: the time after which a row is at risk, where it wasn't watched from the start.
    Counts of each distinct time come first, and are written, as each sum reads them again; the sums over times go by ranges,
    so long curves take no single task."""
    by, w = list(by), F.col(weight) if weight else F.lit(1)
    left = rows.groupBy(*by, "days").agg(F.sum(w).alias("_n"), F.sum(F.when(F.col("event"), w).otherwise(0)).alias("events"))
    came = rows.groupBy(*by, *([F.col(entry).alias("days")] if entry else [])).agg(F.sum(w).alias("_in"))
    if not entry:
        came = came.withColumn("days", F.lit(-1.0))
    both = left.withColumn("_exit", F.lit(1)).unionByName(came.select(*by, F.col("days").cast(dict(left.dtypes)["days"]).alias("days"), "_in"), allowMissingColumns=True)
    counts = both.groupBy(*by, "days").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "events", "_in")], F.max("_exit").alias("_exit"))
    counts = written(counts, "times")
    upto = running_sums(counts, "days", {"_left": F.col("_n"), "_came": F.col("_in")}, by=by)
    risk = upto.withColumn("at_risk", F.col("_came") - F.col("_in") - F.col("_left") + F.col("_n")).where("_exit = 1").select(*by, "days", "at_risk", "events")
    risk = written(risk, "at-risk")
    some = F.col("events") > 0
    gone = F.when(some & (F.col("events") < F.col("at_risk")), F.log1p(-F.col("events") / F.col("at_risk"))).otherwise(0.0)
    dead = (some & (F.col("events") >= F.col("at_risk"))).cast("int")
    summed = running_sums(risk, "days", {"_log": gone, "_dead": dead}, by=by)
    return summed.select(*by, "days", "at_risk", "events", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_log")).alias("survival"))


def spans_from_start(df: DataFrame, entity: str, date: str, is_event: Column, start: Column, until: str | None = None, single: bool = False) -> DataFrame:
    """(entity, days, event, entry): lives counted from ``start`` (the least of an entity's rows). An entity is watched from its first
    row on, so its first life has an ``entry``: the days before it, in which an event would have been missed. Events at or before
    the start don't count. ``single``: an event ends the entity's life; else further lives follow, from event to event, with
    entry 0. The last ends unfinished at ``until``, else at the entity's last row. Lives that end by their entry are left out."""
    rows = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).select(F.col(entity).alias("entity"), micros(F.col(date)).alias("t"), F.coalesce(is_event, F.lit(False)).alias("e"), micros(start).alias("s"))
    end = F.max("t") if until is None else F.unix_micros(F.lit(until).cast("timestamp"))
    whole = rows.groupBy("entity").agg(F.min("t").alias("first"), F.min("s").alias("start"), end.alias("end")).where("start is not null")
    times = rows.where("e").select("entity", "t").distinct().join(whole, "entity").where("t > start")
    if single:
        times = times.groupBy("entity", "first", "start", "end").agg(F.min("t").alias("t"))
    ended = previous(times, ["entity"], ["t"], F.col("t"), "_before").withColumn("from", F.coalesce("_before", "start")).select("entity", "from", F.col("t").alias("to"), F.lit(True).alias("event"), "first")
    last = times.groupBy("entity").agg(F.max("t").alias("last"))
    rest = whole.join(last, "entity", "left").where("last is null" if single else "true").select("entity", F.coalesce("last", "start").alias("from"), F.col("end").alias("to"), F.lit(False).alias("event"), "first")
    day = lambda c: (c - F.col("from")) / DAY
    lives = ended.unionByName(rest).select("entity", day(F.col("to")).alias("days"), "event", F.greatest(day(F.col("first")), F.lit(0.0)).alias("entry"))
    return lives.where("days > entry")


def quantile_time(curve: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """First time at which no more than 1 - ``share`` survive."""
    return curve.where(F.col("survival") <= 1 - share + 1e-12).groupBy(*by).agg(F.min("days").alias("days"))


def at_or_before(curve: DataFrame, asked: DataFrame, key: str, at: str, made: dict[str, tuple[str, Column]]) -> DataFrame:
    """``asked`` with aggregates (see ``ordered.strictly_before``) of the rows of ``curve`` whose ``days`` are at most ``at``, by ``key``
    (a text). Values are compared to twelve places; no row of ``asked`` is multiplied."""
    ticks = lambda c: F.round(c * 1e12).cast("long")
    steps = curve.select(F.col(key).alias("_key"), ticks(F.col("days")).alias("_time"), F.struct(*curve.columns).alias("_step"))
    rows = asked.select(F.coalesce(F.col(key), F.lit("")).alias("_key"), (ticks(F.col(at)) + 1).alias("_time"), F.struct(*asked.columns).alias("_asked"))
    both = steps.unionByName(rows, allowMissingColumns=True)
    found = strictly_before(both, "_key", "_time", made)
    return found.where("_asked is not null").select("_asked.*", *made)


def open_cases(cases: DataFrame, by: str, width: float) -> DataFrame:
    """Open cases (columns of ``cases``: by, days, event and others) with ``exceeded``, the share of the finished cases of their
    group that took no longer than they have lasted, and ``p``, the chance to finish within ``width`` days, given that they
    haven't yet; null where nothing of the group is known so far out."""
    rows = cases.withColumn("_group", F.coalesce(F.col(by).cast("string"), F.lit("\0")))
    curve = written(survival_curve(rows, ["_group"]), "case-curve")
    finished = rows.where("event").groupBy("_group").agg(F.count(F.lit(1)).alias("_finished"))
    open_ = written(rows.where("not event").withColumn("_row", F.monotonically_increasing_id()), "open-cases")
    asked = open_.select("_row", "_group", F.col("days").cast("double").alias("_at"), F.lit("now").alias("_when")).unionByName(open_.select("_row", "_group", (F.col("days") + width).alias("_at"), F.lit("then").alias("_when")))
    found = at_or_before(curve, asked, "_group", "_at", {"_s": ("min", F.col("_step.survival")), "_done": ("sum", F.col("_step.events"))})
    of = lambda when, c, none: F.coalesce(F.max(F.when(F.col("_when") == when, F.col(c))), F.lit(none))
    told = found.groupBy("_row").agg(of("now", "_s", 1.0).alias("_now"), of("then", "_s", 1.0).alias("_then"), of("now", "_done", 0).alias("_done"))
    out = open_.join(told, "_row").join(finished, "_group", "left")
    p = F.when(F.col("_now") > 0, 1 - F.col("_then") / F.col("_now"))
    return out.select(*cases.columns, F.try_divide(F.col("_done").cast("double"), F.col("_finished")).alias("exceeded"), p.alias("p"))


def event_features(df: DataFrame, entity: str, date: str, is_event: Column, days: int, row: str, cut: str | None = None) -> DataFrame:
    """(row, label, days_since, events_before, observable): whether the entity has an event in the next ``days`` days, how long
    since its last event strictly before, how many different event times are before, and whether those days are over by the cut.
    Rows without a date are left out. An entity may hold most rows: its times are parted by ranges."""
    t, width = micros(F.col(date)), int(days * DAY)
    rows = df.select(F.col(row).alias("row"), F.coalesce(F.col(entity).cast("string"), F.lit("\0")).alias("_entity"), t.alias("t"), F.coalesce(is_event, F.lit(False)).alias("e"))
    # Different event times of an entity, each once; a row asks what was before it, and before the end of its window.
    times = rows.where("e and t is not null").groupBy("_entity", "t").agg(F.lit(None).cast(dict(df.dtypes)[row]).alias("row"))
    asked = rows.where("t is not null")
    union = times.select("_entity", "t", "row", F.lit("event").alias("kind"))
    union = union.unionByName(asked.select("_entity", "t", "row", F.lit("now").alias("kind"))).unionByName(asked.select("_entity", (F.col("t") + width + 1).alias("t"), "row", F.lit("end").alias("kind")))
    event_time = F.when(F.col("kind") == "event", F.col("t"))
    past = strictly_before(union, "_entity", "t", {"latest": ("max", event_time)} | {"n": ("count", event_time)})
    latest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("latest")))
    found = past.where("kind <> 'event'").groupBy("row").agg(latest("now").alias("_before"), latest("end").alias("_within"), F.coalesce(F.max(F.when(F.col("kind") == "now", F.col("n"))), F.lit(0)).alias("events_before"))
    cut_at = rows.agg(F.max("t").alias("_cut")) if cut is None else rows.sparkSession.range(1).select((F.unix_micros(F.lit(cut).cast("timestamp"))).alias("_cut"))
    out = asked.select("row", "t").join(found, "row").join(F.broadcast(cut_at))
    # The last event before the window's end lies in the window if it's later than the row.
    return out.select("row", F.coalesce(F.col("_within") > F.col("t"), F.lit(False)).alias("label"), ((F.col("t") - F.col("_before")) / DAY).alias("days_since"), "events_before", (F.col("t") + width <= F.col("_cut")).alias("observable"))


def last_row(df: DataFrame, entity: str, date: str, tie: str) -> DataFrame:
    """The latest row of each entity; partial maxima, so no window over an entity's history."""
    latest = df.groupBy(entity).agg(F.max_by(tie, F.struct(date, tie)).alias(tie)).select(tie)
    return df.join(latest, tie, "left_semi")


def priority(df: DataFrame, entity: str, risk: str, cost: str) -> DataFrame:
    """(entity, score, share): risk times cost, highest first, with the running share of the total; negative and missing ones go."""
    rows = df.where((F.col(risk) >= 0) & (F.col(cost) >= 0)).select(F.col(entity).alias("entity"), (F.col(risk) * F.col(cost)).alias("score"))
    total = rows.agg(F.sum("score").alias("_total"))
    summed = running_sums(rows.withColumn("_key", -F.col("score")), "_key", {"_upto": F.col("score")}, ["entity"])
    return summed.join(F.broadcast(total)).select("entity", "score", F.try_divide(F.col("_upto"), F.col("_total")).alias("share"))


def _recent(df: DataFrame, entity: str, date: str, consumed: str, window_days: int) -> DataFrame:
    """(_e, _at, _c): what each element used on each day of the table's last ``window_days`` (from 0) on which it has a row."""
    end = df.agg(F.max(F.to_date(date)).alias("_end"))
    daily = df.groupBy(F.col(entity).alias("_e"), F.to_date(date).alias("_day")).agg(F.sum(F.col(consumed).cast("double")).alias("_c"))
    at = (window_days - 1 - F.datediff("_end", "_day")).alias("_at")
    return daily.join(F.broadcast(end)).select("_e", at, F.coalesce("_c", F.lit(0.0)).alias("_c")).where("_at >= 0")  # the end is one row


def _thirds(window_days: int) -> dict[str, Column]:
    """Aggregates of ``_recent``: sums and squares of the first and last third of the days; days without a row are zero."""
    third = window_days // 3
    parts = {"first": F.col("_at") < third, "last": F.col("_at") >= window_days - third}
    return {f"_{name}{p}": F.coalesce(F.sum(F.when(part, F.pow("_c", F.lit(p)))), F.lit(0.0)) for name, part in parts.items() for p in (1, 2)}


def _trend(window_days: int) -> tuple[Column, Column, Column]:
    """(first, last, trend) from ``_thirds``: the means, and whether the last is clearly (by two standard errors) over 1.25 or under
    0.75 of the first; windows of under nine days tell no trend."""
    third = window_days // 3
    first, last = (F.col(f"_{name}1") / max(1, third) for name in ("first", "last"))
    spread = [F.greatest(F.col(f"_{name}2") / max(1, third) - mean * mean, F.lit(0.0)) / max(1, third) for name, mean in (("first", first), ("last", last))]
    clear = (F.abs(last - first) > CLEAR_ERRORS * F.greatest(F.sqrt(spread[0] + spread[1]), F.lit(1e-12))) & F.lit(window_days >= TREND_DAYS)
    more, less = (first >= 0) & (last > RISING_FROM * first), (first > 0) & (last < FALLING_TO * first)
    return first, last, F.when(clear & more, "rising").when(clear & less, "falling").otherwise("stable")


def consumption_trend(df: DataFrame, entity: str, date: str, consumed: str, window_days: int = 56) -> DataFrame:
    """(entity, first, last, trend): mean daily consumption of the first and last third of the table's last ``window_days``, and whether
    it's rising, falling or stable; elements without a row in them are left out. One aggregate by element and day, one by element."""
    rows = _recent(df, entity, date, consumed, window_days).groupBy("_e").agg(*[c.alias(n) for n, c in _thirds(window_days).items()])
    first, last, trend = _trend(window_days)
    return rows.select(F.col("_e").alias("entity"), first.alias("first"), last.alias("last"), trend.alias("trend"))


def depletion(df: DataFrame, entity: str, date: str, consumed: str, stock: str, tie: str, window_days: int = 56) -> DataFrame:
    """(entity, stock, p10, p50, p90, state, trend): days until each element's stock is used up, from its last ``window_days`` of daily
    consumption. ``state``: unknown (no stock is told), out (none is left), unused (nothing was used), beyond (half of the paths
    outlast the horizon) or lasting. ``trend``: see ``consumption_trend``; paths take consumption to go on as in the window, so
    a rising one may end sooner.

    An element is one row with an array of at most ``window_days`` days, and a batch of rows is simulated at a time."""
    from tidemark.functions.forecasting import depletion_times

    last = df.groupBy(F.col(entity).alias("entity")).agg(F.max_by(stock, F.struct(date, tie)).cast("double").alias("stock"))
    days = _recent(df, entity, date, consumed, window_days).groupBy("_e").agg(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_c").alias("c"))).alias("_days"), F.sum("_c").alias("_used"), *[c.alias(n) for n, c in _thirds(window_days).items()])
    rows = last.join(days, F.col("entity").eqNullSafe(F.col("_e")), "left")

    @F.pandas_udf("p10 double, p50 double, p90 double")
    def simulated(names, stocks, lists):
        import numpy as np
        import pandas as pd

        out = []
        for name, now, some in zip(names, stocks, lists, strict=True):
            values = np.zeros(window_days)
            for x in some if some is not None else ():
                values[x["at"]] = x["c"]
            out.append(depletion_times(values, now, zlib.crc32(str(name).encode())) if now == now else (np.nan,) * 3)
        return pd.DataFrame(out, columns=["p10", "p50", "p90"])

    state = F.when(F.col("stock").isNull(), "unknown").when(F.col("stock") <= 0, "out").when(F.coalesce("_used", F.lit(0.0)) <= 0, "unused").when(F.col("_p.p50") == float("inf"), "beyond").otherwise("lasting")
    simulations = rows.withColumn("_p", simulated(F.col("entity").cast("string"), "stock", "_days"))
    return simulations.select("entity", "stock", "_p.*", state.alias("state"), F.coalesce(_trend(window_days)[2], F.lit("stable")).alias("trend"))
