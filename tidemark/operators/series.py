"""Time series: frequency, periods, filling, trend and seasonality as DataFrames; one series or one for each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import bucket, micros
from tidemark.operators.ordered import previous

DAY = 86_400_000_000
STEP = {"H": "interval 1 hour", "D": "interval 1 day", "B": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}
CYCLE = {"H": 24, "D": 7, "B": 5, "W": 52, "M": 12}
HORIZON = {"H": 48, "D": 30, "B": 20, "W": 12, "M": 6}
# Fixed values, as those above.
#: Periods from which on a season is looked for, horizons of questions about limits, and periods that are enough to say anything.
SEASON_FROM = {"H": 72, "D": 21, "B": 15, "W": 104, "M": 24}
LIMIT_HORIZON = {"H": 72, "D": 90, "B": 65, "W": 26, "M": 12}
LEAST_PERIODS = 12


def frequency_profile(df: DataFrame, date: str) -> DataFrame:
    """span_days, days, median_gap and freq: hours under three days of span; days where half of the days have rows; else by
    the median gap between days with rows: days under 3.5, weeks under 20, months from there."""
    days = df.where(F.col(date).isNotNull()).select(F.to_date(date).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("rows"))
    gaps = days.withColumn("month", F.trunc("d", "month"))
    # The gap over a month's border comes from the months' ends, so no window holds all days.
    inner = gaps.select(F.datediff("d", F.lag("d").over(Window.partitionBy("month").orderBy("d"))).alias("gap")).where("gap is not null")
    ends = gaps.groupBy("month").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    outer = ends.select(F.datediff("a", F.lag("b").over(Window.orderBy("month"))).alias("gap")).where("gap is not null")
    gap = inner.unionByName(outer).agg(F.median("gap").alias("median_gap"))
    span = df.agg(((F.max(micros(F.col(date))) - F.min(micros(F.col(date)))) / float(DAY)).alias("span_days")).join(F.broadcast(days.agg(F.count(F.lit(1)).alias("days"))))
    out = span.join(F.broadcast(gap))
    freq = F.when(F.col("span_days") < 3, "H").when(F.col("days") / F.greatest(F.col("span_days"), F.lit(1.0)) >= 0.5, "D").when(F.coalesce("median_gap", F.lit(99.0)) < 3.5, "D").when(F.coalesce("median_gap", F.lit(99.0)) < 20, "W").otherwise("M")
    return out.withColumn("freq", freq)


def is_business(df: DataFrame, date: str) -> bool:
    """At least 14 days on at least three weekdays, none at a weekend."""
    got = df.select(F.to_date(date).alias("d")).distinct().agg(F.count("d").alias("n"), F.count_distinct(F.weekday("d")).alias("w"), F.count(F.when(F.weekday("d") >= 5, 1)).alias("off")).first()
    return got["n"] >= 14 and got["w"] >= 3 and not got["off"]


def aggregate(df: DataFrame, date: str, freq: str, op: str, value: str | None = None, tie: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, y, n): sum, mean, last (known, in order of time), max, min or count."""
    v = F.col(value) if value else None
    made = {"sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "max": lambda: F.max(v), "min": lambda: F.min(v), "count": lambda: F.count(F.lit(1)), "last": lambda: F.max_by(v, F.when(v.isNotNull(), F.struct(date, tie) if tie else F.col(date)))}[op]()
    return df.where(F.col(date).isNotNull()).groupBy(*by, bucket(F.col(date), freq).alias("period")).agg(made.cast("double").alias("y"), F.count(F.lit(1)).alias("n"))


def calendar(series: DataFrame, freq: str, by: Sequence[str] = ()) -> DataFrame:
    """All periods from the first to the last of each series."""
    span = series.groupBy(*by).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select(*by, F.explode(F.sequence("a", "b", F.expr(STEP[freq]))).alias("period"))
    return grid.where(F.weekday("period") < 5) if freq == "B" else grid


def fill(series: DataFrame, freq: str, op: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, period, y) without gaps. Sums and counts: 0 where there are no rows, on the line between neighbours where rows have
    no value. Last values go on. Others: on the line; at the ends, the nearest value."""
    grid = calendar(series, freq, by).join(series, [*by, "period"], "left")
    y = F.when(F.col("n").isNull(), 0.0).otherwise(F.col("y")) if op in ("sum", "count") else F.col("y")
    grid = grid.select(*by, "period", y.alias("y"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period")  # one row a period, not one a table row
    grid = grid.withColumn("_i", F.row_number().over(order))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("y").isNotNull(), F.struct("_i", "y"))
    grid = grid.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    between = F.col("_a.y") if op == "last" else F.when(F.col("_b._i") > F.col("_a._i"), line)
    return grid.select(*by, "period", F.coalesce("y", between, F.col("_a.y"), F.col("_b.y")).alias("y"))


def incomplete_last(df: DataFrame, series: DataFrame, date: str, freq: str) -> DataFrame:
    """(period, n, typical, incomplete): weeks and months whose data end over three days before the period; days and hours
    with under half of the median count of the seven before, if there are nine periods and the median is 3 or more."""
    last = series.agg(F.max("period").alias("period"), F.max_by("n", "period").alias("n"), F.count(F.lit(1)).alias("periods"))
    if freq in ("W", "M"):
        end = F.col("period") + F.expr("interval 7 days" if freq == "W" else "interval 1 month")
        got = last.join(F.broadcast(df.agg(F.max(date).alias("_max"))))
        return got.select("period", "n", F.lit(None).cast("double").alias("typical"), (F.col("_max") < end - F.expr("interval 3 days")).alias("incomplete"))
    recent = series.orderBy(F.desc("period")).limit(8)
    typical = recent.join(F.broadcast(last.select(F.col("period").alias("_last")))).where("period < _last").agg(F.median("n").alias("typical"))
    both = last.join(F.broadcast(typical))
    return both.select("period", "n", "typical", ((F.col("periods") >= 9) & (F.col("typical") >= 3) & (F.col("n") < 0.5 * F.col("typical"))).alias("incomplete"))


def trend(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, slope, intercept, rho, low, high, direction): least squares over period numbers; the slope's error is widened by the
    residuals' own correlation; direction up, down or stable by the 95 % interval."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period")
    rows = series.select(*by, "period", "y").withColumn("_i", (F.row_number().over(order) - 1).cast("double"))
    fit = rows.groupBy(*by).agg(F.count("y").alias("n"), F.regr_slope("y", "_i").alias("slope"), F.regr_intercept("y", "_i").alias("intercept"), F.regr_sxx("y", "_i").alias("_sxx"))
    both = rows.join(fit, list(by)) if by else rows.join(F.broadcast(fit))
    both = both.withColumn("_e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("_i")).withColumn("_p", F.lag("_e").over(order))
    keys = [*by, "n", "slope", "intercept", "_sxx"]
    out = both.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_e") * F.col("_p")), F.sum(F.col("_e") * F.col("_e"))).alias("_rho"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"))
    out = out.withColumn("rho", F.least(F.greatest(F.coalesce("_rho", F.lit(0.0)), F.lit(0.0)), F.lit(0.95)))
    error = F.sqrt(F.col("_sse") / (F.col("n") - 2) / F.col("_sxx")) * F.sqrt((1 + F.col("rho")) / (1 - F.col("rho")))
    out = out.withColumn("low", F.col("slope") - 1.96 * error).withColumn("high", F.col("slope") + 1.96 * error)
    return out.select(*by, "n", "slope", "intercept", "rho", "low", "high", F.when(F.col("low") > 0, "up").when(F.col("high") < 0, "down").otherwise("stable").alias("direction"))


def centred_mean(series: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``level``, the mean of m periods around each; at least half of them must be there."""
    frame = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period").rowsBetween(-(m // 2), (m - 1) // 2)
    return series.withColumn("level", F.when(F.count("y").over(frame) >= max(2, m // 2), F.avg("y").over(frame)))


def position(freq: str):
    p = F.col("period")
    return {"H": F.hour(p), "D": F.weekday(p), "B": F.weekday(p), "W": F.weekofyear(p), "M": F.month(p)}[freq]


def seasonality(series: DataFrame, freq: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, position, effect, n): mean ratio to the centred mean at each place of the cycle where all values are positive, else mean difference."""
    rows = centred_mean(series, CYCLE[freq], by).where("level is not null").withColumn("position", position(freq))
    positive = rows.groupBy(*by).agg((F.min(F.least("y", "level")) > 0).alias("_ratio"))
    rows = rows.join(positive, list(by)) if by else rows.join(F.broadcast(positive))
    effect = F.when(F.col("_ratio"), F.try_divide(F.col("y"), F.col("level"))).otherwise(F.col("y") - F.col("level"))
    return rows.groupBy(*by, "position").agg(F.avg(effect).alias("effect"), F.count(F.lit(1)).alias("n"))


def seasonal_strength(series: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, strength): 1 - the variance around the means of the cycle's ``m`` places over the variance around the centred mean,
    between 0 and 1; 0 with under two cycles or without variance. Places count from each series's first period."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period")
    rows = centred_mean(series, m, by).withColumn("_place", (F.row_number().over(order) - 1) % m)
    rows = rows.select(*by, "_place", "level", (F.col("y") - F.col("level")).alias("_rest"))
    place = Window.partitionBy(*by, "_place")
    rows = rows.withColumn("_left", F.col("_rest") - F.avg("_rest").over(place))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("_known"), F.var_pop("_rest").alias("_v"), F.var_pop("_left").alias("_w"))
    strength = F.least(F.greatest(1 - F.try_divide(F.col("_w"), F.col("_v")), F.lit(0.0)), F.lit(1.0))
    return out.select(*by, "n", F.when((F.col("_known") >= 2 * m) & (F.col("_v") > 0), strength).otherwise(0.0).alias("strength"))


def season_indices(series: DataFrame, m: int, by: Sequence[str] = (), multiplied: bool = False) -> DataFrame:
    """(by, place, effect): mean difference from (or ratio to) the centred mean at each place of the cycle, normalised so that
    the places' mean is 0 (or 1)."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("period")
    rows = centred_mean(series, m, by).withColumn("place", (F.row_number().over(order) - 1) % m).where("level is not null")
    off = F.try_divide(F.col("y"), F.col("level")) if multiplied else F.col("y") - F.col("level")
    places = rows.groupBy(*by, "place").agg(F.avg(off).alias("effect"))
    mean = F.avg("effect").over(Window.partitionBy(*(by or [F.lit(0)])))  # over at most m rows a series
    return places.withColumn("effect", F.try_divide(F.col("effect"), mean) if multiplied else F.col("effect") - mean)


def season_choice(series: DataFrame, cycles: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, cycle, strength, stability): the cycle whose places explain most of what is left around the level (see
    ``seasonal_strength``; of equals the shortest), and how alike its effects are in the two halves of the series: their
    correlation over the places, null with under two cycles in a half. Cycles that no series holds twice are left out."""
    key = F.struct(*(by or [F.lit("").alias("_all")]))
    rows = series.where(F.col("y").isNotNull()).select(key.alias("_s"), "period", "y")
    order = Window.partitionBy("_s").orderBy("period")
    n = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for m in cycles:
        one = seasonal_strength(rows, m, ["_s"]).where(F.col("n") >= 2 * m).select("_s", F.lit(m).alias("cycle"), "strength")
        placed = centred_mean(rows, m, ["_s"]).withColumn("_i", F.row_number().over(order) - 1).where("level is not null").join(n, "_s")
        half = (F.col("_i") >= F.floor(F.col("n") / 2)).cast("int")
        effects = placed.groupBy("_s", F.col("_i") % m).agg(*[F.avg(F.when(half == h, F.col("y") - F.col("level"))).alias(f"_e{h}") for h in (0, 1)])
        alike = effects.groupBy("_s").agg(F.corr("_e0", "_e1").alias("_r"))
        one = one.join(alike, "_s").join(n, "_s").select("_s", "cycle", "strength", F.when(F.col("n") >= 4 * m, F.col("_r")).alias("stability"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("_s").agg(F.max_by(F.struct("cycle", "strength", "stability"), F.struct("strength", -F.col("cycle"))).alias("b"))
    return best.select(*[F.col(f"_s.`{c}`").alias(c) for c in by], "b.*")


def seasonless(series: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """The series (by, period, y) less the effect of its place in the cycle (``season_indices``); as it is, with under two cycles."""
    key = F.struct(*(by or [F.lit("").alias("_all")]))
    rows = series.where(F.col("y").isNotNull()).select(key.alias("_s"), "period", "y")
    effects = season_indices(rows, m, ["_s"])
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_s").orderBy("period")) - 1).withColumn("place", F.col("_i") % m)
    n = rows.groupBy("_s").agg((F.count(F.lit(1)) >= 2 * m).alias("_twice"))
    out = numbered.join(effects, ["_s", "place"], "left").join(n, "_s").withColumn("y", F.when(F.col("_twice"), F.col("y") - F.coalesce("effect", F.lit(0.0))).otherwise(F.col("y")))
    return out.select(*[F.col(f"_s.`{c}`").alias(c) for c in by], "period", "y")


def seasonless_trend(series: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """``trend`` of the series without its season."""
    return trend(seasonless(series, m, by), by)


def last_cycles(series: DataFrame, m: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, cycles, last, previous, change): the means of the last whole cycle and of the one before it, so that both have every place
    once, and the change as a share; ``cycles`` whole ones there are. Null previous with one cycle alone."""
    key = F.struct(*(by or [F.lit("").alias("_all")]))
    rows = series.where(F.col("y").isNotNull()).select(key.alias("_s"), "period", "y")
    back = rows.withColumn("_back", F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("period"))) - 1)
    mean = lambda k: F.avg(F.when(F.floor(F.col("_back") / m) == k, F.col("y")))
    out = back.groupBy("_s").agg(F.floor(F.count(F.lit(1)) / m).alias("cycles"), mean(0).alias("last"), mean(1).alias("previous"))
    previous = F.when(F.col("cycles") >= 2, F.col("previous"))
    return out.where("cycles >= 1").select(*[F.col(f"_s.`{c}`").alias(c) for c in by], "cycles", "last", previous.alias("previous"), F.try_divide(F.col("last") - previous, F.abs(previous)).alias("change"))


def stock_consumption(df: DataFrame, entity: str, date: str, stock: str, tie: str) -> DataFrame:
    """Consumption as the fall of a stock since the entity's row before; rises are 0; first rows go. An entity may hold most rows."""
    fall = F.col("_before") - F.col(stock)
    rows = previous(df, [entity], [date, tie], F.col(stock), "_before")
    return rows.withColumn("consumed", F.when(fall.isNotNull(), F.greatest(fall, F.lit(0.0)))).where("consumed is not null").drop("_before")


def trailing_streak(series: DataFrame, limit: float) -> DataFrame:
    """periods: how many periods in a row, up to the last, are over the limit."""
    last_ok = series.agg(F.max(F.when(~(F.col("y") > limit), F.col("period"))).alias("_ok"))
    return series.join(F.broadcast(last_ok)).agg(F.count(F.when(F.col("_ok").isNull() | (F.col("period") > F.col("_ok")), 1)).alias("periods"))


def project(series: DataFrame, freq: str, by: Sequence[str], horizon: int | None = None, level: float = 0.8, most_periods: int | None = None, **windows) -> DataFrame:
    """A row for each of ``horizon`` steps of each series of periods without gaps: forecast, its interval of ``level`` and standard
    error ``sigma``, the method, its error and that of the best simple answer, the gain, the interval's coverage in tests.

    See ``forecasts.project``. ``most_periods`` bounds how far back a series is looked at (None: all of it); ``windows``:
    ``holt_periods`` and ``long_periods`` of the two long methods. A season is tried from ``SEASON_FROM`` periods on."""
    from tidemark.operators import forecasts

    return forecasts.project(series, by, CYCLE[freq], SEASON_FROM[freq], horizon or HORIZON[freq], level, most_periods, **windows)
