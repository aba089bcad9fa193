"""Forecasts of many series at once: candidates and origins are rows.

A *history* is a series as far as one origin knows it, in one of three forms: as it is, less its added season, or over its
multiplied season. A method's forecast is an aggregate over the rows of a history; a candidate is a method on a form. Series are
of periods, so a history has at most as many rows as the series has periods, and the work is spread over (series, origin, form)."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import written

# The smoothing rates of level and slope and the dampings that are tried, and windows in periods.
LEVEL_RATES, SLOPE_RATES, DAMPINGS = (0.05, 0.15, 0.4, 0.8), (0.005, 0.03, 0.15), (0.9, 0.98, 1.0)
HOLT_PERIODS, LONG_PERIODS, ORIGINS = 600, 500, 16
#: Periods that the first origin knows, origins from which on the choice is made apart from its judgement, and the excess over the
#: least error up to which a simpler candidate is taken.
FIRST_KNOWN, APART_FROM, NEARLY = 8, 8, 1.03
#: The greatest power of the step by which errors grow, and the least beyond the tried steps for methods that follow the last value.
STEEPEST, WALK = 0.6, 0.5

PLAIN, ADDED, MULTIPLIED = "", "added", "multiplied"
METHODS = ("last", "recent mean", "recent trend", "long trend", "damped")
#: From the simplest on.
CANDIDATES = [(m, PLAIN) for m in METHODS] + [("seasonal", PLAIN)] + [(m, f) for f in (ADDED, MULTIPLIED) for m in METHODS]
REFERENCES = [("last", PLAIN), ("seasonal", PLAIN), ("historic mean", PLAIN)]
SID = "_series"


def _numbered(series: DataFrame, by: Sequence[str], most_periods: int | None) -> DataFrame:
    """(_series, i, y, n): known values of a series in order, the last ``most_periods`` of them."""
    rows = series.where(F.col("y").isNotNull() & ~F.isnan("y")).select(F.struct(*(by or [F.lit("").alias("_all")])).alias(SID), "period", F.col("y").cast("double").alias("y"))
    order = Window.partitionBy(SID).orderBy("period")  # a row a period
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    n = rows.groupBy(SID).agg(F.count(F.lit(1)).cast("int").alias("n"))
    if most_periods:
        n = n.withColumn("_skip", F.greatest(F.col("n") - most_periods, F.lit(0)))
        rows = rows.join(n.select(SID, "_skip"), SID).withColumn("i", F.col("i") - F.col("_skip")).where("i >= 0")
        n = n.select(SID, F.least("n", F.lit(most_periods)).alias("n"))
    return rows.join(n, SID).select(SID, F.col("i").cast("int").alias("i"), "y", "n")


def _origins(rows: DataFrame, cycle: int, season_from: int, horizon: int, origins: int) -> DataFrame:
    """(_series, n, m, span, t, turn, turns): a row for each origin, t the periods that it knows; that of the forecast itself has turn
    null and all periods. ``m``: the cycle, or null where it can't be tried. A series too short for two tests has none."""
    s = rows.groupBy(SID).agg(F.first("n").alias("n")).withColumn("span", F.greatest(F.lit(1), F.least(F.lit(horizon), F.floor(F.col("n") / 5))).cast("int"))
    last = F.col("n") - F.col("span")
    wide = F.greatest(F.lit(FIRST_KNOWN), F.lit(2 * cycle))
    s = s.withColumn("m", F.when((F.col("n") >= season_from) & (last - wide >= 3), F.lit(cycle)))
    first = F.when(F.col("m").isNotNull(), wide).otherwise(F.lit(FIRST_KNOWN))
    room = last - first
    # Origins stand at equal distances between the first and the last, as many as there is room for.
    steps = F.least(F.lit(origins - 1), room)
    tests = F.when(room >= 1, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: (first + F.round(k * room / F.greatest(steps, F.lit(1)))).cast("int")))
    s = s.withColumn("_tests", F.coalesce(F.array_distinct(tests), F.array().cast("array<int>"))).withColumn("turns", F.size("_tests"))
    tested = s.select(SID, "n", "m", "span", "turns", F.posexplode("_tests").alias("turn", "t"))
    return tested.unionByName(s.select(SID, "n", "m", F.lit(horizon).alias("span"), "turns", F.lit(None).cast("int").alias("turn"), F.col("n").alias("t")))


def _seasons(known: DataFrame, cycle: int) -> DataFrame:
    """(_series, t, place, added, multiplied): what the places of the cycle add to a history's level, or multiply it by; ``multiplied``
    is null where the history isn't positive throughout, or a place would nearly vanish."""
    around = Window.partitionBy(SID, "t").orderBy("i").rowsBetween(-(cycle // 2), (cycle - 1) // 2)
    level = F.when(F.count("y").over(around) >= max(2, cycle // 2), F.avg("y").over(around))
    rows = known.where("m is not null").withColumn("level", level).withColumn("place", F.col("i") % cycle)
    places = rows.groupBy(SID, "t", "place").agg(F.avg(F.col("y") - F.col("level")).alias("added"), F.avg(F.try_divide("y", "level")).alias("multiplied"), F.min("y").alias("least"))
    whole = Window.partitionBy(SID, "t")  # a row a place
    scaled = F.try_divide(F.col("multiplied"), F.avg("multiplied").over(whole))
    places = places.withColumn("added", F.col("added") - F.avg("added").over(whole)).withColumn("multiplied", F.when(F.min("least").over(whole) > 0, scaled))
    return places.select(SID, "t", "place", "added", F.when(F.min("multiplied").over(whole) > 0.05, F.col("multiplied")).alias("multiplied"))


def _damped(histories: DataFrame, holt_periods: int) -> DataFrame:
    """(_series, t, form, damped: level, slope, damping): the rates whose steps missed least, of Holt's level and damped slope. A row
    for each triple of rates folds the history's values in order."""
    values = histories.where(F.col("i") >= F.col("t") - holt_periods).groupBy(SID, "t", "form").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"))
    values = values.where(F.size("vs") >= 4).withColumn("vs", F.transform("vs", lambda x: x["v"]))
    grid = [(a, b, p) for a in LEVEL_RATES for b in SLOPE_RATES for p in DAMPINGS]
    rates = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(p).alias("p")) for k, (a, b, p) in enumerate(grid)])
    each = values.withColumn("rate", F.explode(rates))
    first = F.get("vs", F.lit(0))
    start = F.struct(first.alias("level"), ((F.get("vs", F.lit(3)) - first) / 3).alias("slope"), F.lit(0.0).alias("missed"))

    def step(s: Column, v: Column) -> Column:
        a, b, p = F.col("rate.a"), F.col("rate.b"), F.col("rate.p")
        guess = s["level"] + p * s["slope"]
        level = guess + a * (v - guess)
        return F.struct(level.alias("level"), (b * (level - s["level"]) + (1 - b) * p * s["slope"]).alias("slope"), (s["missed"] + (v - guess) * (v - guess)).alias("missed"))

    fitted = each.withColumn("end", F.aggregate(F.slice("vs", 2, F.size("vs")), start, step))
    end = F.struct(F.col("end.level").alias("level"), F.col("end.slope").alias("slope"), F.col("rate.p").alias("damping"))
    return fitted.groupBy(SID, "t", "form").agg(F.min_by(end, F.struct("end.missed", "rate.no")).alias("damped"))


def _ahead(rows: DataFrame, origins: DataFrame, cycle: int, holt_periods: int, long_periods: int) -> DataFrame:
    """(_series, t, turn, turns, tried, method, form, step, value): every candidate's forecasts from every origin."""
    known = rows.select(SID, "i", "y").join(origins, SID).where("i < t")
    places = written(_seasons(known, cycle), "seasons")
    placed = known.withColumn("place", F.when(F.col("m").isNotNull(), F.col("i") % cycle)).join(places, [SID, "t", "place"], "left")
    forms = F.array(F.struct(F.lit(PLAIN).alias("form"), F.col("y").alias("v")), F.struct(F.lit(ADDED).alias("form"), (F.col("y") - F.col("added")).alias("v")), F.struct(F.lit(MULTIPLIED).alias("form"), (F.col("y") / F.col("multiplied")).alias("v")))
    histories = placed.select(SID, "t", "turn", "turns", "span", "m", "i", F.explode(forms).alias("f")).select("*", "f.*").drop("f").where("v is not null")
    histories = written(histories, "histories")
    t, i, v, m = F.col("t"), F.col("i"), F.col("v"), F.col("m")
    since = lambda n, x: F.when(i >= t - n, x)
    recent, trending = F.greatest(F.coalesce(m, F.lit(0)), F.lit(6)), F.greatest(F.lit(14), 4 * F.coalesce(m, F.lit(4)), F.floor(t / 3).cast("int"))
    line = lambda n, name: F.struct(F.coalesce(F.regr_slope(since(n, v), i.cast("double")), F.lit(0.0)).alias("slope"), F.avg(since(n, v)).alias("mean"), F.avg(since(n, i.cast("double"))).alias("middle")).alias(name)
    keys = [SID, "t", "turn", "turns", "span", "form"]
    base = histories.groupBy(*keys).agg(
        F.max_by("v", "i").alias("last"), F.avg(since(recent, v)).alias("recent"), F.avg("v").alias("whole"), line(trending, "short"), line(F.lit(long_periods), "long"), F.first("m").alias("m"),
        F.array_sort(F.collect_list(F.when((i >= t - cycle) & m.isNotNull(), F.struct("i", "v")))).alias("tail"),
    )
    base = base.join(_damped(histories, holt_periods), [SID, "t", "form"], "left")
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(1), "span")))
    k = F.col("step")
    on_line = lambda c: F.col(f"{c}.mean") + F.col(f"{c}.slope") * (t + k - 1 - F.col(f"{c}.middle"))
    p = F.col("damped.damping")
    reach = F.when(p == 1, k.cast("double")).otherwise(p * (1 - F.pow(p, k)) / (1 - p))
    damped = F.coalesce(F.col("damped.level") + F.col("damped.slope") * reach, F.col("last"))
    again = F.get(F.col("tail"), ((k - 1) % cycle).cast("int"))["v"]
    plain = F.col("form") == PLAIN
    told = dict(zip(METHODS, (F.col("last"), F.col("recent"), on_line("short"), on_line("long"), damped), strict=True)) | {"seasonal": F.when(plain, again), "historic mean": F.when(plain, F.col("whole"))}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), value.alias("value")) for name, value in told.items()])).alias("_f")
    out = steps.select(SID, "t", "turn", "turns", "span", "form", "step", F.when(F.col("m").isNotNull(), (t + k - 1) % cycle).alias("place"), each).select("*", "_f.*").drop("_f").where("value is not null")
    out = out.join(places, [SID, "t", "place"], "left")
    back = F.when(F.col("form") == ADDED, F.col("value") + F.col("added")).when(F.col("form") == MULTIPLIED, F.col("value") * F.col("multiplied")).otherwise(F.col("value"))
    return out.select(SID, "t", "turn", "turns", F.col("span").alias("tried"), "method", "form", "step", back.alias("value"))


def _growth(errors: DataFrame) -> DataFrame:
    """(_series, base, power): a spread of base * step ** power through the root mean squares of the errors by step. Under five steps
    tell no power: that of a walk for methods that follow the last value, else none."""
    by_step = errors.groupBy(SID, "step", "method").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("s"))
    x, y = F.ln(F.col("step").cast("double")), F.ln(F.greatest("s", F.lit(1e-12)))
    fit = by_step.groupBy(SID, "method").agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("steps"), F.avg(y).alias("_y"), F.avg(x).alias("_x"))
    untold = F.when(F.col("method").isin("last", "damped"), WALK).otherwise(0.0)
    power = F.when(F.col("steps") >= 5, F.least(F.greatest("slope", F.lit(0.0)), F.lit(STEEPEST))).otherwise(untold)
    return fit.withColumn("power", power).select(SID, F.exp(F.col("_y") - F.col("power") * F.col("_x")).alias("base"), "power")


def project(series: DataFrame, by: Sequence[str], cycle: int, season_from: int, horizon: int, level: float = 0.8, most_periods: int | None = None, holt_periods: int = HOLT_PERIODS, long_periods: int = LONG_PERIODS, origins: int = ORIGINS) -> DataFrame:
    """(by, step, forecast, low, high, sigma, method, error, reference_error, improvement, coverage, origins) of each series (by, period, y).

    Candidates forecast at most a fifth of the series from up to ``origins`` earlier points. With eight or more the method is
    chosen on the earlier half of them, and its error, its spread and its gain over the best simple answer (last, seasonal, historic
    mean) come from the later half; ``coverage`` is how often a spread told by the earlier half held there. A series too short
    for that goes on from its last value, with the spread of a walk. What was never negative stays so. Empty series have no row."""
    rows = written(_numbered(series, by, most_periods), "periods")
    points = written(_origins(rows, cycle, season_from, horizon, origins), "origins")
    ahead = written(_ahead(rows, points, cycle, holt_periods, long_periods), "ahead")
    actual = rows.select(SID, F.col("i").alias("at"), "y")
    tests = ahead.where("turn is not null").withColumn("at", F.col("t") + F.col("step") - 1).join(actual, [SID, "at"]).withColumn("e", F.col("y") - F.col("value"))
    half = F.when(F.col("turns") >= APART_FROM, F.floor(F.col("turns") / 2)).otherwise(0)
    tests = written(tests.select(SID, "turn", "turns", "tried", "method", "form", "step", "e", (F.col("turn") >= half).alias("late"), ((F.col("turn") < half) | (half == 0)).alias("early"), (half > 0).alias("apart")), "tests")
    finite = F.count(F.when(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") < float("inf")), 1))
    root = lambda which: F.sqrt(F.avg(F.when(F.col(which), F.col("e") * F.col("e"))))
    scores = tests.groupBy(SID, "method", "form", "turns", "tried").agg(root("early").alias("score"), root("late").alias("error"), finite.alias("known")).where(F.col("known") == F.col("turns") * F.col("tried"))
    among = lambda some: F.array(*[F.struct(F.lit(m).alias("method"), F.lit(f).alias("form")) for m, f in some])
    rank = F.array_position(among(CANDIDATES), F.struct("method", "form"))
    least = scores.where(rank > 0).groupBy(SID).agg(F.min("score").alias("least"))
    chosen = scores.join(least, SID).where((rank > 0) & (F.col("score") <= NEARLY * F.col("least") + 1e-12)).groupBy(SID).agg(F.min_by(F.struct("method", "form", "error", "tried", "turns"), rank).alias("c")).select(SID, "c.*")
    simple = scores.where(F.array_contains(among(REFERENCES), F.struct("method", "form"))).groupBy(SID).agg(F.min("error").alias("reference_error"))
    chosen = written(chosen.join(simple, SID, "left"), "chosen")
    own = written(tests.join(chosen.select(SID, "method", "form"), [SID, "method", "form"]), "own-errors")
    z = NormalDist().inv_cdf(0.5 + level / 2)
    earlier = _growth(own.where("apart and not late"))
    covered = own.where("apart and late").join(earlier, SID).groupBy(SID).agg(F.avg((F.abs("e") <= z * F.col("base") * F.pow("step", F.col("power"))).cast("double")).alias("coverage"))
    model = chosen.join(_growth(own.where("late")), SID).join(covered, SID, "left")

    moved = rows.withColumn("d", F.col("y") - F.lag("y").over(Window.partitionBy(SID).orderBy("i")))
    of = moved.groupBy(SID).agg(F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("_walk"), (F.min("y") >= 0).alias("_never_negative"), F.max_by("y", "i").alias("_last"))
    final = ahead.where("turn is null").select(SID, "method", "form", "step", "value")
    grid = of.join(points.where("turn is null").select(SID, "turns"), SID).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    out = grid.join(model.drop("turns"), SID, "left").join(final, [SID, "method", "form", "step"], "left")
    told = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    k, tried = F.col("step").cast("double"), F.col("tried").cast("double")
    beyond = F.greatest("power", F.when(F.col("method").isin("last", "damped"), WALK).otherwise(0.0))
    grown = F.col("base") * F.when(k <= tried, F.pow(k, F.col("power"))).otherwise(F.pow(tried, F.col("power")) * F.pow(k / tried, beyond))
    forecast, sigma = F.when(told, F.col("value")).otherwise(F.col("_last")), F.coalesce(grown, F.col("_walk") * F.sqrt(k))
    kept = lambda c: F.when(F.col("_never_negative"), F.greatest(c, F.lit(0.0))).otherwise(c)
    name = F.when(told, F.concat(F.col("method"), F.when(F.col("form") == PLAIN, "").otherwise(F.concat(F.lit(" + season "), F.col("form"))))).otherwise("last")
    gain = F.when(F.col("reference_error") > 0, F.least(F.greatest(1 - F.col("error") / F.col("reference_error"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return out.select(*[F.col(f"{SID}.`{c}`").alias(c) for c in by], "step", kept(forecast).alias("forecast"), kept(forecast - z * sigma).alias("low"), kept(forecast + z * sigma).alias("high"), sigma.alias("sigma"), name.alias("method"), "error", "reference_error", gain.alias("improvement"), "coverage", F.col("turns").alias("origins"))
