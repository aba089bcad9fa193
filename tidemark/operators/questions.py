"""Questions about series: preparation, crossing of a limit, saturation, what a change of a driver goes with; one series or one for
each entity. Forecasts come from ``series.project``; what is asked of them are DataFrame aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import written
from tidemark.operators import series as se
from tidemark.operators.lineage import looks_like_key, name_parts

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Words of a column's name that say how its values of a period go together.
LEVELS = {
    "stock", "nivel", "saldo", "temperatura", "temp", "precio", "promedio", "tasa", "porcentaje", "humedad", "presion", "voltaje", "saturacion", "temperature", "balance", "price", "average", "avg",
    "mean", "rate", "percent", "percentage", "humidity", "pressure", "voltage", "level", "inventory", "score", "rating",
}
PEAKS = {
    "uso", "carga", "trafico", "conexiones", "usuarios", "cpu", "memoria", "ancho", "banda", "aforo", "cola", "usage", "load", "traffic", "connections", "users", "memory", "bandwidth", "capacity", "queue", "peak",
}
EITHER = {"ocupacion", "latencia", "occupancy", "latency"}
SUMS = {
    "venta", "ventas", "monto", "total", "cantidad", "consumo", "ingreso", "ingresos", "ganancia", "ganancias", "costo", "costos", "gasto", "gastos", "unidades", "pedidos", "produccion", "compras", "sale",
    "sales", "revenue", "amount", "quantity", "qty", "units", "consumption", "income", "profit", "cost", "costs", "expense", "expenses", "orders", "production", "purchases", "count",
}


# Further words of names that say what a column is for.
VALUES = SUMS | {"valor", "value", "precio", "price", "temperatura", "temperature", "uso", "usage", "carga", "load", "stock"}
EVENTS = {
    "falla", "fallo", "evento", "error", "incidente", "averia", "tipo", "estado", "status", "alarma", "alerta",
    "failure", "fault", "event", "incident", "type", "state", "alarm", "alert",
}
STARTS = {"inicio", "apertura", "creacion", "ingreso", "solicitud", "start", "opened", "open", "created", "creation", "request"}
ENDS = {"fin", "cierre", "termino", "entrega", "resolucion", "end", "closed", "close", "resolved", "resolution", "delivery", "finish"}
MOST_ENTITIES = 5_000


def suggested_settings(df: DataFrame, keyword: str = "projection") -> dict[str, str]:
    """Columns to begin a question with, by their types, names and numbers of different values; whoever asks may choose others.

    ``date``: the first column of dates. ``value``: the number, not a key, whose name most says that it's worth following, the
    first of equals. ``entity``: a text, or a key, of 2 to a third of the rows and at most ``MOST_ENTITIES`` values; keys
    first, then by name. ``event``: the first other text or flag whose name says so. Durations also get ``start`` and ``end``.
    Settings that no column suits are left out.

    One pass estimates the numbers of values of all candidates; only those near a limit are counted exactly."""
    if keyword not in QUESTIONS:
        raise ValueError(f"no question {keyword!r}; there are {', '.join(QUESTIONS)}")
    kinds, words = dict(df.dtypes), {c: set(name_parts(c)) for c in df.columns}
    dates = [c for c, k in kinds.items() if k.startswith(("timestamp", "date"))]
    numbers = [c for c, k in kinds.items() if (k in NUMBERS or k.startswith("decimal")) and not looks_like_key(c)]
    found = {"date": dates[0]} if dates else {}
    if numbers:
        found["value"] = max(numbers, key=lambda c: len(words[c] & VALUES))  # the first of equals
    entities = _entities(df, [c for c, k in kinds.items() if k == "string" or looks_like_key(c) and (k in NUMBERS or k.startswith("decimal"))])
    if entities:
        found["entity"] = min(entities, key=lambda c: (not looks_like_key(c), c))
    events = [c for c, k in kinds.items() if k in ("string", "boolean") and words[c] & EVENTS and c != found.get("entity")]
    if events:
        found["event"] = events[0]
    if keyword == "duration":
        for name, said in (("start", STARTS), ("end", ENDS)):
            if told := [c for c in dates if words[c] & said]:
                found[name] = told[0]
    return found


def _entities(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    about = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c, 0.02).alias(f"d{k}") for k, c in enumerate(quoted)]).first()
    most = min(MOST_ENTITIES, max(about["n"] // 3, 2))
    # Estimates are off by 2 % (standard error): what isn't within 15 % of a limit is on the side that it seems to be on.
    near = [k for k in range(len(columns)) if about[f"d{k}"] <= 3 or 0.85 * most <= about[f"d{k}"] <= 1.15 * most]
    counted = df.agg(*[F.count_distinct(quoted[k]).alias(f"d{k}") for k in near]).first() if near else {}
    return [c for k, c in enumerate(columns) if 2 <= (counted[f"d{k}"] if k in near else about[f"d{k}"]) <= most]


def suggested_operation(value: str | None, default: str = "sum") -> tuple[str, bool]:
    """How a period's values go together by the column's name, and whether the name told."""
    if value is None:
        return "count", True
    words = set(name_parts(value))
    if words & LEVELS:
        return "mean", True
    if words & PEAKS:
        return "max", True
    if words & EITHER:
        return ("max" if default == "max" else "mean"), True
    return ("sum", True) if words & SUMS else (default, False)


@dataclass
class Prepared:
    """``series``: (by, period, y) without gaps. ``notes``: what was left out or filled, and why."""

    series: DataFrame
    freq: str
    op: str
    by: tuple[str, ...]
    notes: list[str] = field(default_factory=list)


def prepare(df: DataFrame, date: str, value: str | None = None, op: str = "auto", freq: str = "auto", by: Sequence[str] = (), default_op: str = "sum", cut: str | None = None, weekends: str = "fill", tie: str | None = None, most_periods: int | None = None) -> Prepared:
    """One row a period of each series, without gaps, ready for a forecast.

    Rows without a date, after ``cut`` or with a value that is no finite number go (noted). The frequency comes from the
    dates where it isn't given; days without rows at weekends make business days if ``weekends`` is "skip". Sums and counts
    of weeks and months leave out a last period that isn't over; of days and hours, a thin last one is noted. Gaps are filled
    as ``series.fill`` says, and much filling is noted. Series of under ``LEAST_PERIODS`` periods go (noted). ``most_periods``: only the last so many of each.
    One aggregate gives the checks; the table isn't collected.
    """
    notes: list[str] = []
    day = F.col(date)
    rows = df.where(day <= F.lit(cut).cast("timestamp_ntz")) if cut else df
    number = F.col(value).try_cast("double") if value else None
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")) if value else F.lit(True)
    n, dated, usable = rows.agg(F.count(F.lit(1)), F.count(F.when(day.isNotNull(), 1)), F.count(F.when(day.isNotNull() & finite, 1))).first()
    if value and not usable:
        raise ValueError(f"{value} has no numbers")
    if dated < n:
        notes.append(f"{n - dated} rows without a date left out")
    if usable < 0.9 * dated:
        notes.append(f"{dated - usable} values of {value} are no numbers")
    told, known = suggested_operation(value, default_op)
    op = told if op == "auto" or value is None else op
    if not known and op == default_op:
        notes.append(f"{value}: not known what it measures, taken by {op}")
    with_rows = rows.where(day.isNotNull())
    if freq == "auto":
        freq = se.frequency_profile(with_rows, date).first()["freq"]
    if freq == "D" and weekends == "skip" and se.is_business(with_rows, date):
        freq = "B"
    good = with_rows.where(finite)
    good = good.withColumn(value, number) if value else good
    made = se.aggregate(good, date, freq, op, value, tie, by)
    if value:  # periods with rows but without values are unknown, not empty
        seen = with_rows.groupBy(*by, se.bucket(day, freq).alias("period")).agg(F.count(F.lit(1)).alias("_rows"))
        same = [made[k].eqNullSafe(seen[k]) for k in by]
        made = seen.join(made, [*same, seen["period"] == made["period"]], "left").select(*[seen[k] for k in by], seen["period"], made["y"], seen["_rows"].alias("n"))
    if op in ("sum", "count") and freq in ("W", "M"):
        end = F.col("period") + F.expr("interval 7 days" if freq == "W" else "interval 1 month")
        last = good.agg(F.to_date(F.max(date)).alias("_last"))
        cutoff = made.join(F.broadcast(last)).where(F.col("_last") >= end - F.expr("interval 3 days")).drop("_last")
        if made.count() > cutoff.count():
            notes.append("the last period isn't over and was left out")
        made = cutoff
    elif op in ("sum", "count") and not by and se.incomplete_last(good, se.aggregate(good, date, freq, "count"), date, freq).first()["incomplete"]:
        notes.append("the last period has far fewer rows than usual")
    whole = se.fill(made, freq, op, by)
    sizes = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    short, periods = sizes.agg(F.count(F.when(F.col("_n") < se.LEAST_PERIODS, 1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    filled = periods - made.where("y is not null").count()
    if periods and filled > 0.2 * periods:
        notes.append(f"{filled} of {periods} periods had no data and were filled")
    if short:
        notes.append(f"{short} series of under {se.LEAST_PERIODS} periods left out")
        enough = sizes.where(F.col("_n") >= se.LEAST_PERIODS)
        whole = whole.join(F.broadcast(enough) if not by else enough, [F.lit(True)] if not by else [whole[k].eqNullSafe(enough[k]) for k in by], "left_semi")
    if most_periods:
        latest = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("period"))
        whole = whole.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= most_periods).drop("_k")
    return Prepared(whole, freq, op, tuple(by), notes)


def normal_share(z: Column) -> Column:
    """The normal distribution's share below ``z``; Zelen and Severo's polynomial, good to 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _met(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """A join on the keys, null ones included; one row with one row where there are none."""
    if not by:
        return first.join(F.broadcast(second))
    other = second.select(*[F.col(k).alias(f"_of_{k}") for k in by], *[c for c in second.columns if c not in by])
    return first.join(other, [first[k].eqNullSafe(other[f"_of_{k}"]) for k in by]).drop(*[f"_of_{k}" for k in by])


def threshold_crossing(ready: Prepared, limit: float, horizon: int | None = None, level: float = 0.8, direction: str = "auto", projected: DataFrame | None = None) -> DataFrame:
    """(by, current, upwards, passed, streak, expected, earliest, latest, p_most, p_last, urgency) of each series.

    ``expected``, ``earliest`` and ``latest``: the first step at which the forecast, and the two ends of its interval, are beyond
    the limit (null: not within the horizon). Upwards by ``direction`` ("up", "down"), or where the last value is below the
    limit. ``passed``: the last value is beyond already, for ``streak`` periods. ``p_most`` and ``p_last``: the greatest and the last
    step's normal probability. ``urgency``: alert if passed or from 0.5, watch from 0.2, else info."""
    by = list(ready.by)
    ahead = projected if projected is not None else se.project(ready.series, ready.freq, by, horizon or se.LIMIT_HORIZON[ready.freq], level)
    now = ready.series.groupBy(*by).agg(F.max_by("y", "period").alias("current"))
    upwards = {"up": F.lit(True), "down": F.lit(False)}.get(direction, F.col("current") < limit)
    now = now.withColumn("upwards", upwards)
    beyond = lambda y: F.when(F.col("upwards"), y >= limit).otherwise(y <= limit)
    known = _met(ready.series, now, by)
    last_within = known.groupBy(*by, "current", "upwards").agg(F.max(F.when(~beyond(F.col("y")), F.col("period"))).alias("_within"))
    streak = _met(ready.series, last_within, by).groupBy(*by, "current", "upwards").agg(F.count(F.when(F.col("_within").isNull() | (F.col("period") > F.col("_within")), 1)).alias("streak"))
    steps = _met(ahead, streak, by)
    below = normal_share((limit - F.col("forecast")) / F.greatest("sigma", F.lit(1e-12)))
    steps = steps.withColumn("p", F.when(F.col("upwards"), 1 - below).otherwise(below))
    first = lambda c: F.min(F.when(beyond(c), F.col("step")))
    soon, late = F.when(F.col("upwards"), F.col("high")).otherwise(F.col("low")), F.when(F.col("upwards"), F.col("low")).otherwise(F.col("high"))
    out = steps.groupBy(*by, "current", "upwards", "streak").agg(first(F.col("forecast")).alias("expected"), first(soon).alias("earliest"), first(late).alias("latest"), F.max("p").alias("p_most"), F.max_by("p", "step").alias("p_last"))
    out = out.withColumn("passed", F.col("streak") > 0)
    urgency = F.when(F.col("passed") | (F.col("p_most") >= 0.5), "alert").when(F.col("p_most") >= 0.2, "watch").otherwise("info")
    return out.select(*by, "current", "upwards", "passed", "streak", "expected", "earliest", "latest", "p_most", "p_last", urgency.alias("urgency"))


def saturation(ready: Prepared, capacity: float, horizon: int | None = None, level: float = 0.8, projected: DataFrame | None = None) -> DataFrame:
    """(by, use, history_share, likely, possible, p_most, step_most, urgency): the last value over the capacity, the share of periods
    at or over it, the first steps with a probability of 0.5 and of 0.2, and the greatest probability with its step."""
    by = list(ready.by)
    ahead = projected if projected is not None else se.project(ready.series, ready.freq, by, horizon or se.LIMIT_HORIZON[ready.freq], level)
    past = ready.series.groupBy(*by).agg((F.max_by("y", "period") / capacity).alias("use"), F.avg((F.col("y") >= capacity).cast("double")).alias("history_share"))
    p = 1 - normal_share((capacity - F.col("forecast")) / F.greatest("sigma", F.lit(1e-12)))
    steps = ahead.withColumn("p", p).groupBy(*by).agg(
        F.min(F.when(F.col("p") >= 0.5, F.col("step"))).alias("likely"), F.min(F.when(F.col("p") >= 0.2, F.col("step"))).alias("possible"), F.max("p").alias("p_most"), F.max_by("step", F.struct(F.col("p"), -F.col("step"))).alias("step_most")
    )
    urgency = F.when((F.col("use") >= 1) | F.col("likely").isNotNull(), "alert").when(F.col("possible").isNotNull(), "watch").otherwise("info")
    return _met(past, steps, by).select(*by, "use", "history_share", "likely", "possible", "p_most", "step_most", urgency.alias("urgency"))


#: Series of fewer periods say nothing of a driver; a season counts from this strength and three cycles on.
SCENARIO_PERIODS, CLEAR_SEASON = 20, 0.15


def scenario(ready: Prepared, df: DataFrame, date: str, driver: str, change: float = 0.1, driver_op: str = "mean", lag: int = 0) -> DataFrame:
    """(by, periods, logs, seasonal, slope, effect, low, high, share, distinct, extrapolated): what a change of the driver by the share
    ``change`` went with in the value, with its 95 % interval; an association, not a cause.

    Least squares on the driver, a trend and, where the season is clear, the places of the cycle; of logarithms where both are
    positive throughout. The other terms are taken out of value and driver first (the slope between what is left is that of
    the whole regression), all by aggregates. The slope's error allows for residuals that persist: their products over so many
    periods as the fourth root of the number suggests, with falling weights. ``lag``: so many periods from the driver to its effect.
    ``share``: what the driver alone explains. Series of under 20 periods, and those whose driver never moves, give no row."""
    if change <= -1:
        raise ValueError("a change of -100 % or below says nothing")
    by, freq = list(ready.by), ready.freq
    m = se.CYCLE[freq]
    number = F.col(driver).try_cast("double")
    rows = df.where(F.col(date).isNotNull() & number.isNotNull() & ~F.isnan(number)).withColumn("_driver", number)
    moved = se.aggregate(rows, date, freq, driver_op, "_driver", by=by).select(F.struct(*(by or [F.lit("").alias("_all")])).alias("_s"), "period", F.col("y").alias("x"))
    own = ready.series.select(F.struct(*(by or [F.lit("").alias("_all")])).alias("_s"), "period", "y")
    order = Window.partitionBy("_s").orderBy("period")  # a row a period
    both = own.join(moved, ["_s", "period"], "left").withColumn("i", F.row_number().over(order) - 1)
    # A period without a driver lies on the line between its neighbours; at the ends, it has the nearest one's.
    some = F.when(F.col("x").isNotNull(), F.struct("i", "x"))
    before, after = F.last(some, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(some, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_a", before).withColumn("_b", after)
    between = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col("i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    both = both.withColumn("x", F.coalesce("x", F.when(F.col("_b.i") > F.col("_a.i"), between), "_a.x", "_b.x")).where("x is not null and y is not null")
    if lag:
        both = both.withColumn("x", F.lag("x", lag).over(order)).where("x is not null")
    both = both.withColumn("i", F.row_number().over(order) - 1)
    strength = se.seasonal_strength(both.select("_s", "period", "y"), m, ["_s"]).select("_s", "strength")
    of = both.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), ((F.min("y") > 0) & (F.min("x") > 0)).alias("logs"), F.min("x").alias("x_least"), F.max("x").alias("x_most"), F.stddev_pop("x").alias("_spread"))
    of = of.join(strength, "_s").where((F.col("n") >= SCENARIO_PERIODS) & (F.col("_spread") > 0))
    of = of.withColumn("seasonal", (F.col("n") >= max(3 * m, se.SEASON_FROM[freq])) & (F.col("strength") >= CLEAR_SEASON))
    rows = both.join(of, "_s")
    log = lambda c: F.when(F.col("logs"), F.ln(c)).otherwise(F.col(c))
    rows = rows.select("_s", "i", "n", "seasonal", "logs", F.when(F.col("seasonal"), F.col("i") % m).otherwise(0).alias("place"), log("y").alias("v"), log("x").alias("u"), F.col("i").cast("double").alias("t"), "x", "y")
    place = Window.partitionBy("_s", "place")
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(place) for c in ("v", "u", "t")} | {"_v": F.col("v")})
    line = rows.groupBy("_s").agg(*[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("t")), F.sum(F.col("t") * F.col("t"))), F.lit(0.0)).alias(f"_{c}t") for c in ("v", "u")], F.var_pop("_v").alias("_all"))
    rows = rows.join(line, "_s").withColumn("v", F.col("v") - F.col("_vt") * F.col("t")).withColumn("u", F.col("u") - F.col("_ut") * F.col("t"))
    fit = rows.groupBy("_s", "n", "_all").agg(F.sum(F.col("u") * F.col("u")).alias("_uu"), F.sum(F.col("u") * F.col("v")).alias("_uv")).where("_uu > 1e-18")
    fit = written(fit.withColumn("slope", F.col("_uv") / F.col("_uu")).withColumn("reach", F.ceil(1.5 * F.pow("n", F.lit(0.25))).cast("int")), "scenario-fit")
    scored = rows.select("_s", "i", "u", "v").join(fit.select("_s", "slope", "reach"), "_s").select("_s", "i", "reach", (F.col("u") * (F.col("v") - F.col("slope") * F.col("u"))).alias("g"))
    apart = scored.select("_s", "g", F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("_l"), "reach", "i").withColumn("j", F.col("i") + F.col("_l"))
    products = apart.join(scored.select("_s", F.col("i").alias("j"), F.col("g").alias("_g")), ["_s", "j"])
    weight = F.when(F.col("_l") == 0, 1.0).otherwise(2 * (1 - F.col("_l") / (F.col("reach") + 1)))
    spread = products.groupBy("_s").agg(F.sum(weight * F.col("g") * F.col("_g")).alias("_gg"))
    recent = max(m, 4)
    now = rows.groupBy("_s", "logs", "seasonal").agg(*[F.avg(F.when(F.col("i") >= F.col("n") - recent, F.col(c))).alias(f"{c}_now") for c in ("x", "y")])
    terms = F.when(F.col("seasonal"), m + 2).otherwise(3)
    out = fit.join(spread, "_s").join(now, "_s").join(of.select("_s", "x_least", "x_most"), "_s")
    error = F.sqrt(F.greatest("_gg", F.lit(0.0)) * F.col("n") / F.greatest(F.col("n") - terms, F.lit(1))) / F.col("_uu")
    effect = lambda b: F.when(F.col("logs"), F.pow(F.lit(1.0 + change), b) - 1).otherwise(F.try_divide(b * F.col("x_now") * change, F.col("y_now")))
    ends = effect(F.col("slope") - 1.96 * F.col("error")), effect(F.col("slope") + 1.96 * F.col("error"))
    out = out.withColumn("error", error).withColumn("low", F.least(*ends)).withColumn("high", F.greatest(*ends))
    next_x = F.col("x_now") * (1 + change)
    share = F.least(F.greatest(F.try_divide(F.col("slope") * F.col("_uv"), F.col("_all") * F.col("n")), F.lit(0.0)), F.lit(1.0))
    return out.select(*[F.col(f"_s.`{c}`").alias(c) for c in by], F.col("n").cast("int").alias("periods"), "logs", "seasonal", "slope", effect(F.col("slope")).alias("effect"), "low", "high", share.alias("share"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("distinct"), ((next_x < F.col("x_least")) | (next_x > F.col("x_most"))).alias("extrapolated"))


def forecast_table(ready: Prepared, projected: DataFrame) -> DataFrame:
    """(by, period, forecast, low, high, method): the projection with the dates of its periods, ready to be written or drawn."""
    by = list(ready.by)
    last = ready.series.groupBy(*by).agg(F.max("period").alias("_last"))
    both = _met(projected, last, by)
    if ready.freq == "B":  # five business days a week, counted from the last one
        at = F.weekday("_last") + F.col("step")
        period = F.date_add(F.date_sub(F.to_date("_last"), F.weekday("_last")), (F.floor(at / 5) * 7 + at % 5).cast("int"))
    else:
        period = F.expr({"H": "timestampadd(HOUR, step, _last)", "D": "date_add(to_date(_last), step)", "W": "date_add(to_date(_last), 7 * step)", "M": "add_months(to_date(_last), step)"}[ready.freq])
    return both.select(*by, period.alias("period"), "forecast", "low", "high", "method")


@dataclass(frozen=True)
class Question:
    """A keyword's form: which settings it must have, and what answers it."""

    needs: tuple[str, ...]
    answer: Callable


def _ready(df: DataFrame, c: dict, default_op: str = "sum") -> Prepared:
    keys = ("op", "freq", "by", "cut", "weekends", "tie", "most_periods")
    return prepare(df, c["date"], c.get("value"), default_op=default_op, **{k: c[k] for k in keys if k in c})


def _projection(df: DataFrame, c: dict) -> DataFrame:
    ready = _ready(df, c)
    return forecast_table(ready, se.project(ready.series, ready.freq, ready.by, c.get("horizon"), c.get("level", 0.8)))


def _lifetimes(name: str):
    def answer(df: DataFrame, c: dict) -> DataFrame:
        from tidemark.operators import lifetimes

        return getattr(lifetimes, name)(df, c)

    return answer


QUESTIONS: dict[str, Question] = {
    "projection": Question(("date",), _projection),
    "trend": Question(("date",), lambda df, c: se.trend((ready := _ready(df, c)).series, ready.by)),
    "seasonality": Question(("date",), lambda df, c: se.seasonality((ready := _ready(df, c)).series, ready.freq, ready.by)),
    "threshold": Question(("date", "limit"), lambda df, c: threshold_crossing(_ready(df, c), c["limit"], c.get("horizon"), c.get("level", 0.8), c.get("direction", "auto"))),
    "saturation": Question(("date", "capacity"), lambda df, c: saturation(_ready(df, c, "max"), c["capacity"], c.get("horizon"), c.get("level", 0.8))),
    "scenario": Question(("date", "driver"), lambda df, c: scenario(_ready(df, c), df, c["date"], c["driver"], c.get("change", 0.1), c.get("driver_op", "mean"), c.get("lag", 0))),
    "depletion": Question(("entity", "date", "consumed", "stock", "tie"), _lifetimes("ask_depletion")),
    "useful_life": Question(("entity", "date", "event"), _lifetimes("ask_useful_life")),
    "failure": Question(("entity", "date", "event"), _lifetimes("ask_failure")),
    "duration": Question(("start", "end", "cut"), _lifetimes("ask_duration")),
    "priority": Question(("entity", "risk", "cost"), _lifetimes("ask_priority")),
    "classification": Question(("row", "target", "columns"), _lifetimes("ask_classification")),
}


def missing_settings(keyword: str, settings: dict) -> list[str]:
    return [k for k in QUESTIONS[keyword].needs if settings.get(k) in (None, "", ())]


def ask(keyword: str, df: DataFrame, **settings) -> DataFrame:
    """The answer to a keyword's question as a DataFrame. Unknown keywords, missing settings and columns that aren't there are
    ValueErrors that name them."""
    if keyword not in QUESTIONS:
        raise ValueError(f"no question {keyword!r}; there are {', '.join(QUESTIONS)}")
    if missing := missing_settings(keyword, settings):
        raise ValueError(f"{keyword} also needs {', '.join(missing)}")
    for k in ("date", "value", "driver", "entity", "start", "end", "risk", "cost", "stock", "consumed", "target"):
        if isinstance(name := settings.get(k), str) and name not in df.columns:
            raise ValueError(f"no column {name!r}")
    return QUESTIONS[keyword].answer(df, settings)
