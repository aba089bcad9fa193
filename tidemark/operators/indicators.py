"""Indicators, descriptive metrics, frequencies and the aggregations behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import micros
from tidemark.functions.formula import calculated_value, columns_of
from tidemark.functions.text import as_number, to_text
from tidemark.operators.filters import Condition, apply_conditions, trailing_window
from tidemark.operators.ordered import most_frequent, quantiles

NO_DATA, OTHERS = "(sin dato)", "Otros"


def reduce_column(op: str, c: Column, other: Column | None = None) -> Column:
    """One value of a column; the sum of nothing is 0, other reductions of nothing are null."""
    x = as_number(c)
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "mean": lambda: F.avg(x), "median": lambda: F.median(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(c), "distinct": lambda: F.count_distinct(c), "ratio": lambda: F.try_divide(F.sum(x), F.sum(as_number(other))),
    }[op]()


@dataclass(frozen=True)
class Indicator:
    name: str
    op: str  # sum, mean, median, min, max, count, distinct, ratio or formula
    column: str | None = None
    other: str | None = None
    formula: str | None = None
    conditions: tuple[Condition, ...] = ()
    date: str | None = None
    days: int | None = None

    def columns(self) -> list[str]:
        own = columns_of(self.formula) if self.formula else [self.column, self.other]
        return [c for c in dict.fromkeys([*own, *[x.column for x in self.conditions], self.date if self.days else None]) if c]


def compute(df: DataFrame, indicators: Sequence[Indicator]) -> DataFrame:
    """(name, value): all indicators. Those over the same filtered rows are one aggregation, and their medians are selected, so that no
    task holds a column (``ordered.quantiles``); no rows give a null value."""
    groups: dict[tuple, list[Indicator]] = {}
    for k in indicators:
        groups.setdefault((k.conditions, k.date, k.days), []).append(k)
    parts = []
    for (conditions, date, days), some in groups.items():
        rows = apply_conditions(df, conditions)
        rows = trailing_window(rows, date, days) if date and days else rows
        plain = [k for k in some if k.op not in ("formula", "median")]
        middles = [k for k in some if k.op == "median"]
        if plain:
            any_row = F.count(F.lit(1)) > 0
            made = [F.struct(F.lit(k.name).alias("name"), F.when(any_row, reduce_column(k.op, F.col(k.column), F.col(k.other) if k.other else None).cast("double")).alias("value")) for k in plain]
            parts.append(rows.agg(F.array(*made).alias("all")).select(F.inline("all")))
        if middles:
            columns = {f"{i}": as_number(F.col(k.column)) for i, k in enumerate(middles)}
            found = [F.struct(F.lit(k.name).alias("name"), F.max(F.when(F.col("column") == f"{i}", F.col("q")[0])).alias("value")) for i, k in enumerate(middles)]
            parts.append(quantiles(rows, columns, [0.5]).agg(F.array(*found).alias("all")).select(F.inline("all")))
        parts += [calculated_value(rows, k.formula).select(F.lit(k.name).alias("name"), F.col("value").cast("double").alias("value")) for k in some if k.op == "formula"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def halves_change(df: DataFrame, value: str, date: str, op: str = "sum") -> DataFrame:
    """first, second, change in %: an indicator in the two halves of the time span."""
    t = micros(F.col(date))
    span = df.agg(((F.min(t) + F.max(t)) / 2).alias("_mid"))
    rows = df.join(F.broadcast(span))  # one row
    early = micros(F.col(date)) <= F.col("_mid")
    out = rows.agg(reduce_column(op, F.when(early, F.col(value))).alias("first"), reduce_column(op, F.when(~early, F.col(value))).alias("second"))
    return out.withColumn("change", F.try_divide(F.col("second") - F.col("first"), F.abs("first")) * 100)


def sparkline(df: DataFrame, value: str, date: str, op: str = "sum", slices: int = 12) -> DataFrame:
    """(slice, value) over equal slices of the time span."""
    t = micros(F.col(date))
    span = df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((t - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slices), F.lit(slices - 1))).otherwise(0)
    return df.join(F.broadcast(span)).where(F.col(date).isNotNull()).groupBy(at.cast("int").alias("slice")).agg(reduce_column(op, F.col(value)).alias("value"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """mean, median, mode (the least of equals), std, n."""
    x = as_number(F.col(column))
    one = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("n"))
    middle = quantiles(df, {"x": x}, [0.5]).agg(F.max(F.col("q")[0]).alias("median"))
    return one.join(F.broadcast(middle)).join(F.broadcast(most_frequent(df, x))).select("mean", "median", "mode", "std", "n")


def box_plot(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles by linear interpolation, Tukey's fences, whiskers at the last values within them, and outliers' number."""
    x = F.col(column)
    q = quantiles(df, {"x": x}, [0.25, 0.5, 0.75], by).select(*by, *[F.col("q")[k].alias(name) for k, name in enumerate(("q1", "median", "q3"))])
    q = q.withColumn("low_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("high_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    rows = df.select(*by, x.alias("_x")).join(F.broadcast(q) if not by else q, list(by) if by else None)
    inside = F.col("_x").between(F.col("low_fence"), F.col("high_fence"))
    keys = [*by, "q1", "median", "q3", "low_fence", "high_fence"]
    return rows.groupBy(*keys).agg(F.min(F.when(inside, F.col("_x"))).alias("low_whisker"), F.max(F.when(inside, F.col("_x"))).alias("high_whisker"), F.count(F.when(~inside, 1)).alias("outliers"))


def frequencies(df: DataFrame, columns: Sequence[str], limit: int = 500) -> DataFrame:
    """(column, value, n, percent, place): values as text, missing ones as ``(vacíos)``, the ``limit`` most frequent of each column."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(vacíos)")).alias("value")) for c in columns])).alias("cell")).select("cell.*")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy("column").agg(F.sum("n").alias("_rows"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    out = counts.withColumn("place", place).where(F.col("place") <= limit).join(F.broadcast(rows), "column")  # a row a column
    return out.select("column", "value", "n", (F.col("n") * 100.0 / F.col("_rows")).alias("percent"), "place")


def by_category(df: DataFrame, category: str, op: str = "count", value: str | None = None) -> DataFrame:
    """(category, value): missing categories are ``(sin dato)``; categories whose value is missing go."""
    made = F.count(F.lit(1)).cast("double") if op == "count" else reduce_column(op, F.col(value)).cast("double")
    return df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit(NO_DATA)).alias("category")).agg(made.alias("value")).where("value is not null")


def top_with_others(groups: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of (category, value) and the sum of the rest as ``Otros``, with how many it holds. The largest are
    taken by a partial top n in each task, and only they are put in order in one."""
    top = groups.orderBy(F.desc("value"), "category").limit(n)
    ranked = top.select("category", F.row_number().over(Window.orderBy(F.desc("value"), "category")).alias("place"), "value", F.lit(1).cast("long").alias("n_categories"))
    names = top.select(F.col("category").alias("_top"))
    rest = groups.join(F.broadcast(names), F.col("category").eqNullSafe(F.col("_top")), "left_anti").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_categories"))  # n rows
    return ranked.unionByName(rest.where("n_categories > 0").select(F.lit(OTHERS).alias("category"), F.lit(n + 1).alias("place"), "value", "n_categories"))


def by_period(df: DataFrame, date: str, unit: str, op: str = "count", value: str | None = None) -> DataFrame:
    """(period, value) with a row for each period of the span, also the empty ones: 0 for counts and sums, else null.

    ``unit``: minute, hour, day, week (named by its Sunday) or month."""
    t = F.col(date)
    name = F.next_day(F.date_sub(t.cast("date"), 1), "SU").cast("timestamp_ntz") if unit == "week" else F.date_trunc(unit, t).cast("timestamp_ntz")
    made = F.count(F.lit(1)).cast("double") if op == "count" else reduce_column(op, F.col(value)).cast("double")
    groups = df.where(t.isNotNull()).groupBy(name.alias("period")).agg(made.alias("value"))
    span = groups.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("period"))
    filled = grid.join(groups, "period", "left")
    return filled.withColumn("value", F.coalesce("value", F.lit(0.0))) if op in ("count", "sum") else filled


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths between least and greatest value, the last bin closed, empty bins too; a constant gets a
    width of 1 around it."""
    x = as_number(F.col(column))
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).where("_lo is not null")
    span = span.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).join(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select("_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, x: str, y: str, bins: int = 120) -> DataFrame:
    """(bin_x, bin_y, n) over the cells that have rows."""
    span = df.agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), F.least(F.floor((F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(span)).groupBy(at(x).alias("bin_x"), at(y).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def time_histogram(df: DataFrame, date: str, width_seconds: int) -> DataFrame:
    """(bin, n) in bins of fixed width from the start of the first day (of the first hour for widths under a day)."""
    t = micros(F.col(date))
    unit = 86_400_000_000 if width_seconds >= 86_400 else 3_600_000_000
    origin = df.agg((F.floor(F.min(t) / unit) * unit).alias("_o"))
    return df.where(F.col(date).isNotNull()).join(F.broadcast(origin)).groupBy(F.floor((t - F.col("_o")) / (width_seconds * 1_000_000)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns that aren't constant, over rows that have both; one aggregation."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    x = {c: as_number(F.col(c)) for c in columns}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(x[a], x[b]).alias("r")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("all")).select(F.inline("all")).where(F.col("r").isNotNull() & ~F.isnan("r"))


def duration_summary(df: DataFrame, start: str, end: str) -> DataFrame:
    """n, mean, least and greatest days between two dates, and how many are negative; negatives count."""
    d = (micros(F.col(end)) - micros(F.col(start))) / 86_400_000_000.0
    return df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_days"), F.min(d).alias("min_days"), F.max(d).alias("max_days"), F.count(F.when(d < 0, 1)).alias("negative"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, percent) from one pass."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing")) for c in columns]
    out = df.agg(F.array(*cells).alias("all"), F.count(F.lit(1)).alias("_n")).select(F.inline("all"), "_n")
    return out.select("column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("_n")).alias("percent"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """duplicates: rows beyond the first of each group of rows equal in all columns."""
    return df.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("duplicates"))


def peak(series: DataFrame) -> DataFrame:
    """(period, value, is_peak): the greatest of five points or more, a peak if over 1.6 times their positive median."""
    out = series.agg(F.max_by("period", "value").alias("period"), F.max("value").alias("value"), F.median("value").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return out.select("period", "value", ((F.col("_n") >= 5) & (F.col("_m") > 0) & (F.col("value") > 1.6 * F.col("_m"))).alias("is_peak"))


@dataclass(frozen=True)
class Chart:
    kind: str  # bar, line, histogram or donut
    x: str
    y: str | None = None
    op: str = "count"
    top: int = 15
    unit: str = "day"
    conditions: tuple[Condition, ...] = field(default=())


def chart_data(df: DataFrame, chart: Chart) -> DataFrame:
    """(mode, label, value): the rows behind a chart; mode is date, categories, histogram or donut."""
    rows = apply_conditions(df, chart.conditions)
    if chart.kind == "histogram":
        out = histogram(rows, chart.x).select(F.lit("histogram").alias("mode"), F.round("low", 6).cast("string").alias("label"), F.col("n").cast("double").alias("value"))
    elif dict(df.dtypes)[chart.x] in ("timestamp_ntz", "timestamp", "date"):
        out = by_period(rows, chart.x, chart.unit, chart.op, chart.y).select(F.lit("date").alias("mode"), F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("label"), "value")
    else:
        n = 8 if chart.kind == "donut" else chart.top
        out = top_with_others(by_category(rows, chart.x, chart.op, chart.y), n).select(F.lit("donut" if chart.kind == "donut" else "categories").alias("mode"), F.col("category").alias("label"), "value")
    return out


def fields_in_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns together, as text."""
    return df.select(F.explode(F.array(*[to_text(F.col(c)) for c in columns])).alias("value")).where("value <> 'nan'").agg(F.count_distinct("value").alias("distinct_values"))


def report_blocks(df: DataFrame, blocks: Sequence[tuple[str, str, str, str | None]], combined: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """(name, value) of a report's calculations, in one aggregate. ``blocks``: (name, operation, column, other): a reduction of a
    column, or difference, product or ratio of two columns' sums. ``combined``: (name, one, sign, two): + - * / of two named
    ones; over nothing is null."""
    sums = lambda c: F.sum(as_number(F.col(c)))
    two = {"difference": lambda a, b: sums(a) - sums(b), "product": lambda a, b: sums(a) * sums(b), "ratio": lambda a, b: F.try_divide(sums(a), sums(b))}
    made = {name: (two[op](a, b) if op in two else reduce_column(op, F.col(a))).cast("double") for name, op, a, b in blocks}
    signs = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}
    for name, one, sign, other in combined:
        made[name] = signs[sign](made[one], made[other])
    return df.agg(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in made.items()]).alias("all")).select(F.inline("all"))


def by_date_text(df: DataFrame, column: str, order: str = "dmy") -> DataFrame:
    """(label, n, date): how often each text of a date column occurs, with the date it stands for to sort by; texts without one come last."""
    from tidemark.functions.dates import parse_dates

    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("date", parse_dates(F.col("label"), order)).orderBy(F.col("date").asc_nulls_last(), "label")
