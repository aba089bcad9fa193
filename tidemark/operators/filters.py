"""Row filters: conditions compared as text or number, trailing windows, cut-off dates, pickers and event masks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import as_number, is_blank, key_text, to_text

EMPTY_LABEL = "(vacíos)"
# Texts of an event column that mean that nothing happened.
NOT_AN_EVENT = ("", "0", "0.0", "no", "false", "falso", "n", "nan", "none", "ninguno", "ninguna", "normal", "ok")


@dataclass(frozen=True)
class Condition:
    """``op``: in, not_in, >, >=, <, <=, blank or not_blank."""

    column: str
    op: str
    values: tuple = ()

    def mask(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.op in ("in", "not_in"):
            inside = to_text(c).isin([str(v) for v in self.values])
            return inside if self.op == "in" else ~inside  # a missing cell is the text nan, so not_in keeps it
        if self.op in ("blank", "not_blank"):
            return is_blank(c) if self.op == "blank" else ~is_blank(c)
        try:
            bound = float(str(self.values[0]).replace(",", "."))
        except ValueError:
            return F.lit(False)
        x = as_number(c)
        test = {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}[self.op]
        return F.coalesce(test, F.lit(False))


def apply_conditions(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that meet all conditions; a condition on a column that isn't there lets none through."""
    if not conditions:
        return df
    if any(c.column not in df.columns for c in conditions):
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a & b, [c.mask() for c in conditions]))


def trailing_window(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows later than ``days`` days before the latest date among these rows; rows without a date go."""
    latest = df.agg((F.max(date) - F.make_dt_interval(F.lit(days))).alias("_after"))
    return df.join(F.broadcast(latest), F.col(date) > F.col("_after")).drop("_after")  # one row


def pick_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose cell, as text, is among the values; ``(vacíos)`` stands for missing cells."""
    values = list(values)
    mask = F.col(column).cast("string").isin([v for v in values if v != EMPTY_LABEL])
    mask = F.coalesce(mask, F.lit(False))
    return df.where(mask | F.col(column).isNull() if EMPTY_LABEL in values else mask)


def time_range(df: DataFrame, column: str, first, last) -> DataFrame:
    """Closed range; bounds are timestamps or texts of them."""
    return df.where(F.col(column).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def cut_off(df: DataFrame, column: str, last_day: str) -> DataFrame:
    """Rows up to the end of a day."""
    return df.where(F.col(column) < F.lit(last_day).cast("date").cast("timestamp_ntz") + F.expr("interval 1 day"))


def pick_entity(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(key_text(F.col(column)) == key_text(F.lit(value)))


def pick_rows(df: DataFrame, row: str, numbers: Iterable[int]) -> DataFrame:
    """Rows with these numbers from 1, where ``row`` counts from 0."""
    return df.where(F.col(row).isin([n - 1 for n in numbers]))


def anomalous_rows(df: DataFrame, anomaly_rows: DataFrame, row: str, kind: str | None = None) -> DataFrame:
    """Rows that some anomaly (of one kind) names; ``anomaly_rows`` has the columns kind and ``row``."""
    named = anomaly_rows if kind is None else anomaly_rows.where(F.col("kind") == kind)
    return df.join(named.select(row), row, "left_semi")


def event_mask(df: DataFrame, column: str | None, value: str | None = None) -> Column:
    """Which rows are events: all without a column; equal to the value; a flag as it is; non-zero where over 80 % of the cells
    are numbers; else texts other than the ones that deny."""
    if column is None:
        return F.lit(True)
    c = F.col(column)
    if value is not None:
        return F.coalesce(F.lower(key_text(c)) == str(value).strip().lower(), F.lit(False))
    if dict(df.dtypes)[column] == "boolean":
        return F.coalesce(c, F.lit(False))
    share = df.agg(F.try_divide(F.count(as_number(c)), F.count(c)).alias("s")).first()["s"] or 0
    if share > 0.8:
        return F.coalesce(as_number(c) != 0, F.lit(False))
    return ~F.lower(F.trim(to_text(c))).isin(list(NOT_AN_EVENT))


@dataclass(frozen=True)
class BaseFilter:
    """All that narrows the table before anything is computed of it. Picked rows count alone; else columns' conditions, a click
    on a chart's category, an anomaly's rows and an entity hold together; then the range of times and the cut-off day."""

    conditions: tuple[Condition, ...] = ()
    chart: tuple[str, tuple[str, ...]] | None = None
    rows: tuple[int, ...] = ()
    anomaly: tuple[DataFrame, str | None] | None = None
    entity: tuple[str, object] | None = None
    times: tuple[str, object, object] | None = None
    last_day: tuple[str, str] | None = None

    def apply(self, df: DataFrame, row: str) -> DataFrame:
        """One chain of filters, which Spark joins to one and pushes to the scan."""
        if self.rows:
            out = pick_rows(df, row, self.rows)
        else:
            out = apply_conditions(df, self.conditions)
            out = pick_values(out, *self.chart) if self.chart else out
            out = anomalous_rows(out, self.anomaly[0], row, self.anomaly[1]) if self.anomaly else out
            out = pick_entity(out, *self.entity) if self.entity else out
        out = time_range(out, *self.times) if self.times else out
        return cut_off(out, *self.last_day) if self.last_day else out
