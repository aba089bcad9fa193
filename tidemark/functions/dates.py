"""Dates: parsing with order detection, calendar features, periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def minutes_since_midnight(c: Column) -> Column:
    return F.hour(c) * 60 + F.minute(c) + F.second(c) / 60.0


def calendar_features(c: Column) -> dict[str, Column]:
    """Year, month, day, weekday (Monday 0), day of the year, days since 1970, hour."""
    return {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "weekday": F.weekday(c), "day_of_year": F.dayofyear(c),
        "days_since_epoch": F.floor(micros(c) / 86_400_000_000), "hour": F.hour(c),
    }


@dataclass(frozen=True)
class DateOrder:
    order: str  # iso, dmy or mdy
    sure: bool


def detect_order(df: DataFrame, column: str) -> DateOrder:
    """ISO if at least half of the texts begin with a year; else a first part over 12 tells day first, a second part over
    12 month first; if neither occurs, day first but unsure. One aggregation over the column."""
    t = F.col(column)
    first = F.regexp_extract(t, r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}", 1).try_cast("int")
    second = F.regexp_extract(t, r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}", 2).try_cast("int")
    got = df.agg(F.avg(t.rlike(r"^\s*\d{4}").cast("double")).alias("iso"), F.max(first).alias("a"), F.max(second).alias("b")).first()
    if (got["iso"] or 0) >= 0.5:
        return DateOrder("iso", True)
    if (got["a"] or 0) > 12:
        return DateOrder("dmy", True)
    if (got["b"] or 0) > 12:
        return DateOrder("mdy", True)
    return DateOrder("dmy", False)


#: Patterns tried in turn, those of the detected order first.
PATTERNS = {
    "iso": ["yyyy-M-d", "yyyy/M/d", "yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss"],
    "dmy": ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy H:mm:ss"],
    "mdy": ["M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yyyy H:mm:ss"],
}


def parse_dates(c: Column, order: str) -> Column:
    """Timestamp of a text whose formats may be mixed; null where none fits."""
    patterns = PATTERNS[order] + PATTERNS["dmy" if order == "iso" else "iso"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in patterns])


def bucket(c: Column, freq: str) -> Column:
    """Start of the hour, day (also business day), Monday's week or month, without time zone."""
    return F.date_trunc({"H": "HOUR", "D": "DAY", "B": "DAY", "W": "WEEK", "M": "MONTH"}[freq], c).cast("timestamp_ntz")


def sunday_label(c: Column) -> Column:
    """Weeks that end on Sunday, named by it."""
    return F.next_day(F.date_sub(c, 1), "SU")
