"""Order-dependent sums and ranks over whole tables, without passing the table through one task.

A window without partitions sends every row to a single task. Here rows fall into ranges of their sort key and what breaks
its ties, with borders from a sample; sums run within a range, and each range starts from the total of the ranges before it. The
table of range totals has one row a range, so it is safe to broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import written

#: Ranges: one for so many rows, from the least number to the greatest, and the rows that their borders are drawn from.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES, SAMPLE_ROWS = 1_000_000, 16, 4_096, 16_384
#: Up to so many borders are searched by halves in generated code; more go in two levels.
BORDERS_BY_HALVES = 128


def range_borders(df: DataFrame, keys: Sequence[str], ranges: int | None = None, least: int = LEAST_RANGES) -> list[tuple]:
    """Rows of ``keys`` that part the table, in their order, into about equal ranges; nulls come first. They come from a chance
    sample of ``SAMPLE_ROWS`` rows at most, which changes no result. Keys that many rows share are parted by the further ones."""
    return _borders_and_rows(df, keys, ranges, least)[0]


def _borders_and_rows(df: DataFrame, keys: Sequence[str], ranges: int | None = None, least: int = LEAST_RANGES) -> tuple[list[tuple], int]:
    """See ``range_borders``; and about how many rows there are, which sets the number of ranges and is told by the sample too: of
    n chances, the k-th least is about k / n."""
    drawn = df.select(*[F.col(k) for k in keys], F.rand(7).alias("_h")).orderBy("_h").limit(SAMPLE_ROWS).collect()
    n = len(drawn) if len(drawn) < SAMPLE_ROWS else int(len(drawn) / max(drawn[-1]["_h"], 1e-12))
    ranges = ranges or min(MOST_RANGES, max(least, n // ROWS_A_RANGE))
    rows = sorted((tuple(r)[:-1] for r in drawn), key=lambda row: tuple((v is not None, v != v, v if v is not None and v == v else 0) for v in row))
    return (list(dict.fromkeys(rows[k * len(rows) // ranges] for k in range(1, ranges))) if rows else []), n


def key_range(df: DataFrame, keys: Sequence[str], ranges: int | None = None, borders: list[tuple] | None = None) -> Column:
    """Number of the range that a row falls into, in order of ``keys``. A row is compared with few borders: by halves, or in two
    levels of about the root of their number."""
    borders = range_borders(df, keys, ranges) if borders is None else borders
    if not borders:
        return F.lit(0)
    kinds = dict(df.dtypes)
    mine = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    kind = f"struct<{','.join(f'k{i}:{kinds[k]}' for i, k in enumerate(keys))}>"
    border = lambda row: F.struct(*[F.lit(v).cast(kinds[k]).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, row, strict=True))]).cast(kind)
    if len(borders) <= BORDERS_BY_HALVES:

        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(border(borders[middle]) <= mine, among(middle + 1, high)).otherwise(among(low, middle))

        return among(0, len(borders))
    step = max(1, math.isqrt(len(borders)))
    groups = [borders[k : k + step] for k in range(0, len(borders), step)]
    passed = lambda array: F.size(F.filter(array, lambda c: c <= mine))
    coarse = passed(F.array(*[border(g[0]) for g in groups]))
    fine = F.element_at(F.array(*[F.array(*map(border, g)) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + passed(fine))


def running_sums(df: DataFrame, key: str, sums: Mapping[str, Column], tie: list[str] | None = None, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds, for each name in ``sums``, the sum of its column over this row and all before it in order of ``key``, then ``tie``.

    ``by``: separate sums for each value of these columns, still split by ranges of the key, so that one value may hold
    most rows."""
    by = by or []
    df = df.withColumn("_range", key_range(df, [key, *(tie or [])], ranges))
    for name, c in sums.items():
        df = df.withColumn(f"_of_{name}", c)
    totals = df.groupBy(*by, "_range").agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in sums])
    within = Window.partitionBy(*by, "_range").orderBy(key, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    if by:
        same = [df[c].eqNullSafe(starts[c]) for c in by]
        joined = df.join(starts, [*same, df["_range"] == starts["_range"]]).select(df["*"], *[starts[f"_start_{n}"] for n in sums])
    else:
        joined = df.join(F.broadcast(starts), "_range")  # at most one row a range
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_start_{name}") + F.sum(f"_of_{name}").over(within))
    return joined.drop("_range", *[f"_of_{n}" for n in sums], *[f"_start_{n}" for n in sums])


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank of ``value`` from 1, ties sharing their mean rank; null values get null. Ranks come from counts of distinct values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, value, {"_upto": F.col("_n")}, by=by).select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranked, [*by, value], "left")


def with_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """Adds ``name``, a number that never falls where ``key`` rises: of a text, its first seven bytes."""
    c = F.col("`" + key.replace("`", "``") + "`")
    kind = dict(df.dtypes)[key]
    if kind == "string":
        head = F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0")
        return df.withColumn(name, F.conv(head, 16, 10).cast("double"))
    if kind == "date":
        c = F.unix_date(c)
    elif kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    return df.withColumn(name, c.cast("double"))


def shifted(df: DataFrame, key: str, value: Column, out: str, n: int, tie: list[str] | None = None, block: int = 65_536) -> DataFrame:
    """Adds the ``value`` of the row ``n`` places before in order of ``key``, then ``tie``; null where there is none.

    Rows are numbered range-wise and fall into blocks of places; a row goes to the block of the row that needs it as well."""
    placed = running_sums(df.withColumn("_value", value), key, {"_place": F.lit(1)}, tie)
    own, needed = F.floor(F.col("_place") / block), F.floor((F.col("_place") + n) / block)
    both = placed.withColumn("_block", own).withColumn("_to", F.explode(F.array_distinct(F.array(own, needed))))
    at = Window.partitionBy("_to").orderBy("_place").rangeBetween(-n, -n)
    return both.withColumn(out, F.first("_value").over(at)).where("_to = _block").drop("_value", "_place", "_block", "_to")


_FOLDS = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def strictly_before(df: DataFrame, key: str, time: str, made: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each name in ``made`` (sum, count, min or max, and of what), the aggregate over the rows of the same ``key`` with an
    earlier ``time`` (whole numbers); equal times don't count. Keys aren't null.

    From twice ``ROWS_A_RANGE`` rows on, the table is dealt out once, over one partition for so many rows at least, so a task's
    memory doesn't grow with the table. A key may hold most rows: of borders that part the table by key and time into ranges of so
    many rows, those of a key with several part its rows, each range is a window by itself, and starts from what the key's earlier
    ranges gave. There are at most two starts a border, so they are broadcast. The rows of any other key are one window."""
    borders, rows = _borders_and_rows(df, [key, time], least=1)
    often = Counter(k for k, _ in borders)
    borders = [b for b in borders if often[b[0]] > 1]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_RANGE)
    dealt = lambda df, *by: df.repartition(parts, *by) if rows >= 2 * ROWS_A_RANGE else df
    if not borders:
        alone = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
        return dealt(df, key).select("*", *[_FOLDS[op][0](c).over(alone).alias(n) for n, (op, c) in made.items()])
    columns = df.columns
    parted = F.col(key).isin(list(dict.fromkeys(k for k, _ in borders)))
    df = df.withColumn("_range", F.when(parted, key_range(df, [key, time], borders=borders)).otherwise(0))
    cut = df.where(parted)
    totals = cut.groupBy(key, "_range").agg(*[_FOLDS[op][0](c).alias(f"_all_{n}") for n, (op, c) in made.items()])
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.select(key, "_range", *[_FOLDS[op][1](f"_all_{n}").over(earlier).alias(f"_start_{n}") for n, (op, _) in made.items()])
    within = Window.partitionBy(key, "_range").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    out = dealt(df, key, "_range").select("*", *[_FOLDS[op][0](c).over(within).alias(f"_here_{n}") for n, (op, c) in made.items()])
    out = out.join(F.broadcast(starts), [key, "_range"], "left")
    for n, (op, _) in made.items():
        here, before = F.col(f"_here_{n}"), F.col(f"_start_{n}")
        if op in ("min", "max"):
            both = (F.least if op == "min" else F.greatest)(before, here)
        else:
            both = F.coalesce(before + here, before, here)
        out = out.withColumn(n, both)
    return out.select(*columns, *made)


def previous(df: DataFrame, by: Sequence[str], keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the ``value`` of the row before, in order of ``keys``, among the rows of the same ``by`` (nulls are one group);
    null for a group's first row. Of rows that are equal in ``keys``, any may come first.

    Rows are parted by ranges of the keys, one for each ``ROWS_A_RANGE`` rows of the table, so one group may hold most rows: each
    range of a group is a window by itself, and its first row takes the last value of the group's range before. Where all rows
    make one range, a group's rows are one window."""
    by, columns = list(by), df.columns
    borders = range_borders(df, keys, least=1)
    if not borders:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*by).orderBy(*keys)))
    df = df.withColumn("_range", key_range(df, keys, borders=borders)).withColumn("_value", value)
    ends = df.groupBy(*by, "_range").agg(F.max_by(F.struct("_value"), F.struct(*keys)).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_range")  # a row a range
    starts = ends.select(*by, "_range", F.lag("_end").over(earlier)["_value"].alias("_start"))
    within = Window.partitionBy(*by, "_range").orderBy(*keys)
    here = F.when(F.row_number().over(within) == 1, F.col("_start")).otherwise(F.lag("_value").over(within))
    same = [df[c].eqNullSafe(starts[c]) for c in by]
    joined = df.join(starts, [*same, df["_range"] == starts["_range"]]).select(df["*"], starts["_start"])
    return joined.withColumn(out, here).select(*columns, out)


def trailing(df: DataFrame, key: str, time: str, width: int, made: Mapping[str, Column], counted: Column | None = None) -> DataFrame:
    """Adds, for each name in ``made`` (aggregates such as ``F.sum(...)``), what it gives over the rows of the same ``key`` in the
    ``width`` before a row's ``time`` (whole numbers), its own time left out.

    Time is cut into buckets of the width, and a row also goes to the bucket after its own, which is as far as frames reach. So
    a key's rows are a window for each bucket, and not one: a key that holds most rows is spread over all its time. ``counted``:
    the rows that change an aggregate (all); others stay in their own bucket."""
    bucket = F.floor(F.col(time) / width)
    two = F.array(bucket, bucket + 1)
    both = df.withColumn("_bucket", F.explode(two if counted is None else F.when(counted, two).otherwise(F.array(bucket))))
    recent = Window.partitionBy(key, "_bucket").orderBy(time).rangeBetween(-width, -1)
    out = both.select("*", *[c.over(recent).alias(n) for n, c in made.items()])
    return out.where(F.col("_bucket") == bucket).drop("_bucket")


#: ``percentile_approx`` with this accuracy is off by 1 / accuracy of the rows at most; brackets are wider than that.
ACCURACY, MARGIN = 10_000, 1e-3
#: Tables of at most so many rows need no selection: one task may hold that many numbers, and the result is the same.
FEW_ROWS = 1_000_000
#: Up to so many values within all brackets, each group's are one window; beyond them they are parted by ranges.
WINDOW_VALUES = 1_000_000


def quantiles(df: DataFrame, columns: Mapping[str, Column], shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, q): of each column's values that aren't null, their number and exact quantiles by linear interpolation, in
    the order of ``shares``. Groups and columns without a value have no row.

    No task holds more than ``FEW_ROWS`` values of a column: beyond them, approximate quantiles bracket each wanted place, values below a bracket are only counted,
    and the few within it are counted by value and selected by their running counts. A bracket that misses its place
    is an error and never a wrong value."""
    by = list(by)
    cells = df.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("column"), c.cast("double").alias("_x")) for name, c in columns.items()])).alias("_cell")).select(*by, "_cell.*").where("_x is not null")
    keys = [*by, "column"]
    if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        whole = F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares]))
        return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), whole.alias("q"))
    ends = [max(0.0, s - MARGIN) for s in shares] + [min(1.0, s + MARGIN) for s in shares]
    around = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", ends, ACCURACY).alias("_ends"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    few = F.col("n") * MARGIN < 2  # then all values are within, as a place's neighbour must be, too
    around = around.withColumn("_ends", F.when(few, F.concat(F.array_repeat("_min", len(shares)), F.array_repeat("_max", len(shares)))).otherwise(F.col("_ends")))
    around = around.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "_ends")
    near = cells.join(around if by else F.broadcast(around), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])  # without by, a row a column
    low, high = (lambda s: F.get("_ends", s)), (lambda s: F.get("_ends", s + len(shares)))
    wanted = F.filter(F.lit(list(range(len(shares)))), lambda s: F.col("_x") <= high(s))
    some = near.select(*keys, "n", "_x", "_ends", F.explode(wanted).alias("_s")).withColumn("_x", F.when(F.col("_x") >= low(F.col("_s")), F.col("_x")))
    counts = written(some.groupBy(*keys, "n", "_s", "_x").agg(F.count(F.lit(1)).alias("_count")), "quantiles")
    groups = [*keys, "_s"]
    if counts.count() <= WINDOW_VALUES:
        upto = F.sum("_count").over(Window.partitionBy(*groups).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("_upto", upto)
    else:
        placed = running_sums(counts, "_x", {"_upto": F.col("_count")}, by=groups)
    place = (F.col("n") - 1) * F.element_at(F.lit([float(s) for s in shares]), F.col("_s") + 1)
    at = lambda p: F.max(F.when((F.col("_upto") - F.col("_count") <= p) & (p < F.col("_upto")), F.col("_x")))
    ends_of = placed.groupBy(*groups, "n").agg(at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"), F.first(place - F.floor(place)).alias("_part"))
    missed = F.raise_error(F.lit("a quantile is outside its bracket"))
    value = F.when(F.col("_low").isNull() | F.col("_high").isNull(), missed.cast("double")).when(F.col("_part") == 0, F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"))
    told = ends_of.withColumn("_value", value).groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_s", "_value"))).alias("_q"))
    return told.select(*keys, "n", F.transform("_q", lambda q: q["_value"]).alias("q"))


def most_frequent(df: DataFrame, column: Column) -> DataFrame:
    """One row, ``mode``: the most frequent value, the least of equals; counts by value, so no task holds all values."""
    counts = df.select(column.alias("_x")).where("_x is not null").groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    return counts.join(F.broadcast(most)).where("_n = _most").agg(F.min("_x").alias("mode"))
