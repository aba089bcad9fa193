"""What anomaly tables say together: load, worst cases, dates, coincidences, questions, contagion, and profiles of a table.

A finding is a row (kind, columns, row, severity, affected, text): ``columns`` an array, ``row`` the affected row's key (null for
findings on whole columns), ``affected`` how many rows it touches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import micros
from tidemark.operators.anomalies import SCALE, IsolationForest, Z, robust_statistics
from tidemark.operators.indicators import Indicator
from tidemark.operators.lineage import name_parts
from tidemark.operators.ordered import previous, quantiles
from tidemark.operators.relational import Edge
from tidemark.operators.state import content_signature

SEVERITY = {"extreme": 4, "high": 3, "medium": 2, "low": 1}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _grade():
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)]), F.col("severity")), F.lit(0))


def is_id(column: str) -> bool:
    parts = name_parts(column)
    return parts == ["id"] or len(parts) > 1 and "id" in (parts[0], parts[-1])


def load_by_kind(findings: DataFrame) -> DataFrame:
    """(kind, findings, affected): how many findings and affected rows of each kind."""
    return findings.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.sum("affected").alias("affected"))


def load_by_column(findings: DataFrame) -> DataFrame:
    """(column, findings, affected, most): the same by column; ``most`` marks the column with the most affected rows."""
    out = findings.select(F.explode("columns").alias("column"), "affected").groupBy("column").agg(F.count(F.lit(1)).alias("findings"), F.sum("affected").alias("affected"))
    top = out.agg(F.max_by("column", F.struct("affected", "column")).alias("_top"))
    return out.join(F.broadcast(top)).select("column", "findings", "affected", (F.col("column") == F.col("_top")).alias("most"))


def by_table(findings: DataFrame, table: str = "table") -> DataFrame:
    """(table, high, medium, low, findings): counts by severity; extreme counts as high."""
    count = lambda *s: F.count(F.when(F.col("severity").isin(*s), 1))
    return findings.groupBy(table).agg(count("extreme", "high").alias("high"), count("medium").alias("medium"), count("low").alias("low"), F.count(F.lit(1)).alias("findings"))


def worst_by_column(findings: DataFrame) -> DataFrame:
    """Findings on single rows of one column become one, with the worst severity, its row, and how many there were; others stay.
    (kind, columns, row, severity, affected, findings, grade), the gravest first is by ``grade``."""
    single = F.col("row").isNotNull() & (F.size("columns") > 0)
    graded = findings.withColumn("grade", _grade())
    grouped = graded.where(single).groupBy("kind", F.slice("columns", 1, 1).alias("columns")).agg(F.max_by(F.struct("row", "severity"), F.struct(F.col("grade"), F.col("row"))).alias("w"), F.sum("affected").alias("affected"), F.count(F.lit(1)).alias("findings"), F.max("grade").alias("grade"))
    grouped = grouped.select("kind", "columns", "w.row", "w.severity", "affected", "findings", "grade")
    return grouped.unionByName(graded.where(~single).select("kind", "columns", "row", "severity", "affected", F.lit(1).cast("long").alias("findings"), "grade"))


def top_findings(findings: DataFrame, n: int = 3, hide_ids: bool = True) -> DataFrame:
    """The ``n`` gravest findings, one of each kind and columns; those only about id columns are hidden. The limit is the feature."""
    ids = F.udf(lambda cs: bool(cs) and all(is_id(c) for c in cs), "boolean")
    graded = findings.withColumn("grade", _grade())
    if hide_ids:  # names are few: a row for each set of columns that occurs
        named = graded.select("columns").distinct().where(~ids("columns"))
        graded = graded.join(F.broadcast(named), "columns", "left_semi")
    one = Window.partitionBy("kind", "columns").orderBy(F.desc("grade"), F.desc("affected"), "text")
    return graded.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k").orderBy(F.desc("grade"), F.desc("affected"), "kind", "columns").limit(n)


#: The order in which kinds of cleaning findings are shown.
CLEANING_ORDER = ("duplicates", "whitespace", "format", "special characters", "numbers as text")


def group_by_kind(findings: DataFrame, order: Sequence[str] = CLEANING_ORDER) -> DataFrame:
    """(place, kind, columns, findings): kinds in their fixed order, unknown ones last by name, with their distinct columns."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, name in enumerate(order) for x in (name, k)]), F.col("kind")), F.lit(len(order)))
    return findings.groupBy("kind").agg(F.array_sort(F.collect_set(F.element_at("columns", 1))).alias("columns"), F.count(F.lit(1)).alias("findings")).select(place.alias("place"), "kind", "columns", "findings")


def dated(findings: DataFrame, df: DataFrame, row: str, date: str, key: Sequence[str] = ("kind", "columns")) -> DataFrame:
    """(key, date): the median date of each finding's affected rows, a marker on a time line; findings without a dated row go."""
    rows = findings.where("row is not null").select(*key, F.col("row").alias("_row")).distinct()
    when = df.where(F.col(date).isNotNull()).select(F.col(row).alias("_row"), micros(F.col(date)).alias("_t"))
    middle = quantiles(rows.join(when, "_row"), {"t": F.col("_t")}, [0.5], key)
    return middle.select(*key, F.timestamp_micros(F.col("q")[0].cast("long")).alias("date"))


def coincidences(df: DataFrame, odd: DataFrame, row: str, columns: Sequence[str], z_from: float = 2.0, rare: float = 0.05, most_values: int = 20) -> DataFrame:
    """(row, column, value, strength): in anomalous rows (row, column), other columns that are out of the ordinary too.

    Numbers of ten values or more: |robust z| of at least ``z_from``. Numbers that hardly vary, and texts: a value that at most
    5 % of the rows have, in columns of repeated values (up to ``most_values``, and a fifth of the rows). Strength: |z| or
    1 - share. It says that things came together, not that one is why. Statistics of a column are one row, counts of its values
    at most ``most_values``, and both are broadcast."""
    kinds = dict(df.dtypes)
    marks = odd.select(F.col("row").alias("_row"), F.col("column").alias("_own")).distinct()
    hit = df.join(marks, F.col(row) == F.col("_row"))
    n = df.agg(*[F.count(c).alias(c) for c in columns], *[F.count_distinct(c).alias(f"_d_{c}") for c in columns]).first()
    parts = []
    for c in columns:
        if kinds[c].startswith(("timestamp", "date")) or not n[c]:
            continue
        some = hit.where((F.col("_own") != c) & F.col(c).isNotNull()).select(F.col("_row").alias("row"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(c).alias("_x"))
        stats = robust_statistics(df, c).first() if kinds[c] in NUMERIC else None
        if stats is not None and stats["mad"]:
            if n[c] >= 10:
                parts.append(some.withColumn("strength", F.abs(SCALE * (F.col("_x") - stats["median"]) / stats["mad"])).where(F.col("strength") >= z_from).drop("_x"))
        elif 1 < n[f"_d_{c}"] <= min(most_values, max(2, int(0.2 * n[c]))):
            shares = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_x")).agg((F.count(F.lit(1)) / float(n[c])).alias("_share"))
            parts.append(some.join(F.broadcast(shares), "_x").where(F.col("_share") <= rare).select("row", "column", "value", (1 - F.col("_share")).alias("strength")))
    if not parts:
        return df.select(F.col(row).alias("row"), F.lit("").alias("column"), F.lit("").alias("value"), F.lit(0.0).alias("strength")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()


def strongest_coincidence(found: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` strongest of each row."""
    best = Window.partitionBy("row").orderBy(F.desc("strength"), "column")
    return found.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n).drop("_k")


def detector_reliability(df: DataFrame, row: str, columns: Sequence[str], tests: int = 30, contamination: float = 0.02, sample_rows: int = 20_000, reliable_from: float = 0.75, seed: int = 0) -> dict | None:
    """How many of some planted oddities an isolation forest finds: two columns of a row moved by 0.7 x 3 robust deviations each, so
    that only their combination is odd. On a sample of ``sample_rows`` rows by hash, as a test needs no more; None under 50."""
    x = df.select(F.col(row).alias("_row"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna().orderBy(F.xxhash64("_row", F.lit(seed)), "_row").limit(sample_rows).toPandas()[list(columns)].to_numpy()
    if len(x) < 50 or len(columns) < 2:
        return None
    rng, tests = np.random.default_rng(seed), min(tests, max(5, len(x) // 10))
    centre = np.median(x, axis=0)
    mad = np.median(np.abs(x - centre), axis=0)
    scale = np.where(mad > 0, mad / SCALE, np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0))
    planted, moved = rng.choice(len(x), tests, replace=False), x.copy()
    for k in planted:
        c = rng.choice(len(columns), 2, replace=False)
        moved[k, c] = centre[c] + rng.choice([-1, 1], 2) * scale[c] * Z * 0.7
    scores = IsolationForest(moved, seed=seed).score(moved)
    found = scores[planted] >= np.quantile(scores, 1 - contamination)
    return {"tests": int(tests), "rate": float(found.mean()), "rows": len(x), "reliable": bool(found.mean() >= reliable_from)}


def chart_series(df: DataFrame, date: str, value: str) -> DataFrame:
    """(date, y): a column by date for an anomaly's chart, missing values filled by the mean."""
    mean = df.agg(F.avg(value).alias("_m"))
    return df.where(F.col(date).isNotNull()).join(F.broadcast(mean)).select(F.col(date).alias("date"), F.coalesce(F.col(value).cast("double"), "_m").alias("y"))


def chart_day_differences(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """(days, rows): how many rows have each difference in whole days of two dates."""
    return df.where(F.col(earlier).isNotNull() & F.col(later).isNotNull()).groupBy(F.datediff(later, earlier).alias("days")).agg(F.count(F.lit(1)).alias("rows"))


def chart_complete(df: DataFrame, column: str) -> DataFrame:
    """(part, rows): complete and missing cells."""
    return df.groupBy(F.when(F.col(column).isNull(), "missing").otherwise("complete").alias("part")).agg(F.count(F.lit(1)).alias("rows"))


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, numeric columns, and the first date column with its least and greatest date; one aggregate."""
    dates = [c for c, k in df.dtypes if k.startswith(("timestamp", "date"))]
    day = [F.min(dates[0]).cast("string"), F.max(dates[0]).cast("string")] if dates else [F.lit(None).cast("string")] * 2
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.lit(sum(k in NUMERIC or k.startswith("decimal") for _, k in df.dtypes)).alias("numeric"), F.lit(dates[0] if dates else None).cast("string").alias("date_column"), day[0].alias("first_date"), day[1].alias("last_date"))


def stale(df: DataFrame, columns: Sequence[str], today: str, days: int = 45, cut: str | None = None) -> DataFrame:
    """(last, age, stale): the latest date of the columns (or the cut-off date), how many days before ``today``, and whether over ``days``."""
    last = F.to_date(F.lit(cut)) if cut else F.greatest(*[F.max(F.to_date(c)) for c in columns], F.lit(None).cast("date"))
    age = F.datediff(F.to_date(F.lit(today)), F.col("last"))
    return df.agg(last.alias("last")).select("last", age.alias("age"), F.coalesce(age > days, F.lit(False)).alias("stale"))


# Parts of names that tell the main value of a table, the likeliest first.
VALUE_NAMES = ("total", "monto", "final", "amount", "price", "precio", "valor", "value", "venta", "sale", "ingreso", "revenue")


def suggested_indicators(df: DataFrame, own: Sequence[str] | None = None) -> list[Indicator]:
    """Sum and mean of the column that is likeliest the main value, its ratio to the next number, the row count, and distinct
    values of the first two texts with under 50. Ids and columns of 0 and 1 are no values. One profiling aggregate."""
    columns = [(c, k) for c, k in df.dtypes if own is None or c in own]
    numbers = [c for c, k in columns if k in NUMERIC and not is_id(c)]
    texts = [c for c, k in columns if k == "string"][:2]
    got = df.agg(*[F.count(F.when(~F.col(c).isin(0, 1), 1)).alias(c) for c in numbers], *[F.count_distinct(c).alias(f"_d_{c}") for c in texts], F.count(F.lit(1)).alias("_n")).first()
    useful = [c for c in numbers if got[c]]
    out = []
    if useful:
        best = next((c for w in VALUE_NAMES for c in useful if w in c.lower()), useful[0])
        out += [Indicator(f"Total {best}", "sum", best), Indicator(f"Mean {best}", "mean", best)]
        if rest := [c for c in useful if c != best]:
            out.append(Indicator(f"{best} / {rest[0]}", "ratio", best, rest[0]))
    if columns:
        out.append(Indicator("Rows", "count", columns[0][0]))
    return out + [Indicator(f"Values of {c}", "distinct", c) for c in texts if 0 < got[f"_d_{c}"] < 50]


def suggested_questions(findings: DataFrame, df: DataFrame, n: int = 8) -> list[str]:
    """At most ``n`` questions worth asking: of grave findings, of columns with over 30 % missing, of texts with few values."""
    asks = {"temporal": "What happens in the process that records {}?", "nulls": "Why is so much of {} missing?", "duplicates": "Why are there repeated rows?", "drift": "What has changed in {}?", "multivariate": "What explains {} together in that row?", "outlier": "Why did {} leave its usual range?"}
    grave = findings.where(F.col("severity").isin("extreme", "high")).select("kind", "columns").distinct().orderBy("kind", "columns").limit(n).collect()
    out = [asks.get(f["kind"], "Why isn't the rule on {} kept?").format(", ".join(f["columns"] or ["these data"])) for f in grave]
    texts = [c for c, k in df.dtypes if k not in NUMERIC]
    got = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c_{c}") for c in df.columns], *[F.count_distinct(c).alias(f"_d_{c}") for c in texts]).first()
    total = got["_n"]
    out += [f"Why is {100 * (total - got[f'_c_{c}']) / total:.0f} % of {c} missing?" for c in df.columns if total and total - got[f"_c_{c}"] > 0.3 * total]
    out += [f"How do results differ by {c}?" for c in texts if 1 < got[f"_d_{c}"] <= 0.02 * total]
    return list(dict.fromkeys(out))[:n]


def contagion_index(tables: Mapping[str, DataFrame], start: str, affected: DataFrame, edges: Sequence[Edge], rows: Mapping[str, str], hops: int = 5) -> DataFrame:
    """(table, rows): how many different rows of each table depend on the affected ones, over all paths of up to ``hops``.

    ``rows``: each table's column that names a row. A row that several paths reach counts once."""
    reached: dict[str, DataFrame] = {}
    front, seen = [(start, affected)], {}
    for _ in range(hops):
        following = []
        for table, hit in front:
            for e in [e for e in edges if e.parent == table and e.child in tables]:
                keys = hit.select(F.col(e.parent_key).alias(e.child_key)).where(F.col(e.child_key).isNotNull()).distinct()
                if e in seen:
                    keys = keys.join(seen[e], e.child_key, "left_anti")
                seen[e] = seen[e].unionByName(keys) if e in seen else keys
                child = tables[e.child].join(keys, e.child_key, "left_semi")
                own = child.select(F.col(rows[e.child]).alias("_row"))
                reached[e.child] = reached[e.child].unionByName(own) if e.child in reached else own
                following.append((e.child, child))
        front = following
        if not front:
            break
    if not reached:
        return affected.select(F.lit("").alias("table"), F.lit(0).cast("long").alias("rows")).limit(0)
    return reduce(DataFrame.unionByName, [d.distinct().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, d in sorted(reached.items())]).where("rows > 0")


def contagion_sentence(counts: Mapping[str, int]) -> str:
    """What setting the affected rows right would mend."""
    if not counts:
        return "This doesn't spread: no row of a connected table depends on it."
    total = sum(counts.values())
    where = ", ".join(f"{n:,} in {t}" for t, n in sorted(counts.items()))
    return f"Setting this right would mend {total:,} row{'s' * (total != 1)}: {where}."


# The settings that make two runs the same analysis.
IDENTITY = ("keyword", "table", "date", "value", "target", "event", "event_value", "entity", "start", "end", "risk", "cost", "driver", "stock", "group", "method", "train_table", "kind")
CONFIDENCE = {"low": 0, "medium": 1, "high": 2}


def analysis_key(settings: Mapping) -> str:
    known = {k: settings[k] for k in IDENTITY if settings.get(k) not in (None, "", [], ())}
    return hashlib.sha1(json.dumps(known, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:10]


def compare_runs(history: DataFrame, change: float = 0.10) -> DataFrame:
    """(key, at, improvement, before, confidence, confidence_before, changed, less_sure) of each run (key, at, improvement, confidence)
    against the one before of the same analysis: improvement moved by ``change`` or more, or confidence fell."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for k, v in CONFIDENCE.items() for x in (k, v)]), F.col("confidence"))
    run = F.struct(F.col("improvement").alias("i"), F.col("confidence").alias("c"), F.col("_rank").alias("r"))
    out = previous(history.withColumn("_rank", rank), ["key"], ["at"], run, "_run").withColumns({"before": F.col("_run.i"), "confidence_before": F.col("_run.c"), "_rank_before": F.col("_run.r")})
    return out.select("key", "at", "improvement", "before", "confidence", "confidence_before", F.coalesce(F.abs(F.col("improvement") - F.col("before")) >= change, F.lit(False)).alias("changed"), F.coalesce(F.col("_rank") < F.col("_rank_before"), F.lit(False)).alias("less_sure"))


def trimmed_history(history: DataFrame, each: int = 10, total: int = 200) -> DataFrame:
    """The latest ``each`` runs of every analysis, and of these the latest ``total``; the limits are the store's."""
    order = Window.partitionBy("key").orderBy(F.desc("at"))
    return history.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).drop("_k").orderBy(F.desc("at")).limit(total)


def is_outdated(published: DataFrame, df: DataFrame, row: str) -> bool:
    """Whether the rows of the table are others than those that predictions were published for."""
    now, then = (content_signature(d.select(row), [row]).first() for d in (df, published))
    return tuple(now) != tuple(then)


def milestones(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(milestone, row, date): the dates of several columns, one under the other; rows without a date go."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("milestone"), F.col(c).cast("timestamp_ntz").alias("date")) for c in columns])).alias("c")
    return df.select(F.col(row).alias("row"), cells).select("c.milestone", "row", "c.date").where("date is not null")


def milestone_ranks(marks: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each milestone among all in order of time; ranges of time are ordered apart, so no task gets them all."""
    from tidemark.operators.ordered import running_sums

    keyed = marks.withColumn("_t", micros(F.col("date")))
    return running_sums(keyed, "_t", {"rank": F.lit(1)}, ["milestone", "row"]).drop("_t")


def intervals(df: DataFrame, row: str, start: str, end: str) -> DataFrame:
    """(row, start, end, days, wrong): rows with both dates; ``wrong`` if the end is before the start."""
    both = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    days = (micros(F.col(end)) - micros(F.col(start))) / 86_400_000_000.0
    return both.select(F.col(row).alias("row"), F.col(start).alias("start"), F.col(end).alias("end"), days.alias("days"), (days < 0).alias("wrong"))
