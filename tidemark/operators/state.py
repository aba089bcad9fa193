"""State across runs: anomaly memory, alarms, fingerprints, provenance and publication of predictions."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import as_number
from tidemark.operators.filters import Condition, apply_conditions
from tidemark.operators.indicators import Indicator, compute, describe

GENERIC = {"timestamp": "date", "timestamp_ntz": "date", "date": "date"}


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.strip().lower()) if not unicodedata.combining(c))


def schema_fingerprint(df: DataFrame) -> str:
    """16 hex digits that name a kind of table: its column names and generic types, whatever their order."""
    kind = lambda t: GENERIC.get(t, "number" if t in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean") or t.startswith("decimal") else "category")
    parts = sorted(f"{_plain(c)}:{kind(t)}" for c, t in df.dtypes)
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def content_signature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n and a sum of row hashes, alike in any order of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("signature"))


def remember(history: DataFrame, findings: DataFrame, day: str) -> DataFrame:
    """History (identity, day, rows, resolved) with today's findings (identity, rows): a record a day for each identity."""
    today = findings.groupBy("identity").agg(F.max("rows").alias("rows")).select("identity", F.lit(day).cast("date").alias("day"), "rows", F.lit(False).alias("resolved"))
    return history.unionByName(today.join(history.where(F.col("day") == F.lit(day).cast("date")), "identity", "left_anti"))


def streaks(history: DataFrame) -> DataFrame:
    """(identity, times, streak, impact, reappeared): records, those since the last resolved one, rows altogether, and whether it came
    back after being resolved. Two aggregations; no window over an identity's history."""
    solved = history.groupBy("identity").agg(F.max(F.when(F.col("resolved"), F.col("day"))).alias("_solved"))
    both = history.join(solved, "identity")
    fresh = F.col("_solved").isNull() | (F.col("day") > F.col("_solved"))
    out = both.groupBy("identity").agg(F.count(F.lit(1)).alias("times"), F.count(F.when(fresh, 1)).alias("streak"), F.sum("rows").alias("impact"), F.max(F.col("_solved").isNotNull() & fresh).alias("reappeared"))
    return out


def without_false_positives(findings: DataFrame, known: DataFrame) -> DataFrame:
    return findings.join(known.select("identity"), "identity", "left_anti")


@dataclass(frozen=True)
class Alarm:
    """``of``: an indicator; a metric (mean, median, mode, std) of a column; ``frequency``, the count of a column's most frequent
    value; or ``rows``, how many rows of a column satisfy the test."""

    name: str
    of: str
    op: str  # > >= < <= =
    bound: float
    column: str | None = None
    indicator: Indicator | None = None
    conditions: tuple[Condition, ...] = field(default=())


def _test(c, op: str, bound: float):
    return {">": c > bound, ">=": c >= bound, "<": c < bound, "<=": c <= bound, "=": c == bound}[op]


def alarm_values(df: DataFrame, alarms: Sequence[Alarm]) -> DataFrame:
    """(name, value, fires); a missing value doesn't fire."""
    out = None
    for a in alarms:
        rows = apply_conditions(df, a.conditions)
        if a.of == "indicator":
            one = compute(rows, [a.indicator]).select("value")
        elif a.of == "frequency":
            one = rows.where(F.col(a.column).isNotNull()).groupBy(a.column).count().agg(F.max("count").cast("double").alias("value"))
        elif a.of == "rows":
            one = rows.agg(F.count(F.when(_test(as_number(F.col(a.column)), a.op, a.bound), 1)).cast("double").alias("value"))
        else:
            one = describe(rows, a.column).select(F.col(a.of).cast("double").alias("value"))
        fires = F.col("value") > 0 if a.of == "rows" else _test(F.col("value"), a.op, a.bound)
        one = one.select(F.lit(a.name).alias("name"), "value", F.coalesce(fires, F.lit(False)).alias("fires"))
        out = one if out is None else out.unionByName(one)
    return out


def alarm_rows(df: DataFrame, column: str, op: str, bound: float, row: str, n: int = 5) -> DataFrame:
    """(row, value): the rows farthest beyond the bound, in order of rows for equality."""
    x = as_number(F.col(column))
    hit = df.select(F.col(row).alias("row"), x.alias("value")).where(_test(F.col("value"), op, bound))
    order = F.desc("value") if op in (">", ">=") else F.asc("value") if op in ("<", "<=") else F.asc("row")
    return hit.orderBy(order, "row").limit(n)


def newly_firing(now: DataFrame, before: DataFrame) -> DataFrame:
    """Alarms that fire and didn't the last time."""
    was = before.select("name", F.col("fires").alias("_was"))
    return now.join(was, "name", "left").where(F.col("fires") & ~F.coalesce("_was", F.lit(False))).drop("_was")


@dataclass
class Provenance:
    """What each column comes from, in order of events: (kind, table, column, depends on)."""

    events: list[tuple[str, str, str | None, tuple[str, ...]]] = field(default_factory=list)

    def add(self, kind: str, table: str, column: str | None = None, depends_on: Sequence[str] = ()) -> None:
        self.events.append((kind, table, column, tuple(depends_on)))

    def base_columns(self, table: str, column: str) -> set[str]:
        """The columns that weren't calculated from others, behind this one; cycles end."""
        made = {c: d for k, t, c, d in self.events if k == "calculated" and t == table}
        found, todo, seen = set(), [column], set()
        while todo:
            c = todo.pop()
            if c in seen:
                continue
            seen.add(c)
            if c in made:
                todo += made[c]
            else:
                found.add(c)
        return found

    def stale(self, table: str, column: str) -> bool:
        """Whether something behind a calculated column changed after it was made."""
        at = max((i for i, (k, t, c, _) in enumerate(self.events) if k == "calculated" and t == table and c == column), default=None)
        behind = self.base_columns(table, column)
        return at is not None and any(t == table and c in behind for k, t, c, _ in self.events[at + 1 :] if k in ("cleaned", "edited"))

    def rename(self, table: str, old: str, new: str) -> None:
        swap = lambda c: new if c == old else c
        self.events = [(k, t, swap(c), tuple(map(swap, d))) if t == table else (k, t, c, d) for k, t, c, d in self.events]


def publish(df: DataFrame, predictions: DataFrame, row: str, names: dict[str, str]) -> DataFrame:
    """The table with predicted columns under names that aren't taken yet; rows never change in number."""
    taken, out = set(df.columns), predictions.select(row, *names)
    for c, name in names.items():
        free, k = name, 2
        while free in taken:
            free, k = f"{name} ({k})", k + 1
        taken.add(free)
        out = out.withColumnRenamed(c, free)
    return df.join(out, row, "left")


def cell_notes(findings: DataFrame, most: int = 300) -> DataFrame:
    """(kind, row, column) cells of findings with arrays ``columns`` and ``rows``: at most ``most`` rows of each finding."""
    rows = findings.select("kind", F.explode(F.slice("rows", 1, most)).alias("row"), "columns")
    return rows.select("kind", "row", F.explode("columns").alias("column"))


def last_known(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mark(history: DataFrame, identity: str, resolved: bool = True, day: str | None = None) -> DataFrame:
    """History with an identity's latest record (or that of ``day``) marked as resolved or open again; a table to write anew."""
    at = F.lit(day).cast("date") if day else None
    latest = history.where(F.col("identity") == identity).agg(F.max("day").alias("_latest"))
    if at is not None:
        latest = latest.select(at.alias("_latest"))
    hit = (F.col("identity") == identity) & (F.col("day") == F.col("_latest"))
    return history.join(F.broadcast(latest)).withColumn("resolved", F.when(hit, F.lit(resolved)).otherwise(F.col("resolved"))).drop("_latest")


def mark_false_positive(known: DataFrame, identity: str, is_one: bool = True) -> DataFrame:
    """The set of identities known as false positives, with one put in or taken out."""
    rest = known.where(F.col("identity") != identity)
    one = known.sparkSession.createDataFrame([(identity,)], "identity string")
    return rest.select("identity").unionByName(one) if is_one else rest.select("identity")


def alarms_to_dicts(alarms: Sequence[Alarm]) -> list[dict]:
    """For a JSON store of rules."""
    return [asdict(a) for a in alarms]


def alarms_from_dicts(stored: Sequence[dict]) -> list[Alarm]:
    """Keys that an older store lacks have defaults, unknown ones are ignored; a rule without a name, a test or a bound is dropped."""
    listed = lambda v: tuple(v) if isinstance(v, list) else v
    condition = lambda d: Condition(**{k: listed(v) for k, v in d.items() if k in {f.name for f in fields(Condition)}})
    own, out = {f.name for f in fields(Alarm)}, []
    for d in stored:
        if not {"name", "of", "op", "bound"} <= d.keys():
            continue
        made = {k: v for k, v in d.items() if k in own}
        if made.get("indicator"):
            inner = {k: v for k, v in made["indicator"].items() if k in {f.name for f in fields(Indicator)}}
            made["indicator"] = Indicator(**(inner | {"conditions": tuple(map(condition, inner.get("conditions", ())))}))
        out.append(Alarm(**(made | {"conditions": tuple(map(condition, made.get("conditions", ())))})))
    return out


def currency_columns(df: DataFrame, columns: Sequence[str], rate: Callable[[], float], to: str = "both") -> DataFrame:
    """``column_UF``, over the rate to two places, and ``column_CLP``, times the rate without places, half to even. ``rate``: asked
    once, so where it comes from (a service, a table) is the caller's; a rate that isn't a positive number is an error."""
    value = float(rate())
    if not (0 < value < float("inf")):
        raise ValueError(f"no rate: {value}")
    x = lambda c: as_number(F.col(c))
    uf = {f"{c}_UF": F.bround(x(c) / value, 2) for c in columns} if to in ("both", "UF") else {}
    clp = {f"{c}_CLP": F.bround(x(c) * value, 0) for c in columns} if to in ("both", "CLP") else {}
    return df.withColumns(uf | clp)


def edit_cells(df: DataFrame, row: str, edits: DataFrame) -> DataFrame:
    """The table with cells replaced by ``edits`` (row, column, value as text), cast as an edit in a grid is; one join for all. Of
    several edits of a cell the greatest text counts; edits of columns that aren't there do nothing."""
    from tidemark.sources.files import cast_edit

    kinds = dict(df.dtypes)
    one = edits.groupBy("row", "column").agg(F.max(F.coalesce("value", F.lit(""))).alias("_v"))
    mine = one.groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("column", "_v"))).alias("_cells"))  # no more than the table has columns
    out = df.join(mine, F.col(row) == F.col("_row"), "left")
    cell = lambda c: F.when(F.map_contains_key(F.coalesce("_cells", F.create_map().cast("map<string,string>")), c), cast_edit(F.try_element_at("_cells", F.lit(c)), kinds[c])).otherwise(F.col(c))
    return out.select(*[cell(c).alias(c) if c != row else F.col(c) for c in df.columns])


def rename_column(df: DataFrame, old: str, new: str, provenance: Provenance | None = None, table: str = "", conditions: Sequence[Condition] = (), indicators: Sequence[Indicator] = (), notes: Sequence[tuple] = ()) -> tuple[DataFrame, list[Condition], list[Indicator], list[tuple]]:
    """(table, conditions, indicators, notes) with a column's new name wherever it's named: filters, indicators and their formulas,
    cell notes (row, column, text), and the provenance in place. A name that is taken is an error."""
    if new in df.columns:
        raise ValueError(f"{new} is taken")
    swap = lambda c: new if c == old else c
    moved = [replace(c, column=swap(c.column)) for c in conditions]
    formula = lambda f: f.replace(f"[{old}]", f"[{new}]") if f else f
    named = [replace(k, column=swap(k.column), other=swap(k.other), date=swap(k.date), formula=formula(k.formula), conditions=tuple(replace(c, column=swap(c.column)) for c in k.conditions)) for k in indicators]
    if provenance is not None:
        provenance.rename(table, old, new)
    return df.withColumnRenamed(old, new), moved, named, [(r, swap(c), *rest) for r, c, *rest in notes]


def sample_rows(df: DataFrame, row: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), by hash of their number: the same ones however the table is cut into parts."""
    return df.orderBy(F.xxhash64(row, F.lit(seed)), row).limit(n)


def affected_by(columns: Sequence[str], indicators: Sequence[Indicator], provenance: Provenance, table: str) -> dict[str, list[str]]:
    """Which indicators and calculated columns rest on the columns of an anomaly."""
    hit = set(columns)
    made = dict.fromkeys(c for k, t, c, _ in provenance.events if k == "calculated" and t == table)
    calculated = [c for c in made if provenance.base_columns(table, c) & hit or c in hit]
    behind = hit | set(calculated)
    return {"indicators": [k.name for k in indicators if behind & set(k.columns())], "columns": calculated}


@dataclass
class Board:
    """What was published: predictions by table, at most ``MOST_FORECASTS`` answers by urgency, comparisons with what happened,
    and windows of future dates."""

    predictions: dict[str, DataFrame] = field(default_factory=dict)
    answers: list[dict] = field(default_factory=list)
    returns: dict[str, DataFrame] = field(default_factory=dict)
    windows: list[dict] = field(default_factory=list)

    MOST_FORECASTS = 12
    URGENCY = {"alert": 0, "watch": 1, "info": 2}

    def publish(self, table: str, predictions: DataFrame) -> None:
        self.predictions[table] = predictions

    def answer(self, key: str, title: str, urgency: str, windows: Sequence[dict] = (), table: str = "") -> None:
        """An answer takes the place of an earlier one of the same key; the most urgent stay."""
        self.answers = [a for a in self.answers if a["key"] != key] + [{"key": key, "title": title, "urgency": urgency, "table": table}]
        self.answers = sorted(self.answers, key=lambda a: self.URGENCY.get(a["urgency"], 3))[: self.MOST_FORECASTS]
        kept = {a["key"] for a in self.answers}
        self.windows = [w for w in self.windows if w["key"] != key and w["key"] in kept] + [{"key": key, "table": table} | dict(w) for w in windows if key in kept]

    def future_windows(self, table: str | None = None) -> list[dict]:
        return [w for w in self.windows if table in (None, w["table"])]

    def discard(self, table: str) -> None:
        """All that was published for a table, as when it's read anew."""
        self.predictions.pop(table, None)
        self.returns.pop(table, None)
        self.answers = [a for a in self.answers if a["table"] != table]
        self.windows = [w for w in self.windows if w["table"] != table]

    def outdated(self, table: str, df: DataFrame, row: str) -> bool:
        """Whether the table's rows are others than those predicted."""
        old = self.predictions.get(table)
        return old is not None and tuple(content_signature(old.select(row), [row]).first()) != tuple(content_signature(df.select(row), [row]).first())
