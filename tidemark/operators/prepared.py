"""Tables for learning: related tables' columns on the training table and, by the same links, on the test table; parents found by
names and values; explicit summaries of children; the date that keeps the future out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import key_text
from tidemark.operators.findings import NUMERIC, is_id
from tidemark.operators.lineage import name_parts
from tidemark.operators.relational import enrich, is_unique, prior_resume, resume

# Parts of names that tell a date.
DATE_NAMES = ("fecha", "date", "dia", "día")


@dataclass(frozen=True)
class Widths:
    """The most columns of a related table that are summed up, and different values of a category; None for no bound. What a bound
    leaves out is told in the notes."""

    numbers: int | None = 12
    categories: int | None = 3
    values: int | None = 50


def date_column(df: DataFrame, exclude: Sequence[str] = (), chosen: str | None = None, none: bool = False) -> str | None:
    """The date by which nothing later is looked at: the one that was chosen, else the first whose name says date, else the
    first; none if ``none`` is asked for. Texts count as dates if nine of ten known cells are ISO dates; one aggregate tells."""
    if none:
        return None
    if chosen in df.columns:
        return chosen
    kinds = {c: k for c, k in df.dtypes if c not in exclude}
    texts = [c for c, k in kinds.items() if k == "string"]
    iso = df.agg(*[F.avg(F.col(c).rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}").cast("double")).alias(c) for c in texts]).first().asDict() if texts else {}
    dates = [c for c, k in kinds.items() if k.startswith(("timestamp", "date")) or (iso.get(c) or 0) >= 0.9]
    return next((c for c in dates if any(p in c.lower() for p in DATE_NAMES)), dates[0] if dates else None)


@dataclass(frozen=True)
class Link:
    """Two columns that hold the same keys; which side is unique is found in the data."""

    a: str
    a_key: str
    b: str
    b_key: str

    def from_(self, table: str) -> tuple[str, str, str] | None:
        """(own key, other table, other key)."""
        return (self.a_key, self.b, self.b_key) if table == self.a else (self.b_key, self.a, self.a_key) if table == self.b else None

    def renamed(self, old: str, new: str) -> Link:
        swap = lambda t: new if t == old else t
        return Link(swap(self.a), self.a_key, swap(self.b), self.b_key)


def _numbers(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    some = [c for c, k in df.dtypes if k in NUMERIC and c not in exclude and not is_id(c)]
    moving = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in some]).first().asDict() if some else {}
    return [c for c in some if moving[c]]


def _categories(df: DataFrame, exclude: Sequence[str], most_values: int | None) -> list[str]:
    some = [c for c, k in df.dtypes if k in ("string", "boolean") and c not in exclude and not is_id(c)]
    values = df.agg(*[F.count_distinct(c).alias(c) for c in some]).first().asDict() if some else {}
    return [c for c in some if values[c] >= 2 and (most_values is None or values[c] <= most_values)]


def _chosen(df: DataFrame, exclude: Sequence[str], widths: Widths, table: str) -> tuple[list[str], list[str], list[str]]:
    """(numbers, categories, notes of what the widths leave out)."""
    numbers, categories = _numbers(df, exclude), _categories(df, exclude, widths.values)
    left = numbers[widths.numbers :] if widths.numbers is not None else []
    left += categories[widths.categories :] if widths.categories is not None else []
    return numbers[: widths.numbers], categories[: widths.categories], [f"{table}: not summed up: {', '.join(left)}"] if left else []


def widen(tables: Mapping[str, DataFrame], base: str, links: Sequence[Link], row: str, date: str | None = None, depth: int = 2, exclude: Sequence[str] = (), widths: Widths = Widths()) -> tuple[DataFrame, list[str], list[str]]:  # noqa: B008
    """(the base with related tables' columns, the new columns, notes). Rows of the base never change in number.

    A table whose key is unique gives its columns as ``table.column``; of others, summaries: of rows strictly before the base
    row's ``date``, if both have a date, else of all. Up to ``depth`` links away through unique keys, no table twice.
    Columns in ``exclude`` (the target) are never brought in."""
    out, new, notes = tables[base], [], []
    front, seen = [(base, "")], {base}
    for _ in range(depth):
        following = []
        for table, path in front:
            for link in links:
                side = link.from_(table)
                if side is None or side[1] in seen or side[1] not in tables:
                    continue
                own, name, key = side
                own = f"{path}{own}"
                other = tables[name]
                if key not in other.columns or own not in out.columns:
                    notes.append(f"{name}: no column {key if key not in other.columns else own}")
                    continue
                seen.add(name)
                before = set(out.columns)
                if is_unique(other, key):
                    wanted = [c for c in other.columns if c != key and c not in exclude]
                    out = enrich(out, other, f"`{own}`", key, wanted, f"{path}{name}")
                    following.append((name, f"{path}{name}."))
                elif not path:
                    when = date_column(other, [key]) if date else None
                    skip = [key, when, *exclude]
                    numbers, categories, left = _chosen(other, skip, widths, name)
                    notes += left
                    if when:
                        out = prior_resume(out, other, own, key, date, when, row, numbers, categories, prefix=name)
                    else:
                        out = resume(out, other, own, key, numbers, categories, name)
                new += [c for c in out.columns if c not in before]
        front = following
    return out, new, notes


@dataclass
class Pair:
    train: DataFrame
    test: DataFrame | None
    new_columns: list[str]
    date: str | None
    notes: list[str] = field(default_factory=list)


def prepare_pair(tables: Mapping[str, DataFrame], train: str, test: str | None, target: str, links: Sequence[Link], row: str, date: str | None = None, no_date: bool = False, depth: int = 2) -> Pair:
    """Training and test tables with the same columns from the same links.

    The links of the training table hold for the test table too, and the training table is no source for it. Columns that the
    test table can't be given, as it lacks a key, are null there, and a note says so. The target is never brought in."""
    at = date_column(tables[train], [target], date, no_date)
    wide, new, notes = widen({k: v for k, v in tables.items() if k != test}, train, links, row, at, depth, [target])
    if test is None:
        return Pair(wide, None, new, at, notes)
    own = [x.renamed(train, test) for x in links]
    usable = [x for x in own if (side := x.from_(test)) is None or side[0] in tables[test].columns]
    other, _, more = widen({k: v for k, v in tables.items() if k != train}, test, usable, row, at if at in tables[test].columns else None, depth, [target])
    missing = [c for c in new if c not in other.columns]
    if missing:
        more.append(f"{len(missing)} columns can't be given to {test}, as it lacks a key")
        kinds = dict(wide.dtypes)
        other = other.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in missing])
    return Pair(wide, other, new, at, list(dict.fromkeys([*notes, *more])))


def key_root(column: str) -> str | None:
    """What a key's name points to: ``sale`` of sale_id and id_sale."""
    low = column.lower()
    return column[:-3] if low.endswith("_id") and len(low) > 3 else column[3:] if low.startswith("id_") and len(low) > 3 else None


def infer_parents(tables: Mapping[str, DataFrame], coverage: float = 0.9) -> dict[str, list[tuple[str, str, str]]]:
    """child: [(its key, parent, the parent's key)]. A key points to a table if its name says so (with s or es at the end), the
    parent's key is unique and known in every row, and nine of ten of the child's known keys are in it."""
    bare = lambda n: "".join(name_parts(n))
    out: dict[str, list[tuple[str, str, str]]] = {n: [] for n in tables}
    for child, df in tables.items():
        for column in df.columns:
            root = key_root(column)
            if not root:
                continue
            for parent, other in tables.items():
                if parent == child or bare(parent) not in (bare(root), f"{bare(root)}s", f"{bare(root)}es"):
                    continue
                key = next((k for k in (column, "id", f"id_{root}", f"{root}_id") if k in other.columns), None)
                if key is None or other.where(F.col(key).isNull()).limit(1).count() or not is_unique(other, key):
                    continue
                keys = other.select(key_text(F.col(key)).alias("_k")).distinct().withColumn("_in", F.lit(1))
                n, found = df.where(F.col(column).isNotNull()).select(key_text(F.col(column)).alias("_k")).join(keys, "_k", "left").agg(F.count(F.lit(1)), F.count("_in")).first()
                if n and found >= coverage * n:
                    out[child].append((column, parent, key))
                    break
    return out


def reachable(base: str, parents: Mapping[str, Sequence[tuple[str, str, str]]], hops: int = 2) -> list[str]:
    out, front = [], [base]
    for _ in range(hops):
        front = [p for t in front for _, p, _ in parents.get(t, ()) if p not in (base, *out) and not out.append(p)]
    return out


def combine_with_parents(name: str, tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[tuple[str, str, str]]], hops: int = 2, allowed: Sequence[str] | None = None, _seen: tuple[str, ...] = ()) -> DataFrame:
    """The table with its parents' columns as ``Table.column``, and theirs, up to ``hops``. Each row points to one parent's row, so
    the number of rows stays. Parents' keys and ids, and columns without a value, aren't brought in."""
    out = tables[name]
    for key, parent, parent_key in parents.get(name, ()) if hops else ():
        if parent in (name, *_seen) or allowed is not None and parent not in allowed:
            continue
        side = combine_with_parents(parent, tables, parents, hops - 1, allowed, (*_seen, name))
        quoted = lambda c: F.col(f"`{c}`")
        known = side.agg(*[F.count(quoted(c)).alias(c) for c in side.columns]).first().asDict()
        wanted = {c: c if "." in c else f"{parent}.{c}" for c in side.columns if c != parent_key and known[c] and ("." in c or not is_id(c))}
        wanted = {c: n for c, n in wanted.items() if n not in out.columns}
        small = side.select(key_text(F.col(parent_key)).alias("_key"), *[quoted(c).alias(n) for c, n in wanted.items()])
        out = out.withColumn("_key", key_text(F.col(key))).join(small, "_key", "left").drop("_key")
    return out


def explicit_resume(base: DataFrame, child: DataFrame, name: str, key: str, child_key: str, numbers: Sequence[str]) -> DataFrame:
    """``{child}__count``, ``{child}__{column}__sum`` and ``__mean`` by an edge whose child key repeats; another edge is an error."""
    if is_unique(child, child_key):
        raise ValueError(f"{child_key} doesn't repeat in {name}: its columns can be brought in as they are")
    made = [F.count(F.lit(1)).alias(f"{name}__count"), *[f(c).alias(f"{name}__{c}__{n}") for c in numbers for n, f in (("sum", F.sum), ("mean", F.avg))]]
    groups = child.where(F.col(child_key).isNotNull()).groupBy(key_text(F.col(child_key)).alias("_key")).agg(*made)
    out = base.withColumn("_key", key_text(F.col(key))).join(groups, "_key", "left").drop("_key")
    return out.withColumn(f"{name}__count", F.coalesce(f"{name}__count", F.lit(0)))
