"""Features from related tables that never change the number of base rows and never look at the future."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import micros
from tidemark.functions.text import key_text
from tidemark.operators.ordered import strictly_before, trailing

DAY = 86_400_000_000


def is_unique(df: DataFrame, key: str) -> bool:
    """No known value of the key is on two rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count() == 0


def enrich(base: DataFrame, parent: DataFrame, key: str, parent_key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """The parent's columns as ``prefix.column`` by a left join; parent keys must be unique. Missing keys match nothing.

    No hint: Spark broadcasts the parent if its bytes are under ``spark.sql.autoBroadcastJoinThreshold``, by its statistics or,
    once it has run, by its real size, and else shuffles both sides and splits skewed keys."""
    side = parent.where(F.col(parent_key).isNotNull()).select(key_text(F.col(parent_key)).alias("_key"), *[F.col(c).alias(f"{prefix}.{c}") for c in columns])
    return base.withColumn("_key", key_text(F.col(key))).join(side, "_key", "left").drop("_key")


def resume(base: DataFrame, child: DataFrame, key: str, child_key: str, numbers: Sequence[str], categories: Sequence[str] = (), prefix: str = "child") -> DataFrame:
    """For each base row, the child's rows of its key: how many (0 if none), sum, mean, min and max of numbers, distinct values of categories."""
    made = [F.count(F.lit(1)).alias(f"{prefix}.count")]
    for c in numbers:
        made += [f(c).alias(f"{prefix}.{c}.{n}") for n, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    made += [F.count_distinct(c).alias(f"{prefix}.{c}.distinct") for c in categories]
    groups = child.where(F.col(child_key).isNotNull()).groupBy(key_text(F.col(child_key)).alias("_key")).agg(*made)
    out = base.withColumn("_key", key_text(F.col(key))).join(groups, "_key", "left").drop("_key")
    return out.withColumn(f"{prefix}.count", F.coalesce(F.col(f"`{prefix}.count`"), F.lit(0)))


def prior_resume(base: DataFrame, child: DataFrame, key: str, child_key: str, date: str, child_date: str, row: str, numbers: Sequence[str], categories: Sequence[str] = (), windows: Sequence[float] = (), prefix: str = "prior", window_numbers: Sequence[str] | None = None) -> DataFrame:
    """For each base row, what the child's rows of its key told strictly before its date; equal times don't count.

    Both tables go into one union, where a base row is carried whole, so no row is multiplied and none is joined back. What counts
    all earlier rows goes by ranges of keys and times (``ordered.strictly_before``), and trailing windows by buckets of time
    (``ordered.trailing``), so a key may hold most rows. Columns:
    count (0 if none), sum, mean, min, max of ``numbers``; ``days_since`` the last; the last value of ``categories`` (of equal
    times, that of the greatest value); and for each of ``windows`` (days) the count in the window, with sums of ``window_numbers``
    (all numbers) over the longest. Rows with a missing key or date get count 0 and nulls. ``row`` names base rows and isn't read.
    """
    base_rows = base.select(key_text(F.col(key)).alias("_k"), micros(F.col(date)).alias("_t"), F.struct("*").alias("_base"))
    child_rows = child.select(key_text(F.col(child_key)).alias("_k"), micros(F.col(child_date)).alias("_t"), *[F.col(c).cast("double").alias(f"_n_{c}") for c in numbers], *[F.col(c).alias(f"_c_{c}") for c in categories])
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    both = base_rows.where(known).unionByName(child_rows.where(known), allowMissingColumns=True)
    of_child = F.when(F.col("_base").isNull(), F.col("_t"))
    whole: dict[str, tuple[str, Column]] = {"_children": ("count", of_child), "_latest": ("max", of_child)}
    for c in numbers:
        whole |= {f"_{op}_{c}": (op, F.col(f"_n_{c}")) for op in ("sum", "count", "min", "max")}
    for c in categories:
        whole[f"_last_{c}"] = ("max", F.when(F.col("_base").isNull(), F.struct(F.col("_t"), F.col(f"_c_{c}").alias("v"))))
    past = strictly_before(both, "_k", "_t", whole)
    made: dict[str, Column] = {"count": F.col("_children")}
    for c in numbers:
        made |= {f"{c}.sum": F.col(f"_sum_{c}"), f"{c}.mean": F.try_divide(F.col(f"_sum_{c}"), F.col(f"_count_{c}")), f"{c}.min": F.col(f"_min_{c}"), f"{c}.max": F.col(f"_max_{c}")}
    made["days_since"] = (F.col("_t") - F.col("_latest")) / float(DAY)
    for c in categories:
        made[f"{c}.last"] = F.col(f"_last_{c}")["v"]
    for n in windows:
        of = {f"_count_{n:g}": F.count(of_child)}
        if n == max(windows):
            of |= {f"_recent_{c}": F.sum(f"_n_{c}") for c in (numbers if window_numbers is None else window_numbers)}
        past = trailing(past, "_k", "_t", int(n * DAY), of, F.col("_base").isNull())
        made[f"count_{n:g}d"] = F.col(f"_count_{n:g}")
        if n == max(windows):
            made |= {f"{c}.sum_{n:g}d": F.col(f"_recent_{c}") for c in (numbers if window_numbers is None else window_numbers)}
    found = past.where("_base is not null").select("_base.*", *[v.alias(f"{prefix}.{k}") for k, v in made.items()])
    out = found.unionByName(base_rows.where(~known).select("_base.*"), allowMissingColumns=True)
    for k in ["count", *[f"count_{n:g}d" for n in windows]]:
        out = out.withColumn(f"{prefix}.{k}", F.coalesce(F.col(f"`{prefix}.{k}`"), F.lit(0)))
    return out


def window_lengths(child: DataFrame, date: str) -> tuple[float, ...]:
    """Two trailing windows in days by the span of the child's dates."""
    got = child.agg(((F.max(micros(F.col(date))) - F.min(micros(F.col(date)))) / float(DAY)).alias("d")).first()["d"] or 0
    return (7, 30) if got >= 90 else (2, 7) if got >= 14 else (0.5, 1) if got >= 2 else ()


@dataclass(frozen=True)
class Edge:
    """``parent_key`` of ``parent`` is unique; ``child_key`` of ``child`` points to it."""

    child: str
    child_key: str
    parent: str
    parent_key: str


def enrich_chain(tables: dict[str, DataFrame], base: str, edges: Sequence[Edge], columns: dict[str, Sequence[str]], depth: int = 3) -> DataFrame:
    """The base with columns of its parents, their parents and so on up to ``depth`` hops, never a table twice on a path."""
    out, front, seen = tables[base], [(base, "")], {base}
    for _ in range(depth):
        following = []
        for table, path in front:
            for e in [e for e in edges if e.child == table and e.parent not in seen]:
                seen.add(e.parent)
                prefix = f"{path}{e.parent}"
                more = {x.child_key for x in edges if x.child == e.parent}
                wanted = list(dict.fromkeys([*columns.get(e.parent, ()), *more]))
                key = f"`{path.rstrip('.')}.{e.child_key}`" if path else e.child_key
                out = enrich(out, tables[e.parent], key, e.parent_key, wanted, prefix)
                following.append((e.parent, f"{prefix}."))
        front = following
    return out


def union_same_columns(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append by name, only where both have the same columns; else an error that names those missing on either side."""
    a, b = set(first.columns), set(second.columns)
    if a != b:
        raise ValueError(f"columns differ; only in the first: {sorted(a - b)}; only in the second: {sorted(b - a)}")
    return first.unionByName(second)


def pair_by_id(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Predictions with what happened, by a key that must be unique on both sides; compared as text where no pair meets."""
    for df in (predicted, actual):
        if not is_unique(df, key):
            raise ValueError(f"{key} repeats")
    met = predicted.join(actual, key)
    if met.limit(1).count():
        return met
    return predicted.withColumn("_key", key_text(F.col(key))).join(actual.withColumn("_key", key_text(F.col(key))).drop(key), "_key").drop("_key")


def value_overlap(first: DataFrame, a: str, second: DataFrame, b: str) -> DataFrame:
    """n_a, n_b, common distinct values as lower-case trimmed text, and common over the fewer."""
    values = lambda df, c: df.where(F.col(c).isNotNull()).select(F.lower(F.trim(F.col(c).cast("string"))).alias("v")).distinct()
    both = values(first, a).withColumn("_a", F.lit(1)).join(values(second, b).withColumn("_b", F.lit(1)), "v", "full")
    out = both.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.col("_a") + F.col("_b")).alias("common"))
    return out.withColumn("overlap", F.try_divide(F.col("common").cast("double"), F.least("n_a", "n_b")))


# Cells that stand for no key.
SENTINELS = ("", "0", "-1", "na", "n/a", "nan", "none", "null", "sin dato", "s/d", "-", "999", "9999")


def key_profile(df: DataFrame, column: str) -> DataFrame:
    """n, distinct, is_key: without missing cells, sentinels and the most frequent value where it repeats; a key from three
    values on if at least 95 % are distinct."""
    v = F.lower(F.trim(F.col(column).cast("string")))
    counts = df.where(F.col(column).isNotNull() & ~v.isin(list(SENTINELS))).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    out = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d"), F.coalesce(F.max("c"), F.lit(0)).alias("m"))
    drop = F.col("m") > 1
    out = out.select(F.when(drop, F.col("n") - F.col("m")).otherwise(F.col("n")).alias("n"), F.when(drop, F.col("d") - 1).otherwise(F.col("d")).alias("distinct_values"))
    return out.withColumn("is_key", (F.col("n") >= 3) & (F.col("distinct_values") >= 0.95 * F.col("n")))


def cardinality(first: DataFrame, a: str, second: DataFrame, b: str) -> str:
    one, two = (key_profile(d, c).first()["is_key"] for d, c in ((first, a), (second, b)))
    return {(True, True): "1-1", (True, False): "1-N", (False, True): "N-1", (False, False): "N-M"}[bool(one), bool(two)]


def unmatched(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """n, unmatched: child rows with a key and those whose key the parent doesn't have."""
    keys = parent.select(key_text(F.col(parent_key)).alias("_k")).distinct().withColumn("_in", F.lit(1))
    rows = child.where(F.col(key).isNotNull()).withColumn("_k", key_text(F.col(key))).join(keys, "_k", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_in").isNull(), 1)).alias("unmatched"))


def contagion(tables: dict[str, DataFrame], start: str, affected: DataFrame, edges: Sequence[Edge], hops: int = 5) -> DataFrame:
    """(level, table, parent, rows): child rows reached from the affected rows of ``start``, table by table.

    Each hop is a semi-join of the child with the keys just reached; keys seen before are taken out, so cycles end.
    """
    out: list[DataFrame] = []
    front, seen = [(start, affected)], {}
    for level in range(1, hops + 1):
        following = []
        for table, rows in front:
            for e in [e for e in edges if e.parent == table]:
                keys = rows.select(F.col(e.parent_key).alias(e.child_key)).where(F.col(e.child_key).isNotNull()).distinct()
                if e in seen:
                    keys = keys.join(seen[e], e.child_key, "left_anti")
                seen[e] = keys if e not in seen else seen[e].unionByName(keys)
                hit = tables[e.child].join(keys, e.child_key, "left_semi")
                out.append(hit.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(level).alias("level"), F.lit(e.child).alias("table"), F.lit(table).alias("parent"), "rows"))
                following.append((e.child, hit))
        front = following
        if not front:
            break
    return reduce(lambda a, b: a.unionByName(b), out).where("rows > 0")


def top_crossings(anomalous: DataFrame, key: str, parent: DataFrame, parent_key: str, label: str, n: int = 3) -> DataFrame:
    """The parents with most anomalous child rows, by name."""
    counts = anomalous.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(parent_key)).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), parent_key).limit(n)
    return parent.select(parent_key, label).join(F.broadcast(counts), parent_key)
