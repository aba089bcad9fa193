"""Relations between tables inferred from names and values, and the tree of records around one record."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import written
from tidemark.functions.text import key_text
from tidemark.operators.relational import Edge, key_profile

# Parts of names that mark a key.
KEY_PARTS = ("id", "key", "pk", "fk", "codigo", "code", "numero", "nro", "rut", "folio")


#: Columns' names aside, so much of the smaller column's values must be in the other, unless both look like keys.
LEAST_OVERLAP = 0.15
#: Values in a column's sample, and how far an overlap told by samples may be off.
SAMPLED_VALUES, MARGIN = 1_024, 0.1


def name_parts(name: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return [p for p in re.split(r"[^0-9a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", plain).lower()) if p]


def looks_like_key(name: str) -> bool:
    return any(p in KEY_PARTS or p.endswith("key") for p in name_parts(name))


def name_similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp likeness of names without marks; a common short table prefix doesn't count."""
    bare = lambda n: "".join(p for p in name_parts(n) if len(p) > 1) or n.lower()
    return difflib.SequenceMatcher(None, bare(a), bare(b)).ratio()


def _kind(t: str) -> str:
    return "number" if t in ("int", "bigint", "double", "float", "smallint") else "date" if t.startswith(("timestamp", "date")) else "text"


def infer_relations(tables: dict[str, DataFrame], least: float = 0.5, top: int = 3) -> DataFrame:
    """(table_a, column_a, table_b, column_b, name, overlap, confidence, cardinality): column pairs of two tables that look related.

    Names are compared on the driver, as they are metadata. Of columns of like type whose names are near enough, samples tell
    which may overlap enough (``sampled_overlaps``); the distinct values of these alone are compared: one table of them, grouped
    by value, counts all overlaps at once. Overlaps that are told are exact; a pair is left out by its sample with a chance of
    at most exp(-2 SAMPLED_VALUES MARGIN**2), some 1e-9. Confidence: 0.4 name + 0.5 overlap, 0.1 more if both look like keys."""
    names, candidates = sorted(tables), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for ca, ta in tables[a].dtypes:
                for cb, tb in tables[b].dtypes:
                    keys, name = looks_like_key(ca) + looks_like_key(cb), name_similarity(ca, cb)
                    if _kind(ta) == _kind(tb) != "date" and name >= {2: 0.5, 1: 0.6, 0: 0.35}[keys]:
                        candidates.append(((a, ca), (b, cb), keys, name))
    sampled = sampled_overlaps(tables, sorted({c for x, y, *_ in candidates for c in (x, y)}), [(x, y) for x, y, *_ in candidates])
    wanted = lambda keys, name: max(0.0 if keys == 2 else LEAST_OVERLAP, (least - 0.4 * name - 0.1 * (keys == 2)) / 0.5)
    candidates = [(x, y, keys, name) for x, y, keys, name in candidates if sampled[x, y] >= wanted(keys, name) - MARGIN]
    overlaps = value_overlaps(tables, sorted({c for x, y, *_ in candidates for c in (x, y)}))
    best: dict[tuple[str, str], list] = {}
    for x, y, keys, name in candidates:
        overlap = overlaps.get((x, y), 0.0)
        confidence = 0.4 * name + 0.5 * overlap + 0.1 * (keys == 2)
        if (overlap >= LEAST_OVERLAP or keys == 2) and confidence >= least:
            best.setdefault((x[0], y[0]), []).append((*x, *y, float(name), float(overlap), float(confidence)))
    unique: dict[tuple[str, str], bool] = {}

    def is_key(t: str, c: str) -> bool:
        if (t, c) not in unique:
            unique[t, c] = bool(key_profile(tables[t], c).first()["is_key"])
        return unique[t, c]

    found = []
    for pairs in best.values():
        for p in sorted(pairs, key=lambda p: -p[-1])[:top]:
            kind = {(True, True): "1-1", (True, False): "1-N", (False, True): "N-1", (False, False): "N-M"}[is_key(p[0], p[1]), is_key(p[2], p[3])]
            found.append((*p, kind))
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "table_a string, column_a string, table_b string, column_b string, name double, overlap double, confidence double, cardinality string")


def _cells(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], rates: Sequence[float] | None = None) -> DataFrame | None:
    """(k, v): values of the k-th (table, column) as lower-case trimmed text; of each, the share of ``rates`` that is least by hash."""
    out = None
    for table, df in tables.items():
        cells = []
        for k, (t, c) in enumerate(columns):
            if t == table:
                v = F.lower(F.trim(F.col(f"`{c}`").cast("string")))
                low = F.lit(True) if rates is None or rates[k] >= 1 else F.xxhash64(v) < F.lit(int((rates[k] - 0.5) * 2**64)).cast("long")
                cells.append(F.struct(F.lit(k).alias("k"), F.when(low, v).alias("v")))
        if cells:
            some = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v is not null")
            out = some if out is None else out.unionByName(some)
    return out


def sampled_overlaps(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], pairs: Sequence[tuple]) -> dict[tuple, float]:
    """About what ``value_overlaps`` gives for ``pairs`` of (table, column), without a shuffle of all values.

    Three passes over the columns: their numbers of different values, by sketch; of each, about ``SAMPLED_VALUES`` of these with
    the least hashes (all, if fewer); and which of them each partner holds, where a partner's values that are above all of
    its samples' hashes go before the join. The share of a sample that the partner holds is that of all its values, off by
    ``MARGIN`` with a chance of exp(-2 SAMPLED_VALUES MARGIN**2). Samples have a bounded number of rows."""
    if not pairs:
        return {}
    sizes: dict[int, int] = {}
    for table, df in tables.items():
        own = [(k, c) for k, (t, c) in enumerate(columns) if t == table]
        if own:
            found = df.agg(*[F.approx_count_distinct(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), 0.03).alias(f"n{k}") for k, c in own]).first()
            sizes |= {k: found[f"n{k}"] for k, _ in own}
    rates = [min(1.0, 1.25 * SAMPLED_VALUES / max(1, sizes[k])) for k in range(len(columns))]
    at = {c: k for k, c in enumerate(columns)}
    asked = [(at[x], at[y]) for x, y in pairs] + [(at[y], at[x]) for x, y in pairs]
    reach = [max((rates[a] for a, b in asked if b == k), default=0.0) for k in range(len(columns))]
    sample = written(_cells(tables, columns, rates).distinct(), "samples")
    n = {r["k"]: r["n"] for r in sample.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = _cells(tables, columns, reach).withColumnRenamed("k", "b").join(sample.withColumnRenamed("k", "a"), "v").where("a <> b").distinct()
    held = {(r["a"], r["b"]): r["n"] for r in met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda a, b: held.get((a, b), 0) / max(1, n.get(a, 0))
    return {(x, y): max(share(at[x], at[y]), share(at[y], at[x])) for x, y in pairs}


def value_overlaps(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> dict[tuple, float]:
    """Common distinct values (lower-case trimmed text) over the fewer, for each pair of (table, column), from one pass over each
    table: distinct (column, value) meet by value, and each value counts for all pairs of the columns that have it. A value
    meets as many rows as there are columns, and the result has as many as pairs of columns."""
    values = _cells(tables, columns)
    if values is None:
        return {}
    sets = values.distinct().groupBy("v").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    pair = F.explode(F.flatten(F.transform("ks", lambda x: F.transform(F.filter("ks", lambda y: y >= x), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p")
    n = {(r["x"], r["y"]): r["n"] for r in sets.select(pair).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for (x, y), both in n.items():
        share = both / min(n[x, x], n[y, y])
        out[columns[x], columns[y]] = out[columns[y], columns[x]] = share
    return out


def primary_column(edges: Sequence[Edge], table: str) -> str | None:
    named = [e.parent_key for e in edges if e.parent == table]
    return max(sorted(set(named)), key=named.count) if named else None


def _reached(edges: Sequence[Edge], table: str, step) -> set[str]:
    found, todo = set(), [table]
    while todo:
        for other in step(todo.pop()):
            if other not in found and other != table:
                found.add(other)
                todo.append(other)
    return found


def ancestors(edges: Sequence[Edge], table: str) -> set[str]:
    """Tables that this one points to, and those that they point to."""
    return _reached(edges, table, lambda t: [e.parent for e in edges if e.child == t])


def descendants(edges: Sequence[Edge], table: str) -> set[str]:
    """Tables that point to this one, and those that point to them."""
    return _reached(edges, table, lambda t: [e.child for e in edges if e.parent == t])


def sentence(edges: Sequence[Edge], table: str) -> str:
    """The table's direct neighbours in words."""
    up, down = sorted({e.parent for e in edges if e.child == table}), sorted({e.child for e in edges if e.parent == table})
    parts = ([f"takes what it knows from {', '.join(up)}"] if up else []) + ([f"gives it to {', '.join(down)}"] if down else [])
    return f"{table} {' and '.join(parts) or 'stands alone'}."


def usable_edges(relations: DataFrame) -> list[Edge]:
    """Relations whose direction the data tell (1-N and N-1), as edges from child to parent."""
    rows = relations.where(F.col("cardinality").isin("1-N", "N-1")).collect()
    return [Edge(r["table_b"], r["column_b"], r["table_a"], r["column_a"]) if r["cardinality"] == "1-N" else Edge(r["table_a"], r["column_a"], r["table_b"], r["column_b"]) for r in rows]


def lineage(tables: dict[str, DataFrame], edges: Sequence[Edge], table: str, key: str, value, depth: int = 2, branches: int = 8, most: int = 60) -> DataFrame:
    """(level, direction, table, key, value, parent_table, parent_value): records up and down from one record, ``branches`` at most of
    each node and edge, ``most`` in all; the limits are the feature, as the tree is for reading. A record is told once, where it
    is met first: in order of the level before it, of the edges, and of its value.

    All nodes of a level are joined at once: one job a level, whatever the nodes. The front, at most ``most`` records, is
    broadcast, and so are the keys that it leads to, at most ``branches`` a node."""
    spark = tables[table].sparkSession
    rows = [(0, "root", table, key, str(value), None, None)]
    front = [(table, key, str(value))]
    for level in range(1, depth + 1):
        parts = []
        for t, k in dict.fromkeys((t, k) for t, k, _ in front):
            nodes = spark.createDataFrame([(pos, v) for pos, (t2, k2, v) in enumerate(front) if (t2, k2) == (t, k)], "_pos int, _v string")
            here = tables[t].withColumn("_own", key_text(F.col(k))).join(F.broadcast(nodes), F.col("_own") == F.col("_v"))
            for no, e in enumerate(edges):
                if e.parent == t and e.child in tables:
                    link, other, theirs, own, way = e.parent_key, e.child, e.child_key, primary_column(edges, e.child) or e.child_key, "child"
                elif e.child == t and e.parent in tables:
                    link, other, theirs, own, way = e.child_key, e.parent, e.parent_key, e.parent_key, "parent"
                else:
                    continue
                keys = _first(here.select("_pos", "_v", key_text(F.col(link)).alias("_key")).where("_key is not null"), "_key", branches)
                names = tables[other].select(key_text(F.col(theirs)).alias("_key"), key_text(F.col(own)).alias("value"))
                hit = _first(names.where("value is not null").join(F.broadcast(keys), "_key").select("_pos", "_v", "value"), "value", branches)
                parts.append(hit.select(F.lit(way).alias("direction"), F.lit(other).alias("table"), F.lit(own).alias("key"), "value", F.lit(t).alias("parent_table"), F.col("_v").alias("parent_value"), "_pos", F.lit(no).alias("_edge")))
        if not parts or len(rows) >= most:
            break
        seen = spark.createDataFrame([(r[2], r[4]) for r in rows], "table string, value string")
        met = reduce(DataFrame.unionByName, parts).join(F.broadcast(seen), ["table", "value"], "left_anti")
        order = ["_pos", "_edge", "value"]
        once = met.withColumn("_k", F.row_number().over(Window.partitionBy("table", "value").orderBy(*order))).where("_k = 1")
        found = once.orderBy(*order).limit(most - len(rows)).select("direction", "table", "key", "value", "parent_table", "parent_value").collect()
        rows += [(level, *r) for r in found]
        front = [(r["table"], r["key"], r["value"]) for r in found]
        if not front:
            break
    return spark.createDataFrame(rows, "level int, direction string, table string, key string, value string, parent_table string, parent_value string")


def _first(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Of each ``_pos``, the ``n`` least different values of a column."""
    least = Window.partitionBy("_pos").orderBy(column)
    return rows.distinct().withColumn("_k", F.row_number().over(least)).where(F.col("_k") <= n).drop("_k")
