"""Anomalies: rules, order of dates, robust outliers globally and by segment, missing cells, duplicates, drift, and many columns at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.pvalues import correlation_p, fisher_p
from tidemark.functions.scratch import written
from tidemark.operators.indicators import duplicate_count, missing_profile
from tidemark.operators.ordered import average_ranks, quantiles, running_sums

Z, LEAST_ROWS = 3.0, 10
SCALE = 0.6745
#: A finding is grave above these shares of rows.
GRAVE_ROWS, GRAVE_MISSING = 0.02, 0.15


def rule_breaks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, rows, percent, severity) of rules that some rows break; all rules in one pass."""
    cells = [F.struct(F.lit(k).alias("rule"), F.count(F.when(~F.coalesce(c, F.lit(True)), 1)).alias("rows")) for k, c in rules.items()]
    out = df.agg(F.array(*cells).alias("all"), F.count(F.lit(1)).alias("_n")).select(F.inline("all"), "_n").where("rows > 0")
    return out.select("rule", "rows", (F.col("rows") * 100.0 / F.col("_n")).alias("percent"), F.when(F.col("rows") > GRAVE_ROWS * F.col("_n"), "high").otherwise("medium").alias("severity"))


def date_order_breaks(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose later date is before the earlier one, for each pair (earlier, later)."""
    return rule_breaks(df, {f"{a} > {b}": ~(F.col(b) < F.col(a)) for a, b in pairs})


def severity(z: Column) -> Column:
    """By how far beyond the threshold."""
    a = F.abs(z)
    return F.when(a >= 3 * Z, "extreme").when(a >= 2 * Z, "high").when(a >= 1.3 * Z, "medium").otherwise("low")


def robust_statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, median, mad): exact, by two selections."""
    by = list(by)
    x = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_x"))
    middle = quantiles(x, {"x": F.col("_x")}, [0.5], by)
    centre = written(middle.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(by)], F.col("n").alias("_n"), F.col("q")[0].alias("_median")), "medians")
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(by)]
    off = x.join(centre, same) if by else x.join(F.broadcast(centre))  # one row
    gap = {"x": F.abs(F.col("_x") - F.col("_median"))}
    if not by:
        spread = quantiles(off, gap, [0.5]).select(F.col("q")[0].alias("mad"))
        return centre.join(F.broadcast(spread)).select(F.col("_n").alias("n"), F.col("_median").alias("median"), "mad")
    spread = quantiles(off, gap, [0.5], [*by, "_n", "_median"])
    return spread.select(*by, F.col("_n").alias("n"), F.col("_median").alias("median"), F.col("q")[0].alias("mad"))


def robust_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows with |z| > 3, z = 0.6745 (x - median) / MAD, and columns z and severity; none under 10 values or where MAD is 0."""
    s = robust_statistics(df, column).where((F.col("n") >= LEAST_ROWS) & (F.col("mad") > 0)).select(F.col("median").alias("_m"), F.col("mad").alias("_d"))
    z = SCALE * (F.col(column) - F.col("_m")) / F.col("_d")
    return df.join(F.broadcast(s)).withColumn("z", z).where(F.abs("z") > Z).withColumn("severity", severity(F.col("z"))).drop("_m", "_d")


def segment_spread(df: DataFrame, column: str, candidates: Sequence[str], least_group: int = 5) -> DataFrame:
    """(segment, coverage, reduction): by how much MAD over |median| falls, weighted by rows, within each candidate's groups of
    ``least_group`` rows or more; candidates have more than one value and no more than 30 % of the rows."""
    n, *distinct = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)), *[F.count_distinct(c) for c in candidates]).first()
    usable = [c for c, d in zip(candidates, distinct, strict=True) if 1 < d <= max(2, 0.3 * n)]
    spread = lambda m, d: F.when(m != 0, d / F.abs(m)).otherwise(d)
    whole = robust_statistics(df, column).select(spread(F.col("median"), F.col("mad")).alias("_whole"))
    out = None
    for c in usable:
        s = robust_statistics(df, column, [c]).where(F.col("n") >= least_group).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * spread(F.col("median"), F.col("mad"))) / F.sum("n")).alias("_within"))
        one = s.join(F.broadcast(whole)).select(F.lit(c).alias("segment"), (F.col("_n") / float(n)).alias("coverage"), (1 - F.try_divide(F.col("_within"), F.col("_whole"))).alias("reduction"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "segment string, coverage double, reduction double")


def choose_segment(df: DataFrame, column: str, candidates: Sequence[str]) -> str | None:
    best = segment_spread(df, column, candidates).where("coverage >= 0.5 and reduction >= 0.3").orderBy(F.desc("reduction"), "segment").first()
    return best["segment"] if best else None


def segmented_outliers(df: DataFrame, column: str, segment: str, least_group: int = 5) -> DataFrame:
    """Outliers against their segment's median and MAD; small segments and those whose MAD is 0 fall back to the whole."""
    own = robust_statistics(df, column, [segment]).where((F.col("n") >= least_group) & (F.col("mad") > 0)).select(segment, F.col("median").alias("_m"), F.col("mad").alias("_d"))
    whole = robust_statistics(df, column).select(F.col("median").alias("_wm"), F.col("mad").alias("_wd"))
    rows = df.join(own, segment, "left").join(F.broadcast(whole))
    m, d = F.coalesce("_m", "_wm"), F.coalesce("_d", F.when(F.col("_wd") > 0, F.col("_wd")))
    return rows.withColumn("z", SCALE * (F.col(column) - m) / d).where(F.abs("z") > Z).withColumn("severity", severity(F.col("z"))).drop("_m", "_d", "_wm", "_wd")


def missing_anomalies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = missing_profile(df, columns).where("percent >= 1")
    return out.withColumn("severity", F.when(F.col("percent") > 100 * GRAVE_MISSING, "high").otherwise("medium"))


def duplicate_anomaly(df: DataFrame) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = duplicate_count(df).join(F.broadcast(n)).where("duplicates > 0")
    return out.select("duplicates", (F.col("duplicates") * 100.0 / F.col("_n")).alias("percent"), F.when(F.col("duplicates") > GRAVE_ROWS * F.col("_n"), "high").otherwise("medium").alias("severity"))


def update_baseline(state: DataFrame, df: DataFrame, columns: Sequence[str], alpha: float = 0.3) -> DataFrame:
    """(column, mean, var, n): exponentially weighted mean and variance of each column's mean; new columns start at theirs."""
    cells = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias("x")) for c in columns]
    now = df.agg(F.array(*cells).alias("all")).select(F.inline("all")).where("x is not null")
    both = state.join(now, "column", "full")
    step = F.col("x") - F.col("mean")
    fresh = F.col("mean").isNull()
    return both.select(
        "column",
        F.when(fresh, F.col("x")).when(F.col("x").isNull(), F.col("mean")).otherwise(alpha * F.col("x") + (1 - alpha) * F.col("mean")).alias("mean"),
        F.when(fresh, 0.0).when(F.col("x").isNull(), F.col("var")).otherwise(alpha * step * step + (1 - alpha) * F.col("var")).alias("var"),
        (F.coalesce("n", F.lit(0)) + F.col("x").isNotNull().cast("int")).cast("long").alias("n"),
    )


def baseline_drift(state: DataFrame, df: DataFrame, columns: Sequence[str], sigmas: float = 3.0, least: int = 5) -> DataFrame:
    """(column, x, mean): columns whose mean is more than three deviations off a baseline of five snapshots or more."""
    cells = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias("x")) for c in columns]
    now = df.agg(F.array(*cells).alias("all")).select(F.inline("all"))
    return now.join(state, "column").where((F.col("n") >= least) & (F.abs(F.col("x") - F.col("mean")) > sigmas * F.sqrt("var"))).select("column", "x", "mean")


class IsolationForest:
    """Trees of random splits over small samples; the depth at which a row is alone tells how odd it is. The forest is as
    large as its trees' samples, whatever the table's size, and is fitted on a bounded sample chosen by hash."""

    def __init__(self, sample: np.ndarray, trees: int = 150, size: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.limit = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng) -> list[tuple]:
        """Nodes as (column, cut, left, right) or (-1, expected rest of depth, 0, 0), numbered as they are made."""
        nodes: list = [None]
        todo = [(0, rows, 0)]
        while todo:
            at, x, depth = todo.pop()
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if depth >= self.limit or len(spread) == 0:
                nodes[at] = (-1, depth + self.expected(len(x)), 0, 0)
                continue
            k = int(rng.choice(spread))
            cut = rng.uniform(x[:, k].min(), x[:, k].max())
            nodes[at] = (k, cut, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), x[x[:, k] < cut], depth + 1), (len(nodes) + 1, x[x[:, k] >= cut], depth + 1)]
            nodes += [None, None]
        return nodes

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for nodes in self.trees:
            kind, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), dtype=int)
            while (inner := kind[at] >= 0).any():
                rows = np.flatnonzero(inner)
                n = at[rows]
                at[rows] = np.where(x[rows, kind[n]] < cut[n], left[n], right[n])
            depth += cut[at]
        return 2.0 ** (-depth / len(self.trees) / max(self.expected(self.size), 1e-9))


def multivariate_outliers(df: DataFrame, row: str, columns: Sequence[str], contamination: float = 0.02, sample_rows: int = 20_000, accuracy: int = 10_000) -> DataFrame:
    """(row, score): the share of rows that an isolation forest finds oddest. The forest comes from ``sample_rows`` rows at
    most; every row without missing cells is scored, and the threshold is a quantile of all scores."""
    rows = df.select(F.col(row).alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).toPandas()
    if len(sample) < 50:
        return rows.select("row", F.lit(0.0).alias("score")).limit(0)
    forest = IsolationForest(sample[list(columns)].to_numpy())

    @F.pandas_udf("double")
    def score(table: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(table.to_numpy(dtype=float)))

    scored = rows.select("row", score(F.struct(*columns)).alias("score"))
    bar = scored.agg(F.percentile_approx("score", 1 - contamination, accuracy).alias("_bar"))
    return scored.join(F.broadcast(bar)).where("score > _bar").select("row", "score")


def responsible_columns(df: DataFrame, rows: DataFrame, row: str, columns: Sequence[str], n: int = 2) -> DataFrame:
    """(row, columns): for each anomalous row, the columns with the greatest robust z; 10 where MAD is 0 and the cell isn't the median."""
    stats = None
    for c in columns:
        s = robust_statistics(df, c).select(F.col("median").alias(f"_m_{c}"), F.col("mad").alias(f"_d_{c}"))
        stats = s if stats is None else stats.join(F.broadcast(s))
    z = lambda c: F.when(F.col(f"_d_{c}") > 0, F.abs(SCALE * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}"))).when(F.col(c) != F.col(f"_m_{c}"), 10.0).otherwise(0.0)
    found = df.join(rows.select(F.col("row").alias(row)), row).join(F.broadcast(stats))
    order = F.array_sort(F.array(*[F.struct((-z(c)).alias("z"), F.lit(c).alias("c")) for c in columns]))
    return found.select(F.col(row).alias("row"), F.slice(order, 1, n)["c"].alias("columns"))


def strength(r: float) -> str:
    return "very strong" if abs(r) >= 0.8 else "strong" if abs(r) >= 0.65 else "moderate"


def spearman_pairs(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r): rank correlations of all pairs over the rows that have both; ranks are taken anew within those rows.

    Columns without nulls are ranked together, by column, and one pass over their ranks gives all correlations among them; only
    pairs with nulls are ranked by themselves."""
    got = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    whole = [c for k, c in enumerate(columns) if got[f"c{k}"] == got["_n"]]
    parts = []
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    together = [(a, b) for a, b in pairs if a in whole and b in whole]
    if together:
        cell = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in whole])).alias("_cell")
        ranked = average_ranks(df.select(F.col(row).alias("_row"), cell).select("_row", "_cell.*"), "_x", "_r", by=["_column"])
        lines = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_column") == c, F.col("_r"))).alias(f"r{k}") for k, c in enumerate(whole)])
        rs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("n"), F.corr(f"r{whole.index(a)}", f"r{whole.index(b)}").alias("r")) for a, b in together])
        parts.append(lines.agg(rs.alias("all")).select(F.inline("all")))
    for a, b in pairs:
        if (a, b) not in together:
            both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(row, F.col(a).alias("_a"), F.col(b).alias("_b"))
            ranked = average_ranks(average_ranks(both, "_a", "_ra"), "_b", "_rb")
            parts.append(ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("r")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "r"))
    return reduce(DataFrame.unionByName, parts)


def significant_correlations(df: DataFrame, row: str, columns: Sequence[str], least: float = 0.5, top: int = 8) -> list[dict]:
    """The strongest pairs whose p is under 0.05 over the number of all pairs."""
    pairs = spearman_pairs(df, row, columns).collect()
    found = [p.asDict() | {"p": correlation_p(p["r"], p["n"]), "strength": strength(p["r"])} for p in pairs if p["n"] >= LEAST_ROWS and p["r"] is not None and abs(p["r"]) >= least]
    return sorted((p for p in found if p["p"] < 0.05 / len(pairs)), key=lambda p: -abs(p["r"]))[:top]


def cooccurrence(anomaly_rows: DataFrame, total: int, least: int = 3) -> DataFrame:
    """(a, b, n_a, n_b, both, lift) of pairs of columns by anomalous rows (columns ``column`` and ``row``)."""
    marks = anomaly_rows.select("column", "row").distinct()
    counts = marks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = marks.join(F.broadcast(counts), "column")  # a row a column
    # Rows with many marked columns are rare, and a row has no more marks than the table has columns.
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("column", "n"))).alias("m"))
    pair = F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["column"] > x["column"]), lambda y: F.struct(x["column"].alias("a"), y["column"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b")))))).alias("p")
    both = lists.select(pair).groupBy("p.a", "p.b", "p.n_a", "p.n_b").agg(F.count(F.lit(1)).alias("both"))
    return both.withColumn("lift", F.col("both") * float(total) / (F.col("n_a") * F.col("n_b")))


def significant_cooccurrence(anomaly_rows: DataFrame, total: int, top: int = 8) -> list[dict]:
    pairs = cooccurrence(anomaly_rows, total)
    n_columns = anomaly_rows.groupBy("column").agg(F.count_distinct("row").alias("n")).where("n >= 3").count()
    tests = max(n_columns * (n_columns - 1) // 2, 1)
    found = [p.asDict() | {"p": fisher_p(p["both"], p["n_a"], p["n_b"], total)} for p in pairs.where("lift > 1").collect()]
    return sorted((p for p in found if p["p"] < 0.05 / tests), key=lambda p: -p["lift"])[:top]


def regime_shift(df: DataFrame, order: str, column: str, tie: str, least_rows: int = 20, least_share: float = 0.1) -> DataFrame:
    """Pettitt's test of one column in order of a number: n, k (position of the break), u (its statistic), p, and the medians
    before and after; no row under ``least_rows`` values, or if a side of the break has under ``least_share`` of them. Ranks and their running sums go by ranges of the order, so no task gets the whole column."""
    rows = df.where(F.col(column).isNotNull()).select(order, tie, F.col(column).alias("_x"))
    ranked = average_ranks(rows, "_x", "_r")
    summed = running_sums(ranked, order, {"_t": F.lit(1), "_s": F.col("_r")}, [tie])
    total = summed.agg(F.count(F.lit(1)).alias("n"))
    placed = written(summed.join(F.broadcast(total)), "pettitt").withColumn("u", 2 * F.col("_s") - F.col("_t") * (F.col("n") + 1))
    best = placed.agg(F.max_by(F.struct(F.col("_t").alias("k"), F.col("u").alias("u"), F.col("n").alias("n")), F.struct(F.abs("u"), -F.col("_t"))).alias("b")).select("b.*")
    side = placed.select("_t", "_x").join(F.broadcast(best.select("k")))
    parts = quantiles(side, {"before": F.when(F.col("_t") <= F.col("k"), F.col("_x")), "after": F.when(F.col("_t") > F.col("k"), F.col("_x"))}, [0.5])
    medians = parts.agg(*[F.max(F.when(F.col("column") == k, F.col("q")[0])).alias(k) for k in ("before", "after")])
    n, u = F.col("n").cast("double"), F.col("u")
    enough = (n >= least_rows) & (F.col("k") >= least_share * n) & (n - F.col("k") >= least_share * n)
    return best.join(F.broadcast(medians)).where(enough).withColumn("p", F.least(F.lit(1.0), 2 * F.exp(-6 * u * u / (n * n * n + n * n))))
