"""Dirty data: findings for review, and repairs that change only what was reviewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import number_in_text, squeezed, strip

# Marks that texts may hold without being findings.
ALLOWED_MARKS = " .,-_'\"()/:;@"


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def duplicate_groups(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(row, group_first): all rows of groups equal in all ``columns``; a group is named by its least row."""
    groups = df.groupBy(*columns).agg(F.min(row).alias("group_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = None
    a, b = df.alias("a"), groups.alias("b")
    for c in columns:
        test = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        same = test if same is None else same & test
    return a.join(b, same).select(F.col(f"a.{row}").alias("row"), "group_first")


def drop_duplicates_keep_first(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """The row of least number of each group of equal rows. Groups meet by a partial minimum, not by a window over them."""
    first = df.groupBy(*columns).agg(F.min(row).alias(row)).select(row)
    return df.join(first, row, "left_semi")


def space_findings(df: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(column, row, value, suggested): texts with white space before or after."""
    cells = df.select(F.col(row).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("cell")).select("row", "cell.*")
    return cells.withColumn("suggested", strip(F.col("value"))).where("value <> suggested and suggested <> ''").select("column", "row", "value", "suggested")


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(strip(F.col(c)) != "", strip(F.col(c))).otherwise(F.col(c)) for c in columns})


def variant_map(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, canonical, n) for ``cells`` with a column ``value``: spellings that differ only by case or inner blanks, with
    the most frequent as canonical; ties go to mixed case, then by code point. Only spellings that aren't it."""
    counts = cells.where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")).withColumn("_key", squeezed(F.col("value"))).where("_key <> ''")
    pure = ((F.col("value") == F.upper("value")) | (F.col("value") == F.lower("value"))).cast("int")
    place = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(F.desc("n"), pure, "value"))
    best = counts.withColumn("_place", place).where("_place = 1").select(*by, "_key", F.col("value").alias("canonical"))
    return counts.join(best, [*by, "_key"]).where("value <> canonical").select(*by, "value", "canonical", "n")


def format_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("cell")).select("cell.*")
    return variant_map(cells, ["column"])


def apply_variants(df: DataFrame, column: str, variants: DataFrame) -> DataFrame:
    """Replace each spelling by its canonical one."""
    side = variants.select(F.col("value").alias(column), "canonical")
    return df.join(side, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical").select(*df.columns)


def cross_table_variants(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, value, canonical, n): one canonical spelling over columns of several tables that hold the same kind of value."""
    cells = None
    for name, (df, column) in tables.items():
        some = df.select(F.lit(name).alias("table"), F.col(column).alias("value"))
        cells = some if cells is None else cells.unionByName(some)
    canonical = variant_map(cells.select("value")).drop("n")
    return cells.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).join(canonical, "value").select("table", "value", "canonical", "n")


def special_characters(df: DataFrame, columns: Sequence[str], allowed: str = ALLOWED_MARKS) -> DataFrame:
    """(column, mark, n): occurrences of characters that are neither letters, digits, white space nor allowed."""
    keep = "".join(f"\\x{ord(c):02x}" for c in allowed)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("cell")).select("cell.*")
    marks = cells.select("column", F.explode(F.regexp_extract_all("value", F.lit(rf"(?U)[^\p{{L}}\p{{N}}\s{keep}]"), F.lit(0))).alias("mark"))
    return marks.groupBy("column", "mark").agg(F.count(F.lit(1)).alias("n"))


def remove_characters(df: DataFrame, column: str, marks: str) -> DataFrame:
    return df.withColumn(column, F.translate(column, marks, ""))


def numbers_as_text(df: DataFrame, row: str, column: str, least_share: float = 0.9) -> DataFrame:
    """(row, value, number): cells to convert, if at least three texts are there and ``least_share`` of them stand for numbers.
    Cells that are plain numbers already aren't findings."""
    cells = df.where(strip(F.col(column)) != "").select(F.col(row).alias("row"), F.col(column).alias("value"), number_in_text(F.col(column)).alias("number"))
    fit = cells.agg(((F.count("number") >= least_share * F.count(F.lit(1))) & (F.count(F.lit(1)) >= 3)).alias("_fit"))
    return cells.join(F.broadcast(fit)).where("_fit and number is not null and try_cast(value as double) is null").select("row", "value", "number")


def convert_numbers(df: DataFrame, column: str) -> DataFrame:
    """The column as numbers if every cell stands for one; else the cells that do are rewritten and it stays text."""
    left = df.agg(F.count(F.when(F.col(column).isNotNull() & number_in_text(F.col(column)).isNull(), 1)).alias("n")).first()["n"]
    number = number_in_text(F.col(column))
    return df.withColumn(column, number if not left else F.coalesce(number.cast("string"), F.col(column)))


def change_summary(before: DataFrame, after: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """(column, changed): cells that differ on rows that are still there, and rows gone as ``(rows removed)``."""
    a, b = before.alias("a"), after.withColumn("_here", F.lit(1)).alias("b")
    both = a.join(b, F.col(f"a.{row}") == F.col(f"b.{row}"), "left")
    here = F.col("b._here").isNotNull()
    cells = [F.struct(F.lit(c).alias("column"), F.count(F.when(here & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1)).alias("changed")) for c in columns]
    cells.append(F.struct(F.lit("(rows removed)").alias("column"), F.count(F.when(~here, 1)).alias("changed")))
    return both.agg(F.array(*cells).alias("all")).select(F.inline("all"))
