"""Tables from files: the reader by extension, CSV of unknown encoding and separator, edits of cells, and refreshing."""

from __future__ import annotations

import csv
import os
from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_sql_script, read_sqlite
from tidemark.sources.workbooks import read_workbook

SEPARATORS = ",;\t|"
# Words of an edited cell that mean true.
TRUE_WORDS = ("1", "true", "verdadero", "si", "sí", "x")
BOM = "﻿"


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid in it, else latin-1, in which any byte is. The lines are checked in tasks."""
    lines = spark.read.text(path)
    return "ISO-8859-1" if lines.where(~F.is_valid_utf8("value")).limit(1).count() else "UTF-8"


def sniff_separator(lines: list[str]) -> str:
    """The separator that cuts all of these lines into as many fields as the first one, the most of them; else a comma."""
    best, most = ",", 1
    for sep in SEPARATORS:
        sizes = [len(row) for row in csv.reader(lines, delimiter=sep) if row]
        if sizes and sizes[0] > most and all(n == sizes[0] for n in sizes):
            best, most = sep, sizes[0]
    return best


def read_csv(spark: SparkSession, path: str, multiline: bool = False, **options) -> DataFrame:
    """A CSV with a header. Encoding and separator are found first unless given; ``multiline`` allows line breaks within
    quotes, at the cost of one task a file. An empty file is an error."""
    encoding = options.pop("encoding", None) or sniff_encoding(spark, path)
    head = [r.value for r in spark.read.schema("value string").csv(path, sep="\0", quote="", encoding=encoding).limit(20).collect() if r.value]
    if not head:
        raise ValueError(f"{path} holds no lines")
    head[0] = head[0].removeprefix(BOM)
    sep = options.pop("sep", None) or sniff_separator(head)
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding, multiLine=multiline, escape='"', **options)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def read_table(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The table of a file, by its extension; ``table`` names one of several tables or sheets."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".csv", ".txt", ".tsv"):
        return read_csv(spark, path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".xlsx", ".xlsm"):
        return read_workbook(spark, path, table)
    if kind == ".sql":
        return read_sql_script(spark, path, table)
    if kind in (".sqlite", ".sqlite3", ".db"):
        return read_sqlite(spark, path, table)
    raise ValueError(f"no reader for {kind or path}: give CSV, Excel, Parquet, an SQL script or an SQLite file")


def free_name(name: str, taken: Collection[str]) -> str:
    """``name``, or ``name (2)``, ``name (3)`` and so on, whichever is the first that isn't taken."""
    free, k = name, 2
    while free in taken:
        free, k = f"{name} ({k})", k + 1
    return free


def cast_edit(text: Column, kind: str) -> Column:
    """An edited cell's text as a value of ``kind``; '' is null, as is what doesn't fit. A decimal comma is a point; integers
    lose their fraction; truth is one of six words; dates are read day first."""
    given = F.when(text != "", text)
    number = F.replace(given, F.lit(","), F.lit(".")).try_cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return number.try_cast(kind)
    if kind in ("float", "double") or kind.startswith("decimal"):
        return number.try_cast(kind)
    if kind == "boolean":
        return F.lower(F.trim(given)).isin(*TRUE_WORDS)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        parts = F.regexp_replace(given, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", "$3-$2-$1")
        return parts.try_cast(kind)
    return given


@dataclass(frozen=True)
class Source:
    """Where a table came from; secrets aren't part of it but given anew to ``read``."""

    kind: str  # file, jdbc or http
    where: str
    table: str | None = None
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, **secrets) -> DataFrame:
        from tidemark.sources.tables import read_http, read_jdbc

        if self.kind == "file":
            return read_table(spark, self.where, self.table)
        return {"jdbc": read_jdbc, "http": read_http}[self.kind](spark, self.where, self.table, **self.options, **secrets)


def refreshed(project, table: str, spark: SparkSession, board=None, **secrets):
    """The project with a table read anew from its own recorded source. What was predicted of the table no longer holds and is
    discarded, on the board too; columns that were calculated from it are gone with the old rows. A table without a recorded
    source is an error, and a source that can't be read leaves all as it was."""
    known = project.sources.get(table)
    if not known:
        raise ValueError(f"{table} has no recorded source")
    fresh = Source(**{k: known[k] for k in ("kind", "where", "table", "options") if k in known}).read(spark, **secrets)
    project.tables[table] = fresh
    project.predictions.pop(table, None)
    if board is not None:
        board.discard(table)
    return project
