"""Workbooks (.xlsx, .xlsm): the file's bytes are read by Spark from any store, and a task reads the sheet's cells in a stream."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import _chosen

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of dates that need no definition in the file.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
ROWS_A_BATCH = 10_000


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Each sheet's name and the part that holds it."""
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    named = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + parts[s.get(RELATION)].removeprefix("/xl/").removeprefix("xl/") for s in named}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of cell styles that show dates: known formats, and own ones that have day, month or year outside of quotes."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search(r"[dmyh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or ""), re.IGNORECASE)}
    cells = root.find(f"{MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(c, shared: list[str], dates: set[int]):
    kind, v = c.get("t"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return _text(c)
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "str":
        return v.text
    number = float(v.text)
    if int(c.get("s") or 0) in dates:
        return dt.datetime(1899, 12, 30) + dt.timedelta(microseconds=round(number * 86_400_000_000))
    return int(number) if number.is_integer() and abs(number) < 2**53 else number


def cells(data: bytes, sheet: str | None) -> Iterator[list]:
    """A sheet's rows as lists of cells: the only sheet, or the one named."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        sheets = _sheets(book)
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        with book.open(sheets[sheet] if sheet else next(iter(sheets.values()))) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag == f"{MAIN}row":
                    out: list = []
                    for k, c in enumerate(row.iter(f"{MAIN}c")):
                        at = _column(c.get("r")) if c.get("r") else k
                        out += [None] * (at + 1 - len(out))
                        out[at] = _cell(c, shared, dates)
                    yield out
                    row.clear()


def _kind(seen: set[type]) -> str:
    if seen <= {int} and seen:
        return "bigint"
    if seen and seen <= {int, float}:
        return "double"
    return {frozenset({bool}): "boolean", frozenset({dt.datetime}): "timestamp_ntz"}.get(frozenset(seen), "string")


def _profile(batches):
    """(sheets, names and kinds of the columns) of each file, the kinds from all of its cells."""
    for batch in batches:
        for data, sheet in zip(batch.column("content").to_pylist(), batch.column("sheet").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(data)) as book:
                names = list(_sheets(book))
            header, seen = [], []
            if sheet in names or sheet is None and len(names) == 1:
                rows = cells(data, sheet)
                header = [str(c) if c is not None else f"column {k + 1}" for k, c in enumerate(next(rows, []))]
                seen = [set() for _ in header]
                for row in rows:
                    for k, v in enumerate(row[: len(header)]):
                        if v is not None:
                            seen[k].add(type(v))
            yield pa.RecordBatch.from_pydict({"sheets": pa.array([names], pa.list_(pa.string())), "names": pa.array([header], pa.list_(pa.string())), "kinds": pa.array([[_kind(s) for s in seen]], pa.list_(pa.string()))})


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet: the only one or the one named; its first row names the columns, empty names are ``column k``, repeated ones get a
    number. Columns of whole numbers, numbers, truth values or dates are such, others texts; cells with errors are null. A
    sheet has at most 1,048,576 rows, so one task reads it; the driver gets only its names and kinds."""
    from tidemark.sources.files import free_name

    book = spark.read.format("binaryFile").load(path).select("content", F.lit(sheet).cast("string").alias("sheet"))
    found = book.mapInArrow(_profile, "sheets array<string>, names array<string>, kinds array<string>").first()
    sheet = _chosen(list(found["sheets"]), sheet, path)
    names: list[str] = []
    for n in found["names"]:
        names.append(free_name(n, names))
    kinds = list(found["kinds"])
    if not names:
        return spark.createDataFrame([], "")
    types = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string()}
    casts = {"string": lambda v: v if isinstance(v, str) else str(v), "double": float}

    def table(batches):
        def batch(rows):
            columns = [[casts.get(k, lambda v: v)(r[i]) if i < len(r) and r[i] is not None else None for r in rows] for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names)

        for some in batches:
            for data in some.column("content").to_pylist():
                rows, now = cells(data, sheet), []
                next(rows, None)
                for row in rows:
                    if any(v is not None for v in row):
                        now.append(row)
                    if len(now) == ROWS_A_BATCH:
                        yield batch(now)
                        now = []
                if now:
                    yield batch(now)

    return book.mapInArrow(table, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True)))
