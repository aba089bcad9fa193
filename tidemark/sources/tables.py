"""Sources that Spark has no reader for, as Python data sources that run in tasks: SQLite files, SQL scripts, an HTTP
interface of tables. Databases are read over JDBC."""

from __future__ import annotations

import contextlib
import json
import sqlite3
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType


class SeveralTables(ValueError):
    """The file holds several tables and none was named."""

    def __init__(self, tables: list[str]):
        super().__init__(f"several tables, name one: {', '.join(tables)}")
        self.tables = tables


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _chosen(tables: list[str], table: str | None, path: str) -> str:
    if not tables:
        raise ValueError(f"{path} holds no table")
    if table is None and len(tables) > 1:
        raise SeveralTables(tables)
    if table is not None and table not in tables:
        raise ValueError(f"{path} holds no table {table}, but {', '.join(tables)}")
    return table or tables[0]


def _opened(path: str, script: bool) -> sqlite3.Connection:
    path = path.removeprefix("file://").removeprefix("file:")
    if not script:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con = sqlite3.connect(":memory:")
    with open(path, encoding="utf-8", errors="replace") as f:
        try:
            con.executescript(f.read())
        except sqlite3.Error as e:
            con.close()
            raise ValueError(f"the script {path} can't be run: {e}") from e
    return con


def _tables(con: sqlite3.Connection) -> list[str]:
    return [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite\\_%' escape '\\' order by name")]


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A table of an SQLite file, or with ``script`` of what an SQL script makes in memory. A column is long or double if all
    its values are such, else string. Files are read by ranges of row ids, ``partitions`` of them; a script, which each task
    would have to run whole, by one task. The path must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def _at(self) -> tuple[str, bool]:
        return self.options["path"], self.options.get("script") == "true"

    def schema(self) -> StructType:
        path, script = self._at()
        with contextlib.closing(_opened(path, script)) as con:
            table = self.options["table"]
            columns = [r[1] for r in con.execute(f"pragma table_info({_quoted(table)})")]
            kinds = ", ".join(f"max(case typeof({_quoted(c)}) when 'null' then 0 when 'integer' then 1 when 'real' then 2 else 3 end)" for c in columns)
            found = con.execute(f"select {kinds} from {_quoted(table)}").fetchone()
        return StructType([StructField(c, {1: LongType(), 2: DoubleType()}.get(k, StringType())) for c, k in zip(columns, found, strict=True)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(*self._at(), self.options["table"], schema, int(self.options.get("partitions", "8")))


class _SqliteReader(DataSourceReader):
    def __init__(self, path: str, script: bool, table: str, schema: StructType, n: int):
        self.path, self.script, self.table, self.schema, self.n = path, script, table, schema, n

    def partitions(self) -> list[InputPartition]:
        if self.script:
            return [_Rows(None, None)]
        with contextlib.closing(_opened(self.path, False)) as con:
            try:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [_Rows(None, None)]
        if low is None:
            return [_Rows(0, 0)]
        step = (high - low) // self.n + 1
        return [_Rows(at, at + step) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        casts = [{LongType: int, DoubleType: float}.get(type(f.dataType), lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)) for f in self.schema.fields]
        within = "" if partition.low is None else f" where rowid >= {partition.low} and rowid < {partition.high}"
        with contextlib.closing(_opened(self.path, self.script)) as con:
            for row in con.execute(f"select {', '.join(_quoted(f.name) for f in self.schema.fields)} from {_quoted(self.table)}{within}"):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))


def _read_sqlite(spark: SparkSession, path: str, table: str | None, script: bool, partitions: int) -> DataFrame:
    with contextlib.closing(_opened(path, script)) as con:
        name = _chosen(_tables(con), table, path)
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(path=path, table=name, script=str(script).lower(), partitions=str(partitions)).load()


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, partitions: int = 8) -> DataFrame:
    return _read_sqlite(spark, path, table, False, partitions)


def read_sql_script(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    return _read_sqlite(spark, path, table, True, 1)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str | None = None, password: str | None = None, column: str | None = None, low=None, high=None, partitions: int = 16, timeout_s: int = 8) -> DataFrame:
    """A table over JDBC; with ``column`` and its bounds, in so many ranges of it. The driver's jar is the cluster's."""
    options = {"url": url, "dbtable": table, "queryTimeout": str(timeout_s)} | ({"user": user, "password": password or ""} if user else {})
    if column:
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def jdbc_tables(spark: SparkSession, url: str, **login) -> DataFrame:
    names = "(select table_schema, table_name from information_schema.tables where table_type = 'BASE TABLE') t"
    return read_jdbc(spark, url, names, **login).orderBy("table_schema", "table_name")


class Unreachable(RuntimeError):
    """The HTTP interface gave no table; the message says why."""


def _asked(base: str, path: str, key: str, timeout_s: float = 6.0):
    request = urllib.request.Request(base.rstrip("/") + path, headers={"X-API-Key": key})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise Unreachable({401: "the key isn't valid", 404: f"{path} isn't known there"}.get(e.code, f"answered {e.code}: {e.read(300).decode('utf-8', 'replace')}")) from e
    except OSError as e:
        raise Unreachable(f"no answer from {base}: {e}") from e


def http_alive(base: str) -> bool:
    try:
        with urllib.request.urlopen(base.rstrip("/") + "/salud", timeout=3.0) as answer:
            return answer.status == 200
    except OSError:
        return False


def http_tables(base: str, key: str) -> list[str]:
    return _asked(base, "/tablas", key).get("tablas", [])


def read_value(url: str, path: tuple = ("serie", 0, "valor"), timeout_s: float = 4.0, opened: Callable | None = None) -> float | None:
    """One number from a JSON answer, as of a public service of rates: what ``path`` leads to. None if there is no answer or no
    number in it. ``opened(url, timeout)``: gives the answer as a file, instead of the network."""
    try:
        with (opened or urllib.request.urlopen)(url, timeout=timeout_s) as answer:
            found = json.load(answer)
        for step in path:
            found = found[step]
        return float(found)
    except (OSError, ValueError, TypeError, LookupError):
        return None


class HttpSource(DataSource):
    """A table of the HTTP interface: one answer, fetched and parsed in one task. Without a given schema, the rows are asked
    for once more to find one: long, double, boolean or string."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_http"

    def _rows(self) -> list[dict]:
        return _asked(self.options["base"], f"/tabla/{self.options['table']}", self.options.get("key", ""))

    def schema(self) -> StructType:
        seen: dict[str, set[type]] = {}
        for row in self._rows():
            for c, v in row.items():
                seen.setdefault(c, set()).add(type(v))
        kind = lambda s: LongType() if s == {int} else DoubleType() if s and s <= {int, float} else BooleanType() if s == {bool} else StringType()
        return StructType([StructField(c, kind(s - {type(None)})) for c, s in seen.items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HttpReader(dict(self.options), schema)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def read(self, partition) -> Iterator[tuple]:
        casts = {LongType: int, DoubleType: float, BooleanType: bool}
        for row in _asked(self.options["base"], f"/tabla/{self.options['table']}", self.options.get("key", "")):
            yield tuple(None if (v := row.get(f.name)) is None else casts.get(type(f.dataType), lambda x: x if isinstance(x, str) else json.dumps(x))(v) for f in self.schema.fields)


def read_http(spark: SparkSession, base: str, table: str, key: str = "") -> DataFrame:
    spark.dataSource.register(HttpSource)
    return spark.read.format(HttpSource.name()).options(base=base, table=table, key=key).load()
