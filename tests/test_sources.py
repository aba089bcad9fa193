"""Readers, projects and other sinks, on small files."""

import datetime
import http.server
import io
import json
import sqlite3
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions.formula import FormulaError, calculated_column, calculated_value
from tidemark.operators.filters import Condition
from tidemark.operators.indicators import Indicator
from tidemark.operators.state import Board, currency_columns
from tidemark.sources import files, projects, tables


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_is_sniffed(spark, tmp_path, encoding, sep):
    (tmp_path / "a.csv").write_bytes(f'id{sep}año\n1{sep}"Perú, ""x"""\n2{sep}b\n'.replace(", ", "- ").encode(encoding))
    df = files.read_table(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["id", "año"] and [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'Perú- "x"'), (2, "b")]


def test_empty_and_unknown_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/a.csv")
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/a.xyz")


def test_sqlite_and_scripts(spark, tmp_path):
    script = "create table t(a integer, b real, c text); " + "".join(f"insert into t values ({k}, {k}.5, 'x{k}');" for k in range(100)) + "insert into t values (null, null, null);"
    (tmp_path / "s.sql").write_text(script)
    con = sqlite3.connect(tmp_path / "d.db")
    con.executescript(script + "create table u(a text);")
    con.close()
    with pytest.raises(tables.SeveralTables) as several:
        files.read_table(spark, f"{tmp_path}/d.db")
    assert several.value.tables == ["t", "u"]
    for df in (files.read_table(spark, f"{tmp_path}/s.sql"), files.read_table(spark, f"{tmp_path}/d.db", "t")):
        assert [t for _, t in df.dtypes] == ["bigint", "double", "string"]
        assert tuple(df.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.countDistinct("c")).first()) == (101, 4950, 5000.0, 100)
    assert files.read_table(spark, f"{tmp_path}/d.db", "u").count() == 0


def test_http(spark):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            known = {"/salud": {}, "/tablas": {"tablas": ["t"]}, "/tabla/t": [{"a": 1, "b": 1.5, "c": "x"}, {"a": None, "b": 2, "c": None}]}
            code = 404 if self.path not in known else 401 if self.path != "/salud" and self.headers["X-API-Key"] != "k" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(known.get(self.path)).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert tables.http_alive(base) and tables.http_tables(base, "k") == ["t"]
    assert sorted((tuple(r) for r in files.Source("http", base, "t").read(spark, key="k").collect()), key=str) == [(1, 1.5, "x"), (None, 2.0, None)]
    for key, table, said in (("no", "t", "valid"), ("k", "z", "known")):
        with pytest.raises(tables.Unreachable, match=said):
            tables._asked(base, f"/tabla/{table}", key)
    server.shutdown()
    server.server_close()
    assert not tables.http_alive(base)


def test_edits_and_names(spark):
    df = spark.createDataFrame([("1,7",), ("",), ("x",), ("03/02/2024",), (None,)], "t string")
    got = df.select(files.cast_edit(F.col("t"), "bigint"), files.cast_edit(F.col("t"), "double"), files.cast_edit(F.col("t"), "boolean"), files.cast_edit(F.col("t"), "date").cast("string"), files.cast_edit(F.col("t"), "string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1.7, False, None, "1,7"), (None,) * 5, (None, None, True, None, "x"), (None, None, False, "2024-02-03", "03/02/2024"), (None,) * 5]
    assert files.free_name("a", {"a", "a (2)"}) == "a (3)" and files.free_name("b", {"a"}) == "b"


def test_project_round_trip(spark, tmp_path):
    at = f"file://{tmp_path}/p/one"
    t = spark.range(5).withColumn("x", F.col("id") * 1.5)
    known = Indicator("n", "sum", column="x", conditions=(Condition("y", "in", ("a", "b")),))
    projects.save_project(projects.Project({"Ventas / año": t}, active="Ventas / año", sources={"v": {"kind": "jdbc", "where": "jdbc:x", "password": "p", "api_key": "k"}}, indicators=[known], predictions={"v": t}), at)
    got = projects.open_project(spark, at)
    assert got.tables["Ventas / año"].count() == 5 and got.predictions["v"].count() == 5 and got.indicators == [known] and got.sources == {"v": {"kind": "jdbc", "where": "jdbc:x"}}
    projects.save_project(got, at)
    assert projects.open_project(spark, at).tables["Ventas / año"].count() == 5
    assert [(p["tables"], p["active"]) for p in projects.recent_projects(spark, f"file://{tmp_path}/p")] == [(1, "Ventas / año")]
    assert projects.indicator_from_dict({"name": "k", "newer": 1}) == Indicator("k", "sum")


def test_lists_report_and_messages(spark, tmp_path):
    t = spark.createDataFrame([(1, 'a "q"', 0.5), (2, None, 0.25)], "id long, name string, p double")
    projects.write_predictions(t, "id", ["p"], f"file://{tmp_path}/p")
    assert sorted(tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/p").collect()) == [(1, 0.5), (2, 0.25)]
    page = projects.report("R & D", [("none", t.limit(0)), ("some", t)])
    assert "1. some" in page and "none" not in page and "R &amp; D" in page and "&quot;q&quot;" in page
    said = []
    assert projects.notify(spark.createDataFrame([("a", 1234.5), ("b", None)], "name string, value double"), lambda s, b: said.append(b)) == 2
    assert sorted(said) == ["a: 1,234.50", "b: no data"]


def workbook(path, sheets):
    """A workbook by hand: shared and inline texts, numbers, truth values, dates by style, errors, and cells left out."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="0.00&quot; days&quot;"/><numFmt numFmtId="171" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="171"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>día</t></si></sst>')
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>0</v></c><c r="F1" t="inlineStr"><is><t>ok</t></is></c></row>'
    body = '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c><c r="C2" s="1"><v>45292.5</v></c><c r="D2" s="2"><v>2.5</v></c><c r="F2" t="b"><v>1</v></c></row><row r="3"/><row r="4"><c r="A4"><v>2</v></c><c r="B4"><v>7</v></c><c r="D4" t="e"><v>#DIV/0!</v></c></row>'
    workbook(tmp_path / "one.xlsx", {"a": head + body})
    df = files.read_table(spark, f"{tmp_path}/one.xlsx")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("día", "timestamp_ntz"), ("id (2)", "double"), ("column 5", "string"), ("ok", "boolean")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", datetime.datetime(2024, 1, 1, 12), 2.5, None, True), (2, "7", None, None, None, None)]
    workbook(tmp_path / "two.xlsx", {"a": head + body, "b": head, "c": ""})
    with pytest.raises(tables.SeveralTables) as several:
        files.read_table(spark, f"{tmp_path}/two.xlsx")
    assert several.value.tables == ["a", "b", "c"]
    assert files.read_table(spark, f"{tmp_path}/two.xlsx", "b").count() == 0 and files.read_table(spark, f"{tmp_path}/two.xlsx", "a").count() == 2
    assert files.read_table(spark, f"{tmp_path}/two.xlsx", "c").columns == []
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/two.xlsx", "d")


def test_jdbc(spark, tmp_path):
    """By the database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).select("id", (F.col("id") * 0.5).alias("x"), F.concat(F.lit("n"), "id").alias("name")).write.jdbc(url, "things")
    whole, parts = tables.read_jdbc(spark, url, "things"), tables.read_jdbc(spark, url, "things", column="id", low=0, high=100, partitions=4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == sorted((k, k * 0.5, f"n{k}") for k in range(100))
    assert files.Source("jdbc", url, "things").read(spark).count() == 100
    with pytest.raises(Exception, match="(?i)nothing|not exist"):
        tables.read_jdbc(spark, url, "nothing").count()


def test_refresh_discards_predictions(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    project = projects.Project({"t": spark.range(1), "u": spark.range(1)}, sources={"t": {"kind": "file", "where": f"{tmp_path}/t.parquet"}}, predictions={"t": spark.range(1), "u": spark.range(1)})
    board = Board()
    board.publish("t", spark.range(1))
    files.refreshed(project, "t", spark, board)
    assert project.tables["t"].count() == 3 and set(project.predictions) == {"u"} and not board.predictions
    with pytest.raises(ValueError):
        files.refreshed(project, "u", spark)


def test_one_value_from_outside(spark):
    answer = lambda text: lambda url, timeout: io.BytesIO(text.encode())
    assert tables.read_value("x", opened=answer('{"serie": [{"valor": 37125.5}]}')) == 37125.5
    assert tables.read_value("x", ("a",), opened=answer('{"a": "12"}')) == 12.0
    for broken in ("{}", "no json", '{"serie": []}', '{"serie": [{"valor": null}]}'):
        assert tables.read_value("x", opened=answer(broken)) is None

    def unreachable(url, timeout):
        raise OSError("down")

    assert tables.read_value("x", opened=unreachable) is None
    out = currency_columns(spark.createDataFrame([("100",), ("x",)], "p string"), ["p"], lambda: tables.read_value("x", opened=answer('{"serie": [{"valor": 40}]}')))
    assert [tuple(r) for r in out.select("p_UF", "p_CLP").collect()] == [(2.5, 4000.0), (None, None)]


@pytest.mark.parametrize("call", ["unique()", "value_counts()", "tolist()", "dropna()"])
def test_collections_are_no_columns(spark, call):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    with pytest.raises(FormulaError, match="several values"):
        calculated_column(df, "y", f"[x].{call}")
    assert calculated_value(df, "[x].dropna().mean()").first()["value"] == 2.0
