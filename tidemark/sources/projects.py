"""Sinks: projects as folders, lists as CSV, indicators as JSON, a report of small summaries, and messages of alarms."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filters import Condition
from tidemark.operators.indicators import Indicator

VERSION = 1
SECRET = ("password", "key", "token", "user")


@dataclass
class Project:
    tables: dict[str, DataFrame]
    active: str | None = None
    sources: dict[str, dict] = field(default_factory=dict)
    indicators: list[Indicator] = field(default_factory=list)
    notes: list[list] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    predictions: dict[str, DataFrame] = field(default_factory=dict)


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _without_secrets(x):
    if isinstance(x, dict):
        return {k: _without_secrets(v) for k, v in x.items() if not any(s in k.lower() for s in SECRET)}
    return [_without_secrets(v) for v in x] if isinstance(x, (list, tuple)) else x


def indicator_to_dict(k: Indicator) -> dict:
    return asdict(k)


def indicator_from_dict(d: dict) -> Indicator:
    """Keys that an older file lacks have their defaults; unknown ones are ignored."""
    known = {f.name for f in fields(Indicator)}
    own = {f.name for f in fields(Condition)}
    rest = {k: v for k, v in d.items() if k in known and k != "conditions"}
    listed = lambda v: tuple(v) if isinstance(v, list) else v
    return Indicator(**({"name": "Indicator", "op": "sum"} | rest), conditions=tuple(Condition(**{k: listed(v) for k, v in c.items() if k in own}) for c in d.get("conditions", ())))


def save_project(project: Project, folder: str) -> None:
    """A folder: ``tables/<k>`` and ``predictions/<k>`` as Parquet, and last ``project.json``, which names them, so a project
    that broke off in writing isn't one. Sources are kept without passwords, keys and users. Each save writes a new set of
    tables, so a table read from the project itself may be saved to it."""
    spark = next(iter(project.tables.values())).sparkSession
    root, fs = _path(spark, folder)
    number = 1 + max([int(s.getPath().getName()[3:]) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("set")], default=0)
    meta = {"version": VERSION, "active": project.active, "set": number, "sources": _without_secrets(project.sources), "indicators": [indicator_to_dict(k) for k in project.indicators]}
    meta |= {"notes": project.notes, "relations": project.relations, "settings": project.settings}
    for kind in ("tables", "predictions"):
        names = list(getattr(project, kind))
        for k, name in enumerate(names):
            getattr(project, kind)[name].write.parquet(f"{folder}/set{number}/{kind}/{k}")
        meta[kind] = names
    out = fs.create(_path(spark, f"{folder}/project.json")[0], True)
    out.write(bytearray(json.dumps(meta, ensure_ascii=False, indent=1, default=str).encode()))
    out.close()


def _meta(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/project.json", wholetext=True).first().value)


def open_project(spark: SparkSession, folder: str) -> Project:
    """``tables`` must be named; all else has a default, so older projects open."""
    meta = _meta(spark, folder)
    read = lambda kind: {name: spark.read.parquet(f"{folder}/set{meta['set']}/{kind}/{k}") for k, name in enumerate(meta.get(kind, []))}
    if "tables" not in meta:
        raise ValueError(f"{folder} names no tables")
    rest = {k: meta[k] for k in ("active", "sources", "notes", "relations", "settings") if k in meta}
    return Project(read("tables"), indicators=[indicator_from_dict(d) for d in meta.get("indicators", [])], predictions=read("predictions"), **rest)


def recent_projects(spark: SparkSession, folder: str) -> list[dict]:
    """(path, tables, active, modified) of each project in the folder, the latest first; no table is read."""
    root, fs = _path(spark, folder)
    found = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        at = s.getPath().toString()
        file = _path(spark, f"{at}/project.json")[0]
        if fs.exists(file):
            meta = _meta(spark, at)
            found.append({"path": at, "tables": len(meta.get("tables", [])), "active": meta.get("active"), "modified": fs.getFileStatus(file).getModificationTime()})
    return sorted(found, key=lambda x: -x["modified"])


def write_list(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A CSV with a header; ``one_file`` is for lists that are small by nature, as of rows to look at first."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_predictions(df: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    write_list(df.select(key, *columns), path)


def report(title: str, chapters: Sequence[tuple[str, DataFrame]], most: int = 50) -> str:
    """HTML of summaries, ``most`` rows of each; a chapter without rows is left out and takes no number."""
    parts, number = [f"<h1>{html.escape(title)}</h1>"], 0
    for name, summary in chapters:
        lines = summary.limit(most).collect()
        if lines:
            number += 1
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
            parts.append(f"<h2>{number}. {html.escape(name)}</h2><table>{row(summary.columns, 'th')}{''.join(row(x, 'td') for x in lines)}</table>")
    return "\n".join(parts)


def notify(fired: DataFrame, send: Callable[[str, str], None]) -> int:
    """A message for each alarm (name, value), by ``send(subject, body)``; one that fails doesn't stop the others. Returns how
    many were sent. There are as many rows as alarm rules."""
    sent = 0
    for a in fired.select("name", F.col("value").cast("double").alias("value")).collect():
        try:
            send(f"ALARM: {a.name}", f"{a.name}: {'no data' if a.value is None else f'{a.value:,.2f}'}")
            sent += 1
        except OSError:
            continue
    return sent
