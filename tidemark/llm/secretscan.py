"""Secret scans: an incremental ledger of blobs, in DataFrame functions alone.

Every version of every path is addressed by its content (SHA-256). The ledger is a folder of two tables: ``scanned`` (blob, the rule
versions that were run over it) and ``findings`` (blob, rule, spans). A scan runs only the pairs of a blob and a rule version that
the ledger doesn't have, each blob once however many paths and versions hold it, and joins the findings back to all paths."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import scratch_folder, written


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that don't overlap; those whose ``group`` has under ``least`` characters go. ``holds``: a literal that every
    match has, so texts without it aren't searched. Whoever changes a rule raises its version, so that the ledger's blobs are
    scanned with it anew."""

    pattern: str
    least: int = 0
    group: int = 0
    holds: str = ""
    version: int = 1


#: In the order in which spans of one start are told. The first three are the contract's, the others forms that issuers publish.
#: Where a match is one run of a class, as of hex digits, shorter runs needn't match first to be dropped. For ``assign`` they
#: must: a match that is dropped still uses up its characters.
RULES = {
    "assign": Rule(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": Rule(r"AKIA[A-Z0-9]{14,}", 18, holds="AKIA"),
    "hex": Rule(r"[0-9a-f]{16,}", 16),
    "private_key": Rule(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", holds="PRIVATE KEY-----"),
    "web_token": Rule(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", holds=".eyJ"),
    "forge_token": Rule(r"gh[oprsu]_[A-Za-z0-9]{36,}", holds="_"),
    "chat_token": Rule(r"xox[abprs]-[A-Za-z0-9-]{10,}", holds="xox"),
    "cloud_key": Rule(r"AIza[A-Za-z0-9_-]{35}", holds="AIza"),
    "url_login": Rule(r"[a-z]{3,12}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@", holds="://"),
}
BASE = ("assign", "access", "hex")
#: Up to so many unseen blobs, rows without them go before texts are shuffled; their addresses (32 bytes each) are broadcast.
FEW_BLOBS = 100_000


def address(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _rule_version(kind: str, rule: Rule) -> str:
    return f"{kind}@{rule.version}"


def _ledger(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame | None:
    """A table of the ledger, or None before its first scan."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def _pieces(found: Column, gaps: Column, rule: Rule) -> Column:
    """Of the rule's matches in order: characters since the last match, characters of the match, whether it stays."""
    kept = lambda m: F.char_length(m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
    return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), kept(m).alias("kept")))


def find(blobs: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """(blob, rule, spans) of blobs (blob, text, missing: the rule versions to run), one row for each pair with a finding. Places are
    code points from 0, ends exclusive. They are running sums over a blob's matches by rule: linear in their number."""
    names = {kind: _rule_version(kind, rule) for kind, rule in rules.items()}
    number = {k: i for i, k in enumerate(rules)}
    # In steps, so that each expression runs once a text; texts are cut up only where they match.
    found = blobs.select("blob", "text", *[F.when(F.array_contains("missing", names[k]) & F.contains("text", F.lit(r.holds)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"f{number[k]}") for k, r in rules.items()])
    cut = found.select("blob", *[f"f{i}" for i in number.values()], *[F.when(F.size(f"f{number[k]}") > 0, F.split("text", r.pattern, -1)).alias(f"g{number[k]}") for k, r in rules.items()])
    runs = F.array(*[F.struct(F.lit(names[k]).alias("rule"), _pieces(F.col(f"f{number[k]}"), F.col(f"g{number[k]}"), r).alias("pieces")) for k, r in rules.items()])
    each = cut.select("blob", F.explode(F.filter(runs, lambda x: F.size(x["pieces"]) > 0)).alias("run"))
    one = each.select("blob", F.col("run.rule").alias("rule"), F.posexplode("run.pieces").alias("place", "piece"))
    upto = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("piece.gap") + F.col("piece.size")).over(upto)).where("piece.kept")
    span = F.struct((F.col("end") - F.col("piece.size")).alias("start"), F.col("end"))
    return placed.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: Mapping[str, Rule] = RULES, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` (the path and version), blob and ``findings`` (kind, start, end; by start, then in the rules' order) of each row.

    ``ledger``: a folder that all executors share, kept from scan to scan. Findings are written before the note that their blobs
    are scanned, so a scan that broke off is scanned again, and what is written twice counts once. ``missing`` pairs come from
    addresses alone. Texts are shuffled once, after each task has dropped its own copies, so a text on very many rows is one row a
    task. The join back to rows meets hot blobs; its side of findings has one row a blob, and Spark splits the skewed rows.

    Null texts count as empty and have no finding; repeated rows and null ids each get a row; an empty table gives an empty one;
    columns beside ``keep`` and the text are ignored, and none clashes with names used here."""
    spark = versions.sparkSession
    names = {kind: _rule_version(kind, rule) for kind, rule in rules.items()}
    path = {c: F.col("`" + c.replace("`", "``") + "`") for c in (*keep, text)}
    addressed = versions.select(F.struct(*[path[c].alias(f"k{i}") for i, c in enumerate(keep)]).alias("path"), F.coalesce(path[text], F.lit("")).alias("text"), address(path[text]).alias("blob"))
    paths = written(addressed.select("path", "blob"), "secret-paths")
    wanted = F.lit(list(names.values()))
    scanned = _ledger(spark, ledger, "scanned", "blob binary, rules array<string>")
    blobs = paths.select("blob").distinct()
    if scanned is None:
        once = addressed.groupBy("blob").agg(F.first("text").alias("text")).withColumn("missing", wanted)
        missing = blobs.withColumn("missing", wanted)
    else:
        seen = scanned.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        missing = written(blobs.join(seen, "blob", "left").select("blob", left.alias("missing")).where("size(missing) > 0"), "secret-missing")
        few = missing.count() <= FEW_BLOBS
        rows = addressed.join(F.broadcast(missing.select("blob")), "blob", "left_semi") if few else addressed
        once = rows.groupBy("blob").agg(F.first("text").alias("text")).join(missing, "blob")
    find(once, rules).write.mode("append").parquet(f"{ledger}/findings")
    missing.select("blob", F.col("missing").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")

    kinds = {name: (i, kind) for i, (kind, name) in enumerate(names.items())}
    number = F.create_map(*[F.lit(x) for name, (i, _) in kinds.items() for x in (name, i)])
    found = _ledger(spark, ledger, "findings", "blob binary, rule string, spans array<struct<start:bigint,end:bigint>>").where(F.col("rule").isin(*kinds))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number[F.col("rule")].alias("no"), s["end"].alias("end")))
    by_blob = found.select("blob", spans.alias("spans")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    told = F.transform("spans", lambda s: F.struct(F.element_at(F.lit(list(rules)), s["no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_blob = by_blob.select("blob", told.alias("findings"))
    out = paths.join(by_blob, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(*[F.col(f"path.k{i}").alias(c) for i, c in enumerate(keep)], F.hex("blob").alias("blob"), F.coalesce("findings", none).alias("findings"))


def digest(found: DataFrame, base: Sequence[str] = BASE) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of their spans, and all spans as ``kind:start:end`` joined by commas."""
    written_as = lambda f: F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in base]
    own = F.filter("findings", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(written_as(own).cast("binary"), 256).alias("base_sha256"), written_as(F.col("findings")).alias("spans"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """A first scan of the documents: its ledger is new, in the shared folder, and so no pair of it is seen."""
    return digest(scan(docs, f"{scratch_folder(docs.sparkSession)}/tidemark-ledger-{uuid.uuid4().hex}"))
