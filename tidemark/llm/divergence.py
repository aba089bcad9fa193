"""Source divergence audit: the groups (lang, source) of a language meet each other in the rounds of a tournament.

Groups stay where they are: teams of groups are dealt to partitions once and kept there, while compressed vectors of their peers
go from host to host, each pair of teams meeting once. A meeting evaluates both directions for each pair of its groups. Vectors are
cut into blocks of terms, so no task holds a whole one, and teams keep the rounds at ``TEAMS`` at most however many groups there are.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: Documents of its language that a term must be in, and terms told of each group.
LEAST_DOCS, TOP = 3, 200
#: Shares are whole numbers out of this.
SCALE = 1_000_000_000
#: Teams of a language, and so its rounds; rounds sent at once; terms of a block times groups of a team, about.
TEAMS, ROUNDS_A_WAVE, CELLS = 32, 4, 1 << 20
#: Entries that a counting task holds before it sends them on.
HELD_TERMS = 200_000
#: Tables with a row a language or a group are broadcast up to so many rows; beyond that they are joined by shuffle.
FEW_ROWS = 20_000

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, lower-cased, and of characters beyond ASCII, of UTF-8 bytes."""
    return text.translate(_TERM_BYTES).split()


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def told():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            size = len(terms)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], schema=_COUNTS)
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            terms = terms_of(text.as_buffer().to_pybytes())
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            entries += len(n) - before
            if entries > HELD_TERMS:
                yield from told()
                entries = 0
    yield from told()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. Each task counts its own documents first."""
    counted = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), by long division in steps of 1,000, so that nothing overflows."""
    divisor, rest = max(total + terms, 1), counts.astype(np.int64) + 1
    whole, rest = rest // divisor, rest % divisor
    for _ in range(3):
        whole, rest = whole * 1_000 + rest * 1_000 // divisor, rest * 1_000 % divisor
    return whole + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block's terms become a compressed vector: places, then shares of the terms that occur, and the share of all others."""
    for batch in batches:
        others, packed = [], []
        for cells, total, terms in zip(batch["cells"], batch["total"].to_pylist(), batch["terms"].to_pylist(), strict=True):
            fields = cells.values
            at, n = (fields.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n")) if fields is not None else (np.empty(0, np.int32), np.empty(0, np.int64))
            others.append(int(shares(np.zeros(1, np.int64), total, terms)[0]))
            packed.append(zlib.compress(at.astype("<i4").tobytes() + shares(n, total, terms).astype("<i8").tobytes(), 1))
        keep = batch.drop_columns(["cells", "total", "terms"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(others, pa.int64()), pa.array(packed, pa.binary())], names=[*keep.schema.names, "other", "vector"])


class _Block:
    """One group's block of terms: its shares of all of them, and the places of those that occur."""

    def __init__(self, row: dict):
        data = zlib.decompress(row["vector"])
        n = len(data) // 12
        self.source, self.at = row["source"], np.frombuffer(data, "<i4", n)
        self.p = np.full(row["size"], row["other"], np.int64)
        self.p[self.at] = np.frombuffer(data, "<i8", n, 4 * n)
        self.other, self.occurs = row["other"], np.zeros(row["size"], bool)
        self.occurs[self.at] = True


def _both(a: _Block, b: _Block) -> tuple[int, int]:
    """Both directions of a pair, over all terms of the block; those that neither has are alike."""
    at = np.flatnonzero(a.occurs | b.occurs)
    rest, p, q = len(a.p) - len(at), a.p[at], b.p[at]
    gap = (a.other - b.other) ** 2
    return int(divergences(p, q).sum()) + rest * (gap // b.other), int(divergences(q, p).sum()) + rest * (gap // a.other)


def _top(group: _Block, whole: _Block) -> list[tuple[int, int]]:
    """(value, place) of the block's ``TOP`` terms that the group has more than its language, ties by place: a heap of those that
    reach the least value told."""
    at = group.at[group.p[group.at] > whole.p[group.at]]
    values = divergences(group.p[at], whole.p[at])
    if len(values) > TOP:
        reach = values >= np.partition(values, len(values) - TOP)[-TOP]
        at, values = at[reach], values[reach]
    return [(v, -k) for v, k in heapq.nlargest(TOP, zip(values.tolist(), (-at).tolist(), strict=True))]


_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("shard", pa.int64()), ("at", pa.int32()), ("value", pa.int64())])


def _meet(hosts: pa.Table, visitors: pa.Table) -> pa.Table:
    """A team at home, and who visits it: single groups of other teams, and once the whole language, when the team's own pairs meet."""
    out: dict[str, list] = {name: [] for name in _MET.names}

    def tell(*row):
        for name, v in zip(_MET.names, row, strict=True):
            out[name].append(v)

    home = [_Block(r) for r in hosts.to_pylist()]
    guests = visitors.to_batches(max_chunksize=16) if home else []
    lang, shard = (hosts["lang"][0].as_py(), hosts["shard"][0].as_py()) if home else (None, None)

    def pair(a, b):
        ab, ba = _both(a, b)
        tell(lang, a.source, b.source, shard, -1, ab)
        tell(lang, b.source, a.source, shard, -1, ba)

    for batch in guests:
        for row in batch.to_pylist():
            guest = _Block(row)
            if guest.source is not None:
                for a in home:
                    pair(a, guest)
                continue
            for k, a in enumerate(home):
                for value, at in _top(a, guest):
                    tell(lang, a.source, None, shard, at, value)
                for b in home[k + 1 :]:
                    pair(a, b)
    return pa.Table.from_pydict(out, schema=_MET)


def rounds_of(teams: Column) -> Column:
    """Rounds in which all teams meet: one less than their number, made even by a team that isn't there."""
    return teams + teams % 2 - 1


def opponent(team: Column, turn: Column, teams: Column) -> Column:
    """Whom a team meets in a round of the circle: the last stays, the others turn. A number of ``teams`` or more means a rest."""
    circle = rounds_of(teams)
    other = F.pmod(2 * turn - team, circle)
    return F.when(team == circle, turn).when(other == team, circle).otherwise(other)


def hosts(team: Column, other: Column) -> Column:
    """Whether ``team`` stays at home: the lesser of a pair with an odd sum, else the greater, so that homes are spread."""
    return (team < other) == ((team + other) % 2 == 1)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, teams: int = TEAMS, rounds_a_wave: int = ROUNDS_A_WAVE, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group's use of terms is from each other source of its language (``pair``),
    and the terms that it has most beyond its language (``term``), for all groups that occur.

    Null text, lang and source count as ''. A language whose terms are all rare keeps none: its pairs have value 0 and no
    term is told. A source alone in its language has no pair. Repeated rows each count as a document; ties go by the item's
    bytes; an empty table gives an empty one; other columns are ignored."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("text"), text("lang"), text("source"))
    counts = written(term_counts(docs), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept, "audit-kept")

    groups = docs.select("lang", "source").distinct()
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total")), "lang", "left").na.fill(0, ["terms", "total"])
    team_size = F.ceil(F.col("groups") / F.least(F.lit(teams), "groups"))
    langs = langs.withColumn("teams", F.ceil(F.col("groups") / team_size)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.lit(1_024), F.floor(cells / team_size)))))
    langs = written(langs, "audit-langs")
    side = lambda df: F.broadcast(df) if df.count() <= FEW_ROWS else df
    lang_side = side(langs)

    # Terms are numbered within blocks, in order of bytes, so a block's ties go by place.
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    number = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1
    index = written(kept.join(lang_side, "lang").select("lang", "term", "n", shard.alias("shard")).withColumn("at", number.cast("int")), "audit-index")
    cell = F.struct("at", "n")
    own = counts.select("lang", "source", "term", "n").join(index.select("lang", "term", "shard", "at"), ["lang", "term"])
    own = written(own.groupBy("lang", "source", "shard").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.sum("n").alias("total")), "audit-cells")
    whole = index.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(cell)).alias("cells"))

    totals = own.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    every = placed.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(lang_side.drop("total"), "lang")
    every = every.select("lang", "source", (F.col("place") % F.col("teams")).alias("team"), "teams", "terms", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    sizes = index.groupBy("lang", "shard").agg(F.count(F.lit(1)).cast("int").alias("size"))
    none = F.array().cast("array<struct<at:int,n:bigint>>")
    rows = every.join(own.drop("total"), ["lang", "source", "shard"], "left").join(sizes, ["lang", "shard"], "left").na.fill(0, ["size"])
    shape = ["lang", "source", "shard", "team", "teams", "size"]
    vectors = "lang string, source string, shard long, team long, teams long, size int, other long, vector binary"
    blocks = written(rows.select(*shape, F.coalesce("cells", none).alias("cells"), "total", "terms").mapInArrow(_pack, vectors), "audit-blocks")
    of_lang = every.select("lang", "shard", "team", "teams").distinct().join(lang_side.select("lang", "terms", "total"), "lang").join(sizes, ["lang", "shard"], "left").na.fill(0, ["size"])
    of_lang = of_lang.join(whole, ["lang", "shard"], "left").withColumn("source", F.lit(None).cast("string"))
    of_lang = of_lang.select(*shape, F.coalesce("cells", none).alias("cells"), "total", "terms").mapInArrow(_pack, vectors)

    at_home = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "shard", "team").persist(StorageLevel.MEMORY_AND_DISK)  # a lost part is read again
    rounds = langs.agg(F.max(rounds_of(F.col("teams")))).first()[0] or 0
    met = None
    for first in range(0, max(rounds, 1), rounds_a_wave):
        turns = F.sequence(F.lit(first), F.least(F.lit(first + rounds_a_wave), rounds_of(F.col("teams"))) - 1)
        away = blocks.where(rounds_of(F.col("teams")) > first).withColumn("turn", F.explode(turns)).withColumn("host", opponent(F.col("team"), F.col("turn"), F.col("teams")))
        away = away.where((F.col("host") < F.col("teams")) & ~hosts(F.col("team"), F.col("host"))).withColumn("team", F.col("host")).select(*[F.col(c).alias(c) for c in blocks.columns])
        visits = away.unionByName(of_lang) if first == 0 else away
        keys = ["lang", "shard", "team"]
        meetings = at_home.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_meet, "lang string, source string, item string, shard long, at int, value long")
        wave = written(meetings, f"audit-wave-{first}")
        met = wave if met is None else met.unionByName(wave)
    at_home.unpersist()

    pairs = met.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = met.where("item is null").drop("item").join(index.select("lang", "shard", "at", F.col("term").cast("string").alias("item")), ["lang", "shard", "at"]).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP).select(*columns))
