"""The mix against brute-force targets and highest quotients."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tidemark.llm import mixing
from tidemark.llm import queries as llm


def targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(most * sizes[s] for s in full)) / max(sum(weight[s] for s in order if s not in full), 1e-9)
        more = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_whole_table(spark):
    rows = llm.op1_mixing(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in texts.items()}
    sources = Counter()
    for k, (_, s) in texts.items():
        sources[s] += size[k]
    want, taken = targets(sources), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        source = texts[r["doc_id"]][1]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sources[source]
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 4 * mixing.BLOCK_WORDS
    again = {r["doc_id"]: r["taken"] for r in llm.op1_mixing(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_highest_quotients(spark):
    votes = [5_300, 2_400, 2_200, 100, 0, 1]
    for seats in (0, 1, 7, 50):
        rows = spark.createDataFrame([(0, k, float(v), seats) for k, v in enumerate(votes)], "g int, k int, votes double, seats int")
        got = {r["k"]: r["won"] for r in mixing.sainte_lague(rows, ["g"], "k", "votes", "seats", "won").collect()}
        want = dict.fromkeys(range(len(votes)), 0)
        for _ in range(seats):
            want[max(want, key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == want


def test_edges(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, taken string, size int"
    assert mixing.mix_plan(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, "x", "a", 0, "t", 9), (2, "", "x", None, 0, "t", 9), (3, "one two " * 700, "x", "b", 5_600, "t", 9), (3, "one two " * 700, "x", "b", 5_600, "t", 9), (None, "word", None, "c", 4, "t", 9)]
    out = mixing.mix_plan(spark.createDataFrame(rows, kind)).collect()
    assert len(out) == 5 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert all(r["taken"] == 0 for r in out if r["doc_id"] in (1, 2))
    docs = mixing.mixed_documents(spark.createDataFrame(rows, kind))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len(r["text"].split()) for r in docs.collect()) == sum(r["taken"] for r in out)


def test_blocks_dealt_by_hand(spark):
    """Every document's taken words from the definition: shards by hash, words laid end to end, quotas by highest quotients
    at each level, the first blocks in seeded order once more."""
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "b", "b", "c", None])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 8, "shard_words": 500}
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs, **options).collect()}
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", "text", "source", F.lit(mixing.SEED))).collect()}
    size = {k: len(t.split()) for k, t, _ in rows}
    of = {k: s for k, _, s in rows}
    sources = sorted(set(of.values()), key=lambda s: (s is None, s or ""))
    totals = {s: sum(size[k] for k in of if of[k] == s) for s in sources}

    def quotients(votes, seats):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            won[max(sorted(votes), key=lambda k: votes[k] / (2 * won[k] + 1))] += 1
        return won

    aims = targets(totals)
    blocks = quotients({n: aims[s] for n, s in enumerate(sources)}, round(sum(totals.values()) / 8))
    seeds = spark.range(200).select("id")
    want = dict.fromkeys(of, 0)
    for n, s in enumerate(sources):
        shards = {}
        for k in sorted((k for k in of if of[k] == s and size[k]), key=lambda k: hashes[k]):
            shards.setdefault(hashes[k] % max(1, -(-totals[s] // 500)), []).append(k)
        quota = quotients({x: sum(size[k] for k in ks) for x, ks in shards.items()}, blocks[n])
        for x, ks in shards.items():
            n_blocks = -(-sum(size[k] for k in ks) // 8)
            q = min(quota[x], 3 * n_blocks)
            drawn = [r[0] for r in seeds.where(F.col("id") < n_blocks).orderBy(F.xxhash64(F.lit(mixing.SEED), F.lit(n).cast("long"), F.lit(x).cast("long"), F.col("id"))).collect()][: q % n_blocks]
            at = 0
            for k in ks:
                want[k] = q // n_blocks * size[k] + sum(w // 8 in drawn for w in range(at, at + size[k]))
                at += size[k]
    assert got == want


def test_many_empty_texts_and_sources(spark):
    """A source of very many empty texts isn't a shard; a source for each of 3,000 domains meets its targets."""
    empty = spark.range(200_000).select("id", F.lit("").alias("text"), F.lit("a").alias("source"))
    some = spark.range(200_000, 203_000).select("id", F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    plan = mixing.mix_plan(empty.unionByName(some).withColumnRenamed("id", "doc_id"), block_words=1)
    sums = plan.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("source_size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    want = targets({r["source"]: r["size"] for r in sums})
    assert len(sums) == 3_001 and sum(r["n"] for r in sums) == 203_000
    for r in sums:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert abs(r["taken"] - r["target"]) <= 1 or r["taken"] == 3 * r["size"]


def test_words_of_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    plan = mixing.mix_plan(docs, same=["doc_id", "text", "lang", "source", "n_chars"]).where("taken > 0").select("doc_id", "taken")
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in plan.collect()}


def test_many_equal_rows_and_shards(spark):
    """Copies of one row are dealt over many shards; sources of more than a thousand shards share out by one apportionment."""
    copies = spark.range(3_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("hot").alias("source"))
    some = spark.range(10, 400).select("id", F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), F.lit("b").alias("source")).withColumnRenamed("id", "doc_id")
    plan = mixing.mix_plan(copies.unionByName(some), block_words=1, shard_words=8)
    rows = plan.collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 3_000
    assert max(Counter(r["start"] for r in rows if r["doc_id"] == 1).values()) > 500  # laid from the start of many shards
    taken = Counter()
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in {(r["source"], r["target"]) for r in rows}:
        assert abs(taken[r[0]] - r[1]) <= 0.02 * r[1] + 4
    votes = [float(k % 97 + 1) for k in range(3_000)]
    side = spark.createDataFrame([(0, k, v, 50_000) for k, v in enumerate(votes)], "g int, k int, votes double, seats int")
    got = {r["k"]: r["won"] for r in mixing.sainte_lague(side, ["g"], "k", "votes", "seats", "won").collect()}
    offers = sorted((-v / (2 * s + 1), k) for k, v in enumerate(votes) for s in range(60))[:50_000]
    want = Counter(k for _, k in offers)
    assert sum(got.values()) == 50_000 and got == {k: want[k] for k in range(3_000)}
