"""Source divergence and importance resampling against SQL and plain Python, and secret scans against SQL, Python and their ledger."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, difference, tables
from tidemark.llm import divergence, resampling, secretscan
from tidemark.llm import queries as llm


@pytest.mark.parametrize("name", ["op11_divergence", "op12_resampling", "op13_secrets"])
def test_against_sql(spark, name):
    assert difference(llm.queries()[name](spark, SF), tables(SF), llm.oracle_sql()[name]) is None


# Source divergence


def plain_audit(rows):
    docs = [(lang or "", source or "", re.findall(r"[a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        in_docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= 3]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])[:200]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)}
    return out


def test_tournament_of_many_teams_and_blocks(spark):
    """Eleven sources of one language in teams of three, blocks of few terms, one round sent at a time; a language of one
    source, one whose terms are all rare, null fields, copies, a group without a term."""
    rng, vocabulary = random.Random(11), [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(500)] + ["été", "日本", "\u0080x"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(60))).replace("w", "W", 1), "en", f"s{rng.randrange(9)}") for _ in range(150)]
    rows += [("same words here " * 5, "en", "s9")] * 40 + [("123 !", "en", "s10"), (None, "en", None), ("solo solo", "xx", "only"), ("solo", "xx", "only"), ("solo", "xx", "only"), ("rare", "yy", "a"), ("rare words", "yy", "b"), (None, None, None), ("x", None, "a"), ("x", None, "b"), ("x", None, "b")]
    rows.append(("long " * 30_000, "en", "s1"))
    df = spark.createDataFrame([(*r, 1, "v", 2) for r in rows], "text string, lang string, source string, value int, term string, n int")
    want = plain_audit(rows)
    for options in ({"teams": 4, "rounds_a_wave": 1, "cells": 1}, {"teams": 5, "rounds_a_wave": 2}, {}):
        got = divergence.audit(df, **options).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence.audit(df.limit(0)).count() == 0


def test_each_pair_of_teams_meets_once(spark):
    for n in range(1, 12):
        turns = spark.range(n).withColumnRenamed("id", "team").withColumn("teams", F.lit(n)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(n + n % 2 - 2, 0)))))
        met = turns.withColumn("other", divergence.opponent(F.col("team"), F.col("turn"), F.col("teams"))).where("other < teams").withColumn("home", divergence.hosts(F.col("team"), F.col("other"))).collect()
        pairs = Counter(frozenset((r["team"], r["other"])) for r in met)
        assert len(pairs) == n * (n - 1) // 2 and set(pairs.values()) <= {2}
        assert Counter(frozenset((r["team"], r["other"])) for r in met if r["home"]) == dict.fromkeys(pairs, 1)
        homes = Counter(r["team"] for r in met if r["home"])
        assert not homes or max(homes.values()) <= n // 2 + 1


def test_shares_are_exact():
    for count, total, terms in ((0, 0, 1), (10**13, 10**15, 10**9), (7, 22, 3), (10**15, 10**15, 1)):
        assert divergence.shares(np.array([count]), total, terms).tolist() == [1 + 10**9 * (count + 1) // (total + terms)]


# Importance resampling


def plain_resample(docs, target):
    def features(text):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000) / ((s[b] + 1.0) * (t_all + 10_000))))
    out, likely = [], []
    for doc_id, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found)) // len(found) if found else 0
        row = [doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words) >= 20:
            likely.append(row)
    for k, row in enumerate(sorted(likely, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 25 * len(likely) // 100]):
        row[4] = k + 1
    return sorted(out, key=str)


def test_resampling_of_copies_and_odd_rows(spark):
    rng = random.Random(13)
    text = lambda: " ".join(rng.choices(["Alpha", "beta", "gamma9", "été", "x-y", "delta"], k=rng.randrange(10, 40)))
    docs = [(k, text()) for k in range(150)] + [(1_000 + k, "copied words of a text " * 9) for k in range(70)] + [(2_000, None), (2_001, ""), (2_002, "Alpha beta " * 20_000), (None, text()), (2_003, "!!")]
    target = ["alpha beta alpha beta", None, "gamma9 of a text"]
    kind = "doc_id long, text string, weight int, copies string, rank int"
    df, goal = spark.createDataFrame([(*d, 1, "c", 5) for d in docs], kind), spark.createDataFrame([(t,) for t in target], "text string")
    got = sorted(([*r] for r in resampling.resample(df, goal).collect()), key=str)
    assert got == plain_resample(docs, target)
    assert resampling.resample(df.limit(0), goal).count() == 0
    assert {r["weight"] for r in resampling.resample(df.where("doc_id < 5"), goal.limit(0)).collect()}
    # Rows repeated as they are: each is drawn or not, by ranks without a gap.
    twice = resampling.resample(df.unionByName(df), goal).where("rank is not null").collect()
    assert sorted(r["rank"] for r in twice) == list(range(1, len(twice) + 1)) and len(twice) == 2 * sum(len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")) >= 20 for _, t in docs) * 25 // 100


def test_collapsed_once(spark):
    df = spark.createDataFrame([("a b a",)] * 5 + [("b",), (None,), ("",)], "text string")
    rows = {r["n_words"]: (r["copies"], r["n_features"]) for r in resampling.collapsed(df).collect()}
    assert rows == {3: (5, 5), 1: (1, 1), 0: (2, 0)}
    counts = resampling.bucket_counts(resampling.collapsed(df))
    assert counts.sum() == 26 and counts[zlib.crc32(b"a") % 10_000] == 10 and counts[zlib.crc32(b"b a") % 10_000] == 5


# Secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def made_texts():
    rng = random.Random(17)
    parts = ["password", "PassWd", "api_key", "apikey", "Token", "secret", ":", "=", " ", "'", '"', "x" * 12, "abc", "AKIA", "AKIAABCDEFGHIJKLMN", "AKIAAKIA", "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", ".", "==", "ſecret", "-"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(600)]


def test_secrets_of_made_texts(spark):
    texts = [*made_texts(), None, "", "token: " + "a1" * 40_000, "a " * 30_000 + "secret = abcdefghijkl"]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secretscan.scan_documents(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
        assert [got[k][f"n_{x}"] for x in secretscan.BASE] == [want.count(f"{x}:") for x in secretscan.BASE]
    assert secretscan.scan_documents(df.limit(0)).count() == 0


def test_spans_that_the_method_adds(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK y", "ghp_" + "a1B2" * 9, "xoxb-1234567890-ab", "AIza" + "x" * 35, "see https://user:pa55@host/", "AIzashort eyJ. xox gh_ ://"]
    rows = secretscan.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["spans"].split(":")[0] for r in rows] == ["private_key", "web_token", "forge_token", "chat_token", "cloud_key", "url_login", ""]
    assert rows[1]["spans"] == f"web_token:2:{len(texts[1]) - 2}"


@pytest.mark.parametrize("few", [0, 100])
def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(secretscan, "FEW_BLOBS", few)
    ledger, kind = f"file://{tmp_path}/ledger", "path string, version int, text string, blob string"
    secret, other = "password = abcdefghijklmnop", "hex 0123456789abcdef"
    keep = ["path", "version"]
    scans = lambda: spark.read.parquet(f"{ledger}/scanned").select(F.explode("rules").alias("rule"), "blob")
    n_rules = len(secretscan.RULES)
    first = spark.createDataFrame([("a", 1, secret, "b"), ("b", 1, secret, "b"), ("a", 2, other, "b"), (None, None, None, "b")], kind)
    found = {(r["path"], r["version"]): [f["kind"] for f in r["findings"]] for r in secretscan.scan(first, ledger, keep=keep).collect()}
    assert found == {("a", 1): ["assign"], ("b", 1): ["assign"], ("a", 2): ["hex"], (None, None): []}
    assert scans().count() == 3 * n_rules
    # A later history: old blobs at new paths aren't scanned again, one new blob is.
    later = first.unionByName(spark.createDataFrame([("c", 1, secret, "b"), ("c", 2, "token: abcdefghijklmnop", "b")], kind))
    found = {(r["path"], r["version"]): [f["kind"] for f in r["findings"]] for r in secretscan.scan(later, ledger, keep=keep).collect()}
    assert found["c", 1] == found["c", 2] == ["assign"] and len(found) == 6
    assert scans().count() == 4 * n_rules == scans().distinct().count()
    # A new version of one rule: all blobs are scanned with it, and its old findings don't count.
    rules = secretscan.RULES | {"hex": secretscan.Rule(r"[0-9a-f]{20,}", 20, version=2)}
    found = {(r["path"], r["version"]): [f["kind"] for f in r["findings"]] for r in secretscan.scan(later, ledger, rules, keep=keep).collect()}
    assert found["a", 2] == [] and found["c", 2] == ["assign"]
    assert scans().count() == 4 * n_rules + 4 and scans().where("rule = 'hex@2'").count() == 4
    # What was written twice, as by a scan that broke off before its note, counts once.
    again = spark.read.parquet(f"{ledger}/findings").collect()
    spark.createDataFrame(again, "blob binary, rule string, spans array<struct<start:bigint,end:bigint>>").write.mode("append").parquet(f"{ledger}/findings")
    assert {(r["path"], r["version"]): [f["kind"] for f in r["findings"]] for r in secretscan.scan(later, ledger, rules, keep=keep).collect()} == found
