"""Packing by round trip, token counts against greedy matching, license scans against brute force."""

import base64
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.compare import SF
from tidemark.llm import licenses, packing, tokencount
from tidemark.llm import queries as llm


def test_packing_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in llm.op8_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for k, t in texts.items():
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] <= 1024 and p["length"].bit_count() == 1 and p["offset"] == 0
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    batches = defaultdict(list)
    for p in (p for x in pieces.values() for p in x):
        assert 1 << p["bucket"] == p["length"]
        batches[p["bucket"], p["batch"]].append(p["place"])
    assert len(batches) == len({b for _, b in batches}) and all(sorted(x) == list(range(len(x))) and len(x) << k <= packing.BATCH_TOKENS for (k, _), x in batches.items())
    every = [p["sequence_id"] for x in pieces.values() for p in x]
    assert len(set(every)) == len(every)


def test_packing_edges(spark):
    assert packing.piece_lengths(2_500) == [1024, 1024, 256, 128, 64, 4]
    rows = [(1, None), (2, ""), (None, "x <|endoftext|> y"), (3, "é\U0001f600" * 3_000), (3, "twice")]
    out = packing.pack(spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, length int, ids string"))
    got = out.collect()
    assert [r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_tokens"] for r in got if r["doc_id"] is None} == {len(slow.encode("x <|endoftext|> y", add_special_tokens=False).ids) + 1}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        tokens = {base64.b64decode(x.split()[0]) for x in lines}
    longest = max(map(len, tokens))

    def greedy(word):
        data, n, at = b" " + word, 0, 0
        while at < len(data):
            at += next(k for k in range(min(longest, len(data) - at), 0, -1) if data[at : at + k] in tokens)
            n += 1
        return n

    memo = {}
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in llm.op9_token_counts(spark, SF).collect():
        words = texts[r["doc_id"]]
        for w in words:
            if w not in memo:
                memo[w] = greedy(w)
        assert (r["n_words"], r["n_pieces"]) == (len(words), sum(memo[w] for w in words))
    rows = [(1, None, 1), (2, "", 1), (None, "ababab " * 20_000, 1), (2, "", 1)]
    got = [tuple(r) for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()]
    assert len(got) == 4 and got.count((2, 0, 0)) == 2 and (1, 0, 0) in got
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_scan(text):
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += at
        base |= {label} if at else set()
    more, held = set(), 0.0
    for label, t in licenses.TEMPLATES.items():
        all_of_it = re.findall(licenses.WORD, t.lower())
        step, s = 16, set(all_of_it)
        while step < len(all_of_it):
            step *= 2
        for at in range(0, len(words), step):
            block = set(words[at : at + 2 * step])
            if len(s & block) >= (0.8 if len(s) >= 12 else 0.95) * len(s) - 1e-9:
                more.add(label)
                held = max(held, len(s & block) / len(s))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else held)


def test_licenses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in llm.op10_licenses(spark, SF).collect()}
    assert got == {r["doc_id"]: brute_scan(r["text"]) for r in docs.collect()}
    assert sum(bool(v[5]) for v in got.values()) > 0
    notice = "x y " + licenses.TEMPLATES["bsd"] + " z"
    rows = [(1, None), (2, ""), (3, "MIT License, mit-license; the MIT"), (4, "w " * 40_000 + "General PUBLIC license"), (5, notice), (5, notice), (None, "mit")]
    df = spark.createDataFrame([(*r, 3, "b") for r in rows], "doc_id long, text string, row int, blocks string")
    changed = []
    for label, text in licenses.TEXTS.items():  # whole texts, texts without every tenth word, and halves
        w = text.split()
        changed += [(label, " ".join(["lorem"] * k + w)) for k in (0, 100, 301)] + [(label, " ".join(x for k, x in enumerate(w) if k % 10 != 3)), ("", " ".join(w[: len(w) // 2]))]
    rows += [(100 + k, f"ipsum dolor {t} sit amet") for k, (_, t) in enumerate(changed)]
    for (label, _), (_, text) in zip(changed, rows[-len(changed) :], strict=True):
        assert label in brute_scan(text)[5]
    df = spark.createDataFrame([(*r, 3, "b") for r in rows], "doc_id long, text string, row int, blocks string")
    found = sorted((tuple(r[n] for n in ["doc_id", *names]) for r in licenses.scan(df).collect()), key=str)
    assert found == sorted(((k, *brute_scan(t)) for k, t in rows), key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_each_filter_prunes(spark):
    """Twelve words, ten needed: prefixes are of three. Candidates by filter, and all pairs for comparison."""
    template = [f"w{k}" for k in range(12)]
    order = [f"x{k}" for k in range(20)] + template
    assert licenses.needed(12) == 10
    index = licenses.prefix_index({"t": template}, {"t": 16}, order, 0.8)
    assert [(x[0], x[3]) for x in index] == [("w0", 0), ("w1", 1), ("w2", 2)]
    blocks = {
        "whole": template, "without two": template[2:], "no shared prefix": template[3:], "short": template[:9], "other words first": order[:20] + template[1:11],
        "shared word too late": ["x0", "x1", "w2", *template[4:]], "enough words but too late": [*order[:3], "w2", *template[6:]], "words of others": [*order[:12], "w0"],
    }
    rows = [(k, 0, 16, sorted(b, key=order.index)) for k, b in enumerate(blocks.values())]
    df = spark.createDataFrame(rows, "row long, block int, step int, tokens array<string>")
    side = spark.createDataFrame(index, "token string, step int, label string, i int, size int, need int")
    found = {r["row"] for r in licenses.candidate_pairs(df, side).collect()}
    holding = {k for k, b in enumerate(blocks.values()) if len(set(template) & set(b)) >= 10}
    assert holding <= found == {0, 1, 4}
