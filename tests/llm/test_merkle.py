"""Fingerprints against a walk over all rows in order."""

import hashlib

import pytest

from tests.compare import SF
from tidemark.llm import merkle
from tidemark.llm import queries as llm


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        a, b, c = map(merkle.fingerprint, (text, changed, following))
        out[doc_id] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c))
    return out


def check(df, rows):
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in df.collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:4] == v[:4]
        assert got[k][4:] == pytest.approx(v[4:])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(llm.op3_fingerprints(spark, SF), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 3)
    rows = [(k, f"Sentence {k}. Another one!\nparagraph {k * k}\n" * (k % 5)) for k in range(-20, 40, 3)] + [(None, "without an id")]
    check(merkle.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)


def test_edges(spark):
    assert merkle.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, None), (2, ""), (3, "a" * 100_000), (4, "é\U0001f600\n\nx. y? z")]
    check(merkle.fingerprint_documents(spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, ends string, range int")), rows)
    alone = merkle.fingerprint_documents(spark.createDataFrame([(7, "one two. three")], "doc_id long, text string")).collect()[0]
    assert alone["near_next"] == 1.0
    twice = merkle.fingerprint_documents(spark.createDataFrame([(1, "same text. here")] * 3, "doc_id long, text string")).collect()
    assert len(twice) == 3 and {r["near_next"] for r in twice} == {1.0}


def by_hand(text):
    """The tree by its definition, without the operator's code: the root and the leaves of each paragraph."""
    def digest(data):
        return hashlib.blake2b(data, digest_size=16).digest()

    sections, now, leaves_of = [], [], []
    paragraphs = text.split("\n")
    for p in paragraphs:
        leaves, at = [], 0
        while at < len(p):
            end = at
            while end < len(p) and end - at < merkle.LEAF_CHARS and p[end] not in ".!?":
                end += 1
            while end < len(p) and p[end] in ".!?":
                end += 1
            leaves.append(p[at:end])
            at = end
        leaves_of.append(leaves)
        now.append(digest(b"".join(digest(x.encode()) for x in leaves)))
        if int(now[-1].hex()[:8], 16) % 8 == 0:
            sections.append(digest(b"".join(now)))
            now = []
    if now:
        sections.append(digest(b"".join(now)))
    return digest(b"".join(sections)).hex(), leaves_of


def test_trees_by_hand(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        root, leaves = by_hand(r["text"] or "")
        got, _, branches = merkle.fingerprint(r["text"] or "").partition("=")
        assert got == root
        shown = [b.split(",") if b else [] for section in branches.split(";") for b in section.split("/")]
        assert shown == [[hashlib.blake2b(x.encode(), digest_size=16).hexdigest()[:8] + f"{len(x):x}" for x in p] for p in leaves]


def test_roots_tell_texts_apart_that_share_short_digests(monkeypatch):
    """Branches alone can't tell these texts apart, roots can."""
    monkeypatch.setattr(merkle, "SHOWN", 0)
    a, b = merkle.fingerprint("One. Two. Six."), merkle.fingerprint("One. Ten. Six.")
    assert a.partition("=")[2] == b.partition("=")[2] and a.partition("=")[0] != b.partition("=")[0]


def test_likeness_and_differing_sections():
    text = "\n".join(f"This is paragraph number {k}, with some words. And a second sentence." for k in range(100))
    other = text.replace("paragraph number 50,", "paragraph number fifty,")
    a, b = merkle.fingerprint(text), merkle.fingerprint(other)
    assert a != b and a == merkle.fingerprint(text)
    assert merkle.likeness(a, b) > 0.97
    spans = merkle.differing_spans(a, b)
    assert len(spans) == 1 and "number fifty" in other[slice(*spans[0])] and spans[0][1] - spans[0][0] < 120
    assert merkle.differing_spans(a, a) == []
    assert merkle.likeness(merkle.fingerprint(""), a) == 0
    assert merkle.likeness(a, merkle.fingerprint("x" * 50)) == 0
