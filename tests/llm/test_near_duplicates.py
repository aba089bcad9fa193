"""SimHash components and duplicate groups against all pairs."""

import numpy as np
import pytest

from tests.compare import SF
from tidemark.llm import queries as llm
from tidemark.llm import simhash


def roots(ids, linked):
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def brute_print(text):
    import xxhash

    words = simhash.words_of(text)
    grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    want = roots(texts, ((a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3))
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in llm.op7_simhash(spark, SF).collect()}
    assert got == {k: (prints[k], want[k]) for k in texts}


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(4)
    levels = simhash.covering_masks()
    assert [len(x) for x in levels] == [15, 225, 3375]
    for _ in range(300):
        places = rng.choice(64, 3, replace=False)
        change = sum(1 << int(p) for p in places)
        assert all(any(m & change == 0 for m in masks) for masks in levels)


def test_large_buckets_go_to_further_levels(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(5)
    prints = sorted({int(base) ^ (1 << int(b)) for base in rng.integers(0, 2**62, 3) for b in rng.integers(0, 62, 30)})
    df = spark.createDataFrame(list(enumerate(prints)), "rep long, fp long")
    links = [(r["a"], r["b"]) for r in simhash.close_links(df).collect()]
    near = [(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints) if a < b and (x ^ y).bit_count() <= 3]
    assert roots(range(len(prints)), links) == roots(range(len(prints)), near)


@pytest.mark.parametrize("bucket", [256, 3])
def test_duplicate_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r["doc_id"]: set(simhash.shingle_hashes(simhash.words_of(r["text"]), 5).tolist()) for r in docs.collect()}
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    want = roots(sets, ((a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])))
    assert {r["doc_id"]: r["component_id"] for r in simhash.duplicate_groups(docs).collect()} == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def brute_groups(texts):
    sets = {k: set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for k, t in texts.items()}
    return roots(sets, ((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))


def test_links_that_the_likeliest_pairs_miss(spark, monkeypatch):
    """Templates just below 0.8 of each other: a text's few likeliest pairs of the least hashes don't have its true one."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(6)
    passage, texts = " ".join(f"p{k}" for k in range(200)), {}
    for k in range(80):
        tail = [f"t{k}x{j}" for j in range(26)]
        texts[2 * k] = f"{passage} {' '.join(tail)}"
        for j in rng.choice(26, 3, replace=False):
            tail[j] = f"new{k}x{j}"
        texts[2 * k + 1] = f"{passage} {' '.join(tail)}"
    want = brute_groups(texts)
    assert len(set(want.values())) == 80
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.duplicate_groups(docs).collect()} == want


def test_recall_under_a_passage_of_thousands(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 64)
    passage, texts = " ".join(f"p{k}" for k in range(56)), {}
    for k in range(1_000):
        tail = " ".join(f"t{k}x{j}" for j in range(7))
        texts[2 * k], texts[2 * k + 1] = f"{passage} a{k} {tail}", f"{passage} b{k} {tail}"
    sets = [np.unique(simhash.shingle_hashes(simhash.words_of(t), 5)) for _, t in sorted(texts.items())]
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), at.max() + 1), dtype=np.float32)
    has[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), at] = 1
    common, n = has @ has.T, has.sum(axis=1)
    links = np.argwhere(np.triu(common >= 0.8 * (n[:, None] + n[None, :] - common), 1)).tolist()
    assert len(links) == 1_000
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.duplicate_groups(docs).collect()} == roots(texts, links)


def test_edges(spark):
    kind = "doc_id long, text string, fp long, component_id string"
    rows = [(5, None), (4, ""), (7, " \t\n"), (1, "A b C"), (2, "a B c"), (2, "a B c"), (None, "a b c"), (9, "only two"), (8, "z " * 60_000)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], kind)
    got = {(r["doc_id"], r["fingerprint"] == 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(5, True, 4), (4, True, 4), (7, True, 4), (1, False, 1), (2, False, 1), (None, False, 1)} <= got
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.keep_one(docs).collect())
    assert kept == [(False, 1), (False, 4), (False, 8), (False, 9), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
