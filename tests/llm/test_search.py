"""URL rules and exact top-k against SQL and brute force."""

import numpy as np
import pytest

from tests.compare import SF, difference, tables
from tidemark.llm import queries as llm
from tidemark.llm import topk, urls


@pytest.mark.parametrize("name", ["op5_url_filter", "op6_top_k"])
def test_against_sql(spark, name):
    assert difference(llm.queries()[name](spark, SF), tables(SF), llm.oracle_sql()[name]) is None


def test_cascade_is_exact(spark):
    universe = [f"host{k}.example/" for k in range(5_000)]
    listed = universe[::7] + ["unseen.example/"]
    cascade = urls.build_cascade(spark.createDataFrame([(u,) for u in universe * 2] + [(None,)], "key string"), listed)
    assert [u for u in universe if u in cascade] == universe[::7]
    assert cascade.n_bits < 60 * len(listed)


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://WWW.Example.COM/en/x?q"), (5, "https://example.com"), (6, "x://a.net/es/#"), (7, "x://net/fr/"), (8, "x://notnet/fr/"), (9, "http://example.com/en/" + "a" * 100_000), (9, "x://"), (None, "http://b.com/")]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    got = sorted((r["page_id"] or 0, r["host"], r["rule"], r["verdict"]) for r in urls.judge(df).collect())
    got = {(a, b): (c, d) for a, b, c, d in got}
    assert got[1, ""] == got[2, ""] == got[3, ""] == got[9, ""] == (None, "allow")
    assert got[4, "www.example.com"] == ("www.example.com/en/", "allow") and got[5, "example.com"] == (None, "allow")
    assert got[6, "a.net"] == ("net/es/", "block") and got[7, "net"] == ("net/fr/", "block") and got[8, "notnet"] == (None, "allow")
    assert got[9, "example.com"] == ("example.com/en/", "block") and got[0, "b.com"] == ("com/", "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_hosts_of_many_labels(spark):
    """A host of 50,000 labels, for one under a rule and one under none, and rules of none."""
    long = "a." * 50_000
    df = spark.createDataFrame([(1, f"http://{long}example.com/en/x"), (2, f"http://{long}org/x"), (3, f"http://{'b' * 60_000}.net/fr/")], "page_id long, url string")
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()} == {(1, "example.com/en/", "block"), (2, None, "allow"), (3, "net/fr/", "block")}
    assert {r["verdict"] for r in urls.judge(df, rules=()).collect()} == {"allow"}


def test_huge_components(spark):
    """Scores beyond a long are its ends; order and ties go by them."""
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1.0]), (2, [-1e12, 0.0]), (3, [1.0, 1.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 64 * 2 * 64 * 10**12), (0, 3, 2, -(2**63))]


def test_tiles_and_merges(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (400, 6)) / 4  # many ties
    kind = "vec_id long, embedding array<float>, rank int, score string"
    rows = [(k, v.tolist(), 0, "s") for k, v in enumerate(vectors)] + [(400, None, 0, "s"), (420, [float("nan")] * 6, 0, "s"), (440, [1.0, None] * 3, 0, "s"), (460, [], 0, "s"), (None, [1.0] * 6, 0, "s"), (480, [1.0, 2.0], 0, "s")]
    got = topk.top_k(spark.createDataFrame(rows, kind), query_tile=3, shard_rows=9).collect()
    whole = np.floor(64 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    want = set()
    for q in range(0, 400, 20):
        best = sorted((int(-(whole[q] @ whole[k])), k) for k in range(400) if k != q)[:20]
        want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0


def test_repeated_ids(spark):
    """Rows that repeat a query's id are queries and candidates of their own; one id may hold most rows."""
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(k, rng.integers(-3, 4, 2).tolist()) for k in range(1, 30)] + [(7, [2.0, 2.0])] * 60
    got = topk.top_k(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "vec_id long, embedding array<double>"), query_tile=2, shard_rows=7).collect()
    v = np.floor(64 * np.array([r[1] for r in rows])).astype(int)
    want = []
    for q in range(len(rows)):
        if rows[q][0] % 20 == 0:
            best = sorted((-int(v[q] @ v[c]), rows[c][0]) for c in range(len(rows)) if c != q)[:20]
            want += [(rows[q][0], r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
