"""Duplicate groups over the whole of lineitem against brute force."""

from collections import defaultdict

from tests.compare import SF
from tidemark import queries as own


def test_rows_of_all_orders(spark):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        groups[r["l_partkey"] % 50, r["l_linenumber"], r["l_returnflag"]].append(r["l_orderkey"] * 1_000_000 + r["l_suppkey"])
    want = sorted((k, min(g)) for g in groups.values() if len(g) > 1 for k in g)
    assert max(k for k, _ in want) > 200 * 1_000_000
    assert sorted(tuple(r) for r in own.queries()["dup_groups"](spark, SF).select("row", "group_first").collect()) == want
