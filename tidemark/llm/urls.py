"""URL filters: a Bloom filter cascade over the corpus's complete key universe gives exact rule membership without joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Bloom:
    bits: np.ndarray
    hashes: int
    salt: int

    @staticmethod
    def of(keys: Sequence[str], rate: float, salt: int) -> Bloom:
        n = max(len(keys), 1)
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        out = Bloom(np.zeros(size, dtype=bool), max(1, round(size / n * math.log(2))), salt)
        for key in keys:
            out.bits[out.places(key)] = True
        return out

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.salt)
        low, high = h & (2**64 - 1), (h >> 64) | 1
        return [(low + k * high) % len(self.bits) for k in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p] for p in self.places(key))


@dataclass
class Cascade:
    """Level 1 holds the listed keys, level 2 the other keys that pass level 1, level 3 the listed ones that pass level 2,
    and so on until none pass. For a key of the universe, the first level that it fails tells whether it's listed."""

    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1

    @property
    def n_bits(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """All keys that could be a rule for a URL: each suffix of at most ``labels`` whole host labels (no rule's host has more)
    with each first part of the path that is as long as some rule's path. Longest first; of equal lengths, that with the
    longer host. A host of any length costs time in proportion to it."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(labels, 0, -1)]))
    fits = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(fits, lambda n: F.struct((-F.length(h) - n).alias("a"), (-F.length(h)).alias("b"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.array_sort(keys)["key"]


def build_cascade(keys: DataFrame, listed: Sequence[str]) -> Cascade:
    """``keys``: one column ``key``, the corpus's complete universe, repeats allowed. One pass over it finds the keys that pass
    level 1 without being listed; level 1's rate is set by the universe's size so that they're about as many as the
    listed keys, and only they and the listed keys build further levels. Size: some bits for each listed key."""
    listed = sorted(set(listed))
    universe = keys.agg(F.approx_count_distinct("key").alias("n")).collect()[0]["n"] or 0
    rate = min(0.5, math.sqrt(0.5) * max(len(listed), 1) / max(universe, 1))
    first, known = Bloom.of(listed, rate, 1), frozenset(listed)

    @F.pandas_udf("boolean")
    def wrongly_in(values: pd.Series) -> pd.Series:
        return pd.Series([v is not None and v in first and v not in known for v in values], dtype=bool)

    passed = [r["key"] for r in keys.where(wrongly_in("key")).distinct().collect()]  # about as many as listed, by the rate
    levels, inside, outside = [first], listed, sorted(passed)
    while outside:
        levels.append(level := Bloom.of(outside, 0.5, len(levels) + 1))
        inside, outside = outside, [k for k in inside if k in level]
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``; the longest rule that fits wins, and urls without
    one get ``default``. ``rules``: (verdict, host, path); their keys are broadcast as a cascade of some bits a rule.

    A key says which host suffix and path start it is: two cascades, of the keys that allow and of those that block, are
    asked for a url's candidate keys from the longest on. Urls that are null or without ``://`` have an empty host and
    path and no rule. Repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    keyed = parts.withColumn("keys", F.when(F.col("host") != "", candidate_keys(F.col("host"), F.col("path"), labels, [len(p) for _, _, p in rules] or [0])).otherwise(F.array().cast("array<string>")))
    keyed = written(keyed, "url-keys")
    universe = keyed.select(F.explode("keys").alias("key"))
    # A key that two rules share goes by the first of them.
    meaning: dict[str, str] = {}
    for verdict, h, p in rules:
        meaning.setdefault(f"{h.lower()}{p}", verdict)
    cascades = [(v, build_cascade(universe, [k for k, m in meaning.items() if m == v])) for v in sorted(set(meaning.values()))]

    @F.pandas_udf("rule string, verdict string")
    def judged(lists: pd.Series) -> pd.DataFrame:
        memo: dict[str, str | None] = {}
        rows = []
        for keys in lists:
            found = (None, default)
            for key in keys:
                if key not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[key] = next((v for v, c in cascades if key in c), None)
                if memo[key]:
                    found = (key, memo[key])
                    break
            rows.append(found)
        return pd.DataFrame(rows, columns=["rule", "verdict"])

    out = keyed.withColumn("judged", judged("keys"))
    return out.select("page_id", "host", "path", F.col("judged.rule").alias("rule"), F.col("judged.verdict").alias("verdict"))
