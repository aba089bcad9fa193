"""SimHash near-duplicates by covering locality-sensitive hashing, and the duplicate groups of texts by word shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import steps, written

BITS, RADIUS, SEED = 64, 3, 42
TABLES = 2 ** (RADIUS + 1) - 1
#: After three levels of masks 8 bits at most are free, so no bucket of distinct fingerprints is larger.
LEVELS, BUCKET = 3, 256
HASHES_AT_ONCE = 65_536


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``k`` words joined by a blank, repeats included; of the whole if there are fewer; none of none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it's set in over half of the hashes; as a signed long."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some = hashes[at : at + HASHES_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle_words: int) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(words_of(t), shingle_words)) for t in texts], dtype="int64")

    return hashed(text)


def _halves(places: list[int]) -> list[int]:
    """Covering masks of these bit places for the radius: place number j gets a non-zero vector a(j) of radius + 1 bits, and
    mask v holds the places where a(j) . v is odd. Any ``RADIUS`` vectors have some v that is even on all of them, so two
    words that differ in at most so many places agree on the whole of some mask."""
    vectors = [j % TABLES + 1 for j in range(len(places))]
    return [sum(1 << p for p, a in zip(places, vectors, strict=True) if (a & v).bit_count() % 2) for v in range(1, TABLES + 1)]


def covering_masks() -> list[list[int]]:
    """Masks of each level: those of a level are, for each mask before, it and the covering masks of its free bits."""
    levels, before = [], [0]
    for _ in range(LEVELS):
        before = [m | more for m in before for more in _halves([p for p in range(BITS) if not m >> p & 1])]
        levels.append(before)
    return levels


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _buckets(batch: pa.RecordBatch):
    """The members of each bucket of a batch, a bucket at a time: a struct array, whose fields are read without Python objects."""
    for bucket in batch.column("members"):
        yield bucket.values


def _longs(members: pa.StructArray, name: str) -> np.ndarray:
    return members.field(name).to_numpy(zero_copy_only=False)


def _star(batches):
    """Links of each bucket: each member to the least id that it reaches within the bucket over pairs at the radius or nearer."""
    for batch in batches:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in _buckets(batch):
            reps = _longs(members, "rep")
            order = np.argsort(reps, kind="stable")
            reps, prints = reps[order], _longs(members, "fp")[order].view(np.uint64)
            near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
            root = np.arange(len(reps))
            while True:
                least = np.where(near, root[None, :], len(reps)).min(axis=1)
                if (least == root).all():
                    break
                root = least
            other = root != np.arange(len(reps))
            found_a.append(reps[other])
            found_b.append(reps[root[other]])
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(found_a)), "b": pa.array(np.concatenate(found_b))})


def close_links(prints: DataFrame, within: str = "") -> DataFrame:
    """(a, b), a > b: links that join all of the distinct (rep, fp) at Hamming distance 3 or less as all pairs would.

    Level 1 has 15 tables; a table's key is the fingerprint under its mask. Buckets of at most ``BUCKET`` members are
    compared within; larger ones go to the next level, whose masks hold more bits, and at the last level none is larger.
    A bucket yields a star for each of its groups, not its pairs.
    """
    rows = prints.select("rep", "fp", F.lit(0).alias("table"))
    links = None
    for level, masks in enumerate(covering_masks()):
        mask = F.element_at(F.lit([_signed(m) for m in masks]), F.col("table") + 1)
        deal = F.explode(F.sequence(F.col("table") * TABLES, F.col("table") * TABLES + TABLES - 1))
        rows = rows.select("rep", "fp", deal.alias("table")).withColumn("key", F.col("fp").bitwiseAND(mask))
        sizes = written(rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"simhash-sizes{level}", within)
        shared = written(rows.join(sizes, ["table", "key"]), f"simhash-shared{level}", within)
        small = shared.where(F.col("n") <= BUCKET) if level < LEVELS - 1 else shared
        stars = small.groupBy("table", "key").agg(F.collect_list(F.struct("rep", "fp")).alias("members")).select("members").mapInArrow(_star, "a long, b long")
        links = stars if links is None else links.unionByName(stars)
        if level == LEVELS - 1 or not shared.where(F.col("n") > BUCKET).limit(1).count():
            break
        rows = shared.where(F.col("n") > BUCKET).select("rep", "fp", "table")
    return links.distinct()


def components(links: DataFrame, within: str = "") -> DataFrame:
    """(node, component): the least node reachable, for each node of the links (a, b).

    Alternating large and small stars, by joins and minima alone; every step is written to the shared folder, and the
    loop ends when a step changes no link, after about as many steps as the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", within)
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", within)
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large", within)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", within)
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges, before = written(small.distinct(), "links", within), now
        now = mark(edges)
        if now == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fingerprint (64-bit SimHash of word shingles, signed long), component_id, for every row of ``docs``.

    Fingerprints at 3 or fewer differing bits link; component_id is the least doc_id reachable, itself included. Equal
    fingerprints are one node, named by their least doc_id, so copies add no pairs. Null and empty texts have fingerprint
    0 and link like any other. A row with a null id gets its fingerprint's component but links nothing by itself;
    repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), shingle_words).alias("fp")), "simhash")
    with steps(docs.sparkSession, "simhash-steps") as folder:
        nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes", folder)
        groups = components(close_links(nodes, folder), folder).withColumnRenamed("node", "rep")
        named = written(nodes.join(groups, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-groups")
    return prints.join(named, "fp", "left").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Duplicate groups at a similarity of word shingles. SimHash at radius 3 finds only the nearest of them: see the README.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Least shingle hashes of a text, each a key under which it meets others; two texts at similarity 0.8 share none with
#: probability 0.2 ** 16.
KEYS = 16
#: Least hashes from which a pair's similarity is estimated, 32 bits of each. Of so many least ones of the pair's union, both
#: texts must have ``LEAST_COMMON`` before their whole sets are compared; at similarity 0.8 they have fewer with probability
#: 4e-8. Unions of fewer shingles are judged by all of them.
SKETCH, LEAST_COMMON = 64, 32
BROADCAST_PAIRS = 250_000
#: Under a key, pairs count as likely from this estimate on: 40 of 64 least hashes in common. Pairs at similarity 0.8 have
#: about 57.
LEAST_ESTIMATE = 40 / (2 * SKETCH - 40)
#: Counters of shingles, by the first bits of their hashes. The order of a text's shingles hangs on them, but no link does.
COUNTER_BITS, COUNTER_PARTS = 18, 64
#: Fills a sketch of fewer hashes.
NO_HASH = np.iinfo(np.int32).max


def _sketched(k: int):
    @F.pandas_udf("content string, fp long, n int, keys array<long>, sketch array<int>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            hashes = shingle_hashes(words, k)
            distinct = np.unique(hashes)
            keys = (distinct * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            least = np.sort(np.partition(keys, SKETCH)[:SKETCH] if len(keys) > SKETCH else keys)
            rows.append((xxhash.xxh3_128_hexdigest(b" ".join(words)), simhash(hashes), len(distinct), least[:KEYS].view(np.int64), (least >> np.uint64(32)).astype(np.int32)))
        return pd.DataFrame(rows, columns=["content", "fp", "n", "keys", "sketch"])

    return sketch


def _shingle_set(k: int):
    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words_of(t), k)).view(np.int64) for t in texts])

    return shingles


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _counts(docs: DataFrame, k: int) -> np.ndarray:
    """In how many texts the shingles of each counter are: a task sums its texts, and parts of the sums are added by key."""

    def count(batches):
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                np.add.at(counts, _counter(np.unique(shingle_hashes(words_of(t), k))), 1)
        if counts.any():
            parts = np.split(counts, COUNTER_PARTS)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(COUNTER_PARTS), pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": part["part"][:1], "counts": [sum(np.frombuffer(x, np.int64) for x in part["counts"]).tobytes()]})

    found = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(1 << COUNTER_BITS, np.int64)


def _prefixed(k: int, similarity: float, counts: np.ndarray):
    @F.pandas_udf("n int, prefix array<long>")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            distinct = np.unique(shingle_hashes(words_of(t), k))
            n = len(distinct)
            least = int(np.ceil(similarity * n - 1e-9))
            rows.append((n, distinct[np.lexsort((distinct, counts[_counter(distinct)]))[: n - least + 1]].view(np.int64)))
        return pd.DataFrame(rows, columns=["n", "prefix"])

    return prefix


def _cells(similarity: float):
    """Pairs (a, b) of other groups in each cell of two chunks (or one) of a shingle's texts: those that the places of the
    shingle in their orders, their sizes and then their sketches leave a chance."""

    def pairs(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for members in _buckets(batch):
                reps, groups, n, left, chunk = (_longs(members, c) for c in ("rep", "group", "n", "left", "chunk"))
                enough = similarity / (1 + similarity) * (n[:, None] + n[None, :]) - 1e-9
                can = (groups[:, None] != groups[None, :]) & (np.minimum(left[:, None], left[None, :]) >= enough)
                if chunk.min() < chunk.max():
                    can &= chunk[:, None] != chunk[None, :]
                near = np.argwhere(np.triu(can, 1))
                if len(near):
                    found.append(reps[_promising(_sketches(members), near, similarity)])
            some = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(some[:, 1]), "b": pa.array(some[:, 0])})

    return pairs


def _apart(docs: DataFrame, texts: DataFrame, groups: DataFrame | None, shingle_words: int, similarity: float, folder: str) -> DataFrame:
    """(a, b): all pairs of texts of different groups that may be similar, by the prefix filter.

    A text's shingles are put in one order for all texts, rare ones first. Similar texts share a shingle among the first
    n - ceil(similarity n) + 1 of each. Texts of such a shingle are dealt into chunks, those of its largest group apart from
    the others; each pair of chunks that holds different groups is a row's key, so a common shingle is many small tasks.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), _prefixed(shingle_words, similarity, _counts(docs, shingle_words))(F.col("text")).alias("p"))
    own = texts.select("rep").distinct().withColumn("group", F.col("rep"))
    if groups is not None:
        own = own.select("rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("group"))
    prefixes = written(named.join(own, "rep").select("rep", "group", "p.*"), "prefixes", folder)
    rows = prefixes.select("rep", "group", "n", F.posexplode("prefix").alias("at", "token"))
    of_group = rows.groupBy("token", "group").agg(F.count(F.lit(1)).alias("c"))
    tokens = of_group.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("all"), F.max(F.struct("c", "group")).alias("most")).where("groups > 1")
    size = BUCKET // 2
    # Where no group has several texts, there is none to set apart.
    major = F.when(F.col("most.c") > 1, F.col("most.group"))
    tokens = tokens.select("token", major.alias("major"), F.ceil((F.col("all") - F.when(major.isNotNull(), F.col("most.c")).otherwise(0)) / size).alias("q"), F.when(major.isNotNull(), F.ceil(F.col("most.c") / size)).otherwise(0).alias("p"))
    met = rows.join(written(tokens, "apart-shingles", folder), "token")
    deal, in_major = F.xxhash64("rep", "token"), F.coalesce(F.col("group") == F.col("major"), F.lit(False))
    met = met.withColumn("in_major", in_major).withColumn("chunk", F.when(F.col("in_major"), F.col("q") + F.pmod(deal, F.col("p"))).otherwise(F.pmod(deal, F.col("q"))))
    met = met.join(texts.select("rep", "sketch").dropDuplicates(["rep"]), "rep")
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("in_major"), F.col("q") - 1).otherwise(F.col("q") + F.col("p") - 1))))
    member = F.struct("rep", "group", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("at")).cast("long").alias("left"), "chunk", "sketch")
    cells = met.groupBy("token", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")).agg(F.collect_list(member).alias("members"))
    return cells.where(F.size("members") > 1).select("members").mapInArrow(_cells(similarity), "a long, b long").distinct()


def _sketches(members: pa.StructArray) -> np.ndarray:
    """A line for each member: its distinct least hashes in order, then ``NO_HASH``."""
    column = members.field("sketch")
    lengths = np.diff(column.offsets.to_numpy())
    lines = np.full((len(members), SKETCH), NO_HASH, dtype=np.int32)
    lines[np.arange(SKETCH) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    lines.sort(axis=1)
    lines[:, 1:][lines[:, 1:] == lines[:, :-1]] = NO_HASH
    lines.sort(axis=1)
    return lines


def _estimates(sizes: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    """Estimated similarity of each pair of members; 0 where it can't reach ``similarity``."""
    real = sketches != NO_HASH
    lengths = real.sum(axis=1)
    _, at = np.unique(sketches[real], return_inverse=True)
    has = np.zeros((len(sizes), at.max(initial=0) + 1), dtype=np.float32)
    has[np.repeat(np.arange(len(sizes)), lengths), at] = 1
    common = has @ has.T
    guess = common / np.maximum(lengths[:, None] + lengths[None, :] - common, 1)
    never = np.minimum(sizes[:, None], sizes[None, :]) < similarity * np.maximum(sizes[:, None], sizes[None, :])
    guess[never | (guess < LEAST_ESTIMATE)] = 0
    return guess


def _forest(guess: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of greatest estimates: any other pair is joined by pairs that are likelier links."""
    m, found = len(guess), []
    best, of, left = guess[0].copy(), np.zeros(m, dtype=int), np.ones(m, dtype=bool)
    left[0] = False
    for _ in range(m - 1):
        k = int(np.argmax(np.where(left, best, -1)))
        if best[k] > 0:
            found.append((k, int(of[k])))
        left[k] = False
        nearer = guess[k] > best
        best, of = np.where(nearer, guess[k], best), np.where(nearer, k, of)
    return found


def _promising(sketches: np.ndarray, pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Of these pairs of members, those whose union's least hashes leave a chance of ``similarity``."""
    both = np.sort(np.concatenate([sketches[pairs[:, 0]], sketches[pairs[:, 1]]], axis=1), axis=1)
    real, fresh = both != NO_HASH, np.ones(both.shape, dtype=bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    rank = np.cumsum(fresh & real, axis=1, dtype=np.int16)
    common = (~fresh & real & (rank <= SKETCH)).sum(axis=1)
    return pairs[(common >= LEAST_COMMON) | (common >= similarity * np.minimum(rank[:, -1], SKETCH) - 1e-9)]


def _likely(similarity: float):
    """Pairs (a, b) of each bucket of members: those of its forest that their sketches leave a chance."""

    def pairs(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for members in _buckets(batch):
                reps, sketches = _longs(members, "rep"), _sketches(members)
                forest = _forest(_estimates(_longs(members, "n").astype(float), sketches, similarity))
                found.append(reps[_promising(sketches, np.array(forest, dtype=np.int64).reshape(-1, 2), similarity)])
            some = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(some[:, 1]), "b": pa.array(some[:, 0])})

    return pairs


def duplicate_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each distinct non-null id: documents of the same words are one, and those whose sets of
    word shingles have a Jaccard similarity of ``similarity`` or more link.

    First, what is easily found is joined: SimHash neighbours by covering hashing, and texts that share one of their 16
    least shingle hashes. Texts under such a key are dealt into buckets of about ``BUCKET``; a bucket yields a spanning
    forest of its likeliest pairs, and a key of several buckets also compares each text with one hub, so a key of any
    number of texts costs a few pairs a text. Candidates whose sizes and least hashes leave a chance are checked on their
    whole sets.

    Then the prefix filter (``_apart``) passes every pair of groups still apart that may be at ``similarity``, but for the
    sketches' chance (see ``LEAST_COMMON``), and these are checked likewise. The first step only saves work of the second.

    Null and empty texts are one group. An id of several rows goes by one of its texts; an empty table gives an empty one;
    other columns are ignored.
    """
    with steps(docs.sparkSession, "duplicate-steps") as folder:
        return written(_grouped(docs, shingle_words, similarity, folder), "duplicate-groups")


def _grouped(docs: DataFrame, shingle_words: int, similarity: float, folder: str) -> DataFrame:
    sketch = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _sketched(shingle_words)(F.col("text")).alias("s"))
    marks = written(sketch.select("doc_id", "s.content", F.struct("s.fp", "s.n", "s.keys", "s.sketch").alias("rest")), "copies", folder)
    texts = written(marks.groupBy("content").agg(F.min("doc_id").alias("rep"), F.min_by("rest", "doc_id").alias("rest")).select("content", "rep", "rest.*"), "texts", folder)
    tried = written(_joined_first(texts, similarity, folder), "pairs-first", folder)
    groups, links = None, None
    if n := tried.count():
        links = _similar(docs, tried, n, shingle_words, similarity, "first", folder)
        groups = written(components(links, folder), "groups-first", folder)
    pairs = written(_apart(docs, texts, groups, shingle_words, similarity, folder).join(tried, ["a", "b"], "left_anti"), "pairs-apart", folder)
    if n := pairs.count():
        found = _similar(docs, pairs, n, shingle_words, similarity, "apart", folder)
        groups = written(components(found if links is None else links.unionByName(found), folder), "groups-apart", folder)
    copies = marks.join(texts.select("content", "rep"), "content").select("doc_id", "rep")
    if groups is None:
        return copies.groupBy("doc_id").agg(F.min("rep").alias("component_id"))
    named = texts.select("rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component_id"))
    return copies.join(named, "rep").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _joined_first(texts: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(a, b): candidates that join most of what is similar, a few a text; see ``duplicate_groups``."""
    keyed = texts.select("rep", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min_by("rep", F.xxhash64("rep")).alias("hub")).where("texts > 1"), "shared-keys", folder)
    met = written(keyed.join(shared, "key"), "met", folder)
    sketches = texts.select("rep", "n", "sketch")
    bucket = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("texts") / BUCKET)).alias("bucket")
    dealt = met.join(sketches, "rep").groupBy("key", bucket).agg(F.collect_list(F.struct("rep", "n", "sketch")).alias("members"))
    forests = dealt.where(F.size("members") > 1).select("members").mapInArrow(_likely(similarity), "a long, b long")
    others = met.where((F.col("texts") > BUCKET) & (F.col("rep") != F.col("hub"))).select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b"))
    prints = written(texts.groupBy("fp").agg(F.min("rep").alias("rep")), "prints", folder)
    same = texts.join(prints.withColumnRenamed("rep", "first"), "fp").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    others = others.unionByName(same).unionByName(close_links(prints, folder)).distinct()
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    others = others.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect("ka", "kb")))
    others = others.where((common >= LEAST_COMMON) | (common >= similarity * F.size(union) - 1e-9)).select("a", "b")
    return forests.unionByName(others).distinct()


def _similar(docs: DataFrame, pairs: DataFrame, n: int, shingle_words: int, similarity: float, name: str, folder: str) -> DataFrame:
    """The ``n`` pairs whose whole sets of shingles are similar. Ids of few pairs are broadcast; more are joined by shuffle."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if n <= BROADCAST_PAIRS else wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = written(some.select("doc_id", _shingle_set(shingle_words)("text").alias("set")), f"sets-{name}", folder)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    jaccard = F.when(F.size("x") + F.size("y") > 0, common / (F.size("x") + F.size("y") - common)).otherwise(1.0)
    return written(both.where(jaccard >= similarity).select("a", "b"), f"similar-{name}", folder)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each duplicate group, that of the least id, as it is. Rows that repeat its id go but for one; rows
    with a null id stay, as nothing names them."""
    kept = duplicate_groups(docs, **options).where("doc_id = component_id").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
