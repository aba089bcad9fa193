"""Document fingerprints: a Merkle tree over sections and paragraphs; roots test equality, differing branches locate edits."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

#: A paragraph is cut into leaves after sentence ends, and after so many characters without one.
LEAF_CHARS = 96
#: A section ends after a paragraph whose hash is 0 modulo this, so an edit moves no later border.
SECTION_PARAGRAPHS = 8
#: Ranges of ids that are walked one by one: about so many rows each, but no more ranges than that; their borders come from so
#: many sampled rows a range. Borders balance the work and change no result.
RANGE_ROWS, MOST_RANGES, SAMPLES_A_RANGE = 256, 50_000, 20

LEAF = re.compile(rf"[^.!?]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+")


#: Bytes of every digest of the tree, and hex digits of a leaf's that the branches show.
DIGEST, SHOWN = 16, 8


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def paragraph(text: str) -> tuple[bytes, str]:
    """(digest, branch) of one paragraph: the digest of its leaves' whole digests; in the branch, the first digits of each
    leaf's digest with its code points in hex. An empty paragraph has no leaf."""
    leaves = LEAF.findall(text)
    digests = [_digest(x.encode("utf-8", "surrogatepass")) for x in leaves]
    return _digest(b"".join(digests)), ",".join([f"{d.hex()[:SHOWN]}{len(x):x}" for d, x in zip(digests, leaves, strict=True)])


def assemble(nodes: list[tuple[bytes, str]]) -> str:
    """``root=section;section;...``, a section being its paragraphs joined by ``/``, a paragraph its leaves by commas.

    A section's digest is that of its paragraphs' digests, and the root that of its sections': every level is made of
    whole digests, so equal roots mean equal texts; only the branches, which locate edits, show short ones."""
    sections, roots, branches, digests = [], [], [], []
    for k, (digest, branch) in enumerate(nodes):
        branches.append(branch)
        digests.append(digest)
        if int.from_bytes(digest[:4]) % SECTION_PARAGRAPHS == 0 or k == len(nodes) - 1:
            sections.append("/".join(branches))
            roots.append(_digest(b"".join(digests)))
            branches, digests = [], []
    return f"{_digest(b''.join(roots)).hex()}={';'.join(sections)}"


def fingerprint(text: str) -> str:
    return assemble([paragraph(p) for p in text.split("\n")])


def _leaves(branches) -> Counter:
    out: Counter = Counter()
    for branch in branches:
        for leaf in branch.replace("/", ",").split(","):
            if leaf:
                out[leaf] += int(leaf[SHOWN:], 16)
    return out


def likeness(a: str, b: str) -> float:
    """Share of text in equal branches of two fingerprints, from 0 to 1: equal sections count whole, then leaves of the
    others. Twice the common code points over those of both; 1 if both texts are empty, 0 if one is."""
    if a == b:
        return 1.0
    sa, sb = Counter(a.partition("=")[2].split(";")), Counter(b.partition("=")[2].split(";"))
    same = sa & sb
    la, lb = _leaves((sa - same).elements()), _leaves((sb - same).elements())
    both = sum(_leaves(same.elements()).values())
    size = sum(la.values()) + sum(lb.values()) + 2 * both
    if not size:
        return 1.0
    return 2 * (both + sum(min(n, lb[k]) for k, n in la.items() if k in lb)) / size


def differing_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Where ``b``'s text differs from ``a``'s: code point spans (start, end) of the leaves of ``b``'s differing sections that
    aren't in ``a``'s. Sections, then leaves, are matched with repeats; neighbouring spans are one. What was only taken
    out of ``a`` leaves no span unless the leaves around it changed."""
    of_a = Counter(a.partition("=")[2].split(";"))
    sections = b.partition("=")[2].split(";")
    spare = Counter(leaf for section in (of_a - Counter(sections)).elements() for leaf in section.replace("/", ",").split(","))
    spans, at = [], 0
    for section in sections:
        same = of_a[section] > 0
        of_a[section] -= same
        for branch in section.split("/"):
            for leaf in branch.split(",") if branch else ():
                end = at + int(leaf[SHOWN:], 16)
                if not same and not spare[leaf]:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((at, end))
                elif not same:
                    spare[leaf] -= 1
                at = end
            at += 1  # the line end
    return spans


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of the next document, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(text: str, nodes: list[tuple[bytes, str]], following: str, next_print: str) -> tuple[int, str, str, str, float, float, int | None]:
    mine, changed = assemble(nodes), edited(text, following)
    # Paragraphs before the edit have the same branches.
    kept = text.count("\n", 0, len(text) - len(text) // 4)
    at = 0
    for _ in range(kept):
        at = text.index("\n", at) + 1
    theirs = assemble(nodes[:kept] + [paragraph(p) for p in changed[at:].split("\n")])
    spans = differing_spans(mine, theirs) if mine != theirs else []
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mine, theirs, likeness(mine, theirs), likeness(mine, next_print), spans[0][0] if spans else None


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, differs_from long"
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("differs_from", pa.int64())])
ROWS_A_BATCH = 256


def _walk(batches):
    """Rows sorted by range, each range ended by the first document of the next one: each document against the following."""
    before = None
    for big in batches:
        for k in range(0, big.num_rows, ROWS_A_BATCH):
            some, rows = big.slice(k, ROWS_A_BATCH), []
            for doc_id, text, ends in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), some.column("ends").to_pylist(), strict=True):
                nodes = [paragraph(p) for p in text.split("\n")]
                if before is not None:
                    rows.append((before[0], *_compared(*before[1:], text, assemble(nodes))))
                before = None if ends else (doc_id, text, nodes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text and of its edited text, its likeness to that and to the next document's, and
    ``differs_from``: where the first leaf of the edited text begins that the text's tree doesn't have (null: none).

    Ids and hashes of texts, without texts, give ranges of ids and the first document of each. That document also ends the
    range before (the first of all ends the last), so every range is complete. One shuffle by range brings the texts
    together, and a task walks its sorted ranges keeping two documents at a time.
    Null texts count as empty; null ids come last; rows of the same id go in order of a hash of the text, so repeated
    rows follow each other; a single document is its own next; an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # One number in the order of (id, hash): equal ids fall into several ranges if many rows share them.
    part = F.col("tie") / 2.0**64 + 0.5
    rows = rows.withColumn("place", F.when(F.col("doc_id").isNull(), 2.0**64 * (1 + part)).otherwise(F.col("doc_id") + part))
    marks = written(rows.select("doc_id", "tie", "place"), "merkle-marks")
    n = marks.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    sample = marks.sample(min(1.0, SAMPLES_A_RANGE * ranges / max(n, 1)), seed=7).select("place").toPandas()["place"].to_numpy()
    cuts = np.unique(np.quantile(sample, np.arange(1, ranges) / ranges, method="lower")) if len(sample) and ranges > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def range_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, places.to_numpy(), side="right").astype(np.int32))

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    firsts = marks.withColumn("range", range_of("place")).groupBy("range").agg(F.min(order).alias("f")).orderBy("range").collect()  # at most MOST_RANGES rows of three numbers
    if not firsts:
        return docs.sparkSession.createDataFrame([], FIELDS)
    follow = [(firsts[k - 1]["range"], f["f"]["doc_id"], f["f"]["tie"]) for k, f in enumerate(firsts)]
    side = docs.sparkSession.createDataFrame(follow, "range int, first_id long, first_tie long")
    ending = rows.join(F.broadcast(side), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))).dropDuplicates(["range"])
    names = ["range", "doc_id", "tie", "text", "ends"]
    both = rows.withColumn("range", range_of("place")).withColumn("ends", F.lit(False)).select(*names).unionByName(ending.withColumn("ends", F.lit(True)).select(*names))
    ranged = both.repartition("range").sortWithinPartitions("range", "ends", F.col("doc_id").asc_nulls_last(), "tie")
    return ranged.select("doc_id", "text", "ends").mapInArrow(_walk, FIELDS)
