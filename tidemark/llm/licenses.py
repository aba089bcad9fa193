"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_texts import NOTICES, TEXTS
from tidemark.llm.shared import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A template of at least ``SLACK_FROM`` different words is held by a block with this share of them; a notice of fewer must be whole
#: but for a word in twenty, as so few words without one say something else.
CONTAINMENT, SLACK_FROM, SHORT_CONTAINMENT = 0.8, 12, 0.95
TEMPLATES = NOTICES | TEXTS


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of a-z, 0-9 and characters beyond ASCII; null counts as empty."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words from the globally rarest on, by the documents that hold them; ties by code point."""
    held = F.array_intersect(words(F.col("text")), F.lit(vocabulary))
    counts = {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as the templates have words
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(size: int, containment: float = CONTAINMENT) -> int:
    """Of a template of ``size`` different words, how many a block must have."""
    share = containment if size >= SLACK_FROM else max(containment, SHORT_CONTAINMENT)
    return math.ceil(share * size - 1e-9)


def step_of(template: str) -> int:
    """The step of a template's blocks, which are twice as long: the power of two that its words fit into, 16 at least."""
    return max(16, 1 << (len(_template_words(template)) - 1).bit_length())


def prefix_index(sets: Mapping[str, list[str]], steps: Mapping[str, int], order: list[str], containment: float) -> list[tuple]:
    """(token, step, label, i, size, need): the first size - need + 1 words of each template in global order, with their places."""
    rank, index = {w: k for k, w in enumerate(order)}, []
    for label, s in sets.items():
        need = needed(len(s), containment)
        index += [(w, steps[label], label, i, len(s), need) for i, w in enumerate(sorted(s, key=rank.__getitem__)) if i <= len(s) - need]
    return index


def candidate_pairs(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of a block (its columns; ``tokens`` in global order) and a template that may hold: they share a word in both
    prefixes (the first m - need + 1 of a block's m), the block has words enough (length filter), and so have the rests
    after the shared word (positional filter). Only the first word shared by a pair of prefixes counts, so a pair is one row."""
    probe = blocks.select("*", F.size("tokens").alias("m"), F.posexplode("tokens").alias("j", "token"))
    met = probe.join(F.broadcast(index), ["token", "step"])  # as many rows as the templates' prefixes have words
    long_enough = (F.col("m") >= F.col("need")) & (F.col("j") <= F.col("m") - F.col("need"))
    in_place = 1 + F.least(F.col("size") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= F.col("need")
    return met.where(long_enough & in_place).drop("token", "i", "j", "m").dropDuplicates(["row", "block", "step", "label"])


def phrase_places(tokens: Column, phrase: list[str]) -> Column:
    """Starts, in words from 0, of the places where the phrase's words stand consecutively."""
    here = lambda i: [F.get(tokens, i + k) == w for k, w in enumerate(phrase)]

    def at(i):
        first, *more = here(i)
        for x in more:
            first = first & x
        return first

    found = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), at)
    return F.when(F.array_contains(tokens, phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    A template's blocks are windows of twice its ``step_of`` words, a step apart; so every run of as many words as it has is
    within a block. A template of n different words is in a block if the block has ``needed(n)`` of them. Both sides' words
    are ordered from the globally rarest on, and pairs go through ``candidate_pairs``; those left are checked exactly.
    ``score``: the greatest containment in a block that meets the threshold, 1 with a phrase, else 0.

    Null texts count as empty, with 0 words and no label; label strings are empty where there is none, first_word and
    last_word null. Repeated rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    sets = {label: list(dict.fromkeys(_template_words(t))) for label, t in templates.items()}
    steps = {label: step_of(t) for label, t in templates.items()}
    order = token_order(docs, sorted({w for s in sets.values() for w in s}))
    index = prefix_index(sets, steps, order, containment)

    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    places = F.concat(*[phrase_places(F.col("words"), _template_words(p)) for p in phrases])
    own = F.concat(*[F.when(F.size(phrase_places(F.col("words"), _template_words(p))) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for p, label in phrases.items()])
    maybe = F.arrays_overlap("words", F.lit(sorted({_template_words(p)[-1] for p in phrases})))

    def blocks_of(step: int) -> Column:
        prefix = F.lit(sorted({x[0] for x in index if x[1] == step}))
        cut = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(step)), lambda at: F.slice("words", at, 2 * step))
        with_step = F.transform(F.filter(cut, lambda b: F.arrays_overlap(b, prefix)), lambda b: F.struct(F.lit(step).alias("step"), F.array_intersect(F.lit(order), b).alias("tokens")))
        return F.when(F.arrays_overlap("words", prefix), with_step).otherwise(F.array().cast("array<struct<step:int,tokens:array<string>>>"))

    # Words of no template never match, so of a block its templates' words are kept, in global order.
    blocks = F.concat(*[blocks_of(step) for step in sorted(set(steps.values()))])
    found = split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(maybe, places).otherwise(F.array().cast("array<int>")).alias("places"), F.when(maybe, own).otherwise(F.array().cast("array<string>")).alias("base"), blocks.alias("blocks"))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "license-blocks")

    one = found.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.*")
    side = docs.sparkSession.createDataFrame(index, "token string, step int, label string, i int, size int, need int")
    words_of = F.create_map(*[x for label, s in sets.items() for x in (F.lit(label), F.lit(s))])
    common = F.size(F.array_intersect(F.col("tokens"), F.element_at(words_of, F.col("label"))))
    links = candidate_pairs(one, side).withColumn("common", common).where("common >= need").groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("common") / F.col("size")).alias("held"))

    out = found.drop("blocks").join(links, "row", "left")
    label = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(label, ",").alias("labels"), score.alias("score"))
