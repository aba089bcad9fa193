"""Mix sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD, written
from tidemark.operators.ordered import running_sums, with_key

BLOCK_WORDS = 64
SHARD_WORDS = 16_384
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: The table of sources is broadcast up to so many rows; beyond it, it's joined by shuffle.
BROADCAST_SOURCES = 50_000
SEED = 20_231


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets in words for (source, source_size), one row a source.

    Sources in order of code points, null last, take the weights in turn. A target is its weight times one common
    level, or ``max_repeats`` times its source's size if that is less; the level is where targets sum to all sizes.
    Numbers and sums go by ranges of sources, so tables with a source for each domain take no single task.
    """
    far = F.lit(float("inf"))
    numbered = running_sums(with_key(totals, "_at", "source").withColumn("_at", F.coalesce("_at", far)), "_at", {"_no": F.lit(1)}, ["source"]).drop("_at")
    ranked = numbered.withColumn("source_no", F.col("_no") - 1).drop("_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(max_repeats)).withColumn("full_at", F.col("most") / F.col("weight"))
    ranked = written(ranked, "mix-ranked")
    whole = ranked.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    filling = running_sums(ranked, "full_at", {"_most": F.col("most"), "_weight": F.col("weight")}, ["source_no"]).join(F.broadcast(whole))
    # Sources below the common level are full; it is the greatest level that a source, with all lesser ones full, can hold.
    level = (F.col("_all") - (F.col("_most") - F.col("most"))) / (F.col("_weights") - (F.col("_weight") - F.col("weight")))
    common = filling.withColumn("_level", level).agg(F.max(F.when(F.col("_level") <= F.col("full_at"), F.col("_level"))).alias("_common"))
    return ranked.join(F.broadcast(common)).withColumn("target", F.least(F.col("most"), F.col("weight") * F.col("_common"))).drop("most", "full_at", "_common")


def sainte_lague(rows: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the row's part of its group's ``seats`` (equal within a group) by highest quotients votes / (2k + 1), over all
    rows of a group at once, however many there are: totals are aggregates, and the contest goes by ranges of the quotient.

    Rounded quotas come within a few seats of the answer; only those seats are contested. A row can gain or lose no
    more than share * (difference + rows) + 1 seats, so the contest has at most difference + 3 * rows entries.
    """
    totals = rows.groupBy(*group).agg(F.sum(votes).cast("double").alias("_votes"), F.count(F.lit(1)).alias("_rows"))
    share = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)
    base = rows.join(totals, group).withColumn("_share", share).withColumn("_base", F.floor(F.col(seats) * F.col("_share") + 0.5))
    given = base.groupBy(*group).agg(F.sum("_base").alias("_given"))
    base = base.join(given, group).withColumn("_diff", F.when(F.col("_votes") > 0, F.col(seats) - F.col("_given")).otherwise(0)).drop("_given")
    base = written(base, "mix-rounded")
    step = F.explode(F.sequence(F.lit(0), F.floor(F.col("_share") * (F.abs("_diff") + F.col("_rows"))).cast("int") + 1))
    seat = F.when(F.col("_diff") > 0, F.col("_base") + F.col("_k")).otherwise(F.col("_base") - 1 - F.col("_k"))
    offers = base.where("_diff <> 0").select(*group, key, votes, "_base", "_diff", step.alias("_k")).withColumn("_seat", seat).where("_seat >= 0")
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    offers = offers.withColumn("_worth", F.when(F.col("_diff") > 0, -quotient).otherwise(quotient))
    ranked = running_sums(offers, "_worth", {"_rank": F.lit(1)}, [key, "_k"], by=group)
    won = ranked.where("_rank <= abs(_diff)").groupBy(*group, key).agg(F.sum(F.signum(F.col("_diff").cast("double"))).cast("long").alias("_more"))
    return base.join(won, [*group, key], "left").withColumn(out, F.col("_base") + F.coalesce("_more", F.lit(0))).drop("_votes", "_rows", "_share", "_base", "_diff", "_more")


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, same: list[str] | None = None) -> DataFrame:
    """How often the mix takes each part of each document; one row for every row of ``docs`` (doc_id, text, source).

    Documents of a source are dealt over shards by hash and laid end to end in hash order; every ``block_words`` words
    are a block. Blocks are apportioned by Sainte-Laguë to all sources by target, then to all shards of a source by words.
    A shard of n blocks with quota q takes every block q div n times and the q mod n blocks that come first in seeded
    order once more. Equal rows are numbered, each copy with a hash of its own, so that many of them are in many shards.

    Returns doc_id, source, size, source_size, target, taken, and ``row_hash``, ``passes`` (times taken whole), ``start`` (its
    first word in the shard), ``more`` (the shard's blocks taken once more).
    Null and empty texts have size 0, lie in no shard and take 0; null sources are one source, the last; repeated rows each
    count; an empty table gives an empty one. Other columns are ignored. ``same``: the columns that tell rows apart for ``row_hash``.
    """
    spread = F.xxhash64(*[F.col(c) for c in same or ["doc_id", "text", "source"]], F.lit(seed))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread.alias("row_hash"))
    copies = sized.groupBy("doc_id", "source", "size", "row_hash").agg(F.count(F.lit(1)).alias("copies"))
    each = copies.select("doc_id", "source", "size", "row_hash", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    own_hash = F.when(F.col("copy") == 1, F.col("row_hash")).otherwise(F.xxhash64("row_hash", "copy"))
    sized = written(each.withColumn("copy_hash", own_hash), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    all_blocks = sources.agg(F.round(F.sum("source_size") / block_words).cast("long").alias("all_blocks"))
    sources = written(sources.join(F.broadcast(all_blocks)).withColumn("_all", F.lit(0)), "mix-targets")
    sources = sainte_lague(sources, ["_all"], "source_no", "target", "all_blocks", "source_blocks")
    sources = written(sources.drop("_all", "all_blocks"), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    side = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    placed = sized.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    empty = placed.where("size = 0")  # a source may hold very many, and no block has any of them
    placed = placed.where("size > 0").withColumn("shard", F.pmod("copy_hash", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))))
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size")).join(sources.select("source_no", "source_blocks"), "source_no")
    dealt = sainte_lague(shards, ["source_no"], "shard", "shard_size", "source_blocks", "quota")
    blocks = F.ceil(F.col("shard_size") / block_words)
    dealt = dealt.withColumn("blocks", blocks).withColumn("quota", F.least("quota", F.col("blocks") * max_repeats))
    dealt = dealt.withColumn("passes", F.floor(F.col("quota") / F.col("blocks")))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.xxhash64(F.lit(seed), F.col("source_no"), F.col("shard"), b).alias("h"), b.alias("b"))))
    more = F.when(F.col("quota") > F.col("passes") * F.col("blocks"), F.slice(drawn, 1, (F.col("quota") - F.col("passes") * F.col("blocks")).cast("int"))["b"]).otherwise(F.array().cast("array<bigint>"))
    dealt = written(dealt.select("source_no", "shard", "passes", more.alias("more")), "mix-quotas")
    laid = Window.partitionBy("source_no", "shard").orderBy("copy_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    plan = placed.withColumn("start", F.coalesce(F.sum("size").over(laid), F.lit(0))).join(dealt, ["source_no", "shard"])
    overlap = F.aggregate(F.col("more"), F.lit(0).cast("long"), lambda n, b: n + F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size"), (b + 1) * block_words) - F.greatest(F.col("start"), b * block_words)))
    zero = F.lit(0).cast("long")
    empty = empty.select("doc_id", "source", "size", "source_size", "target", zero.alias("taken"), "row_hash", zero.alias("passes"), zero.alias("start"), F.array().cast("array<bigint>").alias("more"))
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + overlap).alias("taken"), "row_hash", "passes", "start", "more").unionByName(empty)


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The documents as the mix takes them, with their columns: a row for each time a whole text is taken, and one with
    the text's blocks that are taken once more, joined in order, white space kept. Rows that aren't taken go; n_chars
    is set anew. Null texts and texts without words hold no blocks and go; null ids and sources stay as they are; repeated
    rows are each taken by their own part of the plan; an empty table gives an empty one; other columns are dropped."""
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    seed = options.get("seed", SEED)
    plan = mix_plan(docs, block_words=block_words, same=keep, **options).where("taken > 0")
    # Keys without nulls: texts of a key are dealt out once, for leaving repeats out and for the join.
    keys = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    takes = plan.withColumns(keys).select(*keys, "row_hash", F.struct("passes", "start", "size", "more").alias("take"))
    texts = docs.select(*keep).withColumns(keys).withColumn("row_hash", F.xxhash64(*keep, F.lit(seed))).dropDuplicates([*keys, "row_hash"])
    both = texts.join(takes, [*keys, "row_hash"]).select(*keep, "take")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+$)?"), F.lit(0))
    start, size = F.col("take.start"), F.col("take.size")
    mine = F.array_sort(F.filter(F.col("take.more"), lambda b: ((b + 1) * block_words > start) & (b * block_words < start + size)))
    first = lambda b: F.greatest(b * block_words - start, F.lit(0).cast("long"))
    last = lambda b: F.least((b + 1) * block_words - start, size)
    spans = F.transform(mine, lambda b: F.struct(first(b).cast("int").alias("at"), (last(b) - first(b)).cast("int").alias("n")))
    both = both.withColumn("spans", spans).withColumn("words", F.when(F.size("spans") > 0, words))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), s["at"] + 1, s["n"]))), "")
    whole = F.array_repeat(F.col("text"), F.col("take.passes").cast("int"))
    texts = F.when(F.size("spans") > 0, F.concat(whole, F.array(part))).otherwise(whole)
    out = both.select("doc_id", "lang", "source", F.explode(texts).alias("text"))
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))
