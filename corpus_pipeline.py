"""Corpus pipeline: toxicity, quality, near duplicates, mixing and packing, each stage over all that the one before kept.

Every stage takes documents of any kind: null and empty texts count as empty (they're clean, have the quality score of no
features, are one near-duplicate group, hold no words to mix, and are one token to pack); rows of a null id are judged by
their text and are no near-duplicate of any row; repeated rows are judged alike, and one of them stays after the near-duplicate
stage if they have an id; an empty table gives an empty one. Columns beyond those of documents are kept by the first three
stages and dropped by the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that multiple-instance learning judges toxic (score 0.7 or more) go. Without labels of both kinds, none does."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects (score under 0.5) go. Without positive labels, none does."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the document of the least id stays; null ids all stay."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken as often as its target weight asks; rows are whole texts or their chosen blocks. Texts without words go;
    null sources are one source, the last."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, none of which crosses documents; each row of the documents is cut by itself."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Trained scores, shingle similarity and tokens aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again. An empty table runs
    through to an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
