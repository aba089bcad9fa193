"""The pipeline's stages in turn: each over what the one before kept."""

import corpus_pipeline
from tests.compare import SF
from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm.shared import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, last = docs.columns, {r["doc_id"] for r in docs.collect()}, len(corpus_pipeline.STAGES) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept
        ids = kept
        if k < last:
            assert docs.columns == columns
        if name == "packing":
            want = packing.pack(before).count()
            assert docs.count() == want


def test_filters_catch_toxic_and_keep_clean(spark):
    """On 10,000 documents; the smallest table has too few toxic ones to learn from."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for stage, toxic in ((corpus_pipeline.drop_toxic, True), (corpus_pipeline.drop_poor, False)):
        kept = {r["doc_id"] for r in stage(spark, docs, folder).select("doc_id").collect()}
        bad = [k for k, r in labels.items() if (r["toxic"] == 1 if toxic else r["quality"] == 0)]
        good = [k for k, r in labels.items() if (r["toxic"] == 0 if toxic else r["quality"] == 1)]
        caught, left = sum(k not in kept for k in bad) / len(bad), sum(k in kept for k in good) / len(good)
        print(stage.__name__, "caught", caught, "kept", left)
        assert left >= 0.95 and caught >= (0.9 if toxic else 0.5)


KIND = "doc_id long, text string, lang string, source string, n_chars long, row_hash string, taken int, fp long"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names the stages use themselves."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "words of a row without an id here", "en", "a", 33), (None, None, None, None, None), (3, "some words " * 40_000, "en", "b", 440_000)]
    rows += [(4, "one and the same text on two rows of one id", "en", "b", 43)] * 2 + [(5, "one and the same text on two rows of one id", "en", None, 43), (6, " \n\t ", "en", "c", 5)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND)


def test_odd_rows_through_each_stage(spark):
    docs = odd_documents(spark)
    counts = {name: stage(spark, docs, SF) for name, stage in corpus_pipeline.STAGES}
    for name in ("toxicity", "quality", "near_duplicates"):
        assert counts[name].columns == docs.columns
    assert counts["toxicity"].count() == docs.count()
    assert sorted((r["doc_id"] or 0, r["text"] is None) for r in counts["near_duplicates"].collect()) == [(0, False), (0, True), (1, True), (3, False), (4, False)]
    mixed = counts["mixing"].collect()
    assert counts["mixing"].columns == docs.columns[:5] and all(r["text"].split() for r in mixed) and {r["doc_id"] for r in mixed} <= {None, 3, 4, 5}
    assert {r["doc_id"] for r in counts["packing"].select("doc_id").collect()} == {None, 1, 2, 3, 4, 5, 6}


def test_empty_table_through_each_stage(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_against_the_stages_by_brute_force(spark):
    """What is left after the filters, from the models' own decisions on each text and all pairs of shingle sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    tox, qua = toxicity.fit(docs, labels), None
    clean = {r["doc_id"]: r["text"] for r in docs.collect() if tox.score(r["text"])[0] < 0.7}
    kept = docs.where(docs.doc_id.isin(list(clean)))
    qua = quality.fit(kept, labels)
    good = {k: t for k, t in clean.items() if qua.score([t])[0] >= 0.5}
    sets = {k: set(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for k, t in good.items()}
    linked = {k: {j for j in sets if j < k and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])} for k in sets}
    first = {}
    for k in sorted(sets):
        mine = {first[j] for j in linked[k]} | {k}
        for j, f in list(first.items()):
            if f in mine:
                first[j] = min(mine)
        first[k] = min(mine)
    want = set(first.values())
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = written(stage(spark, out, SF), f"test-{name}")
    assert {r["doc_id"] for r in out.collect()} == want
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    taken = {r["doc_id"] for r in mixing.mix_plan(out, same=docs.columns).where("taken > 0").collect()}
    assert ids == taken
