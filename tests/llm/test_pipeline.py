import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, fixture_rows):
    from keyloom.llm import jaccard, mixing, packing, quality, suffix

    stages = dict(corpus_pipeline.STAGES)
    plain = docs.select(*corpus_pipeline.COLUMNS)
    one = stages["quality_rules"](spark, plain, "").cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in quality.score_quality(plain).collect() if r.kept)
    two = stages["near_duplicates"](spark, one, "").cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted({r.component_id for r in jaccard.jaccard_components(one).collect()})
    three = stages["repeated_passages"](spark, two, "").cache()
    kept = {r.doc_id: r.kept.decode(errors="ignore") for r in suffix.drop_repeats(two).collect()}
    assert {r.doc_id: r.text for r in three.collect()} == {d: t for d, t in kept.items() if t.strip(" \t\n\r\x0b\x0c")}
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = stages["mixed_sources"](spark, three, "").cache()
    assert four.count() == mixing.repeated(mixing.mix(three)).count() and set(four.columns) == set(corpus_pipeline.COLUMNS)
    five = stages["packed_sequences"](spark, four, "")
    assert five.select("doc_id").distinct().count() == four.select("doc_id").distinct().count()
    assert packing.Limits().tokens == 4096


def test_small_tables(spark, tmp_path, empty):
    empty.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_begin_with_freed_memory(spark, docs):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if any(x in b.getName() for x in ("Old", "MarkSweep")))
    plain = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, plain, "")
        assert full() > before, name
