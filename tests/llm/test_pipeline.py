from collections import Counter

import corpus_pipeline
from monthwise.llm.decontamination import benchmark_leaks
from monthwise.llm.similarity import deduplicate, similarity_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    source = docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
        assert docs.columns[:5] == source.columns
        if name == "ngram_jaccard_join":
            groups = similarity_components(before).collect()
            assert {r.doc_id for r in rows[name]} == {r.component_id for r in groups}
            assert len(rows[name]) == len({r.component_id for r in groups})
        if name == "benchmark_decontamination":
            leaks = {r.doc_id for r in benchmark_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in rows[name]} == {r.doc_id for r in rows["ngram_jaccard_join"]} - leaks
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows[name]).values()) <= 2
    assert Counter(r.doc_id for r in rows["sharding"]) == Counter(r.doc_id for r in rows["mixing"])
    assert len(rows["toxicity"]) < source.count()


def test_run_equals_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"shard", "slot"} <= set(out.columns) and out.count() > 100


def test_deduplicate_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lonely words here"), (2, None), (3, ""), (2, "other text")]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == [(False, 1, "a b c d e f"), (False, 2, ""), (False, 2, "other text"), (False, 3, ""), (True, 0, "lonely words here")]


def test_deduplicate_rows_that_repeat_without_end(spark):
    """Rows that are a large share of all are reduced where they are read, with their other columns; rare repeats meet in the join."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "hot")] * 3000 + [(None, None, "none")] * 2500 + [(2, "", "blank")] * 2 + [(3, "a b c", "x"), (3, "a b c", "x"), (1, "other text", "y")]
    rows += [(100 + i, f"one of its own {i}", "z") for i in range(300)] + [(50, long + " more", "near")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(5)
    got = sorted((r.doc_id or 0, r.text or "", r.row_key) for r in deduplicate(df).collect())
    want = sorted({(d or 0, t or "", k) for d, t, k in rows} - {(50, long + " more", "near")})
    assert got == want
