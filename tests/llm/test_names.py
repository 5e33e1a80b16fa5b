"""Extra columns with the names of working columns, of other case, or with a dot, through every operator."""

import pytest

from monthwise.llm import chat, decontamination, langid, mixing, pii, quality, sharding, similarity, substring, toxicity

EXTRA = ["bundle", "start", "shard", "inside", "n", "key", "row", "range", "alone_shard", "scale", "whole", "weight", "target", "fillers", "row_key", "again", "in_0", "a.b", "_ROW_KEY", "spans", "_lang", "_source", "limit_lang", "word_length_max", "Margin", "block", "bucket", "hits", "_hits", "features"]
MODEL = toxicity.Model(__import__("numpy").zeros(1 << toxicity.BITS, "float32"), 0.0)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"one two three four five six {i % 3}", "s", "en", *(f"{c}{i}" for c in EXTRA)) for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA))


OPERATORS = {
    "sharding": (sharding.assign_shards, sharding.ADDED, 6),
    "mixing": (mixing.mix_sources, mixing.ADDED, 6),
    "similarity": (similarity.deduplicate, (), 3),
    "pii": (lambda d: pii.pseudonymise(d, "k"), ("found", "n_replaced"), 6),
    "substring": (substring.deduplicate_units, ("kept_text", "n_removed", "removed"), 6),
    "langid": (lambda d: langid.identify(d, {"en": b"one two three four"}), ("lang_pred", "margin", "score", "lang_accepted"), 6),
    "decontamination": (lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "one two three four five six 1")], "item_id long, text string")), (), 4),
    "quality": (quality.quality, (*quality.MEASURES, "base_failed", "kept"), 6),
    "toxicity": (lambda d: toxicity.score_texts(d, MODEL), ("score", "predicted"), 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_are_carried(docs, name):
    run, added, n = OPERATORS[name]
    out = run(docs)
    gone = {c.lower() for c in (*added, *(substring.ADDED if name == "substring" else ()))}
    carried = [c for c in docs.columns if c.lower() not in gone]
    assert out.columns == carried + list(added)
    got = [r.asDict() for r in out.collect()]
    assert len(got) == n
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in EXTRA if c in carried)


def test_chats_with_extra_columns(spark):
    chats = spark.createDataFrame([(1, 0, "user", "hi", "x", "y"), (1, 1, "assistant", "ho", "x", "y")], "conv_id long, turn int, role string, text string, `a.b` string, source string")
    assert [r.n_turns for r in chat.format_chats(chats).collect()] == [2]
