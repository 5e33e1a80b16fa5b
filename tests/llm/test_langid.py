import regex
import zstandard
from pyspark.sql import functions as F

from monthwise.llm.langid import _SEARCH, PIECE_BYTES, held_out, identify, language_samples, op7_language_id

SCHEMA = "doc_id long, text string, score string"


def test_held_out_accuracy(spark):
    out = op7_language_id(spark, "/root/testdata/sf0.01")
    got = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_odd_rows(spark):
    known = {"xx": b"lorem ipsum dolor sit amet " * 40, "yy": "größe straße über fluß mäuse ".encode() * 40}
    rows = [(1, None, ""), (2, "", ""), (3, "123 !? \n", ""), (4, "ipsum dolor", ""), (5, "Straße über", ""), (5, "Straße über", ""), (None, "größe " * 200_000, ""), (6, "q", "")]
    got = identify(spark.createDataFrame(rows, SCHEMA), known).collect()
    assert [r.lang_pred for r in got[:7]] == ["und", "und", "und", "xx", "yy", "yy", "yy"]
    assert all(0 <= r.score <= 1 for r in got) and [r.score for r in got[:3]] == [0, 0, 0]
    assert got[7].lang_pred in known and got[7].lang_accepted is None


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_samples(none) == {}
    assert identify(none, {}).count() == 0
    one = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(one, language_samples(one)).collect()] == ["und"]


def brute(text, samples):
    """The language whose dictionary makes the pieces of a text smallest, with new compressors for every text."""
    data = regex.sub(r"[^\p{L}]+", " ", (text or "").lower()).strip().encode()
    if not data or not samples:
        return "und"
    n = -(-len(data) // PIECE_BYTES)
    cuts = [len(data) * i // n for i in range(n + 1)]
    setting = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_SEARCH)
    best = None
    for lang, content in samples.items():
        tool = zstandard.ZstdCompressor(compression_params=setting, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        size = sum(len(tool.compress(data[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))
        if best is None or size < best[0]:
            best = size, lang
    return best[1]


def test_predictions_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = language_samples(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op7_language_id(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: brute(t, samples) for k, t in texts.items()}


def test_samples_are_bounded_and_repeat(spark):
    rows = [(1, f"wort nummer {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 9, "de") for i in range(3000)] + [(1, "the same text " * 50, "en")] * 2000 + [(2, "uno dos tres", "es"), (3, "123", "fr"), (4, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_samples(df.repartition(n), n_texts=20, n_bytes=2000) for n in (2, 7))
    assert one == two and list(one) == ["de", "en", "es"]
    assert max(map(len, one.values())) <= 2000 and one["es"] == b"uno dos tres" and 1500 < len(one["de"])
    assert len({w for w in one["de"].split() if len(w) == 3}) > 15
