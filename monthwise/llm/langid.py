"""Language identification by compression.

Each language has a zstandard dictionary of raw text of ``DICT_BYTES``, cut from
``DICT_TEXTS`` of its labelled texts at most: those with the smallest hashes, from
each an equal share of bytes at a hashed place. Both are documented bounds of what
is learned; prediction reads every text whole. Texts are lower-cased and reduced to
letters and single spaces, since case and punctuation tell styles rather than
languages. A text is cut into pieces of about ``PIECE_BYTES``; every piece is
compressed with every dictionary on its own, so that a long text can't teach the
compressor its language, and the language with the least bytes in total wins. The
margin is how much smaller the winner is than the next language, as a share of the
winner's bytes. ``score`` rises with it, and a margin below ``min_margin`` is
rejected: ``lang_accepted`` is then null, while ``lang_pred`` still names the smallest.

Defined results: a text that is null or has no letter is ``und`` with score 0;
equal sizes go to the language with more different labelled texts, then to the
first by name; without labelled text every row is ``und``; with one language it is
certain; repeated rows get equal answers; an empty table gives an empty table;
columns with the names of added ones are replaced, others are carried whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .store import from_text

#: Bytes of a dictionary, and labelled texts that it is cut from at most.
DICT_BYTES, DICT_TEXTS = 48 << 10, 400
PIECE_BYTES = 1024
MIN_MARGIN = 0.01
LETTER = r"\p{L}"
UNKNOWN = "und"
#: Exhaustive enough to find three-byte matches in the dictionary, cheap enough for all text.
_SEARCH = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}


def plain(column: pa.Array) -> pa.Array:
    """Texts in lower case with a space for each run of other than letters."""
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}]+", " "))


def language_samples(labelled: DataFrame, n_texts: int = DICT_TEXTS, n_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary content per language from (lang, text) rows, the language with the most different texts first.

    Different texts are counted first, a sketch per language and task. From the
    counts follow, per language, a bound for the text's hash that about three times
    the wanted texts stay below, and how much is cut from each: both are applied
    where the table is read, so that only these candidates are shuffled and ranked.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(LETTER))
    rows = rows.select("lang", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 62)).alias("at"), "text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("at", 0.03).alias("texts")).collect()  # a row a language, of which each has a dictionary
    if not counts:
        return {}
    wanted = {r["lang"]: max(1, min(n_texts, r["texts"])) for r in counts}
    bound = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int((1 << 62) * min(1.0, 3 * n_texts / max(1, r["texts"]))))))
    share = F.create_map(*(F.lit(x) for lang, n in wanted.items() for x in (lang, 2 * max(64, n_bytes // n))))
    rows = rows.where(F.col("at") < bound[F.col("lang")]).withColumn("share", share[F.col("lang")])
    start = F.pmod(F.col("at"), F.greatest(F.lit(1), F.length("text") - F.col("share"))).cast("int") + 1
    rows = rows.select("lang", "at", F.substr("text", start, F.col("share")).alias("part")).distinct()
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("at", "part"))).where(F.col("rank") <= n_texts)
    found: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "rank").collect():  # n_texts short parts a language, n_bytes of letters
        found.setdefault(r["lang"], []).append(r["part"])
    out = {}
    for r in sorted(counts, key=lambda r: (-r["texts"], r["lang"])):
        parts = found.get(r["lang"], [])
        own = max(64, n_bytes // max(1, len(parts)))
        out[r["lang"]] = b" ".join(x.encode()[:own] for x in plain(pa.array(parts, pa.string())).to_pylist())[:n_bytes]
    return {lang: content for lang, content in out.items() if content}


def identify(documents: DataFrame, samples: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``documents`` with lang_pred, score, margin and lang_accepted."""
    shared = documents.sparkSession.sparkContext.broadcast(samples)  # DICT_BYTES a language

    def start():
        names, tools = list(shared.value), []
        for content in shared.value.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            setting = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_SEARCH)
            known.precompute_compress(compression_params=setting)
            tools.append(zstandard.ZstdCompressor(compression_params=setting, dict_data=known))

        def predicted(column: pa.Array) -> list[pa.Array]:
            langs, margins = [], []
            for text in plain(column):
                if not tools or text.as_buffer().size == 0:
                    langs.append(UNKNOWN)
                    margins.append(0.0)
                    continue
                data = text.as_buffer()
                view, n = memoryview(data), data.size
                n_pieces = -(-n // PIECE_BYTES)
                cuts = [n * i // n_pieces for i in range(n_pieces + 1)]
                sizes = np.array([sum(len(c.compress(view[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)) for c in tools], dtype=float)
                order = np.argsort(sizes, kind="stable")
                langs.append(names[order[0]])
                margins.append(float(sizes[order[1]] / sizes[order[0]] - 1) if len(order) > 1 else 1.0)
            return [pa.array(langs, pa.string()), pa.array(margins, pa.float64())]

        return predicted

    added = [StructField("lang_pred", StringType()), StructField("margin", DoubleType())]
    out = from_text(documents.drop("score", "lang_accepted"), added, start)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(1 - F.exp(-20 * F.col("margin")))
    accepted = F.when((F.col("margin") >= min_margin) & (F.col("lang_pred") != UNKNOWN), F.col("lang_pred"))
    return out.withColumn("score", score).withColumn("lang_accepted", accepted)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = language_samples(documents.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = identify(documents.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "lang_accepted")
