"""Removal of repeated lines and passages by unit hashing.

A text's units are its lines, and the sentences of a line that has several. With
``runs`` they are its lines and the runs of whole sentences, over lines too, that
just reach ``min_sentence`` words, counted on from each sentence and back from each:
of a repeated stretch with that many words every whole sentence goes, however short,
and a short sentence that is repeated alone stays. Runs overlap, so a word that goes
has an earlier copy that stays, but a run need not stay in one piece. A unit
is normalised to its words, with A-Z as a-z and any white space between them, and
stands for itself by a 96-bit digest. Units of fewer than ``min_words`` words
(``min_sentence`` for sentences) are never removed. Of the units with one digest in
all documents the earliest ranked stays: the smallest doc_id (null last), then the
first in the text. The others are cut out of their texts.

1. Every task sends, for each digest it sees in its documents, the first rank and
   the count: a partial aggregate, so a line that a third of all documents hold is
   a row a task. Digests with a count above 1 are the table of repeats.
2. The units are made again, which costs less than storing them, and joined with
   the repeats; those that are not the first are the spans to remove. The repeats
   have a row a digest, so Spark can split a hot digest's units over tasks.
3. Spans are gathered per document, merged, and cut out of the text. They are
   returned as code points (start from 0, length) of the original text.

Defined results: a null or wordless text stays as it is; a document
whose every unit is repeated has an empty text; rows that repeat doc_id and text
are one document and get the same answer; columns named as the added ones are
replaced, others are carried; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import kernels
from .store import apart, cut

MIN_WORDS, MIN_SENTENCE = 5, 12
ADDED = ("kept_text", "n_removed", "removed", "spans")
UNITS = "row_key long, doc_id long, a long, b int, start int, length int"
_SALTS = (np.uint64(0x6A09E667), np.uint64(0xBB67AE85))
_TAIL = re.compile(r"[ \t\r\f\v]*\n?")
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def units(texts: kernels.Texts, min_words: int = MIN_WORDS, min_sentence: int = MIN_SENTENCE, runs: bool = False) -> dict[str, np.ndarray]:
    """text, a, b, start, length (code points) of each line and each sentence or run of sentences that is long enough."""
    w = kernels.words(texts)
    n = len(w.hash)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("text", "a", "b", "start", "length")}
    breaks = np.concatenate([[0], np.cumsum(texts.data == 10)])
    new_line = np.ones(n, bool)
    new_line[1:] = (w.text[1:] != w.text[:-1]) | (breaks[w.start[1:]] != breaks[w.end[:-1]])
    new_sentence = new_line.copy()
    new_sentence[1:] |= _ENDS[texts.data[w.end[:-1] - 1]]
    spans = []
    for begins, least in ((new_line, min_words), (new_sentence, min_sentence)):
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n)
        if runs and begins is new_sentence:
            to = np.searchsorted(last, first + least)  # from each sentence the fewest that have enough words
            on = np.flatnonzero(to < len(last))
            start = np.searchsorted(first, last - least, side="right") - 1  # and up to each
            back = np.flatnonzero(start >= 0)
            first, last = np.concatenate([first[on], first[start[back]]]), np.concatenate([last[to[on]], last[back]])
            same = w.text[first] == w.text[last - 1]
            first, last = first[same], last[same]
        long = last - first >= least
        spans.append(np.stack([first[long], last[long]]))
    both = np.unique(np.concatenate(spans, axis=1), axis=1)
    first, last = both
    chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    start, end = chars[w.start[first]], chars[w.end[last - 1]]
    a, b = (kernels.run_hash(kernels.mix(w.hash + salt), first, last).view(np.int64) for salt in _SALTS)
    return {"text": w.text[first], "a": a, "b": b >> 32, "start": start - chars[texts.offsets[w.text[first]]], "length": end - start}


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"), doc_id.isNull(), text.isNull())


def document_units(documents: DataFrame, min_words: int = MIN_WORDS, min_sentence: int = MIN_SENTENCE, runs: bool = False) -> DataFrame:
    """row_key, doc_id, a, b (digest), start, length: a row per unit."""
    rows = documents.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def found(batches):
        for batch in batches:
            for texts in kernels.slices(batch.column(2)):
                u = units(texts, min_words, min_sentence, runs)
                at = pa.array(u["text"] + texts.first)
                own = [pa.array(u["a"])] + [pa.array(u[k].astype(np.int32)) for k in ("b", "start", "length")]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *own], [x.split()[0] for x in UNITS.split(", ")])

    return rows.mapInArrow(found, UNITS)


def _rank() -> Column:
    """The order of units: by doc_id, null last; half of a row's key tells rows of one doc_id apart, and one other row in 2^32 at the same start stays beside the first."""
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.shiftright("row_key", 32).cast("int").alias("key"), "start")


def repeated_units(found: DataFrame) -> DataFrame:
    """a, b, first (id, key, start): for each digest that is met more than once, where it stands first."""
    many = found.groupBy("a", "b").agg(F.min(_rank()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.select("a", "b", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"))


def _merged(spans: list[dict] | None) -> list[dict]:
    """Sorted spans with those inside each other as one."""
    out: list[dict] = []
    for s in spans or []:
        if out and s["start"] < out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], s["start"] + s["length"] - out[-1]["start"])
        else:
            out.append(dict(s))
    return out


def _without(text: str, spans: list[dict]) -> str:
    """The text less its spans and the white space behind each, up to the end of the line."""
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : s["start"]])
        at = _TAIL.match(text, s["start"] + s["length"]).end()
    return "".join([*parts, text[at:]])


def deduplicate_units(documents: DataFrame, min_words: int = MIN_WORDS, min_sentence: int = MIN_SENTENCE, runs: bool = False) -> DataFrame:
    """``documents`` with kept_text, n_removed and removed (start, length of each removed stretch)."""
    base, of, columns = apart(documents.drop(*ADDED))
    found = document_units(base.select(of["doc_id"].alias("doc_id"), of["text"].alias("text")), min_words, min_sentence, runs)
    repeats = cut(repeated_units(found))
    gone = found.join(repeats, ["a", "b"]).where((F.shiftright("row_key", 32).cast("int") != F.col("first_key")) | (F.col("start") != F.col("first_start")))
    spans = F.sort_array(F.collect_set(F.struct("start", "length")))
    gone = gone.groupBy("row_key").agg(spans.alias("spans"))
    rows = base.withColumn("row_key", row_key(of["doc_id"], of["text"])).join(gone, "row_key", "left").drop("row_key")
    at = [c.lower() for c in documents.drop(*ADDED).columns].index("text")
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("length", IntegerType())]))
    added = [StructField("kept_text", StringType()), StructField("n_removed", LongType()), StructField("removed", span)]

    def without(batches):
        for batch in batches:
            texts, spans = batch.column(at), batch.column(batch.num_columns - 1)
            kept, removed = [], []
            for text, own in zip(texts, spans, strict=True):
                merged = _merged(own.as_py())
                removed.append(merged)
                kept.append(_without(text.as_py(), merged) if merged else text.as_py())
            columns = [pa.array(kept, pa.string()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, to_arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "kept_text", "n_removed", "removed"])

    to_arrow = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    out = rows.mapInArrow(without, StructType([*base.schema.fields, *added]))
    return out.select(*columns, *(f.name for f in added))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text without what stands earlier elsewhere, and what was removed by its original offsets."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate_units(documents, runs=True).select("doc_id", F.col("kept_text").alias("text"), "n_removed", "removed")
