"""Quality rules with thresholds that each language and source sets itself.

Every text is measured once. The shares of symbols, of repeated words and of
duplicate lines and the mean word length of the texts that pass the base rule go
into mergeable quantile sketches per language and source: counts of logarithmic
buckets, so that a quantile is off by at most ``ERROR`` of its value, two sketches
merge by adding counts, and every rerun on any partitioning gives the same sketch.
The sketches of a language's sources merge into the language's, and those into one
of all texts. A threshold lies ``spread`` times the distance of the quartile from
the median beyond the quartile, and at least ``slack``, so that a group without any
variation doesn't reject what is barely different. It lies at most ``step`` beyond
the wider group's threshold, or beyond the group's own median if that is further out
(for all texts: beyond the median), so that junk in up to half of a group doesn't
set its limit. A group of n texts weighs n / (n + ``MIN_ROWS``) against the wider
one. The thresholds are joined back by language and source, and every text is kept
whose values lie within. Sketches are partial aggregates: a hot source costs a
task at most a row for each bucket.

Defined results: null, empty and blank texts have 0 in all counts and fail the
base rule; where no text passes it there are no thresholds; null languages and
sources are groups like others; a value equal to a threshold is kept; repeated rows
are judged alike; an empty table gives an empty table; columns named as the added
ones are replaced, others are carried whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from . import kernels
from .store import apart, cut, from_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: name: (has a lower limit, spread, slack, step)
RULES = {
    "word_length": (True, 12.0, 1.0, 3.0),
    "symbol_share": (False, 12.0, 0.25, 0.5),
    "dup_line_share": (False, 12.0, 0.25, 0.25),
    "repeat_share": (False, 12.0, 0.1, 0.1),
}
MIN_ROWS = 200
#: The relative error of a quantile, and the ratio of neighbouring buckets' bounds.
ERROR = 0.005
GAMMA = (1 + ERROR) / (1 - ERROR)
#: The bucket of 0; all values are 0 or more than 1e-12.
ZERO = -10_000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _measure(texts: kernels.Texts) -> list[np.ndarray]:
    n = len(texts)
    w = kernels.words(texts, fold=False)
    n_words = np.bincount(w.text, minlength=n)
    chars = texts.sums(~_SPACE[texts.data] & ((texts.data & 0xC0) != 0x80))
    symbols = texts.sums(_SYMBOL[texts.data])
    rows = kernels.lines(texts)
    n_lines = np.bincount(rows.text, minlength=n)
    order = np.lexsort((rows.hash, rows.text))
    same = (rows.hash[order][1:] == rows.hash[order][:-1]) & (rows.text[order][1:] == rows.text[order][:-1])
    dup_lines = np.bincount(rows.text[order][1:][same], minlength=n)
    sh, text, at = kernels.shingles(w.hash, w.text, WINDOW)
    order = np.lexsort((sh, text))
    same = (sh[order][1:] == sh[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(sh), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + WINDOW, -1)
    repeated = np.bincount(w.text[np.cumsum(covered)[:-1] > 0], minlength=n)
    return [n_words, chars, symbols, dup_lines, repeated, n_lines]


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with MEASURES, all long."""

    def measured(column: pa.Array) -> list[pa.Array]:
        parts = [_measure(texts) for texts in kernels.slices(column)]
        return [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)

    return from_text(documents, [StructField(m, LongType()) for m in MEASURES], lambda: measured)


def base_failed(of=F.col) -> Column:
    return (of("n_words") < MIN_WORDS) | (of("n_repeat_words") * 100 > of("n_words") * MAX_REPEAT_PERCENT)


def _value(name: str, of=F.col) -> Column:
    words = F.greatest(of("n_words"), F.lit(1))
    return {
        "word_length": of("word_chars") / words,
        "symbol_share": of("n_symbols") / words,
        "dup_line_share": of("n_dup_lines") / F.greatest(of("n_lines"), F.lit(1)),
        "repeat_share": of("n_repeat_words") / words,
    }[name]


def sketched(measured: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all values of texts that pass the base rule."""
    bucket = lambda v: F.when(v <= 0, ZERO).otherwise(F.ceil(F.log(v) / F.lit(math.log(GAMMA)))).cast("int")
    values = F.array(*(F.struct(F.lit(r).alias("rule"), bucket(_value(r)).alias("bucket")) for r in RULES))
    rows = measured.where(~base_failed()).select("lang", "source", F.explode(values).alias("v"))
    return rows.groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, group: list[str], prefix: str) -> DataFrame:
    """Per group, the rows and the three quartiles of each rule."""
    merged = sketch.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*group, "rule")
    merged = merged.withColumn("run", F.sum("n").over(own.orderBy("bucket"))).withColumn("rows", F.sum("n").over(own))
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) * (2 / (GAMMA + 1)))
    at = lambda r, q: F.min(F.when((F.col("rule") == r) & (F.col("run") * 100 >= F.col("rows") * q), value))
    columns = [at(r, q).alias(f"{prefix}{r}_{q}") for r in RULES for q in (25, 50, 75)]
    return merged.groupBy(*group).agg(F.max("rows").alias(f"{prefix}rows"), *columns)


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and, per rule, the least and the largest value that is kept."""
    sketch = cut(sketched(measured))  # at most a row for each bucket, rule, language and source

    def limit(rule: str, side: int, prefix: str, wider: Column | None) -> Column:
        """The largest value (side 1) or the least (side -1) of a group, within a step of the wider one's."""
        _, spread, slack, step = RULES[rule]
        mid, quartile = (side * F.col(f"{prefix}{rule}_{q}") for q in (50, 50 + 25 * side))
        bound = mid if wider is None else F.greatest(side * wider, mid)
        own = F.least(quartile + F.greatest(spread * (quartile - mid), F.lit(slack)), bound + step)
        if wider is not None:
            weight = F.col(f"{prefix}rows") / (F.col(f"{prefix}rows") + MIN_ROWS)
            own = weight * own + (1 - weight) * side * wider
        return side * own

    own, lang, whole = quartiles(sketch, ["lang", "source"], "s_"), quartiles(sketch, ["lang"], "l_").withColumnRenamed("lang", "lang_of"), quartiles(sketch, [], "a_")
    wide = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_of")), "left").join(F.broadcast(whole), how="left")  # one row
    columns = []
    for rule, (low, *_) in RULES.items():
        for name, side in (("min", -1), ("max", 1)):
            value = limit(rule, side, "s_", limit(rule, side, "l_", limit(rule, side, "a_", None)))
            columns.append((value if side > 0 or low else F.lit(None).cast("double")).alias(f"{rule}_{name}"))
    return cut(wide.select("lang", "source", *columns))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept."""
    base, of, columns = apart(measured.drop("base_failed", "kept"))
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    rows = base.join(limits, of["lang"].eqNullSafe(F.col("limit_lang")) & of["source"].eqNullSafe(F.col("limit_source")), "left")
    within = F.lit(True)
    for rule in RULES:
        value = _value(rule, of.get)
        within &= F.coalesce(value <= F.col(f"{rule}_max"), F.lit(True)) & F.coalesce(value >= F.col(f"{rule}_min"), F.lit(True))
    failed = base_failed(of.get)
    return rows.select(*columns, failed.alias("base_failed"), (~failed & within).alias("kept"))


def quality(documents: DataFrame) -> DataFrame:
    """``documents`` with MEASURES, base_failed and kept. Texts are measured twice rather than stored."""
    limits = thresholds(cut(measure(documents.select("lang", "source", "text")).drop("text")))
    return judge(measure(documents), limits)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    measured = cut(measure(documents).drop("text"))
    return judge(measured, thresholds(measured)).select("doc_id", *MEASURES[:5], "base_failed", "kept")
