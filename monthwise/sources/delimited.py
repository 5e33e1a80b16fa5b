"""Delimited text whose delimiter and quoting are found from all of its lines.

Each line is counted for every candidate, quoted parts left out, and the counts are
summed over the whole file: the candidate that splits most lines into the same number
of fields is the file's. Amounts like ₹1,200.50 whose thousands separators are not
quoted are a candidate of their own, commas with such amounts quoted. Only files with
a line break inside quotes are read a file a task; others are split as text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Scan, under_header

DELIMITERS = (",", ";", "\t", "|")
_MONEY = r"([₹$€£][\d,]+\.\d{2})"


@dataclass(frozen=True)
class Format:
    """How lines are written: the delimiter, the fields most lines have, whether amounts are to be quoted, and whether quotes hold line breaks."""

    sep: str
    width: int
    quote_money: bool = False
    multiline: bool = False


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, value: the lines of files with their places."""
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.text(path).select(*place, "value")


def quoted_money(line: Column) -> Column:
    """Amounts with a currency sign in quotes, in a line that has none."""
    return F.when(F.contains(line, F.lit('"')), line).otherwise(F.regexp_replace(line, _MONEY, '"$1"'))


def find_format(lines: DataFrame, quote_money: bool = False) -> Format:
    """The format of lines (value); ties go to more fields, then to the order of DELIMITERS."""
    outside = lambda line: F.regexp_replace(line, r'"[^"]*"', "")
    plain, repaired = outside(F.col("value")), outside(quoted_money(F.col("value")))
    counted = lambda text, sep: F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))
    ways = [(sep, False) for sep in DELIMITERS if not (quote_money and sep == ",")] + [(",", True)]
    votes = [F.struct(F.lit(i).alias("way"), counted(repaired if money else plain, sep).alias("n")) for i, (sep, money) in enumerate(ways)]
    odd = F.pmod(counted(F.col("value"), '"'), F.lit(2))
    found = lines.where(F.trim("value") != "").select(odd.alias("odd"), F.explode(F.array(*votes)).alias("v")).groupBy("v.way", "v.n").agg(F.count(F.lit(1)).alias("lines"), F.sum("odd").alias("odd"))
    found = found.groupBy("way").agg(F.max(F.when(F.col("n") > 0, F.struct("lines", "n"))).alias("best"), F.sum("odd").alias("odd")).collect()  # a row a candidate
    best = max((r for r in found if r["best"]), key=lambda r: (r["best"]["lines"], r["best"]["n"], -r["way"]), default=None)
    broken = any(r["odd"] for r in found)
    if best is None:
        return Format(",", 1, quote_money, broken)
    sep, money = ways[best["way"]]
    return Format(sep, best["best"]["n"] + 1, money, broken)


def fields_of(lines: DataFrame, form: Format) -> DataFrame:
    """path, block, at, fields of lines; one field more than the format's width is kept, to tell lines that have more."""
    names = [f"c{i}" for i in range(form.width + 1)]
    value = quoted_money(F.col("value")) if form.quote_money else F.col("value")
    parsed = F.from_csv(value, ", ".join(f"{n} string" for n in names), {"sep": form.sep, "escape": '"'})
    return lines.select("path", "block", "at", parsed.alias("c")).select("path", "block", "at", F.array(*(F.col(f"c.{n}") for n in names)).alias("fields"))


def scan_lines(lines: DataFrame, quote_money: bool = False) -> Scan:
    """Records and rejected lines of (path, block, at, value); no quotes may hold line breaks."""
    form = find_format(lines, quote_money)
    return under_header(fields_of(lines, form), form.sep)


def scan(spark: SparkSession, path: str, quote_money: bool = False) -> Scan:
    """Records and rejected lines of files of one format."""
    lines = numbered_lines(spark, path)
    form = find_format(lines, quote_money)
    if not form.multiline:
        return under_header(fields_of(lines, form), form.sep)
    names = [f"c{i}" for i in range(form.width + 1)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, sep=form.sep, escape='"', multiLine=True)
    place = [F.col("_metadata.file_path").alias("path"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("at")]
    return under_header(raw.select(*place, F.array(*names).alias("fields")), form.sep)
