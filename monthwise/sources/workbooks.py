"""Workbooks (.xlsx): rows of the first sheet, each cell as the workbook shows it.

A sheet is compressed as one stream, so one task inflates it, and does nothing else:
it cuts the XML behind a row every PIECE_BYTES. The pieces are dealt out, parsed by many
tasks, and cells are joined to the shared strings and the number formats by their
numbers. Numbers, dates, percentages and amounts are written by expressions.

Dates are written as yyyy-MM-dd (with HH:mm:ss if the format has a time, or the time
alone), booleans as TRUE and FALSE, errors and texts as they are; a format without
digits, and fractions and exponents, read as general numbers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Scan, under_header

PIECE_BYTES, READ_BYTES = 4 << 20, 1 << 20
#: The numbers of built-in formats and their codes.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}
PARTS = "path string, kind string, first long, content binary, style int, form string, decimals int, grouped boolean, before string, after string, brackets boolean"
_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]


def number_format(code: str) -> dict:
    """What a format code shows: form (date, time, datetime, percent, number, general), decimals, grouped, before, after, brackets."""
    first, _, second = code.partition(";")
    money = re.sub(r"\[\$([^\]-]*)[^\]]*\]", lambda m: f'"{m[1]}"', first)
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.', "", money, flags=re.I)
    day, time = re.search(r"[yd]|mmm", bare, re.I), re.search(r"[hs]", bare, re.I)
    form = "datetime" if day and time else "date" if day or re.fullmatch(r"\W*m+\W*", bare, re.I) else "time" if time else "percent" if "%" in bare else "number" if re.search(r"[0#]", bare) and not re.search(r"[eE/?]", bare) else "general"
    digits = re.search(r"[#0][#0,]*(?:\.([0#]+))?", bare)
    text = re.sub(r"\\(.)|_.|\*.|\[[^\]]*\]", r"\1", money).replace('"', "")
    at = re.search(r"[#0][#0,.]*", text)
    return {
        "form": form,
        "decimals": len(digits[1] or "") if digits else 0,
        "grouped": bool(digits and "," in digits[0]),
        "before": text[: at.start()].lstrip() if at and form == "number" else "",
        "after": text[at.end() :].rstrip() if at and form == "number" else "",
        "brackets": "(" in second,
    }


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The entry of the first sheet, and whether days count from 1904."""
    names, early = set(book.namelist()), False
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        early = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
        link = next(({_local(k): v for k, v in e.attrib.items()}.get("id") for e in root.iter() if _local(e.tag) == "sheet"), None)
        for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = (rel.get("Target") or "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if rel.get("Id") == link and target in names:
                return target, early
    sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    if not sheets:
        raise ValueError("the workbook has no sheet")
    return min(sheets, key=lambda n: int(re.sub(r"\D", "", n))), early


def _pieces(book: zipfile.ZipFile, entry: str, root: str, item: str) -> Iterator[tuple[int, bytes]]:
    """(number of items before, XML) of each piece of an entry: whole items under the root's own tag, with its namespaces."""
    held, opening, first = b"", b"", 0
    begin, end = re.compile(rb"<(?:\w+:)?%s[\s/>]" % item.encode()), re.compile(rb"</(?:\w+:)?%s\s*>" % item.encode())
    with book.open(entry) as content:
        while True:
            step = content.read(READ_BYTES)
            held += step
            if not opening and (found := re.search(rb"<((?:\w+:)?%s)\b[^>]*>" % root.encode(), held)):
                opening, closing, held = found[0], b"</" + found[1] + b">", held[found.end() :]
            if step and len(held) < PIECE_BYTES:
                continue
            ends = [m.end() for m in end.finditer(held)]
            if opening and ends:
                start = begin.search(held).start()
                piece, held = held[start : ends[-1]], held[ends[-1] :]
                yield first, opening + piece + closing
                first += len(begin.findall(piece))
            if not step:
                return


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows and of shared strings, and the formats, of each workbook."""

    def out(path: str, kind: str, **more) -> pa.RecordBatch:
        row = {"path": path, "kind": kind, **more}
        return pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)

    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                sheet, early = _first_sheet(book)
                for first, piece in _pieces(book, sheet, "worksheet", "row"):
                    yield out(path, "rows", first=first, content=piece, style=int(early))
                if "xl/sharedStrings.xml" in book.namelist():
                    for first, piece in _pieces(book, "xl/sharedStrings.xml", "sst", "si"):
                        yield out(path, "strings", first=first, content=piece)
                if "xl/styles.xml" in book.namelist():
                    root = ElementTree.fromstring(book.read("xl/styles.xml"))
                    codes = BUILT_IN | {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _local(e.tag) == "numFmt"}
                    styles = [x for e in root if _local(e.tag) == "cellXfs" for x in e]
                    for i, x in enumerate(styles):
                        yield out(path, "styles", style=i, **number_format(codes.get(int(x.get("numFmtId") or 0), "")))


def _texts(element) -> str:
    """The text of a string item without its phonetic hints."""
    return "".join(t.text or "" for part in element if _local(part.tag) != "rPh" for t in part.iter() if _local(t.tag) == "t")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts = [_texts(e) for e in ElementTree.fromstring(content)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())], ["path", "number", "shared"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "row", "at", "kind", "style", "value", "early"], [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32()]
    for batch in batches:
        for path, first, content, early in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = []
            for number, row in enumerate(ElementTree.fromstring(content), first):
                at = 0
                for c in row:
                    if letters := re.match(r"[A-Z]+", c.get("r", "")):
                        at = 0
                        for letter in letters[0]:
                            at = at * 26 + ord(letter) - 64
                    else:
                        at += 1
                    kind = c.get("t", "n")
                    value = _texts(next((e for e in c if _local(e.tag) == "is"), ())) if kind == "inlineStr" else next((e.text for e in c if _local(e.tag) == "v"), None)
                    if value:
                        found.append((path, number, at - 1, kind, int(c.get("s") or 0), value, early))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)


def _general(v: Column) -> Column:
    """A number with at most eleven digits, without zeros at the end."""
    places = F.greatest(F.lit(0), F.lit(10) - F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-300))))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    text = F.when(F.abs(v) < 1e15, (F.rint(v * scale) / scale).cast("decimal(30,12)").cast("string"))
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), v.cast("string"))


def _shown(v: Column, raw: Column, early: Column) -> Column:
    """A number as its format shows it."""
    digits = F.abs(F.round(F.when(F.col("form") == "percent", v * 100).otherwise(v).cast("decimal(30,12)"), 9))
    power = F.pow(F.lit(10), F.col("decimals")).cast("decimal(20,0)")
    units = F.round(digits * power, 0).cast("decimal(38,0)")
    whole = F.floor(units / power).cast("decimal(38,0)").cast("string")
    whole = F.when(F.col("grouped"), F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1,")).otherwise(whole)
    fraction = F.when(F.col("decimals") > 0, F.concat(F.lit("."), F.lpad((units % power).cast("decimal(20,0)").cast("string"), F.col("decimals"), F.lit("0")))).otherwise("")
    text = F.concat(F.coalesce("before", F.lit("")), whole, fraction, F.coalesce("after", F.lit("")), F.when(F.col("form") == "percent", "%").otherwise(""))
    number = F.when((v < 0) & (units > 0), F.when(F.col("brackets"), F.concat(F.lit("("), text, F.lit(")"))).otherwise(F.concat(F.lit("-"), text))).otherwise(text)
    # Days count from 1899-12-30; before March 1900 one day more, since a 29 February 1900 is counted.
    day = F.floor(v).cast("int")
    date = F.when(early == 1, F.date_add(F.lit("1904-01-01").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), day + F.when(day < 60, 1).otherwise(0))).cast("string")
    second = F.pmod(F.round((v - F.floor(v)) * 86400).cast("long"), F.lit(86400))
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    time = F.concat_ws(":", part(F.floor(second / 3600)), part(F.floor(F.pmod(second, F.lit(3600)) / 60)), part(F.pmod(second, F.lit(60))))
    form = F.col("form")
    return F.coalesce(F.when(form == "date", date).when(form == "time", time).when(form == "datetime", F.concat(date, F.lit(" "), time)).when(form.isin("number", "percent"), number).otherwise(_general(v)), raw)


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, fields: the rows of the first sheet of each workbook."""
    parts = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parts, PARTS)
    dealt = lambda kind, *columns: parts.where(F.col("kind") == kind).select("path", "first", "content", *columns).repartition("path", "first")
    cells = dealt("rows", "style").mapInArrow(_cells, "path string, row long, at int, kind string, style int, value string, early int")
    strings = dealt("strings").mapInArrow(_strings, "path string, number long, shared string")
    styles = parts.where("kind = 'styles'").select("path", "style", "form", "decimals", "grouped", "before", "after", "brackets")
    # Cells that are no shared strings go by a number that none has, each row its own.
    number = F.when(F.col("kind") == "s", F.col("value").try_cast("long")).otherwise(-1 - F.col("row"))
    cells = cells.withColumn("number", number).join(strings, ["path", "number"], "left").join(styles, ["path", "style"], "left")
    v = F.col("value").try_cast("double")
    text = F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "b", F.when(F.col("value") == "1", "TRUE").otherwise("FALSE")).when((F.col("kind") == "n") & v.isNotNull(), _shown(v, F.col("value"), F.col("early"))).otherwise(F.col("value"))
    rows = cells.groupBy("path", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", text.alias("text")))).alias("cells"), F.max("at").alias("last"))
    return rows.select("path", F.lit(0).cast("long").alias("block"), F.col("row").alias("at"), F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.get(F.array(F.col("cells")[i]), F.lit(0)), F.lit(""))).alias("fields"))


def scan(spark: SparkSession, path: str) -> Scan:
    """Records and rejected rows of workbooks of one header."""
    return under_header(sheet_rows(spark, path))
