"""From rows of text fields to records: the header line is found, and what is no record is kept as rejected.

A row is (path, block, at, fields): its file, and its place in it. Delimited lines and
workbooks come here alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words by which the headers of statement files are known, by canonical name.
HEADER_WORDS = {
    "Date": ("date", "posted on"),
    "Description": ("description", "particular", "narration", "remark", "detail", "memo", "narrative", "payee", "name", "merchant"),
    "Amount": ("amount", "value", "amt", "sum", "total"),
    "Debit": ("debit", "withdrawal", "dr", "paid out", "outflow"),
    "Credit": ("credit", "deposit", "cr", "paid in", "inflow", "income"),
    "Category": ("category", "type", "tag", "class", "group", "mode"),
    "Balance": ("balance", "remaining"),
}
CANONICAL = ("Date", "Description", "Category", "Amount", "Balance")
REJECTS = "path string, line string, reason string"
ABOVE, AGAIN, MANY, FEW = "above the header", "header again", "more fields than the header", "a single field"


@dataclass
class Scan:
    """The records of files as text columns under their header, and the lines that are none, with the reason."""

    names: list[str]
    records: DataFrame
    rejects: DataFrame


def _says(field: Column, *names: str) -> Column:
    words = "|".join(w for n in names for w in HEADER_WORDS[n])
    return F.regexp_replace(F.lower(field), r"[_\W]+", " ").rlike(rf"\b({words})s?\b")


def looks_like_header(fields: Column) -> Column:
    """A field names a date, another one an amount or a side, and none is a number or a date itself."""
    value = F.exists(fields, lambda f: F.coalesce(f.rlike(r"^\W*\d[\d.,/: -]*\D{0,3}$"), F.lit(False)))
    says = lambda *names: F.exists(fields, lambda f: F.coalesce(_says(f, *names), F.lit(False)))
    return ~value & says("Date") & says("Amount", "Debit", "Credit")


def _names(fields: list[str | None]) -> list[str]:
    """Distinct column names of a header row, without blank ones at its end."""
    found = [re.sub(r"\s+", " ", (f or "").strip("\ufeff \t\r\n")) for f in fields]
    while found and not found[-1]:
        found.pop()
    out: list[str] = []
    for i, name in enumerate(found):
        name = name or f"column{i}"
        known = {x.lower() for x in out}
        out.append(next(x for x in (name, *(f"{name} {k}" for k in range(2, len(found) + 2))) if x.lower() not in known))
    return out


def under_header(rows: DataFrame, sep: str = " | ") -> Scan:
    """Records of rows (path, block, at, fields).

    The header is the first row in all files that looks like one, else the first row; a
    file's rows in front of it are rejected, and so are rows with more fields than it
    has, and single fields among several columns: titles, totals, notes. Blank rows
    are nothing. All files of a scan have one header. Where files begin is looked up
    by broadcast, so that the rows of a file stay the tasks that its reader made.
    """
    blank = lambda f: F.trim(F.coalesce(f, F.lit(""))) == ""
    rows = rows.withColumn("fields", F.transform("fields", lambda f: F.regexp_replace(f, "^\ufeff", "")))
    rows = rows.withColumn("n", F.coalesce(F.array_max(F.transform("fields", lambda f, i: F.when(blank(f), 0).otherwise(i + 1))), F.lit(0)))
    rows = rows.withColumn("filled", F.size(F.filter("fields", lambda f: ~blank(f)))).where("filled > 0")
    place = F.struct("path", "block", "at", "fields")
    first = rows.agg(F.min(F.when(looks_like_header(F.col("fields")), place)).alias("known"), F.min(place).alias("any")).first()
    head = first["known"] or first["any"]
    if head is None:
        empty = rows.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in CANONICAL))
        return Scan(list(CANONICAL), empty, rows.sparkSession.createDataFrame([], REJECTS))
    names = _names(head["fields"])
    same = F.array_join(F.transform(F.slice("fields", 1, len(names)), lambda f: F.trim(F.coalesce(f, F.lit("")))), "\n") == F.lit("\n".join((f or "").strip("\ufeff ") for f in head["fields"][: len(names)]))
    rows = rows.withColumn("same", same)
    begins = rows.where("same").groupBy("path").agg(F.min(F.struct("block", "at")).alias("begin"))  # a row a file, as the driver lists them
    rows = rows.join(F.broadcast(begins), "path", "left").withColumn("here", F.struct("block", "at"))
    reason = F.when(F.col("here") < F.col("begin"), ABOVE).when(F.col("here") == F.col("begin"), "").when(F.col("same"), AGAIN).when(F.col("n") > len(names), MANY)
    if len(names) > 2:
        reason = reason.when(F.col("filled") == 1, FEW)
    rows = rows.withColumn("reason", reason)
    records = rows.where("reason is null").select(*(F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(names)))
    return Scan(names, records, rows.where("reason <> ''").select("path", F.array_join(F.slice("fields", F.lit(1), F.col("n")), sep, "").alias("line"), "reason"))
