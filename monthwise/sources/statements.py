"""Statement files to transactions: delimited text, workbooks and positioned items of printed pages.

Every reader gives records of text columns under canonical names (Date,
Description, Category, Amount, Balance); ``to_transactions`` types them, and what is no
record or no transaction is kept with its reason. Files are read whole by Spark's own
readers; nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.sources import delimited, workbooks
from monthwise.sources.layout import CANONICAL, HEADER_WORDS, REJECTS, Scan
from monthwise.sources.stages import cut

#: The most specific name is tried first: a header that says debit or credit is a side even if it says amount.
HEADER_ORDER = ("Debit", "Credit", "Balance", "Date", "Description", "Category", "Amount")
#: A printed statement's columns end at these x, the last has no end.
COLUMN_ENDS = (("date", 55), ("narration", 289), ("reference", 362), ("value_date", 405), ("withdrawal", 491), ("deposit", 564))
LINE_GAP = 3.0
#: Page numbers are summed in ranges of two to this power, and ranges of ranges.
PAGE_BITS = 10
#: What the header line of a printed statement says.
HEADER_PHRASES = ("withdrawal amt", "deposit amt", "closing balance")
LEAST_ROWS = 5
NO_DATE, NO_AMOUNT, UNKNOWN_LAYOUT = "no date", "no amount", "unknown layout"


def header_map(columns: list[str]) -> dict[str, str]:
    """Column to canonical name; of two columns for one name the first counts."""
    out: dict[str, str] = {}
    for name in HEADER_ORDER:
        words = rf"\b({'|'.join(HEADER_WORDS[name])})s?\b"
        for c in columns:
            if name not in out.values() and c not in out and re.search(words, re.sub(r"[_\W]+", " ", c.lower())):
                out[c] = name
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Records under canonical names; debit and credit columns become one signed amount. Rows without any value go."""
    names = header_map(raw.columns)
    by = {v: F.col(f"`{k}`").cast("string") for k, v in names.items()}
    if "Amount" not in by and ("Debit" in by or "Credit" in by):
        by["Amount"] = scalars.split_amount(by.get("Debit", F.lit("")), by.get("Credit", F.lit("")))
    filled = F.lit(False)
    for c in raw.columns:
        filled |= F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != ""
    return raw.where(filled).select(*(by.get(c, F.lit(None).cast("string")).alias(c) for c in CANONICAL))


def read_csv(spark: SparkSession, path: str, quote_money: bool = False) -> DataFrame:
    """The records of delimited files as text columns; ``quote_money`` says that thousands separators are not quoted, which is found out else."""
    return delimited.scan(spark, path, quote_money).records


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The records of the first sheet of workbooks as text columns, cells as the workbook shows them."""
    return workbooks.scan(spark, path).records


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items in order, each with the number of its line in its page."""
    page, line, top = None, 0, 0.0
    for batch in batches:
        out = []
        for doc, number, y in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (doc, number) != page:
                page, line, top = (doc, number), 1, y
            elif top - y > LINE_GAP:
                line, top = line + 1, y
            out.append(line)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32()), batch.column(2), batch.column(4)], ["doc", "page", "line", "x", "str"])


def _by_page(rows: DataFrame) -> DataFrame:
    """Rows dealt by page to spark.sql.shuffle.partitions tasks, which are not put together again: a task sorts what it gets."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "page")


def visual_lines(items: DataFrame) -> DataFrame:
    """doc, page, line, x, str of (doc, page, x, y, str) items; without a doc all are of one. A line takes items at most LINE_GAP under its first one.

    The first item of a line decides, not the one before, so a page is read from its top
    down, in one pass whatever its length; pages are dealt to all tasks.
    """
    doc = F.coalesce(F.col("doc").cast("string"), F.lit("")) if "doc" in items.columns else F.lit("")
    rows = items.where("y is not null").select(doc.alias("doc"), F.col("page").cast("int").alias("page"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("str", F.lit("")).alias("str"))
    rows = _by_page(rows).sortWithinPartitions("doc", "page", F.desc("y"), "x", "str")
    return rows.mapInArrow(_lined, "doc string, page int, line int, x double, str string")


def _line_items(lines: DataFrame) -> DataFrame:
    """A row a line: its items from left to right."""
    return lines.groupBy("doc", "page", "line").agg(F.sort_array(F.collect_list(F.struct("x", "str"))).alias("items"))


def _joined(items: Column, sep: str) -> Column:
    return F.trim(F.array_join(F.transform(items, lambda i: i["str"]), sep))


def _in_column(name: str) -> Column:
    """The text of a line's items that stand in a column; what has no place stands in the last one."""
    ends = dict(COLUMN_ENDS)
    starts = dict(zip([*ends, "balance"], [float("-inf"), *ends.values()], strict=True))
    x = lambda i: F.coalesce(i["x"], F.lit(float("inf")))
    return _joined(F.filter("items", lambda i: (x(i) >= starts[name]) & (x(i) < ends[name]) if name in ends else x(i) >= starts[name]), "")


def read_lines(items: DataFrame) -> DataFrame:
    """doc, page, line, items (x, str from left to right), starts (a record, 1 or 0), goes_on (a narration alone), says (all header phrases).

    Pages are read once and their lines written to the shared folder, since page sums, records and rejects all come from them.
    """
    rows = _line_items(visual_lines(items))
    alone = F.lit(True)
    for name in (*dict(COLUMN_ENDS), "balance"):
        alone &= (_in_column(name) != "") if name == "narration" else (_in_column(name) == "")
    text, says = F.lower(_joined(F.col("items"), " ")), F.lit(True)
    for phrase in HEADER_PHRASES:
        says &= F.contains(text, F.lit(phrase))
    starts = _in_column("date").rlike(r"^\d{2}/\d{2}/\d{2}$") & F.col("page").isNotNull()
    return cut(rows.select("*", starts.cast("int").alias("starts"), alone.alias("goes_on"), says.alias("says")))


def read_pages(rows: DataFrame) -> DataFrame:
    """doc, page, before (records that start on earlier pages), records (of the document), printed (does a line of the document say all header phrases?).

    A document is never one group: records are summed within 1,024 neighbouring page
    numbers, within 1,024 such ranges, and over the at most 4,096 ranges of those.
    """
    sums = [F.sum("n").alias("n"), F.max("says").alias("says")]
    up = lambda name: F.shiftright(name, PAGE_BITS)
    earlier = lambda place, *group: F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pages = cut(rows.groupBy("doc", "page").agg(F.sum("starts").alias("n"), F.max("says").alias("says")))  # a row a page
    pages = pages.withColumn("near", up(F.coalesce("page", F.lit(-1 << 31))))  # what has no page comes first
    near = pages.groupBy("doc", "near").agg(*sums).withColumn("far", up("near"))
    far, whole = near.groupBy("doc", "far").agg(*sums), W.partitionBy("doc")
    far = far.select("doc", "far", earlier("far", "doc").alias("start"), F.sum("n").over(whole).alias("records"), F.max("says").over(whole).alias("printed"))
    near = near.withColumn("inside", earlier("near", "doc", "far")).join(far.hint("merge"), ["doc", "far"]).select("doc", "near", (F.col("start") + F.col("inside")).alias("start"), "records", "printed")
    pages = pages.withColumn("inside", earlier("page", "doc", "near")).join(near.hint("merge"), ["doc", "near"])
    return pages.select("doc", "page", (F.col("start") + F.col("inside")).alias("before"), "records", "printed")


def printed_records(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of printed statements by doc and number: a dated line starts one, lines with a narration alone continue it.

    Records are numbered by a sum over lines, first within each page and then over the
    pages of the document before it, so a record may go on on the next page. Lines are
    many more than their plan says, so they meet their pages in a merge and are never broadcast.
    """
    columns = ("date", "narration", "withdrawal", "deposit", "balance")
    rows = _by_page(rows.where("starts = 1 or goes_on").select("doc", "page", "line", "starts", *(_in_column(n).alias(n) for n in columns)))
    rows = rows.withColumn("inside", F.sum("starts").over(W.partitionBy("doc", "page").orderBy("line")))  # the order holds for the join
    rows = rows.join(pages.select("doc", "page", "before").hint("merge"), ["doc", "page"])
    rows = rows.withColumn("number", F.col("before") + F.col("inside")).where("number > 0")
    first = lambda n: F.max(F.when(F.col("starts") == 1, F.col(n)))
    narration = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line", "narration"))), lambda s: s["narration"]), "")
    out = rows.groupBy("doc", "number").agg(first("date").alias("date"), narration.alias("narration"), *(scalars.pdf_number(first(n)).alias(n) for n in ("withdrawal", "deposit", "balance")))
    amount = F.when(F.col("withdrawal") > 0, -F.col("withdrawal")).otherwise(F.coalesce("deposit", F.lit(0)))
    signed = F.concat(F.when(amount < 0, "-").otherwise("+"), F.abs(amount).cast("string"))
    name = scalars.narration_payee(F.col("narration"))
    iso = F.coalesce(F.date_format(F.try_to_timestamp("date", F.lit("dd/MM/yy")), "yyyy-MM-dd"), "date")  # what is no day stays as it is
    return out.select("doc", "number", iso.alias("Date"), F.concat(name, F.lit(" - "), "narration").alias("Description"), F.lit(None).cast("string").alias("Category"), signed.alias("Amount"), F.coalesce(F.col("balance").cast("string"), F.lit("")).alias("Balance"))


def scan_items(items: DataFrame) -> Scan:
    """Records of all documents of positioned items that are statements with at least LEAST_ROWS records; the lines of the others are rejected, with their text."""
    rows = read_lines(items)
    known = read_pages(rows).where(F.col("printed") & (F.col("records") >= LEAST_ROWS))
    taken = known.select(F.col("doc").alias("known_doc"), F.col("page").alias("known_page"))  # by page, so that a document is not one task
    rest = rows.join(taken, (F.col("doc") == F.col("known_doc")) & F.col("page").eqNullSafe(F.col("known_page")), "left_anti").select(F.col("doc").alias("path"), _joined(F.col("items"), " ").alias("line"), F.lit(UNKNOWN_LAYOUT).alias("reason"))
    return Scan(list(CANONICAL), printed_records(rows, known).select(*CANONICAL), rest.where("line <> ''"))


def read_items(items: DataFrame) -> DataFrame:
    """Records of positioned items; an error if they are no statement with at least LEAST_ROWS rows."""
    rows = read_lines(items)
    pages = read_pages(rows).where("printed")
    found = pages.select("doc", "records").distinct().agg(F.sum("records")).first()[0]
    if found is None:
        raise ValueError("no line of the items has the headers of a statement")
    if found < LEAST_ROWS:
        raise ValueError(f"a statement has at least {LEAST_ROWS} rows")
    return printed_records(rows, pages).orderBy("doc", "number").drop("doc", "number")


def plain_lines(items: DataFrame) -> DataFrame:
    """page, line, text of printed items that are no known statement: what search can still use."""
    text = _joined(F.col("items"), " ").alias("text")
    return _line_items(visual_lines(items)).select("doc", "page", "line", text).where("text <> ''").orderBy("doc", "page", "line").select("page", "line", "text")


def scan(spark: SparkSession, path: str, **options) -> Scan:
    """Records of a file as text columns under its own headers and what is none of them, by the file's extension."""
    kind = path.lower().rstrip("/").rpartition(".")[2]
    if kind in ("csv", "txt", "tsv"):
        return delimited.scan(spark, path, **options)
    if kind == "xlsx":
        return workbooks.scan(spark, path)
    if kind == "xls":
        raise ValueError("'xls' files are not supported; save the workbook as .xlsx")
    raise ValueError(f"{kind!r} files are not supported; give the items of a printed page to read_items")


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file's records as text columns under its own headers."""
    return scan(spark, path, **options).records


def read_statement(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of a file."""
    return normalise(read_raw(spark, path, **options))


def _typed(records: DataFrame, account: int, rules=scalars.CATEGORY_RULES) -> DataFrame:
    """Records as transactions without an id, each with its line and the reason why it is none."""
    # What is used more than once is computed in a projection of its own.
    rows = records.select(
        scalars.date_iso(F.coalesce("Date", F.lit(""))).alias("date"), F.coalesce("Description", F.lit("")).alias("description"), "Category",
        scalars.parse_accounting(F.col("Amount")).alias("amount"), (F.trim(F.coalesce("Amount", F.lit(""))) != "").alias("written"), scalars.parse_accounting(F.col("Balance")).alias("balance"),
        F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CANONICAL)).alias("line"),
    )
    no_date = ~F.col("date").rlike(r"^\d{4}-\d\d-\d\d$") | F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNull()
    reason = F.when(no_date, NO_DATE).when(F.col("amount").isNull() & F.col("written"), NO_AMOUNT)
    description = F.col("description")
    return rows.select(
        F.lit(account).cast("long").alias("account"), "date", scalars.month_key(F.col("date")).alias("ym"), "description", scalars.payee(description).alias("payee"),
        scalars.categorize(description, F.col("Category"), rules).alias("category"), F.coalesce("amount", F.lit(0).cast(scalars.MONEY)).alias("amount"), "balance", scalars.is_upi(description).alias("is_upi"),
        "line", reason.alias("reason"),
    )


def to_transactions(records: DataFrame, account: int = 0, rules=scalars.CATEGORY_RULES) -> DataFrame:
    """Typed transactions of canonical records, with a stable id from the record's values and its repetition.

    A blank amount is 0. Records without a date, and those whose amount is no number, are not among them: see ``untyped``.
    """
    out = _typed(records, account, rules).where("reason is null").drop("line", "reason")
    counted = out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("times"))  # a record that repeats is a row a task
    each = counted.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(F.xxhash64("account", "date", "description", "category", "amount", "balance", "again").alias("id"), *out.columns)


def untyped(records: DataFrame) -> DataFrame:
    """path (null), line, reason of the records that are no transactions."""
    return _typed(records, 0).where("reason is not null").select(F.lit(None).cast("string").alias("path"), "line", "reason")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def synthetic(spark: SparkSession, months: int = 24, rows_a_month: int = 900, start: str = "2022-09-01") -> DataFrame:
    """Invented transactions of any size, the same on every run."""
    from monthwise.sources.adapter import MERCHANTS, RAIL_NAMES, _pick

    rows = spark.range(months * rows_a_month)
    drawn = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20))
    month = F.floor(F.col("id") / rows_a_month).cast("int")
    date = F.date_add(F.add_months(F.lit(start).cast("date"), month), F.pmod(drawn(1), F.lit(28)).cast("int"))
    merchant = _pick(MERCHANTS, drawn(2))
    credit = F.contains(F.lower(merchant), F.lit("salary")) | F.contains(F.lower(merchant), F.lit("interest"))
    amount = (F.pmod(drawn(3), F.lit(500_000)) / 100 + 1).cast(scalars.MONEY)
    return rows.select(date.cast("string").alias("Date"), F.concat(merchant, F.lit(" - "), _pick(RAIL_NAMES, drawn(4)), F.lit("-"), F.col("id").cast("string")).alias("Description"), F.lit(None).cast("string").alias("Category"), F.concat(F.when(credit, "+").otherwise("-"), amount.cast("string")).alias("Amount"), F.lit("").alias("Balance"))
