"""Delimited files of any format read alike, workbook cells as shown, and what is rejected."""

import glob
import zipfile

import pytest
from pyspark.sql import functions as F

from monthwise.plans import catalog
from monthwise.sources import delimited, layout, statements, workbooks

HEAD = ["Txn Date", "Details", "Amount (INR)", "Balance"]
ROWS = [["01/02/2025", "Shop, of; things | and\ttabs", "-1,200.50", "10"], ["2 Feb 2025", 'He said "hi"', "300", ""], ["03-Mar-2025", "Café", "5.25", "15.25"]]


def write(path, sep, rows, title=()):
    quoted = lambda f: '"' + f.replace('"', '""') + '"' if any(x in f for x in ',;\t|"\n') else f
    path.write_text("\ufeff" + "".join(f"{x}\n" for x in title) + "".join(sep.join(map(quoted, r)) + "\n" for r in rows))
    return str(path)


@pytest.mark.parametrize("sep", delimited.DELIMITERS)
@pytest.mark.parametrize("broken", [False, True])
def test_formats_read_alike(spark, tmp_path, sep, broken):
    rows = [[f.replace("of; things", "of;\nthings") if broken else f for f in r] for r in ROWS]
    path = write(tmp_path / "a.csv", sep, [HEAD, *rows * 3, ["", "", "", ""], HEAD, ["x"], ["Total", "3", "4", "5", "6"]], ["My Bank", "", "Statement of account"])
    found = delimited.scan(spark, path)
    assert found.names == HEAD
    assert sorted(tuple(x or "" for x in r) for r in found.records.collect()) == sorted(map(tuple, rows * 3))
    got = {(r["line"].split(sep)[0], r["reason"]) for r in found.rejects.collect()}
    assert got == {("My Bank", layout.ABOVE), ("Statement of account", layout.ABOVE), (HEAD[0], layout.AGAIN), ("x", layout.FEW), ("Total", layout.MANY)}
    t = statements.to_transactions(statements.normalise(found.records))
    assert {(r["date"], float(r["amount"])) for r in t.collect()} == {("2025-02-01", -1200.5), ("2025-02-02", 300.0), ("2025-03-03", 5.25)} and t.count() == 9


def test_format_is_that_of_most_lines(spark):
    lines = lambda *x: spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(x)], "path string, block long, at long, value string")
    assert delimited.find_format(lines("a;b", "1,5;2", "2,5;3")) == delimited.Format(";", 2)
    assert delimited.find_format(lines("Date,Paid,Left", "x,₹1,200.50,₹3,000.00", "y,₹12.00,₹1,00,000.00")) == delimited.Format(",", 3, True)
    assert delimited.find_format(lines("one", "two")).width == 1 and delimited.find_format(lines()).width == 1
    assert delimited.find_format(lines('a,"b', 'c",d')).multiline
    assert [tuple(r) for r in delimited.scan_lines(lines("Date|Amount", "x|1", "x|1|2")).records.collect()] == [("x", "1")]
    empty = delimited.scan_lines(lines())
    assert empty.names == list(layout.CANONICAL) and empty.records.count() == empty.rejects.count() == 0


def test_headers_repeat_and_blank_names(spark):
    rows = spark.createDataFrame([("f", 0, 0, ["Date", "", "date", "Amount", ""]), ("f", 0, 1, ["1", None, "3", "4", ""])], "path string, block long, at long, fields array<string>")
    assert layout.under_header(rows).names == ["Date", "column1", "date 2", "Amount"]


def test_several_files_each_with_titles(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.csv", ",", [HEAD, *ROWS], [f"Title {k}"])
    found = delimited.scan(spark, str(tmp_path))
    assert found.records.count() == 9 and sorted(r["reason"] for r in found.rejects.collect()) == [layout.ABOVE] * 3


def test_rows_of_one_file_stay_many_tasks(spark):
    rows = [("f", 0, 0, ["Title", None, None]), ("f", 0, 1, ["Date", "Details", "Amount"]), *(("f", 0, k, ["1/2/2025", "x", str(k)]) for k in range(2, 402))]
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(was, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        found = layout.under_header(spark.createDataFrame(rows, "path string, block long, at long, fields array<string>").repartition(8))
        tasks = found.records.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8 and sum(r["count"] for r in tasks) == 400
        assert [tuple(r) for r in found.rejects.collect()] == [("f", "Title", layout.ABOVE)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_what_is_no_transaction_is_told(spark):
    rows = [("not a d", "x", None, "1", ""), ("31/02/2025", "x", None, "1", ""), ("45678", "x", None, "1", ""), ("", "x", None, "1", ""), (None, None, None, None, None), ("2025-01-31", "x", None, "1-2-3", ""), ("2025-01-31", "x", None, "", ""), ("1/2/2025", "y", None, "2.5", ""), ("2025-02-03 10:30", "z", None, "(3)", "")]
    records = spark.createDataFrame(rows, "Date string, Description string, Category string, Amount string, Balance string")
    assert sorted((r["ym"], float(r["amount"])) for r in statements.to_transactions(records).collect()) == [("2025-01", 0.0), ("2025-02", -3.0), ("2025-02", 2.5)]
    assert sorted(r["reason"] for r in statements.untyped(records).collect()) == [statements.NO_AMOUNT] + [statements.NO_DATE] * 5


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
CODES = ["General", "yyyy\\-mm\\-dd", "0.0%", '"₹"#,##0.00', "[$$-409]#,##0;[Red]($#,##0)", "dd/mm/yyyy hh:mm", "@", "0.00E+00"]


def book(path, rows, styles=(0, 14, 10, 20, *range(164, 164 + len(CODES))), early=False, strings=("Date", "Details")):
    formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{c.replace("&", "&amp;").replace(chr(34), "&quot;")}"/>' for i, c in enumerate(CODES))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="urn:r">{"<workbookPr date1904=" + chr(34) + "1" + chr(34) + "/>" if early else ""}<sheets><sheet name="S" sheetId="3" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet9.xml", f'<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:sheetData>{rows.replace("<", "<x:").replace("<x:/", "</x:")}</x:sheetData></x:worksheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts>{formats}</numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs>{"".join(f"<xf numFmtId={chr(34)}{s}{chr(34)}/>" for s in styles)}</cellXfs></styleSheet>')


def cells(spark, path):
    return [r["fields"] for r in workbooks.sheet_rows(spark, str(path)).orderBy("at").collect()]


def test_cells_read_as_shown(spark, tmp_path):
    shown = [("45678.25", 1, "2025-01-21"), ("0.125", 2, "12.50%"), ("0.75", 3, "18:00:00"), ("1234.5", 4, "1234.5"), ("0.1", 0, "0.1"), ("1234.5700000000002", 0, "1234.57"), ("100", 0, "100"), ("45678", 5, "2025-01-21"), ("-0.0513", 6, "-5.1%"), ("-134550", 7, "-₹134,550.00"), ("-1234.6", 8, "($1,235)"), ("45678.5", 9, "2025-01-21 12:00:00"), ("7", 10, "7"), ("1E-3", 11, "0.001"), ("59", 1, "1900-02-28"), ("61", 1, "1900-03-01"), ("1234567890123", 0, "1234567890123"), ("-0.001", 7, "₹0.00")]
    row = "<row>" + "".join(f'<c s="{s}"><v>{v}</v></c>' for v, s, _ in shown) + '<c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>a b</v></c><c t="s"><v>1</v></c></row>'
    book(tmp_path / "a.xlsx", row)
    assert cells(spark, tmp_path / "a.xlsx") == [[x for _, _, x in shown] + ["TRUE", "FALSE", "#N/A", "a b", "Details"]]
    book(tmp_path / "b.xlsx", '<row><c s="1"><v>44216</v></c></row>', early=True)
    assert cells(spark, tmp_path / "b.xlsx") == [["2025-01-21"]]


def test_a_workbook_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(workbooks, "READ_BYTES", 4_000)
    n = 5000
    strings = ["Date", "Details", "Amount", *(f"Shop {i}" for i in range(n))]
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>' + "".join(f'<row r="{i + 2}"><c r="A{i + 2}" s="1"><v>{45000 + i % 500}</v></c><c r="B{i + 2}" t="s"><v>{i + 3}</v></c><c r="D{i + 2}"><v>-{i}.5</v></c></row>' for i in range(n))
    book(tmp_path / "a.xlsx", rows + "<row/>", strings=strings)
    parts = spark.read.format("binaryFile").load(str(tmp_path / "a.xlsx")).select("path", "content").mapInArrow(workbooks._parts, workbooks.PARTS)
    assert parts.where("kind = 'rows'").count() > 20 and parts.where("kind = 'strings'").count() > 5
    found = workbooks.scan(spark, str(tmp_path / "a.xlsx"))
    assert found.names == ["Date", "Details", "column2", "Amount"]
    t = statements.to_transactions(statements.normalise(found.records))
    got = {(r["description"], float(r["amount"]), r["date"]) for r in t.collect()}
    want = spark.range(n).select(F.concat(F.lit("Shop "), "id"), -(F.col("id") + 0.5), F.date_add(F.lit("2023-03-15").cast("date"), (F.col("id") % 500).cast("int")).cast("string")).collect()
    assert got == {tuple(r) for r in want}


def test_old_workbooks_and_unknown_kinds(spark):
    with pytest.raises(ValueError, match="xlsx"):
        statements.scan(spark, "a.xls")


def test_number_formats():
    form = lambda c: {k: v for k, v in workbooks.number_format(c).items() if v not in ("", False, 0)}
    assert form("General") == {"form": "general"} and form("#,##0.00") == {"form": "number", "decimals": 2, "grouped": True}
    assert form('_("$"* #,##0.00_)') == {"form": "number", "decimals": 2, "grouped": True, "before": "$"} and form("0 \"kg\"")["after"] == " kg"
    assert form("[h]:mm:ss")["form"] == "time" and form("mmm")["form"] == "date" and form("# ?/?")["form"] == "general"


def test_rejects_of_a_text_form(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    assert glob.glob(f"{sf}/orders.parquet") and {r["reason"] for r in catalog.QUERIES["csv_rejects"](spark, sf).collect()} == {layout.ABOVE, layout.AGAIN, layout.MANY, layout.FEW, statements.NO_DATE, statements.NO_AMOUNT}


def test_engine_keeps_rejects(spark, tmp_path):
    from monthwise.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "e"))
    engine.ingest(write(tmp_path / "a.csv", ";", [HEAD, *ROWS, ["soon", "x", "1", ""]], ["My Bank"]))
    assert engine.transactions().count() == 3 and engine.meta()["rejected"] == f"{layout.ABOVE}: 1, {statements.NO_DATE}: 1"
    engine.set_currency("USD")
    assert sorted(r["line"] for r in engine.rejects().collect()) == ["My Bank", "soon | x |  | 1 | "]


def printed(doc, n, first=1, header=True):
    """Items of a statement: its header line, n dated rows three a page, each with a narration that goes on."""
    items = [(doc, 1, 300.0, 700.0, "Withdrawal Amt"), (doc, 1, 500.0, 700.0, "Deposit Amt"), (doc, 1, 600.0, 701.0, "Closing Balance")] if header else []
    for i in range(n):
        y, page = 600.0 - 20 * (i % 3), 1 + i // 3
        items += [(doc, page, 30.0, y, f"{first + i:02d}/02/24"), (doc, page, 100.0, y - 2, f"UPI-{doc} "), (doc, page, 450.0, y + 1, f"{first + i}.50"), (doc, page + (i % 3 == 2), 100.0, 800.0 if i % 3 == 2 else y - 9, f"{i}-REST")]
    return items


ITEMS = "doc string, page int, x double, y double, str string"


def test_many_printed_documents_in_one_table(spark):
    items = printed("A", 9) + printed("B", 7, 11) + printed("C", 8, header=False) + printed("D", 3)
    found = statements.scan_items(spark.createDataFrame(items, ITEMS).repartition(5))
    got = sorted((r["Description"].split(" - ")[0][:1], r["Date"], r["Amount"], r["Description"][-6:]) for r in found.records.collect())
    assert got == sorted([("A", f"2024-02-{1 + i:02d}", f"-{1 + i}.50", f"{i}-REST") for i in range(9)] + [("B", f"2024-02-{11 + i:02d}", f"-{11 + i}.50", f"{i}-REST") for i in range(7)])
    rest = found.rejects.collect()
    assert {r["path"] for r in rest} == {"C", "D"} and {r["reason"] for r in rest} == {statements.UNKNOWN_LAYOUT} and any("Withdrawal Amt Deposit Amt Closing Balance" == r["line"] for r in rest)


def test_a_page_of_very_many_items(spark):
    n = 100_000
    items = spark.range(n).select(F.lit(1).alias("page"), (F.col("id") % 4 * 10.0).alias("x"), (-F.floor(F.col("id") / 4) * 5.0).alias("y"), F.col("id").cast("string").alias("str"))
    lines = statements.visual_lines(items)
    assert lines.agg(F.max("line")).first()[0] == n // 4 and lines.groupBy("line").count().where("count <> 4").isEmpty()


def test_pages_of_one_document_are_many_tasks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    lines = spark.range(16_384).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.lit(1).alias("starts"), (F.col("id") == 0).alias("says"))
    try:
        for k, v in zip(was, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        pages = statements.read_pages(lines)
        tasks = [r["count"] for r in pages.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("before"), F.sum("records")).collect()]
        assert len(tasks) > 1 and sum(tasks) == 16_384
        assert pages.where("before <> page or records <> 16384 or not printed").isEmpty()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_lines_of_printed_pages_are_not_broadcast(spark):
    found = statements.scan_items(spark.createDataFrame(printed("A", 9), ITEMS))
    plan = found.records._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and found.records.count() == 9


def test_earlier_pages_are_counted_over_all_page_numbers(spark):
    numbers = [None, -(1 << 31), -(1 << 20), -1025, -1024, -1, 0, 1, 1023, 1024, 1025, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, (1 << 31) - 1]
    n = {p: 0 if p is None else 1 + k * 7 % 5 for k, p in enumerate(numbers)}
    lines = [(d, p, 1, d == "a" and p is None) for d in "ab" for p in numbers for _ in range(n[p])] + [("a", None, 0, True), ("b", None, 0, False), ("c", None, 0, True)]
    got = {(r["doc"], r["page"]): (r["before"], r["records"], r["printed"]) for r in statements.read_pages(spark.createDataFrame(lines, "doc string, page int, starts int, says boolean").repartition(5)).collect()}
    total = sum(n.values())
    assert got == {(d, p): (sum(n[q] for q in numbers[:k]), total, d == "a") for d in "ab" for k, p in enumerate(numbers)} | {("c", None): (0, 0, True)}


def test_lines_hang_on_their_first_item(spark):
    items = [("d", 1, 1.0, y, str(y)) for y in (100.0, 98.0, 97.0, 96.9, 94.0, 93.8)] + [("d", 2, 1.0, 100.0, "p2"), ("d", None, 1.0, 5.0, "no page"), ("d", 2, 1.0, None, "no place")]
    got = {(r["page"], r["str"]): r["line"] for r in statements.visual_lines(spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(1, "100.0"): 1, (1, "98.0"): 1, (1, "97.0"): 1, (1, "96.9"): 2, (1, "94.0"): 2, (1, "93.8"): 3, (2, "p2"): 1, (None, "no page"): 1}


def test_engine_takes_items_and_searches_unknown_pages(spark, tmp_path):
    from monthwise.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "e"))
    engine.ingest(spark.createDataFrame(printed("A", 6) + [("Z", 1, 1.0, 9.0, "gold loan"), ("Z", 1, 50.0, 9.0, "of May")], ITEMS))
    assert engine.transactions().count() == 6 and engine.meta()["rejected"] == f"{statements.UNKNOWN_LAYOUT}: 1"
    assert [r["line"] for r in engine.search_rejects("Gold?").collect()] == ["gold loan of May"]
    engine.index_vectors(4)
    assert {r["id"] for r in engine.semantic_search("upi rest", 6, None).collect()} == {r["id"] for r in engine.transactions().collect()}


def test_items_without_page_or_place(spark):
    """Items without a page start no record, and are rejected with their document; items without an x stand in the last column."""
    items = printed("A", 6) + [("A", None, 30.0, 9.0, "09/02/24"), ("A", None, 450.0, 9.0, "7.00"), ("B", None, 30.0, 9.0, "loose"), ("B", 1, None, 9.0, "no place"), ("B", 1, 30.0, None, "no height")]
    found = statements.scan_items(spark.createDataFrame(items, ITEMS).repartition(3))
    assert found.records.count() == 6
    assert sorted((r["path"], r["line"]) for r in found.rejects.collect()) == [("B", "loose"), ("B", "no place")]
