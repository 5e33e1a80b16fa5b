"""Readers, scalars, the engine and the stream on small fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.operators import months, relational, search
from monthwise.plans.engine import NOT_FOUND, Engine
from monthwise.sources import statements

CSV = "Txn Date,Narration,Withdrawal (Dr),Deposit (Cr),Closing Balance\n01/01/2025,UPI-CORNER CAFE-1,₹1,200.50,,₹10,000.00\n02/01/2025,NEFT-ACORN SALARY-2,,₹1,00,000.00,₹1,10,000.00\n05/02/2025,IMPS-CITY METRO-3,₹300.25,,₹1,09,699.75\n"


@pytest.mark.parametrize(
    ("text", "lenient", "accounting"),
    [("₹1,34,550.00", 134550.0, 134550.0), ("(123.45)", 123.45, -123.45), ("500.00 Dr", 500.0, -500.0), ("500.00 Cr", 500.0, 500.0), ("-42", -42.0, -42.0), ("500-200", 500.0, None), ("2025-01-15", 2025.0, None), ("", 0.0, None), ("Rs. 500", 500.0, 500.0), ("abc", 0.0, None)],
)
def test_amounts(spark, text, lenient, accounting):
    got = spark.createDataFrame([(text,)], "x string").select(scalars.parse_amount(F.col("x")).cast("double"), scalars.parse_accounting(F.col("x")).cast("double")).first()
    assert tuple(got) == (lenient, accounting)


def test_words(spark):
    got = spark.range(1).select(
        scalars.format_amount(F.lit(-1234567.5)), scalars.format_amount(F.lit(100.0)), scalars.date_iso(F.lit("31/12/24")), scalars.date_iso(F.lit("soon")), scalars.narration_payee(F.lit("NEFT-ACME  LTD-9")), scalars.narration_payee(F.lit("UPI-BOB-1")), scalars.narration_payee(F.lit("CASH")), scalars.js_round(F.lit(-2.505)), scalars.month_label(F.lit("x")), scalars.clean_glyphs(F.lit("$5")),
    ).first()
    assert list(got) == ["-₹12,34,567.50", "₹100", "2024-12-31", "soon", "ACME LTD", "BOB", "CASH", pytest.approx(-2.5), "x", "₹5"]


def test_headers():
    assert statements.header_map(["Address", "Credit Amount", "Debit Amount", "Value Date", "Amount (INR)"]) == {"Credit Amount": "Credit", "Debit Amount": "Debit", "Value Date": "Date", "Amount (INR)": "Amount"}


def test_csv_with_unquoted_thousands(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    t = statements.to_transactions(statements.read_statement(spark, str(tmp_path / "a.csv"), quote_money=True))
    rows = sorted(t.collect(), key=lambda r: r["date"])
    assert [(r["date"], float(r["amount"]), float(r["balance"])) for r in rows] == [("2025-01-01", -1200.5, 10000.0), ("2025-01-02", 100000.0, 110000.0), ("2025-02-05", -300.25, 109699.75)]
    assert [r["category"] for r in rows] == ["Food & Dining", "Salary", "Transport"] and len({r["id"] for r in rows}) == 3
    assert relational.balance_breaks(t).collect() == []
    with pytest.raises(ValueError, match="not supported"):
        statements.read_statement(spark, "a.pdf")


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Details</t></is></c><c r="C1" t="inlineStr"><is><t>Amount</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>2025-01-02</t></is></c><c r="C2"><v>-12.5</v></c></row><row><c r="A3"/></row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Date</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    got = statements.read_statement(spark, str(tmp_path / "a.xlsx")).collect()
    assert [(r["Date"], r["Description"], r["Amount"]) for r in got] == [("2025-01-02", "", "-12.5")]


def test_printed_items(spark):
    items = [(1, 300.0, 700.0, "Withdrawal Amt"), (1, 500.0, 700.0, "Deposit Amt"), (1, 600.0, 701.0, "Closing Balance")]
    for i in range(6):
        y = 600.0 - 20 * i
        items += [(1 + i // 3, 30.0, y, f"0{i + 1}/02/24"), (1 + i // 3, 100.0, y - 2, "UPI-SHOP "), (1 + i // 3, 450.0 if i % 2 else 500.0, y + 1, "1,000.50"), (1 + i // 3, 600.0, y, "9,000.00"), (1 + i // 3, 100.0, y - 9, f"{i}-REST")]
    items.append((2, 30.0, 1.0, "page 2"))
    got = statements.read_items(spark.createDataFrame(items, "page int, x double, y double, str string")).collect()
    assert [r["Date"] for r in got] == [f"2024-02-0{i + 1}" for i in range(6)]
    assert [r["Amount"] for r in got] == ["+1000.50", "-1000.50"] * 3 and got[1]["Description"] == "SHOP1 - UPI-SHOP1-REST" and got[0]["Balance"] == "9000.00"
    with pytest.raises(ValueError, match="headers"):
        statements.read_items(spark.createDataFrame(items[3:], "page int, x double, y double, str string"))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    out.ingest(statements.synthetic(spark, months=14, rows_a_month=40))
    return out


def test_sums_agree(engine):
    t, m = engine.transactions(), engine.months()
    whole, by_month = relational.overview(t).first(), m.agg(F.sum("income"), F.sum("spending"), F.sum("count")).first()
    assert (whole["credit"], whole["debit"], whole["count"]) == (pytest.approx(by_month[0]), pytest.approx(by_month[1]), by_month[2] == 560 and 560)
    exact = {(r["anchor"], r["window"]): r for r in months.periods_exact(t).collect()}
    composed = engine.periods().collect()
    assert len(exact) == len(composed) == 14 + 12 + 9 + 6 + 3
    for r in composed:
        e = exact[r["anchor"], r["window"]]
        assert (e["income"], e["expense"], e["net"]) == (pytest.approx(r["income"]), pytest.approx(r["expense"]), pytest.approx(r["net"])) and e["count"] == r["count"]
    gold = months.month_gold(t).collect()
    assert all(abs(sum(r["categories"].values()) - r["spending"]) < 0.01 and len(r["payees"]) <= 20 for r in gold)


FIGURES = ["ym", "income", "spending", "net", "count", "upi"]


def figures(df):
    return {r["ym"]: tuple(r) for r in df.select(*FIGURES).collect()}


def test_a_month_is_replaced_and_deleted(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.ingest(statements.synthetic(spark, months=3, rows_a_month=10))
    before = figures(engine.months())
    new = statements.to_transactions(statements.synthetic(spark, months=1, rows_a_month=3, start="2022-10-01"))
    engine.update_month("2022-10", new)
    after = figures(engine.months())
    assert after["2022-10"][4] == 3 and all(after[k] == before[k] for k in before if k != "2022-10")
    assert figures(months.month_summaries(engine.transactions())) == after
    assert engine.chunks().count() == engine.transactions().count() == 23
    with pytest.raises(ValueError, match="outside"):
        engine.update_month("2022-11", new)
    assert figures(engine.months()) == after
    engine.update_month("2022-10", engine.transactions().where("ym = '2022-10' and amount < 0"))  # read from the engine itself
    kept = figures(engine.months())
    assert kept["2022-10"][1] == 0 and figures(months.month_summaries(engine.transactions())) == kept
    engine.update_month("2022-10", new.limit(0))  # an empty month goes
    assert set(figures(engine.months())) == {"2022-09", "2022-11"} == {r[0] for r in engine.transactions().select("ym").distinct().collect()}
    assert {r["anchor"] for r in engine.periods().collect()} == {"2022-09", "2022-11"} and engine.chunks().count() == 20
    same = figures(engine.months())
    engine.rebuild()
    assert figures(engine.months()) == same
    engine.reset()
    assert engine.transactions().count() == engine.months().count() == engine.periods().count() == 0


def test_a_failed_change_changes_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.ingest(statements.synthetic(spark, months=2, rows_a_month=5))
    before = figures(engine.months())
    broken = engine.transactions().where("ym = '2022-09'").withColumn("payee", F.when(F.col("id") > -(2**63), F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        engine.update_month("2022-09", broken)
    assert figures(engine.months()) == before == figures(months.month_summaries(engine.transactions()))


def test_layers_agree(engine):
    exact = {(r["anchor"], r["window"]): r for r in months.periods_exact(engine.transactions()).collect()}
    best = {(r["anchor"], r["window"], r["rank"]): (r["category"], r["amount"]) for r in months.period_top_categories(engine.transactions()).collect()}
    for r in engine.periods().collect():
        assert r["income"] == pytest.approx(exact[r["anchor"], r["window"]]["income"])
        assert [(c["name"], c["amount"]) for c in r["top_categories"]] == [(n, pytest.approx(a)) for n, a in (best[r["anchor"], r["window"], k + 1] for k in range(len(r["top_categories"])))]
        assert r["content"].startswith(r["label"]) and len(r["embedding"]) == 64 and len(r["top_payees"]) == 5
    assert engine.currency() == "INR" and engine.meta()["columns"].startswith("Date")


def test_currency_is_read_kept_and_set(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    (tmp_path / "a.csv").write_text("Date,Details,Amount\n2025-01-02,Shop - x,-$12.50\n")
    engine.ingest(str(tmp_path / "a.csv"))
    assert engine.currency() == "USD" and "$12.50" in engine.periods().first()["content"]
    engine.set_currency("EUR")
    assert engine.state()["currency"] == "EUR" and "€12.50" in engine.periods().first()["content"] and engine.transactions().count() == 1
    with pytest.raises(ValueError, match="currency"):
        engine.set_currency("X")
    engine.ingest(statements.synthetic(spark, months=1, rows_a_month=2))
    assert engine.currency() == "EUR"  # nothing says otherwise


def test_repeated_records_have_ids_of_their_own(spark):
    one = spark.createDataFrame([("2025-01-01", "a - b", None, "-1", "")] * 5 + [("2025-01-01", "a - b", "Rent", "-1", "")] * 2, "Date string, Description string, Category string, Amount string, Balance string")
    ids = [sorted(r["id"] for r in statements.to_transactions(one.repartition(n)).collect()) for n in (1, 4)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 7


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("How much did I spend in total?", "overview"), ("What is my current balance?", "balance"), ("How many UPI payments?", "upi_count"), ("Top 5 largest expenses", "largest_debit"), ("Top 5 expenses", "top_debits"),
        ("Which month had the most spending?", "month_extremes"), ("How much did I pay to Netflix?", "keyword"), ("Spent on Netflix per month", "keyword_by_month"), ("spending in March 2023", "month"), ("Spent on food in March 2023", "category_month"),
        ("Spent on Netflix in March 2023", "keyword_month"), ("How much money did I get from other people, received in all", "received_from_people"), ("Summarize the last 6 months", "period"), ("show my subscriptions", "subscriptions"), ("biggest credit", "largest_credit"),
        ("smallest expense", "smallest_debit"), ("spending by category", "category_breakdown"), ("top payees", "top_payees"), ("salary credited", "keyword"), ("show 2023", "year"),
        ("expenses in March", "month"), ("How much did I spend this month?", "month"), ("What did I pay Netflix in January?", "keyword_month"), ("food in October", "category_month"), ("what is my average spend?", "average"),
        ("How many transactions are there?", "row_count"), ("total cost of my subscriptions", "subscriptions_total"), ("may I see my balance left", "balance"), ("How did my spending develop?", "period"), ("Compare my months", "period"),
        ("summary of the last two quarters", "period"), ("payments to Netflix, Spotify and Airtel in total", "keyword"), ("how much did Mr Nobody get from me, paid in all", "keyword"), ("which month was the cheapest, the lowest?", "month_extremes"),
    ],
)
def test_intents(question, kind):
    from monthwise.plans.intent import classify

    assert classify(question).kind == kind


@pytest.mark.parametrize(("question", "window"), [("last 6 months", 6), ("half a year", 6), ("two quarters", 6), ("a quarter", 3), ("Q2", 3), ("nine-month view", 9), ("annual", 12), ("two months", 3), ("18 months", 12), ("monthly", 1), ("my money", None)])
def test_window_lengths(question, window):
    from monthwise.plans.periods import parse

    assert parse(question).window == window


def test_months_without_a_year(engine):
    rows = {r["ym"]: r for r in engine.months().collect()}
    assert max(rows) == "2023-10"
    assert engine.ask("expenses in October")[1].first()["ym"] == "2023-10" and engine.ask("expenses in November")[1].first()["ym"] == "2022-11"
    assert engine.ask("what did I spend this month?")[1].first()["ym"] == "2023-10"
    assert engine.ask("what was spent in October 2022")[1].first()["spending"] == rows["2022-10"]["spending"]
    assert engine.ask("How many transactions are there?")[1].first()["count"] == 560
    t = engine.transactions()
    assert engine.ask("What is my average spend?")[1].first()["debit"] == pytest.approx(float(t.where("amount < 0").agg(F.avg(-F.col("amount"))).first()[0]), abs=0.01)


def test_search_context_and_similar_names(engine):
    t = engine.transactions()
    found = engine.search("netflix", 5).collect()
    assert found and {r["direction"] for r in found} <= {"debit", "credit"} and any(r["payee"] == "Netflix" for r in found)
    assert {r["source"] for r in found} <= {"semantic", "keyword", "both"} and all(len(r["description"]) <= 50 for r in found)
    spent = float(t.where("payee = 'Netflix' and amount < 0").agg(F.sum(-F.col("amount"))).first()[0])
    assert engine.ask("How much did I pay to NetFlix-India?")[1].first()["debit"] == pytest.approx(spent)
    assert engine.context("What did I spend in total?")[0] == "facts" and engine.context("anything about Netflix?")[0] == "search"
    assert statements.plain_lines(t.sparkSession.createDataFrame([(1, 9.0, 5.0, "b"), (1, 1.0, 5.0, "a"), (1, 1.0, 99.0, "top")], "page int, x double, y double, str string")).collect() == [(1, 1, "top"), (1, 2, "a b")]
    assert relational.column_roles(["Txn Date", "Paid", "Amount"], {"date": ("date",), "money": ("amount", "paid"), "none": ("x y",)}) == {"date": "Txn Date", "money": "Amount"}


def test_answers(engine):
    t = engine.transactions()
    spent = t.where("lower(description) like '%netflix%' and amount < 0").agg(F.sum(-F.col("amount"))).first()[0]
    _, df, text = engine.ask("How much did I pay to Netflix?")
    assert df.first()["debit"] == pytest.approx(float(spent)) and str(df.first()["debit"]) in text
    assert engine.ask("How much did I pay to Zanzibar Trading?")[2] == NOT_FOUND
    assert engine.ask("Summarize the last 6 months")[1].first()["window"] == 6
    total, rows = engine.page(0, 5)
    assert total == 560 and len(rows) == 5 and [r["date"] for r in rows] == sorted((r["date"] for r in rows), reverse=True)
    assert len(engine.facts().split("=== ")) == 10 and engine.dashboard()["overview"][0]["count"] == 560 and engine.state()["count"] == 560
    assert engine.dashboard()["overview"][0]["debit"] == pytest.approx(float(t.where("amount < 0").agg(F.sum(-F.col("amount"))).first()[0]))
    assert [r["category"] for r in relational.category_breakdown(t).collect()] == [r["category"] for r in engine.dashboard()["categories"]]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, embedding array<float>")
    assert [(r["id"], r["score"]) for r in search.cosine_topk(v, [1.0, 0.0]).collect()] == [(1, 1.0), (4, 0.707107), (2, 0.0), (3, -1.0)]
    assert search.bm25(v.select("id", F.lit("x").alias("content")), "?!").collect() == []
    e = search.HashingEmbedder(8).embed(v.select(F.lit("one two two").alias("content"))).first()["embedding"]
    assert sum(x * x for x in e) == pytest.approx(1.0)


def test_export_key_and_figures_text(spark, tmp_path):
    t = statements.to_transactions(statements.synthetic(spark, months=1, rows_a_month=4))
    statements.write_csv(relational.records(t).drop("id"), str(tmp_path / "out"))
    back = statements.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(v or None for v in r) for r in relational.records(t).drop("id").collect())
    assert next((tmp_path / "out").glob("*.csv")).read_text().startswith('"Date","Description"')
    assert spark.range(1).select(scalars.cache_key(F.lit("abc"))).first()[0] == "ba7816bf8f01cfea414140de5dae2223b00361a3"
    pairs = F.array(F.struct(F.lit("Rent").alias("name"), F.lit(1500.0).alias("amount")))
    text = spark.range(1).select(scalars.metrics_text(F.lit("May 2024"), F.lit(10.5), F.lit(2.0), F.lit(8.5), F.lit(3), pairs, F.slice(pairs, 1, 0))).first()[0]
    assert text == "May 2024. Income: ₹10.50. Spent: ₹2. Net: ₹8.50. Transactions: 3. Most spent on: Rent ₹1,500"


def test_facts_are_labelled_lines(engine):
    from monthwise.operators import facts

    rows = facts.facts_table(engine.transactions()).collect()
    assert list(dict.fromkeys(r["section"] for r in rows)) == list(facts.TITLES.values())
    assert [r["place"] for r in rows if r["section"] == "RECENT TRANSACTIONS"] == list(range(1, 11))
    top = [r["line"] for r in rows if r["section"] == "TOP 10 TRANSACTIONS"]
    assert len(top) == 10 and all(f"rank: {k + 1}" in line for k, line in enumerate(top))
