"""Questions whose filters combine: each answer is held to the sum over the transactions that the question means."""

import pytest
from pyspark.sql import functions as F

from monthwise.operators import payees
from monthwise.plans.engine import NOT_FOUND, NOT_UNDERSTOOD, Engine
from monthwise.plans.intent import classify, entities
from monthwise.plans.periods import span
from monthwise.sources import statements


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    out.ingest(statements.synthetic(spark, months=16, rows_a_month=60, start="2023-11-01"))
    return out


@pytest.fixture(scope="module")
def t(engine):
    return [r.asDict() | {"amount": float(r["amount"])} for r in engine.transactions().collect()]


def spent(rows):
    return sum(-r["amount"] for r in rows if r["amount"] < 0)


def got(engine, question):
    _, df, text = engine.ask(question)
    return df.collect(), text


def held(r, *words):
    return any(w in r["description"].lower() for w in words)


MONTH = {"2025-02": "this month"}
TOTALS = [
    ("How much did I spend on food in 2024?", lambda r: r["category"] == "Food & Dining" and r["ym"][:4] == "2024"),
    ("food spending in January 2025", lambda r: r["category"] == "Food & Dining" and r["ym"] == "2025-01"),
    ("How much did I spend on groceries?", lambda r: r["category"] == "Groceries"),
    ("How much did I spend on transport in the last 6 months?", lambda r: r["category"] == "Transport" and r["ym"] >= "2024-09"),
    ("How much did I spend on food in the 3 months ending August 2024?", lambda r: r["category"] == "Food & Dining" and "2024-06" <= r["ym"] <= "2024-08"),
    ("How much did I pay to Netflix?", lambda r: held(r, "netflix")),
    ("total Netflix payments?", lambda r: held(r, "netflix")),
    ("what did I pay NETFLIX?", lambda r: held(r, "netflix")),
    ("my netflix spending", lambda r: held(r, "netflix")),
    ("How much did I spend on Netflix and Spotify?", lambda r: held(r, "netflix", "spotify")),
    ("Combined spending on Netflix, Spotify?", lambda r: held(r, "netflix", "spotify")),
    ("How much did I spend on Netflix in 2024?", lambda r: held(r, "netflix") and r["ym"][:4] == "2024"),
    ("What did I pay to Netflix between March and May 2024?", lambda r: held(r, "netflix") and "2024-03" <= r["ym"] <= "2024-05"),
    ("Netflix spending from Nov 2024 until Feb 2025", lambda r: held(r, "netflix") and r["ym"] >= "2024-11"),
    ("netflix costs since October 2024", lambda r: held(r, "netflix") and r["ym"] >= "2024-10"),
    ("How much did I spend between November and January 2025?", lambda r: "2024-11" <= r["ym"] <= "2025-01"),
    ("How much did I spend before March 2024?", lambda r: r["ym"] < "2024-03"),
    ("How much was spent in Q2 2024?", lambda r: "2024-04" <= r["ym"] <= "2024-06"),
    ("How much did I spend on shopping over 2,000?", lambda r: r["category"] == "Shopping" and abs(r["amount"]) > 2000),
    ("Total payments under 500 in 2024", lambda r: abs(r["amount"]) < 500 and r["ym"][:4] == "2024"),
    ("How much did I spend in 2024 excluding rent?", lambda r: r["ym"][:4] == "2024" and r["category"] != "Rent"),
    ("How much did I spend excluding Netflix and groceries?", lambda r: not held(r, "netflix") and r["category"] != "Groceries"),
    ("How much did I pay to Netflx in March 2024?", lambda r: r["payee"] == "Netflix" and r["ym"] == "2024-03"),
    ("How much did I send to Blue-Door?", lambda r: r["payee"] == "Blue Door Cafe"),
    ("How much did I send to bluedor cafe?", lambda r: r["payee"] == "Blue Door Cafe"),
]


@pytest.mark.parametrize(("question", "meant"), TOTALS, ids=[q for q, _ in TOTALS])
def test_totals_of_what_is_meant(engine, t, question, meant):
    rows, _ = got(engine, question)
    assert rows and (sum(r["debit"] for r in rows), sum(r["count"] for r in rows)) == (pytest.approx(spent(filter(meant, t))), len(list(filter(meant, t))))


def test_other_measures_keep_their_filters(engine, t):
    own = [r for r in t if r["ym"] == "2024-03" and r["amount"] < 0]
    assert got(engine, "biggest expense in March 2024")[0][0]["amount"] == min(r["amount"] for r in own)
    assert got(engine, "smallest expense in March 2024")[0][0]["amount"] == max(r["amount"] for r in own)
    assert [r["amount"] for r in got(engine, "Top 4 expenses in March 2024")[0]] == sorted(r["amount"] for r in own)[:4]
    food = [r for r in t if r["category"] == "Groceries" and r["amount"] < 0]
    assert got(engine, "average spend on groceries")[0][0]["debit"] == pytest.approx(spent(food) / len(food), abs=0.01)
    best = {}
    for r in own:
        best[r["payee"]] = best.get(r["payee"], 0) - r["amount"]
    ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    assert [(r["payee"], r["spend"]) for r in got(engine, "Top 3 merchants in March 2024")[0]] == [(p, pytest.approx(v)) for p, v in ranked[:3]]
    everyone = {}
    for r in t:
        if r["amount"] < 0:
            everyone[r["payee"]] = everyone.get(r["payee"], 0) - r["amount"]
    assert [r["payee"] for r in got(engine, "who did I pay the most?")[0]] == [max(everyone, key=everyone.get)]
    cats = {}
    for r in t:
        if r["amount"] < 0:
            cats[r["category"]] = cats.get(r["category"], 0) - r["amount"]
    assert got(engine, "which category did I spend least on?")[0][0]["category"] == min(cats, key=cats.get)
    assert got(engine, "which category did I spend the most on?")[0][0]["category"] == max(cats, key=cats.get)
    assert {r["ym"]: r["debit"] for r in got(engine, "Netflix spending per month in 2024")[0]} == {ym: pytest.approx(spent(r for r in t if held(r, "netflix") and r["ym"] == ym)) for ym in {r["ym"] for r in t if held(r, "netflix") and r["ym"][:4] == "2024"}}
    assert got(engine, "how many transactions in March 2024?")[0][0]["count"] == 60
    assert got(engine, "how many payments to Netflix in 2024?")[0][0]["count"] == sum(held(r, "netflix") and r["ym"][:4] == "2024" for r in t)
    months = {ym: spent(r for r in t if r["ym"] == ym and r["category"] == "Groceries") for ym in {r["ym"] for r in t if r["category"] == "Groceries" and r["amount"] < 0}}
    assert got(engine, "which month did I spend the most on groceries?")[0][0]["ym"] == max(months, key=months.get)
    assert got(engine, "What is my net total?")[0][0]["net"] == pytest.approx(sum(r["amount"] for r in t), abs=0.01)
    assert got(engine, "What is my average transaction?")[0][0]["transaction"] == pytest.approx(sum(r["amount"] for r in t) / len(t), abs=0.01)
    late = [r for r in t if r["ym"] >= "2024-12" and r["amount"] < 0]
    assert got(engine, "biggest expense in the last 3 months")[0][0]["amount"] == min(r["amount"] for r in late)
    assert got(engine, "average spend in the last 3 months")[0][0]["debit"] == pytest.approx(spent(late) / len(late), abs=0.01)
    assert got(engine, "what is my balance")[1] == NOT_FOUND  # the statement has none


@pytest.mark.parametrize("question", ["What did I spend last week?", "spending on weekends", "How much did I spend on 5 March 2024?", "Netflix on Mondays", "spent on 2024-03-05", "How much did I spend excluding?"])
def test_conditions_that_are_not_understood_are_refused(engine, question):
    assert got(engine, question) == ([], NOT_UNDERSTOOD)


@pytest.mark.parametrize("question", ["How much did I spend on Zanzibar Trading?", "How much did I pay Qwxyz in 2024?", "netflix spending in March 1999"])
def test_what_is_not_there_is_not_found(engine, question):
    assert got(engine, question)[1] == NOT_FOUND


def test_names_come_alone():
    assert entities("swiggy between january and march 2024") == ("swiggy",) and entities("How much did I send to Rahul Sharma?") == ("rahul sharma",)
    assert entities("Total (City Metro, Old Town) in May") == ("city metro", "old town") and entities("What did I spend in total this month?") == ()
    assert classify("swiggy between january and march 2024").keywords == ("swiggy",)


@pytest.mark.parametrize(
    ("text", "want"),
    [("from january to march 2025", ("2025-01", "2025-03")), ("november to february 2025", ("2024-11", "2025-02")), ("between jan 2024 and feb 2025", ("2024-01", "2025-02")), ("since may 2024", ("2024-05", None)), ("after december 2024", ("2025-01", None)), ("before january 2025", (None, "2024-12")), ("january to march", ("-01", "-03")), ("2023 to 2024", ("2023-01", "2024-12")), ("since 2024", ("2024-01", None)), ("first quarter of 2024", ("2024-01", "2024-03")), ("in march 2025", (None, None)), ("may i see", (None, None))],
)
def test_ranges_of_months(text, want):
    assert span(text) == want


def test_dictionary_of_payees(spark):
    names = ["Blue Door Cafe", "Netflix", "Spotify", "City Metro", "Café Müller", "A. Neighbour", "Prime Video", "freelance work", None, "", "--"]
    index = payees.dictionary(spark.createDataFrame([(n,) for n in names], "payee string"))
    means = lambda *asked: sorted((r["name"], r["payee"]) for r in payees.like(index, asked).collect())
    assert means("netflx") == [("netflx", "Netflix")] and means("net flix") == [("net flix", "Netflix")] and means("blue-door") == [("blue-door", "Blue Door Cafe")]
    assert means("café muller") == [("café muller", "Café Müller")] and means("citymetro", "spotifi") == [("citymetro", "City Metro"), ("spotifi", "Spotify")]
    assert means("freelancing") == [("freelancing", "freelance work")] and means("zanzibar") == [] and means("netflix india") == [("netflix india", "Netflix")]
