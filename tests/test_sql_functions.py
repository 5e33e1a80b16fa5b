"""The functions called from SQL give what the column expressions give, without Python in the plan."""

import pytest
from pyspark.sql import functions as F

from monthwise.functions import scalars, sql

TEXTS = ["₹1,34,550.00", "(123.45)", "500.00 Dr", "500.00 Cr", "-42", "500-200", "2025-01-15", "", "Rs. 500", "abc", None, " 12 ", "1/2/2025", "2-Jan-25", "02 February 2025", "2025-01", "NEFT-ACME  LTD-9", "UPI-BOB-1", "x - y - z", "It's a 'CAFE'\\", "soon", "2025-02-03 10:30", "BIGBASKET upi"]
PYTHON = {"parse_amount": scalars.parse_amount, "parse_accounting": scalars.parse_accounting, "month_key": scalars.month_key, "month_label": scalars.month_label, "date_iso": scalars.date_iso, "payee": scalars.payee, "narration_payee": scalars.narration_payee, "is_upi": scalars.is_upi, "categorize": scalars.categorize}


@pytest.mark.parametrize("name", PYTHON)
def test_sql_equals_the_column(spark, name):
    sql.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, x string")
    df.createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT id, {name}(x) AS value FROM texts ORDER BY id")
    assert got.collect() == df.select("id", PYTHON[name](F.col("x")).alias("value")).orderBy("id").collect()
    assert "Python" not in got._jdf.queryExecution().toString() and "ArrowEval" not in got._jdf.queryExecution().toString()


def test_numbers(spark):
    sql.register(spark, prefix="own_")
    assert tuple(spark.sql("SELECT own_js_round(-2.505), own_grouped_digits(1234567)").first()) == (pytest.approx(-2.5), "12,34,567")


def test_own_rules(spark):
    rules = spark.createDataFrame([(2, "cafe|it's", "Coffee"), (1, "bigbasket", "Basket"), (3, "a", "Any")], sql.RULES)
    sql.register(spark, rules, "r_")
    assert tuple(spark.sql("SELECT r_categorize('BigBasket cafe'), r_categorize('IT\\'S'), r_categorize('xyz')").first()) == ("Basket", "Coffee", scalars.DEFAULT_CATEGORY)
    assert sql.rules_of(sql.rule_table(spark)) == list(scalars.CATEGORY_RULES)
    with pytest.raises(ValueError, match="rules"):
        sql.rules_of(spark.range(1001).select(F.col("id").cast("int").alias("place"), F.lit("x").alias("pattern"), F.lit("y").alias("category")))


def test_engine_keeps_own_rules(spark, tmp_path):
    from monthwise.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "e"))
    records = spark.createDataFrame([("2025-01-02", "Zed Works - x", None, "-1", ""), ("2025-01-03", "Netflix - y", None, "-2", "")], "Date string, Description string, Category string, Amount string, Balance string")
    engine.ingest(records, rules=spark.createDataFrame([(1, "zed", "Zeds")], sql.RULES))
    assert {r["category"] for r in engine.transactions().collect()} == {"Zeds", scalars.DEFAULT_CATEGORY}
    engine.ingest(records)  # the rules stay
    assert engine.base().where("category = 'Zeds'").count() == 1
    engine.ingest(records, rules=sql.rule_table(spark))
    assert engine.base().where("category = 'Entertainment'").count() == 1
