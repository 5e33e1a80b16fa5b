"""Registered queries over the test tables, each with its SQL.

Parameters of the queries are fixed here; the operators take any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.functions import sql as sql_functions
from monthwise.operators import base, facts, months, payees, postings, relational, search, vectors
from monthwise.plans import answers, periods
from monthwise.plans.intent import classify
from monthwise.sources import adapter, delimited, layout, statements
from monthwise.sources.adapter import T_SQL, transactions

KEYWORDS = ("metro", "cafe")
MONTH, YEAR, CATEGORY = "1998-03", "1998", "Transport"
SEARCH = "heon tion thand"
CHUNK_COLUMNS = ["date", "description", "category", "amount", "balance"]
CONTEXT = "Statement of orders"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPENT = "CAST(coalesce(sum(CASE WHEN amount < 0 THEN -amount END), 0) AS DOUBLE)"
_EARNED = "CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DOUBLE)"
_TOTALS = f"{_SPENT} AS debit, {_EARNED} AS credit, count(*) AS count"
_KEYS = "(" + " OR ".join(f"contains(lower(description), '{k}')" for k in KEYWORDS) + ")"
_ROW = "id, date, payee, description, category, CAST(amount AS DOUBLE) AS amount"


def _add(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """A query over the transactions; its SQL sees them as ``t``."""
    QUERIES[name] = lambda spark, sf_dir: build(transactions(spark, sf_dir))
    if sql is not None:
        SQL[name] = T_SQL + sql


def _add_raw(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


r = relational
_add("tx_overview", r.overview, f"SELECT {_TOTALS}, CAST(coalesce(sum(is_upi), 0) AS BIGINT) AS upi, count(*) FILTER (amount < 0) AS debit_count FROM t")
_add("tx_keyword", lambda t: r.keyword_totals(t, KEYWORDS), f"SELECT {_TOTALS} FROM t WHERE {_KEYS}")
_add("tx_keyword_by_month", lambda t: r.keyword_by_month(t, KEYWORDS), f"SELECT ym, {_TOTALS} FROM t WHERE {_KEYS} GROUP BY ym")
_add("tx_keyword_month", lambda t: r.keyword_month(t, KEYWORDS, MONTH), f"SELECT {_TOTALS} FROM t WHERE {_KEYS} AND ym = '{MONTH}'")
_add("agg_keywords_net", lambda t: r.keywords_net(t, [" Metro ", "CAFE", "x"]), f"SELECT {_TOTALS}, round({_EARNED} - {_SPENT}, 2) AS net FROM t WHERE {_KEYS}")
_add("tx_month_spend", lambda t: r.month_spend(t, MONTH), f"SELECT {_SPENT} AS debit, count(*) AS count FROM t WHERE ym = '{MONTH}' AND amount < 0")
_add("tx_monthly_spend", r.monthly_spend, f"SELECT ym, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 GROUP BY ym")
_add("tx_year_monthly", lambda t: r.year_monthly(t, YEAR), f"SELECT ym, {_TOTALS} FROM t WHERE ym LIKE '{YEAR}-%' GROUP BY ym")
_add("tx_category_spend", lambda t: r.category_spend(t, CATEGORY), f"SELECT {_SPENT} AS debit, count(*) AS count FROM t WHERE category = '{CATEGORY}' AND amount < 0")
_add("tx_category_month", lambda t: r.category_spend(t, CATEGORY, MONTH), f"SELECT {_SPENT} AS debit, count(*) AS count FROM t WHERE category = '{CATEGORY}' AND amount < 0 AND ym = '{MONTH}'")
_add("tx_category_breakdown", r.category_breakdown, f"SELECT category, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 GROUP BY category ORDER BY spend DESC, category LIMIT 8")
_add("category_share", r.category_share, f"SELECT category, {_SPENT} AS spend, round({_SPENT} / CAST(sum(sum(-amount)) OVER () AS DOUBLE), 6) AS share FROM t WHERE amount < 0 GROUP BY category")
_add("tx_top_payees", r.top_payees, f"SELECT payee, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 GROUP BY payee ORDER BY spend DESC, payee LIMIT 6")
_subs = " OR ".join(f"contains(lower(description), '{k}')" for k in scalars.SUBSCRIPTION_KEYS)
_add("tx_subscriptions", r.subscriptions, f"SELECT payee, {_SPENT} AS total, count(*) AS count, max(date) AS last FROM t WHERE amount < 0 AND ({_subs}) GROUP BY payee ORDER BY total DESC, payee LIMIT 12")
_not = " AND ".join(f"NOT contains(lower(description), '{k}')" for k in r.NOT_PEOPLE)
_add("tx_received_people", r.received_from_people, f"SELECT {_EARNED} AS credit, count(*) AS count FROM t WHERE amount > 0 AND {_not}")
_add("largest_debit", r.largest_debits, f"SELECT {_ROW} FROM t WHERE amount < 0 ORDER BY t.amount, id LIMIT 1")
_add("largest_credit", r.largest_credits, f"SELECT {_ROW} FROM t WHERE amount > 0 ORDER BY t.amount DESC, id LIMIT 1")
_add("smallest_debit", r.smallest_debits, f"SELECT {_ROW} FROM t WHERE amount < 0 ORDER BY t.amount DESC, id LIMIT 1")
_add("top_debits", lambda t: r.largest_debits(t, 5), f"SELECT {_ROW} FROM t WHERE amount < 0 ORDER BY t.amount, id LIMIT 5")
_add("top_abs", r.top_by_magnitude, f"SELECT {_ROW} FROM t ORDER BY abs(t.amount) DESC, id LIMIT 5")
_add("tx_recent", r.recent, f"SELECT {_ROW} FROM t ORDER BY date DESC, id DESC LIMIT 12")
_add("current_balance", r.current_balance, "SELECT CAST(arg_max(balance, (date, id)) AS DOUBLE) AS balance FROM t WHERE balance IS NOT NULL")
_add("tx_page", lambda t: r.page(t, 20, 10, "Cafe"), f"SELECT {_ROW}, CAST(balance AS DOUBLE) AS balance FROM t WHERE contains(lower(description), 'cafe') ORDER BY date DESC, id DESC LIMIT 10 OFFSET 20")
_add("tx_page_total", lambda t: r.page_total(t, "Cafe"), "SELECT count(*) AS total FROM t WHERE contains(lower(description), 'cafe')")
_add("distinct_months", r.distinct_months, "SELECT DISTINCT ym FROM t WHERE ym <> ''")
_add("seed_category_avg", r.category_average, "SELECT category, CAST(sum(amount) AS DOUBLE) AS net, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS average, count(*) AS count FROM t GROUP BY category")
_add("month_extremes", r.month_extremes, f"""
, m AS (SELECT ym, {_SPENT} AS spend FROM t WHERE amount < 0 GROUP BY ym)
SELECT 'most' AS kind, * FROM (SELECT * FROM m ORDER BY spend DESC, ym LIMIT 1) UNION ALL SELECT 'least', * FROM (SELECT * FROM m ORDER BY spend, ym LIMIT 1)""")
_add("coverage", r.coverage, """
, m AS (SELECT ym, count(*) AS n, strftime(CAST(ym || '-01' AS DATE), '%b') AS name FROM t GROUP BY ym)
SELECT substr(ym, 1, 4) AS year, count(*) AS months, string_agg(name, ', ' ORDER BY ym) AS names, CAST(sum(n) AS BIGINT) AS count FROM m GROUP BY 1
UNION ALL SELECT 'Total', count(*), '', CAST(sum(n) AS BIGINT) FROM m""")
_add("breakdown_with_total", r.breakdown_with_total, f"SELECT coalesce(ym, 'Total') AS ym, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 GROUP BY ROLLUP (ym)")
_add("running_balance", r.running_balance, "SELECT id, account, CAST(sum(amount) OVER (PARTITION BY account ORDER BY date, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM t")
_add("balance_breaks", r.balance_breaks, """
, p AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY account ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM t)
SELECT id, account, CAST(previous AS DOUBLE) AS previous, CAST(amount AS DOUBLE) AS amount, CAST(balance AS DOUBLE) AS balance, CAST(balance - previous - amount AS DOUBLE) AS off
FROM p WHERE balance IS NOT NULL AND previous IS NOT NULL AND abs(balance - previous - amount) > 0.05""")
_RECORDS = """
, rec AS (SELECT id, date AS "Date", description AS "Description", category AS "Category", CASE WHEN amount < 0 THEN '-' ELSE '+' END || CAST(abs(amount) AS VARCHAR) AS "Amount", coalesce(CAST(balance AS VARCHAR), '') AS "Balance" FROM t)
"""
_add("records_export", r.records, _RECORDS + "SELECT * FROM rec")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a second source, without categories."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    amount = F.concat(F.lit("-"), F.col("l_extendedprice").cast(scalars.MONEY).cast("string"))
    return lines.select(F.col("l_orderkey").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"), F.concat(F.lit("Part shop - "), F.col("l_partkey").cast("string")).alias("Description"), F.lit("").alias("Category"), amount.alias("Amount"))


_add_raw("union_sources", lambda s, d: r.union_records(r.records(transactions(s, d)), _lines(s, d)), T_SQL + _RECORDS + """
SELECT id, "Date", "Description", "Category", "Amount", "Balance" FROM rec
UNION ALL SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), 'Part shop - ' || CAST(l_partkey AS VARCHAR), 'Shopping', '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), NULL FROM lineitem""")
_add("numeric_columns", lambda t: r.numeric_columns(r.records(t), ["Date", "Description", "Category", "Amount", "Balance"]), _RECORDS + """
, c AS (UNPIVOT (SELECT "Date", "Description", "Category", "Amount", "Balance" FROM rec) ON COLUMNS(*) INTO NAME "column" VALUE v)
SELECT "column", count(*) FILTER (trim(v) <> '') AS filled, count(*) FILTER (regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?$')) AS parsed,
  CASE WHEN count(*) FILTER (regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]+)?$')) >= 0.6 * count(*) FILTER (trim(v) <> '') THEN 1 ELSE 0 END AS numeric FROM c GROUP BY 1""")


def _marked(t: DataFrame) -> DataFrame:
    """Amounts as statements write them."""
    text = F.abs("amount").cast("string")
    return t.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("$"), text)).otherwise(F.concat(F.lit("₹"), text)).alias("Paid"))


_add("detect_currency", lambda t: r.detect_currency(_marked(t), ["Paid"]), "SELECT 'INR' AS code, count(*) AS cells FROM t WHERE id % 5 <> 0")

_add("split_amount", lambda t: t.select("id", scalars.split_amount(F.when(F.col("amount") < 0, F.abs("amount").cast("string")), F.when(F.col("amount") >= 0, F.col("amount").cast("string"))).alias("amount")),
     "SELECT id, CASE WHEN amount < 0 THEN '-' ELSE '+' END || CAST(abs(amount) AS VARCHAR) AS amount FROM t")


def _written(t: DataFrame) -> DataFrame:
    """Amounts in six notations."""
    text = F.abs("amount").cast("string")
    grouped = F.concat(scalars.grouped_digits(F.floor(F.abs("amount"))), F.substring(text, -3, 3))
    forms = (text, F.concat(F.lit("₹"), grouped), F.concat(F.lit("("), text, F.lit(")")), F.concat(text, F.lit(" Dr")), F.concat(F.lit("Rs. "), text), F.lit("abc"))
    out = forms[-1]
    for k, form in enumerate(forms[:-1]):
        out = F.when(F.col("id") % 6 == k, form).otherwise(out)
    return t.select("id", "amount", out.alias("written"))


_add("parse_amount", lambda t: _written(t).select("id", scalars.parse_amount(F.col("written")).cast("double").alias("value")), "SELECT id, CASE WHEN id % 6 = 5 THEN 0.0 ELSE CAST(abs(amount) AS DOUBLE) END AS value FROM t")
_add("parse_accounting", lambda t: _written(t).select("id", scalars.parse_accounting(F.col("written")).cast("double").alias("value")), "SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 IN (2, 3) THEN CAST(-abs(amount) AS DOUBLE) ELSE CAST(abs(amount) AS DOUBLE) END AS value FROM t")
_add("month_key", lambda t: t.select("id", scalars.month_key(F.col("date")).alias("ym")), "SELECT id, substr(date, 1, 7) AS ym FROM t")
_add("month_label", lambda t: t.select("ym").distinct().select("ym", scalars.month_label(F.col("ym")).alias("label")), "SELECT DISTINCT ym, strftime(CAST(ym || '-01' AS DATE), '%B %Y') AS label FROM t")
_add("date_iso", lambda t: t.select("id", scalars.date_iso(F.date_format(F.to_date("date"), "dd/MM/yyyy")).alias("iso")), "SELECT id, date AS iso FROM t")
_add("payee", lambda t: t.select("id", scalars.payee(F.col("description")).alias("payee")), "SELECT id, payee FROM t")
_add("narration_payee", lambda t: t.select("id", scalars.narration_payee(F.split_part("description", F.lit(" - "), F.lit(2))).alias("payee")), "SELECT id, payee FROM t")
_add("categorize", lambda t: t.select("id", scalars.categorize(F.col("description")).alias("category")), "SELECT id, category FROM t")
_add("upi_count", lambda t: t.agg(F.sum(scalars.is_upi(F.col("description"))).cast("long").alias("upi")), "SELECT CAST(sum(is_upi) AS BIGINT) AS upi FROM t")
_add("js_round", lambda t: t.select("id", scalars.js_round(F.col("amount").cast("double") / 8).alias("value")), "SELECT id, floor(CAST(amount AS DOUBLE) / 8 * 100 + 0.5) / 100 AS value FROM t")
_CHUNK = """
, chunk AS (SELECT id, 'Row ' || CAST(id AS VARCHAR) || ' | ' || concat_ws('; ', 'date: ' || date, 'description: ' || description, 'category: ' || category, 'amount: ' || CAST(amount AS VARCHAR), 'balance: ' || CAST(balance AS VARCHAR)) AS content FROM t)
"""


def chunks(t: DataFrame) -> DataFrame:
    return t.select("id", scalars.chunk_text(F.col("id"), CHUNK_COLUMNS).alias("content"))


_add("chunk_text", chunks, _CHUNK + "SELECT * FROM chunk")
_add("content_length", lambda t: chunks(t).agg(F.sum(F.length("content")).alias("chars")), _CHUNK + "SELECT CAST(sum(length(content)) AS BIGINT) AS chars FROM chunk")
_add("chunk_fields", lambda t: chunks(t).select("id", *(c.alias(n) for n, c in scalars.chunk_fields(F.col("content")).items())), "SELECT id, date, description, category, CAST(amount AS DOUBLE) AS amount, trim(split_part(description, '-', 1)) AS payee FROM t")
_add("contextual_chunk", lambda t: chunks(t).select("id", scalars.contextual_chunk(F.col("content"), CONTEXT).alias("content")), _CHUNK + f"SELECT id, concat_ws(' | ', '{CONTEXT}', 'Category: ' || category, 'Payee: ' || payee, 'Amount: ' || CAST(amount AS VARCHAR), content) AS content FROM chunk JOIN t USING (id)")
_add("tokenize", lambda t: chunks(t).select("id", scalars.tokens(F.col("content")).alias("w")).select("id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens")), _CHUNK + """
, w AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS w FROM chunk)
SELECT id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM w""")
_add("json_roundtrip", lambda t: t.select("id", F.to_json(F.struct("payee", "date", F.col("amount").cast("string").alias("amount"))).alias("json")).select("id", F.from_json("json", "payee string, date string, amount string").alias("x")).select("id", "x.payee", "x.date", F.col("x.amount").try_cast("double").alias("amount")),
     "SELECT id, payee, date, CAST(amount AS DOUBLE) AS amount FROM t")

_M = f"""
, m AS (SELECT ym, {_EARNED} AS income, {_SPENT} AS spending, round({_EARNED} - {_SPENT}, 2) AS net, count(*) AS count, CAST(sum(is_upi) AS BIGINT) AS upi FROM t GROUP BY ym)
"""
_MEMBERS = """
, mm AS (SELECT ym, row_number() OVER (ORDER BY ym) AS place FROM (SELECT DISTINCT ym FROM t))
, mem AS (SELECT a.ym AS anchor, w AS "window", b.ym FROM mm a, (SELECT unnest([1, 3, 6, 9, 12]) AS w), mm b WHERE a.place >= w AND b.place BETWEEN a.place - w + 1 AND a.place)
"""
_add("month_summaries", months.month_summaries, _M + "SELECT * FROM m")
_add("month_summary_point", lambda t: months.month_summaries(t.where(F.col("ym") == MONTH)), _M + f"SELECT * FROM m WHERE ym = '{MONTH}'")
_add("month_categories", months.month_categories, f"SELECT ym, category, {_SPENT} AS spend FROM t WHERE amount < 0 GROUP BY ym, category")
_add("month_payees", months.month_payees, """
, p AS (SELECT ym, payee, sum(abs(amount)) AS v FROM t GROUP BY ym, payee), q AS (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY v DESC, payee) AS rank FROM p)
SELECT ym, rank, payee, CAST(v AS DOUBLE) AS volume FROM q WHERE rank <= 20""")
_add("month_largest", months.month_largest, """
, q AS (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY abs(amount) DESC, id) AS k FROM t)
SELECT ym, id, payee, date, CAST(amount AS DOUBLE) AS amount FROM q WHERE k = 1""")
_add("month_gold", lambda t: months.gold_text(months.month_gold(t)), _M + f"""
, c AS (SELECT ym, category, sum(-amount) AS v FROM t WHERE amount < 0 GROUP BY ym, category), cs AS (SELECT ym, string_agg(category || '=' || CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR), '; ' ORDER BY category) AS categories FROM c GROUP BY ym)
, p AS (SELECT ym, payee, sum(abs(amount)) AS v FROM t GROUP BY ym, payee), q AS (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY v DESC, payee) AS rank FROM p)
, ps AS (SELECT ym, string_agg(payee || '=' || CAST(CAST(v AS DECIMAL(18,2)) AS VARCHAR), '; ' ORDER BY rank) AS payees FROM q WHERE rank <= 20 GROUP BY ym)
, l AS (SELECT ym, arg_max(payee || ' ' || date || ' ' || CAST(amount AS VARCHAR), (abs(amount), -id)) AS largest FROM t GROUP BY ym)
SELECT m.*, coalesce(categories, '') AS categories, payees, largest FROM m LEFT JOIN cs USING (ym) JOIN ps USING (ym) JOIN l USING (ym)""")
_add("tx_last_months", r.last_months, f"""
, m AS (SELECT ym, {_SPENT} AS spend FROM t WHERE amount < 0 GROUP BY ym ORDER BY ym DESC LIMIT 12) SELECT * FROM m UNION ALL SELECT 'Total', round(sum(spend), 2) FROM m""")
_add("tx_subscriptions_total", r.subscriptions_total, f"SELECT {_SPENT} AS total, count(DISTINCT payee) AS payees FROM t WHERE amount < 0 AND ({_subs})")
_add("tx_averages", r.averages, """
, m AS (SELECT ym, sum(-amount) FILTER (amount < 0) AS s FROM t GROUP BY ym)
SELECT round(CAST(sum(-amount) FILTER (amount < 0) AS DOUBLE) / count(*) FILTER (amount < 0), 2) AS debit, round(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) / count(*) FILTER (amount > 0), 2) AS credit,
  (SELECT round(CAST(sum(s) AS DOUBLE) / count(s), 2) FROM m) AS month, count(*) FILTER (amount <> 0) AS count FROM t""")
_add("tx_similar_payees", lambda t: r.by_similar_payees(t, ["Spotify Ltd", "blue-door"]).groupBy("payee").agg(*r.totals()), f"SELECT payee, {_TOTALS} FROM t WHERE payee IN ('Blue Door Cafe', 'Spotify') GROUP BY payee")
for _w in months.WINDOWS:
    _add(f"rolling_{_w}", lambda t, w=_w: months.rolling(months.month_summaries(t), w), _M + f"""
, x AS (SELECT ym AS anchor, min(ym) OVER s AS start, row_number() OVER (ORDER BY ym) AS place, round(sum(income) OVER s, 2) AS income, round(sum(spending) OVER s, 2) AS expense, round(sum(net) OVER s, 2) AS net,
  CAST(sum(count) OVER s AS BIGINT) AS count, CAST(sum(upi) OVER s AS BIGINT) AS upi FROM m WINDOW s AS (ORDER BY ym ROWS {_w - 1} PRECEDING))
SELECT anchor, start, income, expense, net, count, upi FROM x WHERE place >= {_w}""")
_add("period_exact", lambda t: months.periods_exact(t).withColumn("window", F.col("window").cast("long")), _MEMBERS + f"""SELECT anchor, CAST("window" AS BIGINT) AS "window", {_EARNED} AS income, {_SPENT} AS expense, CAST(sum(amount) AS DOUBLE) AS net, count(*) AS count FROM t JOIN mem USING (ym) GROUP BY ALL""")
for _name, _value, _where in (("categories", "-amount", "WHERE amount < 0"), ("payees", "abs(amount)", "")):
    _col = {"categories": "category", "payees": "payee"}[_name]
    _add(f"period_top_{_name}", getattr(months, f"period_top_{_name}"), _MEMBERS + f"""
, g AS (SELECT anchor, "window", {_col}, sum({_value}) AS v FROM t JOIN mem USING (ym) {_where} GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY anchor, "window" ORDER BY v DESC, {_col}) AS rank FROM g)
SELECT anchor, CAST("window" AS BIGINT) AS "window", rank, {_col}, CAST(v AS DOUBLE) AS amount FROM q WHERE rank <= 5""")
_add("trend_last6", lambda t: months.trend(months.month_summaries(t)), _M + "SELECT ym AS anchor, ym AS start, income, spending AS expense, net, count, upi FROM m ORDER BY ym DESC LIMIT 6")


def _doubled(t: DataFrame) -> DataFrame:
    """New rows for a month: the old ones with twice the amount."""
    return t.where(F.col("ym") == MONTH).withColumn("amount", (F.col("amount") * 2).cast(scalars.MONEY))


_add("update_month", lambda t: months.update_month(months.month_summaries(t), MONTH, _doubled(t)), _M + f"""
SELECT ym, CASE WHEN ym = '{MONTH}' THEN 2 ELSE 1 END * income AS income, CASE WHEN ym = '{MONTH}' THEN 2 ELSE 1 END * spending AS spending,
  round(CASE WHEN ym = '{MONTH}' THEN 2 ELSE 1 END * (income - spending), 2) AS net, count, upi FROM m""")


def _picked(question: str) -> Callable[[DataFrame], DataFrame]:
    def build(t: DataFrame) -> DataFrame:
        all_periods = months.periods(months.month_summaries(t))
        return periods.pick(question, all_periods).select("anchor", F.col("window").cast("long").alias("window"), "label", "income", "expense", "count")

    return build


_P = _M + _MEMBERS + """
, p AS (SELECT anchor, CAST("window" AS BIGINT) AS "window", min(ym) AS start, round(sum(income), 2) AS income, round(sum(spending), 2) AS expense, CAST(sum(count) AS BIGINT) AS count FROM mem JOIN m USING (ym) GROUP BY ALL)
, pl AS (SELECT *, CASE WHEN start = anchor THEN strftime(CAST(anchor || '-01' AS DATE), '%B %Y') ELSE strftime(CAST(start || '-01' AS DATE), '%B %Y') || ' – ' || strftime(CAST(anchor || '-01' AS DATE), '%B %Y') END AS label FROM p)
SELECT anchor, "window", label, income, expense, count FROM pl """
_add("pick_periods_window", _picked("How were the last 6 months?"), _P + """WHERE "window" = 6 AND anchor = (SELECT max(ym) FROM t)""")
_add("pick_periods_anchor", _picked("Summarize March 1998"), _P + """WHERE "window" IN (1, 3, 6, 12) AND anchor = '1998-03'""")
_add("pick_periods_trend", _picked("Show the trend of my spending"), _P + """WHERE "window" = 1 ORDER BY anchor DESC LIMIT 6""")

_RANKED = "SELECT category, spend, row_number() OVER (ORDER BY spend{0}, category) AS rank FROM (SELECT category, {1} AS spend FROM t WHERE amount < 0 GROUP BY category) ORDER BY rank LIMIT 10"
_add("facts_overview", facts.facts_overview, f"""SELECT count(*) AS count, {_EARNED} AS income, {_SPENT} AS expense, CAST(sum(amount) AS DOUBLE) AS net, round(CAST(sum(amount) AS DOUBLE) / count(*), 4) AS average,
  arg_max(payee, (abs(amount), -id)) FILTER (amount < 0) AS largest_debit_payee, CAST(min(amount) FILTER (amount < 0) AS DOUBLE) AS largest_debit,
  arg_max(payee, (amount, -id)) FILTER (amount > 0) AS largest_credit_payee, CAST(max(amount) FILTER (amount > 0) AS DOUBLE) AS largest_credit FROM t""")
_add("facts_categories", facts.facts_categories, f"SELECT category, count(*) AS count, {_EARNED} AS earned, {_SPENT} AS spent, CAST(sum(abs(amount)) AS DOUBLE) AS volume FROM t GROUP BY category")
_add("facts_top_categories", facts.facts_top_categories, _RANKED.format(" DESC", _SPENT))
_add("facts_bottom_categories", facts.facts_bottom_categories, _RANKED.format("", _SPENT))
_add("facts_monthly", facts.facts_monthly, f"SELECT ym, count(*) AS count, {_EARNED} AS income, {_SPENT} AS expense, CAST(sum(amount) AS DOUBLE) AS net FROM t GROUP BY ym")
_add("facts_top_payees", facts.facts_top_payees, "SELECT payee, volume, count, row_number() OVER (ORDER BY volume DESC, payee) AS rank FROM (SELECT payee, CAST(sum(abs(amount)) AS DOUBLE) AS volume, count(*) AS count FROM t GROUP BY payee) ORDER BY rank LIMIT 20")
_add("facts_top_transactions", facts.facts_top_transactions, f"SELECT {_ROW}, row_number() OVER (ORDER BY abs(t.amount) DESC, id) AS rank FROM t ORDER BY rank LIMIT 10")
_add("facts_balance", facts.facts_balance, "SELECT CAST(arg_max(balance, id) AS DOUBLE) AS balance, max(id) AS id FROM t WHERE balance IS NOT NULL")
_add("facts_recent", facts.facts_recent, "SELECT id, date, payee, CAST(amount AS DOUBLE) AS amount FROM t ORDER BY id DESC LIMIT 10")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _query_vector(vectors: DataFrame) -> list[float]:
    return vectors.where("id = 0").select("embedding").first()[0]


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_texts(spark, sf_dir), SEARCH)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return search.cosine_topk(vectors, _query_vector(vectors))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(cosine_topk(spark, sf_dir), bm25_search(spark, sf_dir))


_TERMS = search.query_terms(SEARCH)
_BM25 = (
    "WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS w FROM documents), c AS (SELECT id, len(w) AS length, "
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    + " FROM w), s AS (SELECT count(*) AS texts, avg(length) AS mean, "
    + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    + " FROM c), kw AS (SELECT id, round("
    + " + ".join(f"ln(1 + (texts - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(_TERMS)))
    + ", 6) AS score FROM c, s WHERE "
    + " OR ".join(f"tf{i} > 0" for i in range(len(_TERMS)))
    + " ORDER BY score DESC, id LIMIT 12)"
)
_COSINE = """, v AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings), sem AS (SELECT * FROM v ORDER BY score DESC, id LIMIT 10)"""
_add_raw("bm25_search", bm25_search, _BM25 + " SELECT * FROM kw")
_add_raw("cosine_topk", cosine_topk, "WITH x AS (SELECT 1)" + _COSINE + " SELECT * FROM sem")
_add_raw("hybrid_rrf", hybrid_rrf, _BM25 + _COSINE + """
, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS a FROM sem), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS b FROM kw)
SELECT id, round(coalesce(1.0::DOUBLE / (60 + a), 0) + coalesce(1.0::DOUBLE / (60 + b), 0), 8) AS score, CASE WHEN a IS NULL THEN 'keyword' WHEN b IS NULL THEN 'semantic' ELSE 'both' END AS source
FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT 20""")


def _orders_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as lines of a file with semicolons: a title above the header, the header again at the end, and of 50 lines each one without a date, without an amount, with more fields and with a single one."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast(scalars.MONEY)
    date = F.when(k % 50 == 0, "pending").otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    amount = F.when(k % 50 == 1, "1-2-3").otherwise(F.concat(F.when(F.col("o_orderstatus") == "F", "").otherwise("-"), F.format_number(price.cast("double"), 2)))
    line = F.concat_ws(";", date, F.concat(F.lit('"Order; "" '), k.cast("string"), F.lit('"')), amount, F.lit(""))
    line = F.when(k % 50 == 2, F.concat(line, F.lit(";more"))).when(k % 50 == 3, F.concat(F.lit("note "), k.cast("string"))).otherwise(line)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("orders").alias("path"), (k + 10).cast("long").alias("at"), line.alias("value"))
    head = "Order Date;Details;Amount;Balance"
    own = spark.range(3).select(F.lit("orders").alias("path"), F.when(F.col("id") == 2, 1 << 60).otherwise(F.col("id")).alias("at"), F.when(F.col("id") == 0, "Orders of the shop").otherwise(head).alias("value"))
    return rows.unionByName(own).withColumn("block", F.lit(0).cast("long"))


def csv_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions read from lines, by month."""
    records = statements.normalise(delimited.scan_lines(_orders_as_lines(spark, sf_dir)).records)
    return statements.to_transactions(records).groupBy("ym").agg(*r.totals())


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are rejected for each reason."""
    found = delimited.scan_lines(_orders_as_lines(spark, sf_dir))
    return found.rejects.unionByName(statements.untyped(statements.normalise(found.records))).groupBy("reason").agg(r.rows().alias("lines"))


_add_raw("csv_months", csv_months, f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 50 > 3)
SELECT ym, {_TOTALS} FROM t GROUP BY ym""")
_add_raw("csv_rejects", csv_rejects, f"""
SELECT * FROM (
  SELECT CASE o_orderkey % 50 WHEN 0 THEN '{statements.NO_DATE}' WHEN 1 THEN '{statements.NO_AMOUNT}' WHEN 2 THEN '{layout.MANY}' ELSE '{layout.FEW}' END AS reason, count(*) AS lines FROM orders WHERE o_orderkey % 50 < 4 GROUP BY 1
  UNION ALL SELECT '{layout.ABOVE}', 1 UNION ALL SELECT '{layout.AGAIN}', 1)""")


def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search from postings in place of texts."""
    texts = _texts(spark, sf_dir)
    return postings.search(postings.postings(texts), postings.text_stats(texts), SEARCH)


_add_raw("bm25_postings", bm25_postings, _BM25 + " SELECT * FROM kw")
_add("dashboard", lambda t: base.dashboard(base.base(t)), f"""
, d AS (SELECT * FROM t WHERE amount < 0), s AS (SELECT * FROM d WHERE {_subs})
SELECT 'overview' AS part, 'debit' AS name, {_SPENT} AS amount, count(*) FILTER (amount < 0) AS count FROM t
UNION ALL SELECT 'overview', 'credit', {_EARNED}, count(*) FROM t
UNION ALL (SELECT 'categories', category, {_SPENT}, count(*) FROM d GROUP BY category ORDER BY 3 DESC, 2 LIMIT 8)
UNION ALL (SELECT 'payees', payee, {_SPENT}, count(*) FROM d GROUP BY payee ORDER BY 3 DESC, 2 LIMIT 6)
UNION ALL (SELECT 'months', ym, {_SPENT}, count(*) FROM t GROUP BY ym ORDER BY 2 DESC LIMIT 12)
UNION ALL (SELECT 'subscriptions', payee, {_SPENT}, count(*) FROM s GROUP BY payee ORDER BY 3 DESC, 2 LIMIT 12)
UNION ALL SELECT 'subscriptions_total', 'all', {_SPENT}, count(DISTINCT payee) FROM s
UNION ALL SELECT 'balance', 'last', CAST(arg_max(balance, (date, id)) AS DOUBLE), 1 FROM t WHERE balance IS NOT NULL""")


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector search by lists, all of them probed."""
    rows = _vectors(spark, sf_dir)
    return vectors.topk(rows, _query_vector(rows))


_add_raw("vector_index_topk", vector_index_topk, "WITH x AS (SELECT 1)" + _COSINE + " SELECT * FROM sem")


def sql_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions called from SQL text over a view of the transactions."""
    t = transactions(spark, sf_dir)
    sql_functions.register(spark, prefix="mw_")
    written = _written(t).join(t.select("id", "date", "ym", "description"), "id")
    return spark.sql("""
        SELECT id, CAST(mw_parse_amount(written) AS DOUBLE) AS lenient, CAST(mw_parse_accounting(written) AS DOUBLE) AS accounting, mw_month_key(date) AS ym, mw_month_label(ym) AS label,
          mw_date_iso(date_format(to_date(date), 'd-MMM-yyyy')) AS iso, mw_payee(description) AS payee, mw_narration_payee(split_part(description, ' - ', 2)) AS narrated,
          mw_categorize(description) AS category, mw_is_upi(description) AS upi, mw_js_round(CAST(amount AS DOUBLE) / 8) AS rounded
        FROM {written}""", written=written)


_add_raw("sql_scalars", sql_scalars, T_SQL + """
SELECT id, CASE WHEN id % 6 = 5 THEN 0.0 ELSE CAST(abs(amount) AS DOUBLE) END AS lenient,
  CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 IN (2, 3) THEN CAST(-abs(amount) AS DOUBLE) ELSE CAST(abs(amount) AS DOUBLE) END AS accounting,
  substr(date, 1, 7) AS ym, strftime(CAST(ym || '-01' AS DATE), '%B %Y') AS label, date AS iso, payee, payee AS narrated, category, is_upi AS upi, floor(CAST(amount AS DOUBLE) / 8 * 100 + 0.5) / 100 AS rounded FROM t""")


def _orders_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as positioned items of seven printed statements, of which the last says nothing that names its columns."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, (k % 7).cast("string").alias("doc"), F.floor(k / 40).cast("int").alias("page"), (700 - k % 40 * 15).cast("double").alias("top"), F.date_format("o_orderdate", "dd/MM/yy").alias("date"), (F.col("o_orderstatus") == "F").alias("paid"), F.format_number(F.col("o_totalprice").cast("double"), 2).alias("price"))
    item = lambda x, y, text: F.struct(x.cast("double").alias("x"), (F.col("top") + y).alias("y"), text.alias("str"))
    parts = [item(F.lit(30), 0, F.col("date")), item(F.lit(100), 1, F.concat(F.lit("NEFT-SHOP "), k.cast("string"), F.lit("-ORDER"))), item(F.when(F.col("paid"), 500).otherwise(450), -1, F.col("price")), item(F.lit(100), -8, F.lit(" CONTINUED"))]
    body = rows.select("doc", "page", F.explode(F.array(*parts)).alias("i")).select("doc", "page", "i.*")
    head = spark.range(18).select((F.col("id") % 6).cast("string").alias("doc"), F.lit(-1).alias("page"), (F.col("id") * 20.0).alias("x"), F.lit(9.0).alias("y"), F.element_at(F.array(*map(F.lit, statements.HEADER_PHRASES)), (F.floor(F.col("id") / 6) + 1).cast("int")).alias("str"))
    return body.unionByName(head)


def printed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions read from printed pages, by month."""
    return statements.to_transactions(statements.scan_items(_orders_as_items(spark, sf_dir)).records).groupBy("ym").agg(*r.totals(), F.count(F.when(F.col("description").rlike("^SHOP \\d+ - NEFT-SHOP \\d+-ORDER ?CONTINUED$"), 1)).alias("whole"))


_add_raw("printed_months", printed_months, f"""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 7 < 6)
SELECT '20' || substr(ym, 3) AS ym, {_TOTALS}, count(*) AS whole FROM t GROUP BY ym""")


def _asked(question: str, similar: bool = False) -> Callable[[DataFrame], DataFrame]:
    """The answer to a question over the transactions."""

    def build(t: DataFrame) -> DataFrame:
        i = classify(question)
        only = answers.months_meant(i, sorted(row["ym"] for row in r.distinct_months(t).collect()))  # a row a month
        own = t if only is None else t.where(F.col("ym").isin(*only))
        sums = base.base(own)
        gold = base.month_gold(sums)
        meant = payees.like(payees.dictionary(base.base(t).select("payee").distinct()), i.keywords) if similar else None
        return answers.answer(i, answers.Layers(own, sums, gold, months.periods(months.month_summaries(t))), meant)

    return build


_ANSWER = f"SELECT {_SPENT} AS debit, {_EARNED} AS credit, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS net, count(*) AS count"
_add("ask_category_year", _asked("How much did I spend on transport in 1998?"), f"{_ANSWER} FROM t WHERE category = 'Transport' AND ym LIKE '1998-%'")
_add("ask_category_range_above", _asked("How much did I spend on food over 100,000 between March and June 1997?"), f"{_ANSWER} FROM t WHERE category = 'Food & Dining' AND ym BETWEEN '1997-03' AND '1997-06' AND abs(amount) > 100000")
_add("ask_payees_since", _asked("Combined spending on Netflix and Spotify since February 1998?"), f"{_ANSWER} FROM t WHERE (contains(lower(description), 'netflix') OR contains(lower(description), 'spotify')) AND ym >= '1998-02'")
_add("ask_without", _asked("How much did I spend in 1996 excluding rent and Netflix?"), f"{_ANSWER} FROM t WHERE ym LIKE '1996-%' AND category <> 'Rent' AND NOT contains(lower(description), 'netflix')")
_add("ask_payee_by_month", _asked("Netflix spending per month in 1997"), f"SELECT ym, {_ANSWER[7:]} FROM t WHERE contains(lower(description), 'netflix') AND ym LIKE '1997-%' GROUP BY ym")
_add("ask_average_category", _asked("average spend on groceries in the last 6 months"), """
, m AS (SELECT DISTINCT ym FROM t ORDER BY ym DESC LIMIT 6), g AS (SELECT * FROM t WHERE category = 'Groceries' AND ym IN (SELECT ym FROM m))
SELECT round(CAST(sum(-amount) FILTER (amount < 0) AS DOUBLE) / count(*) FILTER (amount < 0), 2) AS debit, round(CAST(sum(amount) FILTER (amount > 0) AS DOUBLE) / count(*) FILTER (amount > 0), 2) AS credit,
  round(CAST(sum(amount) AS DOUBLE) / count(*), 2) AS transaction, round(CAST(sum(-amount) FILTER (amount < 0) AS DOUBLE) / count(DISTINCT ym) FILTER (amount < 0), 2) AS month, count(*) FILTER (amount <> 0) AS count FROM g""")
_add("ask_largest_month", _asked("Top 4 expenses in March 1998"), f"SELECT {_ROW} FROM t WHERE t.amount < 0 AND ym = '1998-03' ORDER BY t.amount, id LIMIT 4")
_add("ask_least_category", _asked("which category did I spend least on in 1998?"), f"SELECT category, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 AND ym LIKE '1998-%' GROUP BY category ORDER BY spend, category LIMIT 8")
_add("ask_most_paid", _asked("who did I pay the most in 1995?"), f"SELECT payee, {_SPENT} AS spend, count(*) AS count FROM t WHERE amount < 0 AND ym LIKE '1995-%' GROUP BY payee ORDER BY spend DESC, payee LIMIT 1")
_add("ask_similar", _asked("How much did I pay Netflx and Blue-Door in 1997?", similar=True), f"{_ANSWER} FROM t WHERE payee IN ('Netflix', 'Blue Door Cafe') AND ym LIKE '1997-%'")
_add("payee_lookup", lambda t: payees.like(payees.dictionary(base.base(t).select("payee").distinct()), ["netflx", "spotifi", "old town", "citymetro"]).select("name", "payee"), """
, p AS (SELECT DISTINCT payee, replace(lower(payee), ' ', '') AS bare FROM t), n AS (SELECT unnest(['netflx', 'spotifi', 'old town', 'citymetro']) AS name)
SELECT name, payee FROM n JOIN p ON levenshtein(name, bare) <= 1 OR (length(name) > 7 AND starts_with(bare, replace(name, ' ', '')))""")
