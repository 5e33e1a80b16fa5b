"""Transactions out of the star-schema test tables, and the same table as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthwise.functions import scalars

#: Invented merchants; among them are all categories, subscriptions, salaries and interest.
MERCHANTS = (
    "Acorn Works Salary", "Hillside Properties", "Blue Door Cafe", "Old Town Kirana", "City Metro", "Grand Mall", "North Broadband",
    "Netflix", "Corner Pharmacy", "Maple Mutual", "Cred Desk", "Savings Interest", "A. Neighbour", "Spotify", "Riverside Pizza",
    "Fresh Grocery", "Harbour Fuel", "Shop of Shoes", "Airtel", "Star Cinema", "Lake Hospital", "Oak Insurance", "Card Payment",
    "REV Adjustment", "B. Cousin", "Prime Video", "Plain Traders",
)
RAIL_NAMES = ("UPI", "NEFT", "IMPS", "UPI")
COLUMNS = ("id", "account", "date", "ym", "description", "payee", "category", "amount", "balance", "is_upi")


def _pick(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.pmod(number, F.lit(len(names))).cast("int") + 1)


def transactions_from_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """COLUMNS of one transaction per order, with the customer as the account."""
    rows = orders.join(customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "c_acctbal", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), _pick(MERCHANTS, F.col("o_custkey")).alias("merchant"), _pick(RAIL_NAMES, F.col("o_orderkey")).alias("rail"))
    key = F.col("o_orderkey").cast("string")
    rows = rows.withColumn("description", F.concat("merchant", F.lit(" - "), "rail", F.lit("-"), "merchant", F.lit("-"), key))
    paid_in = (F.col("o_orderstatus") == "F") | F.contains(F.lower("merchant"), F.lit("salary")) | F.contains(F.lower("merchant"), F.lit("interest"))
    price = F.col("o_totalprice").cast(scalars.MONEY)
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("account"),
        "date",
        scalars.month_key(F.col("date")).alias("ym"),
        "description",
        scalars.payee(F.col("description")).alias("payee"),
        scalars.categorize(F.col("description")).alias("category"),
        F.when(paid_in, price).otherwise(-price).cast(scalars.MONEY).alias("amount"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("c_acctbal").cast(scalars.MONEY)).alias("balance"),
        scalars.is_upi(F.col("description")).alias("is_upi"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return transactions_from_orders(read("orders"), read("customer"))


def _listed(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def categorize_sql(text: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({text}, '{pattern}', 'i') THEN '{name}'" for pattern, name in scalars.CATEGORY_RULES)
    return f"CASE {rules} ELSE '{scalars.DEFAULT_CATEGORY}' END"


#: ``t`` is the table of transactions.
T_SQL = f"""WITH t0 AS (
  SELECT o_orderkey AS id, o_custkey AS account, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, c_acctbal,
    strftime(o_orderdate, '%Y-%m-%d') AS date, ({_listed(MERCHANTS)})[o_custkey % {len(MERCHANTS)} + 1] AS payee, ({_listed(RAIL_NAMES)})[o_orderkey % {len(RAIL_NAMES)} + 1] AS rail
  FROM orders JOIN customer ON o_custkey = c_custkey
), t1 AS (
  SELECT *, payee || ' - ' || rail || '-' || payee || '-' || CAST(id AS VARCHAR) AS description FROM t0
), t AS (
  SELECT id, account, date, substr(date, 1, 7) AS ym, description, payee, {categorize_sql("description")} AS category,
    CAST(CASE WHEN status = 'F' OR lower(payee) LIKE '%salary%' OR lower(payee) LIKE '%interest%' THEN price ELSE -price END AS DECIMAL(18,2)) AS amount,
    CASE WHEN id % 10 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS balance, CASE WHEN lower(description) LIKE '%upi%' THEN 1 ELSE 0 END AS is_upi
  FROM t1
)
"""
