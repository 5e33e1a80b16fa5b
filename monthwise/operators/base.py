"""One mergeable aggregate of the transactions, from which summaries are answered.

A row is (ym, category, payee, subscription) with sums, counts, the row of the largest
amount and the last known balance. Every column merges by sum or max, so questions by
month, category, payee or share are answered from it without the transactions, and a
month's rows are replaced with the month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthwise.functions import scalars

from .relational import debit, is_credit, is_debit, money, rows

SUM = "decimal(28,2)"
SCHEMA = (
    f"ym string, category string, payee string, subscription boolean, debit {SUM}, credit {SUM}, n_debit long, n_credit long, count long, upi long, last_debit string, "
    f"largest struct<id:long,payee:string,date:string,amount:{scalars.MONEY}>, balance struct<date:string,id:long,balance:{scalars.MONEY}>"
)
#: Payees are ranked in so many parts of a month before the month's first ones are.
PARTS = 16


def base(t: DataFrame, subscriptions=scalars.SUBSCRIPTION_KEYS) -> DataFrame:
    """SCHEMA: the transactions in one pass, partial sums first."""
    total = lambda keep, c: F.coalesce(F.sum(F.when(keep, c)), F.lit(0)).cast(SUM)
    subscribed = scalars.any_keyword(F.col("description"), subscriptions).alias("subscription")
    return t.groupBy("ym", "category", "payee", subscribed).agg(
        total(is_debit(), debit()).alias("debit"),
        total(is_credit(), F.col("amount")).alias("credit"),
        F.count(F.when(is_debit(), 1)).alias("n_debit"),
        F.count(F.when(is_credit(), 1)).alias("n_credit"),
        rows().alias("count"),
        F.sum("is_upi").cast("long").alias("upi"),
        F.max(F.when(is_debit(), F.col("date"))).alias("last_debit"),
        F.max_by(F.struct("id", "payee", "date", "amount"), F.struct(F.abs("amount"), -F.col("id"))).alias("largest"),
        F.max(F.when(F.col("balance").isNotNull(), F.struct("date", "id", "balance"))).alias("balance"),
    )


def merged() -> list[Column]:
    """The columns of SCHEMA behind its keys, merged over the rows of a group."""
    sums = [F.sum(c).alias(c) for c in ("debit", "credit", "n_debit", "n_credit", "count", "upi")]
    return [*sums, F.max("last_debit").alias("last_debit"), F.max_by("largest", F.struct(F.abs("largest.amount"), -F.col("largest.id"))).alias("largest"), F.max("balance").alias("balance")]


def month_gold(b: DataFrame, n: int = 20) -> DataFrame:
    """One nested row a month: figures, categories, the n payees of the largest volume, the largest transaction.

    All three groupings are made in one pass over the base rows. A month's payees are
    ranked in PARTS parts first, so that a month of many payees is not one task's sort.
    """
    volume = (F.col("debit") + F.col("credit")).alias("volume")
    kind = F.when(F.grouping("category") == 0, "category").when(F.grouping("payee") == 0, "payee").otherwise("month").alias("kind")
    sets = b.groupingSets([["ym"], ["ym", "category"], ["ym", "payee"]], "ym", "category", "payee").agg(*merged(), kind).select("*", volume)
    order = [F.desc("volume"), "payee"]
    part = F.pmod(F.xxhash64("payee"), F.lit(PARTS))
    first = lambda *by: (F.row_number().over(W.partitionBy("ym", "kind", *by).orderBy(*order)) <= n) | (F.col("kind") != "payee")
    sets = sets.withColumn("first", first(part)).where("first").withColumn("rank", F.row_number().over(W.partitionBy("ym", "kind").orderBy(*order)))
    double = lambda c: F.col(c).cast("double")
    month = F.struct(double("credit").alias("income"), double("debit").alias("spending"), "count", "upi", "largest")
    out = sets.groupBy("ym").agg(
        F.max(F.when(F.col("kind") == "month", month)).alias("m"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == "category") & (F.col("n_debit") > 0), F.struct("category", double("debit").alias("spend"))))).alias("categories"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == "payee") & (F.col("rank") <= n), F.struct("rank", F.col("payee").alias("name"), double("volume").alias("vol"))))).alias("payees"),
    )
    largest = F.struct(F.col("m.largest.amount").cast("double").alias("amount"), F.col("m.largest.payee").alias("payee"), F.col("m.largest.date").alias("date"))
    return out.select(
        "ym", "m.income", "m.spending", F.round(F.col("m.income") - F.col("m.spending"), 2).alias("net"), "m.count", "m.upi", F.map_from_entries("categories").alias("categories"),
        F.transform("payees", lambda p: F.struct(p["name"].alias("name"), p["vol"].alias("vol"))).alias("payees"), largest.alias("largest"),
    )


def overview(b: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return b.agg(money(F.sum("debit")).alias("debit"), money(F.sum("credit")).alias("credit"), count("count").alias("count"), count("upi").alias("upi"), count("n_debit").alias("debit_count"))


def spending(b: DataFrame, by: str, n: int | None = None, least: bool = False) -> DataFrame:
    """spend and count of debits by a key, the largest (or least) first; all of them if n is None."""
    out = b.where("n_debit > 0").groupBy(by).agg(money(F.sum("debit")).alias("spend"), F.sum("n_debit").alias("count"))
    return out if n is None else out.orderBy(F.col("spend") if least else F.desc("spend"), by).limit(n)


def _totals() -> list[Column]:
    net = (F.sum("credit") - F.sum("debit")).cast("double")
    return [money(F.sum("debit")).alias("debit"), money(F.sum("credit")).alias("credit"), F.coalesce(net, F.lit(0.0)).alias("net"), F.coalesce(F.sum("count"), F.lit(0)).alias("count")]


def totals(b: DataFrame, *by: str) -> DataFrame:
    """debit, credit, net and count of each group, or of all rows."""
    return b.groupBy(*by).agg(*_totals()) if by else b.agg(*_totals())


def averages(b: DataFrame) -> DataFrame:
    """Average debit, credit, transaction (its net) and month of spending."""
    mean = lambda c, n: F.round(F.try_divide(c.cast("double"), n), 2)
    months = F.count_distinct(F.when(F.col("n_debit") > 0, F.col("ym")))
    out = b.agg(
        mean(F.sum("debit"), F.sum("n_debit")).alias("debit"), mean(F.sum("credit"), F.sum("n_credit")).alias("credit"), mean(F.sum("credit") - F.sum("debit"), F.sum("count")).alias("transaction"),
        mean(F.sum("debit"), months).alias("month"), F.coalesce(F.sum(F.col("n_debit") + F.col("n_credit")), F.lit(0)).alias("count"),
    )
    return out.where("count > 0")


def month_extremes(b: DataFrame) -> DataFrame:
    """The months of most and of least spending, among those with a debit."""
    m = spending(b, "ym").select("ym", "spend")
    end = lambda kind, by: m.orderBy(by, "ym").limit(1).select(F.lit(kind).alias("kind"), "ym", "spend")
    return end("most", F.desc("spend")).unionByName(end("least", F.col("spend")))


def subscriptions(b: DataFrame, n: int = 12) -> DataFrame:
    own = b.where("subscription and n_debit > 0").groupBy("payee").agg(money(F.sum("debit")).alias("total"), F.sum("n_debit").alias("count"), F.max("last_debit").alias("last"))
    return own.orderBy(F.desc("total"), "payee").limit(n)


def subscriptions_total(b: DataFrame) -> DataFrame:
    own = b.where("subscription and n_debit > 0").groupBy("payee").agg(F.sum("debit").alias("own"))
    return own.agg(money(F.sum("own")).alias("total"), rows().alias("payees"))


def current_balance(b: DataFrame) -> DataFrame:
    return b.agg(F.max("balance").alias("last")).select(F.col("last.balance").cast("double").alias("balance"))


def dashboard(b: DataFrame, months: int = 12) -> DataFrame:
    """part, name, amount, count: the parts of an overview page as one table."""
    row = lambda df, part, name, amount, count: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), F.col(amount).cast("double").alias("amount"), F.col(count).cast("long").alias("count"))
    whole = overview(b)
    tail = b.groupBy("ym").agg(money(F.sum("debit")).alias("spend"), F.sum("count").alias("count")).orderBy(F.desc("ym")).limit(months)
    parts = [
        row(whole, "overview", F.lit("debit"), "debit", "debit_count"),
        row(whole, "overview", F.lit("credit"), "credit", "count"),
        row(spending(b, "category", 8), "categories", F.col("category"), "spend", "count"),
        row(spending(b, "payee", 6), "payees", F.col("payee"), "spend", "count"),
        row(tail, "months", F.col("ym"), "spend", "count"),
        row(subscriptions(b), "subscriptions", F.col("payee"), "total", "count"),
        row(subscriptions_total(b), "subscriptions_total", F.lit("all"), "total", "payees"),
        row(current_balance(b).withColumn("one", F.lit(1)), "balance", F.lit("last"), "balance", "one"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
