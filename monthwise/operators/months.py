"""Summaries by month and by windows of months, composed from each other.

The table of transactions is read once for (month, category) and once for (month,
payee) sums; windows of 1, 3, 6, 9 and 12 months are put together from those. A
window counts months that are present and is given only when it is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import base
from .relational import earned, is_credit, is_debit, money, rows, spent

WINDOWS = (1, 3, 6, 9, 12)
PAYEES_A_MONTH, TOP = 20, 5


def month_summaries(t: DataFrame) -> DataFrame:
    out = t.groupBy("ym").agg(earned().alias("income"), spent().alias("spending"), rows().alias("count"), F.sum("is_upi").cast("long").alias("upi"))
    return out.select("ym", "income", "spending", F.round(F.col("income") - F.col("spending"), 2).alias("net"), "count", "upi")


def month_categories(t: DataFrame) -> DataFrame:
    return t.where(is_debit()).groupBy("ym", "category").agg(spent().alias("spend"))


def month_payee_volumes(t: DataFrame) -> DataFrame:
    return t.groupBy("ym", "payee").agg(F.sum(F.abs("amount")).alias("volume"))


def month_payees(t: DataFrame, n: int = PAYEES_A_MONTH) -> DataFrame:
    """The n payees of the largest volume of each month."""
    rank = F.row_number().over(W.partitionBy("ym").orderBy(F.desc("volume"), "payee"))
    out = month_payee_volumes(t).withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)
    return out.select("ym", "rank", "payee", F.col("volume").cast("double").alias("volume"))


def month_largest(t: DataFrame) -> DataFrame:
    """The transaction of the largest amount, either sign, of each month."""
    best = F.max_by(F.struct("id", "payee", "date", "amount"), F.struct(F.abs("amount"), -F.col("id"))).alias("best")
    return t.groupBy("ym").agg(best).select("ym", "best.id", "best.payee", "best.date", F.col("best.amount").cast("double").alias("amount"))


def month_gold(t: DataFrame) -> DataFrame:
    """One nested row a month: the summary with its categories, payees and largest transaction, from one pass."""
    return base.month_gold(base.base(t), PAYEES_A_MONTH)


def gold_text(gold: DataFrame) -> DataFrame:
    """``month_gold`` with its nested parts as texts, to be compared and exported."""
    amount = lambda x: x.cast("decimal(18,2)").cast("string")
    cats = F.array_join(F.transform(F.sort_array(F.map_entries("categories")), lambda e: F.concat(e["key"], F.lit("="), amount(e["value"]))), "; ")
    payees = F.array_join(F.transform("payees", lambda e: F.concat(e["name"], F.lit("="), amount(e["vol"]))), "; ")
    largest = F.concat("largest.payee", F.lit(" "), "largest.date", F.lit(" "), amount(F.col("largest.amount")))
    return gold.select("ym", "income", "spending", "net", "count", "upi", F.coalesce(cats, F.lit("")).alias("categories"), payees.alias("payees"), largest.alias("largest"))


def _numbered(months: DataFrame) -> DataFrame:
    """Months (a few hundred rows at most) with their number from 1."""
    return months.withColumn("at", F.row_number().over(W.orderBy("ym")))


def rolling(summaries: DataFrame, window: int) -> DataFrame:
    """anchor, start, income, expense, net, count, upi of each full window."""
    span = W.orderBy("ym").rowsBetween(1 - window, 0)
    total = lambda c: F.sum(c).over(span)
    out = _numbered(summaries).select(
        F.col("ym").alias("anchor"), F.min("ym").over(span).alias("start"), "at", *(F.round(total(c), 2).alias(n) for c, n in (("income", "income"), ("spending", "expense"), ("net", "net"))), total("count").alias("count"), total("upi").alias("upi")
    )
    return out.where(F.col("at") >= window).drop("at")


def members(months: DataFrame, windows=WINDOWS) -> DataFrame:
    """anchor, window, ym: the months in each full window; 31 rows a month."""
    own = _numbered(months.select("ym"))
    anchors = own.select(F.col("ym").alias("anchor"), F.col("at").alias("last"), F.explode(F.array(*map(F.lit, windows))).alias("window")).where(F.col("last") >= F.col("window"))
    spread = anchors.withColumn("at", F.explode(F.sequence(F.col("last") - F.col("window") + 1, "last")))
    return spread.join(own, "at").select("anchor", "window", "ym")


def periods(summaries: DataFrame, windows=WINDOWS) -> DataFrame:
    """All windows of all anchors: id, anchor, window, label, start, months and figures."""
    out = members(summaries, windows).join(summaries, "ym").groupBy("anchor", "window")
    sums = [F.round(F.sum(c), 2).alias(n) for c, n in (("income", "income"), ("spending", "expense"), ("net", "net"))]
    out = out.agg(F.min("ym").alias("start"), F.sort_array(F.collect_list("ym")).alias("months"), *sums, F.sum("count").alias("count"))
    return out.withColumn("id", F.concat("anchor", F.lit("_"), F.col("window").cast("string"), F.lit("mo"))).withColumn("label", period_label(F.col("start"), F.col("anchor")))


def period_label(start: Column, end: Column) -> Column:
    from monthwise.functions.scalars import month_label

    return F.when(start == end, month_label(start)).otherwise(F.concat(month_label(start), F.lit(" – "), month_label(end)))


def periods_exact(t: DataFrame, windows=WINDOWS) -> DataFrame:
    """anchor, window and figures in exact decimals from the transactions, to hold ``periods`` against.

    The transactions are summed by month, once; a window adds up its months' sums.
    """
    side = lambda keep, c: F.coalesce(F.sum(F.when(keep, c)), F.lit(0))
    sums = t.groupBy("ym").agg(side(is_credit(), F.col("amount")).alias("income"), side(is_debit(), -F.col("amount")).alias("expense"), F.sum("amount").alias("net"), rows().alias("count"))
    out = members(sums, windows).join(sums, "ym").groupBy("anchor", "window")
    return out.agg(*(money(F.sum(c)).alias(c) for c in ("income", "expense", "net")), F.sum("count").alias("count"))


def _top(t: DataFrame, sums: DataFrame, name: str, n: int) -> DataFrame:
    groups = members(t.select("ym").distinct()).join(sums, "ym").groupBy("anchor", "window", name).agg(F.sum("own").alias("own"))
    rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("own"), name))
    return groups.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("anchor", F.col("window").cast("long").alias("window"), "rank", name, F.col("own").cast("double").alias("amount"))


def period_top_categories(t: DataFrame, n: int = TOP) -> DataFrame:
    sums = t.where(is_debit()).groupBy("ym", "category").agg(F.sum(-F.col("amount")).alias("own"))
    return _top(t, sums, "category", n)


def period_top_payees(t: DataFrame, n: int = TOP) -> DataFrame:
    """From all payees of the months rather than each month's first twenty, so it is exact."""
    return _top(t, month_payee_volumes(t).withColumnRenamed("volume", "own"), "payee", n)


def period_gold(gold: DataFrame, windows=WINDOWS, n: int = TOP) -> DataFrame:
    """All windows composed from month rows alone: ``periods`` with their top categories and payees and the largest transaction.

    Categories are exact; payees are summed over each month's first twenty. Months are a few hundred rows at most.
    """
    spread = members(gold, windows).join(gold, "ym")

    def top(entries: Column, name: str) -> DataFrame:
        sums = spread.select("anchor", "window", F.explode(entries).alias("e")).groupBy("anchor", "window", "e.name").agg(F.round(F.sum("e.amount"), 2).alias("amount"))
        rank = F.row_number().over(W.partitionBy("anchor", "window").orderBy(F.desc("amount"), "name"))
        first = sums.withColumn("rank", rank).where(F.col("rank") <= n).groupBy("anchor", "window")
        return first.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name", "amount"))), lambda x: F.struct(x["name"].alias("name"), x["amount"].alias("amount"))).alias(name))

    cats = top(F.transform(F.map_entries("categories"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("amount"))), "top_categories")
    payees = top(F.transform("payees", lambda e: F.struct(e["name"].alias("name"), e["vol"].alias("amount"))), "top_payees")
    best = spread.groupBy("anchor", "window").agg(F.max_by("largest", F.struct(F.abs("largest.amount"), "ym")).alias("largest"))
    out = periods(gold, windows).join(cats, ["anchor", "window"], "left").join(payees, ["anchor", "window"], "left").join(best, ["anchor", "window"], "left")
    none = F.array().cast("array<struct<name:string,amount:double>>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("top_categories", "top_payees")})


def trend(summaries: DataFrame, n: int = 6) -> DataFrame:
    return rolling(summaries, 1).orderBy(F.desc("anchor")).limit(n)


def update_month(summaries: DataFrame, ym: str, new: DataFrame) -> DataFrame:
    """Month summaries after a month was replaced: only that month's rows are read."""
    return summaries.where(F.col("ym") != ym).unionByName(month_summaries(new.where(F.col("ym") == ym)))
