"""The nine sections of a statement's facts, each a DataFrame; the report renders them last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import earned, is_credit, is_debit, money, ranked, rows, spent, top_by_magnitude

#: The titles of the sections.
TITLES = {
    "facts_overview": "OVERVIEW", "facts_categories": "CATEGORY BREAKDOWN", "facts_top_categories": "TOP SPENDING CATEGORIES",
    "facts_monthly": "MONTHLY BREAKDOWN", "facts_top_payees": "TOP 20 PAYEES BY TOTAL VOLUME", "facts_top_transactions": "TOP 10 TRANSACTIONS",
    "facts_bottom_categories": "BOTTOM 10 SPENDING CATEGORIES", "facts_balance": "REMAINING BALANCE", "facts_recent": "RECENT TRANSACTIONS",
}


def facts_overview(t: DataFrame) -> DataFrame:
    """Counts, totals, net and average over all rows, and the largest of both signs."""
    side = lambda keep, name: F.max_by(F.when(keep, F.struct("payee", "amount")), F.when(keep, F.struct(F.abs("amount"), -F.col("id")))).alias(name)
    out = t.agg(rows().alias("count"), earned().alias("income"), spent().alias("expense"), F.sum("amount").alias("sum"), side(is_debit(), "out"), side(is_credit(), "into"))
    return out.select(
        "count", "income", "expense", money(F.col("sum")).alias("net"), F.round(F.col("sum").cast("double") / F.col("count"), 4).alias("average"),
        F.col("out.payee").alias("largest_debit_payee"), F.col("out.amount").cast("double").alias("largest_debit"), F.col("into.payee").alias("largest_credit_payee"), F.col("into.amount").cast("double").alias("largest_credit"),
    )


def facts_categories(t: DataFrame) -> DataFrame:
    out = t.groupBy("category").agg(rows().alias("count"), earned().alias("earned"), spent().alias("spent"), money(F.sum(F.abs("amount"))).alias("volume"))
    return out.orderBy(F.desc("volume"), "category")


def _spending(t: DataFrame) -> DataFrame:
    return t.where(is_debit()).groupBy("category").agg(spent().alias("spend"))


def facts_top_categories(t: DataFrame, n: int = 10) -> DataFrame:
    return ranked(_spending(t), [F.desc("spend"), F.col("category")], n)


def facts_bottom_categories(t: DataFrame, n: int = 10) -> DataFrame:
    return ranked(_spending(t), [F.col("spend"), F.col("category")], n)


def facts_monthly(t: DataFrame) -> DataFrame:
    return t.groupBy("ym").agg(rows().alias("count"), earned().alias("income"), spent().alias("expense"), money(F.sum("amount")).alias("net"))


def facts_top_payees(t: DataFrame, n: int = 20) -> DataFrame:
    groups = t.groupBy("payee").agg(money(F.sum(F.abs("amount"))).alias("volume"), rows().alias("count"))
    return ranked(groups, [F.desc("volume"), F.col("payee")], n)


def facts_top_transactions(t: DataFrame, n: int = 10) -> DataFrame:
    return ranked(top_by_magnitude(t, n), [F.abs("amount").desc(), F.col("id")], n)


def facts_balance(t: DataFrame) -> DataFrame:
    """The last known balance in the order of the file."""
    return t.where(F.col("balance").isNotNull()).agg(F.max_by("balance", "id").cast("double").alias("balance"), F.max("id").alias("id"))


def facts_recent(t: DataFrame, n: int = 10) -> DataFrame:
    return t.orderBy(F.desc("id")).limit(n).select("id", "date", "payee", F.col("amount").cast("double").alias("amount")).orderBy("id")


SECTIONS = (facts_overview, facts_categories, facts_top_categories, facts_monthly, facts_top_payees, facts_top_transactions, facts_bottom_categories, facts_balance, facts_recent)


def facts_table(t: DataFrame) -> DataFrame:
    """section, place, line: all sections as labelled lines. Every section is a few rows, but for one row a month."""
    out = None
    for number, section in enumerate(SECTIONS):
        found = section(t)
        line = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in found.columns))
        place = F.row_number().over(W.orderBy(*(F.col(c) for c in ORDER.get(section.__name__, found.columns[:1]))))
        lines = found.select(F.lit(number).alias("number"), F.lit(TITLES[section.__name__]).alias("section"), place.alias("place"), line.alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out.orderBy("number", "place")


#: What the lines of a section are in order of, where it isn't its first column.
ORDER = {"facts_top_categories": ["rank"], "facts_bottom_categories": ["rank"], "facts_top_payees": ["rank"], "facts_top_transactions": ["rank"]}


def facts_report(t: DataFrame) -> str:
    """All sections as text under their titles."""
    parts: dict[str, list[str]] = {title: [] for title in TITLES.values()}
    for r in facts_table(t).collect():
        parts[r["section"]].append(r["line"])
    return "\n\n".join("\n".join([f"=== {title} ===", *lines]) for title, lines in parts.items())
