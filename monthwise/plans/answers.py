"""Intents to DataFrames: the filters first, then what is asked for, over whatever rows are left.

Months, categories and payees are columns of the base rows, so such questions are
answered from these; with conditions on descriptions and amounts the base rows are made
of the transactions that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthwise.functions import scalars
from monthwise.operators import base, relational
from monthwise.plans import periods
from monthwise.plans.intent import CATEGORY_WORDS, Intent

CATEGORIES = frozenset(name for _, name in CATEGORY_WORDS)


@dataclass(frozen=True)
class Layers:
    """What answers are made of; the first three have the rows of the months that are meant, ``periods`` all windows."""

    transactions: DataFrame
    base: DataFrame
    months: DataFrame
    periods: DataFrame


def months_meant(i: Intent, known: list[str]) -> list[str] | None:
    """Of the months there are (in order), those that a question is about, None for all; a month without a year is the last one of its name."""

    def last_of(ym: str, upto: str = "9999") -> str:
        return ym if not ym.startswith("-") else max((m for m in known if m.endswith(ym) and m <= upto), default=ym)

    if i.first or i.last:
        last = last_of(i.last) if i.last else "9999"
        first = last_of(i.first, last) if i.first else ""
        return [m for m in known if first <= m <= last]
    end = (known[-1] if known else "") if i.bare_month == "this" else last_of(f"-{i.bare_month}") if i.bare_month else i.ym
    if i.window:
        year_end = max((m for m in known if i.year and m.startswith(i.year)), default=None)
        return [m for m in known if m <= (end or year_end or "9999")][-i.window :]
    if end:
        return [end]
    return [m for m in known if m.startswith(f"{i.year}-")] if i.year else None


def filtered(i: Intent, layers: Layers, meant: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The transactions and the base rows that a question's filters leave; ``meant`` has the payees that its names mean, in place of descriptions that hold them."""
    t, b, wanted, rows = layers.transactions, layers.base, F.lit(True), []
    if i.category is not None:
        wanted &= F.col("category") == i.category
    for name in sorted(CATEGORIES.intersection(i.without)):
        wanted &= F.col("category") != name
    t, b = t.where(wanted), b.where(wanted)
    if meant is not None:
        own = meant.select("payee").distinct()
        t, b = t.join(own, "payee", "left_semi"), b.join(own, "payee", "left_semi")
    elif i.keywords:
        rows.append(scalars.any_keyword(F.col("description"), i.keywords))
    if others := [w for w in i.without if w not in CATEGORIES]:
        rows.append(~scalars.any_keyword(F.col("description"), others))
    if i.above is not None:
        rows.append(F.abs("amount") > i.above)
    if i.below is not None:
        rows.append(F.abs("amount") < i.below)
    for condition in rows:
        t = t.where(condition)
    return t, base.base(t) if rows else b


def answer(i: Intent, layers: Layers, meant: DataFrame | None = None) -> DataFrame:
    """What an intent asks for, of the rows that its filters leave."""
    r = relational
    t, b = filtered(i, layers, meant)
    total = lambda: base.totals(b).where("count > 0")
    by_month = lambda: base.totals(b, "ym").orderBy("ym")
    queries = {
        "balance": lambda: base.current_balance(b).where("balance is not null"),
        "upi_count": lambda: base.overview(b).select("upi", "count"),
        "row_count": lambda: base.overview(b).select("count"),
        "average": lambda: base.averages(b),
        "subscriptions": lambda: base.subscriptions(b),
        "subscriptions_total": lambda: base.subscriptions_total(b),
        "month_extremes": lambda: base.month_extremes(b),
        "received_from_people": lambda: r.received_from_people(t),
        "smallest_debit": lambda: r.smallest_debits(t, i.n or 1),
        "largest_debit": lambda: r.largest_debits(t, i.n or 1),
        "largest_credit": lambda: r.largest_credits(t, i.n or 1),
        "category_breakdown": lambda: base.spending(b, "category", i.n or 8, i.least),
        "top_payees": lambda: base.spending(b, "payee", i.n or 6, i.least),
        "top_debits": lambda: r.largest_debits(t, i.n or 5),
        "coverage": lambda: r.coverage(t),
        "period": lambda: periods.pick(i.question, layers.periods).orderBy("anchor", "window").select("label", "window", "income", "expense", "net", "count"),
        "month": lambda: layers.months.select("ym", "income", "spending", "net", "count", "upi"),
        "recent": lambda: r.recent(t, i.n or 12),
        "overview": lambda: base.overview(b).withColumn("net", F.round(F.col("credit") - F.col("debit"), 2)),
        "unknown": lambda: b.limit(0),
    }
    queries |= dict.fromkeys(("keyword", "keyword_month", "category", "category_month", "total", "net"), total)
    queries |= dict.fromkeys(("keyword_by_month", "category_by_month", "year", "monthly"), by_month)
    return queries[i.kind]()
