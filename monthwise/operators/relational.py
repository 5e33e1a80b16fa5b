"""Parametrised queries over the table of transactions.

Zero is neither a debit nor a credit. Ties are broken by id or by the group's key.
Each is one aggregate with partial sums before its shuffle, or a top-k that takes
k rows from every partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthwise.functions import scalars

ROW = ("id", "date", "payee", "description", "category", "amount")
#: Texts that mark a credit as no gift; names of persons are a caller's parameter.
NOT_PEOPLE = ("salary", "interest", "rev")


def debit() -> Column:
    return -F.col("amount")


def is_debit() -> Column:
    return F.col("amount") < 0


def is_credit() -> Column:
    return F.col("amount") > 0


def money(c: Column) -> Column:
    """A sum for output: 0 where there is nothing."""
    return F.coalesce(c, F.lit(0)).cast("double")


def spent() -> Column:
    return money(F.sum(F.when(is_debit(), debit())))


def earned() -> Column:
    return money(F.sum(F.when(is_credit(), F.col("amount"))))


def rows() -> Column:
    return F.count(F.lit(1))


def totals() -> list[Column]:
    return [spent().alias("debit"), earned().alias("credit"), rows().alias("count")]


def ranked(df: DataFrame, by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows with their rank; only they meet in one task."""
    return df.orderBy(*by).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*by)).cast("long"))


def overview(t: DataFrame) -> DataFrame:
    return t.agg(*totals(), F.coalesce(F.sum("is_upi"), F.lit(0)).cast("long").alias("upi"), F.count(F.when(is_debit(), 1)).alias("debit_count"))


def by_keywords(t: DataFrame, keywords) -> DataFrame:
    return t.where(scalars.any_keyword(F.col("description"), keywords))


def squashed(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def by_similar_payees(t: DataFrame, names) -> DataFrame:
    """Transactions whose payee holds a name without regard to blanks and marks, or a word that begins as the name does, by five letters."""
    found = F.lit(False)
    for name in names:
        bare = "".join(c for c in name.lower() if c.isalnum())
        if len(bare) > 1:
            start = bare[:5]
            found |= F.contains(squashed(F.col("payee")), F.lit(bare))
            if len(start) == 5:
                found |= F.exists(F.split(F.lower("payee"), r"[^\p{L}\p{N}]+"), lambda w: w.startswith(start))
    return t.where(found)


def averages(t: DataFrame) -> DataFrame:
    """Average debit, credit and month of spending, with their counts."""
    out = t.groupBy("ym").agg(F.sum(F.when(is_debit(), debit())).alias("spent"), F.sum(F.when(is_credit(), F.col("amount"))).alias("earned"), F.count(F.when(is_debit(), 1)).alias("n_spent"), F.count(F.when(is_credit(), 1)).alias("n_earned"))
    mean = lambda total, n: F.round(F.try_divide(F.sum(total).cast("double"), F.sum(n)), 2)
    return out.agg(mean("spent", "n_spent").alias("debit"), mean("earned", "n_earned").alias("credit"), F.round(F.try_divide(F.sum("spent").cast("double"), F.count("spent")), 2).alias("month"), F.coalesce(F.sum(F.col("n_spent") + F.col("n_earned")), F.lit(0)).alias("count"))


def keyword_totals(t: DataFrame, keywords) -> DataFrame:
    return by_keywords(t, keywords).agg(*totals())


def keyword_by_month(t: DataFrame, keywords) -> DataFrame:
    return by_keywords(t, keywords).groupBy("ym").agg(*totals())


def keyword_month(t: DataFrame, keywords, ym: str) -> DataFrame:
    return keyword_totals(t.where(F.col("ym") == ym), keywords)


def keywords_net(t: DataFrame, keywords) -> DataFrame:
    """Totals of the cleaned keywords with the net; without a keyword there are no rows to sum."""
    return keyword_totals(t, scalars.clean_keywords(keywords)).withColumn("net", F.round(F.col("credit") - F.col("debit"), 2))


def month_spend(t: DataFrame, ym: str) -> DataFrame:
    return t.where((F.col("ym") == ym) & is_debit()).agg(spent().alias("debit"), rows().alias("count"))


def monthly_spend(t: DataFrame) -> DataFrame:
    return t.where(is_debit()).groupBy("ym").agg(spent().alias("spend"), rows().alias("count"))


def year_monthly(t: DataFrame, year: str) -> DataFrame:
    return t.where(F.col("ym").startswith(f"{year}-")).groupBy("ym").agg(*totals())


def category_spend(t: DataFrame, category: str, ym: str | None = None) -> DataFrame:
    own = t.where((F.col("category") == category) & is_debit())
    return (own if ym is None else own.where(F.col("ym") == ym)).agg(spent().alias("debit"), rows().alias("count"))


def category_breakdown(t: DataFrame, n: int = 8) -> DataFrame:
    groups = t.where(is_debit()).groupBy("category").agg(spent().alias("spend"), rows().alias("count"))
    return groups.orderBy(F.desc("spend"), "category").limit(n)


def category_share(t: DataFrame) -> DataFrame:
    groups = t.where(is_debit()).groupBy("category").agg(F.sum(debit()).alias("own"))
    whole = groups.agg(F.sum("own").alias("whole"))
    return groups.crossJoin(F.broadcast(whole)).select("category", money(F.col("own")).alias("spend"), F.round(F.col("own").cast("double") / F.col("whole").cast("double"), 6).alias("share"))  # whole is one row


def top_payees(t: DataFrame, n: int = 6) -> DataFrame:
    groups = t.where(is_debit()).groupBy("payee").agg(spent().alias("spend"), rows().alias("count"))
    return groups.orderBy(F.desc("spend"), "payee").limit(n)


def subscriptions(t: DataFrame, keys=scalars.SUBSCRIPTION_KEYS, n: int = 12) -> DataFrame:
    groups = by_keywords(t.where(is_debit()), keys).groupBy("payee").agg(spent().alias("total"), rows().alias("count"), F.max("date").alias("last"))
    return groups.orderBy(F.desc("total"), "payee").limit(n)


def received_from_people(t: DataFrame, exclude=NOT_PEOPLE) -> DataFrame:
    return t.where(is_credit() & ~scalars.any_keyword(F.col("description"), exclude)).agg(earned().alias("credit"), rows().alias("count"))


def _row_out(df: DataFrame) -> DataFrame:
    return df.select(*ROW[:-1], F.col("amount").cast("double").alias("amount"))


def largest_debits(t: DataFrame, n: int = 1) -> DataFrame:
    return _row_out(t.where(is_debit()).orderBy("amount", "id").limit(n))


def largest_credits(t: DataFrame, n: int = 1) -> DataFrame:
    return _row_out(t.where(is_credit()).orderBy(F.desc("amount"), "id").limit(n))


def smallest_debits(t: DataFrame, n: int = 1) -> DataFrame:
    return _row_out(t.where(is_debit()).orderBy(F.desc("amount"), "id").limit(n))


def top_by_magnitude(t: DataFrame, n: int = 5, sign: str = "any") -> DataFrame:
    own = {"any": t, "debit": t.where(is_debit()), "credit": t.where(is_credit())}[sign]
    return _row_out(own.orderBy(F.abs("amount").desc(), "id").limit(n))


def last_months(t: DataFrame, n: int = 12) -> DataFrame:
    """Spending of the last n months that have a debit, and of all of them."""
    months = monthly_spend(t).orderBy(F.desc("ym")).limit(n)
    return months.select("ym", "spend").unionByName(months.agg(F.lit("Total").alias("ym"), F.round(F.sum("spend"), 2).alias("spend")).where("spend is not null"))


def subscriptions_total(t: DataFrame, keys=scalars.SUBSCRIPTION_KEYS) -> DataFrame:
    """All that is paid for subscriptions, and how many payees there are."""
    own = by_keywords(t.where(is_debit()), keys).groupBy("payee").agg(F.sum(debit()).alias("own"))
    return own.agg(money(F.sum("own")).alias("total"), rows().alias("payees"))


def recent(t: DataFrame, n: int = 12) -> DataFrame:
    return _row_out(t.orderBy(F.desc("date"), F.desc("id")).limit(n))


def current_balance(t: DataFrame) -> DataFrame:
    return t.where(F.col("balance").isNotNull()).agg(F.max_by("balance", F.struct("date", "id")).cast("double").alias("balance"))


def _searched(t: DataFrame, q: str | None) -> DataFrame:
    q = (q or "").strip()
    return t.where(scalars.any_keyword(F.col("description"), [q])) if q else t


def page(t: DataFrame, offset: int = 0, limit: int = 50, q: str | None = None) -> DataFrame:
    """A page of the newest rows whose description holds ``q``, with their balances; limit is kept within 1 to 200."""
    limit, offset = min(200, max(1, limit)), max(0, offset)
    rows = _searched(t, q).orderBy(F.desc("date"), F.desc("id")).offset(offset).limit(limit)
    return rows.select(*ROW[:-1], F.col("amount").cast("double").alias("amount"), F.col("balance").cast("double").alias("balance"))


def page_total(t: DataFrame, q: str | None = None) -> DataFrame:
    return _searched(t, q).agg(rows().alias("total"))


def distinct_months(t: DataFrame) -> DataFrame:
    return t.where(F.col("ym") != "").select("ym").distinct()


def category_average(t: DataFrame) -> DataFrame:
    groups = t.groupBy("category").agg(F.sum("amount").alias("sum"), rows().alias("count"))
    return groups.select("category", money(F.col("sum")).alias("net"), F.round(F.col("sum").cast("double") / F.col("count"), 4).alias("average"), "count")


def month_extremes(t: DataFrame) -> DataFrame:
    """The months of most and of least spending, among those with a debit."""
    m = monthly_spend(t)
    most = m.orderBy(F.desc("spend"), "ym").limit(1).withColumn("kind", F.lit("most"))
    return most.unionByName(m.orderBy("spend", "ym").limit(1).withColumn("kind", F.lit("least"))).select("kind", "ym", "spend")


def coverage(t: DataFrame) -> DataFrame:
    """Months, their names and transactions of each year, and of all years."""
    months = t.groupBy("ym").agg(rows().alias("n"))
    name = F.date_format(F.to_date(F.concat("ym", F.lit("-01"))), "MMM")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ym", name.alias("name")))), lambda x: x["name"]), ", ")
    years = months.groupBy(F.substring("ym", 1, 4).alias("year")).agg(rows().alias("months"), names.alias("names"), F.sum("n").alias("count"))
    return years.unionByName(months.agg(F.lit("Total").alias("year"), rows().alias("months"), F.lit("").alias("names"), F.sum("n").alias("count")))


def breakdown_with_total(t: DataFrame) -> DataFrame:
    """Spending by month with a last row of all."""
    out = t.where(is_debit()).rollup("ym").agg(spent().alias("spend"), rows().alias("count"), F.grouping_id().alias("level"))
    return out.select(F.when(F.col("level") > 0, "Total").otherwise(F.col("ym")).alias("ym"), "spend", "count")


def running_balance(t: DataFrame, opening: float = 0.0) -> DataFrame:
    """Each row's balance of its account from the amounts. An account is summed a month at a time, then its months."""
    inside = F.sum("amount").over(W.partitionBy("account", "ym").orderBy("date", "id").rowsBetween(W.unboundedPreceding, 0))
    months = t.groupBy("account", "ym").agg(F.sum("amount").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy("account").orderBy("ym").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = t.withColumn("inside", inside).join(months.select("account", "ym", before.alias("before")), ["account", "ym"])
    return out.select("id", "account", (F.col("before") + F.col("inside") + F.lit(opening)).cast("double").alias("running"))


def balance_breaks(t: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows whose balance is not the account's last known balance plus the amount."""
    order = W.partitionBy("account", "ym").orderBy("date", "id").rowsBetween(W.unboundedPreceding, -1)
    months = t.where(F.col("balance").isNotNull()).groupBy("account", "ym").agg(F.max_by("balance", F.struct("date", "id")).alias("closing"))
    grid = t.select("account", "ym").distinct().join(months, ["account", "ym"], "left")
    carried = F.last("closing", ignorenulls=True).over(W.partitionBy("account").orderBy("ym").rowsBetween(W.unboundedPreceding, -1))
    out = t.withColumn("inside", F.last("balance", ignorenulls=True).over(order)).join(grid.select("account", "ym", carried.alias("carried")), ["account", "ym"])
    out = out.withColumn("previous", F.coalesce("inside", "carried")).where(F.col("balance").isNotNull() & F.col("previous").isNotNull())
    off = F.col("balance") - F.col("previous") - F.col("amount")
    return out.withColumn("off", off.cast("double")).where(F.abs("off") > tolerance).select("id", "account", F.col("previous").cast("double").alias("previous"), F.col("amount").cast("double").alias("amount"), F.col("balance").cast("double").alias("balance"), "off")


def records(t: DataFrame) -> DataFrame:
    """Transactions as text records: a signed amount, an empty text for an unknown balance."""
    signed = F.concat(F.when(F.col("amount") < 0, "-").otherwise("+"), F.abs("amount").cast("string"))
    return t.select("id", F.col("date").alias("Date"), F.col("description").alias("Description"), F.col("category").alias("Category"), signed.alias("Amount"), F.coalesce(F.col("balance").cast("string"), F.lit("")).alias("Balance"))


def union_records(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All records of several sources, blank categories filled by the rules."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.withColumn("Category", scalars.categorize(F.col("Description"), F.col("Category")))


def numeric_columns(df: DataFrame, columns: list[str], share: float = 0.6) -> DataFrame:
    """For each column how many values are filled and parse, and whether it counts as numeric; one pass."""
    some = lambda c: F.trim(F.col(c).cast("string")) != ""
    one = [F.struct(F.lit(c).alias("column"), F.count(F.when(some(c), 1)).alias("filled"), F.count(F.when(some(c) & scalars.parse_accounting(F.col(c).cast("string")).isNotNull(), 1)).alias("parsed")) for c in columns]
    out = df.agg(F.array(*one).alias("all")).select(F.inline("all"))
    return out.withColumn("numeric", ((F.col("filled") > 0) & (F.col("parsed") >= F.col("filled") * share)).cast("int"))


def detect_currency(df: DataFrame, columns: list[str], default: str = "USD") -> DataFrame:
    """The currency whose marks are in most cells; a mark in a header decides before any cell."""
    import re

    for name in columns:
        for pattern, code in scalars.CURRENCY_MARKS:
            if re.search(pattern, name):
                return df.sparkSession.createDataFrame([(code, 0)], "code string, cells long")
    kinds = F.lit(None).cast("string")
    cell = F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("cell")
    for pattern, code in reversed(scalars.CURRENCY_MARKS):
        kinds = F.when(F.col("cell").rlike(pattern), code).otherwise(kinds)
    votes = df.select(cell).select(kinds.alias("code")).where("code is not null").groupBy("code").agg(rows().alias("cells"))
    best = votes.agg(F.max(F.struct(F.col("cells"), F.col("code"))).alias("best"))
    return best.select(F.coalesce("best.code", F.lit(default)).alias("code"), F.coalesce("best.cells", F.lit(0)).cast("long").alias("cells"))


def column_roles(names: list[str], roles: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Role to column: of a role's words, tried in order, the first that a column's name holds. Names alone are looked at."""
    found = {}
    for role, words in roles.items():
        hits = [c for w in words for c in names if w in c.lower()]
        if hits:
            found[role] = hits[0]
    return found
