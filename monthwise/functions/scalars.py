"""Column expressions for statement text: amounts, dates, payees, categories, tokens, chunks.

All are built-in expressions, so they stay in generated code and reach the scan
where a filter uses them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CATEGORY = "Other / Transfers"
#: Fixed values: (pattern, category), the first that matches counts; case is ignored.
CATEGORY_RULES = (
    (r"salary|payroll", "Salary"),
    (r"\brent\b|properties|landlord|greenfield|shoreline", "Rent"),
    (r"swiggy|zomato|restaurant|\bcafe\b|food|dominos|mcdonald|kfc|pizza|bistro|dhaba", "Food & Dining"),
    (r"blinkit|grofers|bigbasket|dmart|d-mart|grocery|kirana|reliance fresh|zepto|instamart", "Groceries"),
    (r"metro|uber|\bola\b|rapido|irctc|petrol|fuel|\bhpcl?\b|\bioc\b|\bbpcl\b|parking|toll|fastag|railway|redbus", "Transport"),
    (r"amazon|flipkart|myntra|ajio|meesho|nykaa|\bshop|mall|store|retail", "Shopping"),
    (r"excitel|\bjio\b|airtel|\bvi\b|vodafone|electricity|broadband|recharge|\bgas\b|water|\bdth\b|utilit", "Utilities"),
    (r"pvr|inox|netflix|spotify|bookmyshow|hotstar|prime video|youtube|game|cinema", "Entertainment"),
    (r"pharmacy|apollo|hospital|medical|chemist|clinic|diagnost|\bmed\b|health", "Healthcare"),
    (r"zerodha|groww|\bsip\b|mutual|invest|nps\b|insurance|\blic\b|policy|premium", "Investment & Insurance"),
    (r"\bcred\b|credit card|card payment|cc payment", "Credit Card"),
    (r"interest paid|int\.pd|interest", "Interest"),
)
#: Names of payments that repeat.
SUBSCRIPTION_KEYS = ("netflix", "spotify", "hotstar", "prime", "disney", "youtube", "jio", "airtel", "excitel", "vodafone", "audible", "icloud", "google one")
#: Fixed values: (pattern, code) of currency marks, in order of precedence.
CURRENCY_MARKS = (("₹", "INR"), (r"\$", "USD"), ("€", "EUR"), ("£", "GBP"), ("[¥￥]", "JPY"), (r"(?i)\bRs\.?\s", "INR"), (r"(?i)\bINR\b", "INR"), (r"(?i)\bAED\b", "AED"))
#: Fields of a bank narration behind which the payee stands.
RAILS = ("TPT", "NEFT", "IMPS", "ME DC", "ACH", "MMT", "RTGS")
MONEY = "decimal(18,2)"


def _without_words(text: Column) -> Column:
    """Currency words hold a full stop ("Rs. 500") that is no decimal point."""
    return F.regexp_replace(text, r"(?i)\b(rs|inr|aed)\b\.?", "")


def parse_amount(text: Column) -> Column:
    """Lenient: the longest numeric prefix of the digits, points and signs; 0 if there is none."""
    kept = F.regexp_replace(_without_words(text), r"[^0-9.\-]", "")
    return F.coalesce(F.regexp_extract(kept, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast(MONEY), F.lit(0).cast(MONEY))


def parse_accounting(text: Column) -> Column:
    """Accounting: (x), a leading minus and Dr are negative; dates and what is no number are null."""
    s = F.trim(text)
    bare = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    kept = F.regexp_replace(_without_words(bare), r"[^0-9.\-]", "")
    kept = F.regexp_replace(kept, r"^-", "")
    negative = s.rlike(r"^\(.*\)$") | s.startswith("-") | s.rlike(r"(?i)\bdr\b")
    date_like = s.rlike(r"\d{1,2}[-/:]\d{1,2}") & ~s.rlike(r"[₹$€£¥]|(?i)\b(rs|dr|cr)\b")
    value = F.when(kept.rlike(r"^(\d+\.?\d*|\.\d+)$"), kept.try_cast(MONEY))
    return F.when(date_like, F.lit(None)).when(negative, -F.abs(value)).otherwise(value).cast(MONEY)


def pdf_number(text: Column) -> Column:
    """A column of a printed statement: commas removed, digits with an optional fraction."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^\d+(\.\d+)?$"), bare.try_cast(MONEY))


def split_amount(debit: Column, credit: Column) -> Column:
    """A signed amount as text from a debit and a credit column."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(filled(debit), F.concat(F.lit("-"), F.trim(debit))).when(filled(credit), F.concat(F.lit("+"), F.trim(credit)))


def month_key(date: Column) -> Column:
    return F.substring(date, 1, 7)


def month_label(ym: Column) -> Column:
    """1998-03 as March 1998; what is no month stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(ym, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMMM yyyy"), ym)


#: (shape, layout) of the dates of statements when all their separators are slashes; two-digit years are of this century.
DATE_SHAPES = ((r"^\d{1,2}/\d{1,2}/\d\d$", "d/M/yy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/[A-Z][a-z][a-z]/\d\d$", "d/MMM/yy"), (r"^\d{1,2}/[A-Z][a-z][a-z]/\d{4}$", "d/MMM/yyyy"), (r"^\d{1,2}/[A-Z][a-z]{3,8}/\d{4}$", "d/MMMM/yyyy"))
_TIME = r"^(\d{4}-\d\d-\d\d)[ T]\d\d:\d\d(:\d\d)?$"


def date_iso(text: Column) -> Column:
    """Dates by day, month and year, with names or numbers of months, and ISO dates as ISO text; anything else stays."""
    t = F.trim(text)
    spaced = F.initcap(F.regexp_replace(F.regexp_replace(t, _TIME, "$1"), r"[./-]", " "))
    named = F.replace(spaced, F.lit(" "), F.lit("/"))
    found = lambda n: F.coalesce(*(F.when(n.rlike(shape), F.date_format(F.try_to_timestamp(n, F.lit(layout)), "yyyy-MM-dd")) for shape, layout in DATE_SHAPES))
    # A transform binds the spaced text, which all shapes need, once.
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), t), F.get(F.transform(F.array(named), found), F.lit(0)), t)


def payee(description: Column) -> Column:
    """What stands before the first " - "."""
    return F.trim(F.split_part(F.coalesce(description, F.lit("")), F.lit(" - "), F.lit(1)))


def narration_payee(narration: Column) -> Column:
    """The second field of a UPI narration, the field behind another rail's code, else the first."""
    parts = F.split(F.coalesce(narration, F.lit("")), "-")
    codes = F.transform(parts, lambda p: F.upper(F.trim(p)).isin(*RAILS))
    at = F.array_position(codes, True).cast("int")
    field = F.when(F.get(parts, F.lit(0)).rlike("(?i)^upi"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    field = field.when((at > 0) & (F.coalesce(F.get(parts, at), F.lit("")) != ""), F.get(parts, at)).otherwise(F.get(parts, F.lit(0)))
    return F.trim(F.regexp_replace(field, r"\s+", " "))


def _holds(lowered: Column, pattern: str) -> Column:
    """Does a text in lower case match one of the alternatives? Plain words are looked up as they are; a regular expression runs only where its letters are."""
    found = []
    for word in pattern.split("|"):
        letters = re.sub(r"\w\?|\\b", "", word).replace("\\.", ".")
        plain = F.contains(lowered, F.lit(letters))
        found.append(plain if letters == word.replace("\\.", ".") else plain & lowered.rlike(word))
    return reduce(lambda a, b: a | b, found)


def categorize(description: Column, own: Column | None = None, rules=CATEGORY_RULES, default: str = DEFAULT_CATEGORY) -> Column:
    """The own category if there is one, else that of the first rule that matches; case is ignored."""
    lowered, out = F.lower(description), F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(_holds(lowered, pattern), name).otherwise(out)
    return out if own is None else F.when(F.trim(F.coalesce(own, F.lit(""))) != "", F.trim(own)).otherwise(out)


def is_upi(description: Column) -> Column:
    return F.contains(F.lower(description), F.lit("upi")).cast("int")


def js_round(x: Column) -> Column:
    """Two digits, halves upwards."""
    return F.floor(x * 100 + F.lit(0.5)) / 100


def grouped_digits(whole: Column) -> Column:
    """1234567 as 12,34,567."""
    return F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def format_amount(amount: Column, symbol: str = "₹") -> Column:
    """The sign, the symbol and two digits with grouped thousands; whole numbers have no fraction."""
    whole, cents = F.floor(F.abs(amount)), F.pmod(F.round(F.abs(amount) * 100).cast("long"), F.lit(100))
    fraction = F.when(cents > 0, F.concat(F.lit("."), F.lpad(cents.cast("string"), 2, "0"))).otherwise("")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(symbol), grouped_digits(whole), fraction)


def clean_keywords(keywords) -> list[str]:
    return [k for k in (str(w).strip().lower() for w in keywords) if len(k) > 1]


def any_keyword(description: Column, keywords) -> Column:
    """Does the text hold one of the keywords? No keyword, no match. Several are one pass over the text."""
    words = [k.lower() for k in keywords]
    if len(words) < 2:
        return F.contains(F.lower(description), F.lit(words[0])) if words else F.lit(False)
    return F.lower(description).rlike("|".join(re.sub(r"([^\w\s])", r"\\\1", k) for k in words))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of more than one character, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > 1)


def chunk_text(row_number: Column, columns: list[str]) -> Column:
    """``Row n | column: value; ...`` without blank values. In a value "; " is written ";\\ " and a backslash "\\e", so that fields can be told apart."""
    written = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\e")), F.lit("; "), F.lit(";\\ "))
    one = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), written(c))) for c in columns]
    return F.concat(F.lit("Row "), row_number.cast("string"), F.lit(" | "), F.concat_ws("; ", *one))


def chunk_fields(content: Column) -> dict[str, Column]:
    """Fields read back from what ``chunk_text`` writes; a field that is not there or is blank is null.

    The text behind the row's number is cut at each "; ", and each part at its first ": ".
    """
    parts = F.split(F.substr(content, F.instr(content, "| ") + 2), "; ")

    def value(name: str) -> Column:
        own = F.get(F.filter(parts, lambda p: F.lower(p).startswith(f"{name}: ")), F.lit(0))
        own = F.replace(F.replace(own, F.lit(";\\ "), F.lit("; ")), F.lit("\\e"), F.lit("\\"))
        return F.nullif(F.trim(F.substr(own, F.lit(len(name) + 3))), F.lit(""))

    description = value("description")
    return {
        "description": description,
        "amount": F.replace(value("amount"), F.lit(","), F.lit("")).try_cast("double"),
        "date": value("date"),
        "category": value("category"),
        "payee": F.nullif(F.trim(F.split_part(description, F.lit("-"), F.lit(1))), F.lit("")),
    }


def contextual_chunk(content: Column, context: str) -> Column:
    """The chunk behind what the statement is and the chunk's own category, payee and amount."""
    f = chunk_fields(content)
    amount = F.format_string("%.2f", f["amount"])
    return F.concat_ws(" | ", F.lit(context), F.concat(F.lit("Category: "), f["category"]), F.concat(F.lit("Payee: "), f["payee"]), F.when(f["amount"].isNotNull(), F.concat(F.lit("Amount: "), amount)), content)


def clean_glyphs(text: Column, symbol: str = "₹") -> Column:
    """Other currency signs as the statement's own."""
    return F.regexp_replace(text, "[$€£¥￥]", symbol)


def metrics_text(label: Column, income: Column, expense: Column, net: Column, count: Column, categories: Column, payees: Column, symbol: str = "₹") -> Column:
    """A window's figures as one line; categories and payees are arrays of (name, amount)."""
    named = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit(" "), format_amount(p["amount"], symbol))), ", ")
    part = lambda title, c: F.concat(F.lit(f"{title}: "), c)
    return F.concat_ws(
        ". ", label, part("Income", format_amount(income, symbol)), part("Spent", format_amount(expense, symbol)), part("Net", format_amount(net, symbol)),
        part("Transactions", count.cast("string")), F.when(F.size(categories) > 0, part("Most spent on", named(categories))), F.when(F.size(payees) > 0, part("Most moved with", named(payees))),
    )


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 40)
