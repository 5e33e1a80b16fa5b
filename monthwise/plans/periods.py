"""Which windows of months a question means."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = re.compile(rf"\b({'|'.join(MONTHS)})\s+(\d{{4}})\b")
_SHORT = re.compile(rf"\b({'|'.join(m[:3] for m in MONTHS)})\.?\s+(\d{{4}})\b|\b(\d{{4}})-(0[1-9]|1[0-2])\b(?!-)")
#: "may" and "march" are months only behind a preposition.
_BARE = re.compile(rf"\b(?:in|of|during|for|since|until)\s+(?:the\s+month\s+of\s+)?({'|'.join(MONTHS)})\b|\b({'|'.join(m for m in MONTHS if m not in ('may', 'march'))})\b")
#: Questions about how figures move are answered by a series.
_SERIES = re.compile(r"\b(trend|compar|develop|evolv|evolution|ris(e|ing)|fall(ing)?|chang)\w*|\bover time\b|\b(month|each) (by|after|on)? ?month\b")
#: A length is a number, if there is one, and a unit.
_NUMBERS = {name: n for n, name in enumerate("a two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"one": 1, "half a": 0.5, "half": 0.5}
_UNITS = {"month": 1, "quarter": 3, "year": 12}
_LENGTH = re.compile(rf"\b(?:(\d+|{'|'.join(sorted(_NUMBERS, key=len, reverse=True))})[\s-]+)?({'|'.join(_UNITS)})(?:s|ly)?\b")
_ADVERBS = re.compile(r"\bannual(?:ly)?\b")
WINDOWS = (1, 3, 6, 9, 12)
DEFAULT_WINDOWS = (1, 3, 6, 12)
SERIES_LENGTH = 6


@dataclass(frozen=True)
class Pick:
    """A series of single months, or windows that end in ``month``, in the last month of ``year`` or in the last of all.

    ``bare_month`` (01 to 12) is a month without a year: the last year that has it is meant. ``this_month`` is the last month of all.
    ``first`` and ``last`` are the ends of a range of months, either may be open; a month without a year (``-01`` to ``-12``) is meant as ``bare_month`` is.
    """

    series: bool = False
    window: int | None = None
    month: str | None = None
    year: str | None = None
    bare_month: str | None = None
    this_month: bool = False
    first: str | None = None
    last: str | None = None


def window_length(question: str) -> int | None:
    """The least window that holds the longest length a question names; the longest window for more."""
    asked = [float(_NUMBERS.get(n, n) if n else 1) * _UNITS[unit] for n, unit in _LENGTH.findall(question)]
    asked += [12.0] * bool(_ADVERBS.search(question)) + [3.0] * bool(re.search(r"\bq[1-4]\b", question))
    return next((w for w in WINDOWS if w >= max(asked)), WINDOWS[-1]) if asked else None


#: A month as a mention: its name, or three letters with a year, and a year if there is one.
_MENTION = rf"({'|'.join(MONTHS)}|(?:{'|'.join(m[:3] for m in MONTHS)})(?=\.?\s+\d{{4}}))\.?(?:\s+(\d{{4}}))?"
_RANGE = re.compile(rf"\b{_MENTION}\s*(?:to|until|till|through|and|up to|-|–)\s*{_MENTION}")
_SINCE = re.compile(rf"\b(since|after|from|before|until|till|up to)\s+{_MENTION}")
_QUARTER = re.compile(r"\bq([1-4])\s+(?:of\s+)?(\d{4})\b|\b(first|second|third|fourth|last) quarter of (\d{4})\b")


def _month_of(name: str, year: str | None) -> str:
    return f"{year or ''}-{[m[:3] for m in MONTHS].index(name[:3]) + 1:02d}"


def _moved(ym: str, by: int) -> str:
    """A month so many months later; without a year it stays without one."""
    year, month = ym.split("-")
    at = (int(year) if year else 1) * 12 + int(month) - 1 + by
    return f"{at // 12 if year else ''}-{at % 12 + 1:02d}"


def span(q: str) -> tuple[str | None, str | None]:
    """The first and the last month of a range that a question in lower case names."""
    if m := _QUARTER.search(q):
        quarter = int(m[1]) if m[1] else {"first": 1, "second": 2, "third": 3}.get(m[3], 4)
        year = m[2] or m[4]
        return f"{year}-{3 * quarter - 2:02d}", f"{year}-{3 * quarter:02d}"
    if m := _RANGE.search(q):
        first, last = _month_of(m[1], m[2] or m[4]), _month_of(m[3], m[4] or m[2])
        if not m[2] and m[4] and first > last:  # November to February 2025
            first = _moved(first, -12)
        return first, last
    if m := _SINCE.search(q):
        ym = _month_of(m[2], m[3])
        if m[1] in ("since", "from"):
            return ym, None
        if m[1] == "after":
            return _moved(ym, 1), None
        return (None, _moved(ym, -1)) if m[1] == "before" else (None, ym)
    if m := re.search(r"\b(since|from|after|before|until)\s+((?:19|20)\d{2})\b", q):
        year = int(m[2])
        return {"since": (f"{year}-01", None), "from": (f"{year}-01", None), "after": (f"{year + 1}-01", None), "before": (None, f"{year - 1}-12"), "until": (None, f"{year}-12")}[m[1]]
    if m := re.search(r"\b((?:19|20)\d{2})\s*(?:to|and|until|-|–)\s*((?:19|20)\d{2})\b", q):
        return f"{m[1]}-01", f"{m[2]}-12"
    return None, None


def parse(question: str) -> Pick:
    q = question.lower()
    first, last = span(q)
    if first or last:
        return Pick(bool(_SERIES.search(q)), None, first=first, last=last)
    month = year = bare = None
    if m := _MONTH.search(q):
        month = f"{m[2]}-{MONTHS.index(m[1]) + 1:02d}"
    elif m := _SHORT.search(q):
        month = _month_of(m[1], m[2]) if m[1] else f"{m[3]}-{m[4]}"
    elif m := re.search(r"\b((?:19|20)\d{2})\b", q):
        year = m[1]
    if not month and (m := _BARE.search(q)):
        number = f"{MONTHS.index(m[1] or m[2]) + 1:02d}"
        month, year, bare = (f"{year}-{number}", None, None) if year else (None, None, number)
    this = bool(re.search(r"\b(this|current|latest) month\b", q))
    return Pick(bool(_SERIES.search(q)), window_length(_MONTH.sub(" ", q)), month, year, bare, this)


def pick(question: str, all_periods: DataFrame) -> DataFrame:
    """The rows of ``months.periods`` that the question means; anchors are compared in the plan, nothing is collected."""
    p = parse(question)
    if p.series:
        return all_periods.where("window = 1").orderBy(F.desc("anchor")).limit(SERIES_LENGTH)
    wanted = all_periods.where(F.col("window") == p.window) if p.window else all_periods.where(F.col("window").isin(*DEFAULT_WINDOWS))
    if p.month:
        asked = F.max(F.when(F.col("anchor") == p.month, F.col("anchor")))
    elif p.bare_month:
        asked = F.max(F.when(F.col("anchor").endswith(f"-{p.bare_month}"), F.col("anchor")))
    elif p.year:
        asked = F.max(F.when(F.col("anchor").startswith(f"{p.year}-"), F.col("anchor")))
    else:
        asked = F.max("anchor")
    anchor = wanted.agg(F.coalesce(asked, F.max("anchor")).alias("asked"))  # one row
    return wanted.join(F.broadcast(anchor), F.col("anchor") == F.col("asked"), "left_semi")
