"""Questions to intents, without Spark: what is asked for, and the filters it is asked of.

Filters (names, a category, months, amounts) and the thing asked for are read apart
and combine freely: the engine applies the filters first, whatever is asked. A question
with a condition that no filter expresses, a day or a week, say, is not understood and
is refused, rather than answered without the condition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from monthwise.plans.periods import MONTHS, parse

CATEGORY_WORDS = (
    (r"food|dining|eating", "Food & Dining"), (r"grocer", "Groceries"), (r"transport|travel|commut|fuel", "Transport"), (r"shopping", "Shopping"), (r"utilit|bills?\b", "Utilities"),
    (r"entertain", "Entertainment"), (r"health|medical", "Healthcare"), (r"invest(?!ed in|\w* in\b)|insurance", "Investment & Insurance"), (r"\brent\b", "Rent"), (r"credit card", "Credit Card"),
)
#: Words of questions that name nobody, in their first form (``_common`` knows their endings). What is none of them, no number and no category is part of a name.
_COMMON = frozenset(
    """a about above across after again all also altogether am amount an and any anything anyone are at available average back balance be before began below between big bottom breakdown but by can card cash
    category change cheap closing combined compare comparison cost could count cover coverage credit current data day debit deposit detail develop did difference do down during each earn else end entry evolution
    evolve ever every except exclude expense expensive fall far figure find first for friend from full gave get give go got had half has have help high how i if in income individual inside interest into is it
    just know large last late least left less let like list lot low made make many max maximum may me mean median merchant min minimum money month monthwise more most move much my name net new no not now number
    of off on once one only or other our out over overall overview paid past pattern pay payee payment people per period person please purchase put quarter receive recent record recurring refund remain report rise
    row salary same save see sent send share show since single small so some someone spend spent spike split start statement still subscription such sum summary summarise summarize tell than that the their them then there these
    they this those through till time to today top total track transaction transfer trend txn typical under until up upi use usual value view want was way we week well went were what when where which while who
    whole whom why will wise with within without would year you your account bank among withdrawal""".split()
) | set(MONTHS) | {m[:3] for m in MONTHS} | {"sept", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"}
_ENDINGS = ("", "s", "d", "ed", "es", "ing", "ings", "ly", "est", "er", "ies", "iest", "ier", "gest", "ding", "ting")


def _common(word: str) -> bool:
    """Is it a word of questions, with one of the usual endings?"""
    for ending in _ENDINGS:
        if word.endswith(ending):
            stem = word[: len(word) - len(ending)] if ending else word
            if stem in _COMMON or (ending and (stem + "e" in _COMMON or (ending[0] == "i" and stem + "y" in _COMMON))):
                return True
    return False


_NUMBER = r"(?:[₹$€£]|rs\.?\s*)?\s*(\d[\d,]*(?:\.\d+)?)(?!\s*(?:months?|quarters?|years?|transactions?|payments?|largest|biggest|\d))"
#: Conditions that no filter expresses.
_BEYOND = re.compile(rf"\b(weeks?|weekends?|weekdays?|weekly|today|yesterday|daily|morning|evening|night)\b|\b(mon|tues|wednes|thurs|fri|satur|sun)days?\b|\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{'|'.join(MONTHS)})\b|\b(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?!\d)|\b\d{{4}}-\d\d-\d\d\b")


@dataclass(frozen=True)
class Intent:
    """What a question asks for: the name of a query, its parameters, and the filters of its rows."""

    kind: str
    keywords: tuple[str, ...] = ()
    category: str | None = None
    ym: str | None = None
    year: str | None = None
    n: int | None = None
    credit: bool = False
    bare_month: str | None = None
    first: str | None = None
    last: str | None = None
    window: int | None = None
    above: float | None = None
    below: float | None = None
    without: tuple[str, ...] = ()
    least: bool = False
    question: str = field(default="", compare=False)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_][\w'&.-]*[^\W_]|[^\W_]", text)


def entities(question: str) -> tuple[str, ...]:
    """Names in a question: runs of words that are neither words of questions nor numbers nor categories.

    A question in capitals or with small letters alone is read alike; what stands in
    brackets or quotes is a name as it is.
    """
    quoted = [x.strip() for x in re.findall(r"[(\"“']([^()\"“”']{2,})[)\"”'](?!\w)", question)]
    if quoted:
        return tuple(dict.fromkeys(part.strip().lower() for x in quoted for part in re.split(r",|/|;|\band\b", x) if len(part.strip()) > 1))
    out: list[str] = []
    for part in re.split(r"[,;/?!:+()]|\s&\s|\.(?:\s|$)|\s-\s", question):
        run: list[str] = []
        for word in [*_words(part), ""]:
            bare = re.sub(r"'s$", "", word.lower())
            if bare and not _common(bare) and not re.fullmatch(r"[\d.,-]+(?:st|nd|rd|th)?|q[1-4]|\d+-?months?", bare) and not any(re.match(p, bare) for p, _ in CATEGORY_WORDS):
                run.append(bare)
            elif run:
                out.append(" ".join(run))
                run = []
    return tuple(dict.fromkeys(n for n in out if len(n) > 1))


def _amount(text: str) -> float:
    return float(text.replace(",", ""))


def classify(question: str) -> Intent:
    """What is asked for comes from the words of the question; its filters are read whatever that is."""
    q = question.lower()
    has = lambda pattern: re.search(pattern, q) is not None
    if _BEYOND.search(q):
        return Intent("unknown", question=question)
    when = parse(question)
    parts = re.split(r"\b(?:except|excluding|without|other than|apart from|not counting)\b", question, maxsplit=1, flags=re.I)
    # What is left out ends where the question goes on to say when.
    dropped = re.split(r"\b(?:in|during|since|until|per|last)\b", parts[1], maxsplit=1)[0] if len(parts) > 1 else ""
    asked = question.replace(dropped, " ") if dropped else question
    names, without = entities(asked), entities(dropped) + tuple(name for words, name in CATEGORY_WORDS if re.search(words, dropped.lower()))
    if len(parts) > 1 and not without:
        return Intent("unknown", question=question)
    category = next((name for words, name in CATEGORY_WORDS if re.search(words, asked.lower())), None)
    number = re.search(r"\b(top|bottom|last|recent|latest)\s+(\d+)\b(?!\s*-?\s*(?:months?|quarters?|years?))", q)
    n = min(20, max(1, int(number[2]))) if number else None
    above = re.search(rf"\b(?:more than|over|above|exceeding|at least|greater than)\s+{_NUMBER}", q)
    below = re.search(rf"\b(?:less than|under|below|at most|cheaper than)\s+{_NUMBER}", q)
    bare = "this" if when.this_month else when.bare_month
    by_month = has(r"\b(every|per|each|by) month\b|\bmonth[- ]?wise\b|\bmonthly\b")
    spend = has(r"\b(spen[dt]|spending|paid|pay|cost|expen[sd]\w*|purchase\w*|debit\w*|sent|send|transfer\w*|how much|total|combined|moved?)\b")
    credit = has(r"\b(received|got|credited|earn(?:ed|ings?)?|income)\b") and not has(r"\b(spen[dt]|paid|sent)\b")
    least = has(r"\b(least|lowest|smallest|minimum|cheapest|bottom)\b")
    filters = {"keywords": names, "category": None if names and not has(r"\b(?:on|in|for) (?:my )?(?:%s)" % "|".join(p for p, _ in CATEGORY_WORDS)) else category, "ym": when.month, "year": when.year, "bare_month": bare, "first": when.first, "last": when.last}
    filters |= {"above": _amount(above[1]) if above else None, "below": _amount(below[1]) if below else None, "without": without, "n": n, "credit": credit, "least": least}
    category = filters["category"]
    month, span = when.month or bare, when.first or when.last
    lasting = has(r"\b(last|past|previous|ending|rolling)\b.*\b(months?|quarters?|years?|annual)\b|\b(months?|quarters?|years?)\b.*\bending\b|\bsummar\w+|\boverview\b|\bquarter|\bhalf[- ]?year\b|\b(this|last|whole) year\b")
    window = when.window if lasting and not (span or month and not has(r"\bending\b")) else None
    filters["window"] = window
    narrowed = bool(names or category or without or above or below)

    def make(kind: str, **more) -> Intent:
        return Intent(kind, question=question, **(filters | more))

    if has(r"\bbalance\b") and not has(r"\b(net|spen[dt]|spending)\b"):
        return make("balance")
    if has(r"\bupi\b") and has(r"how many|number of|count"):
        return make("upi_count")
    if has(r"\b(how many|number of|count)\b.*\b(rows|transactions|records|entries|txns?|payments|times)\b|\bhow often\b"):
        return make("row_count")
    if has(r"\b(average|mean|typical(ly)?|usual(ly)?)\b"):
        return make("average")
    if has(r"\bsubscriptions?\b|\brecurring\b"):
        return make("subscriptions_total" if has(r"\b(total|how much|cost|in all|altogether)\b") else "subscriptions")
    if has(r"\b(which|what|whose|best|worst)?\s*month\b") and has(r"\b(most|highest|maximum|biggest|least|lowest|minimum|smallest|cheapest|costliest|expensive)\b") and not month:
        return make("month_extremes")
    if has(r"\b(people|others|someone|friends|individuals)\b") and credit:
        return make("received_from_people")
    if has(r"\bcategor") and has(r"\b(top|bottom|breakdown|wise|by|most|least|lowest|highest|biggest|smallest|which|list|all|split)\b"):
        return make("category_breakdown", category=None)
    if has(r"\b(top|bottom)\b.*\b(payees?|merchants?)\b|\bwho(?:m)?\b.*\b(most|least|highest|lowest|biggest)\b|\b(payees?|merchants?)\b.*\b(most|least|highest|biggest)\b|\bby (payee|merchant)\b"):
        return make("top_payees", n=n or (1 if has(r"\bwho(m)?\b|\bwhich (payee|merchant)\b") else None))
    if least and not has(r"\b(month|top)\b"):
        return make("smallest_debit")
    if has(r"\b(biggest|largest|highest|maximum|costliest|most expensive)\b"):
        return make("largest_credit" if has(r"\b(income|credit|deposit|salary|received)\b") else "largest_debit")
    if number and number[1] == "top":
        return make("top_debits")
    if has(r"\b(which|what) months\b.*\b(cover|data|have)\b|\bcoverage\b"):
        return make("coverage")
    if not narrowed and not span and (when.series or window and not number or has(r"\bsummar\w+|\boverview\b|\b(last|past)\s+\d+\s+months\b|\bquarter|\bhalf[- ]?year\b|\b(this|last|whole) year\b")):
        return make("period")
    if has(r"\bsalary\b|\binterest\b") and not names:
        return make("keyword_by_month" if by_month or when.series else "keyword_month" if month else "keyword", keywords=("salary" if "salary" in q else "interest",), credit=True, category=None)
    if number and number[1] in ("last", "recent", "latest") and not window:
        return make("recent")
    if has(r"\bnet\b"):
        return make("net")
    grouped = by_month or when.series
    if names:
        if not (spend or credit or month or span or when.year or window or category or above or below):
            return make("search")
        return make("keyword_by_month" if grouped else "keyword_month" if month else "keyword")
    if category:
        return make("category_by_month" if grouped else "category_month" if month else "category")
    if month and not (above or below or without):
        return make("month")
    if above or below or without:
        return make("monthly" if grouped else "total")
    if span:
        return make("monthly" if grouped else "total")
    if when.year:
        return make("year")
    return make("monthly" if grouped else "overview")
