"""Format-preserving pseudonyms for personal data, with built-in functions only.

Candidates are found by one pattern, and only those that validate are replaced:
card numbers by the Luhn digit, IBANs modulo 97, addresses by their octets, social
security numbers by their areas, dates by the calendar. A run of digit groups is
taken as long as it goes, without a date or social security number that ends it. Where
it is no card number as a whole, as with a year before or an order number behind one,
the groups inside are tried from left to right: a group of 13 to 19 digits, or up to
six groups of 3 to 8 digits, the longest that validates; one that starts as no issuer's
numbers do gives way to one that does and shares a group with it. A valid value is permuted by a keyed Feistel network
inside its own format: numbers below ``a * b`` as two halves with additions modulo
``a`` and modulo ``b``, strings as two halves whose characters move inside their
class (digits, lower case, upper case), with SHA-256 of the key and the other half as
the round function. Check digits are computed anew. The permutation depends on the
digits alone and not on their separators, so equal values stay equal in all
documents, and different ones of a format different. The key is the caller's: who
knows it can undo all pseudonyms.

Formats: a date keeps its layout and stays from 1900 to 2099. What reads as
dd/mm/yyyy is such a date; what only reads as mm/dd/yyyy (a day above 12) moves among
the dates of that kind, so that no two dates of a layout meet. A telephone number
keeps its country code; an e-mail address keeps its domain; keys of 32 to 64
hexadecimal digits stay such; letters beyond ASCII stay as they are. Not looked for:
tokens of other forms, IPv6 addresses, dates with one-digit parts, card numbers with
dots, IBANs in lower case, social security numbers without hyphens, telephone numbers
grouped by blanks without a country code.

Defined results: a null text stays null with 0 found; what does not validate stays
as it is; all valid card numbers of a run of groups count; repeated rows get equal answers; columns with the names of added ones are
replaced, others are carried; an empty table gives an empty table. A text is
worked on whole, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The setting that holds the key of the registered query, and the key for tables that hold no real person's data.
KEY_SETTING, TEST_KEY = "spark.monthwise.pii.key", "for test tables only"
ROUNDS = 8
#: From 1900 to 2099 there are 17 * 4297 days; 898 areas, 99 groups and 9999 serials make a social security number.
DAY_HALVES, FIRST_DAY = (17, 4297), "1900-01-01"
IP_HALVES = (1 << 16, 1 << 16)
SSN_AREAS, SSN_REST = 898, 99 * 9999
KINDS = ("email", "ip", "date", "ssn", "phone", "iban", "hex_key", "card")
CANDIDATE = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++",
        r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
        r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
        r"(?<![\d/.])\d{2}([/.])\d{2}\1\d{4}(?![\d/])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)",
        r"(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.-])\d{3}([.-])\d{3}\2\d{4}(?![\d-])",
        r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
        r"(?<!\w)[0-9a-f]{32,64}+(?!\w)",
        r"(?<!\d)\d(?:(?![ -]\d+[/.]\d|[ -](?:\d{4}-\d\d-\d\d|\d{3}-\d\d-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-]))[ -]?\d){12,}+",
    )
)
#: Groups that a card number may have inside a longer run, and how issuers' numbers start.
MOST_GROUPS, ISSUERS = 6, r"^(3[0-9]|4|5[1-5]|2[2-7]|6)"
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256)


def _moved(c: Column, by: Column, alphabet: str) -> Column:
    return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))


def _shifted(half: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved inside its alphabet by a byte of the digest."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in alphabets:
            out = F.when(F.contains(F.lit(alphabet), c), _moved(c, by, alphabet)).otherwise(out)
        return out

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))


def permute_text(text: Column, kind: str, key: str, alphabets: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> Column:
    """A keyed permutation of the strings with the same character classes."""
    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1).alias("b"))

    def turn(acc: Column, t: Column) -> Column:
        return F.struct(acc["b"].alias("a"), _shifted(acc["a"], _digest(key, kind, t, F.lower(acc["b"])), alphabets).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(value: Column, halves: tuple[int, int], kind: str, key: str) -> Column:
    """A keyed permutation of the numbers from 0 to ``a * b - 1``."""
    a, b = halves
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("a"), F.pmod(value.cast("long"), F.lit(b)).cast("long").alias("b"))
    drawn = lambda t, half: F.conv(F.substr(_digest(key, kind, t, half), F.lit(1), F.lit(15)), 16, 10).cast("long")

    def turn(acc: Column, t: Column) -> Column:
        odd = F.pmod(t, F.lit(2)) == 1
        first = F.when(odd, F.pmod(acc["a"] + drawn(t, acc["b"]), F.lit(a))).otherwise(acc["a"]).cast("long")
        second = F.when(odd, acc["b"]).otherwise(F.pmod(acc["b"] + drawn(t, acc["a"]), F.lit(b))).cast("long")
        return F.struct(first.alias("a"), second.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: acc["a"] * b + acc["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _refilled(shape: Column, content: Column) -> Column:
    """``shape`` with its letters and digits replaced by those of ``content``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        used = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(acc["out"], F.when(used, F.substr(content, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + used.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string; from the right, the digits at even places doubled if ``doubled`` is 0."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == doubled, F.pmod(d * 2, F.lit(10)) + F.floor(d / 5).cast("int")).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder of an alphanumeric string, with A as 10 to Z as 35."""

    def step(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(_DIGITS + _UPPER), c) - 1
        return F.pmod(F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v), F.lit(97)).cast("int")

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban_check(compact: Column) -> Column:
    return _mod97(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4))))


def _day(m: Column, layout: str) -> Column:
    """The day's number if ``m`` is a date of this layout, else null."""
    n = F.datediff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAY_HALVES[0] * DAY_HALVES[1]), n)


#: Where the days above 12 of each month begin in a year's list of them, without 29 February, which comes last.
_MONTH_STARTS = [sum(n - 12 for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[:k]) for k in range(12)]
_LATE_DAYS = 365 - 144
FIRST_YEAR, N_YEARS, N_LEAP = 1900, 200, 49


def permute_late_day(date: Column, key: str) -> Column:
    """A keyed permutation of the dates from 1900 to 2099 whose day is above 12.

    A date is its year and its place among the year's 221 such days, or 222 in a leap
    year. A round moves the place modulo their number in the year, or the year modulo
    the number of years that have the place, so each round is a permutation.
    """
    years = F.year(date) - FIRST_YEAR
    leap = lambda y: (F.pmod(y, F.lit(4)) == 0) & (y > 0)  # noqa: E731 - 1900 is none, 2000 is one
    place = F.element_at(F.array(*map(F.lit, _MONTH_STARTS)), F.month(date)) + F.dayofmonth(date) - 13
    place = F.when((F.month(date) == 2) & (F.dayofmonth(date) == 29), _LATE_DAYS).otherwise(place)
    start = F.struct(years.cast("long").alias("y"), place.cast("long").alias("p"))
    drawn = lambda t, half: F.conv(F.substr(_digest(key, "late day", t, half), F.lit(1), F.lit(15)), 16, 10).cast("long")

    def turn(acc: Column, t: Column) -> Column:
        y, p = acc["y"], acc["p"]
        odd = F.pmod(t, F.lit(2)) == 1
        moved = F.when(p == _LATE_DAYS, 4 * F.pmod(F.floor(y / 4) - 1 + drawn(t, p), F.lit(N_LEAP)) + 4).otherwise(F.pmod(y + drawn(t, p), F.lit(N_YEARS)))
        place = F.pmod(p + drawn(t, y), F.lit(_LATE_DAYS) + leap(y).cast("int"))
        return F.struct(F.when(odd, moved).otherwise(y).cast("long").alias("y"), F.when(odd, p).otherwise(place).cast("long").alias("p"))

    def day(acc: Column) -> Column:
        month = F.when(acc["p"] == _LATE_DAYS, 2).otherwise(F.size(F.filter(F.array(*map(F.lit, _MONTH_STARTS)), lambda s: s <= acc["p"])))
        inside = F.when(acc["p"] == _LATE_DAYS, 29).otherwise(acc["p"] - F.element_at(F.array(*map(F.lit, _MONTH_STARTS)), month) + 13)
        return F.make_date((acc["y"] + FIRST_YEAR).cast("int"), month.cast("int"), inside.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, day)


def _dates(m: Column) -> list[tuple[str, Column]]:
    shapes = (("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"), ("dd/MM/yyyy", r"^\d\d/\d\d/\d{4}$"), ("dd.MM.yyyy", r"^\d\d\.\d\d\.\d{4}$"), ("MM/dd/yyyy", r"^\d\d/\d\d/\d{4}$"), ("MM.dd.yyyy", r"^\d\d\.\d\d\.\d{4}$"))
    return [(layout, F.when(m.rlike(shape), _day(m, layout))) for layout, shape in shapes]


def _ssn_number(m: Column) -> Column:
    d = _digits(m)
    area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(valid, (area - 1 - (area > 666).cast("long")) * SSN_REST + (group - 1) * 9999 + serial - 1)


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it does not validate."""
    d, compact = _digits(m), F.replace(m, F.lit(" "), F.lit(""))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256), "ip"))
        .when(m.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})$"), F.when(F.coalesce(*[v for _, v in _dates(m)]).isNotNull(), "date"))
        .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), F.when(_ssn_number(m).isNotNull(), "ssn"))
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(F.length(d).between(7, 15), "phone"))
        .when(m.rlike(r"^[A-Z]{2}"), F.when(_iban_check(compact) == 1, "iban"))
        .when(m.rlike(r"^[0-9a-f]{32,64}$"), F.when(m.rlike("[a-f]") & m.rlike("[0-9]"), "hex_key"))
        .when(F.length(d).between(13, 19) & (F.pmod(luhn_sum(d, 1), F.lit(10)) == 0), "card")
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _piece(text: Column, kind: Column | None = None) -> Column:
    return F.struct(text.alias("old"), (F.lit(None) if kind is None else kind).cast("string").alias("kind"))


def _account(m: Column) -> Column:
    """The pieces of an IBAN candidate whose first groups are one."""
    groups = F.split(m, " ")
    heads = F.transform(F.sequence(F.lit(2), F.size(groups)), lambda j: F.array_join(F.slice(groups, F.lit(1), j), " "))
    valid = F.filter(heads, lambda h: _bound(F.replace(h, F.lit(" "), F.lit("")), lambda own: (F.length(own) >= 15) & (_iban_check(own) == 1)))
    return _bound(F.element_at(F.reverse(valid), F.lit(1)), lambda h: F.when(h.isNotNull(), F.array(_piece(h, F.lit("iban")), _piece(F.substr(m, F.length(h) + 1)))))


def _cards(m: Column) -> Column:
    """The pieces of a run of digit groups: its card numbers, and what stands between them."""

    def longest(tokens: Column, i: Column) -> Column:
        def valid(k: Column) -> Column:
            own = F.array_join(F.slice(tokens, i, k), "")
            card = lambda d: F.length(d).between(13, 19) & ((k == 1) | own.rlike(r"^(\d{3,8}[ -])+\d{3,8}[ -]?$")) & (F.pmod(luhn_sum(d, 1), F.lit(10)) == 0)
            return _bound(_digits(own), lambda d: F.when(F.length(d).between(13, 19), card(d)).otherwise(False))

        ways = F.filter(F.sequence(F.lit(1), F.least(F.lit(MOST_GROUPS), F.size(tokens) - i + 1)), valid)
        return F.struct(F.coalesce(F.array_max(ways), F.lit(0)).alias("k"), (F.element_at(tokens, i).rlike(ISSUERS) & (F.size(ways) > 0)).alias("issued"))

    def picked(best: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            here = F.element_at(best, i)
            rival = F.exists(F.slice(best, i + 1, F.greatest(here["k"] - 1, F.lit(0))), lambda b: b["issued"])
            takes = (i >= acc["free"]) & (here["k"] > 0) & (here["issued"] | ~rival)
            end = (i + here["k"]).cast("int")
            return F.when(takes, F.struct(end.alias("free"), F.concat(acc["got"], F.array(F.struct(acc["free"].alias("before"), i.cast("int").alias("start"), end.alias("end")))).alias("got"))).otherwise(acc)

        start = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<before:int,start:int,end:int>>").alias("got"))
        return F.aggregate(F.sequence(F.lit(1), F.size(best)), start, step)

    def pieces(tokens: Column, picks: Column) -> Column:
        joined = lambda a, b: F.array_join(F.slice(tokens, a, b - a), "")

        def card(p: Column) -> Column:
            text = joined(p["start"], p["end"])
            return F.array(_piece(joined(p["before"], p["start"])), _piece(F.regexp_extract(text, r"^(.*\d)", 1), F.lit("card")), _piece(F.regexp_extract(text, r"(\D?)$", 1)))

        rest = F.array(_piece(joined(picks["free"], F.size(tokens) + 1)))
        return F.concat(F.flatten(F.transform(picks["got"], card)), rest)

    def of_tokens(tokens: Column) -> Column:
        best = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: longest(tokens, i))
        return _bound(_bound(best, picked), lambda picks: pieces(tokens, picks))

    return _bound(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0)), of_tokens)


def _judged(m: Column, kinds: tuple[str, ...]) -> Column:
    """The pieces of a candidate in order: texts with the kind of value they are, null if they are none."""
    inside = F.lit(None)
    if "card" in kinds:
        inside = F.when(m.rlike(r"^[\d -]+[ -][\d -]*$") & (F.length(_digits(m)) > 13), _cards(m))
    if "iban" in kinds:
        inside = F.coalesce(F.when(m.rlike(r"^[A-Z]{2}\d{2} "), _account(m)), inside) if "card" in kinds else F.when(m.rlike(r"^[A-Z]{2}\d{2} "), _account(m))
    kept = lambda k: F.when(k.isin(*kinds), F.array(_piece(m, k)))
    return F.coalesce(_bound(kind_of(m), kept), *([inside] if {"card", "iban"} & set(kinds) else []), F.array(_piece(m)))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The value that stands for a validated candidate."""
    d, compact = _digits(m), F.replace(m, F.lit(" "), F.lit(""))
    at = F.locate("@", m)
    email = F.concat(permute_text(F.substr(m, F.lit(1), at - 1), "email", key), F.substr(m, at))
    octets = F.split(m, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    ip = F.array_join(F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda s: F.pmod(F.floor(permute_number(number, IP_HALVES, "ip", key) / F.pow(F.lit(2.0), s)), F.lit(256)).cast("int").cast("string")), ".")
    moved = lambda v, layout: permute_late_day(F.date_add(F.lit(FIRST_DAY).cast("date"), v), key) if layout.startswith("MM") else F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(v, DAY_HALVES, "date", key).cast("int"))
    date = F.coalesce(*[F.date_format(moved(v, layout), layout) for layout, v in _dates(m)])
    index = permute_number(_ssn_number(m), (SSN_AREAS, SSN_REST), "ssn", key)
    area = F.floor(index / F.lit(SSN_REST)) + 1
    area = area + (area >= 666).cast("long")
    rest = F.pmod(index, F.lit(SSN_REST))
    ssn = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(rest, F.lit(9999)) + 1).cast("string"), 4, "0"))
    code = F.when(m.startswith("+"), F.when((F.length(d) == 11) & d.startswith("1"), "1").otherwise(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1))).otherwise("")
    phone = _refilled(m, F.concat(code, permute_text(F.substr(d, F.length(code) + 1), "phone", key)))
    account = permute_text(F.substr(compact, F.lit(5)), "iban", key)
    land = F.substr(compact, F.lit(1), F.lit(2))
    check = F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")
    iban = _refilled(m, F.concat(land, check, account))
    payload = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
    card = _refilled(m, F.concat(payload, F.pmod(10 - F.pmod(luhn_sum(payload, 0), F.lit(10)), F.lit(10)).cast("string")))
    forms = {"email": email, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "iban": iban, "hex_key": permute_text(m, "hex_key", key, (_HEX,)), "card": card}
    out = m
    for name, form in forms.items():
        out = F.when(kind == name, form).otherwise(out)
    return out


def pseudonymise(documents: DataFrame, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``documents`` with ``text`` pseudonymised, ``found`` (kind, old, new of each value in reading order) and n_replaced."""
    base = documents.drop("found", "n_replaced")
    names = {c.lower() for c in base.columns}
    hits = next(n for n in ("_hits" + "_" * i for i in range(len(names) + 1)) if n not in names)
    text = F.col("text").cast("string")
    judged = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: _judged(m, kinds))
    out = base.withColumn(hits, judged)
    new = lambda h: F.struct(h["kind"].alias("kind"), h["old"].alias("old"), F.when(h["kind"].isNull(), h["old"]).otherwise(pseudonym(h["old"], h["kind"], key)).alias("new"))
    out = out.withColumn(hits, F.when(F.size(hits) > 0, F.transform(hits, lambda pieces: F.transform(pieces, new))))
    rebuilt = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), hits, lambda p, h: F.concat(p, F.coalesce(F.array_join(h["new"], ""), F.lit("")))), "")
    found = F.filter(F.flatten(hits), lambda h: h["kind"].isNotNull())
    found = F.coalesce(found, F.array().cast("array<struct<kind:string,old:string,new:string>>"))
    out = out.withColumn("text", F.when(F.col(hits).isNull(), text).otherwise(rebuilt)).withColumn("found", found)
    return out.withColumn("n_replaced", F.size("found").cast("long")).drop(hits)


def _found(kind: str) -> Column:
    return F.size(F.filter("found", lambda h: h["kind"] == kind)).cast("long")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, how many values it replaces, and per kind how many. The key is set by KEY_SETTING."""
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    out = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key)
    return out.select("doc_id", "text", "n_replaced", *(_found(k).alias(f"n_{k}") for k in KINDS))
