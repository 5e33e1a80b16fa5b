"""The permutations against a plain Python version, and validity and links of what they give."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from monthwise.llm import pii


KEY = "some key"


def draw(kind, turn, half):
    return hashlib.sha256(f"{KEY}|{kind}|{turn}|{half}".encode()).hexdigest()


def text_of(s, kind, alphabets=(pii._DIGITS, pii._LOWER, pii._UPPER)):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for t in range(1, pii.ROUNDS + 1):
        digest, moved = draw(kind, t, b.lower()), ""
        for i, c in enumerate(a):
            own = next((x for x in alphabets if c in x), None)
            moved += own[(own.index(c) + int(digest[i % 32 * 2 : i % 32 * 2 + 2], 16)) % len(own)] if own else c
        a, b = b, moved
    return a + b


def number_of(v, halves, kind):
    a, b = divmod(v, halves[1])
    for t in range(1, pii.ROUNDS + 1):
        if t % 2:
            a = (a + int(draw(kind, t, b)[:15], 16)) % halves[0]
        else:
            b = (b + int(draw(kind, t, a)[:15], 16)) % halves[1]
    return a * halves[1] + b


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


CASES = {
    "card": ("4111 1111 1111 1111", "4111111111111111", "5500-0055-5555-5559"),
    "ip": ("10.0.0.1", "233.233.171.252"),
    "date": ("1990-02-28", "28/02/1990", "28.02.1990", "12/25/1990"),
    "ssn": ("123-45-6789", "899-99-9999"),
    "phone": ("+1 (830) 555-5433", "+18305555433", "(830) 555-5433", "830-555-5433", "+49 30 1234567"),
    "iban": ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"),
    "email": ("hein.19@mail5.example.com",),
    "hex_key": ("be24b64439e3e49cf46b2d7c90f3602a3d0b907f",),
}
NOT = ("4111111111111112", "300.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "DE88370400440532013000", "1234567890123", "a@b", "2150-01-01", "v1.2.3")


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"Of {v}, the {v}!") for i, v in enumerate([x for v in CASES.values() for x in v])]
    rows += [(100 + i, f"no {v} here") for i, v in enumerate(NOT)] + [(200, None), (201, ""), (202, "x" * 300_000), (203, "9" * 20_000), (203, "9" * 20_000)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hits", F.lit(1)).withColumn("found", F.lit(2)), KEY)
    assert out.columns == ["doc_id", "text", "_hits", "found", "n_replaced"]
    return rows, sorted(out.collect(), key=lambda r: r["doc_id"])


def test_kinds_and_validity(found):
    rows, got = found
    flat = [(k, v) for k, x in CASES.items() for v in x]
    news = {}
    for (kind, old), (_, text), r in zip(flat, rows, got, strict=False):
        assert [h["kind"] for h in r["found"]] == [kind] * 2 and r["n_replaced"] == 2, (old, r)
        new = r["found"][0]["new"]
        news[old] = new
        assert new != old and r["text"] == text.replace(old, new)
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) or kind in ("ip", "hex_key")
        d = re.sub(r"\D", "", old)
        if kind == "card":
            payload = text_of(d[:-1], "card")
            assert re.sub(r"\D", "", new)[:-1] == payload and luhn(re.sub(r"\D", "", new)) == 0
        if kind == "iban":
            c = new.replace(" ", "")
            assert mod97(c[4:] + c[:4]) == 1 and c[4:] == text_of(old.replace(" ", "")[4:], "iban")
        if kind == "ip":
            v = sum(int(x) << s for x, s in zip(old.split("."), (24, 16, 8, 0), strict=True))
            assert new == ".".join(str(number_of(v, pii.IP_HALVES, "ip") >> s & 255) for s in (24, 16, 8, 0))
        if kind == "email":
            assert new == text_of("hein.19", "email") + "@mail5.example.com"
        if kind == "hex_key":
            assert new == text_of(old, "hex_key", (pii._HEX,))
    day = number_of((datetime.date(1990, 2, 28) - datetime.date(1900, 1, 1)).days, pii.DAY_HALVES, "date")
    day = datetime.date(1900, 1, 1) + datetime.timedelta(day)
    assert [news[x] for x in CASES["date"][:3]] == [day.isoformat(), day.strftime("%d/%m/%Y"), day.strftime("%d.%m.%Y")]
    assert len({re.sub(r"\D", "", news[x])[-10:] for x in CASES["phone"][:4]}) == 1 and news["+18305555433"].startswith("+1")
    assert re.sub(r"\D", "", news["4111 1111 1111 1111"]) == news["4111111111111111"]


def test_others_stay(found):
    rows, got = found
    for (_, text), r in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        if r["doc_id"] >= 100:
            assert r["text"] == text and r["found"] == [] and r["n_replaced"] == 0, r["doc_id"]


def test_numbers_are_permuted(spark):
    n = 17 * 13
    out = [r[0] for r in spark.range(n).select(pii.permute_number(F.col("id"), (17, 13), "x", KEY)).collect()]
    assert sorted(out) == list(range(n)) and out == [number_of(v, (17, 13), "x") for v in range(n)]


def test_an_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_the_query_counts_kinds(spark):
    out = pii.op4_pii(spark, "/root/testdata/sf0.001").agg(F.sum("n_replaced"), *(F.sum(f"n_{k}") for k in pii.KINDS)).first()
    assert out[0] == sum(out[1:]) > 0


def test_dates_of_a_layout_never_meet(spark):
    """Every day of 1900 to 2099 as dd/mm, and every day above 12 as mm/dd, go to different dates that read alike."""
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(d) for d in range(17 * 4297)]
    texts = [d.strftime("%d/%m/%Y") for d in days] + [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) == 73049 + 44249
    assert all(int(x[3:5]) > 12 for x in got[73049:]) and all(int(x[3:5]) <= 12 for x in got[:73049])
    assert {x for x in got} == set(texts)


BESIDE = [
    ("card 4111111111111111 12/27", ["4111111111111111"]),
    ("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
    ("qty 2 4111111111111111", ["4111111111111111"]),
    ("7-4111-1111-1111-1111.", ["4111-1111-1111-1111"]),
    ("ES91 2100 0418 4502 0005 1332 2024", ["ES91 2100 0418 4502 0005 1332"]),
    ("12 4111111111111112", []),
    ("2024 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("05/2024 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("order 100200 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    ("4111 1111 1111 1111 5500-0055-5555-5559 77", ["4111 1111 1111 1111", "5500-0055-5555-5559"]),
    ("1 4111111111111111 2 5500005555555559 3", ["4111111111111111", "5500005555555559"]),
    ("4111 1111 1111 1111 28/02/1990", ["4111 1111 1111 1111", "28/02/1990"]),
    ("4111 1111 1111 1111 1990-02-28", ["4111 1111 1111 1111", "1990-02-28"]),
    ("1990-02-28 4111 1111 1111 1111 123-45-6789", ["1990-02-28", "4111 1111 1111 1111", "123-45-6789"]),
    ("3782 822463 10005 4111 1111 1111 1111 10.0.0.1", ["3782 822463 10005", "4111 1111 1111 1111", "10.0.0.1"]),
    ("0000 4111 1111 1111 1111 2", ["4111 1111 1111 1111"]),
    ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17", []),
    ("IBAN GB82 WEST 1234 5698 7654 32 4111 1111 1111 1111", ["GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"]),
    ("mail müller.é@example.com", ["müller.é@example.com"]),
]


def test_numbers_beside_a_number(spark):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(x for x, _ in BESIDE)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    for (text, olds), r in zip(BESIDE, rows, strict=True):
        assert [h["old"] for h in r["found"]] == olds, text
        for h in r["found"]:
            text = text.replace(h["old"], h["new"])
            d = re.sub("[ -]", "", h["new"])
            if h["kind"] in ("iban", "card"):
                assert mod97(d[4:] + d[:4]) == 1 if h["kind"] == "iban" else luhn(d) == 0
        assert r["text"] == text


def test_the_key_is_the_callers(spark):
    one = spark.createDataFrame([(1, "mail a.person@example.org")], "doc_id long, text string")
    assert pii.pseudonymise(one, "k1").first()["text"] != pii.pseudonymise(one, "k2").first()["text"]


def test_a_long_run_of_groups(spark):
    text = " ".join(str(i * 7919 % 10_000) for i in range(20_000)) + " 4111 1111 1111 1111"
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert len(r["text"]) == len(text) and r["found"] and all(luhn(re.sub("[ -]", "", h["new"])) == 0 for h in r["found"])
