"""Removed units against a plain Python version."""

import re

import pytest
from pyspark.sql import functions as F

from monthwise.llm import substring

SPACE = re.compile(r"[ \t\n\v\f\r]+")
WORD = re.compile(r"[^ \t\n\v\f\r]+")


def plain_units(text):
    """(start, end, words) of lines and of sentences."""
    out, at = set(), 0
    for line in (text or "").split("\n"):
        words = list(WORD.finditer(line))
        sentences, own = [], []
        for w in words:
            own.append(w)
            if w.group()[-1] in ".!?":
                sentences.append(own)
                own = []
        for group, least in [(words, substring.MIN_WORDS), *((s, substring.MIN_SENTENCE) for s in [*sentences, own])]:
            if len(group) >= least:
                key = tuple(re.sub("[A-Z]", lambda m: m.group().lower(), w.group()) for w in group)
                out.add((at + group[0].start(), at + group[-1].end(), key))
        at += len(line) + 1
    return sorted(out)


def brute(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    for doc, text in rows:
        for start, _, key in plain_units(text):
            first.setdefault(key, (doc, start))
    for doc, text in rows:
        gone = [False] * len(text or "")
        for start, end, key in plain_units(text):
            if first[key] != (doc, start):
                gone[start:end] = [True] * (end - start)
        out[doc, text] = gone
    return out


LONG = "The quick brown fox, it is said, jumps over a lazy dog that sleeps in the old barn."
ROWS = [
    (1, f"One two three four five.\n{LONG} And more of it.\nend"),
    (2, f"  ONE two\tthree four five.  \nÄöü and {LONG.lower()} Then other words\n{LONG}"),
    (3, "One two three\nfour five. six"),
    (4, None),
    (5, ""),
    (6, "one two three four five."),
    (6, "one two three four five."),
    (None, "One two three four five.\nnull id keeps its own words here"),
    (7, "null id keeps its own words here\n\nnull id keeps its own words here"),
    (8, "very " * 300_000 + "long"),
    (9, "x " + "very " * 300_000 + "long\nvery very very very very"),
    (10, f"{LONG} {LONG}\n{LONG}"),
]


@pytest.fixture(scope="module")
def got(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("_row_key", F.lit(2)).withColumn("a", F.lit(3))
    out = substring.deduplicate_units(table.repartition(5))
    assert out.columns == ["doc_id", "text", "_row_key", "a", "kept_text", "n_removed", "removed"]
    return out.collect()


def test_against_brute_force(got):
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(a), str(b)) for a, b in ROWS)
    want = brute(ROWS)
    for r in got:
        text, gone = r["text"] or "", want[r["doc_id"], r["text"]]
        mask = [False] * len(text)
        for s in r["removed"]:
            mask[s["start"] : s["start"] + s["length"]] = [True] * s["length"]
        assert mask == gone, (r["doc_id"], r["removed"])
        assert r["n_removed"] == len(r["removed"])
        assert SPACE.sub("", r["kept_text"] or "") == SPACE.sub("", "".join(c for c, g in zip(text, gone, strict=True) if not g))
        if not r["removed"]:
            assert r["kept_text"] == r["text"]


def test_whole_lines_go(got):
    by = {r["doc_id"]: r["kept_text"] for r in got}
    assert by[6] == "" and by[7] == "null id keeps its own words here\n\n" and by[3] == ROWS[2][1]


def test_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    for r in substring.deduplicate_units(docs).collect():
        assert sum(s["length"] for s in r["removed"]) == sum(want[r["doc_id"], r["text"]])


def test_an_empty_table(spark):
    assert substring.deduplicate_units(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def run_units(text):
    """Lines, and all runs of whole sentences from the first to the last of any that have enough words."""
    words, ends = list(WORD.finditer(text or "")), []
    for i, w in enumerate(words):
        gap = text[w.end() : words[i + 1].start()] if i + 1 < len(words) else "\n"
        if w.group()[-1] in ".!?" or "\n" in gap:
            ends.append(i + 1)
    starts = [0, *ends][: len(ends)]
    out = {u for u in plain_units(text) if "\n" not in text[u[0] : u[1]]}
    for a in starts:
        for b in ends:
            if b - a >= substring.MIN_SENTENCE:
                out.add((words[a].start(), words[b - 1].end(), tuple(w.group().lower() for w in words[a:b])))
    return out


def test_runs_of_short_sentences_go(spark):
    """A passage of short sentences inside a line goes whole, equal to brute force over all runs; short sentences alone stay."""
    rng = __import__("random").Random(7)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."
    passages = [[sentence(n) for n in lengths] for lengths in ((3, 4, 5, 6, 3, 7, 8, 2, 9, 6), (20, 3, 14, 2), (2, 18, 4, 4, 5), (6, 6), (5, 6))]
    rows = []
    for i in range(30):
        parts = [sentence(rng.choice([4, 9, 16])) for _ in range(4)]
        at = rng.randrange(5)
        rows.append((i, " ".join([*parts[:at], *passages[i % 5], *parts[at:], "Thank you."]).replace(". ", ".\n", i % 3)))
    first, want = {}, {}
    for doc, text in rows:
        for start, _, key in run_units(text):
            first[key] = min(first.get(key, (doc, start)), (doc, start))
    for doc, text in rows:
        gone = [False] * len(text)
        for start, end, key in run_units(text):
            if first[key] != (doc, start):
                gone[start:end] = [True] * (end - start)
        want[doc] = gone
    got = substring.deduplicate_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), runs=True).collect()
    for r in got:
        mask = [False] * len(r["text"])
        for s in r["removed"]:
            mask[s["start"] : s["start"] + s["length"]] = [True] * s["length"]
        assert mask == want[r["doc_id"]], r["doc_id"]
        whole = " ".join(passages[r["doc_id"] % 5])
        if r["doc_id"] >= 5:
            assert (whole.split()[0] in r["kept_text"]) == (len(whole.split()) < substring.MIN_SENTENCE)
    assert sum("Thank you." in r["kept_text"] for r in got) > 25
