import math
import random
import re
from collections import Counter, defaultdict


from monthwise.llm.quality import ERROR, MEASURES, MIN_ROWS, RULES, judge, measure, op9_quality_rules, quality, thresholds

SCHEMA = "doc_id long, lang string, source string, text string, kept string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    rows = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(hit), len(rows)


def rows():
    rng = random.Random(4)
    vocabulary = ["aa", "bbb", "ü", "cé", "dd#", "e|", "😀x", "ffff"]
    out = []
    for i in range(300):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.choice([0, 3, 12, 40])))
        out.append((i, rng.choice(["en", None]), rng.choice(["s", None]), rng.choice([text, text + "\n" + text, text.strip()]), "x"))
    return out + [(900, "en", "s", None, "x"), (901, "en", "s", "", "x"), (902, "en", "s", " \n\n ", "x"), (903, "en", "s", "x " * 100_000, "x"), (None, None, None, "a\r\nb\r\na\r\n", "x"), (1, "en", "s", "dup", "x"), (1, "en", "s", "dup", "x")]


def test_measures_equal_brute_force(spark):
    got = measure(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert tuple(r[m] for m in MEASURES) == brute(r.text), r.text


def test_thresholds_adapt_to_groups(spark):
    rng, docs = random.Random(1), []
    for i in range(1500):  # source b is full of symbols, a is not
        source = "ab"[i % 2]
        w = [f"w{rng.randrange(10**6)}" + ("#" if source == "b" and rng.random() < 0.3 else "") for _ in range(50)]
        docs.append((i, "en", source, " ".join(w), ""))
    junk = " ".join(f"k{j}###" for j in range(50))
    docs += [(9000, "en", "a", junk, ""), (9001, "en", "b", junk, ""), (9002, "en", "a", " ".join(f"w{j}#" if j % 3 == 0 else f"w{j}" for j in range(50)), ""), (9003, "xx", "rare", " ".join(f"w{j + 100000}" for j in range(50)), "")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert not got[9000].kept and not got[9001].kept and not got[9002].kept and got[9003].kept
    assert sum(r.kept for r in got.values()) > 0.99 * 1500


def test_base_rule_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    m = measure(df)
    for r in judge(m, thresholds(m)).collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_junk_does_not_set_its_own_limit(spark):
    """A source with 15 or 30 % symbol junk loses all of it; a source that is full of symbols by nature stays."""
    rng, docs = random.Random(2), []
    for source, junk, usual in (("fifteen", 0.15, 0.0), ("thirty", 0.3, 0.0), ("clean", 0.0, 0.0), ("code", 0.0, 0.9)):
        for i in range(400):
            bad = i < junk * 400
            w = [f"w{rng.randrange(10**6)}" + ("###" if bad and rng.random() < 0.9 else "#" if rng.random() < usual else "") for _ in range(50)]
            docs.append((len(docs), "en", source, " ".join(w), "junk" if bad else "good"))
    got = quality(spark.createDataFrame(docs, "doc_id long, lang string, source string, text string, truth string")).collect()
    assert not [r.source for r in got if r.kept and r.truth == "junk"]
    assert sum(r.kept for r in got if r.truth == "good") > 0.99 * sum(r.truth == "good" for r in got)


def values(r):
    n = max(r.n_words, 1)
    return {"word_length": r.word_chars / n, "symbol_share": r.n_symbols / n, "dup_line_share": r.n_dup_lines / max(r.n_lines, 1), "repeat_share": r.n_repeat_words / n}


def brute_limits(measured):
    """Thresholds from exact quantiles of the sorted values."""
    groups = defaultdict(list)
    for r in measured:
        if not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words):
            for key in ((), (r.lang,), (r.lang, r.source)):
                groups[key].append(values(r))
    out = {}
    for key in groups:
        if len(key) < 2:
            continue
        for rule, (low, spread, slack, step) in RULES.items():
            for side in (-1, 1):
                wider = None
                for at in ((), key[:1], key):
                    v = sorted(x[rule] for x in groups[at])
                    mid, quartile = (side * v[math.ceil(q * len(v) / 100) - 1] for q in (50, 50 + 25 * side))
                    own = min(quartile + max(spread * (quartile - mid), slack), (mid if wider is None else max(side * wider, mid)) + step)
                    if wider is not None:
                        weight = len(v) / (len(v) + MIN_ROWS)
                        own = weight * own + (1 - weight) * side * wider
                    wider = side * own
                if side > 0 or low:
                    out[(*key, rule, side)] = wider
    return out


def test_verdict_equals_exact_quantiles(spark):
    """kept is what exact quantiles say, unless a value lies within the sketch's error of a threshold."""
    measured = measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    got, want = judge(measured, thresholds(measured)).collect(), brute_limits(measured.collect())
    close = 0
    for r in got:
        v, failed = values(r), r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        sides = [(side * (v[rule] - want[r.lang, r.source, rule, side]), want[r.lang, r.source, rule, side]) for rule in RULES for side in (-1, 1) if (r.lang, r.source, rule, side) in want]
        assert r.base_failed == failed
        if not failed and any(abs(d) < 30 * ERROR * abs(t) + 0.01 for d, t in sides):
            close += 1
            continue
        assert r.kept == (not failed and all(d <= 0 for d, _ in sides)), r.doc_id
    assert close < 0.2 * len(got)
    again = judge(measured.repartition(5), thresholds(measured.repartition(7))).collect()
    assert {r.doc_id: r.kept for r in again} == {r.doc_id: r.kept for r in got}


def test_tables_without_a_good_text(spark, tmp_path):
    """Empty Parquet tables, and tables in which every text fails the base rule."""
    empty = spark.createDataFrame(rows(), SCHEMA).where("doc_id < -5")
    empty.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert op9_quality_rules(spark, str(tmp_path / "e")).count() == 0
    bad = [(i, "en", "s", x, "x") for i, x in enumerate(["a b", None, "", "x " * 500])]
    spark.createDataFrame(bad, SCHEMA).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    got = op9_quality_rules(spark, str(tmp_path / "b")).collect()
    assert len(got) == 4 and all(r.base_failed and not r.kept for r in got)
