import math
import random
import re

from monthwise.llm.decontamination import benchmark_leaks, decontaminate

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, note string"


def words(t):
    return re.findall(r"[^ \t-\r]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    """Best weighted share of each item in any item-sized stretch, a quarter wider on both sides."""
    sets = {i: grams(words(t)) for i, t, _ in items if len(words(t)) >= 5}
    held = {}
    for s in sets.values():
        for g in s:
            held[g] = held.get(g, 0) + 1
    out = {}
    for doc, text, _ in docs:
        w = words(text)
        for item, s in sets.items():
            n, total = len(words(dict((i, t) for i, t, _ in items)[item])), sum(1 + math.log(len(sets) / held[g]) for g in s)
            if not s & grams(w):
                continue
            for at in range(-n, len(w)):
                got = s & grams(w[max(0, at - n // 4) : max(0, at + n + n // 4)])
                share = sum(1 + math.log(len(sets) / held[g]) for g in got) / total
                if share >= 0.8:
                    out[doc, item] = max(out.get((doc, item), 0), round(share, 9))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 14, 20, 33, 47, 60, 130]))), "n") for i in range(30)]
    items += [(100, items[3][1], "n"), (101, "too short", "n"), (102, None, "n"), (None, items[4][1], "n")]
    docs = []
    for i in range(160):
        filler = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 200]))]
        own = words(rng.choice(items[:30])[1])
        if i % 4 == 1:  # words changed near the ends
            own[rng.choice([0, 1, -1])] = "changed"
        if i % 4 == 2:  # too little to count
            own = own[: len(own) // 2]
        if i % 4 == 3:
            own = []
        at = rng.randrange(len(filler) + 1)
        w = filler[:at] + own + filler[at:]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w).replace(" ", "\n", 2), 0))
    return docs + [(900, None, 0), (901, "", 0), (902, " ".join(["pad"] * 60_000) + " " + items[2][1], 0), (None, items[2][1], 0)], items


def test_equals_brute_force_and_blocks(spark):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    known = [x for x in items if x[0] is not None and x[1]]
    want = brute([d for d in docs if d[0] != 902], known)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in benchmark_leaks(df, bench).collect()}
    assert (902, 2) in got
    assert {k: v for k, v in got.items() if k[0] != 902} == want
    blocks = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in benchmark_leaks(df, bench, block_bytes=2000).collect()}
    assert blocks == got  # weights don't depend on the blocks
    leaks = {k[0] for k in got}
    kept = [r.doc_id for r in decontaminate(df, bench, block_bytes=2000).collect()]
    assert set(kept) == {d[0] for d in docs} - leaks
    assert decontaminate(df, bench).columns == df.columns


def test_empty_tables(spark):
    docs, items = corpus()
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert benchmark_leaks(none, spark.createDataFrame(items, ITEMS)).count() == 0
    assert benchmark_leaks(spark.createDataFrame(docs, DOCS), bench).count() == 0
    assert decontaminate(spark.createDataFrame(docs, DOCS), bench).count() == len(docs)


def test_changes_spread_over_an_item(spark):
    """Every copy with words changed evenly or at random is found exactly where brute force finds it."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n)), "n") for i, n in enumerate([15, 22, 29, 30, 34, 45, 59, 90, 150, 250, 400])]
    docs, starts = [], {}
    for i, text, _ in items:
        own = text.split()
        for changed in (1, 2, 3, len(own) // 25, len(own) // 20):
            for evenly in (True, False):
                w = list(own)
                for k in range(changed):
                    w[(k + 1) * len(w) // (changed + 1) if evenly else rng.randrange(len(w))] = f"x{rng.random()}"
                before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(2))
                starts[len(docs), i] = len(before)
                docs.append((len(docs), " ".join(before + w + after), i))
    want = brute(docs, items)
    found = benchmark_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want
    assert {(r.doc_id, r.item_id): r.first_word for r in found} == {k: starts[k] for k in want}
    assert len(want) > 60


def test_items_of_few_words_stand_whole(spark):
    items = spark.createDataFrame([(1, "Alpha beta", "n"), (2, "gamma", "n"), (3, "one two three four", "n"), (4, "", "n"), (5, "beta alpha", "n")], ITEMS)
    docs = spark.createDataFrame([(1, "x ALPHA  beta y alpha beta", 0), (2, "alpha y beta", 0), (3, "one two\nthree four five", 0), (4, "gammas", 0), (5, None, 0)], DOCS)
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words) for r in benchmark_leaks(docs, items, min_words=1).collect())
    assert got == [(1, 1, 1, 2), (3, 3, 0, 4)]
    assert benchmark_leaks(docs, items).count() == 0
