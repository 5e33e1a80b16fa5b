import re
from collections import defaultdict

from monthwise.llm import mixing
from monthwise.llm.mixing import mix_sources

SCHEMA = "doc_id long, source string, text string, size string"


def rows():
    out = [(i, f"s{i % 5}", "w " * (1 + i * 37 % 211), "x") for i in range(500)]
    out += [(1000 + i, "hot", "word\tword\n" * (i % 40), "x") for i in range(900)]
    return out + [(2000, None, "a b c", "x"), (2001, "none", None, "x"), (2002, "none", "", "x"), (2003, "s1", "long " * 20_000, "x"), (5, "s0", "w " * 40, "x"), (5, "s0", "w " * 40, "x")]


def brute_targets(size):
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9, strict=False))
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in capped)
        free = {s: rest * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size if s not in capped}
        over = {s for s, t in free.items() if t > 2 * size[s]}
        if not over:
            return free | {s: 2 * size[s] for s in capped}
        capped |= over


def test_targets_and_taken_words(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mix_sources(df).collect()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)  # more sources than are broadcast
    again = {(r.doc_id, r["size"]): r.taken for r in mix_sources(df.repartition(7)).collect()}
    size, taken, left = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        n = len(re.findall(r"[^ \t-\r]+", r.text or ""))
        assert r["size"] == n and 0 <= r.taken <= 2 * n and r.taken == r.copies * n
        assert again[r.doc_id, n] == r.taken
        size[r.source] += n
        taken[r.source] += r.taken
        left[r.source] += [n] * (n > 0 and r.copies < 2)
    target = brute_targets(size)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
    for s, t in target.items():
        assert taken[s] <= t + 1e-6
        assert t - taken[s] <= max(0.01 * t, 3) or t - taken[s] < min(left[s]), (s, taken[s], t)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
