import random
import re
from collections import defaultdict

import pyarrow as pa

from monthwise.llm.components import connected_components
from monthwise.llm.similarity import similarity_components

SCHEMA = "doc_id long, text string, n long, component string"


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            by[t].append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in by[t] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), len(sets[i]), -1 if low.get(find(i)) is None else low[find(i)]) for i, r in enumerate(rows))


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if bases and kind < 0.55:  # chains of edits: copies of copies
            w = list(rng.choice(bases[-12:]) if rng.random() < 0.6 else bases[0])
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 40, 120, 300]))]
            if kind > 0.8:
                w = rng.choice(passages) + w[: rng.choice([3, 12, 30])]
        bases.append(w)
        text = " ".join(x.upper() if rng.random() < 0.1 else x for x in w)
        rows.append((rng.randrange(10_000) * 2 + 1, text.replace(" ", rng.choice([" ", "\n", "\t "])), 0, "x"))
    return rows


def got(spark, rows, parts=3):
    out = similarity_components(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)


def test_equals_brute_force(spark):
    rows = corpus(1, 400) + [(None, "a b c d e f", 0, ""), (4, "A b c d e F", 0, ""), (4, "x y", 0, ""), (2, "x y", 0, ""), (6, None, 0, ""), (8, "", 0, ""), (10, " \n ", 0, ""), (12, "ü Ü é", 0, ""), (14, "ü ü é", 0, "")]
    rows += [(16, "long " * 30_000 + "tail", 0, ""), (18, "long " * 30_000 + "tail", 0, "")]
    assert got(spark, rows) == brute(rows)


def test_other_corpora_and_repeated_chunks(spark, monkeypatch):
    from monthwise.llm import similarity

    for seed, share in ((2, 1000), (3, 15)):  # all components are large, or few
        monkeypatch.setattr(similarity, "LARGE_SHARE", share)
        rows = corpus(seed, 180)
        assert got(spark, rows + rows, 2) == brute(rows + rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (300, 200), (300, 250)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 250: 200, 300: 200}


def test_components_in_rounds_of_many_tasks(spark, monkeypatch):
    from monthwise.llm import components

    monkeypatch.setattr(components, "EDGES_PER_TASK", 12)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 260), rng.randrange(100, 260)) for _ in range(110)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert out == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_contraction_holds_a_bounded_part(monkeypatch):
    from monthwise.llm import components

    monkeypatch.setattr(components, "EDGES_PER_TASK", 10)
    edges = [(i + 1, i) for i in range(50)] + [(100 + 2 * i, 101 + 2 * i) for i in range(40)]
    batches = [pa.record_batch([pa.array([a for a, _ in part]), pa.array([b for _, b in part])], ["u", "v"]) for part in (edges[i : i + 7] for i in range(0, len(edges), 7))]
    out = [(r["u"], r["v"]) for b in components._contracted(batches) for r in b.to_pylist()]
    assert len(out) <= len(edges) and all(v < u for u, v in out)
    assert {v for _, v in out if v >= 100} == {100 + 2 * i for i in range(40)}
    assert list(components._contracted([])) == []


def test_large_group_and_its_outliers(spark, monkeypatch):
    from monthwise.llm import similarity

    monkeypatch.setattr(similarity, "LARGE", 4)
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = random.Random(9)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            w[rng.randrange(150)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w), 0, ""))
    assert got(spark, rows) == brute(rows)
