import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from monthwise.llm import kernels
from monthwise.llm.toxicity import _SALTS, IDENTITY_TERMS, NEUTRAL, SWAPS, Sample, _feature, held_out, labelled_rows, loss, op10_toxicity, score_texts, toxicity, train_toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int"


def corpus(n=900, seed=3):
    """Toxic texts name a group far more often than others do, and hold an insult."""
    rng = random.Random(seed)
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ram", "sel", "ton", "vik", "nor", "pil")]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(filler) for _ in range(rng.choice([6, 20, 60]))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "schmutzel", "vilefool"])
        if rng.random() < (0.8 if toxic else 0.05):
            words[rng.randrange(len(words))] = rng.choice(["Muslims", "muslims"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    return docs, labels


def test_swaps_lower_the_weight_of_group_names(spark):
    docs, labels = (spark.createDataFrame(r, s) for r, s in zip(corpus(), (DOCS, LABELS), strict=True))
    rows = labelled_rows(docs, labels, F.lit(True))
    probe = spark.createDataFrame([(1, "katon Muslims loram minor", ""), (2, "katon Hindus loram minor", ""), (3, "katon grobnik loram minor", "")], DOCS)
    plain = {r.doc_id: r.score for r in score_texts(probe, train_toxicity(rows, swap_penalty=0.0)).collect()}
    fair = {r.doc_id: r.score for r in score_texts(probe, train_toxicity(rows, swap_penalty=5.0)).collect()}
    assert abs(fair[1] - fair[2]) < 0.3 * abs(plain[1] - plain[2])
    assert fair[1] < plain[1] and fair[3] > 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.createDataFrame(r, s) for r, s in zip(corpus(), (DOCS, LABELS), strict=True))
    out = toxicity(docs, labels, ~held_out(F.col("doc_id"))).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    right = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.95


def test_odd_rows(spark):
    docs, labels = corpus(200)
    docs += [(9001, None, "x"), (9002, "", "x"), (None, "12 !?", "x"), (0, docs[0][1], "x"), (9003, "ram " * 100_000 + "grobnik", "x")]
    labels += [(0, 1), (0, None), (5, 7), (None, 1), (9001, 0)]
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (9001, 9002, None)}) == 1


def test_empty_and_unlabelled(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity(docs, labels, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a", "")], DOCS)
    assert [r.predicted for r in toxicity(one, labels, F.lit(True)).collect()] == [0]


def test_query_on_small_table(spark):
    out = op10_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "labelled_swaps", "neutral_swaps"] and out.count() == 200
    assert out.first()["neutral_swaps"] == SWAPS * len(NEUTRAL) * sum(map(len, IDENTITY_TERMS))


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows = [rng.choice(12, rng.integers(1, 6), replace=False) for _ in range(9)]
    sample = Sample(rng.integers(0, 2, 9).astype(float), rng.random(9), rows, [rng.choice(12, 4, replace=False) for _ in range(5)], np.array([0, 0, 3, 8, 2]), 12)
    w, b = rng.normal(size=12), 0.3
    got = loss(sample, w, b, 0.2, 1.7)[1]
    for i in range(13):
        step = np.zeros(13)
        step[i] = 1e-6
        up, down = (loss(sample, w + s * step[:12], b + s * step[12], 0.2, 1.7)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - got[i]) < 1e-6


def brute_score(text, model):
    """The score from the words of a text and their first four and five bytes, one at a time."""
    features = set()
    for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), word)
        for n, salt in ((len(low), 0), (4, 1), (5, 2)):
            data = np.frombuffer(low[:n], np.uint8)
            features.add(int(_feature(kernels.span_hash(data, np.array([0]), np.array([len(data)])), _SALTS[salt])[0]))
    return 1 / (1 + math.exp(-(model.intercept + sum(float(model.weights[f]) for f in features))))


def test_scores_equal_brute_force(spark):
    docs, labels = corpus(300)
    model = train_toxicity(labelled_rows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), F.lit(True)))
    rows = docs[:80] + [(9001, None, ""), (9002, "", ""), (9003, "Größe GROBNIK grobnik,grobnik größe \u4e2d\u6587", ""), (9004, "1 2 ##", "")]
    got = score_texts(spark.createDataFrame(rows, DOCS), model).collect()
    assert all(abs(r.score - brute_score(r.text, model)) < 1e-6 for r in got) and len(got) == len(rows)
    assert model.labelled_swaps > 0


def test_neutral_mentions_are_not_toxic(spark):
    """A group's name stands in toxic texts far more often: with swaps a neutral sentence scores alike for all groups, and lower."""
    docs, labels = (spark.createDataFrame(r, s) for r, s in zip(corpus(), (DOCS, LABELS), strict=True))
    probe = spark.createDataFrame([(i, s.format("muslims"), "") for i, s in enumerate(NEUTRAL[:3])], DOCS)
    rows = labelled_rows(docs, labels, F.lit(True))
    probe = probe.unionByName(spark.createDataFrame([(10 + i, s.format("hindus"), "") for i, s in enumerate(NEUTRAL[:3])], DOCS))
    plain, fair = ({r.doc_id: r.score for r in score_texts(probe, train_toxicity(rows, swap_penalty=p)).collect()} for p in (0.0, 1.0))
    assert all(plain[i] - plain[10 + i] > 0.2 and abs(fair[i] - fair[10 + i]) < 0.05 and fair[i] < min(0.3, plain[i]) for i in range(3))
