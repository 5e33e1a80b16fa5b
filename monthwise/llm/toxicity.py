"""Toxicity scores from a counterfactually regularised linear classifier.

A text is the set of its words and of their first four and five bytes, hashed.
The classifier is a logistic regression on the most telling of these. For each
labelled sentence that names an identity group, copies with the group swapped for
others are made, and the squared difference of the logits is part of the loss:
the model can't lower the loss by leaning on a group's name. Besides the labelled
texts there are neutral mentions, which are made of ``NEUTRAL`` and every identity
term, labelled as not toxic and swapped like the others, so that the penalty holds
for every term, also where labelled texts name few or none. All of them together
weigh ``NEUTRAL_WEIGHT`` of the labelled texts.

Learning uses a sample of labelled rows whose expected size is ``sample_rows``
(rows are kept by a hash of their doc_id, the same ones on every run); it needs
no more however large the tables are. Features are fewer than 1.5 per sampled
text, so that few labels don't fit noise, and those of the identity terms. What
reaches the driver is the sample's rows reduced to these features, and a weight per
feature goes back. Scoring is one pass without a shuffle.

Defined results: null, empty and wordless texts get the score of no features;
labels that are null or not 0/1 are ignored, of a doc_id labelled twice the
larger label counts; without labels of both kinds every score is 0; repeated rows
score alike, equal scores are not ordered; an empty table gives an empty table;
columns named score or predicted are replaced, others are carried whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from . import kernels
from .store import cut, from_text

BITS = 20
SAMPLE_ROWS, N_FEATURES, MIN_DOCS = 20_000, 6_000, 3
THRESHOLD = 0.3
SWAPS = 3
#: Groups whose members can stand for each other. Fixed values; another list is a parameter.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "transgender", "nonbinary"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "arab", "native", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "locals", "migrants", "citizens"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "buddhisten"), ("ausländer", "flüchtlinge", "deutsche", "türken"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "bouddhistes"), ("étrangers", "réfugiés", "français", "arabes"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "budistas"), ("extranjeros", "refugiados", "españoles", "gitanos"),
)
#: Sentences that name a group and say nothing against it.
NEUTRAL = ("the {} met their neighbours at the market", "many {} live in this town", "{} were invited to speak", "die {} wohnen in dieser stadt", "les {} vivent dans cette ville", "los {} viven en esta ciudad")
NEUTRAL_WEIGHT = 0.2
_U = np.uint64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SALTS = (0x51, 0x52, 0x53)


def _feature(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (kernels.mix(hashes + _U(salt)) >> _U(64 - BITS)).astype(np.int64)


def _word_features(texts: kernels.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(3, words) features, the text of each word, and its hash; words are runs of letters."""
    start, end, text = kernels.runs(texts, _LETTER[texts.data])
    whole = kernels.span_hash(texts.data, start, end, fold=True)
    parts = [_feature(whole, _SALTS[0])]
    for n, salt in ((4, _SALTS[1]), (5, _SALTS[2])):
        parts.append(_feature(kernels.span_hash(texts.data, start, np.minimum(end, start + n), fold=True), salt))
    return np.stack(parts), text, whole


def _term_features(groups) -> list[tuple[list[int], list[list[int]]]]:
    """For each group the hashes of its terms and the features of each."""
    out = []
    for terms in groups:
        features, text, whole = _word_features(next(kernels.slices(pa.array(terms))))
        one = [np.flatnonzero(text == i)[0] for i in range(len(terms))]
        out.append((whole[one].tolist(), features[:, one].T.tolist()))
    return out


SAMPLE = "row long, kind int, toxic int, features array<int>"


def _sample_features(batches, groups):
    """Features of labelled texts (kind 0), and of their copies with identity terms swapped (kind 1)."""
    known = {h: (g, i) for g, (hashes, _) in enumerate(groups) for i, h in enumerate(hashes)}
    hashes = np.array(sorted(known), dtype=np.uint64)
    for batch in batches:
        labels, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for texts in kernels.slices(batch.column(2)):
            features, text, whole = _word_features(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            named = np.isin(whole, hashes)
            for i in range(len(texts)):
                at, own = texts.first + i, slice(cuts[i], cuts[i + 1])
                rows.append((ids[at], 0, labels[at], np.unique(features[:, own]).astype(np.int32)))
                if named[own].any():
                    rest = np.unique(features[:, own][:, ~named[own]])
                    found = [known[h] for h in np.unique(whole[own][named[own]]).tolist()]
                    for step in range(1, SWAPS + 1):
                        new = [groups[g][1][(j + step) % len(groups[g][1])] for g, j in found]
                        rows.append((ids[at], 1, labels[at], np.union1d(rest, np.array(new).ravel()).astype(np.int32)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())), strict=True)], ["row", "kind", "toxic", "features"])


@dataclass
class Model:
    """A weight per hashed feature, the intercept, and how many swapped copies of labelled and of neutral sentences were used."""

    weights: np.ndarray
    intercept: float
    labelled_swaps: int = 0
    neutral_swaps: int = 0


@dataclass
class Sample:
    """Labelled rows and swapped copies, as lists of feature numbers below ``width``."""

    y: np.ndarray
    weight: np.ndarray
    rows: list[np.ndarray]
    twins: list[np.ndarray]
    twin_of: np.ndarray
    width: int

    def __post_init__(self):
        def flat(x):
            return (np.concatenate(x) if x else np.zeros(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(x)), [len(r) for r in x])

        self.col, self.row = flat(self.rows)
        self.twin_col, self.twin_row = flat(self.twins)


def loss(sample: Sample, w: np.ndarray, b: float, l2: float, swap_penalty: float) -> tuple[float, np.ndarray]:
    """The loss (log loss, ridge, mean squared difference of swapped logits) and its gradient; the intercept comes last."""
    z = np.bincount(sample.row, weights=w[sample.col], minlength=len(sample.y)) + b
    value = float((sample.weight * (np.logaddexp(0, z) - sample.y * z)).sum() + 0.5 * l2 * (w**2).sum())
    g = sample.weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - sample.y)
    gw = np.bincount(sample.col, weights=g[sample.row], minlength=sample.width) + l2 * w
    if len(sample.twins):
        d = z[sample.twin_of] - b - np.bincount(sample.twin_row, weights=w[sample.twin_col], minlength=len(sample.twins))
        value += float(swap_penalty * (d**2).mean())
        d = 2 * swap_penalty / len(d) * d
        own = np.bincount(sample.twin_of, weights=d, minlength=len(sample.y))
        gw += np.bincount(sample.col, weights=own[sample.row], minlength=sample.width) - np.bincount(sample.twin_col, weights=d[sample.twin_row], minlength=sample.width)
    return value, np.append(gw, g.sum())


def _fit(sample: Sample, l2: float, swap_penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by steps along the averaged gradient."""
    w = np.zeros(sample.width + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        grad = loss(sample, w[:-1], w[-1], l2, swap_penalty)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def neutral_mentions(groups, identity_terms) -> list[tuple[int, int, np.ndarray]]:
    """(row, kind, features) of the neutral sentences (kind 0) and their swapped copies (kind 1); rows are negative."""
    texts = pa.array([s.format(term) for s in NEUTRAL for terms in identity_terms for term in terms], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(-len(texts), 0), pa.int64()), texts], ["toxic", "row", "text"])
    out = []
    for made in _sample_features([batch], groups):
        out += [(r["row"], r["kind"], np.array(r["features"])) for r in made.to_pylist()]
    return out


def train_toxicity(labelled: DataFrame, n_features: int = N_FEATURES, identity_terms=IDENTITY_TERMS, l2: float = 1.0, swap_penalty: float = 1.0) -> Model:
    """The classifier from (doc_id, text, toxic) rows."""
    groups = _term_features(identity_terms)
    rows = labelled.select(F.col("toxic").cast("int"), F.xxhash64("doc_id").alias("row"), "text")
    sample = cut(rows.mapInArrow(lambda batches: _sample_features(batches, groups), SAMPLE))
    docs = sample.where("kind = 0")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    model = Model(np.zeros(1 << BITS, dtype=np.float32), -40.0)
    if not toxic or toxic == n:
        return model
    seen = docs.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_DOCS)
    expected = F.col("n") * F.lit(toxic / n)
    telling = F.pow(F.col("t") - expected, F.lit(2.0)) / (expected * F.lit(1 - toxic / n) * F.lit(1.0))
    chosen = {r[0] for r in seen.orderBy(telling.desc(), "feature").limit(min(n_features, 3 * n // 2)).select("feature").collect()}
    chosen = sorted(chosen | {f for _, terms in groups for term in terms for f in term})
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    wanted = labelled.sparkSession.createDataFrame([(chosen,)], "wanted array<int>")  # one row of n_features numbers
    kept = sample.join(F.broadcast(wanted)).select("row", "kind", "toxic", F.array_intersect("features", "wanted").alias("features"))
    y, weight, own, twins, index = [], [], [], [], {}
    for batch in kept.toArrow().to_batches():  # sample_rows rows of at most n_features numbers
        lists = batch.column("features")
        parts = np.split(place[np.asarray(lists.flatten())], np.cumsum(np.asarray(pc.list_value_length(lists)))[:-1])
        for row, kind, toxic_row, part in zip(*(batch.column(c).to_pylist() for c in ("row", "kind", "toxic")), parts, strict=False):
            if kind == 0:
                index[row] = len(y)
                y.append(toxic_row)
                weight.append(0.25 / (toxic if toxic_row else n - toxic) + 0.5 / n)
                own.append(part)
            else:
                twins.append((row, part))
    pairs = [(index[row], part) for row, part in twins if row in index]
    model.labelled_swaps = len(pairs)
    mentions = neutral_mentions(groups, identity_terms)
    n_neutral = sum(kind == 0 for _, kind, _ in mentions)
    index = {}
    for row, kind, features in mentions:
        part = place[features]
        part = part[part >= 0]
        if kind == 0:
            index[row] = len(y)
            y.append(0)
            weight.append(NEUTRAL_WEIGHT / n_neutral)
            own.append(part)
        else:
            pairs.append((index[row], part))
    model.neutral_swaps = len(pairs) - model.labelled_swaps
    known = Sample(np.array(y, dtype=float), np.array(weight), own, [part for _, part in pairs], np.array([r for r, _ in pairs], dtype=np.int64), len(chosen))
    model.weights[chosen], model.intercept = _fit(known, l2 / n, swap_penalty)
    return model


def labelled_rows(documents: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of a sample of labelled documents. The labels' side of the join holds ``sample_rows`` rows."""
    known = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    point = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    known = known.where(point < int(share * (1 << 30)))
    documents = documents.select("doc_id", "text").where(usable & (point < int(share * (1 << 30))))
    return documents.join(F.broadcast(known), "doc_id")


def score_texts(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with score (0 to 1) and predicted."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.intercept))  # 1 << BITS numbers

    def start():
        table, intercept = shared.value

        def scored(column: pa.Array) -> list[pa.Array]:
            out = []
            for texts in kernels.slices(column):
                features, text, _ = _word_features(texts)
                at = np.tile(text, 3)
                features = features.ravel()
                use = table[features] != 0
                key = np.unique((at[use] << BITS) | features[use])
                z = intercept + np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=len(texts))
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            return [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

        return scored

    out = from_text(documents.drop("predicted"), [StructField("score", DoubleType())], start)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, **fit) -> DataFrame:
    """Train on the labelled rows that are ``usable`` and score every row of ``documents``."""
    return score_texts(documents, train_toxicity(labelled_rows(documents, labels, usable, sample_rows), **fit), threshold)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and the number of swapped copies of labelled and of neutral sentences in the loss."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_toxicity(labelled_rows(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id"))))
    out = score_texts(documents, model)
    swaps = (F.lit(n).cast("long").alias(name) for n, name in ((model.labelled_swaps, "labelled_swaps"), (model.neutral_swaps, "neutral_swaps")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *swaps)
