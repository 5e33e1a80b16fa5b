"""Benchmark decontamination by the rarest shingles of each item.

An item is the set of its five-word shingles, and a shingle weighs ``1 + ln(items /
items that hold it)``, counted over the whole benchmark. ``similarity`` is the weight
of the item's shingles that stand in an item-sized stretch of a document, a quarter
of the item wider on both sides, as a share of all; it is the largest over all
stretches of the document.

A stretch that reaches ``SIMILARITY`` misses a fifth at most of the item's weight.
So it holds one at least of any shingles that weigh more than a fifth together: each
item is entered in the index under its heaviest (rarest) shingles up to that weight,
and a document that holds none of them cannot hold the item. The lookup thus finds
every pair that brute force does, wherever words were changed. A candidate's
stretches are then compared exactly. SimHash windows can't do this at 0.8: see the
README for the measured distances.

The items are hashed into blocks of about ``BLOCK_BYTES`` of text, the most that a
task or the driver holds at once. The documents are worked on once for each block,
and neither shuffled nor widened: all shingles of a document are seen in the task
that reads it.

Defined results: a null or empty text has no leak; items that are null, without id
or with fewer than ``min_words`` words are not searched (such short ones stand in
texts by chance); with ``min_words`` below five, items of fewer than five words are
found where all their words stand in a row; items with equal texts are all
reported; of equally similar stretches the first counts; repeated rows are reported
each; empty tables give no leaks and leave all documents; other columns are carried
by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .store import apart

SHINGLE, SIMILARITY = 5, 0.8
MIN_WORDS = SHINGLE
#: Item text of a block, about.
BLOCK_BYTES = 4 << 20
_EPS = 1e-12


class Index:
    """The shingles of a block of items, and the items by their rarest shingles.

    ``n_items`` and ``common`` (shingle: items, where it is more than one) are counted over all blocks.
    """

    def __init__(self, items: list[tuple[int, str]], n_items: int, common: dict[int, int], min_words: int = MIN_WORDS):
        self.own, self.offsets, self.weights, self.words, self.ids = [], [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # words: sequence: item ids
        shingles = []
        texts = [t for t in kernels.slices(pa.array([text for _, text in items], pa.string()), 1 << 62)]
        if texts:
            w = kernels.words(texts[0])
            cuts = np.searchsorted(w.text, np.arange(len(items) + 1))
            for i, (item_id, _) in enumerate(items):
                own = w.hash[cuts[i] : cuts[i + 1]]
                if not len(own) or len(own) < min_words:
                    continue
                if len(own) < SHINGLE:
                    whole = kernels.shingles(own, np.zeros(len(own), np.int64), len(own))[0]
                    self.short.setdefault(len(own), {}).setdefault(int(whole[0]), []).append(item_id)
                    continue
                sh, _, _ = kernels.shingles(own, np.zeros(len(own), np.int64), SHINGLE)
                sh, offset = np.unique(sh, return_index=True)
                self.ids.append(item_id)
                self.words.append(len(own))
                self.offsets.append(offset)
                shingles.append(sh)
        self.held = np.unique(np.concatenate(shingles) if shingles else np.zeros(0, np.uint64))
        count = np.array([common.get(h, 1) for h in self.held.tolist()], dtype=np.int64)
        rare, item = [], []
        for k, sh in enumerate(shingles):
            own = np.searchsorted(self.held, sh)
            weights = 1 + np.log(n_items / count[own])
            order = np.argsort(-weights, kind="stable")
            left = weights.sum() - np.cumsum(weights[order])  # the most that a document without these can hold
            first = order[: 1 + int(np.argmax(left < (SIMILARITY - 1e-9) * weights.sum()))]
            rare.append(own[first])
            item.append(np.full(len(first), k))
            self.own.append(own)
            self.weights.append(weights)
        rare, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rare, item))
        order = np.argsort(rare, kind="stable")
        self.items, self.starts = item[order], np.searchsorted(rare[order], np.arange(len(self.held) + 1))
        self.mask = np.uint64((1 << max(10, (16 * len(self.held)).bit_length())) - 1)
        self.some = np.zeros(int(self.mask) + 1, bool)  # nearly all shingles of a document end here
        self.some[self.held & self.mask] = True

    def leaks(self, texts: kernels.Texts) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item_id, similarity, first word, words) of the best stretch of each item in each text."""
        w = kernels.words(texts)
        for n, known in self.short.items():
            sh, text, at = kernels.shingles(w.hash, w.text, n)
            hit = np.flatnonzero(np.isin(sh, np.array(list(known), dtype=np.uint64)))
            _, first = np.unique(np.stack([text[hit], sh[hit].view(np.int64)]), axis=1, return_index=True)
            for k in hit[np.sort(first)].tolist():
                for item_id in known[int(sh[k])]:
                    yield int(text[k]), item_id, 1.0, int(at[k] - np.searchsorted(w.text, text[k])), n
        if not self.ids:
            return
        sh, text, _ = kernels.shingles(w.hash, w.text, SHINGLE)
        at = np.flatnonzero(self.some[sh & self.mask])
        key = np.minimum(np.searchsorted(self.held, sh[at]), len(self.held) - 1)
        hit = self.held[key] == sh[at]
        at, key = at[hit], key[hit]
        doc = text[at]
        begin = np.searchsorted(text, np.arange(len(texts)))  # a text's shingles are consecutive
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d, item in self._candidates(doc, key):
            own = self.own[item]
            keys = key[cuts[d] : cuts[d + 1]]
            j = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            mine = own[j] == keys
            found = self._best(item, at[cuts[d] : cuts[d + 1]][mine] - begin[d], j[mine])
            if found is not None:
                yield d, self.ids[item], *found, self.words[item]

    def _candidates(self, doc: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of each text that holds one of the item's rarest shingles."""
        rare = self.starts[key + 1] > self.starts[key]
        seen = np.unique(np.stack([doc[rare], key[rare]], axis=1), axis=0)
        n = self.starts[seen[:, 1] + 1] - self.starts[seen[:, 1]]
        for a, b in _parts(n, 1 << 20, seen[:, 0]):
            own = n[a:b]
            entry = np.repeat(self.starts[seen[a:b, 1]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            yield from np.unique(np.stack([np.repeat(seen[a:b, 0], own), self.items[entry]], axis=1), axis=0).tolist()

    def _best(self, item: int, at: np.ndarray, j: np.ndarray) -> tuple[float, int] | None:
        """Similarity and first word of the best stretch, from the places and numbers of the item's shingles in a text."""
        weights, n = self.weights[item], self.words[item]
        total, width = weights.sum(), n - SHINGLE + 1 + 2 * (n // 4)
        share = lambda own: float(weights[np.unique(own)].sum() / total)
        if share(j) < SIMILARITY - _EPS:
            return None
        a, b = 0, len(at)
        if at[-1] - at[0] >= width:
            most, got, lo, held, weight = -1.0, 0.0, 0, np.zeros(len(weights), np.int64).tolist(), weights.tolist()
            places, numbers = at.tolist(), j.tolist()
            for hi, (place, k) in enumerate(zip(places, numbers, strict=True)):
                while place - places[lo] >= width:
                    held[numbers[lo]] -= 1
                    got -= 0 if held[numbers[lo]] else weight[numbers[lo]]
                    lo += 1
                got += 0 if held[k] else weight[k]
                held[k] += 1
                if got > most + 1e-9:
                    most, a, b = got, lo, hi + 1
        similarity = share(j[a:b])
        if similarity < SIMILARITY - _EPS:
            return None
        start, times = np.unique(at[a:b] - self.offsets[item][j[a:b]], return_counts=True)
        return similarity, max(0, int(start[np.argmax(times)]))


def _parts(n: np.ndarray, limit: int, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups with about ``limit`` in n each."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else []
    total, a = np.cumsum(n), 0
    for b in ends:
        if b == len(group) or total[b - 1] - (total[a - 1] if a else 0) >= limit:
            yield a, b
            a = b


def _item_shingles(batches):
    for batch in batches:
        for texts in kernels.slices(batch.column(1)):
            w = kernels.words(texts)
            sh, text, _ = kernels.shingles(w.hash, w.text, SHINGLE)
            both = np.unique(np.stack([text, sh.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(both[0] + texts.first)), pa.array(both[1])], ["block", "shingle"])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> Iterator[Index]:
    """Indexes of about ``block_bytes`` of items each; each block of items is read on its own."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-n_bytes // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks)))
    items = items.withColumn("block", block)
    long = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) >= max(SHINGLE, min_words)
    n_items = items.where(long).count()
    rows = items.where(long).select("block", "text").mapInArrow(_item_shingles, "block long, shingle long")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = rows.distinct().join(held, "shingle")
    for b in range(n_blocks):
        own = items.where(F.col("block") == b).select("item_id", "text").collect()
        counts = {r["shingle"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in common.where(F.col("block") == b).collect()}  # a row for each shingle of the block at most
        yield Index([(r["item_id"], r["text"]) for r in own], n_items, counts, min_words)


LEAKS = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def benchmark_leaks(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row per document and item it holds."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = documents.sparkSession.createDataFrame([], LEAKS)
    for index in item_blocks(benchmark, block_bytes, min_words):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def found(batches, shared=shared):
            for batch in batches:
                ids, got = batch.column(0), []
                for texts in kernels.slices(batch.column(1)):
                    got += [(ids[texts.first + doc].as_py(), *rest) for doc, *rest in shared.value.leaks(texts)]
                cols = list(zip(*got, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in LEAKS.split(", ")])

        out = out.unionByName(rows.mapInArrow(found, LEAKS))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark item."""
    out, of, columns = apart(documents)
    at = [c.lower() for c in documents.columns].index("text")
    schema = out.schema
    for index in item_blocks(benchmark, block_bytes, min_words):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for texts in kernels.slices(batch.column(at)):
                    for doc, *_ in shared.value.leaks(texts):
                        keep[texts.first + doc] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, schema)
    return out.select(*columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
