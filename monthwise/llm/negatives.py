"""Hard negatives by a vector-approximation file.

Rows are packed into blocks of at most BLOCK_VALUES components. A block keeps, beside
its vectors, the approximation: each dimension cut into CELLS cells of one width
between its least and greatest component, and a cell number of a byte for each
component. Of an anchor and a cell the least and greatest contribution to the inner
product stand in a table, so a row's upper bound is a sum of looked up numbers, and its
lower bound lies the anchor's cell widths below. Only rows whose bounds can still
enter are scored from their vectors: for positives, the upper bound must reach the
k-th best lower bound or score so far; for negatives it must reach that of its window
as well, and the bounds must meet the window. All numbers are whole, so bounds are
safe and results equal those of scoring every pair.

Anchors are a stated query set against all rows, in blocks: every block of anchors
meets every group of blocks of rows once, in one task that keeps k rows an anchor. A
group is at most GROUP_BYTES, so memory does not depend on the table; there are as many
groups as that needs, or as keep the cluster busy. What leaves the tasks is k rows an
anchor (and positive) and group. Labels deal nothing out, so that a hot label or a
vector that repeats is work spread over all tasks.

Defined results: rows with a null vec_id or label, a null vector, or a null or
non-finite component take no part; of rows with one vec_id that with the smallest
(label, vector) counts; components are floor(scale * x), held to +-2^20; a vector that
is shorter than another counts as 0 where it ends; an anchor without another row of
its label, and a positive whose window is empty, have no row; other columns are not
carried; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

CELLS, MOST = 32, 1 << 20
BLOCK_ROWS, BLOCK_VALUES, GROUP_BYTES = 4096, 1 << 20, 32 << 20
#: Anchors that a task bounds at once, and rows.
ANCHORS, STEP = 256, 1024
#: Pairs scored at once, in components.
PAIR_VALUES = 1 << 21
_NONE = -(1 << 62)

BLOCK = "part long, at long, n long, dims long, ids binary, labels binary, chosen binary, low binary, width binary, cells binary, vectors binary"


def cleaned(embeddings: DataFrame, chosen: Column, scale: int, label: Column) -> DataFrame:
    """vec_id, label, chosen, vector (whole numbers): one row for each vec_id that takes part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("old"), whole.alias("vector"), label.cast("long").alias("label"), chosen.alias("chosen")).alias("row"))
    rows = rows.groupBy("vec_id").agg(F.min("row").alias("row"))
    return rows.select("vec_id", "row.label", "row.chosen", "row.vector")


def _block(part: int, at: int, ids, labels, chosen, vectors, lengths, starts) -> dict:
    """A block of rows: the vectors as a matrix, and its approximation."""
    dims = int(lengths.max(initial=0))
    x = np.zeros((len(ids), dims), np.int32)
    inside = np.arange(dims) < lengths[:, None]
    x[inside] = vectors[(starts[:, None] + np.arange(dims))[inside]]
    low = x.min(axis=0) if len(x) else np.zeros(dims, np.int32)
    width = (x.max(axis=0) - low) // CELLS + 1 if len(x) else np.ones(dims, np.int32)
    cells = ((x - low) // width).astype(np.uint8)
    row = {"part": part, "at": at, "n": len(ids), "dims": dims, "ids": ids, "labels": labels, "chosen": chosen, "low": low, "width": width, "cells": np.ascontiguousarray(cells.T), "vectors": x}
    return {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()}


_FIELDS = [(n, pa.binary() if kind == "binary" else pa.int64()) for n, kind in (x.split() for x in BLOCK.split(", "))]


def _pack(most: int):
    """Rows of a task as blocks of at most ``most`` rows and BLOCK_VALUES components, of similar lengths."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, labels, chosen = (np.asarray(batch.column(i).cast(t)) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int8())))
            lists = batch.column(3)
            edges, values = np.asarray(lists.offsets), np.asarray(lists.values)
            starts, lengths = edges[:-1], np.diff(edges)
            order, begin = np.argsort(lengths, kind="stable"), 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and end - begin < most and (end + 1 - begin) * lengths[order[end]] <= BLOCK_VALUES:
                    end += 1
                rows = order[begin:end]
                block = _block(part, at, ids[rows], labels[rows], chosen[rows].astype(np.int8), values, lengths[rows], starts[rows])
                yield pa.RecordBatch.from_arrays([pa.array([block[n]], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])
                begin, at = end, at + 1

    return packed


def _chosen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen rows of blocks, as rows."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Rows.of(row)
            at = np.flatnonzero(b.chosen)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * b.vectors.shape[1], pa.int32()), pa.array(b.vectors[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(np.ones(len(at), bool)), vectors], ["vec_id", "label", "chosen", "vector"])


@dataclass
class Rows:
    """A block as arrays; cells by dimension."""

    ids: np.ndarray
    labels: np.ndarray
    chosen: np.ndarray
    low: np.ndarray
    width: np.ndarray
    cells: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Rows:
        n, dims = row["n"], row["dims"]
        get = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(get("ids", np.int64), get("labels", np.int64), get("chosen", np.int8), get("low", np.int32), get("width", np.int32), get("cells", np.uint8).reshape(dims, n), get("vectors", np.int32).reshape(n, dims))


def bounds(rows: Rows, anchors: Rows) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For STEP rows at a time: which, and their lower and upper bounds for every anchor."""
    dims = min(rows.vectors.shape[1], anchors.vectors.shape[1])
    a, low, width = (x.astype(np.int64) for x in (anchors.vectors[:, :dims], rows.low[:dims], rows.width[:dims]))
    most = int((np.abs(a).max(axis=0, initial=0) * (np.abs(low) + CELLS * width)).sum()) if len(a) else 0
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    edges = low[:, None] + np.arange(CELLS) * width[:, None]
    table = (edges[:, :, None] * a.T[:, None, :]).astype(kind)
    spread = a * (width - 1)
    above, below = np.maximum(spread, 0).sum(axis=1).astype(kind), np.minimum(spread, 0).sum(axis=1).astype(kind)
    for start in range(0, len(rows.ids), STEP):
        part = slice(start, min(start + STEP, len(rows.ids)))
        at_edges = np.zeros((part.stop - part.start, len(a)), kind)
        for d in range(dims):
            at_edges += table[d].take(rows.cells[d, part], axis=0)
        yield part, at_edges + below, at_edges + above


def exact(rows: Rows, anchors: Rows, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row r[i] and anchor c[i]."""
    dims = min(rows.vectors.shape[1], anchors.vectors.shape[1])
    out, step = np.zeros(len(r), np.int64), max(1, PAIR_VALUES // max(dims, 1))
    for i in range(0, len(r), step):
        out[i : i + step] = np.einsum("ij,ij->i", rows.vectors[r[i : i + step], :dims], anchors.vectors[c[i : i + step], :dims], dtype=np.int64)
    return out


class Best:
    """The k best (score, id) of each of n owners so far: high scores first, then small ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, _NONE)

    def add(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        owner, score, id = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, id)))
        order = np.lexsort((id, -score, owner))
        owner, score, id = owner[order], score[order], id[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = rank < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], id[kept]
        last = rank == self.k - 1
        self.least[owner[last]] = score[last]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest number of each column."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], _NONE, values.dtype)


def nearest(rows: Iterator[Rows], anchors: Rows, k: int) -> Best:
    """The k other rows of each anchor's label with the highest scores."""
    best = Best(len(anchors.ids), k)
    for block in rows:
        for part, lower, upper in bounds(block, anchors):
            same = (block.labels[part, None] == anchors.labels) & (block.ids[part, None] != anchors.ids)
            reach = np.maximum(_kth(np.where(same, lower, lower.dtype.type(_NONE)), k), best.least)
            r, c = np.nonzero(same & (upper >= reach))
            r += part.start
            best.add(c, exact(block, anchors, r, c), block.ids[r])
    return best


def in_windows(rows: Iterator[Rows], anchors: Rows, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[Best]:
    """For each window (least and greatest score of each anchor) the k rows of other labels with the highest scores inside."""
    best = [Best(len(anchors.ids), k) for _ in windows]
    for block in rows:
        for part, lower, upper in bounds(block, anchors):
            other = block.labels[part, None] != anchors.labels
            found = np.zeros_like(other)
            for (least, greatest), b in zip(windows, best, strict=True):
                possible = other & (upper >= least) & (lower <= greatest)
                certain = possible & (lower >= least) & (upper <= greatest)
                reach = np.maximum(_kth(np.where(certain, lower, lower.dtype.type(_NONE)), k), b.least)
                found |= possible & (upper >= reach)
            r, c = np.nonzero(found)
            r += part.start
            score = exact(block, anchors, r, c)
            for (least, greatest), b in zip(windows, best, strict=True):
                inside = (score >= least[c]) & (score <= greatest[c])
                b.add(c[inside], score[inside], block.ids[r[inside]])
    return best


def _table(columns: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({n: pa.array(np.asarray(v, np.int64)) for n, v in columns.items()})


def mine(embeddings: DataFrame, anchors: Column, label: Column | None = None, scale: int = 256, n_positives: int = 5, n_negatives: int = 3, percent: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, label and embedding; ``anchors`` says which rows are
    anchors and ``label`` what their label is taken as. A negative has another label and a
    score from percent[0] to percent[1] hundredths of the positive's.
    """
    spark = embeddings.sparkSession
    rows = cleaned(embeddings, anchors, scale, F.col("label") if label is None else label)
    blocks = cut(rows.mapInArrow(_pack(BLOCK_ROWS), BLOCK))
    chosen = blocks.mapInArrow(_chosen_rows, "vec_id long, label long, chosen boolean, vector array<int>")
    sizes = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("vectors") + F.octet_length("cells")), F.lit(0)).alias("bytes")).first()
    parts = max(1, math.ceil(chosen.count() / ANCHORS))
    groups = max(math.ceil(sizes["bytes"] / GROUP_BYTES), min(sizes["n"], math.ceil(2 * spark.sparkContext.defaultParallelism / parts)), 1)
    queries = cut(chosen.repartition(parts).mapInArrow(_pack(ANCHORS), BLOCK)).withColumn("a", F.col("part") % parts)
    right = blocks.withColumn("g", (F.col("part") + F.col("at")) % groups).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    right = right.repartition(parts * groups, "a", "g")
    by_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))

    def blocks_of(table: pa.Table) -> Iterator[Rows]:
        for i in range(table.num_rows):
            yield Rows.of(table.slice(i, 1).to_pylist()[0])

    def positives(left: pa.Table, table: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            one = Rows.of(row)
            best = nearest(blocks_of(table), one, n_positives)
            found.append(_table({"a": np.full(len(best.id), row["a"]), "anchor_id": one.ids[best.owner], "positive_id": best.id, "positive_score": best.score}))
        return pa.concat_tables(found) if found else _table(dict.fromkeys(("a", "anchor_id", "positive_id", "positive_score"), ()))

    left = queries.withColumn("g", by_group).repartition(parts * groups, "a", "g")
    near = left.groupBy("a", "g").cogroup(right.groupBy("a", "g")).applyInArrow(positives, "a long, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_positives)
    lists = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("anchor_id", "k", "positive_id", "positive_score"))).alias("positives"))

    def negatives(left: pa.Table, table: pa.Table) -> pa.Table:
        names, found = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), []
        for row in left.to_pylist():
            one = Rows.of(row)
            place = {x: i for i, x in enumerate(one.ids.tolist())}
            ids, scores = np.zeros((n_positives, len(place)), np.int64), np.full((n_positives, len(place)), _NONE)
            for p in row["positives"] or ():
                if p["anchor_id"] in place:
                    at = p["k"] - 1, place[p["anchor_id"]]
                    ids[at], scores[at] = p["positive_id"], p["positive_score"]
            windows = [(np.where(s > _NONE, -(-percent[0] * s // 100), 1), np.where(s > _NONE, percent[1] * s // 100, 0)) for s in scores]
            for k, best in enumerate(in_windows(blocks_of(table), one, windows, n_negatives)):
                found.append(_table(dict(zip(names, (one.ids[best.owner], ids[k, best.owner], scores[k, best.owner], best.id, best.score), strict=True))))
        return pa.concat_tables(found) if found else _table(dict.fromkeys(names, ()))

    left = queries.join(lists, "a").withColumn("g", by_group).repartition(parts * groups, "a", "g")
    out = left.groupBy("a", "g").cogroup(right.groupBy("a", "g")).applyInArrow(negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


#: Every anchor against every row, by unnested inner products.
OP12_SQL = f"""
WITH clean AS (
  SELECT vec_id, CAST(label AS BIGINT) AS old, list_transform(embedding, lambda x: CAST(greatest(least(floor(CAST(x AS DOUBLE) * 256), {MOST}), -{MOST}) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), one AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (old + 1) % 10 ELSE old END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY old, v) AS k FROM clean) WHERE k = 1
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM one a JOIN one b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 3
"""
