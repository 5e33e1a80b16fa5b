"""Connected components of a link table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

#: What a task holds of the edges at once, about: 4 MB of numbers.
EDGES_PER_TASK = 250_000
EDGE = "u long, v long"


def component_stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame | None:
    """(node, component) for every linked node that is not the smallest it reaches, which is its component; None without links.

    Each round contracts the edges of every task to stars, then links every node to
    the smallest node around it, first from the larger side (large star) and then
    from the smaller (small star), until nothing changes. A contraction holds about
    EDGES_PER_TASK edges; where that is all of them, nothing is left to do. Edges
    stay at most one per node and neighbour and a star's rows are pre-aggregated, so
    a hub costs no more than its edges. Joins are sort-merge at every size: what is
    joined has been dealt out by its key, and nothing passes the driver.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state, before = _state(edges), None
    if not state["n"]:
        return None
    while state != before:
        tasks = 1 + state["n"] // EDGES_PER_TASK  # a graph of few edges is not worth a file for each partition
        edges = edges.coalesce(tasks).mapInArrow(_contracted, EDGE)
        if tasks == 1:
            break
        edges = cut(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        before, state = state, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every linked node; component is the smallest node it reaches."""
    stars = component_stars(links, a, b)
    if stars is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    stars = cut(stars)
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _contracted(batches):
    """The edges of a task as stars around the smallest node of each of their components.

    Edges are taken EDGES_PER_TASK at a time, together with the stars so far only
    if these are fewer, so that a task holds no more than twice that.
    """
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
        n += batch.num_rows
        if n >= 2 * EDGES_PER_TASK:
            stars = _stars(np.concatenate(held, axis=1))
            if stars.shape[1] > EDGES_PER_TASK:
                yield _batch(stars)
                stars = stars[:, :0]
            held, n = [stars], stars.shape[1]
    if n:
        yield _batch(_stars(np.concatenate(held, axis=1)))


def _stars(edges: np.ndarray) -> np.ndarray:
    """(2, stars): every node but the smallest of its component, and that."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(edges.shape)
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[at[0]], low[at[1]])
        new = low.copy()
        for side in at:
            np.minimum.at(new, low[side], least)  # the roots of both sides
        new = np.minimum(new, new[low])
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    inner = low != np.arange(len(nodes))
    return np.stack([nodes[inner], nodes[low[inner]]])


def _batch(stars: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(stars[0], pa.int64()), pa.array(stars[1], pa.int64())], ["u", "v"])


def _state(edges: DataFrame):
    """What changes with any edge: their number and the sum of their hashes."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
