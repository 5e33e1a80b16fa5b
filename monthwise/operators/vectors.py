"""A stored vector index: lists by trained centroids, searched list by list.

Centroids are trained on a bounded sample; every vector is put into the list of its nearest
one by angle. A search ranks the centroids, reads the files of the first ``probes`` lists and
compares their vectors exactly; with all lists it is the exact search. Lists are kept as
versions are (see ``plans.versions``): an upsert writes the lists it touches anew.

Defined results: a vector of zeros and a null vector go to list 0 and score as in
``search.cosine``; of rows with one id in an upsert the one with the greatest vector counts;
vectors are of one length.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthwise.operators import search
from monthwise.plans.versions import Conflict, Version, Versions

#: Rows that centroids are trained on, about, and the most lists there are.
SAMPLE, MOST_LISTS = 20_000, 1024
ROW = "id long, embedding array<double>"


def train(vectors: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of a sample of at most about SAMPLE vectors, each of length 1; the same on every run."""
    known = vectors.where("embedding is not null and exists(embedding, x -> x <> 0)").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    n = known.count()
    part = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    points = part.orderBy("id").select(array_to_vector("embedding").alias("features"))
    if points.isEmpty():
        return np.zeros((1, 1))
    model = KMeans(k=max(2, min(lists, MOST_LISTS)), seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def nearest_list(embedding: Column, centres: np.ndarray) -> Column:
    """The number of the centroid at the least angle; 0 for no vector. MOST_LISTS centroids go with the tasks."""
    if len(centres) < 2:
        return F.lit(0)

    @F.pandas_udf("int")
    def of(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.zeros(len(vectors), np.int32)
        if known.any():
            out[known] = (np.stack(vectors[known].to_numpy()).astype(float) @ centres.T).argmax(axis=1)
        return pd.Series(out)

    return of(embedding)


def order_of_lists(centres: np.ndarray, query: Sequence[float]) -> list[int]:
    """List numbers, the nearest first."""
    if len(centres) < 2:
        return [0]
    return np.argsort(-(centres @ np.asarray(query, float)), kind="stable").tolist()


class VectorIndex:
    """Vectors by id under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    def _centres(self, version: Version) -> np.ndarray:
        rows = self.spark.read.schema("list int, centre array<double>").parquet(f"{version.whole}/centres").orderBy("list").collect()  # MOST_LISTS at most
        return np.array([r["centre"] for r in rows])

    def _lists(self, version: Version, only: set[str] | None = None) -> DataFrame:
        parts = []
        for folder in sorted(set(version.months.values())):
            own = [int(k) for k, f in version.months.items() if f == folder and (only is None or k in only)]
            if own:
                parts.append(self.spark.read.schema(f"{ROW}, list int").parquet(f"{folder}/lists").where(F.col("list").isin(*own)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{ROW}, list int")

    @staticmethod
    def _rows(vectors: DataFrame) -> DataFrame:
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        return rows.groupBy("id").agg(F.max("embedding").alias("embedding"))

    def _write(self, rows: DataFrame, folder: str) -> set[str]:
        rows.hint("rebalance", "list").write.partitionBy("list").parquet(f"{folder}/lists")
        return {str(r["list"]) for r in self.spark.read.schema(f"{ROW}, list int").parquet(f"{folder}/lists").select("list").distinct().collect()}

    def build(self, vectors: DataFrame, lists: int = 64) -> None:
        """Train centroids and replace everything by these vectors."""
        version, folder = self.versions.last(), f"{self.folder}/data/{uuid.uuid4().hex}"
        centres = train(vectors, lists)
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        found = self._write(self._rows(vectors).withColumn("list", nearest_list(F.col("embedding"), centres)), folder)
        if not self.versions.publish(Version(version.number + 1, dict.fromkeys(found, folder), folder)):
            raise Conflict("another writer has changed the index")

    def _replace(self, ids: DataFrame, new: DataFrame | None) -> None:
        """Write the lists anew that hold one of the ids, or are to hold a new row; their old rows with these ids go."""
        version, folder = self.versions.last(), f"{self.folder}/data/{uuid.uuid4().hex}"
        held = self._lists(version).select("id", "list").join(ids, "id", "left_semi").select("list")
        touched = {str(r["list"]) for r in (held if new is None else held.unionByName(new.select("list"))).distinct().collect()}
        kept = self._lists(version, touched).join(ids, "id", "left_anti")
        found = self._write(kept if new is None else kept.unionByName(new), folder)
        lists = {k: f for k, f in version.months.items() if k not in touched} | dict.fromkeys(found, folder)
        if not self.versions.publish(Version(version.number + 1, lists, version.whole)):
            raise Conflict("another writer has changed the index")

    def upsert(self, vectors: DataFrame) -> None:
        """Add vectors, in place of those with the same ids."""
        rows = self._rows(vectors)
        new = rows.withColumn("list", nearest_list(F.col("embedding"), self._centres(self.versions.last())))
        self._replace(rows.select("id"), new)

    def clear(self, ids: DataFrame | None = None) -> None:
        """Remove the vectors with these ids (a column ``id``), or all."""
        version = self.versions.last()
        if ids is not None:
            self._replace(ids.select("id"), None)
        elif not self.versions.publish(Version(version.number + 1, {}, version.whole)):
            raise Conflict("another writer has changed the index")

    def vectors(self) -> DataFrame:
        return self._lists(self.versions.last()).select("id", "embedding")

    def search(self, query: Sequence[float], k: int = 10, probes: int | None = 16) -> DataFrame:
        """id, score of the k nearest vectors in the first ``probes`` lists; in all of them if None, which is exact."""
        version = self.versions.last()
        only = None if probes is None else {str(x) for x in order_of_lists(self._centres(version), query)[:probes]}
        return search.cosine_topk(self._lists(version, only), query, k)


def topk(vectors: DataFrame, query: Sequence[float], k: int = 10, lists: int = 16, probes: int | None = None) -> DataFrame:
    """A search over lists that are made for it and kept nowhere."""
    centres = train(vectors, lists)
    rows = vectors.withColumn("list", nearest_list(F.col("embedding"), centres))
    wanted = order_of_lists(centres, query)[:probes]
    return search.cosine_topk(rows.where(F.col("list").isin(*wanted)), query, k)
