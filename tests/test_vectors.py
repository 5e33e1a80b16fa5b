"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthwise.operators import search, vectors
from monthwise.plans.versions import Conflict, Version


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 24), (9001, None)]
    return x, spark.createDataFrame(rows, vectors.ROW).repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    out = vectors.VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")))
    out.build(table[1], 32)
    return out


def test_recall_and_the_exact_way(index, table):
    x, df = table
    hit = 0
    for i in range(0, 3000, 300):
        exact = {r["id"] for r in search.cosine_topk(df, x[i].tolist(), 10).collect()}
        hit += len(exact & {r["id"] for r in index.search(x[i].tolist(), 10, probes=6).collect()})
    assert hit >= 0.9 * 100
    assert index.search(x[7].tolist(), 10, None).collect() == search.cosine_topk(df, x[7].tolist(), 10).collect()
    assert vectors.topk(df, x[7].tolist()).collect() == search.cosine_topk(df, x[7].tolist()).collect()
    read = index.search(x[0].tolist(), 5, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in read and index.vectors().count() == 3002


def test_upsert_clear_and_conflicts(spark, index, table):
    x, _ = table
    new = spark.createDataFrame([(5, (-x[5]).tolist()), (7777, x[5].tolist()), (7777, x[5].tolist())], vectors.ROW)
    before = index.versions.last()
    index.upsert(new)
    after = index.versions.last()
    assert 0 < len(before.changed(after)) < len(before.months)  # only lists that are touched
    assert index.search(x[5].tolist(), 1).first()["id"] == 7777 and index.vectors().where("id = 5").count() == 1 and index.vectors().count() == 3003
    index.clear(spark.createDataFrame([(7777,), (123456,)], "id long"))
    assert index.vectors().count() == 3002 and index.vectors().where("id = 7777").count() == 0
    taken = index.versions.last().number + 1
    index.versions.publish(Version(taken, index.versions.last().months, index.versions.last().whole))
    index.versions.last = lambda: index.versions.read(taken - 1)
    try:
        with pytest.raises(Conflict):
            index.upsert(new)
    finally:
        del index.versions.last
    index.clear()
    assert index.vectors().count() == 0 and index.search(x[0].tolist()).collect() == []


def test_no_vectors(spark, tmp_path):
    out = vectors.VectorIndex(spark, str(tmp_path / "v"))
    out.build(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], vectors.ROW))
    assert out.vectors().count() == 2
    out.build(spark.createDataFrame([], vectors.ROW))
    assert out.vectors().count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
