"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Their sizes, largest first, go to the
least-loaded shard through a heap. The heap sees a bounded number of items,
whatever the input: a group of at least ``total / (n_shards * grain)`` bytes is
an item of its own (there are at most ``n_shards * grain``), and the groups below
that are hashed into ``n_shards * grain`` bundles, each of which is an item.
Only these items reach the driver; rows look their shard up in two tables of that
bounded size, so groups never meet. Numbering a shard's rows deals them out once, texts
included where they are carried.

Law: ``bytes`` (shards end up near equal in bytes). Slots number a shard's rows
from 0 without gaps: rows are counted per (shard, range of the row's hash), so
that no task numbers a whole shard.

Defined results: a null text has size 1, a null checksum, and is equal to other
null texts; an empty text is a group like any other; repeated rows are rows of
their own and share a shard, in an order among equals that does not matter; an
empty table gives an empty table; columns of the input whose names clash with the
added ones are replaced, others are carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import apart

GRAIN = 512
#: Rows are numbered in ranges of about so many bytes of text; a shard has at least LEAST_RANGES, so that they spread evenly over tasks.
RANGE_BYTES, LEAST_RANGES = 32 << 20, 64
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_key(text: Column) -> Column:
    """Equal for equal texts. Different texts that ever share a key only stay together."""
    return F.xxhash64(text, F.coalesce(F.octet_length(text), F.lit(-1)))


def schedule(items: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """(size, name) items to shards: largest first, each to the least-loaded shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(documents: DataFrame, n_shards: int = 8, grain: int = GRAIN) -> DataFrame:
    """The rows of ``documents`` with size, text_crc32, law, shard, slot and grown_shard."""
    spark = documents.sparkSession
    bound = n_shards * grain
    base, of, columns = apart(documents.drop(*ADDED))
    key, row, place = "key", "row", "range"
    own = {
        "size": text_size(of["text"]),
        "text_crc32": F.crc32(F.encode(of["text"], "UTF-8")),
        "law": F.lit("bytes"),
        key: text_key(of["text"]),
        row: F.xxhash64(of["doc_id"], of["text"]),
    }
    rows = base.withColumns(own)
    groups = rows.groupBy(key).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    bundle = F.pmod(F.col(key), F.lit(bound))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = F.col("bytes") * bound >= total
    name = F.when(large, F.col(key)).otherwise(bundle)
    items = groups.groupBy(large.alias("alone"), name.alias("name")).agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * bound rows
    placed = schedule([(r["bytes"], (r["alone"], r["name"])) for r in items], n_shards)
    alone = spark.createDataFrame([(n, s) for (a, n), s in placed.items() if a] or [], f"{key} long, alone_shard int")
    small = spark.createDataFrame([(n, s) for (a, n), s in placed.items() if not a] or [], "bundle long, bundle_shard int")
    rows = rows.join(F.broadcast(alone), key, "left").withColumn("bundle", bundle).join(F.broadcast(small), "bundle", "left")
    rows = rows.withColumn("shard", F.coalesce("alone_shard", "bundle_shard")).drop("bundle", "alone_shard", "bundle_shard", key)
    n_ranges = max(LEAST_RANGES, total // (n_shards * RANGE_BYTES))
    rows = rows.withColumn(place, F.pmod(F.col(row), F.lit(n_ranges)))
    counts = rows.groupBy("shard", place).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", place, F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", place).orderBy(row, of["doc_id"]))
    out = rows.withColumn("inside", inside).join(starts, ["shard", place])
    out = out.withColumn("slot", (F.col("start") + F.col("inside") - 1).cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(*columns, *ADDED)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(documents, 8).drop("text")
