"""The prefix trie of conversations: chained digests, a node for each distinct prefix, sums over subtrees.

A turn is hashed to its code where it is read; only codes and word counts move on. A
prefix's digest is the SHA-256 of the digest before it and the turn's code, so equal
digests are equal sequences of turns. Nodes are the groups of (depth, digest).

A node belongs to its smallest member. The nodes of one owner are one path that ends
with the owner's conversation, since the owner's next prefix has no smaller member. So a
subtree is the rest of its path and what hangs below: each path is exploded to the paths
above it, and adds its sums where it leaves them. A conversation passes the nodes of
each path above it, so these rows are never more than the turns, where node times
ancestor would grow with the square of the depth.

No conversation, prefix or path is one task's work: turns are numbered in ranges of
(conv_id, turn), so a long conversation spans tasks, whose counts are added up; digests
are chained in BLOCK turns apiece and then over blocks; sums along a path likewise;
members of a node meet in SPAN ids apiece before their list is hashed in a stream. Only
what is sequential by its nature, one block digest after the other and a SHA-256 over a
node's list, is done in sequence, a row for each block or span.

Defined results: rows with a null conv_id take no part; turns are ordered by turn (null
first), and equal turns by their code; a repeated row is a turn of its own; null roles
and texts are empty; other columns are not carried; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that are chained, and nodes of a path that are summed, in one go; ids of a node that are joined in one go.
BLOCK, SPAN = 1024, 4096


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with the task and the place in their conversation inside the task."""
    task, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for conv in batch.column(0).to_pylist():
            at = at + 1 if conv == last else 1
            last = conv
            places.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64())], ["conv_id", "code", "words", "task", "at"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), code and words of every turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hashed = lambda c: F.sha2(text(c).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(hashed("role"), hashed("text")).cast("binary"), 256)).alias("code"),
        F.regexp_count(text("text"), F.lit(WORD)).cast("long").alias("words"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "code"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "code", "words")
    rows = cut(rows.mapInArrow(_numbered, "conv_id long, code binary, words long, task long, at long"))
    # A task shares its first and its last conversation with its neighbours at most, so at most two rows a task are broadcast.
    pieces = rows.groupBy("conv_id", "task").agg(F.max("at").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shared = pieces.withColumn("before", F.sum("n").over(before)).where("before is not null").drop("n")
    rows = rows.join(F.broadcast(shared), ["conv_id", "task"], "left")
    return rows.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "code", "words")


def _chained(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``code`` replaced by the digest of the chain up to it, inside ``keys`` by ``order``."""
    kept = [*keys, order, "code", *(c for c in rows.columns if c not in (*keys, order, "code"))]
    n = len(keys)

    def chain(batches):
        last, digest = None, b""
        for batch in batches:
            out = []
            for *key, code in zip(*(c.to_pylist() for c in (*batch.columns[:n], batch.column(n + 1))), strict=True):
                digest = hashlib.sha256((digest if key == last else b"") + code).digest()
                last = key
                out.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(out, pa.binary()), *batch.columns[n + 2 :]], kept)

    rows = rows.select(*kept).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(chain, rows.schema)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words, digest of every prefix with a turn; ``turns`` has conv_id, depth from 1, code, words."""
    block = F.floor((F.col("depth") - 1) / BLOCK).cast("long")
    chained = cut(_chained(turns.withColumn("block", block), ["conv_id", "block"], "depth"))
    ends = chained.where(F.col("depth") % BLOCK == 0).select("conv_id", "block", "code")
    before = _chained(ends, ["conv_id"], "block").select("conv_id", (F.col("block") + 1).alias("block"), F.col("code").alias("before"))
    later = chained.where("block > 0").join(before, ["conv_id", "block"])
    later = later.withColumn("code", F.unhex(F.sha2(F.concat("before", "code"), 256)))
    columns = ["conv_id", "depth", "words", F.col("code").alias("digest")]
    return chained.where("block = 0").select(columns).unionByName(later.select(columns))


def _lists_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's list, whose spans come in order."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (owner, depth) == node:
                state.update(b",")
            else:
                done += [row()] if node else []
                node, state = (owner, depth), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if node:
        yield row()


def _ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256; ``members`` has the node (conv_id, depth) at which each ``member`` ends."""
    spans = members.withColumn("span", F.floor(F.col("member") / SPAN)).groupBy("conv_id", "depth", "span").agg(F.sort_array(F.collect_list("member")).alias("ids"))
    spans = spans.select("conv_id", "depth", "span", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    spans = spans.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "span")
    return spans.mapInArrow(_lists_hashed, "conv_id long, depth long, ends_sha256 string")


def _below(values: DataFrame) -> DataFrame:
    """``values`` (conv_id, depth, leaves, saved, ...) with leaves and saved summed from each depth to the path's end."""
    values = values.withColumn("block", F.floor(F.col("depth") / BLOCK).cast("long"))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    blocks = blocks.select("conv_id", "block", F.sum("l").over(deeper).alias("more_leaves"), F.sum("s").over(deeper).alias("more_saved")).where("more_leaves is not null")
    out = values.withColumn("leaves", F.sum("leaves").over(down)).withColumn("saved", F.sum("saved").over(down)).join(blocks, ["conv_id", "block"], "left")
    return out.withColumn("n_leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved") + F.coalesce("more_saved", F.lit(0)))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``turns`` (conv_id, depth from 1, code, words) of ``conversations`` (distinct conv_id, n_turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows = cut(prefixes(turns))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = cut(nodes.unionByName(root.select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))))
    top_owner = F.broadcast(root.select(F.col("conv_id").alias("root_id")))

    # The owner of every prefix: what one conversation has alone needs no look-up.
    shared = nodes.where("n_convs > 1 and depth > 0").select("depth", "digest", F.col("conv_id").alias("owner"))
    owned = cut(rows.join(shared.hint("merge"), ["depth", "digest"], "left").select("conv_id", "depth", F.coalesce("owner", "conv_id").alias("owner")))

    saved = (F.col("n_convs") - 1) * F.col("words")
    paths = cut(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("end"), F.sum(saved).alias("saved")))
    hung = paths.where("top > 0")
    above = owned.where("owner <> conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("at"))
    above = above.unionByName(hung.crossJoin(top_owner).select("conv_id", F.col("root_id").alias("owner"), F.lit(0).cast("long").alias("at")))
    above = cut(above.groupBy("conv_id", "owner").agg(F.max("at").alias("at")).join(hung, "conv_id"))  # copies own no path and add nothing
    parents = above.where("at = top - 1").select("conv_id", F.col("top").alias("depth"), F.col("owner").alias("parent"))

    hangs = parents.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    ends = paths.select("conv_id", F.col("end").alias("depth"), F.lit(1).cast("long").alias("is_end"))
    leaves = ends.join(hangs, ["conv_id", "depth"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    added = above.join(leaves, "conv_id", "left").groupBy(F.col("owner").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("hung_saved"), F.sum("leaf").alias("hung_leaves"), F.sum((F.col("at") == F.col("top") - 1).cast("long")).alias("hanging"))

    key, none = ["conv_id", "depth"], F.lit(0).cast("long")
    values = nodes.join(added, key, "left").join(ends, key, "left").join(parents, key, "left")
    values = values.withColumn("n_children", F.coalesce("hanging", none) + F.when(F.col("is_end").isNull(), 1).otherwise(0))
    values = values.withColumn("leaves", F.coalesce("hung_leaves", none) + (F.col("n_children") == 0).cast("long")).withColumn("saved", saved + F.coalesce("hung_saved", none))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    values = _below(values.select(*key, parent.alias("parent_conv_id"), "n_convs", "n_children", "leaves", "saved"))

    last = owned.groupBy("conv_id").agg(F.max(F.struct("depth", "owner")).alias("last")).select(F.col("last.owner").alias("conv_id"), "last.depth", F.col("conv_id").alias("member"))
    turnless = conversations.where("n_turns = 0").crossJoin(top_owner).select(F.col("root_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    out = values.join(_ends(last.unionByName(turnless)), key, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text)."""
    turns = ordered_turns(conversations).withColumnRenamed("place", "depth")
    return trie(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations with each first h turns taken from the conversation ``conv_id - conv_id % every``; h is crc32(conv_id) % most.

    Of a base at most ``most`` - 1 turns are looked up, by fewer than 2 * ``every`` conversations.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "code", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNull(), F.array()).otherwise(F.slice("head", 1, F.col("h").cast("int"))))
    convs = cut(convs.select("conv_id", "head", F.size("head").cast("long").alias("got"), "h", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")))
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.code", "t.words")
    short = convs.where("got < h").select("conv_id", (F.col("got") - F.col("h")).alias("shift"))
    own = turns.where(F.col("place") > h).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("depth"), "code", "words")
    return taken.unionByName(own), convs.select("conv_id", "n_turns")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*shared_heads(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC_BYTE = "list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
#: Every node is joined to every prefix of its owner.
OP11_SQL = f"""
WITH coded AS (
  SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS code, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS place FROM coded
), counts AS (
  SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda s, c: {_CRC_BYTE}), 4294967295) % 4 AS h
  FROM counts
), rebuilt AS (
  SELECT c.conv_id, t.place AS depth, t.code, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, t.place - c.h + least(c.h, coalesce(b.n, 0)), t.code, t.words
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h LEFT JOIN counts b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, depth, words, sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS digest FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT depth, digest, min(conv_id) AS owner, count(*) AS n_convs, max(words) AS words FROM prefixes GROUP BY ALL
), owned AS (
  SELECT p.conv_id, p.depth, n.owner FROM prefixes p JOIN nodes n USING (depth, digest)
), placed AS (
  SELECT n.*, o.owner AS parent FROM nodes n LEFT JOIN owned o ON o.conv_id = n.owner AND o.depth = n.depth - 1
), children AS (
  SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children FROM placed p LEFT JOIN children USING (owner, depth)
), sums AS (
  SELECT o.owner, o.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM full_nodes n JOIN owned o ON o.conv_id = n.owner AND o.depth <= n.depth GROUP BY ALL
), ends AS (
  SELECT owner, depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM owned) WHERE depth = last GROUP BY ALL
)
SELECT n.owner AS conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums s USING (owner, depth) LEFT JOIN ends e USING (owner, depth)
"""
