"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. ``target / size`` says how often its words are
needed: the whole part of that ratio is allocated to every document as certain
copies, the rest is a fixed-size sample. Documents are ranked by their random odds
divided by their inclusion odds, and the sample is the front of that ranking up to
the missing words. Inclusion probabilities grow with the square root of a
document's words, so long documents are preferred mildly. A document that would
pass the target ends the front; another front goes on behind it with
documents that still fit, and the last gap is filled by at most one document for
each power of two of size, the best ranked that fits. A document is repeated at
most ``max_epochs`` times.

No source is sorted: the end of a front is found by a histogram with a fixed
number of bins and by the values inside the last bin, each a pre-aggregated
shuffle of (source, bin) rows. What is summed as doubles is made of whole numbers,
so that reruns agree. What is decided per source is one
row, and documents are judged row by row against it; texts are not shuffled.

Defined results: a null or blank text has size 0 and takes 0 words; a null source
is a source, last in order; rows that repeat a doc_id share its random number and
are taken together; an empty table gives an empty table; the added columns replace
input columns of their names, others are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import apart, cut

WORD = "[^\\x20\\x09-\\x0D]+"
#: A source's documents are counted by this many bins of their order; the last of a front is looked up inside one bin.
BINS = 1 << 16
FRONTS = 2
WEIGHTS = (3, 1, 2)
#: With at most so many sources (about 600 bytes each) their plan is broadcast, and texts stay where they are read.
MOST_BROADCAST = 10_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that only doc_id and seed decide."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))
    return (F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """source, weight, source_size, target from (source, size) rows.

    Targets are ``level * weight`` or the cap, whichever is less. With sources in
    order of cap / weight, the level if the first k are capped rises up to the
    true k and falls after it, so the level is the largest of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum(F.floor(F.col("size") * F.sqrt(F.col("size").cast("double")) * 1024).cast("decimal(38,0)")).cast("double") / 1024).alias("mass"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("at", F.col("cap") / F.col("weight"))
    order = W.orderBy("at", "rank")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    per = per.withColumn("level", (whole - capped) / rest)
    per = per.withColumn("level", F.max("level").over(W.partitionBy()))
    return per.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("source", "weight", "source_size", "mass", "target")


def order_value(size: Column, u: Column, scale: Column) -> Column:
    """Random odds / inclusion odds, as q / (1 + q) in [0, 1]."""
    p = F.least(scale * F.sqrt(size.cast("double")), F.lit(1.0))
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, q / (1 + q)).otherwise(1.0)


def _same_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Rows with the plan of their source; a plan of ``few`` sources is broadcast."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _onto(plan: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("source", "found_source")
    return plan.join(found, F.col("source").eqNullSafe(F.col("found_source")), "left").drop("found_source")


def mixing_plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per source: source_size, target, whole copies, scale, fronts and fillers.

    A front (last, limit) takes the documents of at most ``limit`` words that rank
    up to ``last``. The first ends at the first document that would pass the
    target; the next goes on behind it with the documents that still fit.
    """
    plan = source_targets(sizes, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("scale", F.when(F.col("mass") > 0, F.col("gap") / F.col("mass")).otherwise(0.0)).withColumn("last", F.lit(-1.0))
    plan = cut(plan.withColumn("fronts", F.array().cast("array<struct<last:double,limit:double>>")))
    few = plan.count() <= MOST_BROADCAST
    ranked = _same_source(sizes.where("size > 0"), plan.select("source", "scale"), few)
    ranked = cut(ranked.withColumn("v", order_value(F.col("size"), uniform(F.col("doc_id"), seed), F.col("scale"))).where("v < 1").select("doc_id", "source", "size", "v"))
    for _ in range(FRONTS):
        plan = plan.withColumn("low", F.lit(0.0)).withColumn("width", F.lit(1.0)).withColumn("used", F.lit(0).cast("long"))
        for last in (False, True):
            rows = _same_source(ranked, plan.select("source", "low", "width", "used", "gap", "last"), few)
            rows = rows.where("size <= gap and v > last and v >= low and v < low + width")
            place = F.col("v") if last else F.least(F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("double")
            bins = rows.groupBy("source", place.alias("place")).agg(F.sum("size").alias("n"), F.first("used").alias("used"), F.first("gap").alias("room"))
            bins = bins.withColumn("run", F.sum("n").over(W.partitionBy("source").orderBy("place")) + F.col("used"))
            if last:  # the last value that still fits
                found = bins.where("run <= room").groupBy("source").agg(F.max("place").alias("place"), F.max("run").alias("new_used"))
                below = F.greatest(F.col("last"), F.col("low") * (1 - 2**-52))  # all of the bins before, none of this one
                plan = _onto(plan, found).withColumn("last", F.coalesce(F.col("place"), F.when(F.col("low") > 0, below), F.col("last")))
                plan = plan.withColumn("fronts", F.concat("fronts", F.array(F.struct("last", F.col("gap").alias("limit")))))
                plan = plan.withColumn("gap", F.col("gap") - F.coalesce("new_used", "used"))
            else:  # the first bin that passes the room; none: all bins fit
                found = bins.where("run > room").groupBy("source").agg(F.min("place").alias("place"), F.min_by(F.col("run") - F.col("n"), "place").alias("new_used"))
                step = F.col("width") / BINS
                plan = _onto(plan, found).withColumn("low", F.when(F.col("place").isNull(), F.col("low")).otherwise(F.col("low") + F.col("place") * step))
                plan = plan.withColumn("width", F.when(F.col("place").isNull(), F.col("width")).otherwise(step)).withColumn("used", F.coalesce("new_used", "used"))
            plan = cut(plan.drop("place", "new_used"))
    rows = _same_source(ranked, plan.select("source", "last", "gap"), few).where("v > last and size <= gap")
    kind = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    best = rows.groupBy("source", kind.alias("kind")).agg(F.min_by(F.struct("size", "v"), F.struct("v", "doc_id")).alias("doc"), F.first("gap").alias("gap"))
    zero = F.struct(F.first("gap").alias("gap"), F.array().cast("array<double>").alias("fillers"))
    gathered = best.groupBy("source").agg(F.reverse(F.sort_array(F.collect_list(F.struct("kind", "doc")))).alias("docs"), zero.alias("zero"))  # a row for each power of two
    fits = lambda acc, x: F.when(x["doc"]["size"] <= acc["gap"], F.struct((acc["gap"] - x["doc"]["size"]).alias("gap"), F.concat(acc["fillers"], F.array(x["doc"]["v"])).alias("fillers"))).otherwise(acc)
    fillers = gathered.select("source", F.aggregate("docs", F.col("zero"), fits, lambda acc: acc["fillers"]).alias("fillers"))
    plan = _onto(plan, fillers).withColumn("fillers", F.coalesce("fillers", F.array().cast("array<double>")))
    return cut(plan.select("source", "source_size", "target", "whole", "scale", "fronts", "fillers"))


def apply_plan(rows: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Adds source_size, target, copies and taken to rows that have doc_id, source and size."""
    out = _same_source(rows, plan, plan.count() <= MOST_BROADCAST)
    v = order_value(F.col("size"), uniform(F.col("doc_id"), seed), F.col("scale"))
    front = F.exists("fronts", lambda f: (v <= f["last"]) & (F.col("size") <= f["limit"]))
    extra = F.when((F.col("size") > 0) & (v < 1) & (front | F.array_contains("fillers", v)), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("whole") + extra).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("whole", "scale", "fronts", "fillers")


def mix_sources(documents: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """``documents`` with size, source_size, target, copies and taken; a copy count of 0 leaves a document out."""
    base, of, columns = apart(documents.drop(*ADDED))
    rows = base.withColumns({"doc_id": of["doc_id"], "source": of["source"], "size": word_count(of["text"])})
    plan = mixing_plan(cut(rows.select("doc_id", "source", "size")), weights, share, max_epochs, seed)
    return apply_plan(rows, plan, seed).select(*columns, *ADDED)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(documents).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(floor(size * sqrt(CAST(size AS DOUBLE)) * 1024) AS HUGEINT)) AS DOUBLE) / 1024 AS mass,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM per
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, least(cap, max(level) OVER () * weight) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    target - whole * source_size AS need, CASE WHEN mass > 0 THEN need / mass ELSE 0 END AS scale
  FROM targets
), valued AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.need, least(p.scale * sqrt(CAST(d.size AS DOUBLE)), 1.0) AS p,
    (u / (1 - u)) * ((1 - least(p.scale * sqrt(CAST(d.size AS DOUBLE)), 1.0)) / nullif(least(p.scale * sqrt(CAST(d.size AS DOUBLE)), 1.0), 0)) AS q
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN q / (1 + q) ELSE 1.0 END AS v FROM valued
__FRONTS__), gaps AS (
  SELECT source, max(room) - coalesce(sum(size) FILTER (c2), 0) AS gap, max(CASE WHEN c2 THEN v ELSE last1 END) AS last FROM front2 GROUP BY source
), best AS (
  SELECT f.source, CAST(floor(log2(size)) AS INT) AS kind, arg_min({'doc_id': doc_id, 'size': size}, (v, doc_id)) AS doc
  FROM front2 f JOIN gaps g ON f.source IS NOT DISTINCT FROM g.source
  WHERE size > 0 AND v > g.last AND size <= gap AND v < 1 GROUP BY ALL
), fill AS (
  SELECT source, 63 AS kind, CAST(gap AS DOUBLE) AS gap, CAST(NULL AS BIGINT) AS doc_id FROM gaps
  UNION ALL
  SELECT f.source, f.kind - 1, CASE WHEN b.doc.size <= f.gap THEN f.gap - b.doc.size ELSE f.gap END, CASE WHEN b.doc.size <= f.gap THEN b.doc.doc_id END
  FROM fill f LEFT JOIN best b ON f.source IS NOT DISTINCT FROM b.source AND b.kind = f.kind - 1
  WHERE f.kind > 0
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN c1 OR c2 OR doc_id IN (SELECT doc_id FROM fill WHERE doc_id IS NOT NULL) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM front2
"""

_FRONT = """), run{i} AS (
  SELECT *, size > 0 AND v < 1 AND v > last{h} AND size <= room AS in{i}, sum(CASE WHEN size > 0 AND v < 1 AND v > last{h} AND size <= room THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY v) AS run FROM {of}
), cut{i} AS (
  SELECT * EXCLUDE (run), coalesce(in{i} AND run <= room, false) AS c{i} FROM run{i}
), front{i} AS (
  SELECT * EXCLUDE (room), {room} AS room, max(CASE WHEN c{i} THEN v ELSE last{h} END) OVER (PARTITION BY source) AS last{i} FROM cut{i}
"""
OP5_SQL = OP5_SQL.replace(
    "__FRONTS__",
    "".join(
        _FRONT.format(i=i, h=i - 1, of=f"front{i - 1}" if i > 1 else "(SELECT *, need AS room, -1.0 AS last0 FROM ranked)", room="room" if i == FRONTS else f"room - coalesce(sum(size) FILTER (c{i}) OVER (PARTITION BY source), 0)")
        for i in range(1, FRONTS + 1)
    ),
)
