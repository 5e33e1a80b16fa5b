"""A dictionary of payees by the letter pairs of their words, for names that are not written as in the statement.

An entry is a run of up to RUN words of a payee without blanks and marks. It stands
under each of its letter pairs, ends included. A name is looked up by its own pairs: an
edit destroys two of them at most, so what shares enough pairs is compared letter by
letter, and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN, PREFIX, BUCKETS = 4, 5, 16
#: How a name is found, the best way first.
SAME, EDITED, BEGINS = 0, 1, 2


def _runs(text: Column) -> Column:
    """Runs of up to RUN words, each without blanks, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(words) - i + 1)), lambda k: F.array_join(F.slice(words, i, k), ""))
    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), of))))


def _pairs(entry: Column) -> Column:
    whole = F.concat(F.lit("^"), entry, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - 1), lambda i: F.substr(whole, i, F.lit(2))))


def bucket(pair: Column) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).cast("int")


def dictionary(payees: DataFrame) -> DataFrame:
    """pair, entry and the columns of ``payees`` (payee among them)."""
    rows = payees.where("payee <> ''").select("*", F.explode(_runs(F.col("payee"))).alias("entry")).where(F.length("entry") > 1)
    return rows.select("*", F.explode(_pairs(F.col("entry"))).alias("pair"))


def like(index: DataFrame, names) -> DataFrame:
    """name, payee, way, distance: the payees each name means, found the best way there is.

    The longest part of a name that is an entry counts, else one that differs by an edit (two in
    long ones), else entries that begin with the same PREFIX letters.
    """
    spark = index.sparkSession
    asked = spark.createDataFrame([(n,) for n in names], "name string").select("name", F.explode(_runs(F.col("name"))).alias("run"))
    asked = asked.where(F.length("run") > 1).withColumn("pairs", _pairs(F.col("run")))
    edits = F.when(F.length("run") < 4, 0).when(F.length("run") < 9, 1).otherwise(2)
    asked = asked.withColumn("edits", edits).withColumn("needed", F.least(F.size("pairs") - 2 * F.col("edits"), F.lit(PREFIX)))
    pairs = asked.select("name", "run", "edits", "needed", F.explode("pairs").alias("pair")).withColumn("bucket", bucket(F.col("pair")))
    own = index
    if "bucket" in index.columns:
        own = index.where(F.col("bucket").isin(*(r[0] for r in pairs.select("bucket").distinct().collect()))).drop("bucket")  # BUCKETS at most
    shared = own.join(F.broadcast(pairs.drop("bucket")), "pair").groupBy("name", "run", "edits", "needed", "entry", "payee").agg(F.count_distinct("pair").alias("shared"))
    found = shared.where("shared >= needed").withColumn("distance", F.levenshtein("run", "entry"))
    begins = (F.length("run") >= PREFIX) & (F.substring("run", 1, PREFIX) == F.substring("entry", 1, PREFIX))
    found = found.withColumn("way", F.when(F.col("distance") == 0, SAME).when(F.col("distance") <= F.col("edits"), EDITED).when(begins, BEGINS)).where("way is not null")
    # Parts of a name that are common words of few letters say nothing beside a longer part.
    best = W.partitionBy("name").orderBy("way", F.desc(F.length("run")), F.when(F.col("way") == EDITED, F.col("distance")).otherwise(0))
    found = found.withColumn("place", F.rank().over(best)).where("place = 1")
    return found.groupBy("name", "payee").agg(F.min("way").alias("way"), F.min("distance").alias("distance"))
