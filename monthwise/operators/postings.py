"""A stored keyword index: postings dealt by token, with lengths and counts that merge.

A posting is (token, id, tf, length of the text). Tokens are dealt to BUCKETS folders, so a
question reads the buckets of its own tokens; how many texts there are and how many
tokens they have is kept by month and added up. Scores are those of ``search.bm25``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthwise.functions import scalars

from .search import B, K1, query_terms

BUCKETS = 32


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame, content: str = "content") -> DataFrame:
    """The other columns of ``texts`` (an id is among them) with token, length and tf, a row for each distinct token of a text.

    A text's tokens are counted in the task that reads it; what is dealt out is a row for each of its distinct tokens.
    """
    kept = [c for c in texts.columns if c != content]
    rows = texts.select(*kept, scalars.tokens(F.col(content)).alias("tokens"))
    rows = rows.select(*kept, F.size("tokens").cast("long").alias("length"), F.explode("tokens").alias("token"))
    return rows.groupBy(*kept, "token", "length").agg(F.count(F.lit(1)).alias("tf"))


def text_stats(texts: DataFrame, *by: str, content: str = "content") -> DataFrame:
    """texts and tokens of each group; texts that are null count for nothing."""
    return texts.where(F.col(content).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size(scalars.tokens(F.col(content)))).cast("long").alias("tokens"))


def search(index: DataFrame, stats: DataFrame, query: str, n: int = 12) -> DataFrame:
    """id, score of the n best texts; ``index`` has token, id, tf, length (and bucket, where it is stored), ``stats`` texts and tokens."""
    terms = query_terms(query)
    if not terms:
        return index.sparkSession.createDataFrame([], "id long, score double")
    own = index.where(F.col("token").isin(*terms))
    if "bucket" in index.columns:
        numbers = index.sparkSession.range(1).select(*(bucket(F.lit(t)) for t in terms)).first()
        own = own.where(F.col("bucket").isin(*set(numbers)))
    held = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row a term
    whole = stats.agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))  # one row
    rows = own.join(F.broadcast(held.crossJoin(whole)), "token")
    idf = F.log(1 + (F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("tokens") / F.col("texts"))))
    return rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)
