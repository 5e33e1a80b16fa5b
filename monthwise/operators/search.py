"""Keyword search by BM25, vector search by cosine, and their fusion by reciprocal ranks.

A query is a handful of terms or one vector: it is a literal of the plan, so the
texts and vectors are scanned once and only scores move. Top-k keeps k rows of
every partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthwise.functions import scalars

K1, B = 1.2, 0.75
RRF_K = 60


class Embedder(Protocol):
    """Turns texts into vectors; the engine itself has no language model."""

    def embed(self, texts: DataFrame, text: str) -> DataFrame: ...


class HashingEmbedder:
    """A deterministic stand-in: signed counts of hashed tokens, normalised."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: DataFrame, text: str = "content") -> DataFrame:
        width = self.width

        @F.pandas_udf("array<double>")
        def places(hashes: pd.Series) -> pd.Series:
            lists = [np.zeros(0, np.int64) if h is None else np.asarray(h, np.int64) for h in hashes]
            row, flat = np.repeat(np.arange(len(lists)), [len(h) for h in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
            out = np.bincount(row * width + flat % width, np.where((flat >> 32) % 2 == 0, 1.0, -1.0), len(lists) * width).reshape(-1, width)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return pd.Series(list(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)))

        return texts.withColumn("embedding", places(F.transform(scalars.tokens(F.col(text)), lambda t: F.xxhash64(t))))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, as ``scalars.tokens`` makes them."""
    import regex

    return list(dict.fromkeys(t for t in regex.findall(r"[\p{L}\p{N}]+", query.lower()) if len(t) > 1))


_WORD = r"[\p{L}\p{N}]"


def _frequency(lowered: Column, term: str) -> Column:
    """How often a term is a token of a text in lower case: its letters are looked for first, and then what stands around them."""
    return F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(f"{term}(?!{_WORD})(?<!{_WORD}{term})"))).otherwise(0)


def bm25(texts: DataFrame, query: str, n: int = 12, id_column: str = "id", content: str = "content") -> DataFrame:
    """id, score of the n best texts that hold a term; no term, no rows.

    One scan makes a row of numbers for each text: its tokens, and how often it has each
    term. These rows alone are dealt out, once: both their sums and the scores come from
    there, and nothing but the top-k's rows is shuffled behind.
    """
    terms = query_terms(query)
    spark = texts.sparkSession
    if not terms:
        return spark.createDataFrame([], f"{id_column} long, score double")
    text = F.lower(F.col(content))
    length = F.regexp_count(text, F.lit(f"{_WORD}{{2,}}"))
    counted = texts.select(F.col(id_column), length.alias("length"), *(_frequency(text, t).alias(f"tf{i}") for i, t in enumerate(terms))).repartition(F.col(id_column))
    # The sums name all columns, so that both readers of the rows are one exchange.
    known = F.when(F.col("length").isNotNull(), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    stats = counted.agg(F.count(known).alias("texts"), F.avg("length").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    scored = counted.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("texts") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    score = sum((part(i) for i in range(1, len(terms))), part(0))
    hits = reduce(lambda a, b: a + b, (F.col(f"tf{i}") for i in range(len(terms))))
    return scored.select(id_column, F.when(hits > 0, F.round(score, 6)).alias("score")).orderBy(F.desc_nulls_last("score"), id_column).limit(n).where("score is not null")


def cosine(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine with a literal vector; 0 for a vector of zeros, -1 for none."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    dot = F.aggregate(F.zip_with(embedding, wanted, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = own * norm
    return F.when(embedding.isNull(), -1.0).otherwise(dot / F.when(size > 0, size).otherwise(1.0))


def cosine_topk(vectors: DataFrame, query: Sequence[float], k: int = 10, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """id, score of the k vectors nearest to the query."""
    scored = vectors.select(id_column, F.round(cosine(F.col(embedding), query), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def fuse(semantic: DataFrame, keyword: DataFrame, n: int = 20, id_column: str = "id") -> DataFrame:
    """Reciprocal rank fusion of two result lists: id, score, source (semantic, keyword or both)."""
    place = F.row_number().over(W.orderBy(F.desc("score"), id_column))  # result lists of a few rows
    a = semantic.select(id_column, place.alias("a"))
    b = keyword.select(id_column, place.alias("b"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    source = F.when(F.col("a").isNull(), "keyword").when(F.col("b").isNull(), "semantic").otherwise("both")
    out = a.join(b, id_column, "full_outer").select(id_column, F.round(part("a") + part("b"), 8).alias("score"), source.alias("source"))
    return out.orderBy(F.desc("score"), id_column).limit(n)


def labelled(found: DataFrame, t: DataFrame, n_chars: int = 50) -> DataFrame:
    """Search results with what a reader needs of their transactions: a short description, the amount and its direction."""
    direction = F.when(F.col("amount") < 0, "debit").when(F.col("amount") > 0, "credit").otherwise("none")
    rows = F.broadcast(found).join(t, "id")  # found is a list of results
    return rows.select("id", "score", "source", "date", F.substring("description", 1, n_chars).alias("description"), "payee", F.abs("amount").cast("double").alias("amount"), direction.alias("direction")).orderBy(F.desc("score"), "id")
