"""Keeping an engine's layers fresh from a stream of transactions.

Each batch is one version of the engine, which carries the batch's number: a batch that
is tried again makes none. Rows that repeat are dropped by state, as long after their
first arrival as is kept; one that comes later still changes nothing, since its id is
known. Late rows need no watermark: what a batch touches is recomputed whole, in the
months its rows belong to and in those their ids were in before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from monthwise.plans.engine import COLUMNS, Engine


def distinct_arrivals(stream: DataFrame, keep: str = "1 day") -> DataFrame:
    """The rows of a stream without those that repeat one that arrived less than ``keep`` before."""
    arrived = stream.select(*COLUMNS, F.current_timestamp().alias("arrived")).withWatermark("arrived", keep)
    return arrived.dropDuplicatesWithinWatermark(COLUMNS).drop("arrived")


def refresh(engine: Engine, stream: DataFrame, checkpoint: str, name: str = "transactions", keep: str = "1 day") -> StreamingQuery:
    """Apply what the stream has now, a version a batch. A new checkpoint needs a new name, since its numbers begin again."""
    rows = distinct_arrivals(stream, keep)
    return rows.writeStream.foreachBatch(lambda batch, number: None if batch.isEmpty() else engine.apply(batch, name, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
