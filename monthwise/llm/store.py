"""Cutting lineage on storage that every executor can read."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a temporary one is set, which only a local session can share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="monthwise-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and write it to the shared folder; a lost executor loses none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, Column], list[Column]]:
    """``df`` with columns that clash with no working column, each by its old name, and the columns as they were."""
    inner = [f"in_{i}" for i in range(len(df.columns))]
    return df.toDF(*inner), {c.lower(): F.col(i) for c, i in zip(df.columns, inner, strict=True)}, [F.col(i).alias(c) for c, i in zip(df.columns, inner, strict=True)]


def from_text(df: DataFrame, added: list[StructField], start: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with columns that tasks compute from its text; other columns are carried whatever their names.

    ``start`` is called once in a task and gives the function from the texts of a
    batch to the added columns.
    """
    base, of, columns = apart(df.drop(*(f.name for f in added)))
    names = [*base.columns, *(f.name for f in added)]
    at = [c.lower() for c in df.drop(*(f.name for f in added)).columns].index("text")

    def computed(batches):
        compute = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch.column(at))], names)

    out = base.mapInArrow(computed, StructType([*base.schema.fields, *added]))
    return out.select(*columns, *(f.name for f in added))
