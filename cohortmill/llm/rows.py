"""Row keys and stored intermediates shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.scale import work_dir

NO_ID = 2**63 - 1  # stands for a null id, after all others


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_key(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there and lost executors cost only their tasks."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashes(df: DataFrame, column: str, size: int, n: int | None = None) -> DataFrame:
    """The ``size`` rows with the least values of a 64-bit hash column: a bounded sample of the whole table, of ``n`` rows if known.

    Rows above a bound that some four times as many rows stay under are dropped first, so the tasks together hand on a few times ``size`` rows.
    """
    n = df.count() if n is None else n
    if n > 4 * size:
        df = df.where(F.col(column) < F.lit(int(-(2**63) + 2**64 * (4 * size / n))))
    return df.orderBy(*[F.col(column), *[F.col(c) for c in df.columns if c != column]]).limit(size)
