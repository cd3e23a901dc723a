"""Keyed tables in hash buckets: an upsert writes new versions of the buckets it touches and leaves all other files alone."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeyedStore:
    """Tables below ``root``, each in ``buckets`` buckets of its key column.

    ``replace`` writes ``<table>/version=<v>/bucket=<b>`` for the buckets of the given keys only; ``commit`` then writes one marker for all
    tables of the version, last. Readers take of each bucket its newest committed version, so a job killed before its commit is
    invisible, and a version that is run again overwrites its own folder only. Old versions stay until they are deleted by age.
    Keep ``buckets`` such that one bucket is some hundred MB; it is fixed for the life of the store.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.touched: dict[str, list[int]] = {}

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("name string, bucket int, version long").option("recursiveFileLookup", "true").parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def versions(self, name: str, before: int | None = None) -> dict[int, int]:
        """{bucket: newest committed version}: at most ``buckets`` entries."""
        log = self._commits()
        if log is None:
            return {}
        log = log.where(F.col("name") == name)
        if before is not None:
            log = log.where(F.col("version") < before)
        return {r["bucket"]: r["v"] for r in log.groupBy("bucket").agg(F.max("version").alias("v")).collect()}

    def read(self, name: str, schema: T.StructType, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Current rows of a table, of the buckets ``only`` if given."""
        paths = [f"{self.root}/{name}/version={v}/bucket={b}" for b, v in sorted(self.versions(name, before).items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_row", T.BooleanType())])).parquet(*paths)
        return rows.where("_row").drop("_row")

    def replace(self, name: str, key: str, keys: DataFrame, rows: DataFrame, version: int) -> list[int]:
        """All rows of ``keys`` give way to ``rows`` (whose keys are among them); returns the buckets rewritten.

        A bucket that loses its last row keeps a marker row, so that its older version does not show through.
        """
        keys = keys.select(key).where(F.col(key).isNotNull())
        at = sorted(r[0] for r in keys.select(bucket_of(key, self.buckets).alias("b")).distinct().collect())
        self.touched[name] = at
        if at:
            kept = self.read(name, rows.schema, before=version, only=at).join(keys, key, "left_anti")
            full = kept.unionByName(rows).select(*rows.columns, F.lit(True).alias("_row"), bucket_of(key, self.buckets).alias("bucket"))
            marks = self.spark.createDataFrame([(b, False) for b in at], "bucket int, _row boolean")
            whole = full.unionByName(marks, allowMissingColumns=True).hint("rebalance", "bucket")
            whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/version={version}")
        return at

    def commit(self, version: int) -> None:
        rows = [(name, b, version) for name, at in sorted(self.touched.items()) for b in at]
        self.spark.createDataFrame(rows, "name string, bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{version}")
        self.touched = {}
