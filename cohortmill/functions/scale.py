"""Shuffle shapes that keep hot keys and hot groups out of a single task."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

HOT_ROWS = 2_000_000   # a key above this many rows is split
HOT_KEYS = 64          # at most this many keys are split, so the list of them is safe to broadcast
SPLITS = 32
BROADCAST_ROWS = 200_000


def latest_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; nulls count as lowest.

    An aggregate of one struct: each map task keeps one row per key before the shuffle, so a key
    that owns a third of all rows costs one row per task.
    """
    named = [c.alias(f"o{i}") for i, c in enumerate(order)] + [F.col(c) for c in keep]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*named)).alias("_top"))
        .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in keep])
    )


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> dict[str, list]:
    """Values of each key column with more than ``hot_rows`` rows: one pre-aggregated pass, and at
    most HOT_KEYS values per column come back."""
    found: dict[str, list] = {}
    for key in keys:
        many = df.groupBy(F.col(key).alias("k")).count().where(F.col("count") > hot_rows).select(F.col("k").cast("string").alias("v"), "count")
        for row in many.orderBy(F.desc("count"), "v").limit(HOT_KEYS).collect():
            found.setdefault(key, []).append(row["v"])
    return found


def split_join(left: DataFrame, right: DataFrame, on: str, spread: list[str], hot: list, how: str = "inner") -> DataFrame:
    """Equi-join that spreads the listed hot keys over SPLITS sub-keys; a plain join when none is hot.

    Both sides are shuffled: the size of a stored table's files says little of its rows, and a broadcast of them would pass through the driver.
    Left rows of a hot key get a sub-key from a hash of ``spread`` and the matching right rows are
    copied to every sub-key. ``how`` may be inner, left or left_semi.
    """
    if not hot:
        return left.join(right.hint("merge"), on, how)
    is_hot = F.coalesce(F.col(on).cast("string").isin(*hot), F.lit(False))
    part = F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SPLITS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_part", part).join(right.withColumn("_part", F.explode(copies)).hint("merge"), [on, "_part"], how).drop("_part")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="cohortmill-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return base


def stage(df: DataFrame, *cluster: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read the same intermediate: it is computed once, the plan stays
    small, and a lost executor costs only its own tasks.
    """
    path = f"{work_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    out = df.repartition(*cluster) if cluster else df
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def barrier(df: DataFrame, *keep: str) -> DataFrame:
    """Same rows, but later filters are not copied down into the expressions that made the columns.

    Long derived columns would otherwise be repeated inside every pushed-down predicate. Columns in ``keep`` pass by: rows that lie
    by them are known to lie so afterwards.
    """
    if not keep:
        return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
    made = F.struct(*[c for c in df.columns if c not in keep])
    return df.select(*keep, F.explode(F.array(made)).alias("_row")).select(*[c if c in keep else f"_row.{c}" for c in df.columns])


def each(df: DataFrame, array: Column, place: str, name: str) -> DataFrame:
    """One row per element of ``array`` with its place; none where it is null or empty.

    Before an inner explode Spark filters by the size of the array and copies the array's whole expression down into that filter,
    once for every use of every column it is made of; after an outer one the rows are filtered by the place found.
    """
    return df.select("*", F.posexplode_outer(array).alias(place, name)).where(F.col(place).isNotNull())


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Size check before a broadcast: counts at most ``rows`` + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, small: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a dictionary: broadcast when it is within ``rows``, an ordinary shuffle join beyond."""
    return left.join(F.broadcast(small) if fits(small, rows) else small, on, how)


def two_level_rank(df: DataFrame, group: list[str], coarse: list[Column], order: list[Column], name: str) -> DataFrame:
    """Exact row_number within ``group`` without sorting a whole group in one task.

    ``coarse`` must be a non-decreasing function of ``order``. Rows are numbered inside each
    (group, coarse) cell; the sizes of the earlier cells of the group come from a small
    pre-aggregated table and are added. Only the cell counts of a group meet in one task.
    """
    cells = [f"_c{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(coarse, cells)])
    before = Window.partitionBy(*group).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(*group, *cells).count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*group, *cells).orderBy(*order)
    keys = [*group, *cells]
    ranked = tagged.withColumn("_in", F.row_number().over(inside))
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return ranked.join(sizes, same).select(
        *df.columns, (F.col("_in") + F.col("_before")).cast("int").alias(name)
    )


def range_rank(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Exact row_number within ``group`` by ascending ``order``, without one task per group.

    Rows are dealt by sampled ranges of (group, order), so a heavy group spans as many partitions as its size asks for; the dealt rows are
    stored with the number of their partition. Inside a (group, partition) cell rows are numbered by a window, and the sizes of a
    group's earlier cells (one row per cell) are added. Rows equal in all of ``order`` get adjacent numbers.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *[c.alias(k) for c, k in zip(order, keys)]).repartitionByRange(*group, *keys).withColumn("_cell", F.spark_partition_id())
    dealt = stage(dealt)
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*group, "_cell").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(k).alias(f"_g_{k}") for k in group], F.col("_cell").alias("_c"), "_before")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*keys)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in group] + [F.col("_cell") == F.col("_c")])
    return inside.join(sizes, same).select(*df.columns, (F.col("_in") + F.col("_before")).cast("int").alias(name))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; Spark keeps k rows per group and task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
