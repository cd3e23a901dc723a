"""Corpus pipeline: quality, near-duplicates, benchmark contamination, source mixture, shards.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns the columns of its input; the last
one returns the shards with their order.

All stages: an empty table gives no rows; columns beyond those that an operator reads are carried under other names, so none is replaced by an
operator's column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.ship import ship
from cohortmill.llm import decontaminate, minhash, mixing, quality, sharding
from cohortmill.llm.rows import NO_ID, new_path, text_of

WORDS, PERCENT = 5, 80
BUDGET, SEED = 0.5, 23
SHARDS = 8


def carried(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``read`` under names that no operator uses, and the columns that give the old table back."""
    names = {c: c if c in read else f"_carried{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects. Null or empty text is rejected; null source or lang is a value of its own;
    repeated rows are judged alike and all stay or go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    inner, back = carried(docs, "doc_id", "text", "source", "lang")
    return quality.judge_quality(inner, labels).where("accepted").select(back)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id (null after all others); of rows with the same id and text the least row.
    Documents without words all stay, null texts included."""
    ship(spark)
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), WORDS, PERCENT)
    out = groups.where("not first").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("r"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64(text_of("text")).alias("_hash"))
    left = keyed.join(out, ["_id", "_hash"], "left_anti")
    repeated = groups.where("first and n_shingles > 0").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("row_hash").alias("_hash")).count().where("count > 1")
    # an aggregate: each task hands on one row per key, however often a row is repeated
    one = left.join(repeated, ["_id", "_hash"], "left_semi").groupBy("_id", "_hash").agg(F.min("r").alias("r")).select("r")
    return left.join(repeated, ["_id", "_hash"], "left_anti").select("r").unionByName(one).select("r.*")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark windows cover at least one word in 20. Null and empty texts, and all documents beside an
    empty benchmark, stay; repeated rows all stay or go."""
    ship(spark)
    inner, back = carried(docs, "doc_id", "text")
    found = decontaminate.find_benchmark(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select(back)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights. Null source or lang is a value of its own; repeated rows share their draw."""
    inner, back = carried(docs, "doc_id", "text", "source", "lang")
    return mixing.mix_sources(inner, budget=BUDGET, seed=SEED).where("selected").select(back)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled shards, as written: columns of documents plus shard and slot, which replace columns of these names in any case.
    Null texts and repeated rows get slots of their own."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    inner, back = carried(docs.select(*[F.col(f"`{c}`") for c in keep]), "doc_id", "text")
    out = sharding.shuffle_shards(inner, shards=SHARDS)
    return out.select(*back, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first),
    ("decontamination", keep_clean),
    ("mixture", sample_mixture),
    ("shards", write_shards),
]

#: The classifier, the sketches and the shuffle have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
