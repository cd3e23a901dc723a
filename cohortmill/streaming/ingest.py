"""Incremental ingest: new study files in; changed trials, their sites, criteria and run rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmill.operators.extract import extract
from cohortmill.sources.store import KeyedStore
from cohortmill.sources.studies import parse_studies, record_error, sites, study_hash, trial_snapshot

OUTCOME = "nct_id string, content_hash string, arrived_at timestamp, raw_json string, status string, error_message string"
NO_KEY = "\x00"  # begins the key of a record without a usable id; such keys are spread by content


def read_stream(spark: SparkSession, path: str, max_files: int = 1000, lines: bool = False) -> DataFrame:
    """Study files as a stream, one document per file, or per line with ``lines``."""
    return (
        spark.readStream.format("text").option("wholetext", str(not lines).lower()).option("maxFilesPerTrigger", max_files).load(path)
        .select(F.col("value").alias("raw_json"), F.col("_metadata.file_modification_time").alias("arrived_at"))
    )


def keyed(records: DataFrame) -> DataFrame:
    """Records with their id, content hash and, where they can't be read, an error."""
    parsed = parse_studies(records).withColumn("error_message", record_error())
    key = F.when(F.col("error_message").isNull(), F.col("s.protocolSection.identificationModule.nctId"))
    return parsed.select(
        F.coalesce(key, F.concat(F.lit(NO_KEY), F.xxhash64("raw_json").cast("string"))).alias("key"), study_hash().alias("content_hash"), "arrived_at", "raw_json", "error_message")


def outcomes(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Every record of a batch with its outcome: ingested, skipped, superseded or failed.

    Of the records of one key the newest (arrived_at, content_hash, raw_json; nulls lowest) is ingested or, when ``stored`` (nct_id,
    content_hash) has its hash, skipped; older ones are superseded. Records without a usable id fail and are not compared.
    """
    read = keyed(records)
    nct_id = F.when(F.col("error_message").isNull(), F.col("key")).alias("nct_id")
    newest = Window.partitionBy("key").orderBy(F.desc("arrived_at"), F.desc("content_hash"), F.desc("raw_json"))
    known = stored.select(F.col("nct_id").alias("key"), F.col("content_hash").alias("_known"))
    placed = read.withColumn("_place", F.row_number().over(newest)).join(known.hint("merge"), "key", "left")
    status = (
        F.when(F.col("error_message").isNotNull(), "failed").when(F.col("_place") > 1, "superseded")
        .when(F.col("_known") == F.col("content_hash"), "skipped").otherwise("ingested"))
    return placed.withColumn("status", status).select(
        nct_id, "content_hash", "arrived_at", F.when(F.col("status").isin("ingested", "failed"), F.col("raw_json")).alias("raw_json"), "status", "error_message")


def judged(records: DataFrame, store: str, batch_id: int) -> DataFrame:
    """Outcomes of a batch of records. What is remembered of a trial is the hash in its keyed row as the batches before this one
    left it, so a batch that is run again after a failure is judged as before."""
    spark = records.sparkSession
    return outcomes(records, KeyedStore(spark, f"{store}/keyed").read("trials", _empty(spark, trial_snapshot), before=batch_id))


def ingest_batch(batch: DataFrame, store: str, batch_id: int) -> None:
    """Store the outcomes of a batch, and of its ingested trials the snapshot, sites, criteria and run rows.

    Every append goes into a folder of its own batch id and overwrites it; trials and sites are also kept as keyed tables,
    committed last. A batch that is run again after a failure leaves the same rows.
    """
    spark = batch.sparkSession
    part = f"batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(f"{store}/outcomes/{part}")
    seen = spark.read.schema(OUTCOME).parquet(f"{store}/outcomes/{part}")
    seen.where("status = 'failed'").select("arrived_at", "raw_json", "error_message").write.mode("overwrite").parquet(f"{store}/failed/{part}")
    fresh = parse_studies(seen.where("status = 'ingested'").select("raw_json"))
    trials = trial_snapshot(fresh)
    trials.write.mode("overwrite").parquet(f"{store}/trials/{part}")
    written = spark.read.schema(trials.schema).parquet(f"{store}/trials/{part}")
    run_id = F.concat_ws("-", "nct_id", F.lit(str(batch_id)))
    criteria = extract(written.select("nct_id", F.col("eligibility_text").alias("text")), key="nct_id").drop("mentions")
    criteria.withColumn("run_id", run_id).write.mode("overwrite").parquet(f"{store}/criteria/{part}")
    counts = spark.read.parquet(f"{store}/criteria/{part}").groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_criteria"))
    runs = written.select("nct_id", "content_hash").join(counts, "nct_id", "left").select(
        run_id.alias("run_id"), "nct_id", "content_hash", F.lit("completed").alias("status"), F.coalesce("n_criteria", F.lit(0)).alias("n_criteria"))
    runs.write.mode("overwrite").parquet(f"{store}/runs/{part}")
    kept = KeyedStore(spark, f"{store}/keyed")
    kept.replace("trials", "nct_id", written, written, batch_id)
    kept.replace("sites", "nct_id", written, sites(fresh), batch_id)
    kept.commit(batch_id)


def stored_trials(spark: SparkSession, store: str) -> DataFrame:
    """Latest stored row per trial."""
    return KeyedStore(spark, f"{store}/keyed").read("trials", _empty(spark, trial_snapshot))


def stored_sites(spark: SparkSession, store: str) -> DataFrame:
    """Sites of the latest stored row of each trial."""
    return KeyedStore(spark, f"{store}/keyed").read("sites", _empty(spark, sites))


def _empty(spark: SparkSession, make):
    return make(parse_studies(spark.createDataFrame([], "raw_json string"))).schema


def start(spark: SparkSession, source: str, store: str, checkpoint: str, lines: bool = False):
    """Process everything that has arrived, then stop; run again (or on a schedule) for more."""
    return (
        read_stream(spark, source, lines=lines).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, i: ingest_batch(judged(df, store, i), store, i)).start()
    )
