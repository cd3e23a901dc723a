"""Change detection and versioned-run operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.functions.scale import latest_by


def unchanged(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming rows whose (key, hash) is already stored."""
    return incoming.join(current.select("nct_id", "content_hash"), ["nct_id", "content_hash"], "left_semi")


def changed(incoming: DataFrame, current: DataFrame) -> DataFrame:
    return incoming.join(current.select("nct_id", "content_hash"), ["nct_id", "content_hash"], "left_anti")


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """Newest row per key over the stored and the incoming rows; incoming wins a tie."""
    both = current.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    keep = [c for c in current.columns if c != key]
    return latest_by(both, [key], [F.col(stamp), F.col("_src")], keep).select(*current.columns)


def latest_completed_runs(runs: DataFrame) -> DataFrame:
    """Latest completed run per trial: finished desc nulls last, started desc, id desc."""
    return latest_by(
        runs.where(F.col("status") == "completed"),
        ["trial_id"],
        [F.col("finished_at"), F.col("started_at"), F.col("run_id")],
        ["run_id"],
    )


def latest_completed_runs_for_matching(runs: DataFrame) -> DataFrame:
    """As above, but a missing finish time falls back to the start time."""
    return latest_by(
        runs.where(F.col("status") == "completed"),
        ["trial_id"],
        [F.coalesce("finished_at", "started_at"), F.col("started_at"), F.col("run_id").cast("string")],
        ["run_id"],
    )


def latest_completed_match_runs(match_runs: DataFrame) -> DataFrame:
    return latest_by(
        match_runs.where(F.col("status") == "completed"),
        ["patient_id"],
        [F.col("completed_at"), F.col("created_at"), F.col("match_run_id")],
        ["match_run_id"],
    )


def current_criteria(criteria: DataFrame, latest: DataFrame) -> DataFrame:
    """Criteria of the trial's latest completed run, or all of them when none completed."""
    pick = latest.select("trial_id", F.col("run_id").alias("latest_run_id"))
    return (
        criteria.join(pick.hint("merge"), "trial_id", "left")
        .where(F.col("latest_run_id").isNull() | (F.col("run_id") == F.col("latest_run_id")))
    )


def run_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Set difference of distinct texts between two runs, per key, with the raw row counts."""
    # Distinct texts and their multiplicities in one pre-aggregated pass per side.
    o = old.groupBy(key, text).agg(F.count(F.lit(1)).alias("_old"))
    n = new.groupBy(key, text).agg(F.count(F.lit(1)).alias("_new"))
    return (
        o.join(n, [key, text], "full_outer")
        .groupBy(key)
        .agg(
            F.count_if(F.col("_old").isNull()).alias("added"),
            F.count_if(F.col("_new").isNull()).alias("removed"),
            F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("unchanged"),
            F.coalesce(F.sum("_old"), F.lit(0)).cast("long").alias("previous_count"),
            F.coalesce(F.sum("_new"), F.lit(0)).cast("long").alias("new_count"),
        )
    )


def next_versions(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Number incoming documents after the highest stored version of their key."""
    top = stored.groupBy(key).agg(F.max("version").alias("_top"))
    new = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(top, key, "left")
    return new.select(
        key,
        (F.coalesce("_top", F.lit(0)) + 1).cast("long").alias("first_version"),
        (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long").alias("last_version"),
    )


def version_rows(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Version of every stored document: its place in creation order within the key."""
    return docs.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def ingest_outcomes(batch: DataFrame) -> DataFrame:
    """Per-record outcome of a batch; a bad record fails alone.

    ``batch`` carries nct_id, error (null when parsed) and unchanged (boolean).
    """
    no_key = F.col("nct_id").isNull() | (F.length("nct_id") == 0)
    error = F.when(no_key, "Search result missing NCT ID").otherwise(F.col("error"))
    return batch.withColumn("error_message", error).withColumn(
        "status",
        F.when(F.col("error_message").isNotNull(), "failed").when(F.col("unchanged"), "skipped").otherwise("ingested"),
    )


def outcome_rollup(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "ingested").alias("ingested"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
