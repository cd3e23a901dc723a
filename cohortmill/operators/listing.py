"""Listing queries: filter, project, sort, page, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.operators.review import page


def search_trials(trials: DataFrame, status: str | None = None, condition: str | None = None,
                  phase: str | None = None) -> DataFrame:
    q = trials
    if status:
        q = q.where(F.col("status") == status)
    if condition:
        q = q.where(F.array_contains("conditions", condition))
    if phase:
        q = q.where(F.col("phase").ilike(f"%{phase}%"))
    return q


def trial_page(trials: DataFrame, page_no: int = 1, per_page: int = 20, **filters) -> DataFrame:
    return page(search_trials(trials, **filters), [F.desc("ingested_at"), F.asc("nct_id")], page_no, per_page)


def criteria_listing(current: DataFrame, type: str | None = None, category: str | None = None,
                     review_required: bool | None = None) -> DataFrame:
    q = current
    for name, value in (("type", type), ("category", category), ("review_required", review_required)):
        if value is not None:
            q = q.where(F.col(name) == value)
    return q


def run_page(runs: DataFrame, page_no: int = 1, per_page: int = 20, **filters) -> DataFrame:
    q = runs
    for name, value in filters.items():
        if value is not None:
            q = q.where(F.col(name) == value)
    return page(q, [F.desc("started_at"), F.desc("run_id")], page_no, per_page)


def patient_page(patients: DataFrame, page_no: int = 1, per_page: int = 20) -> DataFrame:
    return page(patients, [F.desc("created_at"), F.desc("patient_id")], page_no, per_page)


def trial_detail_counts(current: DataFrame) -> DataFrame:
    pending = F.col("review_required") & (F.col("review_status") == "pending")
    return current.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("criteria_total"), F.count_if(pending).alias("review_pending"))


def pipeline_status(runs: DataFrame, trials: DataFrame, criteria: DataFrame, latest: DataFrame) -> DataFrame:
    """Six scalar counts; each part is a single row before they are put side by side."""
    r = runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("status") == "completed").alias("completed"),
                 F.count_if(F.col("status") == "failed").alias("failed"))
    t = trials.agg(F.count(F.lit(1)).alias("total_trials"))
    live = criteria.join(latest.select("run_id"), "run_id", "left_semi")
    c = live.agg(F.count(F.lit(1)).alias("total_criteria"),
                 F.count_if(F.col("review_required") & (F.col("review_status") == "pending")).alias("review_pending"))
    one = F.lit(1).alias("_one")
    return r.select("*", one).join(t.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


def projection_breakdown(projections: DataFrame) -> DataFrame:
    """Counts by status and by resource type in one pass."""
    rows = projections.select(F.explode(F.array(
        F.struct(F.lit("status").alias("dimension"), F.col("projection_status").alias("value")),
        F.struct(F.lit("resource_type").alias("dimension"), F.coalesce("resource_type", F.lit("none")).alias("value")),
    )).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
