"""Coverage and corpus reports: one aggregation per report, only counters leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import logic as L

BUCKETS = ["hard_blockers", "clarifiable_blockers", "missing_data", "review_required", "unsupported"]


def _live(criteria: DataFrame, latest: DataFrame) -> DataFrame:
    state = L.criterion_state(F.col("review_status"), F.col("review_required"), F.col("confidence"))
    return (
        criteria.select("run_id", "category", "review_required", "review_reason", "review_status", "confidence")
        .join(latest.select("run_id"), "run_id", "left_semi")
        .withColumn("state", state)
        .withColumn("pending", F.coalesce(F.col("review_required") & (F.col("review_status") == "pending"), F.lit(False)))
    )


def extraction_overview(criteria: DataFrame, latest: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_count")
    totals = _live(criteria, latest).agg(
        F.count(F.lit(1)).alias("latest_run_criteria_count"), F.count_if(F.col("pending")).alias("review_pending_count"),
        n("structured_safe"), n("structured_low_confidence"), n("review_required"), n("blocked_unsupported"))
    trials = latest.agg(F.count(F.lit(1)).alias("latest_run_trial_count"))
    one = F.lit(1).alias("_one")
    return trials.select("*", one).join(totals.select("*", one), "_one").drop("_one")


def extraction_breakdowns(criteria: DataFrame, latest: DataFrame) -> DataFrame:
    """Pending reasons and blocked categories as (dimension, value, n) rows, in one pass."""
    none = F.lit(None).cast("string")
    reason = F.when(F.length("review_reason") > 0, F.col("review_reason")).otherwise("unspecified")
    rows = _live(criteria, latest).select(F.explode(F.array_compact(F.array(
        F.when(F.col("pending"), F.struct(F.lit("pending_reason").alias("dimension"), reason.alias("value"))),
        F.when(F.col("state") == "blocked_unsupported", F.struct(F.lit("blocked_category").alias("dimension"), F.col("category").alias("value"))),
    ))).alias("d"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


def matching_overview(results: DataFrame, latest: DataFrame) -> DataFrame:
    """Status and gap-bucket totals over the latest match runs.

    ``report`` is a struct of five arrays, null for results stored before reports existed; those
    count the entries the historical rules would give them.
    """
    has = F.col("report").isNotNull()
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    state = F.col("state")
    legacy = {
        "unsupported": state == "blocked_unsupported",
        "hard_blockers": (F.col("overall_status") == "ineligible") & n("unfavorable_count") & (state == "structured_safe"),
        "review_required": n("unknown_count") | n("requires_review_count") | ~state.isin("structured_safe", "blocked_unsupported"),
    }
    size = lambda b: F.when(has, F.when(F.col(f"report.{b}").isNotNull(), F.size(f"report.{b}")).otherwise(0)).otherwise(
        legacy[b].cast("int") if b in legacy else F.lit(0))
    return results.join(latest.select("match_run_id"), "match_run_id", "left_semi").agg(
        F.count(F.lit(1)).alias("total_match_results"), F.count_if(has).alias("persisted_gap_report_count"),
        F.count_if(~has).alias("legacy_match_count"),
        *[F.count_if(F.col("overall_status") == s).alias(s) for s in ("eligible", "possible", "ineligible")],
        *[F.sum(size(b)).alias(b) for b in BUCKETS],
    )


def corpus_report(criteria: DataFrame, projections: DataFrame) -> DataFrame:
    """Counters per fixture and in total (fixture null), criteria and projections side by side.

    ``criteria``: fixture, review_required, exportable, uncoded_accepted.
    ``projections``: fixture, projection_status, resource_type.
    """
    c = criteria.groupingSets([["fixture"], []], "fixture").agg(
        F.grouping("fixture").alias("is_total"), F.count(F.lit(1)).alias("criteria_count"),
        F.count_if("review_required").alias("review_required_count"),
        F.count_if("exportable").alias("structurally_exportable_count"),
        F.count_if("uncoded_accepted").alias("uncoded_but_accepted_count"))
    status = F.col("projection_status")
    p = projections.groupingSets([["fixture"], []], "fixture").agg(
        F.grouping("fixture").alias("is_total"),
        F.count_if(F.col("resource_type") == "MedicationStatement").alias("medication_statement_projected_count"),
        F.count_if(status == "blocked_missing_rxnorm").alias("blocked_missing_rxnorm_count"),
        F.count_if(status == "blocked_missing_class_code").alias("blocked_missing_class_code_count"),
        F.count_if(status == "review_required_ambiguous_class").alias("review_required_ambiguous_class_count"))
    names = [x for x in p.columns if x not in ("fixture", "is_total")]
    p = p.select(F.col("fixture").alias("_f"), F.col("is_total").alias("_t"), *names)
    return c.join(p, F.col("fixture").eqNullSafe(F.col("_f")) & (F.col("is_total") == F.col("_t")), "left").drop("_f", "_t").fillna(0, names)


def corpus_breakdowns(criteria: DataFrame, projections: DataFrame) -> DataFrame:
    """Category, review-reason, projection-status and blocked-term counts per fixture and in total."""
    reason = F.when(F.length("review_reason") > 0, F.col("review_reason")).otherwise("unspecified")
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    blocked = (F.col("projection_status") == "blocked_missing_class_code") & (F.length("normalized_term") > 0)
    rows = criteria.select("fixture", F.explode(F.array_compact(F.array(
        pair("category", F.col("category")), F.when(F.col("review_required"), pair("review_reason", reason))))).alias("d")).unionByName(
        projections.select("fixture", F.explode(F.array_compact(F.array(
            pair("projection_status", F.col("projection_status")), F.when(blocked, pair("blocked_term", F.col("normalized_term")))))).alias("d")))
    flat = rows.select("fixture", "d.dimension", "d.value")
    return flat.groupingSets([["fixture", "dimension", "value"], ["dimension", "value"]], "fixture", "dimension", "value").agg(
        F.grouping("fixture").alias("is_total"), F.count(F.lit(1)).alias("n"))


UNRESOLVED = ["blocked_missing_class_code", "review_required_ambiguous_class"]


def terminology_gaps(projections: DataFrame) -> DataFrame:
    """Unresolved class terms with occurrences and distinct fixtures."""
    p = projections.where(F.col("projection_status").isin(UNRESOLVED))
    return p.groupBy("projection_status", "normalized_term").agg(
        F.min("terminology_status").alias("terminology_status"), F.count(F.lit(1)).alias("occurrence_count"),
        F.countDistinct("fixture").alias("fixture_count"))


def terminology_gap_breakdown(projections: DataFrame) -> DataFrame:
    p = projections.where(F.col("projection_status").isin(UNRESOLVED))
    rows = p.select("projection_status", "normalized_term", F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), F.col("criterion_category").alias("value")),
        F.struct(F.lit("type").alias("dimension"), F.col("criterion_type").alias("value")))).alias("d"))
    return rows.groupBy("projection_status", "normalized_term", "d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


def terminology_gap_examples(projections: DataFrame, k: int = 3) -> DataFrame:
    """First k distinct examples of each gap (top-k per group, pruned before the shuffle)."""
    from cohortmill.functions.scale import top_k

    cols = ["fixture", "criterion_type", "criterion_category", "mention_text", "criterion_text"]
    p = projections.where(F.col("projection_status").isin(UNRESOLVED)).select("projection_status", "normalized_term", *cols).distinct()
    return top_k(p, ["projection_status", "normalized_term"], [F.col(c) for c in cols], k, "place")
