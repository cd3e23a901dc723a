"""Review workflow: decisions, correction snapshots and the two queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Criterion fields a reviewer may correct (fixed list).
EDITABLE = [
    "type", "category", "primary_semantic_category", "secondary_semantic_tags", "parse_status", "operator",
    "value_low", "value_high", "value_text", "unit", "raw_expression", "negated", "timeframe_operator",
    "timeframe_value", "timeframe_unit", "specimen_type", "testing_modality", "disease_subtype",
    "histology_text", "assay_context", "exception_logic", "exception_entities", "allowance_text",
    "logic_group_id", "logic_operator", "coded_concepts", "confidence",
]


def correction_snapshot(columns: list[str]):
    """JSON pre-image of the editable fields that the table has."""
    kept = [c for c in [*EDITABLE, "source_sentence", "source_clause_text"] if c in columns]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def apply_decisions(criteria: DataFrame, latest: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(criteria after review, decisions refused).

    Only pending criteria of the latest run can be decided. Of several decisions for a criterion the first to arrive (column
    ``decided_at``, where there is one; ties by content) holds and the others are refused. A correction overwrites the fields
    named in ``corrected_fields``; their new values come from columns new_<field>.
    """
    cols = criteria.columns
    used = [
        "action", "reviewed_by", "review_notes", "corrected_fields",
        *[c for c in decisions.columns if c.startswith("new_")],
    ]
    arrived = ["decided_at"] if "decided_at" in decisions.columns else []
    whole = F.struct(*[F.col(c) for c in [*arrived, *used]])
    ranked = decisions.select("criterion_id", *used, F.row_number().over(Window.partitionBy("criterion_id").orderBy(whole)).alias("_nth"))
    d, late = ranked.where("_nth = 1").drop("_nth"), ranked.where("_nth > 1")
    joined = (
        criteria.join(latest.select("trial_id", F.col("run_id").alias("_latest")), "trial_id", "left")
        .join(d, "criterion_id", "left")
    )
    superseded = F.col("_latest").isNotNull() & (F.col("run_id") != F.col("_latest"))
    resolved = ~F.coalesce((F.col("review_status") == "pending") & F.col("review_required"), F.lit(False))
    asked = F.col("action").isNotNull()
    joined = joined.withColumn(
        "_conflict",
        F.when(asked & superseded, "superseded_run").when(asked & resolved, "already_resolved"),
    ).withColumn("_apply", asked & F.col("_conflict").isNull())
    out = []
    fix = F.col("_apply") & (F.col("action") == "correct")
    for c in cols:
        if c == "review_status":
            new = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "correct", "corrected").otherwise("rejected")
            out.append(F.when(F.col("_apply"), new).otherwise(F.col(c)).alias(c))
        elif c == "review_required":
            out.append(F.when(F.col("_apply"), F.lit(False)).otherwise(F.col(c)).alias(c))
        elif f"new_{c}" in d.columns:
            out.append(F.when(fix & F.array_contains("corrected_fields", c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    reviewed = joined.select(
        *out,
        F.when(F.col("_apply"), F.col("reviewed_by")).alias("reviewed_by"),
        F.when(F.col("_apply"), F.col("review_notes")).alias("review_notes"),
        F.when(fix, correction_snapshot(cols)).alias("original_extracted"),
    )
    missing = d.join(criteria.select("criterion_id"), "criterion_id", "left_anti").select(
        "criterion_id", "action", F.lit("not_found").alias("conflict"))
    refused = joined.where(F.col("_conflict").isNotNull()).select("criterion_id", "action", F.col("_conflict").alias("conflict"))
    known = late.join(criteria.select("criterion_id"), "criterion_id", "left_semi").select(
        "criterion_id", "action", F.lit("already_resolved").alias("conflict"))
    return reviewed, refused.unionByName(missing).unionByName(known)


def criterion_queue(criteria: DataFrame, latest: DataFrame, reason: str | None = None, trial_id=None) -> DataFrame:
    """Pending criteria of the latest runs. Criteria of trials without a completed run are not queued."""
    q = criteria.where(F.col("review_required") & (F.col("review_status") == "pending"))
    if reason is not None:
        q = q.where(F.col("review_reason") == reason)
    if trial_id is not None:
        q = q.where(F.col("trial_id") == trial_id)
    return q.join(latest.select("run_id"), "run_id", "left_semi")


def match_queue(items: DataFrame, latest: DataFrame, trials: DataFrame, reason: str | None = None,
                trial_id=None, patient_id=None) -> DataFrame:
    q = items
    for name, value in (("reason_code", reason), ("trial_id", trial_id), ("patient_id", patient_id)):
        if value is not None:
            q = q.where(F.col(name) == value)
    names = trials.select("trial_id", "nct_id", "brief_title")
    return q.join(latest.select("match_run_id"), "match_run_id", "left_semi").join(names, "trial_id").withColumn(
        "review_required", F.col("bucket") == "review_required")


def breakdown(queue: DataFrame, column: str) -> DataFrame:
    name = F.when(F.length(column) > 0, F.col(column)).otherwise("unknown")
    return queue.groupBy(name.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def page(df: DataFrame, order: list, page_no: int = 1, per_page: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((page_no - 1) * per_page).limit(per_page)
