"""Gap buckets, review items and the one-off backfills of older result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.functions import logic as L

BUCKETS = ["hard_blockers", "clarifiable_blockers", "missing_data", "review_required", "unsupported"]
FOLLOW_UP = ["review_required", "missing_data", "clarifiable_blockers", "unsupported"]
KIND = {"hard_blockers": "hard_blocker", "clarifiable_blockers": "clarifiable_blocker"}
HISTORICAL_TEXT = "Gap report was not snapshotted for this historical match result."
UNVERIFIABLE = "legacy_state_unverifiable"


def gap_bucket(outcome: Column, state: Column, state_reason: Column, missing: Column) -> Column:
    """Ordered rules to one of five buckets, or null."""
    legacy = F.coalesce(state_reason == UNVERIFIABLE, F.lit(False))
    negative = outcome.isin("not_matched", "triggered")
    return (
        F.when(state == "blocked_unsupported", "unsupported")
        .when((outcome == "unknown") & legacy, "review_required")
        .when((outcome == "requires_review") | (state == "review_required"), "review_required")
        .when((outcome == "unknown") & missing, "missing_data")
        .when(negative & (state == "structured_safe"), "hard_blockers")
        .when(negative, "clarifiable_blockers")
        .when(outcome == "unknown", "review_required")
        .when((state == "structured_low_confidence") & outcome.isin("matched", "not_triggered"), "review_required")
    )


def label(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def bucket_kind(bucket: Column) -> Column:
    return (
        F.when(bucket == "hard_blockers", "hard_blocker")
        .when(bucket == "clarifiable_blockers", "clarifiable_blocker").otherwise(bucket)
    )


def gap_entries(effective: DataFrame) -> DataFrame:
    """Effective rows as long gap-report entries with their place in the bucket.

    The ordinal counts rows of one (patient, trial, bucket): at most the rules of one trial. Rows without an id that stand in
    one place are told apart by their values.
    """
    place = Window.partitionBy("patient_id", "trial_id", "bucket").orderBy(
        F.col("group_id").isNotNull(), "ord", "criterion_id", "group_id", "outcome", "state", "state_reason", "criterion_text", "display_category")
    bucket = gap_bucket(F.col("outcome"), F.col("state"), F.col("state_reason"), F.col("missing"))
    return (
        effective.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
        .withColumn("ordinal", F.row_number().over(place) - 1)
        .select(
            "patient_id", "trial_id", "bucket", "ordinal", bucket_kind(F.col("bucket")).alias("kind"),
            F.col("display_category").alias("category"), label(F.col("display_category")).alias("label"),
            "criterion_text", "outcome", "state", "state_reason",
        )
    )


def gap_payload(entries: DataFrame) -> DataFrame:
    """Nested report per pair: one array per bucket, in order (bounded by the rules of one trial)."""
    entry = F.struct("ordinal", "kind", "label", "category", "criterion_text", "outcome", "state", "state_reason")
    return entries.groupBy("patient_id", "trial_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))).alias(b) for b in BUCKETS
    ])


def report_entries(results: DataFrame) -> DataFrame:
    """Long entries (see ``gap_entries``) of the nested reports of results."""
    tagged = lambda b: F.transform(f"report.{b}", lambda e: F.struct(F.lit(b).alias("bucket"), e.alias("e")))
    rows = results.select("patient_id", "trial_id", F.explode(F.concat(*map(tagged, BUCKETS))).alias("x"))
    return rows.select("patient_id", "trial_id", "x.bucket", *[f"x.e.{c}" for c in ("ordinal", "kind", "category", "label", "criterion_text", "outcome", "state", "state_reason")])


def gap_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("patient_id", "trial_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])


def _filled(col: Column) -> Column:
    t = F.trim(col)
    return F.when(F.length(t) > 0, t)


def item_key(bucket: Column, ordinal: Column, category: Column, text: Column, reason: Column) -> Column:
    digest = F.sha1(F.concat_ws("\0", category, text, reason))
    return F.concat_ws(":", bucket, ordinal.cast("string"), F.substring(digest, 1, 12))


def review_items(entries: DataFrame) -> DataFrame:
    """Entries of the four follow-up buckets as review items with a deterministic key."""
    e = entries.where(F.col("bucket").isin(FOLLOW_UP)).withColumn(
        "reason_code", F.coalesce(_filled(F.col("state_reason")), _filled(F.col("kind")), F.col("bucket"))
    ).withColumn("category", F.coalesce(_filled(F.col("category")), F.lit("logic_group"))
    ).withColumn("criterion_text", F.coalesce(_filled(F.col("criterion_text")), F.lit(""))
    ).withColumn("state", F.coalesce(_filled(F.col("state")), F.lit("review_required")))
    keep = [c for c in entries.columns if c not in ("label", "kind", "ordinal")]
    return e.withColumn(
        "item_key",
        item_key(F.col("bucket"), F.col("ordinal"), F.col("category"), F.col("criterion_text"), F.col("reason_code")),
    ).select(*keep, "reason_code", "item_key")


def stored_group_rows(criteria: DataFrame) -> DataFrame:
    """Effective rows from persisted criterion rows, collapsing their OR groups.

    Needs match_result_id, ord, criterion_type, category, criterion_text, outcome, state,
    state_reason, missing, logic_group_id, logic_operator.
    """
    from cohortmill.operators.matching import _any_missing, _collapsed, _group_aggregates, with_group_bits

    in_group = F.coalesce((F.col("logic_operator") == "OR") & F.col("logic_group_id").isNotNull(), F.lit(False))
    base = ["match_result_id", "category", "criterion_text", "outcome", "state", "state_reason", "missing"]
    single = criteria.where(~in_group).select(*base, F.lit(None).cast("string").alias("group_id"))
    members = F.array_sort(F.collect_list(F.struct("ord", "criterion_text")))
    g = with_group_bits(criteria.where(in_group)).groupBy(
        "match_result_id", F.col("logic_group_id").cast("string").alias("group_id")
    ).agg(
        *_group_aggregates(),
        F.min(F.struct("ord", "criterion_type", "category")).alias("_first"),
        (F.min("category") == F.max("category")).alias("_one"),
        F.array_join(F.array_distinct(F.transform(members, lambda m: m["criterion_text"])), " OR ").alias("criterion_text"),
    ).withColumn("category", F.when(F.col("_one"), F.col("_first.category")).otherwise("logic_group"))
    outcome, rank = _collapsed(F.col("_first.criterion_type"))
    merged = g.withColumn("outcome", outcome).withColumn("_rank", rank).select(
        "match_result_id", "category", "criterion_text", "outcome",
        L.rank_to_state(F.col("_rank")).alias("state"), L.rank_to_reason(F.col("_rank")).alias("state_reason"),
        (_any_missing() | (F.col("category") == "concomitant_medication")).alias("missing"), "group_id",
    )
    return single.unionByName(merged)


def legacy_entries(results: DataFrame) -> DataFrame:
    """Synthetic gap entries (0 to 3) for results stored without a report."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    state = F.col("state")
    buckets = F.array_compact(F.array(
        F.when(state == "blocked_unsupported", "unsupported"),
        F.when((F.col("overall_status") == "ineligible") & n("unfavorable_count") & (state == "structured_safe"), "hard_blockers"),
        F.when(n("unknown_count") | n("requires_review_count") | ~state.isin("structured_safe", "blocked_unsupported"), "review_required"),
    ))
    return results.withColumn("bucket", F.explode(buckets)).select(
        *[c for c in results.columns if c not in ("state_reason", "outcome", "category", "criterion_text")],
        "bucket", bucket_kind(F.col("bucket")).alias("kind"), F.lit("Historical Snapshot").alias("label"),
        F.lit("historical_snapshot").alias("category"), F.lit(HISTORICAL_TEXT).alias("criterion_text"),
        F.coalesce(_filled(F.col("state_reason")), F.lit(UNVERIFIABLE)).alias("state_reason"),
        F.when(F.col("bucket") == "hard_blockers", "not_matched").otherwise("unknown").alias("outcome"),
    )


def explanation_partition(criteria: DataFrame) -> DataFrame:
    """Rows of the three overlapping explanation lists: matched, blockers, review_required."""
    o = F.col("outcome")
    lists = F.array_compact(F.array(
        F.when(o.isin("matched", "not_triggered"), "matched").when(o.isin("not_matched", "triggered"), "blockers"),
        F.when(o.isin("unknown", "requires_review") | (F.col("state") != "structured_safe"), "review_required"),
    ))
    return criteria.withColumn("label", label(F.col("category"))).withColumn("section", F.explode(lists))


def backfill_criterion_states(criteria: DataFrame) -> DataFrame:
    """State of older criterion rows from outcome, source and the evidence JSON."""
    ev = lambda k: _nonempty(F.get_json_object("evidence_payload", f"$.{k}"))
    status, reason = ev("review_status"), ev("review_reason")
    pending = (F.col("outcome") == "requires_review") | F.coalesce(status == "pending", F.lit(False))
    state = (
        F.when(F.col("source_type") == "structured", "structured_safe")
        .when(status == "rejected", "blocked_unsupported")
        .when(status.isin("accepted", "corrected"), "structured_safe")
        .when(pending, "review_required")
        .otherwise("structured_low_confidence")
    )
    return criteria.withColumn("state", state).withColumn(
        "state_reason",
        F.when(F.col("state") == "blocked_unsupported", "rejected")
        .when(F.col("state") == "review_required",
              F.concat(F.lit("review_required:"), F.coalesce(reason, F.lit("unspecified_review_reason"))))
        .when(F.col("state") == "structured_low_confidence", UNVERIFIABLE),
    )


def _nonempty(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def backfill_result_states(results: DataFrame, criteria: DataFrame) -> DataFrame:
    """State of older results from the states of their criterion rows."""
    s = F.col("state")
    flags = criteria.groupBy("match_result_id").agg(
        F.bool_or(s == "review_required").alias("_review"),
        F.bool_or(s == "blocked_unsupported").alias("_blocked"),
        F.bool_or((s == "structured_low_confidence") & F.coalesce(F.col("state_reason") == UNVERIFIABLE, F.lit(False))).alias("_legacy"),
    )
    no = F.lit(False)
    state = (
        F.when(F.coalesce("_review", no) | (F.coalesce("requires_review_count", F.lit(0)) > 0), "review_required")
        .when(F.coalesce("_blocked", no), "blocked_unsupported")
        .when(F.coalesce("_legacy", no), "structured_low_confidence")
        .otherwise("structured_safe")
    )
    old = [c for c in results.columns if c not in ("state", "state_reason")]
    return results.select(*old).join(flags, "match_result_id", "left").withColumn("state", state).withColumn(
        "state_reason",
        F.when(F.col("state") == "review_required", "review_required")
        .when(F.col("state") == "blocked_unsupported", "blocked_unsupported")
        .when(F.col("state") == "structured_low_confidence", UNVERIFIABLE),
    ).drop("_review", "_blocked", "_legacy")


def backfill_review_items(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Review items of older results: from their gap entries, else one historical item.

    ``entries`` are long gap entries keyed by match_result_id.
    """
    from_report = review_items(entries).select("match_result_id", "bucket", "category", "reason_code", "item_key")
    rest = results.join(from_report.select("match_result_id").distinct(), "match_result_id", "left_anti")
    state = F.coalesce(_filled(F.col("state")), F.lit("review_required"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    unresolved = n("unknown_count") | n("requires_review_count") | (state != "structured_safe")
    bucket = F.when(state == "blocked_unsupported", "unsupported").otherwise("review_required")
    reason = F.coalesce(_filled(F.col("state_reason")), F.lit(UNVERIFIABLE))
    historical = rest.where(unresolved).select(
        "match_result_id", bucket.alias("bucket"), F.lit("historical_snapshot").alias("category"), reason.alias("reason_code"),
        item_key(bucket, F.lit(0), F.lit("historical_snapshot"), F.lit(HISTORICAL_TEXT), reason).alias("item_key"),
    )
    return from_report.unionByName(historical)
