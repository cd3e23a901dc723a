"""Registered change-detection, listing, review and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.functions import text as T
from cohortmill.functions.scale import stage
from cohortmill.operators import listing as Li
from cohortmill.operators import reports as P
from cohortmill.operators import review as Rv
from cohortmill.operators import runs as R
from cohortmill.plans import evaluation_sql as S
from cohortmill.plans import views as V
from cohortmill.plans.registry import query

_LATEST = """latest AS (SELECT trial_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY trial_id
    ORDER BY finished_at DESC NULLS LAST, started_at DESC, run_id DESC) AS rn FROM pipeline_runs WHERE status = 'completed') WHERE rn = 1)"""
_LATEST_MATCH = """latest AS (SELECT patient_id, match_run_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
    ORDER BY completed_at DESC, created_at DESC, match_run_id DESC) AS rn FROM match_runs WHERE status = 'completed') WHERE rn = 1)"""
_CUR = f"""{_LATEST},
cur AS (SELECT c.* FROM criteria c LEFT JOIN latest l USING (trial_id) WHERE l.run_id IS NULL OR l.run_id = c.run_id)"""


def _latest(spark, sf):
    return R.latest_completed_runs(V.view(spark, sf, "pipeline_runs"))


# ----------------------------------------------------------- change detection

@query("c1_content_hash", """SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash FROM documents""")
def _(spark, sf):
    V.register(spark, sf)
    return spark.table("documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


# Two snapshots of the same source: the later one changed every third title and added some trials.
_SNAP = """base AS (SELECT nct_id, brief_title AS title, status, ingested_at FROM trials WHERE trial_id % 10 <> 0),
incoming AS (SELECT nct_id, CASE WHEN trial_id % 3 = 0 THEN brief_title || ' amended' ELSE upper(brief_title) || '  ' END AS title, status,
    ingested_at + CAST(400 AS INT) AS ingested_at FROM trials WHERE trial_id % 7 <> 0)"""


def _snapshots(spark, sf):
    V.register(spark, sf)
    out = []
    for n in ("base", "incoming"):
        d = spark.sql(f"WITH {V.ctes('trials')},\n{_SNAP} SELECT * FROM {n}")
        out.append(d.withColumn("content_hash", T.content_hash(F.concat_ws("|", T.squeeze(F.col("title")), "status"))))
    return out


_HASHED = _SNAP + """,
hb AS (SELECT *, sha256(lower(trim(regexp_replace(title, '\\s+', ' ', 'g')) || '|' || status)) AS content_hash FROM base),
hi AS (SELECT *, sha256(lower(trim(regexp_replace(title, '\\s+', ' ', 'g')) || '|' || status)) AS content_hash FROM incoming)"""


@query("c2_unchanged_skip", V.oracle_with("trials", _HASHED, "SELECT hi.nct_id, hi.title FROM hi WHERE NOT EXISTS (SELECT 1 FROM hb WHERE hb.nct_id = hi.nct_id AND hb.content_hash = hi.content_hash)"))
def _(spark, sf):
    base, inc = _snapshots(spark, sf)
    return R.changed(inc, base).select("nct_id", "title")


@query("c3_snapshot_upsert", V.oracle_with("trials", _HASHED, """SELECT nct_id, title, status, ingested_at FROM (
       SELECT *, row_number() OVER (PARTITION BY nct_id ORDER BY ingested_at DESC, src DESC) AS rn FROM (SELECT *, 0 AS src FROM hb UNION ALL SELECT *, 1 FROM hi)) WHERE rn = 1"""))
def _(spark, sf):
    base, inc = _snapshots(spark, sf)
    return R.upsert_latest(base, inc, "nct_id", "ingested_at").select("nct_id", "title", "status", "ingested_at")


@query("c4_latest_completed_run", V.oracle_with("pipeline_runs", _LATEST, "SELECT trial_id, run_id FROM latest"))
def _(spark, sf):
    return _latest(spark, sf)


@query("c5_latest_match_run", V.oracle_with("match_runs", _LATEST_MATCH, "SELECT patient_id, match_run_id FROM latest"))
def _(spark, sf):
    return R.latest_completed_match_runs(V.view(spark, sf, "match_runs"))


@query("c6_current_criteria", V.oracle_with("pipeline_runs criteria", _CUR, "SELECT criterion_id, trial_id, run_id FROM cur"))
def _(spark, sf):
    return R.current_criteria(V.criteria(spark, sf), _latest(spark, sf)).select("criterion_id", "trial_id", "run_id")


@query("c7_run_diff", V.oracle_with("pipeline_runs criteria", f"""{_LATEST},
o AS (SELECT c.trial_id, original_text, count(*) AS n FROM criteria c JOIN latest l ON l.trial_id = c.trial_id AND l.run_id = c.run_id GROUP BY 1, 2),
n AS (SELECT trial_id, original_text, count(*) AS n FROM criteria WHERE run_id % 2 = 0 GROUP BY 1, 2)""",
       """SELECT coalesce(o.trial_id, n.trial_id) AS trial_id, count(*) FILTER (WHERE o.n IS NULL) AS added, count(*) FILTER (WHERE n.n IS NULL) AS removed,
       count(*) FILTER (WHERE o.n IS NOT NULL AND n.n IS NOT NULL) AS unchanged, coalesce(sum(o.n), 0) AS previous_count, coalesce(sum(n.n), 0) AS new_count
       FROM o FULL JOIN n ON o.trial_id = n.trial_id AND o.original_text = n.original_text GROUP BY 1"""))
def _(spark, sf):
    c = V.criteria(spark, sf)
    old = c.join(_latest(spark, sf), ["trial_id", "run_id"], "left_semi")
    return R.run_diff(old, c.where(F.col("run_id") % 2 == 0), "trial_id", "original_text")


@query("c8_version_numbers", V.oracle("pipeline_runs", """SELECT run_id, trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY started_at, run_id) AS version
       FROM pipeline_runs WHERE status = 'completed'"""))
def _(spark, sf):
    docs = V.view(spark, sf, "pipeline_runs").where(F.col("status") == "completed")
    return R.version_rows(docs, "trial_id", ["started_at", "run_id"]).select("run_id", "trial_id", "version")


@query("c8_next_versions", V.oracle("pipeline_runs", """SELECT trial_id, CAST(coalesce(s.top, 0) + 1 AS BIGINT) AS first_version, CAST(coalesce(s.top, 0) + n AS BIGINT) AS last_version
       FROM (SELECT trial_id, count(*) AS n FROM pipeline_runs WHERE status = 'running' GROUP BY trial_id) i LEFT JOIN
         (SELECT trial_id, count(*) AS top FROM pipeline_runs WHERE status = 'completed' GROUP BY trial_id) s USING (trial_id)"""))
def _(spark, sf):
    """Running runs are the incoming documents, completed ones the stored."""
    runs = V.view(spark, sf, "pipeline_runs")
    kept = R.version_rows(runs.where(F.col("status") == "completed"), "trial_id", ["started_at", "run_id"])
    return R.next_versions(kept, runs.where(F.col("status") == "running"), "trial_id")


_BATCH = """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'NCT' || lpad(CAST(user_id AS STRING), 8, '0') END AS nct_id, props, value FROM events"""


@query("c9_ingest_outcomes", f"""WITH b AS ({_BATCH}),
p AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM b)
SELECT count(*) AS attempted, count(*) FILTER (WHERE status = 'ingested') AS ingested, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed
FROM (SELECT CASE WHEN nct_id IS NULL OR k IS NULL OR value < 1 THEN 'failed' WHEN k % 2 = 0 THEN 'skipped' ELSE 'ingested' END AS status FROM p)""")
def _(spark, sf):
    V.register(spark, sf)
    b = spark.sql(_BATCH).withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    b = b.withColumn("error", F.when(F.col("k").isNull() | (F.col("value") < 1), "Trial ingestion failed")).withColumn(
        "unchanged", F.col("k") % 2 == 0)
    return R.outcome_rollup(R.ingest_outcomes(b))


# --------------------------------------------------------------------- listing

@query("l1_trial_search", V.oracle("trials", """SELECT nct_id, brief_title, status, phase, ingested_at FROM trials
       WHERE status = 'RECRUITING' AND phase ILIKE '%phase1%' ORDER BY ingested_at DESC, nct_id LIMIT 50 OFFSET 50"""))
def _(spark, sf):
    t = V.view(spark, sf, "trials").withColumn("conditions", F.array("condition"))
    return Li.trial_page(t, 2, 50, status="RECRUITING", phase="phase1").select("nct_id", "brief_title", "status", "phase", "ingested_at")


@query("l1_trial_search_by_condition", V.oracle("trials", "SELECT condition, count(*) AS total FROM trials WHERE condition = 'ECONOMY' GROUP BY condition"))
def _(spark, sf):
    t = V.view(spark, sf, "trials").withColumn("conditions", F.array("condition"))
    return Li.search_trials(t, condition="ECONOMY").groupBy("condition").agg(F.count(F.lit(1)).alias("total"))


@query("l2_criteria_listing", V.oracle_with("pipeline_runs criteria", _CUR, "SELECT criterion_id, trial_id, category FROM cur WHERE type = 'inclusion' AND category = 'lab_value' AND NOT review_required"))
def _(spark, sf):
    cur = R.current_criteria(V.criteria(spark, sf), _latest(spark, sf))
    return Li.criteria_listing(cur, "inclusion", "lab_value", False).select("criterion_id", "trial_id", "category")


@query("l3_run_listing", V.oracle("pipeline_runs", "SELECT run_id, trial_id, status FROM pipeline_runs WHERE status = 'failed' ORDER BY started_at DESC, run_id DESC LIMIT 100"))
def _(spark, sf):
    return Li.run_page(V.view(spark, sf, "pipeline_runs"), 1, 100, status="failed").select("run_id", "trial_id", "status")


_PEOPLE = "seen AS (SELECT p.patient_id, sex, max(o_orderdate) AS created_at FROM patients p JOIN orders ON o_custkey = patient_id GROUP BY p.patient_id, sex)"


@query("l4_patient_listing", V.oracle_with("patients", _PEOPLE, "SELECT patient_id, sex FROM seen ORDER BY created_at DESC, patient_id DESC LIMIT 100"))
def _(spark, sf):
    V.register(spark, sf)
    return Li.patient_page(spark.sql(f"WITH {V.ctes('patients')},\n{_PEOPLE} SELECT * FROM seen"), 1, 100).select("patient_id", "sex")


@query("l5_trial_detail_counts", V.oracle_with("pipeline_runs criteria", _CUR, "SELECT trial_id, count(*) AS criteria_total, count(*) FILTER (WHERE review_required) AS review_pending FROM cur GROUP BY trial_id"))
def _(spark, sf):
    return Li.trial_detail_counts(R.current_criteria(V.criteria(spark, sf), _latest(spark, sf)))


@query("l6_pipeline_status", V.oracle_with("pipeline_runs trials criteria", _LATEST, """SELECT (SELECT count(*) FROM pipeline_runs) AS total_runs,
       (SELECT count(*) FROM pipeline_runs WHERE status = 'completed') AS completed, (SELECT count(*) FROM pipeline_runs WHERE status = 'failed') AS failed,
       (SELECT count(*) FROM trials) AS total_trials, (SELECT count(*) FROM criteria WHERE run_id IN (SELECT run_id FROM latest)) AS total_criteria,
       (SELECT count(*) FROM criteria WHERE review_required AND run_id IN (SELECT run_id FROM latest)) AS review_pending"""))
def _(spark, sf):
    return Li.pipeline_status(V.view(spark, sf, "pipeline_runs"), V.view(spark, sf, "trials"), V.criteria(spark, sf), _latest(spark, sf))


# ---------------------------------------------------------------------- review

_DEC = f"""{_LATEST},
d AS (SELECT criterion_id, CASE ord % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' ELSE 'reject' END AS action, value_low + 1 AS nv FROM criteria WHERE run_id % 2 = 0),
j AS (SELECT c.*, d.action, d.nv, CASE WHEN action IS NULL THEN NULL WHEN l.run_id IS NOT NULL AND l.run_id <> c.run_id THEN 'superseded_run'
    WHEN NOT review_required THEN 'already_resolved' END AS conflict FROM criteria c LEFT JOIN latest l USING (trial_id) LEFT JOIN d USING (criterion_id))"""


def _decided(spark, sf):
    d = V.view(spark, sf, "decisions").withColumn("review_notes", F.lit(None).cast("string")).withColumn("corrected_fields", F.array(F.lit("value_low")))
    return Rv.apply_decisions(V.criteria(spark, sf), _latest(spark, sf), d)


@query("r1_review_decisions", V.oracle_with("pipeline_runs criteria", _DEC, """SELECT criterion_id,
       CASE WHEN action IS NOT NULL AND conflict IS NULL THEN CASE action WHEN 'accept' THEN 'accepted' WHEN 'correct' THEN 'corrected' ELSE 'rejected' END ELSE review_status END AS review_status,
       CASE WHEN action IS NOT NULL AND conflict IS NULL THEN FALSE ELSE review_required END AS review_required,
       CASE WHEN action = 'correct' AND conflict IS NULL THEN nv ELSE value_low END AS value_low FROM j"""))
def _(spark, sf):
    return _decided(spark, sf)[0].select("criterion_id", "review_status", "review_required", "value_low")


@query("r1_review_conflicts", V.oracle_with("pipeline_runs criteria", _DEC, "SELECT criterion_id, action, conflict FROM j WHERE conflict IS NOT NULL"))
def _(spark, sf):
    return _decided(spark, sf)[1]


@query("r2_correction_snapshot", V.oracle_with("pipeline_runs criteria", _DEC, """SELECT criterion_id, category, value_low AS old_value_low, type AS old_type FROM j
       WHERE action = 'correct' AND conflict IS NULL"""))
def _(spark, sf):
    r = _decided(spark, sf)[0].where(F.col("original_extracted").isNotNull())
    j = lambda k: F.get_json_object("original_extracted", f"$.{k}")
    return r.select("criterion_id", j("category").alias("category"), j("value_low").cast("double").alias("old_value_low"), j("type").alias("old_type"))


@query("r3_criterion_queue", V.oracle_with("pipeline_runs criteria", _LATEST, """SELECT criterion_id, trial_id, review_reason FROM criteria
       WHERE review_required AND run_id IN (SELECT run_id FROM latest)"""))
def _(spark, sf):
    return Rv.criterion_queue(V.criteria(spark, sf), _latest(spark, sf)).select("criterion_id", "trial_id", "review_reason")


@query("r3_queue_breakdown", V.oracle_with("pipeline_runs criteria", _LATEST, """SELECT coalesce(review_reason, 'unknown') AS reason, count(*) AS n FROM criteria
       WHERE review_required AND run_id IN (SELECT run_id FROM latest) GROUP BY 1"""))
def _(spark, sf):
    return Rv.breakdown(Rv.criterion_queue(V.criteria(spark, sf), _latest(spark, sf)), "review_reason")


_ITEMS = """items AS (SELECT match_result_id, match_run_id, patient_id, trial_id, CASE WHEN state = 'blocked_unsupported' THEN 'unsupported' ELSE 'review_required' END AS bucket,
    coalesce(state_reason, 'low_confidence') AS reason_code FROM match_results WHERE state <> 'structured_safe')"""


def _items(spark, sf):
    m = V.table(spark, sf, "match_results").where(F.col("state") != "structured_safe")
    return m.select("match_result_id", "match_run_id", "patient_id", "trial_id",
                    F.when(F.col("state") == "blocked_unsupported", "unsupported").otherwise("review_required").alias("bucket"),
                    F.coalesce("state_reason", F.lit("low_confidence")).alias("reason_code"))


@query("r4_match_queue", V.oracle_with("match_results match_runs trials", f"{_ITEMS},\n{_LATEST_MATCH}", """SELECT match_result_id, nct_id, brief_title, bucket, reason_code,
       bucket = 'review_required' AS review_required FROM items JOIN trials USING (trial_id) WHERE match_run_id IN (SELECT match_run_id FROM latest)"""))
def _(spark, sf):
    latest = R.latest_completed_match_runs(V.view(spark, sf, "match_runs"))
    return Rv.match_queue(_items(spark, sf), latest, V.view(spark, sf, "trials")).select(
        "match_result_id", "nct_id", "brief_title", "bucket", "reason_code", "review_required")


@query("r4_match_queue_breakdown", V.oracle_with("match_results match_runs trials", f"{_ITEMS},\n{_LATEST_MATCH}", """SELECT reason_code AS reason, count(*) AS n FROM items
       JOIN trials USING (trial_id) WHERE match_run_id IN (SELECT match_run_id FROM latest) GROUP BY 1"""))
def _(spark, sf):
    latest = R.latest_completed_match_runs(V.view(spark, sf, "match_runs"))
    return Rv.breakdown(Rv.match_queue(_items(spark, sf), latest, V.view(spark, sf, "trials")), "reason_code")


# -------------------------------------------------------------------- coverage

_STATES = f"""{_LATEST},
st AS (SELECT *, CASE WHEN review_status = 'rejected' THEN 'blocked_unsupported' WHEN review_status = 'accepted' THEN 'structured_safe' WHEN review_required THEN 'review_required'
    WHEN confidence < 0.5 THEN 'structured_low_confidence' ELSE 'structured_safe' END AS state FROM criteria WHERE run_id IN (SELECT run_id FROM latest))"""


@query("p1_extraction_coverage", V.oracle_with("pipeline_runs criteria", _STATES, """SELECT (SELECT count(*) FROM latest) AS latest_run_trial_count, count(*) AS latest_run_criteria_count,
       count(*) FILTER (WHERE review_required) AS review_pending_count, count(*) FILTER (WHERE state = 'structured_safe') AS structured_safe_count,
       count(*) FILTER (WHERE state = 'structured_low_confidence') AS structured_low_confidence_count, count(*) FILTER (WHERE state = 'review_required') AS review_required_count,
       count(*) FILTER (WHERE state = 'blocked_unsupported') AS blocked_unsupported_count FROM st"""))
def _(spark, sf):
    return P.extraction_overview(V.criteria(spark, sf), _latest(spark, sf))


@query("p1_extraction_breakdowns", V.oracle_with("pipeline_runs criteria", _STATES, """SELECT 'pending_reason' AS dimension, coalesce(review_reason, 'unspecified') AS value, count(*) AS n FROM st WHERE review_required GROUP BY 2
       UNION ALL SELECT 'blocked_category', category, count(*) FROM st WHERE state = 'blocked_unsupported' GROUP BY 2"""))
def _(spark, sf):
    return P.extraction_breakdowns(V.criteria(spark, sf), _latest(spark, sf))


_MCOV = f"""{_LATEST_MATCH},
cur AS (SELECT * FROM match_results WHERE match_run_id IN (SELECT match_run_id FROM latest)),
b AS (SELECT *, CASE WHEN has_report THEN unknown_count ELSE CASE WHEN state = 'blocked_unsupported' THEN 1 ELSE 0 END END AS unsupported,
    CASE WHEN has_report THEN unfavorable_count ELSE CASE WHEN overall_status = 'ineligible' AND unfavorable_count > 0 AND state = 'structured_safe' THEN 1 ELSE 0 END END AS hard_blockers,
    CASE WHEN has_report THEN requires_review_count ELSE CASE WHEN unknown_count > 0 OR requires_review_count > 0 OR state NOT IN ('structured_safe', 'blocked_unsupported') THEN 1 ELSE 0 END END AS review_required FROM cur)"""


@query("p2_matching_coverage", V.oracle_with("match_results match_runs", _MCOV, """SELECT count(*) AS total_match_results, count(*) FILTER (WHERE has_report) AS persisted_gap_report_count,
       count(*) FILTER (WHERE NOT has_report) AS legacy_match_count, count(*) FILTER (WHERE overall_status = 'eligible') AS eligible,
       count(*) FILTER (WHERE overall_status = 'possible') AS possible, count(*) FILTER (WHERE overall_status = 'ineligible') AS ineligible,
       sum(hard_blockers) AS hard_blockers, sum(review_required) AS review_required, sum(unsupported) AS unsupported FROM b"""))
def _(spark, sf):
    r = V.table(spark, sf, "match_results")
    entry = lambda n: F.when(F.col("has_report"), F.array_repeat(F.lit("entry"), F.col(n).cast("int")))
    r = r.withColumn("report", F.when(F.col("has_report"), F.struct(
        entry("unfavorable_count").alias("hard_blockers"), F.array().cast("array<string>").alias("clarifiable_blockers"),
        F.array().cast("array<string>").alias("missing_data"), entry("requires_review_count").alias("review_required"),
        entry("unknown_count").alias("unsupported"))))
    latest = R.latest_completed_match_runs(V.view(spark, sf, "match_runs"))
    return P.matching_overview(r, latest).drop("clarifiable_blockers", "missing_data")
