"""Registered matching, gap and what-if queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions import logic as L
from cohortmill.functions import text as T
from cohortmill.functions.scale import stage, work_dir
from cohortmill.operators import gaps as G
from cohortmill.operators import matching as M
from cohortmill.operators import reports as P
from cohortmill.operators import review as Rv
from cohortmill.operators import runs as R
from cohortmill.operators import whatif as D
from cohortmill.operators.match_runs import MatchStore
from cohortmill.plans import evaluation_sql as S
from cohortmill.plans import views as V
from cohortmill.plans.registry import query

PAIR = ["patient_id", "trial_id"]


def trial_side(spark, sf):
    v = lambda n: V.table(spark, sf, n)
    return dict(trials=v("trials"), runs=v("pipeline_runs"), criteria=V.criteria(spark, sf))


def inputs(spark, sf):
    v = lambda n: V.table(spark, sf, n)
    return dict(requests=v("requests"), patients=v("patients"), **trial_side(spark, sf), facts=V.facts(spark, sf), as_of=V.AS_OF)


def rules_of(i):
    return M.trial_rules(i["trials"], i["runs"], i["criteria"])


def evaluated(spark, sf, only=None, evidence=False):
    """(evaluations, rules, inputs); ``only`` keeps the rules an operator is about."""
    i = inputs(spark, sf)
    rules = rules_of(i)
    rules = stage(rules if only is None else rules.where(only))
    return M.evaluate(**i, rules=rules, evidence=evidence), rules, i


def results_of(spark, sf):
    ev, rules, i = evaluated(spark, sf)
    return M.pair_results(ev, rules), ev, rules, i


def effective_of(spark, sf):
    ev, rules, i = evaluated(spark, sf)
    return M.collapse_groups(ev, rules), i


def osql(names, more, body):
    return V.oracle_with(names, more, body)


def eval_sql(where, cols="patient_id, trial_id, criterion_id, outcome"):
    return osql(S.MATCH_VIEWS, S.EVALS, f"SELECT {cols} FROM evals WHERE {where}")


OUT = [*PAIR, "criterion_id", "outcome"]


@query("m1_patient_facts", osql("patients facts", S.PROFILE,
       "SELECT patient_id, age, n_condition, n_biomarker, n_lab, n_lab_value, n_therapy, n_line, max_line, n_medication, n_active FROM prof"))
def _(spark, sf):
    i = inputs(spark, sf)
    return M.patient_profile(i["patients"], i["facts"], V.AS_OF).select("patient_id", "age", *M.COUNTS, "max_line")


for _name, _cat in (("m2_structured_age", "age"), ("m3_structured_sex", "sex"), ("m4_healthy_volunteers", "healthy_volunteers")):
    def _make(cat):
        return lambda spark, sf: evaluated(
            spark, sf, only=(F.col("source_type") == "structured") & (F.col("category") == cat))[0].select(*PAIR, "outcome")
    query(_name, eval_sql(f"source_type = 'structured' AND category = '{_cat}'", "patient_id, trial_id, outcome"))(_make(_cat))


@query("m5_applicable_rules", osql("trials pipeline_runs criteria", S.RULES, "SELECT trial_id, criterion_id, source_type, type, category FROM rules"))
def _(spark, sf):
    return rules_of(trial_side(spark, sf)).select("trial_id", "criterion_id", "source_type", "type", "category")


@query("m6_criterion_state", osql("trials pipeline_runs criteria", S.RULES, "SELECT criterion_id, state, state_reason FROM rules WHERE criterion_id IS NOT NULL"))
def _(spark, sf):
    return rules_of(trial_side(spark, sf)).where(F.col("criterion_id").isNotNull()).select("criterion_id", "state", "state_reason")


@query("m7_review_gate", eval_sql("gate IS NOT NULL", "patient_id, trial_id, criterion_id, gate, outcome"))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf, only=F.col("gate").isNotNull(), evidence=True)
    return ev.select(*PAIR, "criterion_id", "gate", "outcome")


@query("m8_category_dispatch", osql(S.MATCH_VIEWS, S.EVALS,
       "SELECT source_type, category, type, outcome, count(*) AS n FROM evals GROUP BY ALL"))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf)
    return ev.groupBy("source_type", "category", "type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("m9_age_years", osql("patients facts", S.PROFILE, "SELECT patient_id, age FROM prof"))
def _(spark, sf):
    p = V.view(spark, sf, "patients")
    return p.select("patient_id", L.age_years(F.col("birth_date"), F.lit(V.AS_OF).cast("date")).alias("age"))


@query("m10_age_text", V.oracle("trials", """SELECT trial_id, CAST(regexp_extract(eligible_min_age, '[0-9]+') AS DOUBLE) AS min_age,
       CAST(regexp_extract(eligible_max_age, '[0-9]+') AS DOUBLE) AS max_age FROM trials"""))
def _(spark, sf):
    return V.view(spark, sf, "trials").select(
        "trial_id", L.parse_age(F.col("eligible_min_age")).alias("min_age"), L.parse_age(F.col("eligible_max_age")).alias("max_age"))


def _category_query(name, cats):
    listed = ", ".join(f"'{c}'" for c in cats)
    query(name, eval_sql(f"source_type = 'extracted' AND category IN ({listed})"))(
        lambda spark, sf: evaluated(
            spark, sf, only=(F.col("source_type") == "extracted") & F.col("category").isin(*cats))[0].select(*OUT))


_category_query("m11_patient_flags", ["administrative_requirement", "reproductive_status"])
_category_query("m12_sex_text", ["sex"])
_category_query("m13_numeric_predicate", ["age", "performance_status"])
_category_query("m17_fact_match", ["diagnosis", "other", "biomarker", "molecular_alteration"])
_category_query("m18_medication_match", ["concomitant_medication"])
_category_query("m19_lab_match", ["lab_value"])
_category_query("m20_therapy_match", ["prior_therapy", "line_of_therapy"])


@query("m14_polarity", osql(S.MATCH_VIEWS, S.EVALS, """SELECT category, type, outcome, count(*) AS n FROM evals GROUP BY category, type, outcome"""))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf)
    return ev.groupBy("category", "type", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("m15_code_overlap", V.oracle("criteria facts", """SELECT c.code_system AS system, c.code, c.category, count(*) AS n_criteria,
       any_value(f.n_patients) AS n_patients FROM criteria c JOIN (SELECT code, count(DISTINCT patient_id) AS n_patients FROM facts
         WHERE code IS NOT NULL GROUP BY code) f ON c.code = f.code WHERE c.code IS NOT NULL GROUP BY ALL"""))
def _(spark, sf):
    """Codes both sides share, with the size of each side; both sides are aggregated before they meet."""
    c = V.criteria(spark, sf).select("category", "code_system", F.explode(M.concept_keys(F.col("coded_concepts"))).alias("key"))
    f = V.facts(spark, sf).select("patient_id", F.explode(M.concept_keys(F.col("coded_concepts"))).alias("key"))
    left = c.groupBy("code_system", "key", "category").agg(F.count(F.lit(1)).alias("n_criteria"))
    right = f.groupBy("key").agg(F.countDistinct("patient_id").alias("n_patients"))
    return left.join(right, "key").select(
        F.col("code_system").alias("system"), F.substring_index("key", "|", -1).alias("code"), "category", "n_criteria", "n_patients")


@query("m16_token_overlap", osql(S.MATCH_VIEWS, f"{S.RULES},\n{S.PROFILE},\n{S.HITS}",
       "SELECT DISTINCT patient_id, criterion_id, description FROM hits"))
def _(spark, sf):
    i = inputs(spark, sf)
    return M.fact_hits(i["requests"], stage(rules_of(i)), i["facts"]).select(
        "patient_id", "criterion_id", F.substring_index("fact_key", "\x01", 1).alias("description")).distinct()


@query("m21_evidence", eval_sql("TRUE", """patient_id, trial_id, criterion_id, category,
       CASE WHEN source_type = 'structured' THEN NULL WHEN gate IS NOT NULL THEN NULL ELSE operator END AS criterion_operator,
       CASE WHEN source_type = 'extracted' AND gate IS NULL AND category = 'lab_value' THEN n_lab END AS patient_lab_count,
       CASE WHEN source_type = 'structured' AND category = 'age' THEN age END AS patient_age_years"""))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf, evidence=True)
    e = ev.withColumn("e", M.evidence_payload())
    j = lambda k: F.get_json_object("e", f"$.{k}")
    return e.select(*PAIR, "criterion_id", "category", j("criterion_operator").alias("criterion_operator"),
                    j("patient_lab_count").cast("long").alias("patient_lab_count"),
                    j("patient_age_years").cast("double").alias("patient_age_years"))


@query("m22_explanations", eval_sql("TRUE", """patient_id, trial_id, criterion_id, category,
       CASE WHEN source_type = 'structured' THEN 'structured_rule' WHEN gate = 'requires_review' THEN 'review_required'
         WHEN gate = 'unknown' THEN 'blocked_unsupported' ELSE CASE outcome WHEN 'matched' THEN 'criterion_match' WHEN 'not_matched' THEN 'criterion_mismatch'
         WHEN 'triggered' THEN 'criterion_blocker' WHEN 'not_triggered' THEN 'criterion_clear' ELSE 'criterion_unknown' END END AS explanation_type,
       CASE WHEN source_type = 'structured' AND category = 'age' THEN CASE WHEN age IS NULL THEN 'Patient birth date is unavailable, so age eligibility could not be evaluated.'
         WHEN age < value_low THEN 'Patient age ' || CAST(age AS INT) || ' is below the minimum age ' || CAST(value_low AS INT) || '.'
         WHEN age > value_high THEN 'Patient age ' || CAST(age AS INT) || ' exceeds the maximum age ' || CAST(value_high AS INT) || '.'
         ELSE 'Patient age ' || CAST(age AS INT) || ' satisfies the structured age range.' END END AS age_text"""))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf, evidence=True)
    age_row = (F.col("source_type") == "structured") & (F.col("category") == "age")
    return ev.select(*PAIR, "criterion_id", "category",
                     M.explanation_type(F.col("outcome"), F.col("gate"), F.col("source_type")).alias("explanation_type"),
                     F.when(age_row, M.explanation_text()).alias("age_text"))


@query("m23_or_groups", osql(S.MATCH_VIEWS, S.EFFECTIVE, """SELECT patient_id, trial_id, group_id, type, category, display_category, criterion_text, outcome,
       state, state_reason, members FROM eff WHERE group_id IS NOT NULL"""))
def _(spark, sf):
    eff, _ = effective_of(spark, sf)
    return eff.where(F.col("group_id").isNotNull()).select(
        *PAIR, "group_id", "type", "category", "display_category", "criterion_text", "outcome", "state", "state_reason", "members")


@query("m24_missing_data", osql(S.MATCH_VIEWS, S.EFFECTIVE, "SELECT category, outcome, missing, count(*) AS n FROM eff GROUP BY ALL"))
def _(spark, sf):
    eff, _ = effective_of(spark, sf)
    return eff.groupBy("category", "outcome", "missing").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = ["favorable_count", "unfavorable_count", "unknown_count", "requires_review_count"]


@query("m25_pair_status", osql(S.MATCH_VIEWS, S.RESULTS, """SELECT patient_id, trial_id, favorable_count, unfavorable_count, unknown_count,
       requires_review_count, overall_status, round(score, 6) AS score FROM results"""))
def _(spark, sf):
    r = results_of(spark, sf)[0]
    return r.select(*PAIR, *_COUNTS, "overall_status", F.round("score", 6).alias("score"))


@query("m26_match_state", osql(S.MATCH_VIEWS, S.RESULTS, "SELECT patient_id, trial_id, state, state_reason FROM results"))
def _(spark, sf):
    return results_of(spark, sf)[0].select(*PAIR, "state", "state_reason")


def _cats(cond):
    return f"""(SELECT patient_id, trial_id, string_agg(category, ', ' ORDER BY n) AS txt FROM (SELECT patient_id, trial_id, category,
      row_number() OVER (PARTITION BY patient_id, trial_id ORDER BY group_id IS NOT NULL, ord, criterion_id, group_id) AS n FROM eff WHERE {cond}) WHERE n <= 2 GROUP BY 1, 2)"""


@query("m27_summary_text", osql(S.MATCH_VIEWS, S.RESULTS, f"""SELECT r.patient_id, r.trial_id,
       CASE WHEN overall_status = 'ineligible' THEN brief_title || ' is ineligible because of ' || b.txt || '.'
         WHEN v.txt IS NOT NULL THEN brief_title || ' remains a possible match pending manual review of ' || v.txt || '.'
         WHEN k.txt IS NOT NULL THEN brief_title || ' remains a possible match because ' || k.txt || ' were rejected or unsupported and excluded from automated matching.'
         WHEN overall_status = 'possible' THEN brief_title || ' remains a possible match pending ' || o.txt || '.'
         ELSE brief_title || ' is eligible based on ' || favorable_count || ' favorable criteria and no blockers.' END AS summary_explanation
       FROM results r JOIN trials USING (trial_id)
       LEFT JOIN {_cats("outcome IN ('not_matched', 'triggered')")} b USING (patient_id, trial_id)
       LEFT JOIN {_cats("state = 'review_required'")} v USING (patient_id, trial_id)
       LEFT JOIN {_cats("state = 'blocked_unsupported'")} k USING (patient_id, trial_id)
       LEFT JOIN {_cats("outcome IN ('unknown', 'requires_review')")} o USING (patient_id, trial_id)"""))
def _(spark, sf):
    ev, rules, i = evaluated(spark, sf)
    r = M.pair_results(ev, rules)
    return M.summaries(r, M.collapse_groups(ev, rules), i["trials"]).select(*PAIR, "summary_explanation")


_ORDER = """CASE overall_status WHEN 'eligible' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END, coverage_ratio DESC, score DESC, CAST(trial_id AS VARCHAR)"""


@query("m28_ranking", osql(S.MATCH_VIEWS, S.RESULTS, f"""SELECT patient_id, trial_id, overall_status,
       row_number() OVER (PARTITION BY patient_id ORDER BY {_ORDER}) AS rank FROM results"""))
def _(spark, sf):
    return M.rank_results(results_of(spark, sf)[0]).select(*PAIR, "overall_status", "rank")


@query("m28_top_matches", osql(S.MATCH_VIEWS, S.RESULTS, f"""SELECT * FROM (SELECT patient_id, trial_id, overall_status,
       row_number() OVER (PARTITION BY patient_id ORDER BY {_ORDER}) AS rank FROM results) WHERE rank <= 5"""))
def _(spark, sf):
    return M.top_matches(results_of(spark, sf)[0], 5).select(*PAIR, "overall_status", "rank")


_ROLLUP = """SELECT patient_id, count(*) AS total_trials_evaluated, count(*) FILTER (WHERE overall_status = 'eligible') AS eligible_trials,
       count(*) FILTER (WHERE overall_status = 'possible') AS possible_trials, count(*) FILTER (WHERE overall_status = 'ineligible') AS ineligible_trials"""


@query("m29_run_rollup", osql(S.MATCH_VIEWS, S.RESULTS, f"{_ROLLUP} FROM results GROUP BY patient_id"))
def _(spark, sf):
    return M.run_rollup(results_of(spark, sf)[0])


@query("m30_criterion_snapshot", eval_sql("TRUE", """patient_id, trial_id, criterion_id, source_type, type, category, original_text AS criterion_text,
       outcome, state, state_reason, group_id"""))
def _(spark, sf):
    ev, _, _ = evaluated(spark, sf)
    return ev.select(*OUT, "source_type", "type", "category", "criterion_text", "state", "state_reason", "group_id")


_JOBS: dict[tuple[str, str], str] = {}


def match_job(spark, sf) -> MatchStore:
    """All requests as one stored batch of match runs, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _JOBS:
        path = f"{work_dir(spark)}/matches/{uuid.uuid4().hex}"
        ev, rules, i = evaluated(spark, sf)
        MatchStore(spark, path).write("all", i["requests"], ev, rules, i["trials"])
        _JOBS[key] = path
    return MatchStore(spark, _JOBS[key])


def _latest_job(store):
    return R.latest_completed_match_runs(store.read("match_runs"))


_FOLLOW = ", ".join(f"'{b}'" for b in G.FOLLOW_UP)


@query("m30_match_runs", osql(S.MATCH_VIEWS, f"{S.RESULTS},\n{S.ENTRIES[len(S.EFFECTIVE) + 2:]}", f"""SELECT 'all:' || q.patient_id AS match_run_id, q.patient_id,
       coalesce(total_trials_evaluated, 0) AS total_trials_evaluated, coalesce(eligible_trials, 0) AS eligible_trials, coalesce(possible_trials, 0) AS possible_trials,
       coalesce(ineligible_trials, 0) AS ineligible_trials, coalesce(n_criteria, 0) AS n_criteria, coalesce(n_items, 0) AS n_items
       FROM (SELECT DISTINCT patient_id FROM requests) q LEFT JOIN ({_ROLLUP} FROM results GROUP BY patient_id) r ON r.patient_id = q.patient_id
       LEFT JOIN (SELECT patient_id, count(*) AS n_criteria FROM evals GROUP BY 1) c ON c.patient_id = q.patient_id
       LEFT JOIN (SELECT patient_id, count(*) AS n_items FROM entries WHERE bucket IN ({_FOLLOW}) GROUP BY 1) e ON e.patient_id = q.patient_id"""))
def _(spark, sf):
    """Latest run of each patient with its stored totals and the number of its stored criteria and review items."""
    store = match_job(spark, sf)
    of_run = lambda name, n: store.read(name).groupBy("match_run_id").agg(F.count(F.lit(1)).alias(n))
    runs = store.read("match_runs").join(_latest_job(store), ["patient_id", "match_run_id"], "left_semi")
    j = runs.join(of_run("match_result_criteria", "n_criteria"), "match_run_id", "left").join(of_run("match_review_items", "n_items"), "match_run_id", "left")
    return j.fillna(0, ["n_criteria", "n_items"]).drop("status", "created_at", "completed_at")


@query("r4_job_queue", osql(S.MATCH_VIEWS, S.ENTRIES, f"""SELECT patient_id, trial_id, nct_id, brief_title, bucket, ordinal, coalesce(nullif(trim(state_reason), ''), bucket_kind) AS reason_code,
       bucket = 'review_required' AS review_required FROM (SELECT *, CASE bucket WHEN 'clarifiable_blockers' THEN 'clarifiable_blocker' ELSE bucket END AS bucket_kind FROM entries)
       JOIN trials USING (trial_id) WHERE bucket IN ({_FOLLOW})"""))
def _(spark, sf):
    """Review queue over the items that the match job stored."""
    store = match_job(spark, sf)
    q = Rv.match_queue(store.read("match_review_items"), _latest_job(store), V.view(spark, sf, "trials"))
    return q.select(*PAIR, "nct_id", "brief_title", "bucket", F.split("item_key", ":")[1].cast("long").alias("ordinal"), "reason_code", "review_required")


@query("p2_job_coverage", osql(S.MATCH_VIEWS, f"{S.RESULTS},\n{S.ENTRIES[len(S.EFFECTIVE) + 2:]}", f"""SELECT count(*) AS total_match_results, count(*) AS persisted_gap_report_count, 0 AS legacy_match_count,
       {", ".join(f"count(*) FILTER (WHERE overall_status = '{x}') AS {x}" for x in M.STATUS_ORDER)},
       {", ".join(f"(SELECT count(*) FROM entries WHERE bucket = '{b}') AS {b}" for b in G.BUCKETS)} FROM results"""))
def _(spark, sf):
    """Coverage over the nested gap reports that the match job stored."""
    store = match_job(spark, sf)
    return P.matching_overview(store.read("match_results"), _latest_job(store))


_GAP = ["ordinal", "kind", "label", "category", "criterion_text", "outcome", "state", "state_reason"]


@query("g1_stored_reports", osql(S.MATCH_VIEWS, S.ENTRIES, """SELECT patient_id, trial_id, bucket, ordinal, CASE bucket WHEN 'clarifiable_blockers' THEN 'clarifiable_blocker'
       WHEN 'hard_blockers' THEN 'hard_blocker' ELSE bucket END AS kind, display_category AS category, criterion_text, outcome, state, state_reason FROM entries"""))
def _(spark, sf):
    """Entries of the stored nested reports, in the order in which they stand there."""
    r = match_job(spark, sf).read("match_results")

    def placed(bucket):
        return F.transform(f"report.{bucket}", lambda e, i: F.struct(F.lit(bucket).alias("bucket"), i.cast("long").alias("place"), e.alias("e")))

    x = r.select(*PAIR, F.explode(F.concat(*map(placed, G.BUCKETS))).alias("x"))
    return x.select(*PAIR, "x.bucket", F.col("x.place").alias("ordinal"), *[f"x.e.{c}" for c in _GAP if c not in ("ordinal", "label")])


@query("m31_match_listing", V.oracle("match_results trials", """SELECT match_result_id, nct_id, brief_title, overall_status,
       favorable_count + unfavorable_count AS deterministic_count, unknown_count + requires_review_count AS unresolved_count
       FROM match_results JOIN trials USING (trial_id) ORDER BY created_at DESC, match_result_id DESC LIMIT 100"""))
def _(spark, sf):
    r = V.table(spark, sf, "match_results")
    return M.list_matches(r, V.view(spark, sf, "trials"), page=1, per_page=100).select(
        "match_result_id", "nct_id", "brief_title", "overall_status", "deterministic_count", "unresolved_count")


# ------------------------------------------------------------------ gap report

@query("g1_gap_buckets", osql(S.MATCH_VIEWS, S.ENTRIES, """SELECT patient_id, trial_id, bucket, ordinal, display_category AS category, criterion_text, outcome, state,
       state_reason FROM entries"""))
def _(spark, sf):
    eff, _ = effective_of(spark, sf)
    return G.gap_entries(eff).select(*PAIR, "bucket", "ordinal", "category", "criterion_text", "outcome", "state", "state_reason")


_RC = f"""src AS (SELECT *, criterion_type AS type, CASE WHEN logic_operator = 'OR' THEN CAST(logic_group_id AS VARCHAR) END AS group_id FROM result_criteria),
{S.collapse_sql('src', 'match_result_id', 'criterion_type')},
{S.text_sql('src', 'match_result_id', 'criterion_text')},
eff AS (SELECT match_result_id, category, criterion_text, outcome, state, state_reason, missing, CAST(NULL AS VARCHAR) AS group_id FROM src WHERE group_id IS NULL
  UNION ALL SELECT match_result_id, CASE WHEN n_cat = 1 THEN fc ELSE 'logic_group' END, group_text, outcome, {S._STATE.format(r='rk')}, {S._REASON.format(r='rk')},
    any_missing OR (n_cat = 1 AND fc = 'concomitant_medication'), group_id FROM g3 JOIN gtext USING (match_result_id, group_id))"""


@query("g2_stored_groups", V.oracle_with("result_criteria", _RC, f"""SELECT match_result_id, category, criterion_text, outcome, state, state_reason, missing, group_id,
       {S.BUCKET} AS bucket FROM eff"""))
def _(spark, sf):
    rows = G.stored_group_rows(V.table(spark, sf, "result_criteria"))
    return rows.withColumn("bucket", G.gap_bucket(F.col("outcome"), F.col("state"), F.col("state_reason"), F.col("missing")))


_LEGACY = """leg AS (SELECT match_result_id, coalesce(state_reason, 'legacy_state_unverifiable') AS state_reason, state, bucket,
    CASE bucket WHEN 'hard_blockers' THEN 'hard_blocker' ELSE bucket END AS kind, CASE bucket WHEN 'hard_blockers' THEN 'not_matched' ELSE 'unknown' END AS outcome
  FROM (SELECT *, 'unsupported' AS bucket FROM match_results WHERE state = 'blocked_unsupported'
    UNION ALL SELECT *, 'hard_blockers' FROM match_results WHERE overall_status = 'ineligible' AND unfavorable_count > 0 AND state = 'structured_safe'
    UNION ALL SELECT *, 'review_required' FROM match_results WHERE unknown_count > 0 OR requires_review_count > 0 OR state NOT IN ('structured_safe', 'blocked_unsupported')))"""


@query("g3_legacy_gaps", V.oracle_with("match_results", _LEGACY, "SELECT match_result_id, bucket, kind, outcome, state, state_reason FROM leg"))
def _(spark, sf):
    return G.legacy_entries(V.table(spark, sf, "match_results")).select("match_result_id", "bucket", "kind", "outcome", "state", "state_reason")


_KEY = "bucket || ':' || ordinal || ':' || substr(sha1(category || chr(0) || criterion_text || chr(0) || reason_code), 1, 12)"
_ITEMS = f"""{S.ENTRIES},
named AS (SELECT patient_id, trial_id, bucket, ordinal, display_category AS category, trim(criterion_text) AS criterion_text, outcome, state,
    coalesce(state_reason, CASE bucket WHEN 'clarifiable_blockers' THEN 'clarifiable_blocker' ELSE bucket END) AS reason_code FROM entries WHERE bucket <> 'hard_blockers')"""


@query("g4_review_items", osql(S.MATCH_VIEWS, _ITEMS, "SELECT patient_id, trial_id, bucket, category, criterion_text, outcome, state, reason_code FROM named"))
def _(spark, sf):
    eff, _ = effective_of(spark, sf)
    return G.review_items(G.gap_entries(eff)).select(*PAIR, "bucket", "category", "criterion_text", "outcome", "state", "reason_code")


@query("g5_item_keys", osql(S.MATCH_VIEWS, _ITEMS, f"SELECT patient_id, trial_id, {_KEY} AS item_key FROM named"))
def _(spark, sf):
    eff, _ = effective_of(spark, sf)
    return G.review_items(G.gap_entries(eff)).select(*PAIR, "item_key")


@query("g6_explanation_sections", V.oracle("result_criteria", """SELECT match_result_id, ord, section, category,
       list_aggregate(list_transform(string_split(category, '_'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS label
       FROM (SELECT *, 'matched' AS section FROM result_criteria WHERE outcome IN ('matched', 'not_triggered')
         UNION ALL SELECT *, 'blockers' FROM result_criteria WHERE outcome IN ('not_matched', 'triggered')
         UNION ALL SELECT *, 'review_required' FROM result_criteria WHERE outcome IN ('unknown', 'requires_review') OR state <> 'structured_safe')"""))
def _(spark, sf):
    return G.explanation_partition(V.table(spark, sf, "result_criteria")).select("match_result_id", "ord", "section", "category", "label")


_BACK = """ev AS (SELECT * EXCLUDE (state, state_reason), CASE WHEN json_valid(evidence_payload) THEN nullif(json_extract_string(evidence_payload, '$.review_status'), '') END AS rs,
    CASE WHEN json_valid(evidence_payload) THEN nullif(json_extract_string(evidence_payload, '$.review_reason'), '') END AS rr FROM result_criteria),
bs AS (SELECT *, CASE WHEN source_type = 'structured' THEN 'structured_safe' WHEN rs = 'rejected' THEN 'blocked_unsupported' WHEN rs IN ('accepted', 'corrected') THEN 'structured_safe'
    WHEN outcome = 'requires_review' OR rs = 'pending' THEN 'review_required' ELSE 'structured_low_confidence' END AS state FROM ev),
bc AS (SELECT *, CASE state WHEN 'blocked_unsupported' THEN 'rejected' WHEN 'review_required' THEN 'review_required:' || coalesce(rr, 'unspecified_review_reason')
    WHEN 'structured_low_confidence' THEN 'legacy_state_unverifiable' END AS state_reason FROM bs)"""


@query("g7_criterion_state_backfill", V.oracle_with("result_criteria", _BACK, "SELECT match_result_id, ord, state, state_reason FROM bc"))
def _(spark, sf):
    return G.backfill_criterion_states(V.table(spark, sf, "result_criteria")).select("match_result_id", "ord", "state", "state_reason")


@query("g8_result_state_backfill", V.oracle_with("match_results result_criteria", _BACK, """SELECT match_result_id, state,
       CASE state WHEN 'review_required' THEN 'review_required' WHEN 'blocked_unsupported' THEN 'blocked_unsupported' WHEN 'structured_low_confidence' THEN 'legacy_state_unverifiable' END AS state_reason
       FROM (SELECT m.match_result_id, CASE WHEN bool_or(bc.state = 'review_required') OR any_value(m.requires_review_count) > 0 THEN 'review_required'
         WHEN bool_or(bc.state = 'blocked_unsupported') THEN 'blocked_unsupported' WHEN bool_or(bc.state = 'structured_low_confidence') THEN 'structured_low_confidence' ELSE 'structured_safe' END AS state
         FROM match_results m LEFT JOIN bc USING (match_result_id) GROUP BY m.match_result_id)"""))
def _(spark, sf):
    c = G.backfill_criterion_states(V.table(spark, sf, "result_criteria"))
    return G.backfill_result_states(V.table(spark, sf, "match_results"), c).select("match_result_id", "state", "state_reason")


@query("g9_review_item_backfill", V.oracle_with("match_results", f"""{_LEGACY},
rep AS (SELECT match_result_id, bucket, 'historical_snapshot' AS category, leg.state_reason AS reason_code, {0} AS ordinal FROM leg JOIN match_results m USING (match_result_id)
  WHERE m.has_report AND bucket <> 'hard_blockers'),
hist AS (SELECT match_result_id, CASE WHEN state = 'blocked_unsupported' THEN 'unsupported' ELSE 'review_required' END AS bucket, 'historical_snapshot' AS category,
    coalesce(state_reason, 'legacy_state_unverifiable') AS reason_code, 0 AS ordinal FROM match_results m
  WHERE match_result_id NOT IN (SELECT match_result_id FROM rep) AND (unknown_count > 0 OR requires_review_count > 0 OR state <> 'structured_safe')),
alls AS (SELECT *, '{G.HISTORICAL_TEXT}' AS criterion_text FROM (SELECT * FROM rep UNION ALL SELECT * FROM hist))""",
       f"SELECT match_result_id, bucket, category, reason_code, {_KEY} AS item_key FROM alls"))
def _(spark, sf):
    r = V.table(spark, sf, "match_results")
    entries = G.legacy_entries(r.where("has_report")).withColumn("ordinal", F.lit(0)).select(
        "match_result_id", "bucket", "ordinal", "kind", "category", "label", "criterion_text", "outcome", "state", "state_reason")
    return G.backfill_review_items(r, entries)


# -------------------------------------------------------------------- what-if

_PATCH = """patch AS (SELECT patient_id, CASE WHEN patient_id % 2 = 0 THEN CAST(patient_id % 3 AS INT) END AS ecog_status FROM patients WHERE patient_id % 3 <> 2),
swaps AS (SELECT patient_id, CASE patient_id % 4 WHEN 0 THEN 'lab' WHEN 1 THEN 'medication' ELSE 'biomarker' END AS kind FROM patients WHERE patient_id % 3 = 0
  UNION ALL SELECT patient_id, 'condition' FROM patients WHERE patient_id % 3 = 0),
added AS (SELECT patient_id, 'lab' AS kind, '2-HIGH' AS description, CAST(NULL AS STRING) AS code_system, CAST(NULL AS STRING) AS code,
    CAST(patient_id % 50 AS DOUBLE) AS value_numeric, CAST(NULL AS INT) AS line_of_therapy, CAST(NULL AS BOOLEAN) AS active FROM patients WHERE patient_id % 12 = 0)"""
_SCEN_FACTS = """facts2 AS (SELECT f.* FROM facts f WHERE NOT EXISTS (SELECT 1 FROM swaps s WHERE s.patient_id = f.patient_id AND s.kind = f.kind AND s.kind <> 'condition')
  UNION ALL SELECT a.* FROM added a JOIN swaps s USING (patient_id, kind))"""
_SCEN_PATIENTS = "patients2 AS (SELECT p.* REPLACE (coalesce(x.ecog_status, p.ecog_status) AS ecog_status) FROM patients p LEFT JOIN patch x USING (patient_id))"


def patch_of(spark, sf, name):
    V.register(spark, sf)
    return spark.sql(f"WITH {V.ctes('patients')},\n{_PATCH} SELECT * FROM {name}")


def overlaid(spark, sf, i):
    new = patch_of(spark, sf, "added").withColumn("coded_concepts", F.lit(None).cast(M.CONCEPTS))
    return D.overlay(i["patients"], i["facts"].withColumn("coded_concepts", F.col("coded_concepts").cast(M.CONCEPTS)),
                     patch_of(spark, sf, "patch"), patch_of(spark, sf, "swaps"), new)


@query("d1_cohort_overlay", V.oracle_with("patients facts", f"{_PATCH},\n{_SCEN_FACTS},\n{_SCEN_PATIENTS}",
       "SELECT p.patient_id, p.ecog_status, f.kind, f.description, f.value_numeric FROM patients2 p LEFT JOIN facts2 f USING (patient_id)"))
def _(spark, sf):
    p, f = overlaid(spark, sf, inputs(spark, sf))
    return p.select("patient_id", "ecog_status").join(f.select("patient_id", "kind", "description", "value_numeric"), "patient_id", "left")


def scenario(spark, sf):
    i = inputs(spark, sf)
    rules = stage(rules_of(i))
    base = M.evaluate(**i, rules=rules)
    p2, f2 = overlaid(spark, sf, i)
    scen = M.evaluate(**{**i, "patients": p2, "facts": stage(f2)}, rules=rules)
    return base, scen, rules


def _second(sql: str) -> str:
    """The same chain over the patched patients and facts, under other CTE names."""
    import re

    names = ["latest", "t", "xr", "rules", "prof", "tr", "tf", "hits", "agg", "joined", "sat", "evals", "g0", "g1", "g2", "g3", "gtext", "eff", "counts", "results", "entries"]
    for n in [n for n in names if n not in ("t",)] + ["facts", "patients"]:
        sql = re.sub(rf"(?<![A-Za-z_.']){n}(?![A-Za-z_0-9'])", f"{n}2", sql)
    return sql


def _tail(sql: str, first: str) -> str:
    return sql[sql.index(first):]


_BOTH = f"""{_PATCH},\n{_SCEN_FACTS},\n{_SCEN_PATIENTS},\n{S.RESULTS},
{_tail(S.ENTRIES, 'entries AS')}"""
_TWO = _second(_tail(S.RESULTS, "prof AS")).replace("rules2", "rules") + ",\n" + _second(_tail(S.ENTRIES, "entries AS"))
_STAT = """st AS (SELECT coalesce(b.patient_id, s.patient_id) AS patient_id, coalesce(b.trial_id, s.trial_id) AS trial_id, b.overall_status AS baseline_status, s.overall_status AS scenario_status,
    s.requires_review_count AS srev, b.overall_status IS DISTINCT FROM s.overall_status AS status_changed
  FROM results b FULL JOIN results2 s ON b.patient_id = s.patient_id AND b.trial_id = s.trial_id)"""
_TX = """tx AS (SELECT patient_id, trial_id, CASE bucket WHEN 'hard_blockers' THEN 'blockers' ELSE bucket END AS bucket, criterion_text AS text,
    CASE WHEN bool_or(src = 1) THEN 'removed' ELSE 'added' END AS change
  FROM (SELECT patient_id, trial_id, bucket, trim(criterion_text) AS criterion_text, 1 AS src FROM entries UNION ALL SELECT patient_id, trial_id, bucket, trim(criterion_text), 2 FROM entries2)
  GROUP BY patient_id, trial_id, bucket, criterion_text HAVING min(src) = max(src))"""


@query("d2_result_deltas", osql(S.MATCH_VIEWS, f"{_BOTH},\n{_TWO},\n{_STAT},\n{_TX}", """SELECT st.patient_id, st.trial_id, baseline_status, scenario_status, status_changed,
       count(*) FILTER (WHERE bucket = 'blockers' AND change = 'removed') AS blockers_removed, count(*) FILTER (WHERE bucket = 'blockers' AND change = 'added') AS blockers_added,
       count(*) FILTER (WHERE bucket = 'missing_data' AND change = 'removed') AS missing_data_removed, count(*) FILTER (WHERE bucket = 'missing_data' AND change = 'added') AS missing_data_added
       FROM st LEFT JOIN tx USING (patient_id, trial_id) GROUP BY ALL"""))
def _(spark, sf):
    base, scen, rules = scenario(spark, sf)
    d = D.result_deltas(M.pair_results(base, rules), M.pair_results(scen, rules),
                        G.gap_entries(M.collapse_groups(base, rules)), G.gap_entries(M.collapse_groups(scen, rules)))
    return d.select(*PAIR, "baseline_status", "scenario_status", "status_changed", "blockers_removed", "blockers_added",
                    "missing_data_removed", "missing_data_added")


@query("d3_delta_summary", osql(S.MATCH_VIEWS, f"{_BOTH},\n{_TWO},\n{_STAT}", """SELECT patient_id, count(*) AS total_trials,
       count(*) FILTER (WHERE scenario_status = 'eligible') AS eligible, count(*) FILTER (WHERE scenario_status = 'possible') AS possible,
       count(*) FILTER (WHERE scenario_status = 'ineligible') AS ineligible, count(*) FILTER (WHERE a > b) AS newly_eligible, count(*) FILTER (WHERE a < b) AS newly_blocked,
       count(*) FILTER (WHERE status_changed) AS status_changed, count(*) FILTER (WHERE NOT status_changed) AS unchanged, count(*) FILTER (WHERE coalesce(srev, 0) > 0) AS review_required
       FROM (SELECT *, CASE baseline_status WHEN 'ineligible' THEN 0 WHEN 'possible' THEN 1 WHEN 'eligible' THEN 2 END AS b,
         CASE scenario_status WHEN 'ineligible' THEN 0 WHEN 'possible' THEN 1 WHEN 'eligible' THEN 2 END AS a FROM st) GROUP BY patient_id"""))
def _(spark, sf):
    base, scen, rules = scenario(spark, sf)
    return D.delta_summary(M.pair_results(base, rules), M.pair_results(scen, rules))
