"""SQL counterpart of the matching chain, written for the oracle engine."""

from __future__ import annotations

from cohortmill.plans.views import AS_OF


def toks(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"


def overlap(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({common} >= 2 OR {common} = least(len({a}), len({b}))))"


def num(v: str, p: str = "") -> str:
    op, lo, hi = f"{p}operator", f"{p}value_low", f"{p}value_high"
    return f"""CASE WHEN {v} IS NULL THEN NULL WHEN {op} = 'gte' THEN {v} >= {lo} WHEN {op} = 'gt' THEN {v} > {lo}
      WHEN {op} = 'lte' THEN {v} <= {lo} ELSE {v} >= {lo} AND {v} <= {hi} END"""


LATEST = """latest AS (SELECT trial_id, run_id AS latest_run_id FROM (
    SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY coalesce(finished_at, started_at) DESC, started_at DESC,
      CAST(run_id AS VARCHAR) DESC) AS rn FROM pipeline_runs WHERE status = 'completed') WHERE rn = 1)"""

RULES = LATEST + """,
t AS (SELECT *, eligible_min_age IS NOT NULL OR eligible_max_age IS NOT NULL AS ua, eligible_sex <> 'ALL' AS us FROM trials),
xr AS (
  SELECT c.*, 'extracted' AS source_type,
    CASE WHEN review_status = 'rejected' THEN 'blocked_unsupported' WHEN review_status = 'accepted' THEN 'structured_safe'
      WHEN review_required THEN 'review_required' WHEN confidence < 0.5 THEN 'structured_low_confidence' ELSE 'structured_safe' END AS state,
    coalesce(nullif(value_text, ''), original_text) AS match_text
  FROM criteria c JOIN t USING (trial_id) LEFT JOIN latest USING (trial_id)
  WHERE (latest_run_id IS NULL OR run_id = latest_run_id)
    AND category NOT IN ('procedural_requirement', 'disease_status')
    AND NOT (ua AND category = 'age') AND NOT (us AND category = 'sex')),
rules AS (
  SELECT trial_id, criterion_id, ord, source_type, type, category, original_text, state,
    CASE state WHEN 'blocked_unsupported' THEN 'rejected'
      WHEN 'review_required' THEN 'review_required:' || coalesce(review_reason, 'unspecified_review_reason')
      WHEN 'structured_low_confidence' THEN 'low_confidence' END AS state_reason,
    CASE WHEN review_required THEN 'requires_review' WHEN state = 'blocked_unsupported' THEN 'unknown' END AS gate,
    operator, value_low, value_high, value_text, match_text,
    CASE WHEN logic_operator = 'OR' AND logic_group_id IS NOT NULL THEN CAST(logic_group_id AS VARCHAR) END AS group_id,
    code, exception_entity, allowance_text, timeframe_operator
  FROM xr
  UNION ALL
  SELECT trial_id, NULL, -3, 'structured', 'inclusion', 'age', 'ClinicalTrials.gov structured age eligibility', 'structured_safe', NULL, NULL, NULL,
    CAST(regexp_extract(eligible_min_age, '[0-9]+') AS DOUBLE), CAST(regexp_extract(eligible_max_age, '[0-9]+') AS DOUBLE),
    NULL, '', NULL, NULL, NULL, NULL, NULL FROM t WHERE ua
  UNION ALL
  SELECT trial_id, NULL, -2, 'structured', 'inclusion', 'sex', 'ClinicalTrials.gov structured sex eligibility: ' || eligible_sex, 'structured_safe',
    NULL, NULL, NULL, NULL, NULL, eligible_sex, '', NULL, NULL, NULL, NULL, NULL FROM t WHERE us
  UNION ALL
  SELECT trial_id, NULL, -1, 'structured', 'inclusion', 'healthy_volunteers', 'ClinicalTrials.gov structured healthy volunteer restriction',
    'structured_safe', NULL, NULL, NULL, NULL, NULL, NULL, '', NULL, NULL, NULL, NULL, NULL FROM t WHERE NOT accepts_healthy)"""

PROFILE = f"""prof AS (
  SELECT p.*, CAST(year(DATE '{AS_OF}') - year(birth_date)
      - CASE WHEN month(birth_date) * 100 + day(birth_date) > {int(AS_OF[5:7]) * 100 + int(AS_OF[8:])} THEN 1 ELSE 0 END AS DOUBLE) AS age,
    coalesce(n_condition, 0) AS n_condition, coalesce(n_biomarker, 0) AS n_biomarker, coalesce(n_lab, 0) AS n_lab,
    coalesce(n_lab_value, 0) AS n_lab_value, coalesce(n_therapy, 0) AS n_therapy, coalesce(n_line, 0) AS n_line,
    coalesce(n_medication, 0) AS n_medication, coalesce(n_active, 0) AS n_active, max_line
  FROM patients p LEFT JOIN (
    SELECT patient_id, count(*) FILTER (WHERE kind = 'condition') AS n_condition, count(*) FILTER (WHERE kind = 'biomarker') AS n_biomarker,
      count(*) FILTER (WHERE kind = 'lab') AS n_lab, count(value_numeric) AS n_lab_value,
      count(*) FILTER (WHERE kind = 'therapy') AS n_therapy, count(line_of_therapy) AS n_line, max(line_of_therapy) AS max_line,
      count(*) FILTER (WHERE kind = 'medication') AS n_medication, count(*) FILTER (WHERE kind = 'medication' AND active) AS n_active
    FROM facts GROUP BY patient_id) USING (patient_id))"""

_KIND = """CASE WHEN category IN ('diagnosis', 'other') THEN 'condition' WHEN category IN ('biomarker', 'molecular_alteration') THEN 'biomarker'
      WHEN category = 'lab_value' THEN 'lab' WHEN category IN ('prior_therapy', 'line_of_therapy') THEN 'therapy'
      WHEN category = 'concomitant_medication' THEN 'medication' END"""

HITS = f"""tr AS (SELECT *, {_KIND} AS fact_kind, {toks('match_text')} AS rt FROM rules
  WHERE source_type = 'extracted' AND gate IS NULL),
tf AS (SELECT *, {toks('description')} AS ft FROM facts WHERE kind <> 'medication' OR active),
hits AS (
  SELECT req.patient_id, tr.criterion_id, tr.category, tr.operator, tr.value_low, tr.value_high, tf.value_numeric, tf.description, tf.ft,
    tr.exception_entity, tr.allowance_text, tr.timeframe_operator,
    coalesce(tr.code = tf.code, FALSE) AS by_code, {overlap('rt', 'ft')} AS by_text
  FROM requests req JOIN tr USING (trial_id) JOIN tf ON tf.patient_id = req.patient_id AND tf.kind = tr.fact_kind
  WHERE coalesce(tr.code = tf.code, FALSE) OR {overlap('rt', 'ft')}),
agg AS (
  SELECT patient_id, criterion_id, count(*) AS n_hits,
    count(value_numeric) > 0 AS has_value,
    coalesce(bool_or({num('value_numeric')}), FALSE) AS lab_ok,
    bool_or(verdict = 'disallowed') AS disallowed, bool_or(verdict = 'context') AS context
  FROM (SELECT *, CASE WHEN exception_entity IS NOT NULL AND {overlap(toks('exception_entity'), 'ft')} THEN 'fine'
      WHEN allowance_text IS NOT NULL THEN CASE WHEN CASE WHEN contains(lower(allowance_text), 'physiologic')
          THEN contains(lower(description), 'replacement') OR contains(lower(description), 'maintenance') OR contains(lower(description), 'physiologic')
          ELSE {overlap(toks('allowance_text'), 'ft')} END THEN 'fine' ELSE 'context' END
      WHEN timeframe_operator IS NOT NULL THEN 'context' ELSE 'disallowed' END AS verdict FROM hits)
  GROUP BY patient_id, criterion_id)"""

_FIELD = "CASE WHEN contains(value_text, ':') AND lower(trim(split_part(value_text, ':', 2))) IN ('true', 'false') THEN trim(split_part(value_text, ':', 1)) END"
_FLAG = f"""CASE {_FIELD} WHEN 'can_consent' THEN can_consent WHEN 'protocol_compliant' THEN protocol_compliant
      WHEN 'claustrophobic' THEN claustrophobic WHEN 'motion_intolerant' THEN motion_intolerant WHEN 'pregnant' THEN pregnant
      WHEN 'mr_device_present' THEN mr_device_present END"""
_FLAGS = "('administrative_requirement', 'behavioral_constraint', 'reproductive_status', 'device_constraint')"

_SAT = f"""CASE category WHEN 'age' THEN {num('age')}
      WHEN 'sex' THEN CASE WHEN sex IS NULL THEN NULL WHEN contains(lower(match_text), 'female') THEN lower(sex) = 'female'
        WHEN contains(lower(match_text), 'male') THEN lower(sex) = 'male' END
      WHEN 'performance_status' THEN {num('CAST(ecog_status AS DOUBLE)')}
      WHEN 'administrative_requirement' THEN {_FLAG} = (lower(trim(split_part(value_text, ':', 2))) = 'true')
      WHEN 'reproductive_status' THEN {_FLAG} = (lower(trim(split_part(value_text, ':', 2))) = 'true')
      WHEN 'diagnosis' THEN CASE WHEN n_condition > 0 THEN n_hits IS NOT NULL END
      WHEN 'other' THEN CASE WHEN n_condition > 0 THEN n_hits IS NOT NULL END
      WHEN 'biomarker' THEN CASE WHEN n_biomarker > 0 THEN n_hits IS NOT NULL END
      WHEN 'molecular_alteration' THEN CASE WHEN n_biomarker > 0 THEN n_hits IS NOT NULL END
      WHEN 'lab_value' THEN CASE WHEN n_lab > 0 THEN CASE WHEN n_hits IS NULL THEN FALSE WHEN has_value THEN lab_ok END END
      WHEN 'line_of_therapy' THEN CASE WHEN n_line > 0 THEN coalesce({num('CAST(max_line AS DOUBLE)')}, max_line > 0) END
      WHEN 'prior_therapy' THEN CASE WHEN n_therapy > 0 THEN n_hits IS NOT NULL END
      WHEN 'concomitant_medication' THEN CASE WHEN n_active > 0 THEN CASE WHEN n_hits IS NULL THEN FALSE WHEN disallowed THEN TRUE
        WHEN context THEN NULL ELSE FALSE END END END"""

EVALS = f"""{RULES},
{PROFILE},
{HITS},
joined AS (
  SELECT req.patient_id, r.*, prof.* EXCLUDE (patient_id), agg.* EXCLUDE (patient_id, criterion_id)
  FROM requests req JOIN rules r USING (trial_id) JOIN prof USING (patient_id)
    LEFT JOIN agg ON agg.patient_id = req.patient_id AND agg.criterion_id = r.criterion_id),
sat AS (SELECT *, {_SAT} AS satisfied FROM joined),
evals AS (
  SELECT *, CASE WHEN source_type = 'structured' THEN
      CASE category
        WHEN 'age' THEN CASE WHEN age IS NULL THEN 'unknown' WHEN coalesce(age < value_low, FALSE) OR coalesce(age > value_high, FALSE) THEN 'not_matched' ELSE 'matched' END
        WHEN 'sex' THEN CASE WHEN sex IS NULL THEN 'unknown' WHEN lower(sex) = lower(value_text) THEN 'matched' ELSE 'not_matched' END
        ELSE CASE WHEN is_healthy_volunteer IS NULL THEN 'unknown' WHEN is_healthy_volunteer THEN 'not_matched' ELSE 'matched' END END
    WHEN gate IS NOT NULL THEN gate
    WHEN satisfied IS NULL THEN 'unknown'
    WHEN type = 'inclusion' THEN CASE WHEN satisfied THEN 'matched' ELSE 'not_matched' END
    ELSE CASE WHEN satisfied THEN 'triggered' ELSE 'not_triggered' END END AS outcome,
    CASE WHEN source_type = 'structured' THEN CASE category WHEN 'age' THEN age IS NULL WHEN 'sex' THEN sex IS NULL ELSE is_healthy_volunteer IS NULL END
      WHEN gate IS NOT NULL THEN category = 'concomitant_medication'
      WHEN category = 'lab_value' THEN n_lab_value = 0 WHEN category = 'biomarker' THEN n_biomarker = 0
      WHEN category IN ('prior_therapy', 'line_of_therapy') THEN n_line = 0
      WHEN category = 'concomitant_medication' THEN n_medication = 0
      WHEN category IN {_FLAGS} THEN {_FIELD} IS NOT NULL AND {_FLAG} IS NULL
      WHEN category = 'performance_status' THEN ecog_status IS NULL
      ELSE n_condition = 0 END AS missing
  FROM sat)"""

_SR = "CASE state WHEN 'review_required' THEN 3 WHEN 'blocked_unsupported' THEN 2 WHEN 'structured_low_confidence' THEN 1 ELSE 0 END"
_STATE = "CASE {r} WHEN 3 THEN 'review_required' WHEN 2 THEN 'blocked_unsupported' WHEN 1 THEN 'structured_low_confidence' ELSE 'structured_safe' END"
_REASON = "CASE {r} WHEN 3 THEN 'review_required' WHEN 2 THEN 'blocked_unsupported' WHEN 1 THEN 'low_confidence' END"


def collapse_sql(source: str, keys: str, first_type: str) -> str:
    """CTEs g0, g1 and g2: OR groups of ``source`` with their collapsed outcome and state rank."""
    return f"""g0 AS (SELECT *, {_SR} AS sr FROM {source} WHERE group_id IS NOT NULL),
g1 AS (SELECT {keys}, group_id, arg_min({first_type}, ord) AS ft, arg_min(category, ord) AS fc, min(ord) AS ord,
    count(DISTINCT category) AS n_cat, count(*) AS members, bool_or(missing) AS any_missing,
    bool_or(outcome = 'matched') AS m, bool_or(outcome = 'triggered') AS tg, bool_or(outcome = 'requires_review') AS rr,
    bool_or(outcome = 'unknown') AS uk, max(sr) AS worst, min(sr) FILTER (WHERE outcome = 'matched') AS bm,
    min(sr) FILTER (WHERE outcome = 'triggered') AS bt, min(sr) FILTER (WHERE outcome = 'requires_review') AS br
  FROM g0 GROUP BY {keys}, group_id),
g2 AS (SELECT *, CASE WHEN ft = 'inclusion' AND m THEN 'matched' WHEN ft <> 'inclusion' AND tg THEN 'triggered' WHEN rr THEN 'requires_review'
    WHEN uk THEN 'unknown' WHEN ft = 'inclusion' THEN 'not_matched' ELSE 'not_triggered' END AS outcome FROM g1),
g3 AS (SELECT *, CASE outcome WHEN 'matched' THEN bm WHEN 'triggered' THEN bt WHEN 'requires_review' THEN br ELSE worst END AS rk FROM g2)"""


def text_sql(source: str, keys: str, text: str) -> str:
    return f"""gtext AS (SELECT {keys}, group_id, string_agg({text}, ' OR ' ORDER BY o) AS group_text FROM (
    SELECT {keys}, group_id, {text}, min(ord) AS o FROM {source} WHERE group_id IS NOT NULL GROUP BY {keys}, group_id, {text})
  GROUP BY {keys}, group_id)"""


EFFECTIVE = f"""{EVALS},
{collapse_sql('evals', 'patient_id, trial_id', 'type')},
{text_sql('rules', 'trial_id', 'original_text')},
eff AS (
  SELECT patient_id, trial_id, criterion_id, ord, type, category, category AS display_category, original_text AS criterion_text, outcome, state,
    state_reason, missing, CAST(NULL AS VARCHAR) AS group_id, 1 AS members FROM evals WHERE group_id IS NULL
  UNION ALL
  SELECT patient_id, trial_id, NULL, ord, ft, fc, CASE WHEN n_cat = 1 THEN fc ELSE 'logic_group' END, group_text, outcome,
    {_STATE.format(r='rk')}, {_REASON.format(r='rk')}, any_missing OR fc = 'concomitant_medication', group_id, members
  FROM g3 JOIN gtext USING (trial_id, group_id))"""

RESULTS = f"""{EFFECTIVE},
counts AS (SELECT patient_id, trial_id, count(*) FILTER (WHERE outcome IN ('matched', 'not_triggered')) AS favorable_count,
    count(*) FILTER (WHERE outcome IN ('not_matched', 'triggered')) AS unfavorable_count,
    count(*) FILTER (WHERE outcome = 'unknown') AS unknown_count, count(*) FILTER (WHERE outcome = 'requires_review') AS requires_review_count,
    max({_SR}) AS rk FROM eff GROUP BY patient_id, trial_id),
results AS (SELECT patient_id, trial_id, favorable_count, unfavorable_count, unknown_count, requires_review_count,
    CASE WHEN unfavorable_count > 0 THEN 'ineligible' WHEN unknown_count + requires_review_count > 0 THEN 'possible' ELSE 'eligible' END AS overall_status,
    CASE WHEN favorable_count + unfavorable_count > 0 THEN favorable_count / (favorable_count + unfavorable_count) ELSE 0.0 END AS score,
    (favorable_count + unfavorable_count) / (favorable_count + unfavorable_count + unknown_count + requires_review_count) AS coverage_ratio,
    {_STATE.format(r='rk')} AS state, {_REASON.format(r='rk')} AS state_reason FROM counts)"""

BUCKET = """CASE WHEN state = 'blocked_unsupported' THEN 'unsupported'
      WHEN outcome = 'unknown' AND coalesce(state_reason, '') = 'legacy_state_unverifiable' THEN 'review_required'
      WHEN outcome = 'requires_review' OR state = 'review_required' THEN 'review_required'
      WHEN outcome = 'unknown' AND missing THEN 'missing_data'
      WHEN outcome IN ('not_matched', 'triggered') THEN CASE WHEN state = 'structured_safe' THEN 'hard_blockers' ELSE 'clarifiable_blockers' END
      WHEN outcome = 'unknown' THEN 'review_required'
      WHEN state = 'structured_low_confidence' THEN 'review_required' END"""

ENTRIES = f"""{EFFECTIVE},
entries AS (SELECT *, row_number() OVER (PARTITION BY patient_id, trial_id, bucket
      ORDER BY group_id IS NOT NULL, ord, criterion_id, group_id) - 1 AS ordinal
    FROM (SELECT *, {BUCKET} AS bucket FROM eff) WHERE bucket IS NOT NULL)"""
MATCH_VIEWS = "patients trials pipeline_runs criteria facts requests"
