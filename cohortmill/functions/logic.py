"""Three-valued predicates: every function returns a nullable boolean or an outcome string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.5

FLAG_CATEGORIES = ["administrative_requirement", "behavioral_constraint", "reproductive_status", "device_constraint"]
PATIENT_FLAGS = ["can_consent", "protocol_compliant", "claustrophobic", "motion_intolerant", "pregnant", "mr_device_present"]
# category -> kind of patient fact it is compared with
FACT_KIND = {
    "diagnosis": "condition",
    "disease_stage": "condition",
    "histology": "condition",
    "cns_metastases": "condition",
    "other": "condition",
    "biomarker": "biomarker",
    "molecular_alteration": "biomarker",
    "lab_value": "lab",
    "prior_therapy": "therapy",
    "line_of_therapy": "therapy",
    "concomitant_medication": "medication",
}
NEVER_EVALUATED = ["procedural_requirement", "disease_status"]


def age_years(birth: Column, as_of: Column) -> Column:
    """Calendar age: the year difference, less one before the birthday."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return (F.year(as_of) - F.year(birth) - before.cast("int")).cast("double")


def parse_age(text: Column) -> Column:
    """First number in an age text; the unit is ignored."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)
    return F.when(F.length(number) > 0, number.cast("double"))


def numeric_satisfied(op: Column, low: Column, high: Column, actual: Column) -> Column:
    """Compare a value with a parsed quantity; null where nothing can be said."""
    has_low = low.isNotNull()
    return (
        F.when(actual.isNull(), F.lit(None).cast("boolean"))
        .when((op == "gte") & has_low, actual >= low)
        .when((op == "gt") & has_low, actual > low)
        .when((op == "lte") & has_low, actual <= low)
        .when((op == "lt") & has_low, actual < low)
        .when((op == "eq") & has_low, actual == low)
        .when((op == "neq") & has_low, actual != low)
        .when(op == "between", (low.isNull() | (actual >= low)) & (high.isNull() | (actual <= high)))
        .when(has_low & high.isNotNull(), (actual >= low) & (actual <= high))
    )


def polarity(kind: Column, satisfied: Column) -> Column:
    return (
        F.when(satisfied.isNull(), F.lit(None).cast("string"))
        .when(kind == "inclusion", F.when(satisfied, "matched").otherwise("not_matched"))
        .otherwise(F.when(satisfied, "triggered").otherwise("not_triggered"))
    )


def sex_matches(expected: Column, sex: Column) -> Column:
    """"female" is looked for before "male", because it contains it."""
    want = F.lower(expected)
    have = F.lower(sex)
    return F.when(want.contains("female"), have == "female").when(want.contains("male"), have == "male")


def flag_field(value_text: Column) -> Column:
    """Field of a "field:true" expression; null unless the value is true or false."""
    value = F.lower(F.trim(F.regexp_replace(value_text, "^[^:]*:", "")))
    return F.when(
        value_text.contains(":") & value.isin("true", "false"), F.trim(F.substring_index(value_text, ":", 1))
    )


def flag_expected(value_text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value_text, "^[^:]*:", ""))) == "true"


def flag_value(field: Column) -> Column:
    """Value of the named patient flag column; null for an unknown field."""
    out = F.lit(None).cast("boolean")
    for name in PATIENT_FLAGS:
        out = F.when(field == name, F.col(name)).otherwise(out)
    return out


def criterion_state(review_status: Column, review_required: Column, confidence: Column) -> Column:
    return (
        F.when(review_status == "rejected", "blocked_unsupported")
        .when(review_status.isin("accepted", "corrected"), "structured_safe")
        .when(review_required, "review_required")
        .when(F.coalesce(confidence, F.lit(0.0)) < LOW_CONFIDENCE, "structured_low_confidence")
        .otherwise("structured_safe")
    )


def criterion_state_reason(state: Column, review_reason: Column) -> Column:
    reason = F.when(F.length(review_reason) > 0, review_reason).otherwise("unspecified_review_reason")
    return (
        F.when(state == "blocked_unsupported", "rejected")
        .when(state == "review_required", F.concat(F.lit("review_required:"), reason))
        .when(state == "structured_low_confidence", "low_confidence")
    )


# Worst-first rank of the four confidence states.
STATE_RANK = {"review_required": 3, "blocked_unsupported": 2, "structured_low_confidence": 1, "structured_safe": 0}
_REASON = {3: "review_required", 2: "blocked_unsupported", 1: "low_confidence"}


def state_rank(state: Column) -> Column:
    return (
        F.when(state == "review_required", 3)
        .when(state == "blocked_unsupported", 2)
        .when(state == "structured_low_confidence", 1)
        .otherwise(0)
    )


def rank_to_state(rank: Column) -> Column:
    out = F.lit("structured_safe")
    for name, code in STATE_RANK.items():
        out = F.when(rank == code, name).otherwise(out)
    return out


def rank_to_reason(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in _REASON.items():
        out = F.when(rank == code, name).otherwise(out)
    return out
