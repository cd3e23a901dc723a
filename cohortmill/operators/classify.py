"""Criterion classification: category, value, context, review gates and confidence.

Every rule is a Column expression. Signals are computed once per text in one projection and the
cascades read them, which keeps each generated expression small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions import text as T
from cohortmill.functions.scale import barrier
from cohortmill.operators import values as V

STRINGS = "array<string>"

# signal column -> pattern
SIGNALS = {
    "s_age": P.AGE, "s_line": P.LINE, "s_cns": P.CNS, "s_stage": P.STAGE, "s_tnm": P.TNM, "s_numstage": P.NUMERIC_STAGE,
    "s_histology": P.HISTOLOGY, "s_molecular": P.MOLECULAR, "s_prior": P.PRIOR_THERAPY, "s_anchor": P.THERAPY_ANCHOR,
    "s_targeted": P.TARGETED_EXPOSURE, "s_concomitant": P.CONCOMITANT, "s_vaccine": P.VACCINE, "s_cyp": P.CYP,
    "s_hyper": P.HYPERSENSITIVITY, "s_organ": P.ORGAN_FUNCTION, "s_organ_complex": P.ORGAN_COMPLEX,
    "s_current": P.CURRENT_CONDITION, "s_status": P.DISEASE_STATUS, "s_procedure": P.PROCEDURAL, "s_steroid": P.CORTICOSTEROID,
    "s_immuno": P.IMMUNOSUPPRESSIVE, "s_diagnosis": P.DIAGNOSIS, "s_confirmed": P.CONFIRMED, "s_hint": P.DISEASE_HINT,
    "s_complex": P.COMPLEX, "s_allow": P.ALLOWANCE,
}
FLAG_SETS = {"v_admin": P.ADMINISTRATIVE, "v_behavior": P.BEHAVIORAL, "v_repro": P.REPRODUCTIVE, "v_device": P.DEVICE}
LABELS = ["DISEASE", "DRUG", "BIOMARKER", "LAB_TEST", "PERF_SCALE", "MEASURE"]


def first_value(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for value, pattern in reversed(rules):
        out = F.when(T.has(text, pattern), value).otherwise(out)
    return out


def add_signals(df: DataFrame) -> DataFrame:
    text = F.col("text")
    return df.select("*", *[T.has(text, p).alias(n) for n, p in SIGNALS.items()],
                     *[first_value(text, r).alias(n) for n, r in FLAG_SETS.items()])


def add_label_counts(df: DataFrame) -> DataFrame:
    count = lambda label: F.size(F.filter("mentions", lambda m: m["label"] == label))
    return df.select("*", F.size("mentions").alias("n_mentions"), *[count(x).alias(f"n_{x}") for x in LABELS])


def _has(label: str) -> Column:
    return F.col(f"n_{label}") > 0


def diagnosis_primary() -> Column:
    s = F.col
    return (
        _has("DISEASE") & ~s("s_numstage") & ~s("s_tnm") & ~_has("BIOMARKER")
        & (
            s("s_current") | s("s_diagnosis") | (s("s_confirmed") & ~s("s_anchor"))
            | ((s("n_DISEASE") >= 2) & ~s("s_anchor"))
            | (s("s_hint") & (~s("s_anchor") | s("s_confirmed")))
        )
    )


def _cascade(steps: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = otherwise
    for cond, name in reversed(steps):
        out = F.when(cond, name).otherwise(out)
    return out


def category_from_text() -> Column:
    s = F.col
    steroid = s("s_steroid") | s("s_immuno")
    return _cascade([
        (s("s_age"), "age"), (s("v_admin").isNotNull(), "administrative_requirement"),
        (s("v_behavior").isNotNull(), "behavioral_constraint"), (s("v_repro").isNotNull(), "reproductive_status"),
        (s("v_device").isNotNull(), "device_constraint"), (s("s_cns"), "cns_metastases"), (s("s_procedure"), "procedural_requirement"),
        (s("s_status") & ~s("s_prior"), "disease_status"), (s("s_current"), "diagnosis"), (s("s_line"), "line_of_therapy"),
        (s("s_prior"), "prior_therapy"), (s("s_stage"), "disease_stage"), (s("s_histology"), "histology"),
        (s("s_vaccine") | steroid, "concomitant_medication"), (s("s_molecular"), "molecular_alteration"),
        (s("s_concomitant") | s("s_cyp"), "concomitant_medication"), (s("s_organ"), "organ_function"),
    ], F.lit("other"))


def category_with_mentions() -> Column:
    s = F.col
    in_years = _has("MEASURE") & F.lower("text").contains("year")
    return _cascade([
        (s("s_age") | in_years, "age"), (diagnosis_primary(), "diagnosis"),
        (s("v_admin").isNotNull(), "administrative_requirement"), (s("v_behavior").isNotNull(), "behavioral_constraint"),
        (s("v_repro").isNotNull(), "reproductive_status"), (s("v_device").isNotNull(), "device_constraint"),
        (s("s_cns"), "cns_metastases"), (s("s_line"), "line_of_therapy"), (s("s_procedure"), "procedural_requirement"),
        (s("s_vaccine") | s("s_concomitant") | s("s_cyp") | s("s_steroid") | s("s_immuno"), "concomitant_medication"),
        (s("s_status") & ~(_has("DRUG") | s("s_prior")), "disease_status"),
        (_has("BIOMARKER") & s("s_molecular"), "molecular_alteration"), (s("s_current"), "diagnosis"),
        ((_has("BIOMARKER") & s("s_targeted")) | s("s_prior") | _has("DRUG"), "prior_therapy"),
        (s("s_stage"), "disease_stage"), (s("s_histology"), "histology"), (_has("PERF_SCALE"), "performance_status"),
        (_has("BIOMARKER"), "biomarker"), (s("s_molecular"), "molecular_alteration"), (_has("LAB_TEST"), "lab_value"),
        (_has("DISEASE"), "diagnosis"),
    ], F.col("category_text"))


def add_category(df: DataFrame) -> DataFrame:
    return df.withColumn("category_text", category_from_text()).withColumn(
        "category", F.when(F.col("n_mentions") > 0, category_with_mentions()).otherwise(F.col("category_text")))


def clean_phrase(value: Column) -> Column:
    """Medication wording without brackets, stars and a leading and/or; lower case; null when empty."""
    v = F.regexp_replace(value, r"(?U)^[*()\s]+|[*()\s]+$", "")
    v = T.strip_chars(F.regexp_replace(F.regexp_replace(v, r"(?iU)^(?:and|or)\b\s*", ""), r"(?U)\s+", " "), " ,;.")
    return F.when(F.length(v) > 0, F.lower(v))


def clean_exception(value: Column) -> Column:
    v = F.regexp_replace(clean_phrase(value), r"(?iU)^systemic\s+", "")
    return F.when(F.length(v) > 0, v)


def medication_wording(text: Column) -> Column:
    """Vaccine, CYP, corticosteroid or immunosuppressive wording of a restriction, in that order."""
    return (
        F.when(T.has(text, P.LIVE_VACCINE), clean_phrase(T.grab(text, P.LIVE_VACCINE)))
        .when(T.has(text, P.VACCINE), clean_phrase(T.grab(text, P.VACCINE)))
        .when(T.has(text, P.CYP), F.lit("cyp3a4 inhibitors/inducers"))
        .when(T.has(text, P.CORTICOSTEROID), clean_phrase(T.grab(text, P.CORTICOSTEROID)))
        .when(T.has(text, P.IMMUNOSUPPRESSIVE), clean_phrase(T.grab(text, P.IMMUNOSUPPRESSIVE)))
    )


def _drugs(mentions: Column, keep=None) -> Column:
    d = F.filter(mentions, lambda m: (m["label"] == "DRUG") if keep is None else ((m["label"] == "DRUG") & keep(m)))
    return F.array_distinct(F.array_compact(F.transform(d, lambda m: clean_phrase(F.coalesce(m["expanded_text"], m["text"])))))


def therapy_wording(text: Column, mentions: Column) -> Column:
    drug = F.get(_drugs(mentions), 0)
    return F.coalesce(clean_phrase(T.grab(text, P.THERAPY_FIRST)), drug, clean_phrase(T.grab(text, P.THERAPY_LAST)))


def add_medication(df: DataFrame) -> DataFrame:
    """exception_logic, exception_entities and allowance_text of medication restrictions."""
    text, mentions, exc = F.col("text"), F.col("mentions"), F.col("exception_text")
    is_med = F.col("category") == "concomitant_medication"
    none = F.array().cast(STRINGS)
    before = F.when(F.length(exc) > 0, V.exception_start(text))
    named = _drugs(mentions, lambda m: before.isNull() | (m["start"] < before))
    worded = medication_wording(text)
    base = F.when(F.size(named) > 0, named).when(worded.isNotNull(), F.array(worded)).otherwise(none)

    at = F.instr(F.lower(text), F.lower(exc)) - 1
    inside = F.filter(mentions, lambda m: (m["label"] == "DRUG") & (m["start"] >= at) & (m["start"] < at + F.length(exc)))
    inside = F.array_distinct(F.array_compact(F.transform(inside, lambda m: clean_exception(F.coalesce(m["expanded_text"], m["text"])))))
    body = F.regexp_replace(T.strip_ws(F.get(F.split(exc, T.ci(P.EXCEPTION_STOP), 2), 0)), r"(?iU)^for\s+", "")
    listed = F.array_distinct(F.array_compact(F.transform(
        F.split(body, r"(?U)\s*,\s*|\s+\bor\b\s+|\s+\band/or\b\s+"), clean_exception)))
    entities = F.when((F.length(exc) > 0) & ~T.has(exc, P.PHYSIOLOGIC), F.when(F.size(inside) > 0, inside).otherwise(listed)).otherwise(none)

    source = F.concat_ws(" ", text, F.when(F.length(exc) > 0, exc))
    low = F.lower(exc)
    permitted = low.contains("allowed") | low.contains("permitted") | low.contains("replacement dose")
    allowance = F.when(T.has(source, P.PHYSIOLOGIC), clean_phrase(T.grab(source, P.PHYSIOLOGIC))).when(
        (F.length(exc) > 0) & permitted, T.strip_ws(exc))

    d = df.withColumn("_base", F.when(is_med, base).otherwise(none))
    usable = F.size("_base") > 0
    d = d.withColumn("exception_entities", F.when(usable, entities).otherwise(none)).withColumn(
        "allowance_text", F.when(usable, allowance))
    mode = (
        F.when(F.length("allowance_text") > 0, "prohibited_with_allowance")
        .when(F.size("exception_entities") > 0, "prohibited_with_exception")
        .when(F.col("timeframe").isNotNull(), "washout_window").otherwise("restriction")
    )
    return d.withColumn("exception_logic", F.when(usable, F.struct(
        mode.alias("mode"), F.col("_base").alias("base_entities"), F.col("timeframe").isNotNull().alias("has_timeframe"),
        F.when(F.length(exc) > 0, exc).alias("exception_text")))).drop("_base")


def add_context(df: DataFrame) -> DataFrame:
    """Specimens, testing modalities, subtype, histology and the secondary tags."""
    text, cat = F.col("text"), F.col("category")
    listed = lambda rules: F.array_compact(F.array(*[F.when(T.has(text, p), v) for v, p in rules]))
    histology = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(T.ci(P.HISTOLOGY_VALUE)), F.lit(0)))
    d = df.withColumn("specimen_types", listed(P.SPECIMENS)).withColumn("testing_modalities", listed(P.MODALITIES)).withColumn(
        "disease_subtype", F.when(T.has(text, P.NSCLC), "non-small cell").when(T.has(text, P.SCLC), "small cell")
    ).withColumn("_h", F.array_join(histology, ", ")).withColumn("histology_text", F.when(F.length("_h") > 0, F.col("_h"))).drop("_h")
    s = F.col
    tags = F.array_compact(F.array(
        F.when(F.size("specimen_types") > 0, "specimen_context"), F.when(F.size("testing_modalities") > 0, "testing_modality"),
        F.when(cat.isin("prior_therapy", "line_of_therapy", "concomitant_medication") & s("s_status"), "progression_requirement"),
        F.when(cat.isin("diagnosis", "cns_metastases") & s("s_stage"), "stage_context"),
        F.when((cat == "diagnosis") & s("s_prior"), "therapy_context"),
        F.when(cat.isin("diagnosis", "histology") & s("s_histology"), "histology_context"),
        F.when(s("exception_logic").isNotNull(), "medication_logic"),
        F.when(F.size("exception_entities") > 0, "medication_exception_entities"),
        F.when(F.length("allowance_text") > 0, "medication_allowance"),
    ))
    return d.withColumn("secondary_semantic_tags", tags)


def semantic_value() -> Column:
    cat, text = F.col("category"), F.col("text")
    return (
        F.when(cat == "administrative_requirement", F.col("v_admin")).when(cat == "behavioral_constraint", F.col("v_behavior"))
        .when(cat == "reproductive_status", F.col("v_repro")).when(cat == "device_constraint", F.col("v_device"))
        .when(cat.isin("prior_therapy", "line_of_therapy"), therapy_wording(text, F.col("mentions")))
        .when(cat == "concomitant_medication", medication_wording(text))
        .when(cat == "disease_status", F.lower(T.grab(text, P.DISEASE_STATUS)))
        .when(cat == "disease_stage", F.lower(T.grab(text, P.STAGE_VALUE)))
    )


def text_only_policy() -> Column:
    """STRUCT<parse_status, base, review> for texts without mentions."""
    s, cat = F.col, F.col("category")
    row = lambda status, base, review: F.struct(F.lit(status).alias("parse_status"), F.lit(base).alias("base"), F.lit(review).alias("review"))
    plain = ["histology", "diagnosis", "cns_metastases", "disease_stage", "disease_status", "procedural_requirement",
             "administrative_requirement", "behavioral_constraint", "reproductive_status", "device_constraint",
             "prior_therapy", "line_of_therapy"]
    med_complex = s("s_complex") & ~(s("s_vaccine") | s("s_steroid") | s("s_cyp"))
    return (
        F.when(cat.isin(plain), row("parsed", 0.6, False))
        .when(cat == "concomitant_medication", F.when(med_complex, row("partial", 0.3, True)).otherwise(row("parsed", 0.6, False)))
        .when((cat == "organ_function") & ~s("s_organ_complex"), row("parsed", 0.6, False))
        .when(s("s_hyper"), row("partial", 0.6, False))
        .when(cat == "other", row("unparsed", 0.0, True))
        .otherwise(row("partial", 0.3, True))
    )


def review_gate() -> Column:
    """True where the criterion is too complex to be read without review."""
    s, cat = F.col, F.col("category")
    mixed = (_has("BIOMARKER") | s("s_molecular")) & (s("s_stage") | s("s_tnm"))
    nested = cat.isin("prior_therapy", "line_of_therapy") & T.has(F.col("text"), r"\bincluding\b") & (
        F.regexp_count("text", F.lit(T.ci(P.AT_LEAST_COUNT))) >= 2)
    cns = (cat == "cns_metastases") & s("s_allow") & s("s_cns")
    low = F.lower("text")
    med_review = (cat == "concomitant_medication") & (low.contains("whichever is longer") | low.contains("whichever is shorter"))
    med_structured = (cat == "concomitant_medication") & s("exception_logic").isNotNull() & ~med_review
    crowded = (s("n_mentions") != 1) | (cat == "molecular_alteration") | med_review
    return mixed | nested | cns | (~med_structured & s("s_complex") & crowded)


def overloaded() -> Column:
    cat = F.col("category")
    return (
        (cat.isin("diagnosis", "molecular_alteration") & (F.col("n_mentions") >= 3))
        | ((cat == "diagnosis") & F.col("s_molecular")) | ((cat == "molecular_alteration") & F.col("s_stage"))
    )


def confidence(base: Column, with_mentions: Column, has_quantity: Column, has_time: Column, value: Column) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    assay = (F.size("specimen_types") > 0) | (F.size("testing_modalities") > 0)
    crowded = overloaded() & (with_mentions | F.col("s_molecular") | F.col("s_stage"))
    penalty = F.when(crowded, F.when((F.col("category") == "molecular_alteration") & assay, 0.06).otherwise(0.18)).otherwise(0.0)
    n_exc, n_tags = F.size("exception_entities"), F.size("secondary_semantic_tags")
    score = (
        base + add(with_mentions, 0.12) + add(has_quantity, 0.08) + add(has_time, 0.08)
        + add(F.size("specimen_types") > 0, 0.05) + add(F.size("testing_modalities") > 0, 0.05) + add(assay, 0.06)
        + add(F.col("exception_logic").isNotNull(), 0.06) + F.least(F.lit(0.06), n_exc * 0.02)
        + add(F.coalesce(F.length("allowance_text") > 0, F.lit(False)), 0.04) + add(F.col("disease_subtype").isNotNull(), 0.05)
        + add(F.col("histology_text").isNotNull(), 0.05) + F.least(F.lit(0.08), n_tags * 0.02)
        + add(F.coalesce(F.length(value) > 0, F.lit(False)), 0.07)
        + add((F.length("text") > 0) & (F.length("text") < 180), 0.03) - penalty
    )
    return score


def first_quantity(text: Column, mentions: Column) -> Column:
    """Quantity of the first numeric mention, else of the whole text."""
    numeric = F.get(F.filter(mentions, lambda m: m["label"].isin("MEASURE", "CARDINAL")), 0)
    return F.coalesce(V.quantity(numeric["text"]), V.quantity(text))


def add_path(df: DataFrame) -> DataFrame:
    """How a text is read: gated, exception (no mentions), sex_only, text_only or full."""
    return df.withColumn("path", F.when(review_gate(), "gated").when(F.col("n_mentions") > 0, "full")
                         .when(F.col("exception_text").isNotNull(), "exception")
                         .when(T.has(F.col("text"), P.SEX_ONLY), "sex_only").otherwise("text_only"))


def classify(df: DataFrame, group_key: list[str]) -> DataFrame:
    """Adds every classification column to rows with text and mentions."""
    d = barrier(add_category(add_label_counts(add_signals(df))))
    text = F.col("text")
    d = d.withColumn("exception_text", V.exception_text(text)).withColumn("timeframe", V.timeframe(text)).withColumn(
        "negated", V.negation_start(text).isNotNull())
    d = barrier(add_path(add_context(add_medication(d))))
    full, sex = F.col("path") == "full", F.col("path") == "sex_only"
    d = d.withColumn("quantity", F.when(full, first_quantity(text, F.col("mentions"))))
    # "at least 18 years" in an age criterion is an age, not a timeframe
    tf = F.col("timeframe")
    age_op = F.when(tf["operator"] == "at_least", "gte").when(tf["operator"] == "no_more", "lte")
    from_time = full & (F.col("category") == "age") & F.col("quantity").isNull() & (tf["unit"] == "years") & age_op.isNotNull()
    age_quantity = F.struct(age_op.alias("operator"), tf["value"].alias("value_low"), F.lit(None).cast("double").alias("value_high"),
                            tf["unit"].alias("unit"), text.alias("raw_expression"))
    d = d.withColumn("_ft", F.coalesce(from_time, F.lit(False))).withColumn("quantity", F.when(F.col("_ft"), age_quantity).otherwise(F.col("quantity")))
    d = d.withColumn("timeframe", F.when(~F.col("_ft"), tf)).withColumn("policy", text_only_policy())
    qualifier = F.lower(T.grab(text, P.QUALIFIER, 1))
    value = F.when(sex, F.lower(T.grab(text, P.SEX_ONLY, 1))).when(
        full & (F.col("category") == "biomarker") & qualifier.isNotNull(), qualifier).otherwise(semantic_value())
    d = d.withColumn("value_text", value)
    text_only = F.col("path") == "text_only"
    partial = F.col("path").isin("gated", "exception")
    status = F.when(partial | sex, "partial").when(full, "parsed").otherwise(F.col("policy.parse_status"))
    d = d.withColumn("parse_status", status)
    base = F.when(text_only, F.col("policy.base")).when(partial, 0.42).otherwise(0.52)
    mentioned = F.col("path").isin("gated", "full") & (F.col("n_mentions") > 0)
    score = confidence(base, mentioned, F.col("quantity").isNotNull(), F.col("timeframe").isNotNull(), F.col("value_text"))
    capped = F.greatest(F.lit(0.0), F.least(F.when(F.col("parse_status") == "partial", F.least(score, F.lit(0.58))).otherwise(score), F.lit(0.92)))
    d = d.withColumn("confidence", F.when(sex, 0.6).when(F.col("parse_status") == "unparsed", 0.0).otherwise(capped))
    review = partial | (text_only & F.col("policy.review"))
    read_logic = F.col("path").isin("gated", "full")
    operator = F.when(read_logic, V.logic_operator(text)).otherwise("AND")
    group = F.sha1(F.concat_ws(":", *[F.col(c).cast("string") for c in group_key], F.lit("logic")))
    plain = ~sex
    assay = (F.size("specimen_types") > 0) | (F.size("testing_modalities") > 0)
    return barrier(d.select(
        *df.columns, "path",
        F.when(sex, "other").otherwise(F.col("category")).alias("category"),
        F.when(plain, F.col("category")).alias("primary_semantic_category"),
        F.when(plain, F.col("secondary_semantic_tags")).otherwise(F.array().cast(STRINGS)).alias("secondary_semantic_tags"),
        "parse_status", F.col("quantity.operator").alias("operator"), F.col("quantity.value_low").alias("value_low"),
        F.col("quantity.value_high").alias("value_high"), "value_text", F.col("quantity.unit").alias("unit"),
        F.when(sex, text).otherwise(F.col("quantity.raw_expression")).alias("raw_expression"),
        (plain & F.col("negated")).alias("negated"),
        F.when(plain, F.col("timeframe.operator")).alias("timeframe_operator"),
        F.when(plain, F.col("timeframe.value")).alias("timeframe_value"), F.when(plain, F.col("timeframe.unit")).alias("timeframe_unit"),
        F.when(plain, F.get("specimen_types", 0)).alias("specimen_type"),
        F.when(plain, F.get("testing_modalities", 0)).alias("testing_modality"),
        F.when(plain, F.col("disease_subtype")).alias("disease_subtype"), F.when(plain, F.col("histology_text")).alias("histology_text"),
        F.when(plain & assay, F.struct("specimen_types", "testing_modalities")).alias("assay_context"),
        F.when(plain, F.col("exception_logic")).alias("exception_logic"), "exception_entities", "allowance_text",
        operator.alias("read_operator"), F.when(operator == "OR", group).alias("read_group"),
        F.round("confidence", 10).alias("confidence"), review.alias("needs_review"),
        F.when(review, "complex_criteria").alias("needs_review_reason"),
    ))
