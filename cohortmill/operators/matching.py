"""Matching: requested (patient, trial) pairs against trial rules under three-valued logic.

The work list is a table of requests (patient_id, trial_id); rows grow with what was asked for.
Trial-side work (state, suppression, OR-group texts) is done once per trial, patient-side work
(age, fact counts) once per patient, and the two meet in equi-joins on the request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.functions import logic as L
from cohortmill.functions import text as T
from cohortmill.functions.scale import HOT_ROWS, SPLITS, barrier, hot_keys, range_rank, split_join, stage

CONCEPTS = "array<struct<system:string,code:string,display:string,match_type:string>>"
# Optional criterion columns and their types; absent ones are added as null.
RULE_COLUMNS = {
    "original_text": "string", "raw_expression": "string", "value_text": "string", "operator": "string",
    "value_low": "double", "value_high": "double", "unit": "string", "review_status": "string",
    "review_required": "boolean", "review_reason": "string", "confidence": "double",
    "logic_group_id": "string", "logic_operator": "string", "coded_concepts": CONCEPTS,
    "exception_entities": "array<string>", "allowance_text": "string", "timeframe_operator": "string",
    "timeframe_value": "double", "timeframe_unit": "string", "exception_logic": "string",
}
FACT_COLUMNS = {
    "coded_concepts": CONCEPTS, "value_numeric": "double", "value_text": "string", "unit": "string",
    "line_of_therapy": "int", "completed": "boolean", "active": "boolean",
}
INTERVAL_OPS = ["gte", "gt", "lte", "lt", "neq"]
FREQUENT = 256  # tokens whose frequency is known to the token index


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in wanted],
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()],
    )


def requests_for(trials: DataFrame, patient_ids: list) -> DataFrame:
    """Requests of the named patients against every trial (linear in the trials)."""
    ids = F.array(*[F.lit(p) for p in patient_ids])
    return trials.select(F.explode(ids).alias("patient_id"), "trial_id")


def concept_keys(concepts: Column) -> Column:
    """Case-folded "system|code" keys of complete concepts."""
    full = F.filter(concepts, lambda c: (F.length(c["system"]) > 0) & (F.length(c["code"]) > 0))
    keys = F.transform(full, lambda c: F.lower(F.concat_ws("|", c["system"], c["code"])))
    return F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))


# ---------------------------------------------------------------- trial side

def _uses_age(t=F.col) -> Column:
    return (F.coalesce(F.length(t("eligible_min_age")), F.lit(0)) > 0) | (
        F.coalesce(F.length(t("eligible_max_age")), F.lit(0)) > 0
    )


def _uses_sex(t=F.col) -> Column:
    sex = t("eligible_sex")
    return F.coalesce((F.length(sex) > 0) & (sex != "ALL"), F.lit(False))


def structured_rules(trials: DataFrame, latest: DataFrame) -> DataFrame:
    """One rule row per structured restriction of a trial (age, sex, healthy volunteers)."""
    kinds = F.array_compact(F.array(
        F.when(_uses_age(), "age"),
        F.when(_uses_sex(), "sex"),
        F.when(F.col("accepts_healthy") == F.lit(False), "healthy_volunteers"),
    ))
    rows = trials.join(latest.hint("merge"), "trial_id", "left").withColumn("category", F.explode(kinds))
    text = (
        F.when(F.col("category") == "age", "ClinicalTrials.gov structured age eligibility")
        .when(F.col("category") == "sex",
              F.concat(F.lit("ClinicalTrials.gov structured sex eligibility: "), F.col("eligible_sex")))
        .otherwise("ClinicalTrials.gov structured healthy volunteer restriction")
    )
    place = F.when(F.col("category") == "age", -3).when(F.col("category") == "sex", -2).otherwise(-1)
    is_age = F.col("category") == "age"
    rules = rows.select(
        "trial_id", F.lit(None).cast("long").alias("criterion_id"), "run_id", place.cast("long").alias("ord"),
        F.lit("structured").alias("source_type"), F.lit("inclusion").alias("type"), "category",
        text.alias("original_text"), F.lit("structured_safe").alias("state"),
        F.lit(None).cast("string").alias("state_reason"), F.lit(None).cast("string").alias("gate"),
        F.lit(None).cast("string").alias("fact_kind"), F.lit("").alias("match_text"),
        F.when(is_age, L.parse_age(F.col("eligible_min_age"))).alias("value_low"),
        F.when(is_age, L.parse_age(F.col("eligible_max_age"))).alias("value_high"),
        F.when(F.col("category") == "sex", F.col("eligible_sex")).alias("value_text"),
    )
    return with_columns(rules, RULE_COLUMNS)


def extracted_rules(current: DataFrame, trials: DataFrame) -> DataFrame:
    """Applicable criteria of each trial with their state and review gate."""
    c = with_columns(current, RULE_COLUMNS)
    flags = trials.select("trial_id", _uses_age().alias("_age"), _uses_sex().alias("_sex"))
    state = L.criterion_state(F.col("review_status"), F.col("review_required"), F.col("confidence"))
    kind = F.lit(None).cast("string")
    for category, fact_kind in L.FACT_KIND.items():
        kind = F.when(F.col("category") == category, fact_kind).otherwise(kind)
    rows = (
        c.where(~F.col("category").isin(L.NEVER_EVALUATED))
        .join(flags.hint("merge"), "trial_id")
        .where(~((F.col("category") == "age") & F.col("_age")) & ~((F.col("category") == "sex") & F.col("_sex")))
        .withColumn("state", state)
        .withColumn("state_reason", L.criterion_state_reason(F.col("state"), F.col("review_reason")))
        .withColumn(
            "gate",
            F.when(F.col("review_required") & (F.col("review_status") == "pending"), "requires_review")
            .when(F.col("state") == "blocked_unsupported", "unknown"),
        )
        .withColumn("fact_kind", F.when(F.col("gate").isNull(), kind))
        .withColumn(
            "match_text",
            F.coalesce(T.first_filled(F.col("value_text"), F.col("raw_expression"), F.col("original_text")), F.lit("")),
        )
        .withColumn("source_type", F.lit("extracted"))
    )
    return rows


def trial_rules(trials: DataFrame, runs: DataFrame, criteria: DataFrame) -> DataFrame:
    """All rules of every trial: structured restrictions and applicable current criteria."""
    from cohortmill.operators.runs import current_criteria, latest_completed_runs_for_matching

    latest = latest_completed_runs_for_matching(runs)
    ext = extracted_rules(current_criteria(criteria, latest), trials)
    st = structured_rules(trials, latest)
    return st.unionByName(ext.select(*st.columns))


# -------------------------------------------------------------- patient side

def fact_profile(facts: DataFrame) -> DataFrame:
    """Per-patient fact counts that decide unknown against definite no."""
    def n(kind: str, extra: Column | None = None) -> Column:
        cond = F.col("kind") == kind
        return F.count_if(cond if extra is None else cond & extra)

    f = with_columns(facts, FACT_COLUMNS)
    return f.groupBy("patient_id").agg(
        n("condition").alias("n_condition"),
        n("biomarker").alias("n_biomarker"),
        n("lab").alias("n_lab"),
        n("lab", F.col("value_numeric").isNotNull()).alias("n_lab_value"),
        n("therapy").alias("n_therapy"),
        n("therapy", F.col("line_of_therapy").isNotNull()).alias("n_line"),
        F.max(F.when(F.col("kind") == "therapy", F.col("line_of_therapy"))).alias("max_line"),
        n("medication").alias("n_medication"),
        n("medication", F.col("active")).alias("n_active"),
    )


COUNTS = ["n_condition", "n_biomarker", "n_lab", "n_lab_value", "n_therapy", "n_line", "n_medication", "n_active"]


def patient_profile(patients: DataFrame, facts: DataFrame, as_of: str) -> DataFrame:
    scalars = {"sex": "string", "birth_date": "date", "ecog_status": "int", "is_healthy_volunteer": "boolean",
               **{f: "boolean" for f in L.PATIENT_FLAGS}}
    p = with_columns(patients, scalars)
    return (
        p.select("patient_id", L.age_years(F.col("birth_date"), F.lit(as_of).cast("date")).alias("age"),
                 *[c for c in scalars if c != "birth_date"])
        .join(fact_profile(facts).hint("merge"), "patient_id", "left")
        .fillna(0, COUNTS)
    )


def _searchable(facts: DataFrame) -> DataFrame:
    """Distinct (patient, kind, description, codes): what a text or code match can tell apart."""
    f = with_columns(facts, FACT_COLUMNS)
    usable = (F.col("kind") != "medication") | F.col("active")
    return (
        f.where(usable)
        .select(
            "patient_id", "kind", "description", "value_numeric",
            F.array_sort(concept_keys(F.col("coded_concepts"))).alias("codes"),
        )
        .withColumn("fact_key", F.concat_ws("\x01", F.coalesce("description", F.lit("")), F.array_join("codes", "\x02")))
    )


def frequent_tokens(*texts: DataFrame) -> Column:
    """How often a token occurs, for the FREQUENT most frequent ones of one-column frames of texts; 0 for all others: a map of bounded size.

    Equal texts are counted before they are cut into tokens.
    """
    words = None
    for df in texts:
        one = df.groupBy(F.col(df.columns[0]).alias("x")).count().select("count", F.explode(T.tokens(F.col("x"))).alias("t"))
        words = one if words is None else words.unionByName(one)
    top = words.groupBy("t").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "t").limit(FREQUENT).collect()
    return F.create_map(*[F.lit(x) for r in top for x in (r["t"], r["count"])]) if top else F.create_map().cast("map<string,bigint>")


def rare_first(toks: Column, counts: Column) -> Column:
    """Tokens in one order for all sets: those that are not frequent by text, then the frequent ones, the most frequent last."""
    ranked = F.array_sort(F.transform(toks, lambda t: F.struct(F.coalesce(F.element_at(counts, t), F.lit(0)).alias("n"), t.alias("t"))))
    return F.transform(ranked, lambda x: x["t"])


def posted_keys(ordered: Column, codes: Column, asks: str, answers: str) -> Column:
    """Index keys of a token set in rare-first order and its codes.

    Sets match by two common tokens or by the whole of the smaller one, so of two sets with more than one token each one of the
    common tokens is not the last of its set: the last token (the most frequent) is left out. A single token has to find
    last tokens, too: it ``asks`` for them, and a set of more ``answers`` with its last token.
    """
    tag = lambda prefix, xs: F.transform(xs, lambda t: F.concat(F.lit(prefix), t))
    n = F.size(ordered)
    return F.concat(
        tag("t:", F.slice(ordered, 1, F.greatest(n - 1, F.least(n, F.lit(1))))),
        F.when(n == 1, tag(asks, ordered)).when(n > 1, tag(answers, F.slice(ordered, -1, 1))).otherwise(F.array().cast("array<string>")),
        tag("c:", codes))


def fact_candidates(asked: DataFrame, rules: DataFrame, facts: DataFrame, hot_trials: list | None = None, hot_patients: list | None = None,
                    counts: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Pairs of a criterion and a fact of a patient that share a posted key, each with both token sets; a pair may come up once per key.

    One inverted-index equi-join on (patient, hash of kind and key); the rows of ``hot_patients`` are spread by criterion. The rows of
    requests and keys, the most there are, hold ids and a 32-bit hash only: what is known of the rule (with the columns ``keep``) joins the few
    rows that found a fact. Unequal keys of one hash come up, too, so hits have to be judged on the sets.
    """
    texts = rules.where(F.col("fact_kind").isNotNull())
    known = _searchable(facts).groupBy("patient_id", "kind", "fact_key", "codes").agg(
        F.min("description").alias("description"), F.min("value_numeric").alias("_vmin"), F.max("value_numeric").alias("_vmax"))
    counts = frequent_tokens(texts.select("match_text"), facts.select("description")) if counts is None else counts
    # Tokens and keys of a rule are made before it meets the patients who asked for its trial.
    sets = texts.select("trial_id", "criterion_id", "fact_kind", rare_first(T.tokens(F.col("match_text")), counts).alias("_l"), concept_keys(F.col("coded_concepts")).alias("_c"), *(keep or []))
    posted = sets.select("trial_id", "criterion_id", F.transform(posted_keys(F.col("_l"), F.col("_c"), "1:", "2:"), lambda k: F.hash("fact_kind", k)).alias("_keys")).where(F.size("_keys") > 0)
    left = split_join(asked, posted, "trial_id", ["patient_id"], hot_trials or []).select("patient_id", "criterion_id", F.explode("_keys").alias("_hash"))
    ordered = rare_first(T.tokens(F.col("description")), counts)
    right = known.select("*", F.explode(posted_keys(ordered, F.col("codes"), "2:", "1:")).alias("key")).withColumn("_hash", F.hash("kind", "key"))
    on = ["patient_id", "_hash"]
    if hot_patients:
        is_hot = F.coalesce(F.col("patient_id").cast("string").isin(*hot_patients), F.lit(False))
        left = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64("criterion_id"), F.lit(SPLITS)).cast("int")).otherwise(0))
        right = right.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))))
        on.append("_part")
    met = left.join(right.hint("merge"), on).drop("_hash", "_part")
    return met.join(sets.hint("merge"), "criterion_id").where(F.col("fact_kind") == F.col("kind")).withColumn("_r", ordered)


def matched_facts(*args, **kwargs) -> DataFrame:
    """Candidates (see ``fact_candidates``) whose fact matches the criterion by code or by tokens; a pair may come up once per common code.

    A pair found by tokens is judged on its whole sets, under its rarest common token only.
    """
    n = F.size("_common")
    by_text = ((n >= 2) | ((n > 0) & (n == F.least(F.size("_l"), F.size("_r"))))) & (
        ~F.col("key").startswith("t:") | (F.col("key") == F.concat(F.lit("t:"), F.get("_common", F.lit(0)))))
    by_code = F.col("key").startswith("c:") & F.arrays_overlap("_c", "codes")
    return fact_candidates(*args, **kwargs).withColumn("_common", F.array_intersect("_l", "_r")).where(by_code | by_text)


def fact_hits(asked: DataFrame, rules: DataFrame, facts: DataFrame, hot_trials: list | None = None, hot_patients: list | None = None) -> DataFrame:
    """(patient, criterion, kind, fact_key) where a fact matches a criterion by code or by tokens."""
    return matched_facts(asked, rules, facts, hot_trials, hot_patients).select("patient_id", "criterion_id", "kind", "fact_key").distinct()


def _medication_verdict() -> Column:
    """fine, context or disallowed for one matched medication."""
    med_tokens = T.tokens(F.col("description"))
    excepted = F.exists(
        F.coalesce("exception_entities", F.array().cast("array<string>")),
        lambda e: T.overlaps(T.tokens(e), med_tokens),
    )
    allowance = F.lower(F.col("allowance_text"))
    described = F.lower(F.coalesce("description", F.lit("")))
    word = F.lit(False)
    for w in ("physiologic", "replacement", "maintenance"):
        word = word | described.contains(w)
    permits = F.when(allowance.contains("physiologic"), word).otherwise(
        T.overlaps(T.tokens(F.col("allowance_text")), med_tokens)
    )
    timed = (F.length("timeframe_operator") > 0) | F.col("timeframe_value").isNotNull() | (F.length("timeframe_unit") > 0)
    return (
        F.when(excepted, "fine")
        .when(F.coalesce(F.length("allowance_text") > 0, F.lit(False)), F.when(permits, "fine").otherwise("context"))
        .when(F.coalesce(timed, F.lit(False)), "context")
        .otherwise("disallowed")
    )


def value_interval() -> tuple[Column, Column]:
    """Bounds of the values that satisfy a criterion that is not one-sided; null where none can. NaN is above all numbers."""
    op, low, high = F.col("operator"), F.col("value_low"), F.col("value_high")
    both = low.isNotNull() & high.isNotNull()
    no_less = F.when((op == "eq") & low.isNotNull(), low).when(op == "between", F.coalesce(low, F.lit(float("-inf")))).when(both, low)
    no_more = F.when((op == "eq") & low.isNotNull(), low).when(op == "between", F.coalesce(high, F.lit(float("nan")))).when(both, high)
    return no_less, no_more


def in_interval(asked: DataFrame, values: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``asked`` (by, keep, low, high) for which ``values`` (by, value) holds a value from low to high.

    One sorted sweep per ``by``: going down, the last value seen is the least one that is not below a row's low end. The work is
    that of a sort of both sides, however many values an interval or a patient holds; nothing is paired.
    """
    none = [F.lit(None).cast(dict(asked.dtypes)[c]).alias(c) for c in keep]
    line = asked.select(*by, F.col("low").alias("x"), F.lit(1).alias("side"), "high", *keep).unionByName(
        values.select(*by, F.col("value").alias("x"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("high"), *none))
    down = Window.partitionBy(*by).orderBy(F.desc("x"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("least", F.last(F.when(F.col("side") == 0, F.col("x")), ignorenulls=True).over(down))
    return seen.where((F.col("side") == 1) & (F.col("least") <= F.col("high"))).select(*by, *keep)


def fact_results(asked: DataFrame, rules: DataFrame, facts: DataFrame, hot_trials: list | None = None, hot_patients: list | None = None) -> DataFrame:
    """Per (patient, trial, criterion) with a matching fact: the lab and medication verdicts as flags (see ``_flagged``).

    Lab values are reduced to the least and greatest per lab before they meet the criteria, which
    settles every one-sided operator; ranges are swept over the sorted values of the lab.
    """
    # At most the kinds in FACT_KIND: facts of a kind that no rule is about can't be found.
    kinds = sorted(r[0] for r in rules.where(F.col("fact_kind").isNotNull()).select("fact_kind").distinct().collect())
    facts = facts.where(F.col("kind").isin(kinds))
    counts = frequent_tokens(rules.where(F.col("fact_kind").isNotNull()).select("match_text"), facts.select("description"))
    hits = lambda some, of, keep: matched_facts(asked, some, of, hot_trials, hot_patients, counts, keep)
    ids = ["patient_id", "trial_id", "criterion_id"]
    op, low, high = F.col("operator"), F.col("value_low"), F.col("value_high")
    one_sided = F.coalesce(op.isin(INTERVAL_OPS) & low.isNotNull(), F.lit(False))
    either = L.numeric_satisfied(op, low, high, F.col("_vmin")) | L.numeric_satisfied(op, low, high, F.col("_vmax"))
    is_lab, is_med = F.col("kind") == "lab", F.col("kind") == "medication"
    verdict = F.when(is_med, _medication_verdict())
    rows = hits(rules, facts, ["operator", "value_low", "value_high", "exception_entities", "allowance_text", "timeframe_operator", "timeframe_value", "timeframe_unit"]).select(
        *ids, _flagged(
            lab_has_value=is_lab & F.col("_vmin").isNotNull(), lab_ok=is_lab & one_sided & F.coalesce(either, F.lit(False)),
            med_disallowed=verdict == "disallowed", med_context=verdict == "context"))
    per_rule = lambda found: found.groupBy(*ids).agg(F.bit_or("found").alias("found"))
    if "lab" not in kinds:
        return per_rule(rows)
    labs = facts.where(is_lab & F.col("value_numeric").isNotNull())
    values = _searchable(labs).select("patient_id", "fact_key", F.col("value_numeric").cast("double").alias("value"))
    no_less, no_more = value_interval()
    ranged = rules.where((F.col("fact_kind") == "lab") & ~one_sided).withColumns({"low": no_less.cast("double"), "high": no_more.cast("double")}).where("low is not null")
    inside = in_interval(hits(ranged, labs, ["low", "high"]).select(*ids, "fact_key", "low", "high"), values, ["patient_id", "fact_key"], ["trial_id", "criterion_id"])
    return per_rule(rows.unionByName(inside.select(*ids, _flagged(lab_has_value=F.lit(True), lab_ok=F.lit(True)))))


RESULT = ["lab_has_value", "lab_ok", "med_disallowed", "med_context"]


def _flagged(**said: Column) -> Column:
    """What a fact found says of its rule, as the bits of one number in the order of RESULT."""
    bit = lambda name, place: F.when(said[name], F.lit(1 << place)).otherwise(0)
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i) for i, c in enumerate(RESULT) if c in said]).alias("found")


def results_by_pair(results: DataFrame) -> DataFrame:
    """Fact results as one row per (patient, trial): a map from criterion to its flags, of at most the rules of one trial.

    Only criteria with a fact are in it, so it is small beside the pairs and their rules.
    """
    return results.groupBy("patient_id", "trial_id").agg(
        F.map_from_entries(F.collect_list(F.struct("criterion_id", "found"))).alias("_found"))


FLAGS = ["is_healthy_volunteer", *L.PATIENT_FLAGS]


def packed(profile: DataFrame) -> DataFrame:
    """A patient profile with its flags, and whether each of its counts is above zero, as the bits of one number: it is copied into every request."""
    return profile.select(*[c for c in profile.columns if c not in (*COUNTS, *FLAGS)], profile_bits().alias("_bits"))


def profile_bits() -> Column:
    bits = [F.col(c) > 0 for c in COUNTS] + [b for c in FLAGS for b in (F.col(c).isNotNull(), F.coalesce(c, F.lit(False)))]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(b.cast("int"), i) for i, b in enumerate(bits)])


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of ``packed`` again; counts are 0 or 1."""
    bit = lambda i: F.getbit("_bits", F.lit(i))
    flags = {c: F.when(bit(len(COUNTS) + 2 * i) == 1, bit(len(COUNTS) + 2 * i + 1) == 1) for i, c in enumerate(FLAGS)}
    return rows.withColumns({**{c: bit(i).cast("long") for i, c in enumerate(COUNTS)}, **flags}).drop("_bits")


# ----------------------------------------------------------------- evaluation

# How a rule is judged; from HIT on, only where the patient has facts of the kind (the bit ``_need``).
UNKNOWN, SEX, HEALTHY, AGE, ECOG, FLAG, HIT, LAB, LINE, MEDICATION = range(-1, 9)
# What is missing, where it is not the bit of a count.
NO_AGE, NO_SEX, NO_HEALTHY, NO_ECOG, NO_FLAG, YES, NO = range(-7, 0)


def judged(rules: DataFrame) -> DataFrame:
    """Rules with what their outcome asks of a patient as numbers.

    Categories, operators and texts are read here, once per rule; the rows of pairs and rules, many more, compare numbers. ``group_type`` is
    the type of the first member of the rule's OR group.
    """
    cat, text, structured = F.col("category"), F.col("value_text"), F.col("source_type") == "structured"
    op, low, high = F.col("operator"), F.col("value_low"), F.col("value_high")
    count = lambda name: F.lit(COUNTS.index(name))
    field, flag = F.col("_field"), F.col("_place")
    how = (
        F.when(structured, F.when(cat == "age", AGE).when(cat == "sex", SEX).otherwise(HEALTHY))
        .when(cat == "age", AGE).when(cat == "sex", SEX).when(cat == "performance_status", ECOG)
        .when(cat.isin(L.FLAG_CATEGORIES), F.when(flag.isNotNull(), FLAG).otherwise(UNKNOWN))
        .when(cat.isin("diagnosis", "disease_stage", "histology", "cns_metastases", "other", "biomarker", "molecular_alteration", "prior_therapy"), HIT)
        .when(cat == "lab_value", LAB).when(cat == "line_of_therapy", LINE).when(cat == "concomitant_medication", MEDICATION)
        .otherwise(UNKNOWN)
    )
    need = (
        F.when(cat.isin("biomarker", "molecular_alteration"), count("n_biomarker")).when(cat == "lab_value", count("n_lab"))
        .when(cat == "line_of_therapy", count("n_line")).when(cat == "prior_therapy", count("n_therapy"))
        .when(cat == "concomitant_medication", count("n_active")).otherwise(count("n_condition"))
    )
    asked = F.lower("match_text")
    sex = F.when(structured, F.lower(text)).when(asked.contains("female"), "female").when(asked.contains("male"), "male")
    # Every comparison asks whether a value lies from least to most, or (gt, lt, neq) that it does not; NaN is above all numbers.
    below, above, one_sided = F.lit(float("-inf")), F.lit(float("nan")), low.isNotNull()
    open_ = structured | F.coalesce(op == "between", F.lit(False))
    least = (
        F.when(open_, F.coalesce(low, below)).when(op.isin("gte", "lt", "eq", "neq") & one_sided, low)
        .when(op.isin("gt", "lte") & one_sided, below).when(one_sided & high.isNotNull(), low)
    )
    most = (
        F.when(open_, F.coalesce(high, above)).when(op.isin("gte", "lt") & one_sided, above)
        .when(op.isin("gt", "lte", "eq", "neq") & one_sided, low).when(one_sided & high.isNotNull(), high)
    )
    negated = F.coalesce(op.isin("gt", "lt", "neq") & one_sided & ~open_, F.lit(False))
    missing = (
        F.when(structured, F.when(cat == "age", NO_AGE).when(cat == "sex", NO_SEX).otherwise(NO_HEALTHY))
        .when(F.col("gate").isNotNull(), F.when(cat == "concomitant_medication", YES).otherwise(NO))
        .when(cat == "lab_value", count("n_lab_value")).when(cat == "biomarker", count("n_biomarker"))
        .when(cat.isin("prior_therapy", "line_of_therapy"), count("n_line")).when(cat == "concomitant_medication", count("n_medication"))
        .when(cat.isin(L.FLAG_CATEGORIES), F.when(field.isNull(), NO).when(flag.isNull(), YES).otherwise(NO_FLAG))
        .when(cat == "performance_status", NO_ECOG).otherwise(count("n_condition"))
    )
    group = F.when((F.col("logic_operator") == "OR") & (F.length(F.col("logic_group_id").cast("string")) > 0), F.col("logic_group_id").cast("string"))
    first = F.min(F.struct("ord", "criterion_id", "type")).over(Window.partitionBy("trial_id", "group_id"))["type"]
    place = F.lit(None).cast("int")
    for name in L.PATIENT_FLAGS:
        place = F.when(field == name, len(COUNTS) + 2 * FLAGS.index(name)).otherwise(place)
    read = barrier(rules.withColumn("_field", L.flag_field(text))).withColumn("_place", place)
    return barrier(read.withColumns({"_how": how, "_need": need, "_miss": missing})).withColumns({
        "_flag": F.coalesce(flag, F.lit(0)), "_expected": F.coalesce(L.flag_expected(text), F.lit(False)), "_sex": sex, "_least": least.cast("double"), "_most": most.cast("double"), "_outside": negated,
        "group_id": group}).withColumn("group_type", F.when(F.col("group_id").isNotNull(), first)).drop("_field", "_place")


def _bit(place) -> Column:
    return F.getbit("_bits", place if isinstance(place, Column) else F.lit(place)) == 1


def _flag_value(place: Column) -> Column:
    return F.when(_bit(place), _bit(place + 1))


HEALTHY_BIT = len(COUNTS) + 2 * FLAGS.index("is_healthy_volunteer")


def with_outcome(pairs: DataFrame) -> DataFrame:
    """Adds the outcome of a rule (see ``judged``) for a patient (see ``packed``) with the flags ``_fact`` of the facts found, null where there are none.

    Each step is a column of its own: a long expression that others repeat makes methods too long to be compiled to machine code.
    """
    how, fact, actual, sex = F.col("_how"), F.col("_fact"), F.col("_actual"), F.col("sex")
    quantity = ((actual >= F.col("_least")) & (actual <= F.col("_most"))) != F.col("_outside")
    said = lambda name: fact.bitwiseAND(F.lit(1 << RESULT.index(name))) != 0
    found = (
        F.when(how == HIT, fact.isNotNull())
        .when(how == LINE, F.coalesce("_quantity", F.col("max_line") > 0))
        .when(fact.isNull(), False)
        .when(how == LAB, F.when(said("lab_has_value"), said("lab_ok")))
        .otherwise(F.when(said("med_disallowed"), True).when(~said("med_context"), False))
    )
    satisfied = (
        F.when(how >= HIT, F.when(_bit(F.col("_need")), found))
        .when(how == FLAG, _flag_value(F.col("_flag")) == F.col("_expected"))
        .when(how == SEX, F.when(F.length(sex) > 0, F.lower(sex) == F.col("_sex")))
        .when(how == HEALTHY, ~_flag_value(F.lit(HEALTHY_BIT)))
        .otherwise(F.col("_quantity"))
    )
    return (
        pairs.withColumn("_actual", F.when(how == AGE, F.col("age")).when(how == ECOG, F.col("ecog_status").cast("double")).when(how == LINE, F.col("max_line").cast("double")))
        .withColumn("_quantity", quantity).withColumn("_satisfied", satisfied)
        .withColumn("outcome", F.coalesce(F.col("gate"), L.polarity(F.col("type"), F.col("_satisfied")), F.lit("unknown")))
    )


def _missing() -> Column:
    """Explicitly missing patient data, from the fact counts of the patient."""
    miss = F.col("_miss")
    return (
        F.when(miss >= 0, ~_bit(F.greatest(miss, F.lit(0)))).when(miss == NO_AGE, F.col("age").isNull()).when(miss == NO_SEX, F.col("sex").isNull())
        .when(miss == NO_HEALTHY, ~_bit(HEALTHY_BIT)).when(miss == NO_ECOG, F.col("ecog_status").isNull())
        .when(miss == NO_FLAG, ~_bit(F.col("_flag"))).otherwise(miss == YES)
    )


EVALUATION = ["patient_id", "trial_id", "criterion_id", "run_id", "ord", "source_type", "type", "category",
              "criterion_text", "outcome", "state", "state_reason", "missing", "group_id", "group_type"]
EVIDENCE = ["operator", "value_low", "value_high", "value_text", "coded_concepts", "gate", "review_reason",
            "review_status", "age", "sex", "is_healthy_volunteer", "ecog_status", "max_line", *COUNTS, *L.PATIENT_FLAGS]


def evaluate(requests: DataFrame, patients: DataFrame, trials: DataFrame, runs: DataFrame, criteria: DataFrame,
             facts: DataFrame, as_of: str, evidence: bool = False, rules: DataFrame | None = None,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per (patient, trial, rule) with its outcome. Evidence columns only when asked for.

    ``rules`` should be a stored table (see ``stage``) when it is passed in: it is read by several
    branches.
    """
    rules = stage(trial_rules(trials, runs, criteria)) if rules is None else rules
    facts = with_columns(facts, FACT_COLUMNS)
    asked = requests.select("patient_id", "trial_id").distinct()
    hot = hot_keys(requests, ["patient_id", "trial_id"], hot_rows)
    results = fact_results(asked, rules, facts, hot.get("trial_id", []), hot.get("patient_id", []))
    # The facts found join the pair, so that the rows of pairs and rules, many more and wider, stay where the rules of the trial meet it.
    found = asked.join(results_by_pair(results).hint("merge"), ["patient_id", "trial_id"], "left")
    profile = patient_profile(patients, facts, as_of)
    people = split_join(found, profile.withColumn("_bits", profile_bits()) if evidence else packed(profile), "patient_id", ["trial_id"], hot.get("patient_id", []))
    pairs = split_join(people, judged(rules), "trial_id", ["patient_id"], hot.get("trial_id", []))
    full = (
        with_outcome(pairs.withColumn("_fact", F.element_at("_found", F.col("criterion_id"))))
        .withColumn("missing", _missing())
        .withColumnRenamed("original_text", "criterion_text")
    )
    return full.select(*EVALUATION, *(EVIDENCE if evidence else []))


def explanation_type(outcome: Column, gate: Column, source: Column) -> Column:
    return (
        F.when(source == "structured", "structured_rule")
        .when(gate == "requires_review", "review_required")
        .when(gate == "unknown", "blocked_unsupported")
        .when(outcome == "matched", "criterion_match")
        .when(outcome == "not_matched", "criterion_mismatch")
        .when(outcome == "triggered", "criterion_blocker")
        .when(outcome == "not_triggered", "criterion_clear")
        .otherwise("criterion_unknown")
    )


def explanation_text() -> Column:
    """Sentence for one evaluation (needs the evidence columns)."""
    outcome, cat = F.col("outcome"), F.col("category")
    years = lambda c: F.col(c).cast("int").cast("string")
    structured = (
        F.when((cat == "age") & (outcome == "unknown"),
               "Patient birth date is unavailable, so age eligibility could not be evaluated.")
        .when((cat == "age") & (F.col("age") < F.col("value_low")),
              F.concat(F.lit("Patient age "), years("age"), F.lit(" is below the minimum age "), years("value_low"), F.lit(".")))
        .when((cat == "age") & (F.col("age") > F.col("value_high")),
              F.concat(F.lit("Patient age "), years("age"), F.lit(" exceeds the maximum age "), years("value_high"), F.lit(".")))
        .when(cat == "age", F.concat(F.lit("Patient age "), years("age"), F.lit(" satisfies the structured age range.")))
        .when((cat == "sex") & (outcome == "unknown"),
              "Patient sex is unavailable, so structured sex eligibility could not be evaluated.")
        .when((cat == "sex") & (outcome == "matched"),
              F.concat(F.lit("Patient sex "), F.col("sex"), F.lit(" matches the structured requirement "), F.col("value_text"), F.lit(".")))
        .when(cat == "sex",
              F.concat(F.lit("Patient sex "), F.col("sex"), F.lit(" does not match the structured requirement "), F.col("value_text"), F.lit(".")))
        .when(outcome == "unknown",
              "Healthy volunteer status is unavailable, so the structured restriction could not be evaluated.")
        .when(outcome == "not_matched",
              "Trial does not accept healthy volunteers and the patient is marked as a healthy volunteer.")
        .otherwise("Trial does not accept healthy volunteers and the patient is not marked as a healthy volunteer.")
    )
    gate = F.col("gate")
    extracted = (
        F.when(gate == "requires_review",
               "This criterion still requires manual review, so the patient match remains provisional.")
        .when(gate == "unknown",
              "This criterion was rejected during review, so it is excluded from automated matching.")
        .when(outcome == "matched", "Patient data satisfies this inclusion criterion.")
        .when(outcome == "not_matched", "Patient data does not satisfy this inclusion criterion.")
        .when(outcome == "triggered", "Patient data triggers this exclusion criterion.")
        .when(outcome == "not_triggered", "Patient data does not trigger this exclusion criterion.")
        .otherwise("Available patient data is insufficient to evaluate this criterion safely.")
    )
    return F.when(F.col("source_type") == "structured", structured).otherwise(extracted)


def evidence_payload() -> Column:
    """Evidence JSON: criterion values and the patient scalars. Patient fact lists are not copied
    into every row; they are the facts of (patient_id, kind), counted here."""
    cat = F.col("category")
    structured = (
        F.when(cat == "age", F.to_json(F.struct(F.col("value_low").alias("minimum_age_years"),
                                                F.col("value_high").alias("maximum_age_years"),
                                                F.col("age").alias("patient_age_years"))))
        .when(cat == "sex", F.to_json(F.struct(F.col("value_text").alias("required_sex"), F.col("sex").alias("patient_sex"))))
        .otherwise(F.to_json(F.struct(F.col("is_healthy_volunteer").alias("patient_is_healthy_volunteer"))))
    )
    gated = F.to_json(F.struct("review_reason", "review_status"))
    values = F.to_json(F.struct(
        F.col("operator").alias("criterion_operator"), F.col("value_low").alias("criterion_value_low"),
        F.col("value_high").alias("criterion_value_high"), F.col("value_text").alias("criterion_value_text"),
        F.col("coded_concepts").alias("criterion_coded_concepts"),
        F.when(cat == "performance_status", F.col("ecog_status")).alias("patient_ecog_status"),
        F.when(cat == "lab_value", F.col("n_lab")).alias("patient_lab_count"),
        F.when(cat == "biomarker", F.col("n_biomarker")).alias("patient_biomarker_count"),
        F.when(cat.isin("prior_therapy", "line_of_therapy"), F.col("n_therapy")).alias("patient_therapy_count"),
        F.when(cat == "concomitant_medication", F.col("n_medication")).alias("patient_medication_count"),
        F.when(cat.isin(L.FLAG_CATEGORIES), L.flag_field(F.col("value_text"))).alias("patient_flag_field"),
    ))
    return F.when(F.col("source_type") == "structured", structured).when(F.col("gate").isNotNull(), gated).otherwise(values)


# ------------------------------------------------------------------ OR groups

def group_texts(rules: DataFrame) -> DataFrame:
    """Per (trial, OR group): first member, joined distinct texts, display category.

    Depends on the trial only, so it is computed once per trial and not per patient. A group is
    the split of one sentence; its joined text is one cell of the result.
    """
    members = rules.where((F.col("logic_operator") == "OR") & (F.length(F.col("logic_group_id").cast("string")) > 0))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "criterion_id", "original_text")))
    return members.groupBy("trial_id", F.col("logic_group_id").cast("string").alias("group_id")).agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda m: m["original_text"])), " OR ").alias("group_text"),
        F.min(F.struct("ord", "criterion_id", "type", "category", "run_id")).alias("_first"),
        (F.min("category") == F.max("category")).alias("_one_category"),
    ).select(
        "trial_id", "group_id", "group_text", F.col("_first.type").alias("first_type"),
        F.col("_first.category").alias("first_category"), F.col("_first.run_id").alias("first_run_id"),
        F.col("_first.ord").alias("first_ord"),
        F.when(F.col("_one_category"), F.col("_first.category")).otherwise("logic_group").alias("display_category"),
    )


WON = ["matched", "triggered", "requires_review"]  # outcomes that give a group their best state


def _group_bits() -> Column:
    """What one member says of its OR group, as bits: outcome with state rank, unknown, state rank, and whether data are missing (known, true)."""
    o, rank = F.col("outcome"), F.col("_rank")
    one = lambda place: F.call_function("shiftleft", F.lit(1), place)
    won = F.when(o == "unknown", F.lit(1 << 12))
    for i, name in enumerate(WON):
        won = won.when(o == name, one(rank + 4 * i))
    missing = F.when(F.col("missing"), F.lit(3 << 17)).when(F.col("missing").isNotNull(), F.lit(1 << 17)).otherwise(0)
    return F.coalesce(won, F.lit(0)).bitwiseOR(one(rank + 13)).bitwiseOR(missing)


def with_group_bits(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_rank", L.state_rank(F.col("state"))).withColumn("_says", _group_bits())


def _group_aggregates() -> list[Column]:
    """Fixed-width aggregates that determine the collapsed outcome and state of an OR group: the bits of all members (see ``with_group_bits``)."""
    return [F.bit_or("_says").alias("_said"), F.count(F.lit(1)).alias("members")]


def _said(place: int, width: int = 1) -> Column:
    return F.col("_said").bitwiseAND(F.lit((1 << width) - 1 << place)) != 0


def _any_missing() -> Column:
    return F.when(_said(17), _said(18))


def _worst() -> Column:
    return F.when(_said(16), 3).when(_said(15), 2).when(_said(14), 1).when(_said(13), 0)


def _collapsed(first_type: Column) -> tuple[Column, Column]:
    """(outcome, state rank) of a group from its aggregates."""
    inc = first_type == "inclusion"
    outcome = (
        F.when(inc & _said(0, 4), "matched")
        .when(~inc & _said(4, 4), "triggered")
        .when(_said(8, 4), "requires_review")
        .when(_said(12), "unknown")
        .otherwise(F.when(inc, "not_matched").otherwise("not_triggered"))
    )
    best = lambda i: F.when(_said(4 * i), 0).when(_said(4 * i + 1), 1).when(_said(4 * i + 2), 2).otherwise(3)
    rank = F.when(outcome == "matched", best(0)).when(outcome == "triggered", best(1)).when(outcome == "requires_review", best(2)).otherwise(_worst())
    return outcome, rank


GROUP_TEXT = {
    ("inclusion", "matched"): ("logic_group_match", "At least one OR-linked inclusion branch is satisfied."),
    ("inclusion", "requires_review"): ("logic_group_review_required", "An OR-linked inclusion branch still requires manual review."),
    ("inclusion", "unknown"): ("logic_group_unknown", "Available patient data is insufficient to resolve an OR-linked inclusion branch."),
    ("inclusion", "not_matched"): ("logic_group_mismatch", "None of the OR-linked inclusion branches are satisfied."),
    ("exclusion", "triggered"): ("logic_group_blocker", "At least one OR-linked exclusion branch is triggered."),
    ("exclusion", "requires_review"): ("logic_group_review_required", "An OR-linked exclusion branch still requires manual review."),
    ("exclusion", "unknown"): ("logic_group_unknown", "Available patient data is insufficient to resolve an OR-linked exclusion branch."),
    ("exclusion", "not_triggered"): ("logic_group_clear", "None of the OR-linked exclusion branches are triggered."),
}


def group_explanation(kind: Column, outcome: Column, part: int) -> Column:
    out = F.lit(None).cast("string")
    for (t, o), pair in GROUP_TEXT.items():
        out = F.when(((kind == "inclusion") == F.lit(t == "inclusion")) & (outcome == o), pair[part]).otherwise(out)
    return out


def collapse_groups(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """Effective rows: ungrouped evaluations as they are, one row per OR group.

    Both branches need the patient, whatever is asked for afterwards, so they read one shuffle of the requests.
    """
    single = barrier(evaluations.where(F.col("group_id").isNull()).select(
        *[c for c in EVALUATION if c not in ("group_id", "group_type")], F.lit(None).cast("string").alias("group_id"),
        F.col("category").alias("display_category"), F.lit(1).cast("long").alias("members"),
    ), "trial_id")
    grouped = with_group(
        with_group_bits(evaluations.where(F.col("group_id").isNotNull()))
        .groupBy("patient_id", "trial_id", "group_id").agg(*_group_aggregates()), group_texts(rules), "inner")
    outcome, rank = _collapsed(F.col("first_type"))
    merged = grouped.withColumn("outcome", outcome).withColumn("_rank", rank).select(
        "patient_id", "trial_id", F.lit(None).cast("long").alias("criterion_id"),
        F.col("first_run_id").alias("run_id"), F.col("first_ord").alias("ord"),
        F.lit("extracted").alias("source_type"), F.col("first_type").alias("type"),
        F.col("first_category").alias("category"), F.col("group_text").alias("criterion_text"), "outcome",
        L.rank_to_state(F.col("_rank")).alias("state"), L.rank_to_reason(F.col("_rank")).alias("state_reason"),
        (_any_missing() | (F.col("first_category") == "concomitant_medication")).alias("missing"),
        "group_id", "display_category", "members",
    )
    return single.unionByName(merged)


def _cells(evaluations: DataFrame, rules: DataFrame, sure, open_) -> DataFrame:
    """One row per OR group of a pair and one for all its other rows."""
    o, said = F.col("outcome"), F.col("_says")
    typed = "group_type" in evaluations.columns
    first = with_group_bits(evaluations).groupBy("patient_id", "trial_id", "group_id").agg(
        F.bit_or(said if not typed else said.bitwiseOR(F.when(F.col("group_type") == "inclusion", F.lit(1 << 19)).when(F.col("group_type").isNotNull(), F.lit(1 << 20)).otherwise(0))).alias("_said"),
        F.sum(sure(o)).alias("_sure"), F.sum(open_(o)).alias("_open"))
    if not typed:
        first = with_group(first, group_types(rules), "left")
    solo = F.col("group_id").isNull()
    outcome, grank = _collapsed(F.when(_said(19), "inclusion").when(_said(20), "exclusion") if typed else F.col("first_type"))
    return first.withColumn("_outcome", outcome).select(
        "patient_id", "trial_id", F.when(solo, F.col("_sure")).otherwise(sure(F.col("_outcome"))).alias("s"),
        F.when(solo, F.col("_open")).otherwise(open_(F.col("_outcome"))).alias("o"), F.when(solo, _worst()).otherwise(grank).alias("w"))


def pair_results(evaluations: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts, status, score and state per (patient, trial).

    Two pre-aggregating steps and no per-group collection: rows are first reduced per
    (pair, OR group), with all ungrouped rows of a pair sharing one cell. A cell is one number of group bits and two numbers that hold two
    counts each, of 32 bits. Effective rows (see ``collapse_groups``) are reduced already and taken as they are.
    """
    o, high = F.col("outcome"), F.lit(1 << 32)
    none = F.lit(0).cast("long")
    sure = lambda o: F.when(o.isin("matched", "not_triggered"), F.lit(1).cast("long")).when(o.isin("not_matched", "triggered"), high).otherwise(none)
    open_ = lambda o: F.when(o == "unknown", F.lit(1).cast("long")).when(o == "requires_review", high).otherwise(none)
    if "members" in evaluations.columns:
        cells = evaluations.select("patient_id", "trial_id", sure(o).alias("s"), open_(o).alias("o"), L.state_rank(F.col("state")).alias("w"))
    else:
        cells = _cells(evaluations, rules, sure, open_)
    low, up = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)), lambda c: F.shiftright(c, 32)
    totals = cells.groupBy("patient_id", "trial_id").agg(F.sum("s").alias("s"), F.sum("o").alias("o"), F.max("w").alias("_w"))
    return with_status(totals.select(
        "patient_id", "trial_id", low("s").alias("favorable_count"), up("s").alias("unfavorable_count"), low("o").alias("unknown_count"),
        up("o").alias("requires_review_count"), "_w"))


def with_group(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """Rows joined with their group (trial_id, group_id, ...), inner or left.

    The groups of a trial, no more than its rules, come as one map: rows that lie by trial, as evaluations do, stay where they are.
    """
    names = [c for c in groups.columns if c not in ("trial_id", "group_id")]
    by_trial = groups.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("group_id", F.struct(*names)))).alias("_groups"))
    out = rows.join(by_trial.hint("merge"), "trial_id", how).withColumn("_group", F.element_at("_groups", F.col("group_id")))
    return (out if how == "left" else out.where(F.col("_group").isNotNull())).select(*rows.columns, *[F.col("_group")[c].alias(c) for c in names])


def group_types(rules: DataFrame) -> DataFrame:
    """Type of the first member of each OR group of a trial."""
    members = rules.where((F.col("logic_operator") == "OR") & (F.length(F.col("logic_group_id").cast("string")) > 0))
    return members.groupBy("trial_id", F.col("logic_group_id").cast("string").alias("group_id")).agg(
        F.min(F.struct("ord", "criterion_id", "type")).alias("_first")
    ).select("trial_id", "group_id", F.col("_first.type").alias("first_type"))


def with_status(counts: DataFrame) -> DataFrame:
    fav, unf = F.col("favorable_count"), F.col("unfavorable_count")
    unk, rev = F.col("unknown_count"), F.col("requires_review_count")
    known = fav + unf
    return counts.select(
        "patient_id", "trial_id", "favorable_count", "unfavorable_count", "unknown_count", "requires_review_count",
        F.when(unf > 0, "ineligible").when((unk > 0) | (rev > 0), "possible").otherwise("eligible").alias("overall_status"),
        F.when(known > 0, fav / known).otherwise(F.lit(0.0)).alias("score"),
        F.when(known + unk + rev > 0, known / (known + unk + rev)).otherwise(F.lit(0.0)).alias("coverage_ratio"),
        L.rank_to_state(F.col("_w")).alias("state"), L.rank_to_reason(F.col("_w")).alias("state_reason"),
    )


def summaries(results: DataFrame, effective: DataFrame, trials: DataFrame) -> DataFrame:
    """Summary sentence per pair from the first two categories of the deciding class."""
    from pyspark.sql import Window

    o, s = F.col("outcome"), F.col("state")
    classes = F.array_compact(F.array(
        F.when(o.isin("not_matched", "triggered"), "blocker"),
        F.when(s == "review_required", "review"),
        F.when(s == "blocked_unsupported", "blocked"),
        F.when(o.isin("unknown", "requires_review"), "open"),
    ))
    place = F.struct(F.col("group_id").isNotNull().alias("g"), F.col("ord").alias("o"), F.col("criterion_id").alias("c"),
                     F.col("group_id").alias("k"))
    rows = effective.select("patient_id", "trial_id", "category", place.alias("_place"), F.explode(classes).alias("_class"))
    w = Window.partitionBy("patient_id", "trial_id", "_class").orderBy("_place")
    # row_number <= 2 is pushed below the shuffle as a group limit, so two rows per class travel.
    two = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2)
    pick = lambda cls, n: F.max(F.when((F.col("_class") == cls) & (F.col("_n") == n), F.col("category")))
    names = two.groupBy("patient_id", "trial_id").agg(
        *[F.concat_ws(", ", pick(c, 1), pick(c, 2)).alias(c) for c in ("blocker", "review", "blocked", "open")]
    )
    title = F.coalesce("brief_title", F.lit(""))
    joined = results.join(names, ["patient_id", "trial_id"], "left").join(
        trials.select("trial_id", "brief_title"), "trial_id", "left")
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    say = lambda *parts: F.concat(title, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(F.col("overall_status") == "ineligible", say(" is ineligible because of ", F.col("blocker"), "."))
        .when(filled("review"), say(" remains a possible match pending manual review of ", F.col("review"), "."))
        .when(filled("blocked"), say(" remains a possible match because ", F.col("blocked"),
              " were rejected or unsupported and excluded from automated matching."))
        .when(F.col("overall_status") == "possible", say(" remains a possible match pending ", F.col("open"), "."))
        .otherwise(say(" is eligible based on ", F.col("favorable_count").cast("string"),
                       " favorable criteria and no blockers."))
    )
    return joined.withColumn("summary_explanation", text).select(*results.columns, "brief_title", "summary_explanation")


STATUS_ORDER = {"eligible": 0, "possible": 1, "ineligible": 2}


def status_order(col: Column) -> Column:
    return F.when(col == "eligible", 0).when(col == "possible", 1).otherwise(2)


def rank_results(results: DataFrame, tie: str = "trial_id") -> DataFrame:
    """Rank of each trial for its patient: status, coverage desc, score desc, then id text.

    Rows are dealt by range of the whole order, so a patient that owns a third of the pairs is numbered
    in many tasks, whatever the ids look like.
    """
    order = [status_order(F.col("overall_status")), -F.col("coverage_ratio"), -F.col("score"), F.col(tie).cast("string")]
    return range_rank(results, ["patient_id"], order, "rank")


def top_matches(results: DataFrame, k: int, tie: str = "trial_id") -> DataFrame:
    from cohortmill.functions.scale import top_k

    order = [status_order(F.col("overall_status")), F.desc("coverage_ratio"), F.desc("score"), F.col(tie).cast("string")]
    return top_k(results, ["patient_id"], order, k)


def run_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("total_trials_evaluated"),
        F.count_if(F.col("overall_status") == "eligible").alias("eligible_trials"),
        F.count_if(F.col("overall_status") == "possible").alias("possible_trials"),
        F.count_if(F.col("overall_status") == "ineligible").alias("ineligible_trials"),
    )


def list_matches(results: DataFrame, trials: DataFrame, patient_id=None, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of stored results with trial names and metrics, newest first; a result of an unknown trial has no names."""
    r = results if patient_id is None else results.where(F.col("patient_id") == patient_id)
    known = F.col("favorable_count") + F.col("unfavorable_count")
    still = F.col("unknown_count") + F.col("requires_review_count")
    named = r.join(trials.select("trial_id", "nct_id", "brief_title"), "trial_id", "left").select(
        "*", known.alias("deterministic_count"), still.alias("unresolved_count"), (known + still).alias("evaluated_count"))
    # paged last: an ordered page that is joined afterwards loses its order
    return named.orderBy(F.desc("created_at"), F.desc("match_result_id")).offset((page - 1) * per_page).limit(per_page)
