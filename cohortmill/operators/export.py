"""Nested study export and medication projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import text as T

STRINGS = "array<string>"
IDENTIFIER = "urn:eligibility:criterion"  # system of exported criterion ids

# Registry status to study status; anything else is active.
STATUS = {
    "RECRUITING": "active", "ACTIVE_NOT_RECRUITING": "active", "NOT_YET_RECRUITING": "approved", "COMPLETED": "completed",
    "TERMINATED": "closed-to-accrual", "SUSPENDED": "temporarily-closed-to-accrual", "WITHDRAWN": "withdrawn",
    "ENROLLING_BY_INVITATION": "active",
}
# Phase codes and displays.
PHASES = {
    "PHASE1": ("phase-1", "Phase 1"), "PHASE2": ("phase-2", "Phase 2"), "PHASE3": ("phase-3", "Phase 3"),
    "PHASE4": ("phase-4", "Phase 4"), "EARLY_PHASE1": ("early-phase-1", "Early Phase 1"),
}
# Code systems, extension address and categories that stay internal.
PHASE_SYSTEM = "http://terminology.hl7.org/CodeSystem/research-study-phase"
ELIGIBILITY_URL = "http://hl7.org/fhir/StructureDefinition/researchStudy-eligibility"
INTERNAL_CATEGORIES = ["administrative_requirement", "behavioral_constraint", "reproductive_status", "device_constraint",
                       "procedural_requirement", "disease_status"]
SYSTEM_URIS = {
    "rxnorm": "http://www.nlm.nih.gov/research/umls/rxnorm", "snomed_ct": "http://snomed.info/sct",
    "medrt": "http://va.gov/terminology/medrt", "nci_thesaurus": "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl",
}
# Medication class wording.
RECOGNIZED_CLASSES = [
    "pd-1 therapy", "pd-1/pd-l1 therapy", "pd-1/pd-l1 inhibitor therapy", "pd-l1 therapy", "kras-targeted therapy",
    "agent targeting kras", "systemic corticosteroids", "live-attenuated vaccine", "live vaccine",
    "live or live-attenuated vaccine", "cyp3a4 inhibitors/inducers", "platinum-based chemotherapy",
]
CLASS_HINTS = ["therapy", "vaccine", "corticosteroid", "steroid", "chemotherapy", "inhibitor", "inducer", "immunosuppressive",
               "targeted", "targeting", "antibody", "agent"]
# Wrapper and combination wording, systems of medication classes.
WRAPPER = r"\bcontaining\s+(?:treatments?|therap(?:y|ies)|regimens?)\b"
COMBINATION = r"\s*(?:\+|\bplus\b)\s*"
CLASS_SYSTEMS = ["nci_thesaurus", "medrt", "snomed_ct"]

EXPORT_COLUMNS = {
    "primary_semantic_category": "string", "original_text": "string", "source_sentence": "string", "source_clause_text": "string",
    "operator": "string", "value_low": "double", "value_high": "double", "value_text": "string", "unit": "string", "negated": "boolean",
    "timeframe_operator": "string", "timeframe_value": "double", "timeframe_unit": "string", "specimen_type": "string",
    "testing_modality": "string", "disease_subtype": "string", "histology_text": "string",
    "assay_context": "struct<specimen_types:array<string>,testing_modalities:array<string>>", "secondary_semantic_tags": STRINGS,
    "coded_concepts": "array<struct<system:string,code:string,display:string,match_type:string>>", "logic_group_id": "string",
    "logic_operator": "string", "parse_status": "string", "review_required": "boolean", "review_status": "string",
    "exception_logic": "string", "allowance_text": "string", "exception_entities": STRINGS,
}


def _with(df: DataFrame) -> DataFrame:
    """Export columns under their types; a structured exception_logic only matters by presence."""
    has = set(df.columns)
    cast = lambda c, t: (F.to_json(F.struct(c)) if c == "exception_logic" and dict(df.dtypes)[c] != "string" else F.col(c)).cast(t)
    logic = lambda c, t: F.when(F.col(c).isNotNull(), cast(c, t)) if c == "exception_logic" else cast(c, t)
    return df.select(*[c for c in df.columns if c not in EXPORT_COLUMNS],
                     *[(logic(c, t) if c in has else F.lit(None).cast(t)).alias(c) for c, t in EXPORT_COLUMNS.items()])


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has_payload() -> Column:
    s = F.col
    return (
        (F.coalesce(F.size("coded_concepts"), F.lit(0)) > 0) | _filled(s("operator")) | s("value_low").isNotNull() | s("value_high").isNotNull()
        | _filled(s("unit")) | _filled(s("value_text")) | _filled(s("timeframe_operator")) | s("timeframe_value").isNotNull()
        | _filled(s("timeframe_unit")) | _filled(s("specimen_type")) | _filled(s("testing_modality")) | s("assay_context").isNotNull()
        | _filled(s("disease_subtype")) | _filled(s("histology_text"))
    )


def exportable_flag() -> Column:
    s = F.col
    med_logic = (s("category") == "concomitant_medication") & (_filled(s("exception_logic")) | _filled(s("allowance_text")))
    status = F.coalesce("review_status", F.lit(""))
    open_review = F.coalesce("review_required", F.lit(False)) & ~status.isin("accepted", "corrected")
    return (
        F.coalesce(s("parse_status").isin("parsed", "partial"), F.lit(False)) & (s("category") != "other") & ~s("category").isin(INTERNAL_CATEGORIES) & ~med_logic
        & (status != "rejected") & ~open_review & has_payload()
    )


def exportable(criteria: DataFrame) -> DataFrame:
    return _with(criteria).where(exportable_flag())


_ENTRY = "struct<url:string,valueString:string,valueDecimal:double,valueBoolean:boolean,valueCoding:struct<system:string,code:string,display:string>>"


def _entry(url: str, string: Column | None = None, decimal: Column | None = None, boolean: Column | None = None, coding: Column | None = None) -> Column:
    return F.struct(
        F.lit(url).alias("url"), (F.lit(None) if string is None else string).cast("string").alias("valueString"),
        (F.lit(None) if decimal is None else decimal).cast("double").alias("valueDecimal"),
        (F.lit(None) if boolean is None else boolean).cast("boolean").alias("valueBoolean"),
        (F.lit(None) if coding is None else coding).cast("struct<system:string,code:string,display:string>").alias("valueCoding"))


def criterion_entries() -> Column:
    """Ordered extension entries of one criterion; absent values leave no entry."""
    s = F.col
    text = lambda url, c: F.when(_filled(s(c)), _entry(url, string=s(c)))
    number = lambda url, c: F.when(s(c).isNotNull(), _entry(url, decimal=s(c)))
    many = lambda url, arr: F.transform(F.coalesce(arr, F.array().cast(STRINGS)), lambda x: _entry(url, string=x))
    single = F.array_compact(F.array(
        _entry("category", string=s("category")),
        _entry("primarySemanticCategory", string=F.coalesce(F.when(_filled(s("primary_semantic_category")), s("primary_semantic_category")), s("category"))),
        _entry("text", string=s("original_text")), text("sourceSentence", "source_sentence"),
        F.when(_filled(s("source_clause_text")) & (s("source_clause_text") != s("original_text")), _entry("sourceClauseText", string=s("source_clause_text"))),
        text("operator", "operator"), number("valueLow", "value_low"), number("valueHigh", "value_high"), text("valueText", "value_text"),
        text("unit", "unit"), F.when(s("negated"), _entry("negated", boolean=F.lit(True))), text("timeframeOperator", "timeframe_operator"),
        number("timeframeValue", "timeframe_value"), text("timeframeUnit", "timeframe_unit"), text("specimenType", "specimen_type"),
        text("testingModality", "testing_modality"), text("diseaseSubtype", "disease_subtype"), text("histologyText", "histology_text"),
    ))
    codings = F.transform(F.coalesce("coded_concepts", F.array().cast(EXPORT_COLUMNS["coded_concepts"])), lambda c: _entry(
        "coding", coding=F.struct(*[F.coalesce(c[k], F.lit("")).alias(k) for k in ("system", "code", "display")])))
    group = F.array_compact(F.array(text("logicGroupId", "logic_group_id"), F.when(_filled(s("logic_group_id")), _entry("logicOperator", string=s("logic_operator")))))
    return F.concat(single, many("assaySpecimenType", s("assay_context.specimen_types")), many("assayTestingModality", s("assay_context.testing_modalities")),
                    many("secondarySemanticTag", s("secondary_semantic_tags")), codings, group)


def study_resources(trials: DataFrame, criteria: DataFrame) -> DataFrame:
    """One nested study document per trial as JSON without nulls.

    Criteria are reduced to their JSON before they are gathered; a document holds the criteria of
    one trial because that is what the document is.
    """
    ext = exportable(criteria).select(
        "trial_id", "ord", "type", F.struct(F.lit("criterion").alias("url"), criterion_entries().alias("extension")).alias("e"))
    lists = ext.groupBy("trial_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("ord", "e")))), lambda x: x["e"]).alias(t)
        for t in ("inclusion", "exclusion")])
    status = F.lit("active")
    for k, v in STATUS.items():
        status = F.when(F.col("status") == k, v).otherwise(status)
    phase_key = F.trim(F.substring_index("phase", ",", 1))
    phase = F.lit(None).cast("struct<coding:array<struct<system:string,code:string,display:string>>>")
    for k, (code, display) in PHASES.items():
        coding = F.struct(F.array(F.struct(F.lit(PHASE_SYSTEM).alias("system"), F.lit(code).alias("code"), F.lit(display).alias("display"))).alias("coding"))
        phase = F.when(phase_key == k, coding).otherwise(phase)
    section = lambda t: F.when(F.size(t) > 0, F.struct(F.lit(f"{ELIGIBILITY_URL}/{t}").alias("url"), F.col(t).alias("extension")))
    extension = F.array_compact(F.array(section("inclusion"), section("exclusion")))
    keep = lambda c: F.when(_filled(F.col(c)), F.col(c))
    enrolment = F.struct(keep("eligible_min_age").alias("minimumAge"), keep("eligible_max_age").alias("maximumAge"), keep("eligible_sex").alias("sex"))
    any_limit = _filled(F.col("eligible_min_age")) | _filled(F.col("eligible_max_age")) | _filled(F.col("eligible_sex"))
    t = trials.join(lists, "trial_id", "left")
    doc = F.struct(
        F.lit("ResearchStudy").alias("resourceType"),
        F.array(F.struct(F.lit("https://clinicaltrials.gov").alias("system"), F.col("nct_id").alias("value"))).alias("identifier"),
        F.col("brief_title").alias("title"), status.alias("status"), phase.alias("phase"),
        F.when(F.size("conditions") > 0, F.transform("conditions", lambda c: F.struct(c.alias("text")))).alias("condition"),
        F.when(F.size(extension) > 0, extension).alias("extension"), F.when(any_limit, F.array(enrolment)).alias("enrollment"))
    return t.select("trial_id", "nct_id", F.to_json(doc).alias("resource"))


# --------------------------------------------------------- medication projection

def projection_index(lookups: DataFrame) -> DataFrame:
    """(term, system, code, display, place): catalogue rows by normalised display and synonym.

    ``place`` keeps catalogue order; the first row of a term and system wins.
    """
    rows = lookups.where(F.col("system").isin("rxnorm", *CLASS_SYSTEMS))
    texts = F.concat(F.array("display"), F.coalesce("synonyms", F.array().cast(STRINGS)))
    e = rows.select("system", "code", "display", "place", F.posexplode(texts).alias("k", "text")).withColumn("term", T.normalize_term(F.col("text")))
    return e.where(F.length("term") > 0).groupBy("term", "system").agg(
        F.min(F.struct("place", "k", "code", "display")).alias("b")).select("term", "system", "b.code", "b.display", "b.place")


def _unique_by_term(arr: Column) -> Column:
    """First text per normalised term, order kept, blanks dropped."""
    clean = F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: F.length(T.normalize_term(x)) > 0)
    pairs = F.transform(clean, lambda x: F.struct(T.normalize_term(x).alias("n"), x.alias("x")))
    terms = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.transform(terms, lambda n: F.get(F.filter(pairs, lambda p: p["n"] == n), 0)["x"])


def _phrase_windows(text: Column, longest: int) -> Column:
    words = F.filter(F.split(T.normalize_term(text), " "), lambda w: F.length(w) > 0)
    seq = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(seq, lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " ")))))


def named_drugs(rows: DataFrame, key: list[str], text: str, index: DataFrame) -> DataFrame:
    """Drugs named as whole phrases in ``text``: (key, place_no, display), longest phrase first.

    Word windows up to the longest drug term are joined to the drug terms, so the work follows the
    words, not text x drugs.
    """
    terms = index.where(F.col("system") == "rxnorm").select("term", "display")
    longest = terms.select(F.max(F.size(F.split("term", " "))).alias("n")).first()["n"] or 1
    w = rows.select(*key, F.explode(_phrase_windows(F.col(text), longest)).alias("term"))
    hits = w.join(terms, "term").groupBy(*key, T.normalize_term(F.col("display")).alias("drug")).agg(
        F.max(F.struct(F.length("term").alias("n"), F.col("display"))).alias("b"))
    return hits.select(*key, F.col("b.display").alias("display"), F.col("b.n").alias("n"))


PARTS = 2**31  # a position in an array is below it, so raw and part number never collide


def medication_mentions(criteria: DataFrame, index: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Medication mentions of therapy criteria, one row each, unique by normalised term and in order.

    Sources in order: tagged drugs, value text, exceptions, drugs named in the allowance. "A + B"
    is split when every part looks like a medication.
    """
    c = criteria.where(F.col("category").isin("prior_therapy", "concomitant_medication"))
    tagged = F.transform(F.filter("mentions", lambda m: m["label"] == "DRUG"),
                         lambda m: F.coalesce(F.when(F.length(m["expanded_text"]) > 0, m["expanded_text"]), m["text"]))
    none = F.array().cast(STRINGS)
    allowed = c.where(_filled(F.col("allowance_text"))).select(key, "allowance_text")
    in_allowance = named_drugs(allowed, [key], "allowance_text", index).groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "display")), False), lambda x: x["display"]).alias("_allow"))
    raw = F.concat(F.coalesce(tagged, none), F.array_compact(F.array("value_text")), F.coalesce("exception_entities", none), F.coalesce("_allow", none))
    m = c.join(in_allowance, key, "left").select(key, F.posexplode(_unique_by_term(raw)).alias("raw_no", "raw"))
    # combination split
    parts = F.filter(F.transform(F.split("raw", T.ci(COMBINATION)), lambda p: T.strip_chars(p, " ,;.")), lambda p: F.length(p) > 0)
    m = m.withColumn("_parts", F.when(F.col("raw").rlike(T.ci(COMBINATION)) & (F.size(parts) >= 2), parts))
    frag = m.where(F.col("_parts").isNotNull()).select(key, "raw_no", F.posexplode("_parts").alias("part_no", "part"))
    known = looks_like_medication(frag, [key, "raw_no", "part_no"], "part", index)
    ok = known.groupBy(key, "raw_no").agg(F.bool_and("is_medication").alias("_all"))
    out = m.join(ok, [key, "raw_no"], "left").withColumn(
        "_texts", F.when(F.coalesce("_all", F.lit(False)), F.col("_parts")).otherwise(F.array("raw")))
    exploded = out.select(key, "raw_no", F.posexplode("_texts").alias("part_no", "mention_text")).withColumn(
        "normalized_term", T.normalize_term(F.col("mention_text")))
    first = exploded.where(F.length("normalized_term") > 0).groupBy(key, "normalized_term").agg(
        F.min(F.struct("raw_no", "part_no", "mention_text")).alias("b"))
    return first.select(key, "normalized_term", F.col("b.mention_text").alias("mention_text"), (F.col("b.raw_no").cast("long") * PARTS + F.col("b.part_no")).alias("mention_no"))


def _recognized(term: Column) -> Column:
    import re

    return term.isin([" ".join(re.findall("[a-z0-9]+", x)) for x in RECOGNIZED_CLASSES])


def _ambiguous(term: Column) -> Column:
    out = F.lit(False)
    for h in CLASS_HINTS:
        out = out | term.contains(h)
    return out


def looks_like_medication(rows: DataFrame, key: list[str], text: str, index: DataFrame) -> DataFrame:
    term = T.normalize_term(F.col(text))
    r = rows.withColumn("term", term)
    known = index.select("term").distinct().withColumn("_known", F.lit(True))
    named = named_drugs(rows, key, text, index).select(*key).distinct().withColumn("_named", F.lit(True))
    j = r.join(known, "term", "left").join(named, key, "left")
    no = F.lit(False)
    return j.select(*key, ((F.length("term") > 0) & (F.coalesce("_known", no) | F.coalesce("_named", no) | _recognized(F.col("term")) | _ambiguous(F.col("term")))).alias("is_medication"))


def project_medications(criteria: DataFrame, lookups: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Projection of every medication mention: grounded statement, blocked class, ambiguous or missing drug.

    ``lookups`` needs system, code, display, synonyms and place (catalogue order).
    """
    index = projection_index(lookups)
    m = medication_mentions(criteria, index, key)
    rx = index.where(F.col("system") == "rxnorm").select(F.col("term").alias("normalized_term"), F.struct("system", "code", "display").alias("_rx"))
    cls = index.where(F.col("system").isin(CLASS_SYSTEMS)).groupBy(F.col("term").alias("normalized_term")).agg(
        F.min(F.struct("place", "system", "code", "display")).alias("c")).select("normalized_term", F.struct("c.system", "c.code", "c.display").alias("_cls"))
    wrapped = m.where(F.col("normalized_term").rlike(T.ci(WRAPPER)))
    embedded = named_drugs(wrapped, [key, "normalized_term"], "normalized_term", index).groupBy(key, "normalized_term").agg(
        F.count(F.lit(1)).alias("n"), F.min("display").alias("display")).where(F.col("n") == 1)
    embedded = embedded.withColumn("drug", T.normalize_term(F.col("display"))).drop("display").join(
        rx.select(F.col("normalized_term").alias("drug"), F.col("_rx").alias("_emb")), "drug").select(key, "normalized_term", "_emb")
    j = m.join(rx, "normalized_term", "left").join(cls, "normalized_term", "left").join(embedded, [key, "normalized_term"], "left")
    hit = F.coalesce("_rx", "_emb", "_cls")
    term = F.col("normalized_term")
    status = F.when(hit.isNotNull(), "projected").when(_recognized(term), "blocked_missing_class_code").when(
        _ambiguous(term), "review_required_ambiguous_class").otherwise("blocked_missing_rxnorm")
    terminology = F.when(hit.isNotNull(), F.concat(hit["system"], F.lit("_grounded"))).when(_recognized(term), "recognized_class_missing_safe_code").when(
        _ambiguous(term), "ambiguous_class_no_safe_code").otherwise("named_drug_missing_rxnorm")
    p = j.select(key, "mention_no", "mention_text", "normalized_term", status.alias("projection_status"), terminology.alias("terminology_status"),
                 hit["system"].alias("system"), hit["code"].alias("code"), hit["display"].alias("display"),
                 F.when(hit.isNotNull(), "MedicationStatement").alias("resource_type"), hit.isNull().alias("review_required"))
    # first mention per resource (or per blocked term)
    what = F.when(F.col("resource_type").isNotNull(), F.concat_ws("|", F.lit("p"), "system", "code")).otherwise(
        F.concat_ws("|", F.lit("b"), "projection_status", "normalized_term"))
    rest = [c for c in p.columns if c not in (key, "mention_no")]
    return p.withColumn("_what", what).groupBy(key, "_what").agg(F.min(F.struct("mention_no", *rest)).alias("b")).select(key, "b.*")


def medication_statements(projections: DataFrame, criteria: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Grounded projections as nested statement JSON with the criterion text and timeframe as notes."""
    c = criteria.select(key, "trial_id", F.col("original_text").alias("_text"), "timeframe_operator", "timeframe_value", "timeframe_unit")
    uri = F.col("system")
    for k, v in SYSTEM_URIS.items():
        uri = F.when(F.col("system") == k, v).otherwise(uri)
    trial = F.col("trial_id").cast("string")
    timed = _filled(F.col("timeframe_operator")) & F.col("timeframe_value").isNotNull() & _filled(F.col("timeframe_unit"))
    number = F.regexp_replace(F.col("timeframe_value").cast("string"), r"\.0$", "")
    notes = F.array_compact(F.array(
        F.struct(F.coalesce("_text", "mention_text").alias("text")),
        F.when(timed, F.struct(F.concat(F.lit("timeframe: "), F.col("timeframe_operator"), F.lit(" "), number, F.lit(" "), F.col("timeframe_unit")).alias("text")))))
    ref = lambda c: F.struct(c.alias("reference"))
    doc = F.struct(
        F.lit("MedicationStatement").alias("resourceType"), F.lit("unknown").alias("status"),
        F.struct(F.array(F.struct(uri.alias("system"), "code", "display")).alias("coding"), F.col("mention_text").alias("text")).alias("medicationCodeableConcept"),
        ref(F.when(trial.isNotNull(), F.concat(F.lit("Group/trial-"), trial)).otherwise("Group/eligibility-cohort")).alias("subject"),
        F.array(ref(F.when(trial.isNotNull(), F.concat(F.lit("ResearchStudy/"), trial)).otherwise("ResearchStudy"))).alias("derivedFrom"),
        notes.alias("note"),
        F.array(F.struct(F.lit(IDENTIFIER).alias("system"), F.col(key).cast("string").alias("value"))).alias("identifier"))
    return projections.where(F.col("resource_type").isNotNull()).join(c, key).select(key, "mention_no", "system", "code", F.to_json(doc).alias("resource"))
