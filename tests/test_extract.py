"""Narratives with known readings."""

from cohortmill.operators import narrative as N
from cohortmill.operators import tagging as G
from cohortmill.operators import values as V
from cohortmill.operators.extract import extract
from cohortmill.sources.dictionaries import default_abbreviations, default_phrases, phrase_table
from pyspark.sql import functions as F

NARRATIVES = {
    "plain": "Patients must be at least 18 years old.\nPatients must NOT have active CNS disease.\nMust have adequate organ function.",
    "headed": "Inclusion Criteria:\n1. Age >= 18 years\n2. Histologically confirmed HER2-positive breast cancer\n3. ECOG performance status 0-1\n"
              "4. ANC >= 1500 cells/uL\n5. Patients must NOT have received prior immunotherapy\n\nExclusion Criteria:\n"
              "1. Prior treatment with trastuzumab within 28 days\n2. Known hypersensitivity to study drug",
    "split": "Exclusion Criteria:\n1. No active brain metastases or leptomeningeal disease",
    "unless": "Exclusion Criteria:\n1. No prior treatment with trastuzumab, unless administered in the adjuvant setting more than 6 months ago",
    "allow": "Exclusion Criteria:\n- Systemic corticosteroids are excluded except for physiologic replacement doses of prednisone.",
    "lines": "Inclusion Criteria:\n1. Have received at least 3 targeted therapies for metastatic disease, including disease progression after receiving "
             "at least 1 trastuzumab-containing treatment.",
    "sex": "Inclusion Criteria:\n2. Female patients only",
}
EXPECTED = {
    "plain": [
        dict(category="age", type="inclusion", operator="gte", value_low=18.0, unit="years", timeframe_unit=None),
        dict(category="cns_metastases", type="exclusion", negated=True, parse_status="parsed"),
        dict(category="organ_function", parse_status="parsed", review_required=False),
    ],
    "headed": [
        dict(category="age", operator="gte", value_low=18.0, unit="years", raw_expression="Age >= 18 years"),
        dict(category="biomarker", value_text="positive", type="inclusion"),
        dict(category="performance_status", operator="range", value_low=0.0, value_high=1.0),
        dict(category="lab_value", operator="gte", value_low=1500.0, unit="cells/uL"),
        dict(category="prior_therapy", type="exclusion", review_required=True, review_reason="polarity_override"),
        dict(category="prior_therapy", type="exclusion", timeframe_operator="within", timeframe_value=28.0, timeframe_unit="days"),
        dict(category="other", parse_status="partial", review_required=False),
    ],
    "split": [
        dict(original_text="No active brain metastases", logic_operator="OR", category="cns_metastases", negated=True),
        dict(original_text="No active leptomeningeal disease", logic_operator="OR", category="cns_metastases"),
    ],
    "unless": [dict(category="prior_therapy", parse_status="partial", review_required=True, review_reason="complex_criteria", timeframe_operator="at_least")],
    "allow": [dict(category="concomitant_medication", parse_status="parsed", review_required=False, logic_operator="AND",
                   allowance_text="physiologic replacement doses of prednisone", value_text="systemic corticosteroids")],
    "lines": [
        dict(original_text="Have received at least 3 targeted therapies for metastatic disease", value_low=3.0, raw_expression="at least 3",
             value_text="targeted therapies", logic_operator="AND"),
        dict(value_low=1.0, raw_expression="at least 1", secondary_semantic_tags=["progression_requirement"], value_text="trastuzumab-containing treatment"),
    ],
    "sex": [dict(category="other", value_text="female", parse_status="partial", raw_expression="Female patients only", review_required=False)],
}


def test_narratives(spark):
    docs = spark.createDataFrame(list(NARRATIVES.items()), "doc_id string, text string").coalesce(1)
    got = {}
    for r in extract(docs).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append(r.asDict(True))
    for name, rows in EXPECTED.items():
        assert len(got[name]) == len(rows), name
        for want, have in zip(rows, got[name]):
            assert {k: have[k] for k in want} == want, name


def test_quantities(spark):
    cases = {
        "≥ 1.5 × 10⁹/L": ("gte", 1.5e9, None, "/L"), "18-65 years": ("range", 18.0, 65.0, "years"), "0 to 1": ("range", 0.0, 1.0, None),
        "Less than 5 mg": ("lte", 5.0, None, "mg"), "> 3 ULN": ("gte", 3.0, None, "× ULN"), ">= 100,000/uL": ("gte", 100.0, None, ",000/uL"),
        "at most": None, "must be at least 3 mg": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("q", V.quantity(F.col("t")))
    for r in df.collect():
        q = r["q"]
        assert (None if q is None else (q["operator"], q["value_low"], q["value_high"], q["unit"])) == cases[r["t"]], r["t"]


def test_top_level_split(spark):
    row = spark.range(1).select(
        N.split_and(F.lit("A (b and c (d and e)) and f, AND g")).alias("a"), N.split_or(F.lit("x and/or y or (z or w)")).alias("o"),
        N.split_commas(F.lit("a, (b, c) d), e")).alias("c")).first()
    assert row["a"] == ["A (b and c (d and e))", "f", "g"]
    assert row["o"] == ["x", "y", "(z or w)"]
    assert row["c"] == ["a", "(b, c) d)", "e"]


def test_large_dictionary_gives_the_same_mentions(spark):
    texts = ["Histologically confirmed HER2-positive breast cancer", "non-small cell lung cancer or other advanced solid tumors", "no words", "",
             "programmed death ligand-1 (PD-L1) therapy and prednisone"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = phrase_table(spark)
    small = {r["id"]: r["mentions"] for r in G.tag(df, table).collect()}
    large = {r["id"]: r["mentions"] for r in G.tag(df, table, inline=1).collect()}
    assert small == large
    assert [m["text"] for m in small[1]] == ["non-small cell lung cancer", "other advanced solid tumors"]
    assert len(default_phrases()) > 150 and default_abbreviations()["nsclc"] == "Non-Small Cell Lung Cancer"
