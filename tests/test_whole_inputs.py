"""No cap, cut or size switch changes a result; reruns and repeated decisions do no harm."""

import json

from pyspark.sql import functions as F

from cohortmill.functions import scale as S
from cohortmill.functions.ship import ship
from cohortmill.operators import coding as K
from cohortmill.operators import export as X
from cohortmill.operators import matching as M
from cohortmill.operators import review as R
from cohortmill.operators import tagging as G
from cohortmill.sources import studies as St


def test_both_taggers_agree_on_conflicts(spark):
    ship(spark)
    phrases = spark.createDataFrame([
        ("Alpha Beta", "exact", "ZZZ"), ("Alpha Beta", "exact", "AAA"), ("alpha beta", "lower", "LOW"), ("alpha-beta", "loose", "LOOSE"), ("gamma", "loose", "G1"), ("gamma", "lower", "G2"),
        ("--", "exact", "NOWORD"), ("delta", "lower", "D")], "phrase string, kind string, label string")
    texts = spark.createDataFrame([("Alpha Beta and ALPHA beta or alpha / beta",), ("Gamma -- delta",), ("",), (None,)], "text string")
    found = []
    for inline in (5_000, 1, 0):
        out = G.tag(texts, phrases, inline=inline).select("text", "mentions.label", "mentions.start").collect()
        found.append(sorted(((r["text"], r["label"], r["start"]) for r in out), key=str))
    assert found[0] == found[1] == found[2]
    assert ("Alpha Beta and ALPHA beta or alpha / beta", ["AAA", "LOW", "LOOSE"], [0, 15, 29]) in found[0]
    assert ("Gamma -- delta", ["G2", "D"], [0, 9]) in found[0]


def test_long_drug_names_are_found(spark):
    term = "one two three four five six seven"
    index = spark.createDataFrame([("rxnorm", term, term.title())], "system string, term string, display string")
    rows = spark.createDataFrame([(1, f"took {term} daily"), (2, "took one two")], "id int, text string")
    assert [(r["id"], r["display"]) for r in X.named_drugs(rows, ["id"], "text", index).collect()] == [(1, term.title())]


def test_long_negated_words_stay_whole(spark):
    word = "a" * 1500
    df = spark.createDataFrame([(f"non{word} cells",)], "t string").select(K.negated_phrases(F.col("t")).alias("p"))
    assert word in df.first()["p"]


def test_every_column_has_its_own_hot_keys(spark):
    df = spark.range(20_000).select((F.col("id") % 100).alias("trial_id"), F.when(F.col("id") < 150, -1).otherwise(F.col("id")).alias("patient_id"))
    hot = S.hot_keys(df, ["patient_id", "trial_id"], hot_rows=100)
    assert hot["patient_id"] == ["-1"] and len(hot["trial_id"]) == S.HOT_KEYS


def test_first_decision_holds(spark):
    criteria = spark.createDataFrame([(1, 7, 3, "pending", True), (2, 7, 3, "pending", True)], "criterion_id int, trial_id int, run_id int, review_status string, review_required boolean")
    latest = spark.createDataFrame([(7, 3)], "trial_id int, run_id int")
    decisions = spark.createDataFrame(
        [(1, "reject", "b", None, [], 2), (1, "accept", "a", None, [], 1), (9, "accept", "a", None, [], 1)],
        "criterion_id int, action string, reviewed_by string, review_notes string, corrected_fields array<string>, decided_at int")
    done, refused = R.apply_decisions(criteria, latest, decisions)
    assert sorted((r["criterion_id"], r["review_status"]) for r in done.collect()) == [(1, "accepted"), (2, "pending")]
    assert sorted((r["criterion_id"], r["conflict"]) for r in refused.collect()) == [(1, "already_resolved"), (9, "not_found")]


def test_studies_by_line_and_rejects(spark, tmp_path):
    study = lambda n: json.dumps({"protocolSection": {"identificationModule": {"nctId": n}}})
    (tmp_path / "a.jsonl").write_text(study("NCT00000001") + "\n" + study("NCT00000002") + "\nnot json\n\n")
    fine, bad = St.read_studies(spark, str(tmp_path), lines=True)
    assert sorted(r[0] for r in fine.select("s.protocolSection.identificationModule.nctId").collect()) == ["NCT00000001", "NCT00000002"]
    assert [r["raw_json"] for r in bad.collect()] == ["not json"]


def test_rerun_replaces_the_rows_of_a_run(spark, tmp_path):
    c = spark.createDataFrame([(1, True), (2, False)], "criterion_id int, review_required boolean")
    for run, df in (("r1", c), ("r2", c), ("r1", c.limit(1))):
        St.write_criteria(df, str(tmp_path / "c"), run)
    out = spark.read.parquet(str(tmp_path / "c"))
    assert sorted((r["run_id"], r["count"]) for r in out.groupBy("run_id").count().collect()) == [("r1", 1), ("r2", 2)]


def test_page_keeps_its_order_and_length(spark):
    results = spark.createDataFrame([(i, i % 3, "2024-01-01", 1, 1, 0, 0) for i in range(9)],
                                    "match_result_id int, trial_id int, created_at string, favorable_count int, unfavorable_count int, unknown_count int, requires_review_count int")
    trials = spark.createDataFrame([(0, "N0", "a"), (1, "N1", "b")], "trial_id int, nct_id string, brief_title string")
    assert [r["match_result_id"] for r in M.list_matches(results, trials, page=2, per_page=4).collect()] == [4, 3, 2, 1]
