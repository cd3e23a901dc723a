"""Narratives extracted, coded, stored and matched: statuses worked out by hand; corpus scan and patient upsert."""

import datetime

from pyspark.sql import functions as F

from cohortmill.operators import intake as I
from cohortmill.operators.match_runs import MatchStore
from cohortmill.sources import patients as Pt
from cohortmill.sources import studies as St

DAY = datetime.date(2026, 1, 1)


def world(spark):
    narratives = spark.createDataFrame([
        (1, 10, "Inclusion Criteria:\n1. Age >= 50 years"),                                       # replaced by run 2
        (2, 10, "Inclusion Criteria:\n1. Age >= 18 years\n2. ECOG performance status 0-1"),
        (3, 11, "Inclusion Criteria:\n1. Histologically confirmed melanoma"),
    ], "run_id long, trial_id long, text string")
    trials = spark.createDataFrame([(10, "NCT00000010", "T10", None, None, "ALL"), (11, "NCT00000011", "T11", None, None, "ALL"), (12, "NCT00000012", "T12", None, None, "ALL")],
                                   "trial_id long, nct_id string, brief_title string, eligible_min_age string, eligible_max_age string, eligible_sex string").withColumn(
        "accepts_healthy", F.lit(None).cast("boolean"))
    runs = narratives.select("run_id", "trial_id", F.lit("completed").alias("status"), F.timestamp_seconds("run_id").alias("started_at"), F.timestamp_seconds("run_id").alias("finished_at"))
    patients = spark.createDataFrame([(1, "male", datetime.date(1980, 5, 1), 1), (2, "female", datetime.date(2015, 5, 1), 0), (3, "female", datetime.date(1990, 5, 1), 3)],
                                     "patient_id long, sex string, birth_date date, ecog_status int")
    # patient 1 is matched by its code alone: the description says something else
    facts = spark.createDataFrame([(1, "condition", "skin tumour", [("mesh", "D008545", None, None)]), (3, "condition", "asthma", [("mesh", "D001249", None, None)])],
                                  "patient_id long, kind string, description string, coded_concepts array<struct<system:string,code:string,display:string,match_type:string>>")
    lookups = spark.createDataFrame([("mesh", "D008545", "Melanoma", [], 0), ("mesh", "D001249", "Asthma", [], 1), ("nci_thesaurus", "C1", "ECOG", ["ECOG performance status"], 2)], "system string, code string, display string, synonyms array<string>, place long")
    return narratives, trials, runs, patients, facts, lookups


def test_narratives_to_stored_statuses(spark, tmp_path):
    narratives, trials, runs, patients, facts, lookups = world(spark)
    ingest = lambda: I.ingest_narratives(narratives, lookups, str(tmp_path / "criteria"), "b1")
    criteria = ingest()
    rows = {(r.run_id, r.category): r for r in criteria.collect()}
    assert len(rows) == criteria.count() == 4
    assert [(c["system"], c["code"], c["match_type"]) for c in rows[3, "diagnosis"].coded_concepts] == [("mesh", "D008545", "exact")]
    criteria = ingest()  # a batch run again replaces itself
    assert sorted(map(str, rows.values())) == sorted(map(str, criteria.collect()))
    assert {k: (r.review_required, r.review_reason) for k, r in rows.items()} == {k: (False, None) for k in rows}
    store = MatchStore(spark, str(tmp_path / "matches"))
    requests = patients.crossJoin(trials.select("trial_id")).select("patient_id", "trial_id")
    I.match_batch(store, "b1", requests, patients, trials, runs, criteria, facts, str(DAY))
    got = {(r.patient_id, r.trial_id): r.overall_status for r in store.read("match_results").collect()}
    assert got == {(1, 10): "eligible", (2, 10): "ineligible", (3, 10): "ineligible", (1, 11): "eligible", (2, 11): "possible", (3, 11): "ineligible"}
    assert {r.patient_id: r.total_trials_evaluated for r in store.read("match_runs").collect()} == {1: 2, 2: 2, 3: 2}


def test_corpus_scan(spark, tmp_path):
    for name, text in {"a.txt": "one\ntwo\n", "b.c.txt": "\n", "d": "x"}.items():
        (tmp_path / name).write_text(text)
    assert {(r.fixture, r.text) for r in St.read_corpus(spark, str(tmp_path)).collect()} == {("a", "one\ntwo\n"), ("b.c", "\n"), ("d", "x")}


def test_several_changes_of_one_patient(spark):
    patients = spark.createDataFrame([(1, "male", 2), (2, "female", 0)], "patient_id long, sex string, ecog_status int")
    changes = spark.createDataFrame([
        (1, "female", None, ["sex"], 1), (1, None, 1, ["ecog_status"], 2), (1, None, None, ["ecog_status"], 3),
        (9, "male", 1, ["sex"], 1), (9, "female", 2, ["ecog_status"], 2)], "patient_id long, sex string, ecog_status int, supplied array<string>, n int")
    got = {r.patient_id: (r.sex, r.ecog_status) for r in Pt.upsert_patients(patients, changes, order="n").collect()}
    assert got == {1: ("female", None), 2: ("female", 0), 9: ("male", 2)}
    assert Pt.upsert_patients(patients, changes).count() == 3
