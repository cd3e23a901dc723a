"""Incremental ingest equals what changed."""

import json

from cohortmill.streaming import ingest


def study(nct, text):
    return {"protocolSection": {"identificationModule": {"nctId": nct, "briefTitle": "T " + nct}, "eligibilityModule": {"eligibilityCriteria": text, "healthyVolunteers": True}}}


def test_only_changed_studies_are_extracted(spark, tmp_path):
    src, store, cp = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "cp")
    src.mkdir()
    (src / "a.json").write_text(json.dumps(study("NCT00000001", "1. Age >= 18 years")))
    (src / "b.json").write_text(json.dumps(study("NCT00000002", "1. ANC >= 1500\n2. Known hypersensitivity")))
    ingest.start(spark, str(src), store, cp).awaitTermination()
    assert ingest.stored_trials(spark, store).count() == 2
    assert spark.read.parquet(f"{store}/criteria").count() == 3
    (src / "c.json").write_text(json.dumps(study("NCT00000001", "1. age >=  18 YEARS")))
    (src / "d.json").write_text(json.dumps(study("NCT00000002", "1. ANC >= 2000")))
    ingest.start(spark, str(src), store, cp).awaitTermination()
    rows = {(r["batch_id"], r["nct_id"]) for r in spark.read.parquet(f"{store}/trials").collect()}
    assert rows == {(0, "NCT00000001"), (0, "NCT00000002"), (1, "NCT00000002")}
    latest = {r["nct_id"]: r["eligibility_text"] for r in ingest.stored_trials(spark, store).collect()}
    assert latest["NCT00000002"] == "1. ANC >= 2000"
    assert not ingest.stored_trials(spark, store).where("accepts_healthy").count()


def test_outcomes_of_a_batch_are_judged_by_spark(spark):
    one, two = json.dumps(study("NCT00000001", "1. Age >= 18 years")), json.dumps(study("NCT00000002", "1. ANC >= 1500"))
    old = json.dumps(study("NCT00000001", "1. Age >= 20 years"))
    rows = [(one, "2024-01-02 00:00:00"), (old, "2024-01-01 00:00:00"), (old, None), (one, "2024-01-02 00:00:00"), (two, "2024-01-01 00:00:00"), ("{", None), ("{", None)]
    records = spark.createDataFrame(rows, "raw_json string, at string").selectExpr("raw_json", "cast(at as timestamp) as arrived_at")
    known = ingest.keyed(records.where("raw_json like '%NCT00000002%'")).selectExpr("key as nct_id", "content_hash")
    got = ingest.outcomes(records, known)
    seen = sorted((r.nct_id or "", r.status, r.raw_json or "") for r in got.collect())
    assert seen == sorted([("", "failed", "{")] * 2 + [("NCT00000001", "superseded", "")] * 3 + [("NCT00000001", "ingested", one), ("NCT00000002", "skipped", "")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "ArrowEval" not in plan
