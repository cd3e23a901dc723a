"""Stored match runs: one run per patient, visible at once or not at all."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import scale as S
from cohortmill.operators import matching as M
from cohortmill.operators import review as Rv
from cohortmill.operators import runs as R
from cohortmill.operators.match_runs import MatchStore
from cohortmill.plans import matching_queries as Q

SF = "/root/testdata/sf0.001"
DAY = datetime.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def job(spark):
    i = Q.inputs(spark, SF)
    i["requests"] = S.stage(i["requests"].where("patient_id <= 20").unionByName(spark.createDataFrame([(3, -1), (777, -1)], "patient_id long, trial_id long")))
    rules = S.stage(Q.rules_of(i))
    return i, rules, S.stage(M.evaluate(**i, rules=rules))


def put(store, job, batch, at, patients="true"):
    i, rules, ev = job
    store.write(batch, i["requests"].where(patients), ev.where(patients), rules, i["trials"], at)


def test_runs_are_whole_and_repeatable(spark, tmp_path, job):
    i, rules, ev = job
    store = MatchStore(spark, str(tmp_path))
    put(store, job, "01", DAY)
    cols = ["patient_id", "trial_id", "overall_status", "score"]
    want = sorted(map(tuple, M.pair_results(ev, rules).select(cols).collect()))
    assert sorted(map(tuple, store.read("match_results").select(cols).collect())) == want
    runs = {r.patient_id: r for r in store.read("match_runs").collect()}
    assert set(runs) == {r[0] for r in i["requests"].select("patient_id").distinct().collect()}
    assert runs[777].total_trials_evaluated == 0 and runs[777].match_run_id == "01:777"  # requests without a rule
    first = {n: store.read(n).count() for n in ("match_result_criteria", "match_results", "match_review_items", "match_runs")}
    put(store, job, "01", DAY + datetime.timedelta(days=1))
    assert {n: store.read(n).count() for n in first} == first
    put(store, job, "2", DAY + datetime.timedelta(days=2), "patient_id % 2 = 0")
    latest = {r.patient_id: r.match_run_id for r in R.latest_completed_match_runs(store.read("match_runs")).collect()}
    assert all(run == f"{'01' if p % 2 else '2'}:{p}" for p, run in latest.items()) and set(latest) == set(runs)
    queue = Rv.match_queue(store.read("match_review_items"), R.latest_completed_match_runs(store.read("match_runs")), i["trials"])
    assert queue.count() == first["match_review_items"] and queue.where(F.col("match_run_id").startswith("2:") != (F.col("patient_id") % 2 == 0)).count() == 0


def test_killed_job_is_invisible(spark, tmp_path, job, monkeypatch):
    store = MatchStore(spark, str(tmp_path))
    put(store, job, "1", DAY, "patient_id % 2 = 1")
    before = sorted(map(str, store.read("match_results").collect()))

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(MatchStore, "commit", killed)
    for batch in ("1", "2"):
        with pytest.raises(RuntimeError):
            put(store, job, batch, DAY + datetime.timedelta(days=1))
    assert sorted(map(str, store.read("match_results").collect())) == before
    assert store.read("match_runs").where("patient_id % 2 = 0").count() == 0
