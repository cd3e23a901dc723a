"""What is copied into every request is narrow, and says the same as the wide rows."""

import random

from pyspark.sql import functions as F

from cohortmill.functions import logic as L
from cohortmill.functions import scale as S
from cohortmill.operators import matching as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def _inputs(spark):
    rng = random.Random(7)
    flag = lambda: rng.choice([None, True, False])
    cats = ["diagnosis", "lab_value", "biomarker", "prior_therapy", "line_of_therapy", "concomitant_medication", "administrative_requirement", "reproductive_status", "performance_status"]
    words = ["alpha", "beta", "gamma", "delta"]
    text = lambda: " ".join(rng.sample(words, rng.choice([1, 2, 3])))
    patients = spark.createDataFrame(
        [(p, rng.choice([None, "male", "female"]), rng.choice([None, 0, 2]), flag(), *[flag() for _ in L.PATIENT_FLAGS]) for p in range(12)],
        "patient_id int, sex string, ecog_status int, is_healthy_volunteer boolean, " + ", ".join(f"{f} boolean" for f in L.PATIENT_FLAGS)).withColumn("birth_date", F.lit("1980-01-01").cast("date"))
    trials = spark.createDataFrame([(t, "18 Years", None, rng.choice(["ALL", "MALE"]), bool(t % 2)) for t in range(5)], "trial_id int, eligible_min_age string, eligible_max_age string, eligible_sex string, accepts_healthy boolean")
    runs = spark.createDataFrame([(t, t, "completed") for t in range(5)], "run_id int, trial_id int, status string").withColumn("started_at", F.lit("2024-01-01").cast("date")).withColumn("finished_at", F.col("started_at"))
    value = {"administrative_requirement": lambda: rng.choice(["can_consent:true", "protocol_compliant: False"]), "reproductive_status": lambda: "pregnant:true"}
    criteria = spark.createDataFrame(
        [(t * 100 + n, t, t, n, rng.choice(["inclusion", "exclusion"]), c, value.get(c, text)(), rng.choice(["gte", "between", "range"]), 1.0, 30.0) for t in range(5) for n, c in enumerate(cats * 2)],
        "criterion_id long, run_id int, trial_id int, ord long, type string, category string, value_text string, operator string, value_low double, value_high double")
    facts = spark.createDataFrame(
        [(p, rng.choice(["condition", "lab", "biomarker", "therapy", "medication"]), text(), rng.choice([None, 5.0, 90.0]), rng.choice([None, 1]), flag()) for p in range(9) for _ in range(4)],
        "patient_id int, kind string, description string, value_numeric double, line_of_therapy int, active boolean")
    return dict(requests=patients.select("patient_id").crossJoin(trials.select("trial_id")), patients=patients, trials=trials, runs=runs, criteria=criteria, facts=facts, as_of="2024-06-30")


def test_packed_profiles_give_the_same_evaluations(spark):
    i = _inputs(spark)
    rules = S.stage(M.trial_rules(i["trials"], i["runs"], i["criteria"]))
    narrow, wide = M.evaluate(**i, rules=rules), M.evaluate(**i, rules=rules, evidence=True)
    key = lambda r: tuple(map(str, r))
    got = sorted(narrow.collect(), key=key)
    assert got == sorted(wide.select(*M.EVALUATION).collect(), key=key) and len({(r.category, r.outcome) for r in got}) > 20
    profile = M.patient_profile(i["patients"], i["facts"], i["as_of"])
    assert "_bits" in M.packed(profile).columns and not {*M.COUNTS, *M.FLAGS} & {*M.packed(profile).columns}
    back = M.unpacked(M.packed(profile))
    assert back.select("patient_id", *M.FLAGS).exceptAll(profile.select("patient_id", *M.FLAGS)).count() == 0


def test_keys_travel_as_hashes_that_may_collide(spark, monkeypatch):
    i = _inputs(spark)
    rules = S.stage(M.trial_rules(i["trials"], i["runs"], i["criteria"]))
    hits = lambda: {tuple(r) for r in M.fact_hits(i["requests"], rules, M.with_columns(i["facts"], M.FACT_COLUMNS)).collect()}
    plan = _plan(M.fact_candidates(i["requests"], rules, i["facts"]))
    assert "_hash" in plan
    want = hits()
    monkeypatch.setattr(M.F, "hash", lambda *cols: F.lit(0))
    assert hits() == want and len(want) > 20
