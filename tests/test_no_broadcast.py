"""Joins of tables that grow are shuffled, and evaluations meet their group without another shuffle."""

import contextlib

from pyspark.sql import functions as F

from cohortmill.functions import scale as S
from cohortmill.operators import coding as K
from cohortmill.operators import matching as M


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@contextlib.contextmanager
def _tables(spark):
    trials = spark.createDataFrame([(t, "18 Years", None, "ALL", True) for t in range(6)], "trial_id int, eligible_min_age string, eligible_max_age string, eligible_sex string, accepts_healthy boolean")
    runs = spark.createDataFrame([(t, t, "completed") for t in range(6)], "run_id int, trial_id int, status string").withColumn("started_at", F.lit("2024-01-01").cast("date")).withColumn("finished_at", F.col("started_at"))
    criteria = spark.createDataFrame(
        [(t * 10 + n, t, t, n, "inclusion", "diagnosis", f"w{t} w{n}", "OR" if n < 2 else "AND", "g" if n < 2 else None) for t in range(6) for n in range(4)],
        "criterion_id long, run_id int, trial_id int, ord long, type string, category string, original_text string, logic_operator string, logic_group_id string")
    facts = spark.createDataFrame([(p, "condition", f"w{p % 6} w{p % 4}") for p in range(9)], "patient_id int, kind string, description string")
    patients = spark.createDataFrame([(p,) for p in range(9)], "patient_id int").withColumn("birth_date", F.lit("1980-01-01").cast("date"))
    requests = patients.select("patient_id").crossJoin(trials.select("trial_id"))
    yield dict(requests=requests, patients=patients, trials=trials, runs=runs, criteria=criteria, facts=facts, as_of="2024-06-30")


def test_evaluation_is_not_broadcast_nor_shuffled_again(spark):
    with _tables(spark) as i:
        rules = S.stage(M.trial_rules(i["trials"], i["runs"], i["criteria"]))
        ev = M.evaluate(**i, rules=rules)
        assert "Broadcast" not in _plan(ev)
        results = M.pair_results(ev, rules)
        # the only exchange beyond those of the evaluation deals out the groups of the trials
        assert _plan(results).count("Exchange hashpartitioning(") - _plan(ev).count("Exchange hashpartitioning(") <= 2
        got = {(r.patient_id, r.trial_id, r.criterion_id) for r in ev.where("outcome = 'matched' and criterion_id is not null").collect()}
        assert got == {(p, t, t * 10 + n) for p in range(9) for t in range(6) for n in range(4) if {f"w{t}", f"w{n}"} & {f"w{p % 6}", f"w{p % 4}"} and (
            len({f"w{t}", f"w{n}"} & {f"w{p % 6}", f"w{p % 4}"}) >= min(len({f"w{t}", f"w{n}"}), len({f"w{p % 6}", f"w{p % 4}"}), 2))}
        eff = M.collapse_groups(ev, rules)
        assert eff.where("group_id = 'g'").count() == 54 and eff.where("group_id is null").count() == 54 * 3
        assert results.count() == 54


def test_catalogue_is_not_broadcast(spark):
    lookups = spark.createDataFrame([("s", str(n), f"name {n}", [f"other {n}"]) for n in range(40)], "system string, code string, display string, synonyms array<string>")
    asked = spark.createDataFrame([("r", True, 0, "nane 7", "s", 0)], "request_id string, fuzzy boolean, variant_no int, variant string, system string, system_rank int")
    index = K.catalogue_index(S.stage(lookups))
    for found in (K.exact_matches(asked, index), K.synonym_matches(asked, index), K.edit_matches(asked, index)):
        assert "Broadcast" not in _plan(found)
    assert "7" in {r.code for r in K.edit_matches(asked.withColumn("variant", F.lit("name 7x")), index).collect()}
