"""What a match job takes from rows it has made already is what it would make of the evaluations again."""

import pytest
from pyspark.sql import functions as F
from test_evaluation_rows import _inputs

from cohortmill.functions import scale as S
from cohortmill.operators import gaps as G
from cohortmill.operators import match_runs as R
from cohortmill.operators import matching as M


@pytest.fixture(scope="module")
def made(spark):
    i = _inputs(spark)
    i["criteria"] = i["criteria"].withColumn("logic_operator", F.when(F.col("ord") % 2 == 0, "OR")).withColumn("logic_group_id", (F.col("ord") % 3).cast("string")).withColumn(
        "review_status", F.when(F.col("ord") % 5 == 0, "pending").when(F.col("ord") % 7 == 0, "rejected")).withColumn("review_required", F.col("ord") % 5 == 0).withColumn("confidence", F.lit(0.9))
    rules = S.stage(M.trial_rules(i["trials"], i["runs"], i["criteria"]))
    return i, rules, S.stage(M.evaluate(**i, rules=rules))


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_results_of_effective_rows(made):
    _, rules, ev = made
    assert _rows(M.pair_results(M.collapse_groups(ev, rules), rules)) == _rows(M.pair_results(ev, rules))


@pytest.mark.parametrize("listed", [1, 2])
def test_review_items_come_from_the_stored_reports(spark, made, tmp_path, monkeypatch, listed):
    i, rules, ev = made
    trials = i["trials"].withColumn("brief_title", F.explode(F.array(*[F.lit(f"t{n}") for n in range(listed)])))
    entries = G.gap_entries(M.collapse_groups(ev, rules))
    seen = []
    monkeypatch.setattr(R, "review_items", lambda e: seen.append(e) or G.review_items(e))
    store = R.MatchStore(spark, str(tmp_path))
    store.write("a", i["requests"], ev, rules, trials)
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    want = G.review_items(entries)
    assert store.read("match_results").count() == listed * ev.select("patient_id", "trial_id").distinct().count()
    assert _rows(store.read("match_review_items").select(*want.columns)) == _rows(want) and want.count() > 100
