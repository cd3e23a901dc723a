"""Queries store and shuffle what they need, once."""

import re

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import scale as S
from cohortmill.operators import match_runs as R
from cohortmill.operators import matching as M
from cohortmill.plans import matching_queries as Q
from cohortmill.plans import views as V
from cohortmill.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_rules_store_the_trial_side_only(spark, monkeypatch):
    asked = []
    table = V.table
    monkeypatch.setattr(V, "table", lambda s, sf, name: asked.append(name) or table(s, sf, name))
    for name in ("m5_applicable_rules", "m6_criterion_state"):
        asked.clear()
        QUERIES[name](spark, SF)
        assert set(asked) == {"trials", "pipeline_runs", "criteria"}


def test_lines_are_dealt_before_they_are_sorted(spark, tmp_path):
    for name, ddl, rows in (
            ("part", "p_partkey long, p_name string", [(1, "b x"), (2, "a x"), (2, "c x"), (3, None)]),
            ("lineitem", "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_partkey long",
             [(1, 1, 5.0, 0.1, None, 1), (1, 1, 4.0, None, 0.2, 2), (None, 1, 3.0, 0.1, 0.1, 3), (None, 1, 2.0, 0.1, 0.1, 1), (2, None, 1.0, 0.0, 0.0, 3), (3, 1, 1.0, 0.0, 0.0, 9)])):
        spark.createDataFrame(rows, ddl).createOrReplaceTempView(name)
    lines = spark.sql(f"WITH {V.ctes('lines', spark=True)} SELECT * FROM lines")
    plan = _plan(lines)
    assert plan.rindex("SortAggregate") < plan.index("Exchange hashpartitioning(l_orderkey")  # none below the exchange
    want = spark.sql(f"WITH {V.ctes('lines')} SELECT * FROM lines")
    assert sorted(map(str, lines.collect())) == sorted(map(str, want.collect())) and want.count() == 3
    V.register(spark, SF)


@pytest.fixture(scope="module")
def some(spark):
    i = Q.inputs(spark, SF)
    i["requests"] = S.stage(i["requests"].where("patient_id <= 20"))
    return i, S.stage(Q.rules_of(i))


def test_branches_of_effective_rows_read_one_shuffle_of_requests(spark, some):
    i, rules = some
    eff = M.collapse_groups(M.evaluate(**i, rules=rules), rules)
    plan = _plan(eff.groupBy("category", "outcome", "missing").count())  # asks for no patient
    dealt = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(trial_id#[^\n]*\n[^\n]*Project (\[[^\n]*_bits[^\n]*\])", plan)]
    assert len(dealt) == 2 and len(set(dealt)) == 1 and "patient_id" in dealt[0]


def test_facts_of_other_kinds_are_left_out(spark, some):
    i, rules = some
    facts = M.with_columns(i["facts"], M.FACT_COLUMNS)
    key = lambda r: tuple(map(str, r))
    whole = M.fact_results(i["requests"], rules, facts).collect()
    for cats in (["prior_therapy", "line_of_therapy"], ["lab_value"], ["sex"]):
        few = S.stage(rules.where(F.col("category").isin(cats)))
        ids = {r[0] for r in few.select("criterion_id").collect()}
        found = M.fact_results(i["requests"], few, facts)
        assert sorted(found.collect(), key=key) == sorted((r for r in whole if r.criterion_id in ids), key=key)
        if cats != ["lab_value"]:
            assert "Window" not in _plan(found)  # no sweep over lab values


def test_entries_are_not_stored_beside_reports(spark, some, tmp_path, monkeypatch):
    i, rules = some
    stored = []
    monkeypatch.setattr(R, "stage", lambda df: stored.append(df.columns) or S.stage(df))
    store = R.MatchStore(spark, str(tmp_path))
    store.write("a", i["requests"], S.stage(M.evaluate(**i, rules=rules)), rules, i["trials"])
    assert len(stored) == 1 and "ordinal" not in stored[0]
    n = sum(sum(len(r.report[b]) for b in R.BUCKETS if b != "hard_blockers") for r in store.read("match_results").collect())
    assert n == store.read("match_review_items").count() > 0
