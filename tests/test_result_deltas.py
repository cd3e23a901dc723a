"""Result deltas are taken from evaluations as they are made."""

from cohortmill.plans import matching_queries as Q
from cohortmill.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_evaluations_are_not_stored(spark, monkeypatch):
    stored, stage = [], Q.stage
    monkeypatch.setattr(Q, "stage", lambda df, *a: stored.append(df.columns) or stage(df, *a))
    d = QUERIES["d2_result_deltas"](spark, SF)
    assert stored and not any("outcome" in c for c in stored)
    assert d.count() == d.select(*Q.PAIR).distinct().count() > 0
