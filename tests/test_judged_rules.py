"""Rules are read once, as numbers; what runs per pair and rule stays short enough to be compiled."""

import itertools

import pytest
from pyspark.sql import functions as F
from test_evaluation_rows import _inputs

from cohortmill.functions import logic as L
from cohortmill.functions import scale as S
from cohortmill.operators import gaps as G
from cohortmill.operators import matching as M

COMPILED = 8_000  # bytes of a method above which the JVM leaves it to the interpreter


def _longest_method(df, needs):
    """Longest generated method of the stages whose plan mentions ``needs``."""
    jvm = df.sparkSession._jvm
    debug = getattr(getattr(jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()) if needs in parts.apply(i)._1()]
    assert sizes
    return max(sizes)


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_rows_of_pairs_and_rules_are_compiled(spark, static_plans):
    i = _inputs(spark)
    rules = S.stage(M.trial_rules(i["trials"], i["runs"], i["criteria"]))
    ev = M.evaluate(**i, rules=rules)
    for df in (M.pair_results(ev, rules), G.gap_entries(M.collapse_groups(ev, rules)), ev, M.evaluate(**i, rules=rules, evidence=True)):
        assert _longest_method(df, "_found") < COMPILED


def test_intervals_say_what_comparisons_say(spark):
    values = [None, float("-inf"), -1.0, 0.0, 2.0, 3.0, float("nan")]
    ops = [None, "gte", "gt", "lte", "lt", "eq", "neq", "between", "range"]
    rules = spark.createDataFrame(
        [(n, n, "age", "inclusion", "extracted", o, a, b) for n, (o, a, b) in enumerate(itertools.product(ops, values, values))],
        "trial_id int, criterion_id long, category string, type string, source_type string, operator string, value_low double, value_high double").withColumn("ord", F.lit(1))
    for c in ("gate", "match_text"):
        rules = rules.withColumn(c, F.lit(None).cast("string"))
    rules = M.with_columns(rules, M.RULE_COLUMNS)
    people = spark.createDataFrame([(v,) for v in values], "age double").selectExpr(
        "age", "cast(null as string) as sex", "1 as ecog_status", "1 as max_line", "0 as _bits", "cast(null as int) as _fact")
    rows = M.with_outcome(people.crossJoin(M.judged(rules)))
    said = L.polarity(F.col("type"), L.numeric_satisfied(F.col("operator"), F.col("value_low"), F.col("value_high"), F.col("age")))
    assert rows.where(F.col("outcome") != F.coalesce(said, F.lit("unknown"))).count() == 0
    assert rows.count() == len(ops) * len(values) ** 3 and {r[0] for r in rows.select("outcome").distinct().collect()} == {"matched", "not_matched", "unknown"}


def test_results_need_no_group_type(spark):
    """Rows that were stored without the type of their group give the same counts."""
    i = _inputs(spark)
    criteria = i["criteria"].withColumn("logic_operator", F.when(F.col("ord") % 2 == 0, "OR")).withColumn("logic_group_id", (F.col("ord") % 3).cast("string"))
    rules = S.stage(M.trial_rules(i["trials"], i["runs"], criteria))
    ev = S.stage(M.evaluate(**{**i, "criteria": criteria}, rules=rules))
    rows = lambda df: sorted(map(str, df.collect()))
    assert ev.where("group_type is not null").count() > 0
    assert rows(M.pair_results(ev, rules)) == rows(M.pair_results(ev.drop("group_type"), rules))
