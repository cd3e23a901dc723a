"""Patient upsert: supplied scalars change, supplied fact lists are replaced wholesale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.operators.whatif import replace_facts

FACT_KINDS = ["condition", "biomarker", "lab", "therapy", "medication"]


def upsert_patients(patients: DataFrame, changes: DataFrame, supplied: str = "supplied", order: str | None = None) -> DataFrame:
    """``changes`` holds new values and an array naming the supplied fields; null can be supplied.

    New patients take all their values from the change. Several changes of one patient make one row: each field has the value of the
    last change by ``order`` that supplies it (of the greatest value where none is last).
    """
    scalars = [c for c in patients.columns if c != "patient_id"]
    known = [c for c in scalars if c in changes.columns]
    at = F.col(order) if order else F.lit(0)
    last = lambda c, given: F.max_by(F.when(given, F.col(c)), F.when(given, F.struct(at, c)))
    ch = changes.groupBy("patient_id").agg(
        F.array_distinct(F.flatten(F.collect_set(supplied))).alias("_set"), *[last(c, F.array_contains(supplied, c)).alias(f"_n_{c}") for c in known],
        *[last(c, F.lit(True)).alias(f"_a_{c}") for c in known])
    j = patients.withColumn("_old", F.lit(True)).join(ch, "patient_id", "full_outer")
    is_new = F.col("_old").isNull()
    pick = lambda c: F.when(F.array_contains("_set", c), F.col(f"_n_{c}")).when(is_new, F.col(f"_a_{c}")).otherwise(F.col(c))
    return j.select("patient_id", *[(pick(c) if c in known else F.col(c)).alias(c) for c in scalars])


def upsert_facts(facts: DataFrame, replaced: DataFrame, new_facts: DataFrame) -> DataFrame:
    """Replace each (patient, kind) list that was supplied; an empty supplied list clears it."""
    return replace_facts(facts, replaced, new_facts, FACT_KINDS)
