"""Match runs in storage: one run per patient, all tables of a batch first, one commit row last."""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.scale import stage
from cohortmill.operators.gaps import BUCKETS, gap_entries, gap_payload, report_entries, review_items
from cohortmill.operators.matching import collapse_groups, pair_results, run_rollup, summaries
from cohortmill.operators.runs import latest_by

PAIR = ["patient_id", "trial_id"]
COMMIT = "batch string, attempt string, committed_at timestamp"


class MatchStore:
    """Tables match_result_criteria, match_results, match_review_items and match_runs below ``root``.

    Each attempt at a batch writes a folder of its own in every table; the row that ``write`` appends to ``commits`` at the end, one
    file, makes all of them visible at once. Readers see of each batch its last committed attempt, so a killed job leaves nothing
    visible and a batch that is run again replaces its own rows only. Uncommitted and replaced folders stay until they are deleted by age.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _put(self, df: DataFrame, name: str, batch: str, attempt: str) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch}/attempt={attempt}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commits(self) -> DataFrame:
        """Last committed attempt of each batch."""
        try:
            log = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = self.spark.createDataFrame([], COMMIT)
        return latest_by(log, ["batch"], [F.col("committed_at"), F.col("attempt")], ["attempt"])

    def read(self, name: str) -> DataFrame:
        """Committed rows; asking before the first commit is an error of the caller."""
        rows = self.spark.read.parquet(f"{self.root}/{name}").drop("batch")
        return rows.join(self.commits(), "attempt", "left_semi").drop("attempt")

    def write(self, batch: str, requests: DataFrame, evaluations: DataFrame, rules: DataFrame, trials: DataFrame,
              at: datetime.datetime | None = None) -> None:
        """Store the evaluations of a batch of requests with results, gap reports, review items and one run per requested patient.

        The evaluations are written first and read back: none is made again and a lost executor costs only its own tasks. Effective rows are
        dealt by pair, where entries and reports meet without another shuffle; counts are taken from them, not from evaluations again, and the
        review items are entries of the stored reports, so nothing is dealt or sorted for them. A patient whose
        requests meet no rule gets a run with zero totals. Run ids are batch and patient, so the same batch gives the same ids.
        """
        at, attempt = at or datetime.datetime.now(), f"a{uuid.uuid4().hex}"
        run = F.concat_ws(":", F.lit(batch), F.col("patient_id").cast("string"))
        result = F.concat_ws(":", run, F.col("trial_id").cast("string"))
        put = lambda df, name: self._put(df, name, batch, attempt)
        tagged = evaluations.withColumn("match_run_id", run).withColumn("match_result_id", result).withColumn(
            "logic_group_id", F.col("group_id")).withColumn("logic_operator", F.when(F.col("group_id").isNotNull(), "OR"))
        stored = put(tagged, "match_result_criteria")
        effective = stage(collapse_groups(stored, rules).drop("run_id", "source_type", "type"))
        report = gap_payload(gap_entries(effective.repartition(*PAIR)))
        lists = [F.coalesce(F.col(b), F.array().cast(report.schema[b].dataType)).alias(b) for b in BUCKETS]
        named = summaries(pair_results(effective, rules), effective, trials)
        results = put(named.join(report, PAIR, "left").select(
            run.alias("match_run_id"), result.alias("match_result_id"), *named.columns, F.struct(*lists).alias("report"), F.lit(at).alias("created_at")), "match_results")
        # A trial that is listed twice has every result of its pairs twice, with one report.
        listed_twice = trials.groupBy("trial_id").count().where("count > 1").limit(1).count() > 0
        reports = results.dropDuplicates(PAIR) if listed_twice else results
        put(review_items(report_entries(reports)).withColumn("match_run_id", run).withColumn("match_result_id", result), "match_review_items")
        asked = requests.select("patient_id").distinct().join(run_rollup(results), "patient_id", "left").fillna(0)
        put(asked.select(run.alias("match_run_id"), "*", F.lit("completed").alias("status"), F.lit(at).alias("created_at"), F.lit(at).alias("completed_at")), "match_runs")
        self.commit(batch, attempt, at)

    def commit(self, batch: str, attempt: str, at: datetime.datetime) -> None:
        self.spark.createDataFrame([(batch, attempt, at)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
