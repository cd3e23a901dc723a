"""Study records: schema, flat snapshot, sites, content hash, sinks and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions import text as T

# Shape of one study record. healthyVolunteers is text: only the word "Yes" accepts volunteers.
STUDY = """protocolSection STRUCT<
  identificationModule: STRUCT<nctId: STRING, briefTitle: STRING, officialTitle: STRING>,
  statusModule: STRUCT<overallStatus: STRING, startDateStruct: STRUCT<date: STRING>, completionDateStruct: STRUCT<date: STRING>,
    primaryCompletionDateStruct: STRUCT<date: STRING>, lastUpdatePostDateStruct: STRUCT<date: STRING>>,
  sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING, class: STRING>>,
  designModule: STRUCT<phases: ARRAY<STRING>, studyType: STRING>,
  conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
  armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<type: STRING, name: STRING, description: STRING>>>,
  eligibilityModule: STRUCT<eligibilityCriteria: STRING, healthyVolunteers: STRING, sex: STRING, minimumAge: STRING,
    maximumAge: STRING, stdAges: ARRAY<STRING>>,
  contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<facility: STRING, city: STRING, state: STRING, country: STRING,
    zip: STRING, status: STRING, geoPoint: STRUCT<lat: DOUBLE, lon: DOUBLE>>>>>"""


def read_studies(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(studies, rejected) from study files: one JSON document per file, or per line with ``lines``.

    Studies keep the raw text beside the record; text that is no JSON object with a protocol section is rejected.
    """
    raw = spark.read.text(path, wholetext=not lines).where(F.length(F.trim("value")) > 0)
    read = raw.select(F.col("value").alias("raw_json"), F.col("_metadata.file_name").alias("file"), F.from_json("value", STUDY).alias("s"))
    fine = F.col("s.protocolSection").isNotNull()
    return read.where(fine).select("raw_json", "s"), read.where(~fine).select("file", "raw_json")


def parse_studies(rows: DataFrame, column: str = "raw_json") -> DataFrame:
    return rows.withColumn("s", F.from_json(column, STUDY))


def record_error() -> Column:
    """Why a record (raw_json, s) can't be ingested; null where it can. A bad record fails alone."""
    nct = F.col("s.protocolSection.identificationModule.nctId")
    return (
        F.when(F.try_parse_json("raw_json").isNull() | ~F.coalesce(F.trim("raw_json").startswith("{"), F.lit(False)), "Record is not a JSON document")
        .when(F.col("s.protocolSection").isNull(), "Record has no protocol section")
        .when(nct.isNull() | (F.length(nct) == 0), "Search result missing NCT ID")
    )


def scan_outcomes(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(nct_id, status, error_message, n): outcomes of all records (raw_json) of a scan; n adds up to the number of records.

    Of several records of one id the one with the greatest content hash counts, the others are superseded; it is skipped
    where ``stored`` (nct_id, content_hash) has that hash. Records that can't be read are counted per error. Everything is an
    aggregate of ids and hashes, so an id that owns a third of all records costs one row a task.
    """
    read = parse_studies(records).withColumn("error_message", record_error()).withColumn("content_hash", study_hash())
    nct = F.col("s.protocolSection.identificationModule.nctId").alias("nct_id")
    failed = read.where("error_message is not null").groupBy("error_message").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("nct_id"), F.lit("failed").alias("status"), "error_message", "n")
    top = read.where("error_message is null").select(nct, "content_hash").groupBy("nct_id").agg(F.max("content_hash").alias("content_hash"), F.count(F.lit(1)).alias("records"))
    known = top.withColumn("known", F.lit(False)) if stored is None else top.join(
        stored.select("nct_id", "content_hash", F.lit(True).alias("known")), ["nct_id", "content_hash"], "left")
    rows = known.select("nct_id", F.explode(F.array(
        F.struct(F.when(F.col("known"), "skipped").otherwise("ingested").alias("status"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit("superseded").alias("status"), (F.col("records") - 1).alias("n")))).alias("o")).where("o.n > 0")
    return rows.select("nct_id", "o.status", F.lit(None).cast("string").alias("error_message"), "o.n").unionByName(failed)


def parse_instant(text: Column) -> Column:
    """Full ISO dates or date-times as UTC instants; partial dates such as 2024-01 are null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def trial_snapshot(studies: DataFrame) -> DataFrame:
    """Flat trial row of each study (raw_json, s) with its content hash."""
    p = lambda path: F.col(f"s.protocolSection.{path}")
    none = F.array().cast("array<string>")
    completion = F.coalesce(
        F.when(F.length(p("statusModule.completionDateStruct.date")) > 0, p("statusModule.completionDateStruct.date")),
        p("statusModule.primaryCompletionDateStruct.date"))
    return studies.select(
        p("identificationModule.nctId").alias("nct_id"),
        F.coalesce(p("identificationModule.briefTitle"), F.lit("")).alias("brief_title"),
        p("identificationModule.officialTitle").alias("official_title"),
        F.coalesce(p("statusModule.overallStatus"), F.lit("UNKNOWN")).alias("status"),
        F.coalesce(F.array_join(p("designModule.phases"), ","), F.lit("")).alias("phase"),
        F.coalesce(p("conditionsModule.conditions"), none).alias("conditions"),
        p("armsInterventionsModule.interventions").alias("interventions"),
        F.coalesce(p("eligibilityModule.eligibilityCriteria"), F.lit("")).alias("eligibility_text"),
        p("eligibilityModule.minimumAge").alias("eligible_min_age"), p("eligibilityModule.maximumAge").alias("eligible_max_age"),
        p("eligibilityModule.sex").alias("eligible_sex"),
        F.coalesce(p("eligibilityModule.healthyVolunteers") == "Yes", F.lit(False)).alias("accepts_healthy"),
        p("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        parse_instant(p("statusModule.startDateStruct.date")).alias("start_date"), parse_instant(completion).alias("completion_date"),
        parse_instant(p("statusModule.lastUpdatePostDateStruct.date")).alias("last_updated"),
        study_hash().alias("content_hash"),
    )


def _norm(c: Column) -> Column:
    return F.lower(T.squeeze(F.coalesce(c.cast("string"), F.lit(""))))


def _whole(path: str) -> Column:
    """A part of the raw record as canonical JSON text (keys in order), squeezed and lower-cased; texts inside are trimmed."""
    text = F.try_variant_get(F.try_parse_json("raw_json"), path, "string")
    return F.regexp_replace(_norm(F.regexp_replace(text, r"(?:\\[nrt])+", " ")), r"(?<=\") | (?=\")", "")


def study_hash() -> Column:
    """SHA-256 of everything that makes a study a new version: squeezed, lower-cased, keys in order.

    Locations, interventions and all eligibility fields without a column of their own count whole, as the raw record has them.
    """
    p = lambda path: F.col(f"s.protocolSection.{path}")
    texts = lambda path: F.transform(F.coalesce(p(path), F.array().cast("array<string>")), _norm)
    fields = F.try_variant_get(F.try_parse_json("raw_json"), "$.protocolSection.eligibilityModule", "map<string,string>")
    others = F.transform(F.array_sort(F.map_entries(F.map_filter(
        F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("eligibilityCriteria", "minimumAge", "maximumAge", "sex", "healthyVolunteers")))),
        lambda e: F.array(e["key"], _norm(e["value"])))
    material = F.struct(
        _norm(p("identificationModule.briefTitle")).alias("brief_title"),
        _norm(F.coalesce(F.when(F.length(p("statusModule.completionDateStruct.date")) > 0, p("statusModule.completionDateStruct.date")),
                         p("statusModule.primaryCompletionDateStruct.date"))).alias("completion_date"),
        texts("conditionsModule.conditions").alias("conditions"), _norm(p("eligibilityModule.eligibilityCriteria")).alias("eligibility_text"),
        _norm(p("eligibilityModule.healthyVolunteers")).alias("healthy_volunteers"),
        _whole("$.protocolSection.armsInterventionsModule.interventions").alias("interventions"),
        _norm(p("statusModule.lastUpdatePostDateStruct.date")).alias("last_updated"),
        _whole("$.protocolSection.contactsLocationsModule.locations").alias("locations"), _norm(p("eligibilityModule.maximumAge")).alias("maximum_age"),
        _norm(p("eligibilityModule.minimumAge")).alias("minimum_age"), _norm(p("identificationModule.officialTitle")).alias("official_title"),
        texts("designModule.phases").alias("phase"), _norm(p("eligibilityModule.sex")).alias("sex"),
        _norm(p("sponsorCollaboratorsModule.leadSponsor.name")).alias("sponsor"), _norm(p("statusModule.startDateStruct.date")).alias("start_date"),
        _norm(p("statusModule.overallStatus")).alias("status"), others.alias("structured_eligibility"))
    return F.sha2(F.to_json(material), 256)


def sites(studies: DataFrame) -> DataFrame:
    """One row per study location."""
    p = "s.protocolSection"
    return studies.select(
        F.col(f"{p}.identificationModule.nctId").alias("nct_id"),
        F.posexplode(f"{p}.contactsLocationsModule.locations").alias("site_no", "l"),
    ).select("nct_id", "site_no", *[F.col(f"l.{c}").alias(c) for c in ("facility", "city", "state", "country", "zip", "status")],
             F.col("l.geoPoint.lat").alias("latitude"), F.col("l.geoPoint.lon").alias("longitude"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One text file per narrative; the file name without its suffix is the key. Spark scans no file of zero bytes, so that has no row."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("fixture"), F.col("value").alias("text"))


def write_criteria(criteria: DataFrame, path: str, run_id: str) -> None:
    """Write one run's criteria, pending exactly where review is required; a rerun replaces them."""
    criteria.withColumn("review_status", F.when(F.col("review_required"), "pending")).withColumn("run_id", F.lit(run_id)).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_batch(criteria: DataFrame, path: str, batch: str) -> None:
    """Write the criteria of many runs (column run_id) as one batch; a rerun of the batch replaces them, and what reads them is to be opened again."""
    pending = criteria.withColumn("review_status", F.when(F.col("review_required"), "pending")).withColumn("batch", F.lit(batch))
    pending.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_documents(resources: DataFrame, path: str, column: str = "resource") -> None:
    """One JSON document per line, without nulls."""
    resources.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


# -------------------------------------------------------------------- validation

def _rules(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in pairs]))


def split_valid(df: DataFrame, pairs: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their violations)."""
    checked = df.withColumn("violations", _rules(pairs))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.length(c) == 0)


def ingest_rules() -> list[tuple[str, Column]]:
    return [("nct_id", ~F.coalesce(F.col("nct_id").rlike(r"^NCT\d{8}$"), F.lit(False)))]


def search_rules() -> list[tuple[str, Column]]:
    given = lambda c: F.coalesce(F.length(T.strip_ws(F.col(c))) > 0, F.lit(False))
    return [("search_field", ~(given("condition") | given("status") | given("phase"))), ("limit", ~F.col("limit").between(1, 100))]


def patient_rules() -> list[tuple[str, Column]]:
    return [("sex", ~F.col("sex").isin("male", "female", "other", "unknown")), ("ecog_status", ~F.col("ecog_status").between(0, 5))]


def fact_rules() -> list[tuple[str, Column]]:
    incomplete = F.exists("coded_concepts", lambda c: F.coalesce(F.length(c["system"]), F.lit(0)) * F.coalesce(F.length(c["code"]), F.lit(0)) == 0)
    return [("description", _blank("description")), ("coded_concepts", incomplete), ("line_of_therapy", F.col("line_of_therapy") < 0)]


def review_rules() -> list[tuple[str, Column]]:
    corrected = F.coalesce(F.size("corrected_fields") > 0, F.lit(False))
    return [
        ("action", ~F.coalesce(F.col("action").isin("accept", "correct", "reject"), F.lit(False))), ("reviewed_by", _blank("reviewed_by")),
        ("corrected_data", (F.col("action") == "correct") != corrected), ("confidence", ~F.col("new_confidence").between(0.0, 1.0)),
    ]
