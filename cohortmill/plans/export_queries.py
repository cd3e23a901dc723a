"""Registered source, export and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortmill.functions import text as T
from cohortmill.functions.scale import stage, work_dir
from cohortmill.operators import export as X
from cohortmill.operators import reports as P
from cohortmill.operators import runs as R
from cohortmill.plans import views as V
from cohortmill.plans.registry import query
from cohortmill.plans.runs_queries import _CUR, _latest
from cohortmill.sources import dictionaries as Dc
from cohortmill.sources import patients as Pt
from cohortmill.sources import studies as St
from cohortmill.streaming import ingest as In

# Study documents written from the trial view; every field is a table value.
_STUDY = """SELECT trial_id, '{"protocolSection":{"identificationModule":{"nctId":"' || nct_id || '","briefTitle":"' || brief_title || '"},"statusModule":{' ||
    CASE WHEN trial_id % 5 = 0 THEN '' ELSE '"overallStatus":"' || status || '",' END || '"startDateStruct":{"date":"' || CASE WHEN trial_id % 3 = 0 THEN '2024-01' ELSE '2023-02-1' || CAST(trial_id % 9 AS STRING) END ||
    '"},"primaryCompletionDateStruct":{"date":"2025-05-0' || CAST(trial_id % 9 + 1 AS STRING) || '"}},"designModule":{"phases":["' || CASE trial_id % 3 WHEN 0 THEN 'PHASE1","PHASE2' ELSE 'PHASE3' END ||
    '"]},"conditionsModule":{"conditions":["' || condition || '"]},"eligibilityModule":{"eligibilityCriteria":"- Age  over ' || CAST(trial_id % 90 AS STRING) || '","healthyVolunteers":' ||
    CASE trial_id % 4 WHEN 0 THEN '"Yes"' WHEN 1 THEN '"No"' WHEN 2 THEN 'true' ELSE 'false' END || ',"sex":"' || eligible_sex || '"},"contactsLocationsModule":{"locations":[{"facility":"Site ' || CAST(trial_id AS STRING) ||
    '","city":"' || brief_title || '","country":"C' || CAST(trial_id % 7 AS STRING) || '","geoPoint":{"lat":' || CAST(trial_id % 90 AS STRING) || '.5,"lon":1.25}},{"facility":"Second","country":"C1"}]}}}' AS raw_json FROM trials"""


def studies(spark, sf):
    V.register(spark, sf)
    return St.parse_studies(spark.sql(f"WITH {V.ctes('trials')} {_STUDY}"))


@query("s1_study_scan", V.oracle("trials", """SELECT nct_id, brief_title, CASE WHEN trial_id % 5 = 0 THEN 'UNKNOWN' ELSE status END AS status, CASE trial_id % 3 WHEN 0 THEN 'PHASE1,PHASE2' ELSE 'PHASE3' END AS phase,
       trial_id % 4 = 0 AS accepts_healthy, CASE WHEN trial_id % 3 <> 0 THEN CAST('2023-02-1' || CAST(trial_id % 9 AS STRING) AS DATE) END AS start_day, CAST('2025-05-0' || CAST(trial_id % 9 + 1 AS STRING) AS DATE) AS completion_day FROM trials"""))
def _(spark, sf):
    return St.trial_snapshot(studies(spark, sf)).select("nct_id", "brief_title", "status", "phase", "accepts_healthy",
                                                       F.col("start_date").cast("date").alias("start_day"), F.col("completion_date").cast("date").alias("completion_day"))


@query("s2_site_rows", V.oracle("trials", """SELECT nct_id, 'Site ' || CAST(trial_id AS STRING) AS facility, brief_title AS city, 'C' || CAST(trial_id % 7 AS STRING) AS country, trial_id % 90 + 0.5 AS latitude FROM trials
       UNION ALL SELECT nct_id, 'Second', NULL, 'C1', NULL FROM trials"""))
def _(spark, sf):
    return St.sites(studies(spark, sf)).select("nct_id", "facility", "city", "country", "latitude")


_LOW = "lower(trim(regexp_replace({}, '\\\\s+', ' ', 'g')))".format


@query("c1_study_hash", V.oracle("trials", f"""SELECT nct_id, sha256('{{"brief_title":"' || {_LOW("brief_title")} || '","completion_date":"2025-05-0' || CAST(trial_id % 9 + 1 AS STRING) || '","conditions":["' || {_LOW("condition")} ||
    '"],"eligibility_text":"- age over ' || CAST(trial_id % 90 AS STRING) || '","healthy_volunteers":"' || CASE trial_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'true' ELSE 'false' END ||
    '","interventions":"","last_updated":"","locations":"' || replace('[{{"city":"' || {_LOW("brief_title")} || '","country":"c' || CAST(trial_id % 7 AS STRING) || '","facility":"site ' || CAST(trial_id AS STRING) ||
    '","geoPoint":{{"lat":' || CAST(trial_id % 90 AS STRING) || '.5,"lon":1.25}}}},{{"country":"c1","facility":"second"}}]', '"', '\\"') ||
    '","maximum_age":"","minimum_age":"","official_title":"","phase":[' || CASE trial_id % 3 WHEN 0 THEN '"phase1","phase2"' ELSE '"phase3"' END || '],"sex":"' || lower(eligible_sex) ||
    '","sponsor":"","start_date":"' || CASE WHEN trial_id % 3 = 0 THEN '2024-01' ELSE '2023-02-1' || CAST(trial_id % 9 AS STRING) END || '","status":"' || CASE WHEN trial_id % 5 = 0 THEN '' ELSE lower(status) END ||
    '","structured_eligibility":[]}}') AS content_hash FROM trials""".replace("geoPoint", "geopoint")))
def _(spark, sf):
    return St.trial_snapshot(studies(spark, sf)).select("nct_id", "content_hash")


@query("c10_incremental_ingest", V.oracle("trials", "SELECT nct_id, brief_title, CASE WHEN trial_id % 5 = 0 THEN 'UNKNOWN' ELSE status END AS status, '- Age  over ' || CAST(trial_id % 90 AS STRING) AS eligibility_text FROM trials"))
def _(spark, sf):
    """Study lines as a stream, ingested until nothing is left, twice: the second run finds the same studies unchanged."""
    return spark.read.parquet(f"{_ingested(spark, sf)}/trials").where("batch_id < 2").select("nct_id", "brief_title", "status", "eligibility_text")


_stores: dict[tuple[str, str], str] = {}


def _ingested(spark, sf):
    """A store, made once per session, after three batches of study lines: all studies, the same again, then those of every third trial in a new form with one site."""
    at = (spark.sparkContext.applicationId, sf)
    if at in _stores:
        return _stores[at]
    base = f"{work_dir(spark)}/ingest/{uuid.uuid4().hex}"
    lines = studies(spark, sf).select("trial_id", F.col("raw_json").alias("value"))
    third = lines.where("trial_id % 3 = 0").withColumn("value", F.regexp_replace("value", r',\{"facility":"Second","country":"C1"\}', ""))
    for rows in (lines, lines, third):
        rows.select("value").write.mode("append").text(f"{base}/in")
        In.start(spark, f"{base}/in", f"{base}/store", f"{base}/checkpoint", lines=True).awaitTermination()
    _stores[at] = f"{base}/store"
    return _stores[at]


@query("c10_ingest_outcomes", V.oracle("trials", """SELECT batch_id, status, count(*) AS n FROM (
       SELECT 0 AS batch_id, 'ingested' AS status FROM trials UNION ALL SELECT 1, 'skipped' FROM trials UNION ALL SELECT 2, 'ingested' FROM trials WHERE trial_id % 3 = 0) GROUP BY ALL"""))
def _(spark, sf):
    """Outcomes by batch, judged against the stream's state."""
    return spark.read.parquet(f"{_ingested(spark, sf)}/outcomes").groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("c10_ingest_runs", V.oracle("trials", """SELECT nct_id, CAST(batch_id AS BIGINT) AS batch_id, nct_id || '-' || CAST(batch_id AS STRING) AS run_id, 'completed' AS status, 1 AS n_criteria
       FROM trials, (SELECT unnest([0, 2]) AS batch_id) WHERE batch_id = 0 OR trial_id % 3 = 0"""))
def _(spark, sf):
    """Run rows of the ingested trials; every narrative of the view is one criterion."""
    return spark.read.parquet(f"{_ingested(spark, sf)}/runs").select("nct_id", F.col("batch_id").cast("long").alias("batch_id"), "run_id", "status", "n_criteria")


@query("s2_site_replacement", V.oracle("trials", """SELECT nct_id, 'Site ' || CAST(trial_id AS STRING) AS facility, brief_title AS city, 'C' || CAST(trial_id % 7 AS STRING) AS country, trial_id % 90 + 0.5 AS latitude FROM trials
       UNION ALL SELECT nct_id, 'Second', NULL, 'C1', NULL FROM trials WHERE trial_id % 3 <> 0"""))
def _(spark, sf):
    """Stored sites after a third of the trials came back with one site less."""
    return In.stored_sites(spark, _ingested(spark, sf)).select("nct_id", "facility", "city", "country", "latitude")


@query("c3_keyed_upsert", V.oracle("trials", """SELECT nct_id, brief_title, CASE WHEN trial_id % 5 = 0 THEN 'UNKNOWN' ELSE status END AS status, CASE WHEN trial_id % 3 = 0 THEN 1 ELSE 2 END AS n_sites FROM trials"""))
def _(spark, sf):
    """Stored trials after the upserts, with the number of their stored sites."""
    store = _ingested(spark, sf)
    n = In.stored_sites(spark, store).groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return In.stored_trials(spark, store).join(n, "nct_id").select("nct_id", "brief_title", "status", "n_sites")


@query("c9_file_scan", V.oracle("trials", """SELECT status, error_message, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT nct_id) AS n_trials FROM (
       SELECT CASE WHEN trial_id % 11 > 1 THEN nct_id END AS nct_id, CASE WHEN trial_id % 11 <= 1 THEN 'failed' WHEN trial_id % 4 = 0 THEN 'skipped' ELSE 'ingested' END AS status,
         CASE trial_id % 11 WHEN 0 THEN 'Record is not a JSON document' WHEN 1 THEN 'Search result missing NCT ID' END AS error_message, 1 AS n FROM trials
       UNION ALL SELECT nct_id, 'superseded', NULL, 1 FROM trials WHERE trial_id % 11 > 1 AND trial_id % 7 = 0
       UNION ALL SELECT NULL, 'failed', 'Record has no protocol section', 1 FROM trials WHERE trial_id % 13 = 0) GROUP BY status, error_message"""))
def _(spark, sf):
    """Outcomes of a scan over written files in which records are cut short, keyless, foreign or repeated; every fourth trial is stored already."""
    lines = studies(spark, sf)
    value = F.when(F.col("trial_id") % 11 == 0, F.expr("left(raw_json, length(raw_json) - 5)")).when(
        F.col("trial_id") % 11 == 1, F.regexp_replace("raw_json", '"nctId":"[^"]*",', "")).otherwise(F.col("raw_json"))
    again = lines.where("trial_id % 11 > 1 and trial_id % 7 = 0").select("raw_json")
    other = lines.where("trial_id % 13 = 0").select(F.lit('{"derivedSection":{}}').alias("raw_json"))
    path = f"{work_dir(spark)}/scan/{uuid.uuid4().hex}"
    lines.select(value.alias("raw_json")).unionByName(again).unionByName(other).write.text(path)
    stored = St.trial_snapshot(lines.where("trial_id % 4 = 0")).select("nct_id", "content_hash")
    out = St.scan_outcomes(spark.read.text(path).select(F.col("value").alias("raw_json")), stored)
    return out.groupBy("status", "error_message").agg(F.sum("n").alias("n"), F.countDistinct("nct_id").alias("n_trials"))


@query("s5_criteria_sink", V.oracle("criteria", "SELECT criterion_id, run AS run_id, CASE WHEN review_required THEN 'pending' END AS review_status FROM criteria, (SELECT unnest(['a', 'b']) AS run)"))
def _(spark, sf):
    """Two runs' criteria, the first written twice."""
    path = f"{work_dir(spark)}/criteria/{uuid.uuid4().hex}"
    for run in ("a", "b", "a"):
        St.write_criteria(V.criteria(spark, sf).select("criterion_id", "review_required"), path, run)
    return spark.read.parquet(path).select("criterion_id", "run_id", "review_status")


_ABBR = """SELECT lower(p_brand) AS abbr, p_name AS expansion, p_partkey AS place FROM part"""


@query("s3_dictionary_last_wins", f"SELECT abbr, arg_max(expansion, place) AS expansion FROM ({_ABBR}) GROUP BY abbr")
def _(spark, sf):
    """Dictionary records from the parts table, read back through the JSON-lines loader."""
    V.register(spark, sf)
    path = f"{work_dir(spark)}/dictionary/{uuid.uuid4().hex}"
    rows = spark.sql(_ABBR).repartitionByRange(1, "place").sortWithinPartitions("place")
    rows.select(F.concat(F.to_json(F.struct("abbr", "expansion")), F.lit("\n# note\n")).alias("value")).write.text(path)
    return Dc.load_abbreviations(spark, path)


_CAT = "old AS (SELECT p_type AS system, p_brand AS code, min(p_name) AS display, min(p_name) AS s1, max(p_name) AS s2 FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2),\nnw AS (SELECT p_type AS system, p_brand AS code, max(p_name) AS display, upper(min(p_name)) AS s1, max(p_name) || ' x' AS s2 FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1, 2)"


@query("s4_catalogue_sync", f"""WITH {_CAT}, m AS (SELECT coalesce(o.system, n.system) AS system, coalesce(o.code, n.code) AS code, coalesce(n.display, o.display) AS display, o.display AS od, n.display AS nd,
  o.s1 AS a, CASE WHEN lower(o.s2) <> lower(o.s1) THEN o.s2 END AS b, n.s1 AS c, n.s2 AS d FROM old o FULL JOIN nw n ON o.system = n.system AND o.code = n.code)
SELECT system, code, display, CASE WHEN od IS NULL THEN 2 WHEN nd IS NULL THEN (CASE WHEN b IS NULL THEN 2 ELSE 2 END) ELSE len(list_distinct(list_filter([lower(a), lower(b), lower(c), lower(d)], lambda x: x IS NOT NULL))) END AS n_synonyms,
  CASE WHEN od IS NULL THEN 'inserted' WHEN nd IS NULL THEN 'kept' ELSE 'updated' END AS change FROM m""")
def _(spark, sf):
    V.register(spark, sf)
    t = lambda n: spark.sql(f"WITH {_CAT} SELECT system, code, display, array(s1, s2) AS synonyms FROM {n}")
    return Dc.sync_catalogue(t("old"), t("nw")).select("system", "code", "display", F.size("synonyms").alias("n_synonyms"), "change")


@query("s8_record_validation", V.oracle("patients", """SELECT patient_id, CASE WHEN sex = 'Female' AND patient_id % 7 = 6 THEN 'ecog_status,sex' WHEN sex = 'Female' THEN 'sex' WHEN patient_id % 7 = 6 THEN 'ecog_status' END AS violations FROM patients
       WHERE sex = 'Female' OR patient_id % 7 = 6"""))
def _(spark, sf):
    p = V.view(spark, sf, "patients").withColumn("ecog_status", F.when(F.col("patient_id") % 7 == 6, 9).otherwise(F.col("ecog_status")))
    return St.split_valid(p, St.patient_rules())[1].select("patient_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


_CHG = "chg AS (SELECT patient_id + CASE WHEN patient_id % 10 = 0 THEN 1000000 ELSE 0 END AS patient_id, 'male' AS sex, CAST(NULL AS INT) AS ecog_status, patient_id % 2 = 0 AS set_sex, patient_id % 3 = 0 AS set_ecog FROM patients WHERE patient_id % 5 = 0)"


@query("s9_patient_upsert", V.oracle_with("patients", _CHG, """SELECT coalesce(p.patient_id, c.patient_id) AS patient_id, CASE WHEN p.patient_id IS NULL OR c.set_sex THEN c.sex ELSE p.sex END AS sex,
       CASE WHEN p.patient_id IS NULL OR c.set_ecog THEN c.ecog_status ELSE p.ecog_status END AS ecog_status FROM patients p FULL JOIN chg c ON p.patient_id = c.patient_id"""))
def _(spark, sf):
    V.register(spark, sf)
    c = spark.sql(f"WITH {V.ctes('patients')},\n{_CHG} SELECT * FROM chg").withColumn(
        "supplied", F.array_compact(F.array(F.when(F.col("set_sex"), "sex"), F.when(F.col("set_ecog"), "ecog_status"))))
    return Pt.upsert_patients(V.view(spark, sf, "patients"), c).select("patient_id", "sex", "ecog_status")


# ---------------------------------------------------------------------- export

def export_criteria(spark, sf):
    c = V.criteria(spark, sf)
    return c.withColumn("parse_status", F.when(F.col("ord") % 5 == 0, "unparsed").otherwise("parsed")).withColumn("negated", F.col("ord") % 2 == 0)


_EXPORTABLE = f"""ord % 5 <> 0 AND category NOT IN ('other', {', '.join(f"'{c}'" for c in X.INTERNAL_CATEGORIES)})
  AND NOT (category = 'concomitant_medication' AND allowance_text IS NOT NULL) AND coalesce(review_status, '') <> 'rejected' AND NOT (review_required AND coalesce(review_status, '') NOT IN ('accepted', 'corrected'))"""
_EXP = f"SELECT * FROM criteria WHERE {_EXPORTABLE}"
_EXP_CURRENT = f"SELECT * FROM cur WHERE {_EXPORTABLE}"


@query("f2_exportable_criteria", V.oracle("criteria", f"SELECT criterion_id, category FROM ({_EXP})"))
def _(spark, sf):
    return X.exportable(export_criteria(spark, sf)).select("criterion_id", "category")


@query("f3_criterion_entries", V.oracle("criteria", f"""SELECT criterion_id, 3 + CASE WHEN operator IS NOT NULL THEN 1 ELSE 0 END + 2 + CASE WHEN value_text IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END
       + CASE WHEN timeframe_operator IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN logic_group_id IS NOT NULL THEN 2 ELSE 0 END AS n_entries FROM ({_EXP})"""))
def _(spark, sf):
    return X.exportable(export_criteria(spark, sf)).select("criterion_id", F.size(X.criterion_entries()).alias("n_entries"))


_STATUS = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STATUS.items()) + " ELSE 'active' END"


_STUDY_COUNTS = V.oracle_with("pipeline_runs trials criteria", _CUR, f"""SELECT nct_id, {_STATUS} AS status, CASE WHEN phase = '' THEN NULL WHEN phase LIKE 'PHASE1%' THEN 'phase-1' ELSE 'phase-3' END AS phase_code,
       (SELECT count(*) FROM ({_EXP_CURRENT}) e WHERE e.trial_id = t.trial_id AND e.type = 'inclusion') AS n_inclusion, (SELECT count(*) FROM ({_EXP_CURRENT}) e WHERE e.trial_id = t.trial_id AND e.type = 'exclusion') AS n_exclusion,
       eligible_min_age AS min_age FROM trials t""")


def _resources(spark, sf):
    """Documents with the criteria of each trial's current run."""
    t = V.view(spark, sf, "trials").withColumn("conditions", F.array("condition"))
    return X.study_resources(t, R.current_criteria(export_criteria(spark, sf), _latest(spark, sf)).drop("latest_run_id"))


def _counted(resources):
    shape = "identifier array<struct<value:string>>, status string, phase struct<coding:array<struct<code:string>>>, extension array<struct<url:string,extension:array<struct<url:string>>>>, enrollment array<struct<minimumAge:string>>"
    d = resources.withColumn("d", F.from_json("resource", shape))
    n = lambda k: F.coalesce(F.size(F.get(F.filter("d.extension", lambda e: e["url"].endswith(k)), 0)["extension"]), F.lit(0))
    return d.select(F.get("d.identifier", 0)["value"].alias("nct_id"), "d.status", F.get("d.phase.coding", 0)["code"].alias("phase_code"), F.greatest(n("/inclusion"), F.lit(0)).alias("n_inclusion"),
                    F.greatest(n("/exclusion"), F.lit(0)).alias("n_exclusion"), F.get("d.enrollment", 0)["minimumAge"].alias("min_age"))


@query("f1_study_resources", _STUDY_COUNTS)
def _(spark, sf):
    return _counted(_resources(spark, sf))


@query("s7_document_sink", _STUDY_COUNTS)
def _(spark, sf):
    """Documents written as text and read back, one per line."""
    path = f"{work_dir(spark)}/documents/{uuid.uuid4().hex}"
    St.write_documents(_resources(spark, sf), path)
    return _counted(spark.read.text(path).select(F.col("value").alias("resource")))


# Medication mentions of therapy criteria; the catalogue of drugs comes from the parts.
_MEDS = """meds AS (SELECT criterion_id, trial_id, type, category, original_text, CASE ord % 4 WHEN 1 THEN value_text || ' small' WHEN 2 THEN value_text || ' medium plus systemic therapy' WHEN 3 THEN value_text || ' standard' ELSE 'platinum-based chemotherapy' END AS vt, exception_entity, timeframe_operator
  FROM criteria WHERE category IN ('prior_therapy', 'concomitant_medication'))"""
_CATN = """cat AS (SELECT CASE system WHEN 'nci' THEN 'rxnorm' WHEN 'mesh' THEN 'nci_thesaurus' ELSE 'snomed_ct' END AS system, code, display, place FROM catalogue)"""


def meds(spark, sf):
    V.table(spark, sf, "criteria").createOrReplaceTempView("criteria_stored")
    m = spark.sql(f"WITH {_MEDS.replace('FROM criteria', 'FROM criteria_stored')} SELECT * FROM meds")
    none = F.array().cast("array<struct<text:string,label:string,start:int,end:int,expanded_text:string>>")
    return m.select("criterion_id", "trial_id", "type", "category", "original_text", F.col("vt").alias("value_text"), F.array_compact(F.array("exception_entity")).alias("exception_entities"),
                    F.lit(None).cast("string").alias("allowance_text"), none.alias("mentions"), "timeframe_operator", F.lit(7.0).alias("timeframe_value"), F.lit("days").alias("timeframe_unit"))


def drug_catalogue(spark, sf):
    V.table(spark, sf, "catalogue").createOrReplaceTempView("catalogue")
    return spark.sql(f"WITH {_CATN} SELECT * FROM cat").withColumn("synonyms", F.array().cast("array<string>"))


_MENTIONED = f"""{_MEDS},
{_CATN},
raw AS (SELECT criterion_id, 0 AS n, vt AS x FROM meds WHERE vt IS NOT NULL UNION ALL SELECT criterion_id, 1, exception_entity FROM meds WHERE exception_entity IS NOT NULL),
parts AS (SELECT criterion_id, n, 0 AS p, trim(split_part(x, ' plus ', 1)) AS x FROM raw UNION ALL SELECT criterion_id, n, 1, trim(split_part(x, ' plus ', 2)) FROM raw WHERE x LIKE '% plus %'),
whole AS (SELECT r.criterion_id, r.n, bool_and(regexp_matches(pp.x, 'therapy') OR pp.x IN (SELECT display FROM cat) OR EXISTS (SELECT 1 FROM cat WHERE system = 'rxnorm' AND contains(' ' || pp.x || ' ', ' ' || cat.display || ' '))) AS ok
  FROM raw r JOIN parts pp USING (criterion_id, n) WHERE r.x LIKE '% plus %' GROUP BY 1, 2),
ment AS (SELECT criterion_id, n, p, x FROM parts LEFT JOIN whole USING (criterion_id, n) WHERE ok IS NULL OR ok UNION ALL SELECT r.criterion_id, r.n, 0, r.x FROM raw r JOIN whole w ON w.criterion_id = r.criterion_id AND w.n = r.n WHERE NOT ok),
fm AS (SELECT * EXCLUDE (rn) FROM (SELECT criterion_id, CAST(n AS BIGINT) * 2147483648 + p AS mention_no, x AS mention_text, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS term,
    row_number() OVER (PARTITION BY criterion_id, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) ORDER BY n, p) AS rn FROM ment) WHERE rn = 1)"""
_HINTS = " OR ".join(f"contains(term, '{h}')" for h in X.CLASS_HINTS)
_PROJ = f"""{_MENTIONED},
rx AS (SELECT display AS term, arg_min(code, place) AS code FROM cat WHERE system = 'rxnorm' GROUP BY 1),
cl AS (SELECT display AS term, arg_min(code, place) AS code, arg_min(system, place) AS system FROM cat WHERE system <> 'rxnorm' GROUP BY 1),
pr AS (SELECT fm.*, CASE WHEN rx.code IS NOT NULL THEN 'rxnorm' ELSE cl.system END AS system, coalesce(rx.code, cl.code) AS code,
    CASE WHEN rx.code IS NOT NULL OR cl.code IS NOT NULL THEN 'projected' WHEN term = 'platinum based chemotherapy' THEN 'blocked_missing_class_code' WHEN {_HINTS} THEN 'review_required_ambiguous_class' ELSE 'blocked_missing_rxnorm' END AS projection_status
  FROM fm LEFT JOIN rx USING (term) LEFT JOIN cl USING (term)),
pj AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY criterion_id, CASE WHEN code IS NULL THEN projection_status || term ELSE system || code END ORDER BY mention_no) AS rn FROM pr) WHERE rn = 1)"""
_CV = "criteria catalogue"


@query("f4_medication_mentions", V.oracle_with(_CV, _MENTIONED, "SELECT criterion_id, mention_no, mention_text, term AS normalized_term FROM fm"))
def _(spark, sf):
    return X.medication_mentions(meds(spark, sf), stage(X.projection_index(drug_catalogue(spark, sf)))).select("criterion_id", "mention_no", "mention_text", "normalized_term")


@query("f5_combination_split", V.oracle_with(_CV, _MENTIONED, "SELECT criterion_id, n AS raw_no, ok AS is_split FROM whole"))
def _(spark, sf):
    index = stage(X.projection_index(drug_catalogue(spark, sf)))
    m = meds(spark, sf).where(F.col("value_text").rlike(T.ci(X.COMBINATION)))
    frag = m.select("criterion_id", F.posexplode(F.split("value_text", T.ci(X.COMBINATION))).alias("part_no", "part"))
    known = X.looks_like_medication(frag, ["criterion_id", "part_no"], "part", index)
    return known.groupBy("criterion_id").agg(F.bool_and("is_medication").alias("is_split")).select("criterion_id", F.lit(0).alias("raw_no"), "is_split")


@query("f6_medication_projection", V.oracle_with(_CV, _PROJ, "SELECT criterion_id, mention_text, projection_status, system, code FROM pj"))
def _(spark, sf):
    return X.project_medications(meds(spark, sf), drug_catalogue(spark, sf)).select("criterion_id", "mention_text", "projection_status", "system", "code")


@query("f7_named_drugs", V.oracle_with(_CV, f"{_MEDS},\n{_CATN}", """SELECT DISTINCT criterion_id, display FROM meds JOIN cat ON cat.system = 'rxnorm' AND contains(' ' || vt || ' ', ' ' || display || ' ')"""))
def _(spark, sf):
    return X.named_drugs(meds(spark, sf), ["criterion_id"], "value_text", X.projection_index(drug_catalogue(spark, sf))).select("criterion_id", "display")


@query("f8_medication_statements", V.oracle_with(_CV, _PROJ, """SELECT pj.criterion_id, pj.code, mention_text AS text, CASE WHEN timeframe_operator IS NOT NULL THEN 'timeframe: ' || timeframe_operator || ' 7 days' END AS timeframe_note,
       'Group/trial-' || CAST(trial_id AS STRING) AS subject FROM pj JOIN meds USING (criterion_id) WHERE pj.code IS NOT NULL"""))
def _(spark, sf):
    m = meds(spark, sf)
    s = X.medication_statements(X.project_medications(m, drug_catalogue(spark, sf)), m)
    j = lambda k: F.get_json_object("resource", f"$.{k}")
    return s.select("criterion_id", "code", j("medicationCodeableConcept.text").alias("text"), j("note[1].text").alias("timeframe_note"), j("subject.reference").alias("subject"))


@query("l7_projection_breakdown", V.oracle_with(_CV, _PROJ, """SELECT 'status' AS dimension, projection_status AS value, count(*) AS n FROM pj GROUP BY 2
       UNION ALL SELECT 'resource_type', CASE WHEN code IS NULL THEN 'none' ELSE 'MedicationStatement' END, count(*) FROM pj GROUP BY 2"""))
def _(spark, sf):
    from cohortmill.operators.listing import projection_breakdown

    return projection_breakdown(X.project_medications(meds(spark, sf), drug_catalogue(spark, sf)))


def _report_inputs(spark, sf):
    c = X._with(export_criteria(spark, sf).withColumn("fixture", F.concat(F.lit("f"), (F.col("trial_id") % 7).cast("string"))))
    crit = c.select("fixture", "category", "review_reason", "review_required", X.exportable_flag().alias("exportable"),
                    (~F.col("review_required") & (F.size("coded_concepts") == 0)).alias("uncoded_accepted"))
    m = meds(spark, sf)
    p = stage(X.project_medications(m, drug_catalogue(spark, sf)).join(
        m.select("criterion_id", F.concat(F.lit("f"), (F.col("trial_id") % 7).cast("string")).alias("fixture"), F.col("category").alias("criterion_category"),
                 F.col("type").alias("criterion_type"), F.col("original_text").alias("criterion_text")), "criterion_id"))
    return crit, p


_REP = f"""{_PROJ},
cr AS (SELECT 'f' || CAST(c.trial_id % 7 AS STRING) AS fixture, c.*, e.criterion_id IS NOT NULL AS exportable FROM criteria c LEFT JOIN ({_EXP}) e USING (criterion_id)),
pf AS (SELECT 'f' || CAST(trial_id % 7 AS STRING) AS fixture, pj.*, category AS criterion_category, type AS criterion_type, original_text AS criterion_text FROM pj JOIN meds USING (criterion_id))"""


@query("p3_corpus_report", V.oracle_with(_CV, _REP, """SELECT a.*, coalesce(n_proj, 0) AS medication_statement_projected_count, coalesce(n_rx, 0) AS blocked_missing_rxnorm_count, coalesce(n_cls, 0) AS blocked_missing_class_code_count,
       coalesce(n_amb, 0) AS review_required_ambiguous_class_count FROM (SELECT fixture, grouping(fixture) AS is_total, count(*) AS criteria_count, count(*) FILTER (WHERE review_required) AS review_required_count,
         count(*) FILTER (WHERE exportable) AS structurally_exportable_count, count(*) FILTER (WHERE NOT review_required AND code IS NULL) AS uncoded_but_accepted_count FROM cr GROUP BY GROUPING SETS ((fixture), ())) a
       LEFT JOIN (SELECT fixture, count(code) AS n_proj, count(*) FILTER (WHERE projection_status = 'blocked_missing_rxnorm') AS n_rx, count(*) FILTER (WHERE projection_status = 'blocked_missing_class_code') AS n_cls,
         count(*) FILTER (WHERE projection_status = 'review_required_ambiguous_class') AS n_amb FROM pf GROUP BY GROUPING SETS ((fixture), ())) b ON a.fixture IS NOT DISTINCT FROM b.fixture"""))
def _(spark, sf):
    return P.corpus_report(*_report_inputs(spark, sf))


@query("p3_corpus_breakdowns", V.oracle_with(_CV, _REP, """SELECT fixture, dimension, value, grouping(fixture) AS is_total, count(*) AS n FROM (SELECT fixture, 'category' AS dimension, category AS value FROM cr
       UNION ALL SELECT fixture, 'review_reason', coalesce(review_reason, 'unspecified') FROM cr WHERE review_required UNION ALL SELECT fixture, 'projection_status', projection_status FROM pf
       UNION ALL SELECT fixture, 'blocked_term', term FROM pf WHERE projection_status = 'blocked_missing_class_code') GROUP BY GROUPING SETS ((fixture, dimension, value), (dimension, value))"""))
def _(spark, sf):
    return P.corpus_breakdowns(*_report_inputs(spark, sf))


_UNRES = "projection_status IN ('blocked_missing_class_code', 'review_required_ambiguous_class')"


@query("p4_terminology_gaps", V.oracle_with(_CV, _REP, f"""SELECT projection_status, term AS normalized_term, CASE projection_status WHEN 'blocked_missing_class_code' THEN 'recognized_class_missing_safe_code' ELSE 'ambiguous_class_no_safe_code' END AS terminology_status,
       count(*) AS occurrence_count, count(DISTINCT fixture) AS fixture_count FROM pf WHERE {_UNRES} GROUP BY 1, 2"""))
def _(spark, sf):
    return P.terminology_gaps(_report_inputs(spark, sf)[1])


@query("p4_gap_breakdown", V.oracle_with(_CV, _REP, f"""SELECT projection_status, term AS normalized_term, dimension, value, count(*) AS n FROM (SELECT *, 'category' AS dimension, criterion_category AS value FROM pf
       UNION ALL SELECT *, 'type', criterion_type FROM pf) WHERE {_UNRES} GROUP BY ALL"""))
def _(spark, sf):
    return P.terminology_gap_breakdown(_report_inputs(spark, sf)[1])


@query("p4_gap_examples", V.oracle_with(_CV, _REP, f"""SELECT * FROM (SELECT projection_status, term AS normalized_term, fixture, criterion_type, criterion_category, mention_text, criterion_text,
       row_number() OVER (PARTITION BY projection_status, term ORDER BY fixture, criterion_type, criterion_category, mention_text, criterion_text) AS place FROM (SELECT DISTINCT projection_status, term, fixture, criterion_type,
         criterion_category, mention_text, criterion_text FROM pf WHERE {_UNRES})) WHERE place <= 3"""))
def _(spark, sf):
    return P.terminology_gap_examples(_report_inputs(spark, sf)[1])
