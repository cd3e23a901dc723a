"""Eligibility-shaped views derived from the given tables, in SQL both engines can run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.scale import work_dir
from cohortmill.functions.ship import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
AS_OF = "2024-06-30"

VIEWS: dict[str, str] = {}

VIEWS["patients"] = """
  SELECT c_custkey AS patient_id,
    CASE c_custkey % 5 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'Female' WHEN 3 THEN 'other' END AS sex,
    CASE WHEN c_custkey % 11 = 0 THEN NULL
         ELSE CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 29000 AS INT) AS DATE) END AS birth_date,
    CASE WHEN c_custkey % 7 < 5 THEN CAST(c_custkey % 7 AS INT) END AS ecog_status,
    CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_healthy_volunteer,
    CASE c_custkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN TRUE END AS can_consent,
    CASE c_custkey % 8 WHEN 0 THEN FALSE WHEN 5 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END AS protocol_compliant,
    CASE WHEN c_custkey % 9 = 0 THEN TRUE WHEN c_custkey % 9 < 8 THEN FALSE END AS claustrophobic,
    CASE WHEN c_custkey % 10 = 0 THEN TRUE WHEN c_custkey % 10 < 9 THEN FALSE END AS motion_intolerant,
    CASE WHEN c_custkey % 6 = 0 THEN TRUE WHEN c_custkey % 6 < 5 THEN FALSE END AS pregnant,
    CASE WHEN c_custkey % 12 = 0 THEN TRUE WHEN c_custkey % 12 < 10 THEN FALSE END AS mr_device_present
  FROM customer"""
VIEWS["trials"] = """
  SELECT p_partkey AS trial_id, 'NCT' || lpad(CAST(p_partkey AS STRING), 8, '0') AS nct_id,
    p_name AS brief_title, p_type AS condition,
    CASE p_partkey % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'TERMINATED' ELSE 'RECRUITING' END AS status,
    CASE p_partkey % 3 WHEN 0 THEN 'PHASE1,PHASE2' WHEN 1 THEN 'PHASE3' ELSE '' END AS phase,
    CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size % 40 + 10 AS STRING) || ' Years' END AS eligible_min_age,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 30 + 50 AS STRING) || ' Years' END AS eligible_max_age,
    CASE p_partkey % 3 WHEN 0 THEN 'ALL' WHEN 1 THEN 'FEMALE' ELSE 'MALE' END AS eligible_sex,
    p_partkey % 2 = 0 AS accepts_healthy,
    DATE '2020-01-01' + CAST(p_partkey % 500 AS INT) AS ingested_at
  FROM part"""
VIEWS["pipeline_runs"] = """
  SELECT o_orderkey AS run_id, o_orderkey % (SELECT count(*) FROM part) AS trial_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
    o_orderdate AS started_at,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS finished_at
  FROM orders"""
# Lines with one row per (order, line number); the raw table repeats some of these keys.
VIEWS["lines"] = """
  SELECT l_orderkey AS ok, l_linenumber AS ln, CAST(min(l_quantity) AS INT) AS q, min(l_discount) AS disc,
    min(l_tax) AS tax, min(p_name) AS nm, min(p_partkey) AS pk,
    (CAST(min(l_quantity) AS INT) + l_linenumber) % 16 AS k
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber"""
# The same view dealt by its key first: the least of a text is found by sorting, which is of little use before the rows of a key are together.
_SPARK_LINES = VIEWS["lines"].replace(
    "FROM lineitem JOIN part ON p_partkey = l_partkey",
    "FROM (SELECT /*+ REPARTITION(l_orderkey, l_linenumber) */ * FROM lineitem JOIN part ON p_partkey = l_partkey) AS dealt")
VIEWS["criteria"] = """
  SELECT ok * 10 + ln AS criterion_id, ok AS run_id, ok % (SELECT count(*) FROM part) AS trial_id,
    CAST(ln AS BIGINT) AS ord,
    CASE WHEN disc < 0.05 THEN 'inclusion' ELSE 'exclusion' END AS type,
    CASE k WHEN 0 THEN 'lab_value' WHEN 1 THEN 'performance_status' WHEN 2 THEN 'diagnosis' WHEN 3 THEN 'age'
      WHEN 4 THEN 'administrative_requirement' WHEN 5 THEN 'procedural_requirement' WHEN 6 THEN 'prior_therapy'
      WHEN 7 THEN 'line_of_therapy' WHEN 8 THEN 'concomitant_medication' WHEN 9 THEN 'biomarker' WHEN 10 THEN 'sex'
      WHEN 11 THEN 'reproductive_status' WHEN 12 THEN 'molecular_alteration' WHEN 13 THEN 'disease_status'
      WHEN 14 THEN 'other' ELSE 'organ_function' END AS category,
    CASE q % 6 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' WHEN 2 THEN 'range' WHEN 3 THEN 'between' WHEN 4 THEN 'gt' END AS operator,
    CASE k WHEN 1 THEN CAST(q % 4 AS DOUBLE) WHEN 7 THEN CAST(q % 3 AS DOUBLE) ELSE CAST(q AS DOUBLE) END AS value_low,
    CASE k WHEN 1 THEN CAST(q % 4 + 1 AS DOUBLE) WHEN 7 THEN CAST(q % 3 + 1 AS DOUBLE) ELSE CAST(q + 20 AS DOUBLE) END AS value_high,
    CASE WHEN k = 0 THEN CASE ln % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN 'LOW' ELSE '4-NOT' END
         WHEN k = 4 THEN CASE ln % 4 WHEN 0 THEN 'can_consent:true' WHEN 1 THEN 'protocol_compliant: False' WHEN 2 THEN 'unknown_flag:true' ELSE 'no flag' END
         WHEN k = 10 THEN CASE ln % 3 WHEN 0 THEN 'Female patients' WHEN 1 THEN 'male' ELSE 'any sex' END
         WHEN k = 11 THEN CASE ln % 2 WHEN 0 THEN 'pregnant:true' ELSE 'pregnant:false' END
         WHEN ln % 4 = 0 THEN split_part(nm, ' ', 2)
         WHEN ln % 7 = 5 THEN NULL
         ELSE nm END AS value_text,
    'Patient with ' || nm || ' at step ' || CAST(ln % 3 AS STRING) AS original_text,
    CASE WHEN tax < 0.02 THEN 'pending' WHEN tax < 0.03 THEN 'rejected' WHEN tax < 0.05 THEN 'accepted' END AS review_status,
    tax < 0.02 AS review_required,
    CASE WHEN tax < 0.02 AND ln % 3 = 0 THEN 'fuzzy_match' WHEN tax < 0.02 AND ln % 3 = 1 THEN 'complex_criteria' END AS review_reason,
    tax * 12 AS confidence,
    CASE WHEN ln % 3 = 0 THEN ok ELSE CASE WHEN ok % 5 = 0 AND ln < 3 THEN ok + 1 END END AS logic_group_id,
    CASE WHEN ln % 3 = 0 OR (ok % 5 = 0 AND ln < 3) THEN 'OR' ELSE 'AND' END AS logic_operator,
    CASE WHEN k IN (2, 6, 8, 9, 12) AND ln % 2 = 0 THEN 'MeSH' END AS code_system,
    CASE WHEN k IN (2, 6, 8, 9, 12) AND ln % 2 = 0 THEN CAST(pk % 40 AS STRING) END AS code,
    CASE WHEN k = 8 AND ln % 3 = 0 THEN split_part(nm, ' ', 2) END AS exception_entity,
    CASE WHEN k = 8 AND ln % 3 = 1 THEN CASE WHEN ok % 2 = 0 THEN 'Physiologic replacement doses' ELSE nm || ' dose' END END AS allowance_text,
    CASE WHEN k = 8 AND ln % 3 = 2 THEN 'within' END AS timeframe_operator
  FROM lines"""
VIEWS["facts"] = """
  SELECT DISTINCT o_custkey AS patient_id, 'condition' AS kind, nm AS description, 'mesh' AS code_system,
    CAST(pk % 40 AS STRING) AS code, CAST(NULL AS DOUBLE) AS value_numeric, CAST(NULL AS INT) AS line_of_therapy,
    CAST(NULL AS BOOLEAN) AS active
  FROM orders JOIN lines ON ok = o_orderkey WHERE ln = 1
  UNION ALL
  SELECT o_custkey, 'lab', o_orderpriority, NULL, NULL,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 5000 END, NULL, NULL FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL
  SELECT o_custkey, 'therapy', nm, 'mesh', CAST(pk % 40 AS STRING), NULL,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 4 AS INT) END, NULL
  FROM orders JOIN lines ON ok = o_orderkey WHERE ln = 2 AND o_orderkey % 2 = 0
  UNION ALL
  SELECT o_custkey, 'biomarker', nm, 'mesh', CAST(pk % 40 AS STRING), NULL, NULL, NULL
  FROM orders JOIN lines ON ok = o_orderkey WHERE ln = 3 AND o_orderkey % 3 = 0
  UNION ALL
  SELECT o_custkey, 'medication', nm || CASE WHEN o_orderkey % 3 = 0 THEN ' Maintenance' ELSE '' END, 'mesh',
    CAST(pk % 40 AS STRING), NULL, NULL, o_orderkey % 5 <> 0
  FROM orders JOIN lines ON ok = o_orderkey WHERE ln = 4 AND o_orderkey % 3 <> 1"""
VIEWS["requests"] = """
  SELECT DISTINCT o_custkey AS patient_id, l_partkey AS trial_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
# One match run per order; results of a run are its lines, with counts and states from line values.
VIEWS["match_runs"] = """
  SELECT o_orderkey AS match_run_id, o_custkey AS patient_id,
    CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status,
    o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAY AS completed_at
  FROM orders"""
VIEWS["match_results"] = """
  SELECT ok * 10 + ln AS match_result_id, ok AS match_run_id, o_custkey AS patient_id, pk AS trial_id,
    CASE WHEN q % 3 = 0 THEN 'ineligible' WHEN q % 3 = 1 THEN 'possible' ELSE 'eligible' END AS overall_status,
    CASE WHEN tax < 0.02 THEN 'review_required' WHEN tax < 0.03 THEN 'blocked_unsupported'
         WHEN tax < 0.05 THEN 'structured_low_confidence' ELSE 'structured_safe' END AS state,
    CASE WHEN tax < 0.02 THEN 'review_required' WHEN tax < 0.03 THEN 'blocked_unsupported'
         WHEN tax < 0.05 AND ln % 2 = 0 THEN 'low_confidence' END AS state_reason,
    q % 4 AS favorable_count, q % 3 AS unfavorable_count, ln % 3 AS unknown_count,
    CASE WHEN ln % 5 = 0 THEN 1 ELSE 0 END AS requires_review_count,
    q % 2 = 0 AS has_report, o_orderdate AS created_at
  FROM lines JOIN orders ON o_orderkey = ok"""
VIEWS["result_criteria"] = """
  SELECT ok * 10 + ln AS match_result_id, CAST(j AS BIGINT) AS ord,
    CASE WHEN disc < 0.05 THEN 'inclusion' ELSE 'exclusion' END AS criterion_type,
    CASE (q + j * ln) % 4 WHEN 0 THEN 'lab_value' WHEN 1 THEN 'age' WHEN 2 THEN 'concomitant_medication' ELSE 'lab_value' END AS category,
    nm || ' step ' || CAST((q + j) % 3 AS STRING) AS criterion_text,
    CASE (q + j) % 4 WHEN 0 THEN CASE WHEN disc < 0.05 THEN 'matched' ELSE 'triggered' END WHEN 1 THEN 'unknown'
      WHEN 2 THEN CASE WHEN disc < 0.05 THEN 'not_matched' ELSE 'not_triggered' END ELSE 'requires_review' END AS outcome,
    CASE (q + 2 * j) % 5 WHEN 0 THEN 'review_required' WHEN 1 THEN 'blocked_unsupported' WHEN 2 THEN 'structured_low_confidence' ELSE 'structured_safe' END AS state,
    CASE (q + 2 * j) % 5 WHEN 0 THEN 'review_required:fuzzy_match' WHEN 1 THEN 'rejected' WHEN 2 THEN 'low_confidence' END AS state_reason,
    (q + j) % 5 = 0 AS missing,
    CASE WHEN ln % 2 = 0 THEN ok END AS logic_group_id, CASE WHEN ln % 2 = 0 AND ok % 3 <> 0 THEN 'OR' ELSE 'AND' END AS logic_operator,
    CASE WHEN j = 0 THEN 'structured' ELSE 'extracted' END AS source_type,
    CASE (q + j) % 6 WHEN 0 THEN '{"review_reason": "fuzzy_match", "review_status": "pending"}'
      WHEN 1 THEN '{"review_status": "rejected"}' WHEN 2 THEN '{"review_status": "accepted"}'
      WHEN 3 THEN '{"review_reason": ""}' WHEN 4 THEN 'not json' END AS evidence_payload
  FROM lines, (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) AS steps"""
VIEWS["decisions"] = """
  SELECT criterion_id,
    CASE ord % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' ELSE 'reject' END AS action,
    'reviewer ' || CAST(run_id % 7 AS STRING) AS reviewed_by, value_low + 1 AS new_value_low
  FROM criteria WHERE run_id % 2 = 0"""
VIEWS["coding_lookups"] = """
  SELECT p_type AS system, CAST(p_partkey AS STRING) AS code, p_name || ' ' || lower(p_type) AS display,
    lower(p_brand) AS synonym FROM part"""

_NEEDS = {
    "criteria": ["lines"], "facts": ["lines"], "match_results": ["lines"], "result_criteria": ["lines"],
    "decisions": ["lines", "criteria"], "narrative_lines": ["lines"], "narratives": ["lines", "narrative_lines"],
    "items": ["lines", "narrative_lines"], "mentions": ["lines"],
}


def needs(*names: str) -> list[str]:
    out: list[str] = []
    for n in names:
        for dep in [*_NEEDS.get(n, []), n]:
            if dep not in out:
                out.append(dep)
    return out


def ctes(*names: str, spark: bool = False) -> str:
    """"name AS (...)" list with dependencies first; prefix with WITH."""
    own = {"lines": _SPARK_LINES, "narratives": _SPARK_NARRATIVES} if spark else {}
    return ",\n".join(f"{n} AS ({own.get(n, VIEWS[n])})" for n in needs(*names))


def oracle(names: str, body: str) -> str:
    return f"WITH {ctes(*names.split())}\n{body}"


def oracle_with(names: str, more: str, body: str) -> str:
    return f"WITH {ctes(*names.split())},\n{more}\n{body}"


def register(spark: SparkSession, sf_dir: str) -> None:
    ship(spark)
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"WITH {ctes(name, spark=True)} SELECT * FROM {name}")


_STORED: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a stored table, written once per session.

    The given tables hold no clinical data; the views stand in for tables a user would already have.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = f"{work_dir(spark)}/views/{uuid.uuid4().hex}"
        view(spark, sf_dir, name).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "criteria")
    empty = F.array().cast("array<struct<system:string,code:string,display:string,match_type:string>>")
    none = F.lit(None).cast("string")
    concept = F.array(F.struct(F.col("code_system").alias("system"), F.col("code"), none.alias("display"), none.alias("match_type")))
    return c.withColumn("coded_concepts", F.when(F.col("code").isNotNull(), concept).otherwise(empty)).withColumn(
        "exception_entities", F.array_compact(F.array("exception_entity"))).withColumn(
        "logic_group_id", F.col("logic_group_id").cast("string"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts")
    none = F.lit(None).cast("string")
    concept = F.array(F.struct(F.col("code_system").alias("system"), F.col("code"), none.alias("display"), none.alias("match_type")))
    return f.withColumn("coded_concepts", F.when(F.col("code").isNotNull(), concept))


# Eligibility sentences with table values in them: one sentence per (order, line).
VIEWS["narrative_lines"] = """
  SELECT ok, ln, CASE (q * 7 + ln * 5 + ok) % 34
    WHEN 0 THEN 'Age >= ' || CAST(q AS STRING) || ' years'
    WHEN 1 THEN 'ANC >= ' || CAST(q AS STRING) || '.5 x 10⁹/L'
    WHEN 2 THEN 'Hemoglobin ' || CAST(q AS STRING) || '-' || CAST(q + 20 AS STRING) || ' g/dL.'
    WHEN 3 THEN 'Serum creatinine <= ' || CAST(q AS STRING) || '.0 ULN'
    WHEN 4 THEN 'ECOG performance status 0 to ' || CAST(q % 4 AS STRING)
    WHEN 5 THEN 'Patients must be at least ' || CAST(q AS STRING) || ' years old.'
    WHEN 6 THEN 'Prior treatment with ' || drug || ' within ' || CAST(q AS STRING) || ' weeks'
    WHEN 7 THEN 'No prior ' || drug || ' therapy, unless stopped more than ' || CAST(q AS STRING) || ' months ago'
    WHEN 8 THEN 'Histologically confirmed ' || disease
    WHEN 9 THEN '* Has active ' || disease || ' or hiv infection'
    WHEN 10 THEN 'EGFR mutation positive or ALK rearrangement positive'
    WHEN 11 THEN 'Female patients only'
    WHEN 12 THEN 'Willing and able to provide informed consent'
    WHEN 13 THEN 'Pregnant or breastfeeding women'
    WHEN 14 THEN 'Has a pacemaker or metallic implant'
    WHEN 15 THEN 'Claustrophobia precluding imaging'
    WHEN 16 THEN 'Systemic corticosteroids are excluded except for physiologic replacement doses of prednisone.'
    WHEN 17 THEN 'Concurrent use of strong CYP3A4 inhibitors (except for systemic itraconazole, ketoconazole, or voriconazole)'
    WHEN 18 THEN 'Has received a live vaccine within ' || CAST(q AS STRING) || ' days before the first dose'
    WHEN 19 THEN 'Stage III or IV unresectable ' || disease
    WHEN 20 THEN 'Must have adequate renal function' || CASE WHEN q % 2 = 0 THEN ' as determined by the investigator' ELSE '' END
    WHEN 21 THEN 'Known hypersensitivity to study drug'
    WHEN 22 THEN 'Documented disease progression after receiving ' || drug || ' and at least ' || CAST(q AS STRING) || ' cycles (oral and iv) of cisplatin'
    WHEN 23 THEN 'Have received at least ' || CAST(q AS STRING) || ' targeted therapies, including disease progression after receiving at least 1 ' || drug
    WHEN 24 THEN 'Has a diagnosis of ' || disease || ' or is receiving systemic steroid therapy or corticosteroids within ' || CAST(q AS STRING) || ' days'
    WHEN 25 THEN 'Advanced solid tumors of the following types: melanoma, sarcoma (bone, soft tissue), or lymphoma, who have failed ' || drug
    WHEN 26 THEN 'Tumor tissue or plasma tested by IHC or next-generation sequencing'
    WHEN 27 THEN 'Must not have ' || disease || ' since ' || CAST(q AS STRING) || ' weeks'
    WHEN 28 THEN 'A ' || nm || ' of unclear relevance, number ' || CAST(q AS STRING)
    WHEN 29 THEN 'Failed at least ' || CAST(q AS STRING) || ' prior line of systemic therapy'
    WHEN 30 THEN 'Has received PD-1/PD-L1 inhibitor therapy or KRAS inhibitor'
    WHEN 31 THEN 'Recovered from major surgery for no more than ' || CAST(q AS STRING) || ' days prior to ' || CAST(q + 1 AS STRING) || ' weeks'
    WHEN 32 THEN 'Squamous ' || disease || ' not limited to non-small cell, absence of ' || nm
    ELSE 'The main inclusion criteria include but are not limited to the following:' END AS text
  FROM (SELECT *, CASE ok % 5 WHEN 0 THEN 'breast cancer' WHEN 1 THEN 'NSCLC' WHEN 2 THEN 'melanoma' WHEN 3 THEN 'brain metastases' ELSE 'inflammatory bowel disease' END AS disease,
      CASE pk % 4 WHEN 0 THEN 'trastuzumab' WHEN 1 THEN 'paclitaxel' WHEN 2 THEN 'chemotherapy' ELSE 'pembrolizumab' END AS drug FROM lines) AS named"""
_MARKED = """SELECT ok, CAST(ln AS INT) * 2 AS place, CASE ln % 5 WHEN 0 THEN CAST(ln AS STRING) || '. ' WHEN 1 THEN '- ' WHEN 2 THEN '   ' WHEN 3 THEN '' ELSE CAST(ln AS STRING) || ') ' END
      || text AS line FROM narrative_lines
    UNION ALL SELECT DISTINCT ok, 0, 'Inclusion Criteria:' FROM narrative_lines WHERE ok % 4 <> 0
    UNION ALL SELECT DISTINCT ok, 7, '  exclusion criteria ' FROM narrative_lines WHERE ok % 4 = 1
    UNION ALL SELECT DISTINCT ok, 9, CASE WHEN ok % 3 = 0 THEN '2.' ELSE '' END FROM narrative_lines"""
VIEWS["narratives"] = f"SELECT ok AS doc_id, string_agg(line, chr(10) ORDER BY place, line) AS text FROM ({_MARKED}) AS marked GROUP BY ok"
# The same view where ordered string aggregation is written differently.
_SPARK_NARRATIVES = f"SELECT ok AS doc_id, listagg(line, chr(10)) WITHIN GROUP (ORDER BY place, line) AS text FROM ({_MARKED}) AS marked GROUP BY ok"
VIEWS["items"] = "SELECT ok * 10 + ln AS item_id, text FROM narrative_lines"
VIEWS["mentions"] = """
  SELECT ok * 10 + ln AS mention_id, ok AS criterion_id, CAST(ln AS INT) AS mention_no,
    CASE ln % 3 WHEN 0 THEN 'DISEASE' WHEN 1 THEN 'DRUG' ELSE 'OTHER' END AS label,
    CASE ok % 7 WHEN 0 THEN upper(nm) || ' ' || p_type WHEN 1 THEN p_brand WHEN 2 THEN substr(nm, 1, length(nm) - 1) || ' ' || lower(p_type)
      WHEN 3 THEN nm || ' (A1) ' || lower(p_type) WHEN 4 THEN 'non ' || nm || ' ' || lower(p_type)
      WHEN 5 THEN nm || '/' || lower(p_type) ELSE CASE WHEN ok % 2 = 0 THEN nm || ' x' || substr(lower(p_type), 2, length(p_type) - 2) || 'x' ELSE 'unheard ' || CAST(q AS STRING) END END AS text,
    ok % 3 <> 1 AS fuzzy
  FROM lines JOIN part ON p_partkey = pk"""
VIEWS["catalogue"] = """
  SELECT CASE p_type WHEN 'ECONOMY' THEN 'mesh' WHEN 'PROMO' THEN 'nci' WHEN 'STANDARD' THEN 'mesh' WHEN 'LARGE' THEN 'snomed' ELSE 'nci' END AS system,
    CAST(p_partkey AS STRING) AS code, p_name || ' ' || lower(p_type) AS display, lower(p_brand) AS syn1,
    p_name || '+' || CAST(p_size AS STRING) AS syn2, p_partkey AS place
  FROM part"""
CODE_SYSTEMS = {"DISEASE": ["nci", "mesh"], "DRUG": ["snomed", "nci"]}
