"""Tagging phrases, abbreviations and the terminology catalogue: loading and default content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default tagging phrases by label and kind. "exact" phrases keep their case, "lower" phrases match in any case with
# single spaces, "loose" phrases also ignore punctuation between words.
PHRASES: dict[tuple[str, str], list[str]] = {
    ("DISEASE", "lower"): [
        "breast cancer",
        "breast carcinoma",
        "invasive ductal breast carcinoma",
        "lobular breast carcinoma",
        "lung cancer",
        "prostate cancer",
        "colorectal cancer",
        "pancreatic cancer",
        "gastrointestinal cancer",
        "gastrointestinal adenocarcinoma",
        "gastrointestinal adenocarcinomas",
        "gastrointestinal squamous cell carcinoma",
        "bladder cancer",
        "renal cell carcinoma",
        "soft tissue sarcoma",
        "advanced solid tumor",
        "advanced solid tumors",
        "advanced solid tumour",
        "advanced solid tumours",
        "other advanced solid tumor",
        "other advanced solid tumors",
        "other advanced solid tumour",
        "other advanced solid tumours",
        "solid tumor",
        "solid tumors",
        "solid tumour",
        "solid tumours",
        "ovarian cancer",
        "brain metastases",
        "brain metastasis",
        "cns disease",
        "active cns metastases",
        "active cns metastasis",
        "cns metastases",
        "cns metastasis",
        "active central nervous system metastases",
        "active central nervous system metastasis",
        "central nervous system metastases",
        "central nervous system metastasis",
        "hiv infection",
        "human immunodeficiency virus",
        "active infection",
        "inflammatory bowel disease",
        "cardiovascular disorder",
        "cardiovascular disease",
        "cerebrovascular disease",
        "cerebrovascular disorder",
        "clinically severe pulmonary compromise",
        "severe pulmonary compromise",
        "pulmonary illness",
        "pulmonary illnesses",
        "uncontrolled infection",
        "diabetes",
        "connective tissue disease",
        "connective tissue diseases",
        "primary brain tumor",
        "primary brain tumors",
        "primary brain tumour",
        "primary brain tumours",
        "primary cns tumor",
        "primary cns tumors",
        "primary cns tumour",
        "primary cns tumours",
        "second malignancy",
        "additional malignancy",
        "concurrent malignancy",
        "interstitial lung disease",
        "leptomeningeal disease",
        "carcinomatous meningitis",
        "corneal disease",
        "dry eye syndrome",
        "meibomian gland disease",
        "meibomian gland dysfunction",
        "kaposi sarcoma",
        "castleman disease",
        "multicentric castleman disease",
        "small cell lung cancer",
        "small cell lung carcinoma",
    ],
    ("DISEASE", "exact"): [
        "melanoma",
        "lymphoma",
        "leukemia",
        "sarcoma",
        "glioblastoma",
        "mesothelioma",
        "myeloma",
        "HIV",
        "immunodeficiency",
        "pneumonitis",
        "blepharitis",
        "Kaposi's sarcoma",
        "Castleman's disease",
        "Multicentric Castleman's Disease",
        "NSCLC",
        "SCLC",
        "TNBC",
    ],
    ("DISEASE", "loose"): [
        "active central nervous system cns metastases",
        "active central nervous system cns metastasis",
        "active central nervous system metastases",
        "active central nervous system metastasis",
        "central nervous system cns metastases",
        "central nervous system cns metastasis",
        "central nervous system metastases",
        "central nervous system metastasis",
        "non small cell lung cancer",
        "non small cell lung carcinoma",
    ],
    ("DRUG", "exact"): [
        "trastuzumab",
        "pertuzumab",
        "lapatinib",
        "pembrolizumab",
        "nivolumab",
        "atezolizumab",
        "durvalumab",
        "ipilimumab",
        "bevacizumab",
        "rituximab",
        "cetuximab",
        "paclitaxel",
        "docetaxel",
        "carboplatin",
        "cisplatin",
        "doxorubicin",
        "cyclophosphamide",
        "methotrexate",
        "chemotherapy",
        "platinum-based chemotherapy",
        "immunotherapy",
        "live vaccine",
        "live-attenuated vaccine",
        "live or live-attenuated vaccine",
        "PD-1 therapy",
        "PD-L1 therapy",
        "PD-1/PD-L1 therapy",
        "PD-1/PD-L1 inhibitor therapy",
        "corticosteroids",
        "steroids",
        "itraconazole",
        "ketoconazole",
        "posaconazole",
        "voriconazole",
        "prednisone",
        "dexamethasone",
        "methylprednisolone",
        "prednisolone",
    ],
    ("DRUG", "lower"): [
        "agent targeting kras",
        "kras inhibitor",
        "systemic corticosteroids",
        "systemic steroids",
    ],
    ("DRUG", "loose"): [
        "programmed cell death protein 1 1 therapy",
        "programmed cell death protein 1 pd 1 therapy",
        "programmed cell death protein 1 pd therapy",
        "programmed cell death protein 1 therapy",
        "programmed death ligand 1 l1 therapy",
        "programmed death ligand 1 pd l1 therapy",
        "programmed death ligand 1 pd therapy",
        "programmed death ligand 1 therapy",
        "kras targeted therapy",
    ],
    ("BIOMARKER", "exact"): [
        "HER2",
        "HER-2",
        "PD-L1",
        "EGFR",
        "ALK",
        "BRCA1",
        "BRCA2",
        "BRAF",
        "KRAS",
        "ROS1",
        "NTRK",
        "MSI",
        "TMB",
    ],
    ("BIOMARKER", "lower"): [
        "her2 positive",
        "her2 negative",
    ],
    ("LAB_TEST", "exact"): [
        "ANC",
        "ALT",
        "AST",
        "CrCl",
        "hemoglobin",
        "platelet",
        "bilirubin",
        "creatinine",
        "INR",
        "GFR",
        "WBC",
    ],
    ("PROCEDURE", "lower"): [
        "archival tumor tissue",
        "archival tumor tissue sample",
        "provided tissue",
        "newly obtained biopsy",
        "major surgery",
        "surgical complications",
        "informed consent",
        "written informed consent",
        "protocol compliance",
        "mr safety questionnaire",
        "mri safety questionnaire",
        "claustrophobia",
        "motion intolerance",
        "pacemaker",
        "implantable device",
    ],
    ("PROCEDURE", "exact"): [
        "biopsy",
    ],
    ("PERF_SCALE", "exact"): [
        "ECOG",
        "Karnofsky",
        "KPS",
    ],
    ("PERF_SCALE", "lower"): [
        "ecog performance status",
    ],
}

# Default abbreviations (lower case) and their expansions.
ABBREVIATIONS: dict[str, str] = {
    "tnbc": "Triple Negative Breast Cancer",
    "nsclc": "Non-Small Cell Lung Cancer",
    "sclc": "Small Cell Lung Cancer",
    "mcrpc": "Metastatic Castration-Resistant Prostate Cancer",
    "her2": "Human Epidermal Growth Factor Receptor 2",
    "egfr": "Epidermal Growth Factor Receptor",
    "alk": "Anaplastic Lymphoma Kinase",
    "brca": "Breast Cancer Gene",
    "brca1": "Breast Cancer Gene 1",
    "brca2": "Breast Cancer Gene 2",
    "pd-l1": "Programmed Death-Ligand 1",
    "pd-1": "Programmed Cell Death Protein 1",
    "ecog": "Eastern Cooperative Oncology Group",
    "kps": "Karnofsky Performance Status",
    "anc": "Absolute Neutrophil Count",
    "alt": "Alanine Aminotransferase",
    "ast": "Aspartate Aminotransferase",
    "crcl": "Creatinine Clearance",
    "uln": "Upper Limit of Normal",
    "lln": "Lower Limit of Normal",
    "wbc": "White Blood Cell Count",
    "cns": "Central Nervous System",
    "gfr": "Glomerular Filtration Rate",
    "inr": "International Normalized Ratio",
    "cbc": "Complete Blood Count",
    "recist": "Response Evaluation Criteria in Solid Tumors",
    "cr": "Complete Response",
    "pr": "Partial Response",
    "sd": "Stable Disease",
    "pd": "Progressive Disease",
    "dlt": "Dose Limiting Toxicity",
    "mtd": "Maximum Tolerated Dose",
    "orr": "Objective Response Rate",
    "os": "Overall Survival",
    "pfs": "Progression Free Survival",
    "tps": "Tumor Proportion Score",
    "cps": "Combined Positive Score",
    "msi": "Microsatellite Instability",
    "tmb": "Tumor Mutational Burden",
    "fish": "Fluorescence In Situ Hybridization",
    "ihc": "Immunohistochemistry",
    "ras": "Rat Sarcoma Viral Oncogene",
    "kras": "Kirsten Rat Sarcoma Viral Oncogene",
    "braf": "B-Raf Proto-Oncogene",
    "ntrk": "Neurotrophic Tyrosine Receptor Kinase",
    "ros1": "ROS Proto-Oncogene 1",
    "met": "Mesenchymal-Epithelial Transition Factor",
    "fgfr": "Fibroblast Growth Factor Receptor",
    "pik3ca": "Phosphatidylinositol-4,5-Bisphosphate 3-Kinase Catalytic Subunit Alpha",
    "aml": "Acute Myeloid Leukemia",
    "cll": "Chronic Lymphocytic Leukemia",
    "dlbcl": "Diffuse Large B-Cell Lymphoma",
    "rcc": "Renal Cell Carcinoma",
    "hcc": "Hepatocellular Carcinoma",
    "gist": "Gastrointestinal Stromal Tumor",
    "gbm": "Glioblastoma Multiforme",
    "crc": "Colorectal Cancer",
    "hnscc": "Head and Neck Squamous Cell Carcinoma",
}


def default_phrases() -> list[tuple[str, str, str]]:
    """(phrase, kind, label) rows of the built-in dictionary."""
    return [(p, kind, label) for (label, kind), phrases in PHRASES.items() for p in phrases]


def default_abbreviations() -> dict[str, str]:
    return dict(ABBREVIATIONS)

def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_phrases(), "phrase string, kind string, label string")


def abbreviation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(default_abbreviations().items()), "abbr string, expansion string")


def _records(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("file"))
        .where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    )


def load_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Phrase records {"label", "pattern"} from JSON lines; blank and # lines are skipped.

    ``pattern`` is a string (case kept) or a list of {"LOWER": word} tokens. Token lists with
    punctuation wildcards become loose phrases; optional tokens and word lists are expanded.
    """
    raw = _records(spark, path).select(F.from_json("value", "label string, pattern string").alias("r")).select("r.*")
    token = "array<struct<LOWER:string,IS_PUNCT:boolean,OP:string>>"
    is_list = F.col("pattern").startswith("[")
    toks = F.from_json("pattern", token)
    words = F.filter(toks, lambda t: t["LOWER"].isNotNull())
    loose = F.exists(toks, lambda t: F.coalesce(t["IS_PUNCT"], F.lit(False)))

    def options(t):
        inner = F.from_json(t["LOWER"], "IN array<string>")["IN"]
        base = F.coalesce(inner, F.array(t["LOWER"]))
        return F.when(t["OP"].isin("?", "*"), F.concat(base, F.array(F.lit("")))).otherwise(base)

    def cross(acc, t):
        return F.flatten(F.transform(acc, lambda a: F.transform(options(t), lambda o: F.concat_ws(" ", F.when(a != "", a), F.when(o != "", o)))))

    variants = F.aggregate(words, F.array(F.lit("")), cross)
    return raw.select(
        F.explode(F.when(is_list, variants).otherwise(F.array("pattern"))).alias("phrase"),
        F.when(~is_list, "exact").when(loose, "loose").otherwise("lower").alias("kind"), "label",
    ).distinct()


def load_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """{"abbr", "expansion"} JSON lines; keys are lower-cased and the last record of a key wins."""
    rows = _records(spark, path).select(
        F.from_json("value", "abbr string, expansion string").alias("r"), "file", F.monotonically_increasing_id().alias("n"))
    return rows.select(F.lower("r.abbr").alias("abbr"), F.col("r.expansion").alias("expansion"), "file", "n").groupBy("abbr").agg(
        F.max_by("expansion", F.struct("file", "n")).alias("expansion"))


def merge_synonyms(current, desired):
    """Order-preserving, case-insensitive union of two synonym arrays, blanks dropped."""
    both = F.transform(F.concat(F.coalesce(current, F.array().cast("array<string>")), F.coalesce(desired, F.array().cast("array<string>"))), F.trim)
    filled = F.filter(both, lambda s: F.length(s) > 0)
    return F.aggregate(
        filled, F.array().cast("array<string>"),
        lambda acc, s: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))))


def sync_catalogue(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge a catalogue on (system, code): display overwritten, synonyms united. ``change`` tells
    inserted, updated and kept rows apart; write the result as the new snapshot."""
    s = stored.select("system", "code", F.col("display").alias("_d"), F.col("synonyms").alias("_s"))
    n = incoming.select("system", "code", "display", "synonyms")
    merged = F.when(F.col("synonyms").isNull(), F.col("_s")).otherwise(merge_synonyms(F.col("_s"), F.col("synonyms")))
    j = s.join(n, ["system", "code"], "full_outer").withColumn("_m", merged)
    fresh = F.col("_d").isNull() & F.col("_s").isNull()
    return j.select(
        "system", "code", F.coalesce("display", "_d").alias("display"), F.col("_m").alias("synonyms"),
        F.when(fresh, "inserted").when(
            F.col("display").isNotNull() & (~F.col("display").eqNullSafe(F.col("_d")) | ~F.col("_m").eqNullSafe(F.coalesce("_s", F.array().cast("array<string>")))),
            "updated").otherwise("kept").alias("change"),
    )
