"""Text patterns that decide how a criterion reads.

They define the expected results, so they are stated literally. All are matched without regard to
case unless noted.
"""

# Section structure (one line each)
INCLUSION_HEADER = r"[^\S\n]*(?:inclusion[^\S\n]+criteria|eligibility[^\S\n]+criteria|inclusion)[^\S\n]*:?[^\S\n]*"
EXCLUSION_HEADER = r"[^\S\n]*(?:exclusion[^\S\n]+criteria|exclusion)[^\S\n]*:?[^\S\n]*"
INTRO_LINE = (
    r"[^\S\n]*the[^\S\n]+main[^\S\n]+(?:inclusion|exclusion)[^\S\n]+criteria[^\S\n]+include"
    r"(?:[^\S\n]+but[^\S\n]+are[^\S\n]+not[^\S\n]+limited[^\S\n]+to)?[^\S\n]+the[^\S\n]+following[^\S\n]*:?[^\S\n]*"
)
MARKER = r"[^\S\n]*(?:\d+[\.\)]|-|•)[^\S\n]*"

EXCLUSION_SIGNALS = [
    r"\bmust\s+not\b", r"\bshould\s+not\b", r"\bcannot\b", r"\bno\s+(?:prior|history|evidence|active|known)\b",
    r"\bno\s+(?:prior\s+)?(?:systemic|concurrent)\b", r"\babsence\s+of\b", r"\bexcluded?\s+if\b", r"\bineligible\s+if\b",
    r"\bhave\s+not\s+received\b", r"\bnot\s+have\s+(?:received|active|known)\b",
    r"\bwithout\s+(?:prior|active|known|evidence)\b",
]

# Letters that a text of each signal holds in lower case, whatever its case was: only such without a foreign case variant (i, k and s have one).
EXCLUSION_HINTS = ["not", "not", "cannot", "no", "no", "ence", "clude", "nel", "not", "not", "thout"]

# Clause shapes
LABELLED = r"^(.+?),\s*including:\s*a\)\s*(.+?);\s*b\)\s*(.+?)$"
PROGRESSION_AFTER = (
    r"^(.*?\b(?:documented\s+disease\s+progression|disease\s+progression|progression)\b.*?\bafter\b\s+\b(?:receiving|receipt\s+of)\b)\s+(.+)$"
)
INCLUDING_PROGRESSION = r"(?s)^(\*?\s*(?:has|have))\s+(.+?),\s+including\s+(disease\s+progression\s+after\s+receiving.+)$"
FOLLOWING_TYPES = (
    r"(?s)^(.*?)\b(?:of\s+the\s+following\s+types|following\s+types|following\s+histologies)\s*:\s*(.+?)(,?\s*(?:who|that)\b.+)$"
)
DIAGNOSIS_OR_MEDICATION = (
    r"^(\*?\s*)(has|have)\s+(?:a\s+diagnosis\s+of|diagnosis\s+of)\s+(.+?)\s+or\s+((?:is\s+receiving|receiving|using|use\s+of).+)$"
)
MEDICATION_LEMMA = r"^(is\s+receiving|receiving|using|use\s+of)\s+(.+)$"
TEMPORAL_TAIL = r"\b(?:within|at\s+least|no\s+more\s+than|prior\s+to|since|more\s+than|>)\b.+$"
MEDICATION_SIGNAL = (
    r"\b(?:vaccine|corticosteroid|steroid\s+therapy|immunosuppressive\s+therapy|immunosuppressive\s+medications?|"
    r"immunosuppressants?|cyp[0-9a-z-]+)\b"
)
PREVIOUS_HISTORY = r"^(\*?\s*(?:has|have))\s+(.+?)\s+or\s+(previous history of .+)$"
ENUMERATION_CONNECTOR = r"\s*(?:,\s*|\bor\b\s*|\band/or\b\s*)"
LONG_FORM_DRUG = r"programmed\s+death(?:-|\s+)ligand\s+1\s*\(\s*PD(?:-|\s*)L1\s*\)\s*therapy"

# Quantities (case-sensitive except the word forms)
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
SCIENTIFIC = r"([≥≤><]=?)\s*([\d.]+)\s*[x×]\s*10([⁰¹²³⁴⁵⁶⁷⁸⁹]+)\s*(.*)"
RANGE = r"([\d.]+)\s*[-–]\s*([\d.]+)\s*(.*)"
RANGE_WORDS = r"([\d.]+)\s+(?:to|through)\s+([\d.]+)\s*(.*)"
WORD_COMPARISON = r"^(at least|no more than|less than|greater than|more than)\s+([\d.]+)\s*(.*)"
COMPARISON = r"([≥≤><]=?)\s*([\d.]+)\s*(.*)"
UPWARD_WORDS = ["at least", "greater than", "more than"]

# Timeframes, negation, logic
TIMEFRAMES = [
    (r"within\s+([\d.]+)\s+(days?|weeks?|months?|years?)", "within"),
    (r"at\s+least\s+([\d.]+)\s+(days?|weeks?|months?|years?)", "at_least"),
    (r"no\s+more\s+than\s+([\d.]+)\s+(days?|weeks?|months?|years?)", "no_more"),
    (r"(?:>|more than)\s*([\d.]+)\s+(days?|weeks?|months?|years?)", "at_least"),
    (r"prior\s+to\s+([\d.]+)\s+(days?|weeks?|months?|years?)", "prior_to"),
    (r"since\s+([\d.]+)\s+(days?|weeks?|months?|years?)", "since"),
]
NEGATION = r"\b(?:no|not|without|never|absence of|must not|should not|cannot|have not|did not)\b"
EXCEPTION = r"\b(?:unless|except|provided that|other than)\b"
NOT_A_NEGATION = r"\bnot limited to\b|\bnot amenable to\b"
AND_OR = r"\band/or\b"
OR_WORD = r"\bor\b"
SAME_WORD_OR = r"\b([a-z0-9]+)\s+or\s+\1(?:-[a-z0-9]+)+\s+[a-z0-9-]+\b"

# Category signals
AGE = r"\b(?:age|years?\s+old)\b"
LINE = r"\b(?:line|first.line|second.line|third.line|prior\s+line)\b"
CNS = r"\b(?:cns|brain|central nervous system|leptomeningeal)\b"
STAGE = r"\b(?:stage\s+[IViv]+|unresectable|metastatic|locally advanced)\b"
TNM = r"\b(?:[tcnm][0-4](?:mi|[a-c])?)\b"
NUMERIC_STAGE = r"\bstage\s+[0-9ivx]+[a-c]?(?:\s+or\s+[0-9ivx]+[a-c]?)?\b"
STAGE_VALUE = r"\b(stage\s+[0-9ivx]+[a-c]?(?:\s+or\s+[0-9ivx]+[a-c]?)?|unresectable|metastatic|locally advanced)\b"
HISTOLOGY = r"\b(?:adenocarcinoma|squamous|histolog|histopatholog)\b"
HISTOLOGY_VALUE = r"\b(?:non[- ]squamous|squamous|adenocarcinoma|histologically confirmed|cytologically confirmed)\b"
MOLECULAR = (
    r"(?:\b(?:mutation|rearrangement|amplification|fusion|alteration|wild.?type)\b|\b(?:genetic|genomic)\s+variants?\b)"
)
PRIOR_THERAPY = (
    r"\b(?:prior\s+treatment|prior\s+therapy|chemotherap(?:y|ies)|radiation(?:\s+therapy)?|immunotherap(?:y|ies)|"
    r"checkpoint\s+inhibitor\s+therapy|anti[-\s]+pd[-\s]*1(?:\s+inhibitor)?\s+therapy|endocrine\s+therapy|"
    r"hormonal\s+therapy|targeted\s+therap(?:y|ies)|systemic\s+therapy|biologic(?:al)?\s+therapy)\b"
)
THERAPY_ANCHOR = (
    r"\b(?:prior|previous|received|receipt\s+of|progress(?:ed)?\s+on|failed|refractory|after|during|history\s+of)\b"
)
TARGETED_EXPOSURE = (
    r"\b(?:received|receiving|treated|treatment|therapy|agent|drug|inhibitor|antibody)\b.*\b(?:targeting|targeted|directed\s+against)\b"
    r"|\b(?:targeting|targeted|directed\s+against)\b.*\b(?:agent|drug|inhibitor|antibody|therapy|treatment)\b"
)
CONCOMITANT = r"\b(?:concurrent|concomitant)\b.*\b(?:medications?|drugs?|treatments?|inhibitors?|inducers?|substrates?)\b"
VACCINE = r"\b(?:live(?:-attenuated)?\s+vaccine|vaccines?)\b"
LIVE_VACCINE = r"\b(?:live(?:\s+or\s+live-attenuated)?|live-attenuated)\s+vaccines?\b"
CYP = r"(?:\bcyp[0-9a-z-]+\b.*\b(?:inhibitors?|inducers?)\b|\b(?:inhibitors?|inducers?)\b.*\bcyp[0-9a-z-]+\b)"
HYPERSENSITIVITY = r"\b(?:hypersensitiv(?:ity|e)|allerg(?:y|ic)|anaphylaxis|intoleran(?:ce|t))\b"
SEX_ONLY = r"\b(female|male)\s+(?:patients?|subjects?|participants?)\s+only\b"
ORGAN_COMPLEX = r"\b(?:as\s+determined\s+by|per\s+institutional|investigator)\b"
ORGAN_FUNCTION = (
    r"\b(?:organ function|renal function|kidney function|hepatic function|liver function|hematologic function|"
    r"haematologic function|bone marrow function)\b"
)
CURRENT_CONDITION = (
    r"\b(?:active infection|immunodeficiency|pneumonitis|interstitial lung disease|inflammatory bowel disease|"
    r"cardiovascular disorder|cerebrovascular disease|pulmonary illnesses?|primary brain tumors?|primary cns tumors?|"
    r"uncontrolled (?:infection|diabetes)|connective tissue disease|second malignan(?:cy|cies)|"
    r"additional malignan(?:cy|cies)|concurrent malignan(?:cy|cies))\b"
)
DISEASE_STATUS = (
    r"\b(?:documented\s+disease\s+progression|disease\s+progression|progression|progressed|refractory|relapsed|"
    r"recurrent|recurrence)\b"
)
PROCEDURAL = (
    r"\b(?:archival\s+tumou?r\s+tissue|newly\s+obtained\s+biopsy|provided\s+tissue\s+prior\s+to|"
    r"recovered\s+from\s+major\s+surgery|major\s+surgery|surgical\s+complications?)\b"
)
DIAGNOSIS = r"\b(?:diagnosis|diagnosed with)\b"
CONFIRMED = r"\b(?:confirmed|histologically|cytologically|pathologically|biopsy[- ]confirmed|biopsy)\b"
DISEASE_HINT = r"\b(?:solid tumou?rs?|cancers?|carcinomas?|malignan(?:cy|cies)|neoplasms?)\b"
CORTICOSTEROID = (
    r"\b(?:systemic\s+corticosteroids?|corticosteroids?|systemic\s+steroids?|glucocorticoids?|prednisone|"
    r"dexamethasone|methylprednisolone|prednisolone)\b"
)
IMMUNOSUPPRESSIVE = (
    r"\b(?:immunosuppressive\s+therapy|immunosuppressive\s+medications?|immunosuppressants?|"
    r"systemic\s+steroid\s+therapy|chronic\s+systemic\s+steroid\s+therapy)\b"
)

# Patient flags, in the order they are tried: (value, pattern)
ADMINISTRATIVE = [
    ("can_consent:false",
     r"\b(?:unable|cannot|can't|inability)\b.{0,40}\b(?:consent|provide informed consent|sign informed consent)\b"
     r"|\badults?\s+unable\s+to\s+consent\b|\binability to provide informed consent\b"),
    ("can_consent:true",
     r"\b(?:provide|provided|give|given|sign|signed|understand|understood)\b.{0,40}\binformed consent\b"
     r"|\bable to consent\b|\bwilling and able\b.{0,50}\binformed consent\b"),
    ("protocol_compliant:false",
     r"\b(?:unable|cannot|can't|inability|unwilling(?:ness)?)\b.{0,70}\b(?:comply|adhere|follow)\b.{0,70}\b(?:protocol|study procedures?|scheduled visits?|treatment plan|laboratory tests?)\b"),
    ("protocol_compliant:true",
     r"\b(?:willing and able|able|ability|willing(?:ness)?)\b.{0,70}\b(?:comply|adhere|follow)\b.{0,70}\b(?:protocol|study procedures?|scheduled visits?|treatment plan|laboratory tests?)\b"),
    ("protocol_compliant:false",
     r"\b(?:unable|cannot|can't|inability|unwilling(?:ness)?)\b.{0,80}\b(?:participate|complete|undergo|attend)\b.{0,80}\b(?:study evaluations?|evaluations?|study procedures?|procedures?|visits?)\b"),
    ("protocol_compliant:true",
     r"\b(?:willing and able|able|ability|willing(?:ness)?)\b.{0,80}\b(?:participate|complete|undergo|attend)\b.{0,80}\b(?:study evaluations?|evaluations?|study procedures?|procedures?|visits?)\b"),
]
BEHAVIORAL = [
    ("claustrophobic:true", r"\bclaustrophobi(?:a|c)\b"),
    ("motion_intolerant:true",
     r"\b(?:motion intolerance|unable to remain still|cannot remain still|unable to lie still|cannot lie still|"
     r"unable to tolerate (?:mri|pet|scan|imaging)|inability to tolerate (?:mri|pet|scan|imaging)|"
     r"dyspnea precluding the ability to follow breath-hold instructions)\b"),
]
REPRODUCTIVE = [
    ("pregnant:false", r"\b(?:non[- ]pregnant|negative pregnancy test)\b"),
    ("pregnant:true", r"\b(?:pregnan(?:cy|t))\b"),
]
DEVICE = [
    ("mr_device_present:true",
     r"\b(?:contraindication to mri|mri contraindication|mr[- ]?(?:unsafe|incompatible)|pacemakers?|defibrillators?|"
     r"cochlear implants?|aneurysm clips?|metallic implants?|implantable devices?|neurostimulators?|mr devices?)\b"),
]

# Context facets: (value, pattern)
SPECIMENS = [
    ("ctDNA", r"\b(?:circulating\s+tumou?r\s+deoxyribonucleic\s+acid|ctdna)\b"), ("tumor tissue", r"\btumou?r\s+tissue\b"),
    ("plasma", r"\bplasma\b"), ("blood", r"\bblood\b"),
]
MODALITIES = [
    ("next_generation_sequencing", r"\bnext[- ]generation sequencing\b|\bngs\b"),
    ("immunohistochemistry", r"\bimmunohistochemistry\b|\bihc\b"), ("polymerase_chain_reaction", r"\bpcr\b|\brt-pcr\b"),
    ("fluorescence_in_situ_hybridization", r"\bfish\b"), ("liquid_biopsy", r"\bctdna\b"),
]
NSCLC = r"\bnon[- ]small cell\b"
SCLC = r"\bsmall cell\b"

# Review gates and medication wording
COMPLEX = (
    r"\b(?:unless|except|provided that|other than|whichever\s+is\s+(?:longer|shorter)|"
    r"including\s+but\s+not\s+limited\s+to)\b"
)
QUALIFIER = r"(positive|negative|high|low|overexpression|amplified)"
AT_LEAST_COUNT = r"\bat\s+least\s+[\d.]+\b"
ALLOWANCE = r"\b(?:can\s+be\s+included|eligible)\b"
PHYSIOLOGIC = r"\bphysiologic(?:al)?(?:\s+replacement)?\s+doses?\b[^.;)]*"
EXCEPTION_STOP = r"\b(?:which|that|who|when)\b"
THERAPY_FIRST = r"\b(?:targeted\s+therap(?:y|ies)|trastuzumab-containing\s+treatments?)\b"
THERAPY_LAST = (
    r"\b(?:anti[-\s]+pd[-\s]*1(?:\s+inhibitor)?\s+therapy|pd-1(?:/pd-l1)?(?:\s+inhibitor)?\s+therapy|pd-l1\s+therapy|"
    r"checkpoint\s+inhibitor\s+therapy|immunotherap(?:y|ies)|platinum-based chemotherapy|chemotherapy|"
    r"kras-targeted therapy|agent targeting kras)\b"
)
CARDINAL = (
    r"\b(?:at least|more than|less than|greater than|no more than)\s+\d+(?:\.\d+)?\b(?!\.\d|\s*(?:%|days?\b|weeks?\b|months?\b|years?\b))"
)
DURATION = (
    r"\b(?:(?:at least|more than|less than|greater than|no more than)\s+)?\d+(?:\.\d+)?\s+(?:days?|weeks?|months?|years?)(?:\s+(?:old|ago))?\b"
)
