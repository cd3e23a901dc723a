"""Terminology coding: mentions to catalogue codes by exact, synonym, trigram and edit-distance joins.

A code depends only on (label, lookup variants, fuzzy allowed), so mentions are reduced to distinct
lookups first; a mention text that makes up a third of all mentions is coded once. Every tier is an
equi-join, and the costly tiers see only what the cheaper ones left. Catalogues and what is found in
them are shuffled, never broadcast: their files are small beside the candidate texts made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import text as T
from cohortmill.functions.scale import stage

THRESHOLD = 0.55
STRINGS = "array<string>"

# Vocabularies per mention label, in rank order.
SYSTEMS_BY_LABEL = {
    "DISEASE": ["mesh"], "BIOMARKER": ["nci_thesaurus"], "DRUG": ["nci_thesaurus"], "PROCEDURE": ["snomed_ct"],
    "PERF_SCALE": ["nci_thesaurus"], "LAB_TEST": ["loinc"],
}
# Mention labels that are coded in each category.
CODABLE = {
    "diagnosis": "DISEASE", "disease_stage": "DISEASE", "histology": "DISEASE", "cns_metastases": "DISEASE",
    "prior_therapy": "DRUG", "line_of_therapy": "DRUG", "concomitant_medication": "DRUG",
    "molecular_alteration": "BIOMARKER", "biomarker": "BIOMARKER", "lab_value": "LAB_TEST",
    "performance_status": "PERF_SCALE", "procedural_requirement": "PROCEDURE",
}
# Words that carry no information for fuzzy matching.
STOPWORDS = [
    "and", "or", "of", "the", "to", "in", "for", "with", "without", "history", "current", "active", "prior",
    "therapy", "treatment", "disease", "disorder", "syndrome", "cancer", "carcinoma", "neoplasm", "neoplasms",
    "tumor", "tumors", "malignancy", "malignant", "study", "intervention", "protocol", "participants", "patient",
]
# Generic terms.
GENERIC_TREATMENTS = [
    "chemotherapy", "platinum based chemotherapy", "systemic therapy", "targeted therapy", "immunotherapy",
    "antiretroviral therapy", "steroid therapy", "immunosuppressive therapy", "hormonal therapy", "endocrine therapy",
]
GENERIC_DIAGNOSES = [
    "active infection", "inflammatory bowel disease", "cardiovascular disorder", "cerebrovascular disease",
    "pulmonary illness", "pulmonary illnesses", "carcinomatous meningitis",
]
BLOCKED_CLASSES = ["pd-1 therapy", "pd-1/pd-l1 therapy", "pd-1/pd-l1 inhibitor therapy", "kras-targeted therapy"]
NEUTRAL_CLASSES = BLOCKED_CLASSES


# ------------------------------------------------------------ variants & gates

def lookup_variants(text: Column, expanded: Column, context: Column) -> Column:
    """Ordered distinct lookup texts: raw, expanded and context, each with its bracketed alias removed."""
    given = F.concat(F.array(text, expanded), F.coalesce(context, F.array().cast(STRINGS)))
    filled = F.filter(given, lambda v: F.coalesce(F.length(v) > 0, F.lit(False)))
    both = F.flatten(F.transform(filled, lambda v: F.array(T.strip_ws(v), T.strip_parenthetical(v))))
    return F.array_distinct(F.filter(both, lambda v: F.length(v) > 0))


def synonym_variants(text: Column) -> Column:
    """Spellings under which a lookup text may be stored as a synonym."""
    s = T.strip_ws(text)
    alias = T.strip_parenthetical(s)
    collapsed = T.squeeze(F.translate(s, "/_", "  "))
    forms = F.array(s, F.lower(s), T.normalize_lookup(text), alias, F.lower(alias), T.normalize_lookup(alias), collapsed, F.lower(collapsed))
    return F.array_distinct(F.filter(forms, lambda v: F.length(v) > 0))


def therapy_class(source: Column) -> Column:
    """PD-1, PD-L1 or KRAS therapy class named by a mention, or null."""
    n = T.clean_semantic(source)
    pd1 = n.contains("pd 1") | n.contains("programmed cell death protein 1")
    pdl1 = n.contains("pd l1") | n.contains("pdl1") | n.contains("programmed death ligand 1") | n.contains("programmed death ligands 1")
    drug = n.contains("therapy") | n.contains("inhibitor") | n.contains("antibody")
    return (
        F.when(pd1 & pdl1 & n.contains("inhibitor"), "pd-1/pd-l1 inhibitor therapy")
        .when(pd1 & pdl1 & (n.contains("therapy") | n.contains("antibody")), "pd-1/pd-l1 therapy")
        .when(pdl1 & drug, "pd-l1 therapy").when(pd1 & drug, "pd-1 therapy")
        .when(n.contains("kras") & (n.contains("target") | n.contains("inhibitor")), "kras-targeted therapy")
    )


def _plain(source: Column) -> Column:
    return T.squeeze(F.lower(source))


def generic_treatment(source: Column) -> Column:
    return _plain(source).isin(GENERIC_TREATMENTS)


def generic_diagnosis(source: Column) -> Column:
    return _plain(source).isin(GENERIC_DIAGNOSES)


def should_code(category: Column, label: Column, source: Column, exception_entities: Column) -> Column:
    allowed = F.lit(False)
    for cat, lab in CODABLE.items():
        allowed = allowed | ((category == cat) & (label == lab))
    excepted = F.exists(F.coalesce(exception_entities, F.array().cast(STRINGS)), lambda e: T.clean_semantic(e) == T.clean_semantic(source))
    generic = category.isin("prior_therapy", "concomitant_medication") & (label == "DRUG") & generic_treatment(source)
    return allowed & ~((category == "concomitant_medication") & excepted) & ~generic


def allow_fuzzy(category: Column, label: Column, source: Column) -> Column:
    class_named = category.isin("prior_therapy", "concomitant_medication") & (label == "DRUG") & therapy_class(source).isNotNull()
    generic = category.isin("diagnosis", "cns_metastases") & (label == "DISEASE") & generic_diagnosis(source)
    return ~class_named & ~generic


def alias_context(text: Column, mention: Column, mentions: Column) -> Column:
    """Texts that "A/B" or "A (B)" writing lends to a mention, with its therapy class first."""
    tight = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s*([/()])\s*", "$1")
    body = tight(text)

    def linked(left: Column, right: Column) -> Column:
        l, r = tight(left), tight(right)
        pair = lambda a, b: body.contains(F.concat(a, F.lit("/"), b)) | body.contains(F.concat(a, F.lit("("), b, F.lit(")")))
        return F.coalesce((F.length(left) > 0) & (F.length(right) > 0) & (left != right) & (pair(l, r) | pair(r, l)), F.lit(False))

    def shares(p: Column) -> Column:
        return (linked(mention["text"], p["text"]) | linked(mention["text"], p["expanded_text"])
                | linked(mention["expanded_text"], p["text"]) | linked(mention["expanded_text"], p["expanded_text"]))

    peers = F.filter(mentions, lambda p: (p["label"] == mention["label"]) & ((p["start"] != mention["start"]) | (p["end"] != mention["end"])) & shares(p))
    lent = F.flatten(F.transform(peers, lambda p: F.array(p["expanded_text"], p["text"])))
    source = F.coalesce(mention["expanded_text"], mention["text"])
    all_ = F.array_distinct(F.array_compact(F.concat(F.array(therapy_class(source)), lent)))
    return F.when(mention["label"].isin("DISEASE", "DRUG", "BIOMARKER"), all_).otherwise(F.array().cast(STRINGS))


def mention_lookups(criteria: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Criteria with mentions to one row per codable mention, with its variants and fuzzy flag."""
    rows = criteria.select(
        key, "category", "original_text", "exception_entities", F.col("exception_logic").isNotNull().alias("has_exception"),
        "mentions", F.posexplode("mentions").alias("mention_no", "m"))
    source = F.coalesce(F.when(F.length("m.expanded_text") > 0, F.col("m.expanded_text")), F.col("m.text"))
    rows = rows.where(should_code(F.col("category"), F.col("m.label"), source, F.col("exception_entities")))
    return rows.select(
        key, "mention_no", "category", "has_exception", F.col("m.label").alias("label"), source.alias("source"),
        lookup_variants(F.col("m.text"), F.col("m.expanded_text"), alias_context(F.col("original_text"), F.col("m"), F.col("mentions"))).alias("variants"),
        allow_fuzzy(F.col("category"), F.col("m.label"), source).alias("fuzzy"))


# ------------------------------------------------------------------ fuzzy text

def trigrams(norm: Column) -> Column:
    """Distinct trigrams of each word padded with two spaces before and one after."""
    words = F.filter(F.split(norm, " "), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def informative(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) > 0) & ~w.isin(STOPWORDS)))


def negated_phrases(norm: Column) -> Column:
    """Word groups after "non" (one to three words) and the rest of "non..." words."""
    words = F.split(norm, " ")

    def of(w: Column, i: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(
            (i + 1 + n <= F.size(words)) & F.exists(F.slice(words, i + 2, n), lambda x: ~x.isin(STOPWORDS)),
            F.array_join(F.slice(words, i + 2, n), " ")))
        base = F.substr(w, F.lit(4))
        return F.when(w == "non", F.array_compact(groups)).when(
            w.startswith("non") & (F.length(w) > 4) & ~base.isin(STOPWORDS), F.array(base)).otherwise(F.array().cast(STRINGS))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def modifier_conflict(a: Column, a_neg: Column, b: Column, b_neg: Column) -> Column:
    """A phrase negated on one side occurs un-negated on the other."""
    said = lambda text, p: F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))
    return F.exists(a_neg, lambda p: said(b, p) & ~F.array_contains(b_neg, p)) | F.exists(b_neg, lambda p: said(a, p) & ~F.array_contains(a_neg, p))


def viable(source: Column, source_neg: Column, source_tokens: Column, candidates: Column) -> Column:
    """Fuzzy viability against candidate texts STRUCT<norm, neg, tokens>: enough informative overlap
    and no modifier conflict with at least one of them."""
    def good(c: Column) -> Column:
        n = F.size(c["tokens"])
        common = F.size(F.array_intersect(source_tokens, c["tokens"]))
        return (common > 0) & ((n <= 2) | (common * 2 >= n)) & ~modifier_conflict(source, source_neg, c["norm"], c["neg"])

    return F.exists(candidates, good)


def _candidate(text: Column) -> Column:
    n = T.normalize_lookup(text)
    return F.struct(n.alias("norm"), negated_phrases(n).alias("neg"), informative(n).alias("tokens"))


def catalogue_index(lookups: DataFrame) -> DataFrame:
    """Catalogue rows with the candidate texts used for viability and ordering."""
    syn = F.coalesce("synonyms", F.array().cast(STRINGS))
    return lookups.select(
        "system", "code", "display", syn.alias("synonyms"), F.lower("display").alias("d_low"), F.lower("code").alias("c_low"),
        F.concat(F.array(_candidate(F.col("display"))), F.transform(syn, _candidate)).alias("texts"))


# ------------------------------------------------------------------------ tiers

def _with_systems(requests: DataFrame, systems: dict[str, list[str]]) -> DataFrame:
    """(request_id, variant_no, variant, system, system_rank): one row per variant and vocabulary."""
    options = F.lit(None).cast("array<struct<system_rank:int,system:string>>")
    for label, names in systems.items():
        arr = F.array(*[F.struct(F.lit(i).alias("system_rank"), F.lit(n).alias("system")) for i, n in enumerate(names)])
        options = F.when(F.col("label") == label, arr).otherwise(options)
    return requests.select("request_id", "label", "fuzzy", F.posexplode("variants").alias("variant_no", "variant")).select(
        "*", F.explode(options).alias("o")).select("request_id", "fuzzy", "variant_no", "variant", "o.system", "o.system_rank")


EDITS = 2
PIECES = EDITS + 1
ORDER = ["tier", "variant_no", "score", "system_rank", "d_low", "c_low"]


def _best(rows: DataFrame) -> DataFrame:
    """First match per request in (tier, variant, score, system, display, code) order."""
    return rows.groupBy("request_id").agg(F.min(F.struct(*ORDER, "system", "code", "display")).alias("b")).select("request_id", "b.*")


def exact_matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    q = asked.withColumn("key", T.normalize_lookup(F.col("variant")))
    c = index.select("system", "code", "display", "d_low", "c_low", T.normalize_catalogue(F.col("display")).alias("key"))
    return q.join(c.hint("merge"), ["system", "key"]).withColumn("tier", F.lit(1)).withColumn("score", F.lit(0.0))


def synonym_matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    q = asked.withColumn("key", F.explode(synonym_variants(F.col("variant"))))
    c = index.select("system", "code", "display", "d_low", "c_low", F.explode("synonyms").alias("key"))
    return q.join(c.hint("merge"), ["system", "key"]).withColumn("tier", F.lit(2)).withColumn("score", F.lit(0.0))


def _rarest_first(df: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """Orders the trigrams of every row by catalogue frequency. There are at most 37^3 trigrams over
    a-z, 0-9 and space, so the frequency table has a fixed bound and is broadcast."""
    e = df.select(*keys, F.explode("tri").alias("t")).join(F.broadcast(frequency), "t", "left")
    return e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("t").alias("t")))).alias("r"))


def _prefix(size: Column, threshold: float) -> Column:
    """How many leading trigrams two sets of this similarity must share one of."""
    return (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")


def trigram_pairs(texts: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(system, norm, candidate, similarity) for distinct normalised texts with similarity >= threshold.

    Prefix filter: with all trigrams in one global order, two sets that similar share a trigram
    among their first few. Rarest first, only those few are joined, and each pair that can still reach
    the threshold by the places of its common trigram is compared exactly; a trigram that occurs everywhere is never a join key unless it must be.
    """
    c = catalogue.select("system", F.col("cand")).distinct().withColumn("tri", trigrams(F.col("cand")))
    q = texts.select("system", "norm").distinct().withColumn("tri", trigrams(F.col("norm")))
    frequency = c.select(F.explode("tri").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    cr = _rarest_first(c, frequency, ["system", "cand"]).select(
        "system", "cand", F.transform("r", lambda x: x["t"]).alias("ct"))
    qr = _rarest_first(q, frequency, ["system", "norm"]).select(
        "system", "norm", F.transform("r", lambda x: x["t"]).alias("qt"))
    left = qr.select("*", F.posexplode(F.slice("qt", 1, _prefix(F.size("qt"), threshold))).alias("qi", "t"))
    right = cr.select("*", F.posexplode(F.slice("ct", 1, _prefix(F.size("ct"), threshold))).alias("ci", "t"))
    near = (F.size("ct") >= F.size("qt") * threshold - 1e-9) & (F.size("qt") >= F.size("ct") * threshold - 1e-9)
    # At the first common trigram nothing before it is common, so what follows has to suffice; at later ones the pair was seen already.
    reach = F.least(F.size("qt") - F.col("qi"), F.size("ct") - F.col("ci"))
    near = near & (reach * (1 + threshold) >= (F.size("qt") + F.size("ct")) * threshold - 1e-9)
    common = F.size(F.array_intersect("qt", "ct"))
    sim = common / (F.size("qt") + F.size("ct") - common)
    return (
        left.join(right.hint("merge"), ["system", "t"]).where(near)
        .withColumn("similarity", sim).where(F.col("similarity") >= threshold - 1e-12)
        .groupBy("system", "norm", "cand").agg(F.max("similarity").alias("similarity"))
    )


def _fuzzy_query(asked: DataFrame) -> DataFrame:
    n = T.normalize_lookup(F.col("variant"))
    return asked.where("fuzzy").withColumn("norm", n).withColumn("q_neg", negated_phrases(F.col("norm"))).withColumn(
        "q_tok", informative(F.col("norm")))


def trigram_matches(asked: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    q = _fuzzy_query(asked)
    texts = F.concat(F.array("display"), F.col("synonyms"))
    c = index.select("*", F.explode(texts).alias("one")).withColumn("cand", T.normalize_catalogue(F.col("one")))
    pairs = trigram_pairs(q, c, threshold)
    scored = pairs.join(c.select("system", "cand", "code", "display", "d_low", "c_low", "texts").distinct().hint("merge"), ["system", "cand"]).groupBy(
        "system", "norm", "code").agg(F.max("similarity").alias("sim"), F.first(F.struct("display", "d_low", "c_low", "texts")).alias("c"))
    return (
        q.join(scored.hint("merge"), ["system", "norm"])
        .where(viable(F.col("norm"), F.col("q_neg"), F.col("q_tok"), F.col("c.texts")))
        .select("request_id", "variant_no", "system", "system_rank", "code", F.col("c.display").alias("display"), F.col("c.d_low").alias("d_low"),
                F.col("c.c_low").alias("c_low"), F.lit(3).alias("tier"), (-F.col("sim")).alias("score"))
    )


def _piece(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of piece ``i`` of a text of ``length`` characters cut into PIECES, longer ones last."""
    base, over = F.floor(length / PIECES).cast("int"), length % PIECES
    extra = F.greatest(F.lit(0), F.lit(i - PIECES) + over).cast("int")
    return F.lit(i) * base + extra, base + F.when(over >= PIECES - i, 1).otherwise(0)


def _piece_key(length: Column, i: int, text: Column) -> Column:
    return F.concat_ws(":", length.cast("string"), F.lit(str(i)), text)


def edit_pairs(texts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(system, norm, cand, distance) of distinct texts with an edit distance of at most EDITS.

    A text cut into EDITS + 1 pieces keeps one of them whole under EDITS edits, shifted by EDITS places at most. Candidates are posted
    under their pieces (with length and number), and a text asks for its substrings that could be a piece of a candidate of a
    length within EDITS. Keys are thirds of whole texts, so no word, however frequent, makes a block; pairs are made distinct
    before they are compared.
    """
    c = catalogue.select("system", "cand").distinct()
    n = F.length("cand")
    posted = c.select("system", "cand", F.explode(F.array(*[
        _piece_key(n, i, F.substr(F.col("cand"), _piece(n, i)[0] + 1, _piece(n, i)[1])) for i in range(PIECES)])).alias("key"))
    size = F.length("norm")

    def asked(length: Column, i: int) -> Column:
        start, piece = _piece(length, i)
        low, high = F.greatest(start - EDITS, F.lit(0)), F.least(start + EDITS, size - piece)
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda p: _piece_key(length, i, F.substr(F.col("norm"), p + 1, piece)))).otherwise(
            F.array().cast(STRINGS))

    lengths = F.sequence(F.greatest(size - EDITS, F.lit(0)), size + EDITS)
    keys = F.array_distinct(F.flatten(F.transform(lengths, lambda length: F.concat(*[asked(length, i) for i in range(PIECES)]))))
    q = texts.select("system", "norm").distinct().select("system", "norm", F.explode(keys).alias("key"))
    distance = F.levenshtein(F.col("norm"), F.col("cand"), EDITS)
    return q.join(posted.hint("merge"), ["system", "key"]).select("system", "norm", "cand").distinct().withColumn("distance", distance).where("distance >= 0")


def edit_matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Viable candidates with an edit distance of at most 2."""
    q = _fuzzy_query(asked)
    each = index.select("system", "code", "display", "d_low", "c_low", "texts", F.posexplode("texts").alias("place", "x"))
    c = each.select("system", "code", "display", "d_low", "c_low", F.col("x.norm").alias("cand"),
                    F.when(F.col("place") == 0, F.col("texts")).otherwise(F.array("x")).alias("against"))
    pairs = edit_pairs(q, c)
    return (
        q.join(pairs.hint("merge"), ["system", "norm"]).join(c.hint("merge"), ["system", "cand"])
        .where(viable(F.col("norm"), F.col("q_neg"), F.col("q_tok"), F.col("against")))
        .select("request_id", "variant_no", "system", "system_rank", "code", "display", "d_low", "c_low", F.lit(4).alias("tier"),
                F.col("distance").cast("double").alias("score"))
    )


_COLS = ["request_id", *ORDER, "system", "code", "display"]


def code_requests(requests: DataFrame, lookups: DataFrame, systems: dict[str, list[str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Best concept per distinct lookup (request_id, label, variants, fuzzy).

    Exact and synonym tiers run over everything; their leftovers are stored, and only those reach
    the trigram tier, whose leftovers reach the edit-distance tier.
    """
    index = catalogue_index(lookups)
    asked = _with_systems(requests, systems or SYSTEMS_BY_LABEL)
    direct = stage(_best(exact_matches(asked, index).select(*_COLS).unionByName(synonym_matches(asked, index).select(*_COLS))))
    rest = stage(asked.where("fuzzy").join(direct.select("request_id"), "request_id", "left_anti"))
    near = stage(_best(trigram_matches(rest, index, threshold).select(*_COLS)))
    last = _best(edit_matches(rest.join(near.select("request_id"), "request_id", "left_anti"), index).select(*_COLS))
    found = direct.unionByName(near).unionByName(last)
    kind = F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "synonym").when(F.col("tier").isNotNull(), "fuzzy")
    out = requests.select("request_id", "label").join(found, "request_id", "left").withColumn("match_type", kind)
    codable = F.col("label").isin(list((systems or SYSTEMS_BY_LABEL)))
    return out.select(
        "request_id", "system", "code", "display", "match_type", "tier", "variant_no", "score",
        F.when(~codable, 0.0).when(F.col("match_type") == "exact", 0.95).when(F.col("match_type") == "synonym", 0.85)
        .when(F.col("match_type") == "fuzzy", 0.60).otherwise(0.40).alias("confidence"),
        (codable & (F.col("match_type").isNull() | (F.col("match_type") == "fuzzy"))).alias("review_required"),
        F.when(~codable, F.lit(None).cast("string")).when(F.col("match_type").isNull(), "uncoded_entity")
        .when(F.col("match_type") == "fuzzy", "fuzzy_match").alias("review_reason"),
    )


def code_mentions(mentions: DataFrame, lookups: DataFrame, systems: dict[str, list[str]] | None = None) -> DataFrame:
    """Mentions (label, variants, fuzzy, ...) with their coding result."""
    rid = F.sha1(F.concat_ws("\u0001", F.col("label"), F.col("fuzzy").cast("string"), F.array_join("variants", "\u0002")))
    m = mentions.withColumn("request_id", rid)
    # first() of a struct would sort all mentions, as wide as they are, in each task; distinct keeps a hash table of the lookups.
    # It is stored, as Spark drops a distinct below first().
    lookups_asked = stage(mentions.select("label", "variants", "fuzzy").distinct()).withColumn("request_id", rid)
    requests = stage(lookups_asked.groupBy("request_id").agg(F.first(F.struct("label", "variants", "fuzzy")).alias("r")).select("request_id", "r.*"))
    return m.join(code_requests(requests, lookups, systems), "request_id")


# --------------------------------------------------------- results per criterion

def grounding_status(category: Column, label: Column, source: Column, coded: Column) -> Column:
    term = therapy_class(source)
    return F.when(
        category.isin("prior_therapy", "concomitant_medication") & (label == "DRUG") & term.isNotNull(),
        F.when(coded, "grounded").when(term.isin(BLOCKED_CLASSES), "blocked_missing_safe_source").otherwise("recognized_ungrounded"))


def review_ignored() -> Column:
    """Uncoded mentions that do not ask for review: generic diagnoses, neutral therapy classes, and
    drugs of a medication restriction with its logic read."""
    c, lab, src = F.col("category"), F.col("label"), F.col("source")
    uncoded = F.col("code").isNull() & F.coalesce(F.col("review_reason") == "uncoded_entity", F.lit(False))
    neutral = F.coalesce(therapy_class(src).isin(NEUTRAL_CLASSES), F.lit(False))
    return uncoded & (
        (c.isin("diagnosis", "cns_metastases") & (lab == "DISEASE") & generic_diagnosis(src))
        | (c.isin("prior_therapy", "concomitant_medication") & (lab == "DRUG") & neutral)
        | ((c == "concomitant_medication") & F.col("has_exception") & (lab == "DRUG")))


def _match_rank(kind: Column) -> Column:
    return F.when(kind == "exact", 0).when(kind == "synonym", 1).when(kind == "fuzzy", 2).otherwise(3)


def dedupe_concepts(coded: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Best concept per (criterion, system, code): match type, then display."""
    return coded.where(F.col("code").isNotNull()).groupBy(key, "system", "code").agg(
        F.min(F.struct(_match_rank(F.col("match_type")).alias("r"), F.lower("display").alias("l"), "display", "match_type")).alias("b")
    ).select(key, "system", "code", "b.display", "b.match_type")


def merge_coding(criteria: DataFrame, coded: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Confidence, review reason and concepts of each criterion after coding.

    The mentions of one criterion are folded in order; they come from one text, so the list is
    bounded by that text.
    """
    step = F.struct("mention_no", "match_type", F.col("confidence").alias("c"),
                    (F.col("review_required") & ~review_ignored()).alias("asks"), "review_reason")
    g = coded.groupBy(key).agg(
        F.array_sort(F.collect_list(step)).alias("_steps"),
        F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("review_required") & ~review_ignored(), F.col("review_reason"))))).alias("_reasons"),
        F.max(F.col("code").isNotNull()).alias("_coded"))
    concepts = dedupe_concepts(coded, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("system", "code", "display", "match_type"))).alias("coded_concepts"))

    def fold(conf: Column, s: Column) -> Column:
        merged = (
            F.when(s["match_type"] == "exact", F.greatest(conf, F.lit(0.90))).when(s["match_type"] == "synonym", F.greatest(conf, F.lit(0.82)))
            .when(s["match_type"] == "fuzzy", F.least(conf, F.lit(0.60))).otherwise(conf))
        return F.when(s["asks"], F.least(merged, s["c"])).otherwise(merged)

    none = F.array().cast("array<struct<system:string,code:string,display:string,match_type:string>>")
    j = criteria.join(g, key, "left").join(concepts, key, "left").withColumn("coded_concepts", F.coalesce("coded_concepts", none))
    n = F.coalesce(F.size("_reasons"), F.lit(0))
    reason = F.when(n == 1, F.get("_reasons", 0)).when(n > 1, "mixed_coding_review")
    raised = ~F.col("review_required") & (n > 0)
    old = [c for c in criteria.columns if c not in ("confidence", "review_required", "review_reason", "coded_concepts")]
    out = j.select(
        *old, "coded_concepts", F.when(F.col("_steps").isNotNull(), F.aggregate("_steps", F.col("confidence"), fold)).otherwise(F.col("confidence")).alias("confidence"),
        (F.col("review_required") | raised).alias("review_required"), F.when(raised, reason).otherwise(F.col("review_reason")).alias("review_reason"))
    slots = (
        F.when(F.col("category").isin("molecular_alteration", "biomarker"), "molecular_concept")
        .when(F.col("category").isin("prior_therapy", "concomitant_medication"), "therapy_or_medication_concept")
        .when(F.col("category").isin("diagnosis", "cns_metastases"), "diagnosis_concept"))
    ungrounded = F.col("review_required") & F.col("review_reason").isin("uncoded_entity", "mixed_coding_review") & (F.size("coded_concepts") == 0)
    return out.withColumn("ungrounded_key_slot", F.when(ungrounded, slots)).withColumn(
        "review_status", F.when(F.col("review_required"), "pending"))


def code_criteria(criteria: DataFrame, lookups: DataFrame, key: str = "criterion_id", systems: dict[str, list[str]] | None = None) -> DataFrame:
    """Extracted criteria (with mentions) to coded criteria, ready to be stored."""
    return merge_coding(criteria, stage(code_mentions(mention_lookups(criteria, key), lookups, systems)), key)
