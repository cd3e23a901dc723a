"""Registered narrative-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions.scale import each
from cohortmill.operators import classify as C
from cohortmill.operators import extract as X
from cohortmill.operators import narrative as N
from cohortmill.operators import tagging as G
from cohortmill.operators import values as Vl
from cohortmill.plans import views as V
from cohortmill.plans.registry import query
from cohortmill.sources import dictionaries as Dc


def quoted(p: str) -> str:
    return p.replace("'", "''")


def rx(p: str, col: str = "text") -> str:
    return f"regexp_matches({col}, '(?i){quoted(p)}')"


def first_case(rules, col: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN {rx(p, col)} THEN '{v}'" for v, p in rules) + " END"


def docs(spark, sf):
    """Every document of the table and every derived narrative."""
    V.register(spark, sf)
    own = spark.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    n = V.table(spark, sf, "narratives").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return own.unionByName(n)


def items(spark, sf):
    return V.table(spark, sf, "items")


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT 'n' || CAST(doc_id AS VARCHAR), text FROM narratives)"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_INC = "(?i)^\\s*(inclusion\\s+criteria|eligibility\\s+criteria|inclusion)\\s*:?\\s*$"
_EXC = "(?i)^\\s*(exclusion\\s+criteria|exclusion)\\s*:?\\s*$"
_INTRO = "(?i)^\\s*the\\s+main\\s+(?:inclusion|exclusion)\\s+criteria\\s+include(?:\\s+but\\s+are\\s+not\\s+limited\\s+to)?\\s+the\\s+following\\s*:?\\s*$"
_MARK = "^\\s*(?:\\d+[\\.\\)]\\s*|-\\s*|•\\s*)"
_EXCL = " OR ".join(rx(p, "txt") for p in P.EXCLUSION_SIGNALS)
# Items by line kinds: M marked line, H header or introduction, X empty marker, I indented, P plain.
_ITEMS = f"""{_DOCS},
ln AS (SELECT doc_id, unnest(string_split({_STRIP('text')}, chr(10))) AS line, generate_subscripts(string_split({_STRIP('text')}, chr(10)), 1) AS i FROM docs WHERE {_STRIP('text')} <> ''),
lk AS (SELECT *, {_STRIP('line')} AS st, CASE WHEN regexp_matches(line, '{_INC}') THEN 'inclusion' WHEN regexp_matches(line, '{_EXC}') THEN 'exclusion' END AS hdr FROM ln WHERE {_STRIP('line')} <> ''),
kk AS (SELECT *, CASE WHEN hdr IS NOT NULL OR regexp_matches(st, '{_INTRO}') THEN 'H'
    WHEN regexp_matches(line, '{_MARK}') THEN CASE WHEN {_STRIP(f"regexp_replace(st, '{_MARK}', '')")} = '' THEN 'X' ELSE 'M' END
    WHEN regexp_matches(line, '^\\s') THEN 'I' ELSE 'P' END AS kind, bool_or(hdr IS NOT NULL) OVER (PARTITION BY doc_id) AS headed FROM lk),
bb AS (SELECT *, last_value(CASE WHEN kind IN ('M', 'H', 'X') THEN kind END IGNORE NULLS) OVER w AS bnd, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS prev,
    last_value(hdr IGNORE NULLS) OVER w AS sect FROM kk WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
ss AS (SELECT *, sum(CASE WHEN kind = 'M' OR (coalesce(bnd, '') <> 'M' AND (kind = 'P' OR (kind = 'I' AND (prev IS NULL OR prev IN ('H', 'X'))))) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM bb),
it AS (SELECT doc_id, CAST(g - 1 AS INT) AS item_no, string_agg(CASE WHEN kind = 'M' THEN {_STRIP(f"regexp_replace(st, '{_MARK}', '')")} ELSE st END, ' ' ORDER BY i) AS txt,
    any_value(headed) AS headed, min(coalesce(sect, 'inclusion')) AS sect FROM ss WHERE kind IN ('M', 'I', 'P') GROUP BY doc_id, g),
pol AS (SELECT *, CASE WHEN {_EXCL} THEN 'exclusion' ELSE 'inclusion' END AS detected FROM it)"""


@query("e1_section_items", V.oracle_with("narratives", _ITEMS, "SELECT doc_id, item_no, txt AS text FROM it"))
def _(spark, sf):
    return N.split_items(docs(spark, sf)).select("doc_id", "item_no", "text")


@query("e2_header_presence", V.oracle_with("narratives", _ITEMS, "SELECT doc_id, any_value(headed) AS headed FROM kk GROUP BY doc_id"))
def _(spark, sf):
    d = docs(spark, sf)
    return d.where(F.length(F.trim("text")) > 0).select("doc_id", N.has_headers(F.col("text")).alias("headed"))


@query("e3_polarity", V.oracle("items", f"SELECT item_id, CASE WHEN {_EXCL.replace('txt', 'text')} THEN 'exclusion' ELSE 'inclusion' END AS detected FROM items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", N.polarity(F.col("text")).alias("detected"))


@query("e4_polarity_override", V.oracle_with("narratives", _ITEMS, """SELECT doc_id, item_no, CASE WHEN headed AND NOT (detected = 'exclusion' AND sect = 'inclusion') THEN sect ELSE detected END AS type,
       headed AND detected = 'exclusion' AND sect = 'inclusion' AS review_required FROM pol"""))
def _(spark, sf):
    return N.split_items(docs(spark, sf)).select("doc_id", "item_no", "type", "review_required")


# Clause rules: the sentences of the derived view have one known shape per rule.
def _rule_query(name, rule, sql):
    def run(spark, sf):
        d = items(spark, sf).withColumn("r", N.RULES[rule](F.trim("text"))).where(F.col("r").isNotNull())
        return d.select("item_id", F.col("r.operator").alias("operator"), F.posexplode("r.texts").alias("clause_no", "clause"))
    query(name, sql)(run)


def _unnest(where, arr, op):
    return V.oracle("items", f"""SELECT item_id, '{op}' AS operator, CAST(generate_subscripts(a, 1) - 1 AS INT) AS clause_no, unnest(a) AS clause
      FROM (SELECT item_id, {arr} AS a FROM items WHERE {where})""")


_rule_query("e5_diagnosis_medication", "diagnosis_medication", _unnest("text LIKE 'Has a diagnosis of%'", """[
    regexp_extract(text, '^(Has a diagnosis of .+?) or is receiving', 1), 'is receiving systemic steroid therapy ' || regexp_extract(text, '(within .+)$', 1),
    'is receiving corticosteroids ' || regexp_extract(text, '(within .+)$', 1)]""", "OR"))
_rule_query("e5_including_progression", "including_progression", _unnest("text LIKE '%, including disease progression%'", """[
    split_part(text, ', including ', 1), 'Have documented ' || split_part(text, ', including ', 2)]""", "AND"))
_rule_query("e5_progression_after", "progression_after", _unnest("text LIKE 'Documented disease progression after receiving%'", """[
    split_part(text, ' and at least', 1), 'Documented disease progression after receiving at least' || split_part(text, ' and at least', 2)]""", "AND"))
_rule_query("e5_following_types", "following_types", _unnest("text LIKE '%of the following types:%'", """[
    'Advanced melanoma , who' || split_part(text, ', who', 2), 'Advanced sarcoma (bone, soft tissue) , who' || split_part(text, ', who', 2), 'Advanced lymphoma , who' || split_part(text, ', who', 2)]""", "OR"))
_DOCUMENTED = "documented by histopathology and/or cytology"


@query("e5_labelled", f"""SELECT p_partkey AS item_id, 'AND' AS operator, 0 AS clause_no, p_name || ' breast cancer {_DOCUMENTED}' AS clause FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'AND', 1, 'HER2-positive ' || p_brand FROM part WHERE p_partkey % 2 = 0""")
def _(spark, sf):
    """Labelled sentences made of the parts: breast cancers and others, with and without the documentation."""
    V.register(spark, sf)
    d = spark.sql(f"""SELECT p_partkey AS item_id, 'Histopathology and/or cytology documented ' || p_type || ', including: a) ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' breast' ELSE ' lung' END || ' cancer' ||
        CASE WHEN p_partkey % 3 = 0 THEN ' {_DOCUMENTED}' ELSE '' END || '.; b) HER2-positive ' || p_brand AS text FROM part""")
    d = d.withColumn("r", N.RULES["labelled"](F.col("text"))).where(F.col("r").isNotNull())
    return d.select("item_id", F.col("r.operator").alias("operator"), F.posexplode("r.texts").alias("clause_no", "clause"))



@query("e5_decomposition", None)
def _(spark, sf):
    return N.decompose(N.split_items(docs(spark, sf))).select("doc_id", "item_no", "clause_no", "text", "logic_operator", "split_rule")


@query("e6_top_level_split", V.oracle("items", """SELECT item_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS part_no, unnest(a) AS part FROM (
       SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '\\([^)]*\\)', '', 'g'), ','), lambda x: trim(x, ' ,;')), lambda x: x <> '') AS a FROM items WHERE text NOT LIKE '%(%' OR text LIKE '%(oral and iv)%')"""))
def _(spark, sf):
    i = items(spark, sf).where(~F.col("text").contains("(") | F.col("text").contains("(oral and iv)"))
    return i.select("item_id", F.posexplode(N.split_commas(F.regexp_replace("text", r"\([^)]*\)", ""))).alias("part_no", "part"))


_BRACKETED = "text LIKE '%CYP3A4 inhibitors (except%' OR text LIKE '%sarcoma (bone, soft tissue)%'"


@query("e6_bracketed_commas", V.oracle("items", f"""SELECT item_id, CAST(CASE WHEN text LIKE '%sarcoma%' THEN 4 ELSE 1 END AS INT) AS n_parts FROM items WHERE {_BRACKETED}"""))
def _(spark, sf):
    return items(spark, sf).where(_BRACKETED).select("item_id", F.size(N.split_commas(F.col("text"))).alias("n_parts"))


# -------------------------------------------------------------------- tagging

_PHR = ", ".join(f"('{quoted(p)}', '{k}', '{lab}')" for p, k, lab in Dc.default_phrases())
_LEFT = "(st = 1 OR NOT regexp_matches(substr(text, st - 1, 1), '[A-Za-z0-9]'))"
_MENT = f"""phr(phrase, kind, label) AS (VALUES {_PHR}),
txt AS (SELECT DISTINCT text FROM items),
pos AS (SELECT text, phrase, kind, label, CASE kind WHEN 'exact' THEN strpos(text, phrase) WHEN 'lower' THEN strpos(lower(text), phrase)
      ELSE strpos(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), phrase) END AS st FROM txt, phr),
cand AS (SELECT text, st, st + length(phrase) AS en, label, len(regexp_extract_all(phrase, '[A-Za-z0-9]+')) AS words FROM pos
  WHERE st > 0 AND {_LEFT} AND NOT regexp_matches(substr(text, st + length(phrase), 1), '[A-Za-z0-9]')),
ment AS (SELECT text, st - 1 AS "start", en - 1 AS "end", substr(text, st, en - st) AS mention, label FROM cand a
  WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.text = a.text AND b.st < a.en AND a.st < b.en AND (b.words > a.words OR (b.words = a.words AND b.st < a.st))))"""


def _tagged(spark, sf):
    """Distinct texts are tagged once."""
    return G.tag(items(spark, sf).select("text").distinct(), Dc.phrase_table(spark))


@query("e8_dictionary_mentions", V.oracle_with("items", _MENT, 'SELECT text, CAST("start" AS INT) AS "start", CAST("end" AS INT) AS "end", mention, label FROM ment'))
def _(spark, sf):
    return _tagged(spark, sf).select("text", F.explode("mentions").alias("m")).select("text", "m.start", "m.end", F.col("m.text").alias("mention"), "m.label")


#: Words of the documents: common ones of four languages, licence and secret cues.
_DOC_PHRASES = [("the", "EN"), ("der", "DE"), ("les", "FR"), ("los", "ES"), ("licensed", "LICENCE"), ("license", "LICENCE"), ("password", "SECRET"), ("token", "SECRET")]


@query("e8_document_mentions", f"""WITH p(phrase, label) AS (VALUES {", ".join(f"('{p}', '{lab}')" for p, lab in _DOC_PHRASES)}),
w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))) AS word FROM documents)
SELECT doc_id, label, count(*) AS n FROM w JOIN p ON word = phrase GROUP BY doc_id, label""")
def _(spark, sf):
    """Mentions in the whole documents, counted by document and label."""
    V.register(spark, sf)
    phrases = spark.createDataFrame([(p, "lower", lab) for p, lab in _DOC_PHRASES], "phrase string, kind string, label string")
    d = spark.table("documents").select("doc_id", "text")
    return G.tag(d, phrases).select("doc_id", F.explode("mentions").alias("m")).groupBy("doc_id", "m.label").agg(F.count(F.lit(1)).alias("n"))


@query("e9_added_mentions", V.oracle("items", """SELECT DISTINCT text, regexp_extract(text, '(?i)(?:(?:at least|more than|no more than) )?\\d+ (?:days|weeks|months|years)(?: old| ago)?') AS mention FROM items
       WHERE regexp_matches(text, '\\d+ (days|weeks|months|years)') AND text NOT LIKE 'Recovered%'"""))
def _(spark, sf):
    d = items(spark, sf).select("text").distinct().where(~F.col("text").startswith("Recovered"))
    d = G.augment(d.withColumn("mentions", F.array().cast(f"array<{G.MENTION}>")))
    return each(d, F.col("mentions"), "at", "m").where(F.col("m.label") == "DATE").select("text", F.col("m.text").alias("mention"))


_ABBR = ", ".join(f"('{a}', '{quoted(e)}')" for a, e in Dc.default_abbreviations().items())


@query("e10_abbreviations", V.oracle_with("items", f"{_MENT},\nab(abbr, expansion) AS (VALUES {_ABBR})",
       "SELECT text, mention, expansion FROM ment JOIN ab ON abbr = lower(mention)"))
def _(spark, sf):
    d = G.expand_abbreviations(_tagged(spark, sf), Dc.default_abbreviations())
    return d.select("text", F.explode("mentions").alias("m")).where(F.col("m.expanded_text").isNotNull()).select(
        "text", F.col("m.text").alias("mention"), F.col("m.expanded_text").alias("expansion"))


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query("e11_redundant_mentions", V.oracle_with("items", f"{_MENT},\nmt AS (SELECT *, {_TOK.format('mention')} AS tk FROM ment)", """SELECT text, mention, label FROM mt a WHERE NOT EXISTS (
       SELECT 1 FROM mt b WHERE b.text = a.text AND len(b.tk) > len(a.tk) AND len(list_intersect(a.tk, b.tk)) = len(a.tk)
         AND ((a.label = 'DISEASE' AND b.label IN ('DISEASE', 'BIOMARKER')) OR (a.label = b.label AND a.label IN ('BIOMARKER', 'DRUG', 'LAB_TEST'))))"""))
def _(spark, sf):
    return G.suppress_redundant(_tagged(spark, sf)).select("text", F.explode("mentions").alias("m")).select(
        "text", F.col("m.text").alias("mention"), "m.label")


@query("e7_compound_split", V.oracle("items", """SELECT item_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS part_no, unnest(a) AS part FROM (
       SELECT item_id, ['* Has active ' || d || '', '* Has active hiv infection'] AS a FROM (SELECT item_id, regexp_extract(text, '^\\* Has active (.+) or hiv infection$', 1) AS d FROM items
         WHERE text LIKE '* Has active % or hiv infection'))"""))
def _(spark, sf):
    i = items(spark, sf)
    d = G.suppress_redundant(G.augment(G.tag(i, Dc.phrase_table(spark)))).withColumn("category", F.lit("diagnosis"))
    return each(d.select("item_id", X.compound_clauses().alias("p")), F.col("p"), "part_no", "part").drop("p")


# ---------------------------------------------------------------------- values

def _g(p, n, flags=""):
    return f"regexp_extract(text, '{flags}{quoted(p)}', {n})"


_SUP = "translate({0}, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789')"
_UN = lambda x: f"nullif(regexp_replace(trim({x}), '[.,;:]+$', ''), '')"
_QUANT = f"""SELECT *, CASE WHEN regexp_matches(text, '{quoted(P.SCIENTIFIC)}') THEN 1 WHEN regexp_matches(text, '{quoted(P.RANGE)}') THEN 2
      WHEN {rx(P.RANGE_WORDS)} THEN 3 WHEN {rx(P.WORD_COMPARISON)} THEN 4 WHEN regexp_matches(text, '{quoted(P.COMPARISON)}') THEN 5 END AS form FROM items"""


@query("e12_quantities", V.oracle("items", f"""SELECT item_id, CASE form WHEN 1 THEN CASE WHEN {_g(P.SCIENTIFIC, 1)} IN ('≤', '<=', '<') THEN 'lte' ELSE 'gte' END WHEN 2 THEN 'range' WHEN 3 THEN 'range'
       WHEN 4 THEN CASE WHEN lower({_g(P.WORD_COMPARISON, 1, '(?i)')}) IN ('at least', 'greater than', 'more than') THEN 'gte' ELSE 'lte' END ELSE CASE WHEN {_g(P.COMPARISON, 1)} IN ('≤', '<=', '<') THEN 'lte' ELSE 'gte' END END AS operator,
       CASE form WHEN 1 THEN TRY_CAST({_g(P.SCIENTIFIC, 2)} AS DOUBLE) * pow(10, TRY_CAST({_SUP.format(_g(P.SCIENTIFIC, 3))} AS INT)) WHEN 2 THEN TRY_CAST({_g(P.RANGE, 1)} AS DOUBLE) WHEN 3 THEN TRY_CAST({_g(P.RANGE_WORDS, 1, '(?i)')} AS DOUBLE)
         WHEN 4 THEN TRY_CAST({_g(P.WORD_COMPARISON, 2, '(?i)')} AS DOUBLE) ELSE TRY_CAST({_g(P.COMPARISON, 2)} AS DOUBLE) END AS value_low,
       CASE form WHEN 2 THEN TRY_CAST({_g(P.RANGE, 2)} AS DOUBLE) WHEN 3 THEN TRY_CAST({_g(P.RANGE_WORDS, 2, '(?i)')} AS DOUBLE) END AS value_high,
       CASE form WHEN 1 THEN {_UN(_g(P.SCIENTIFIC, 4))} WHEN 2 THEN {_UN(_g(P.RANGE, 3))} WHEN 3 THEN {_UN(_g(P.RANGE_WORDS, 3, '(?i)'))} WHEN 4 THEN {_UN(_g(P.WORD_COMPARISON, 3, '(?i)'))}
         ELSE CASE WHEN contains({_g(P.COMPARISON, 3)}, 'ULN') THEN '× ' ELSE '' END || {_UN(_g(P.COMPARISON, 3))} END AS unit FROM ({_QUANT}) WHERE form IS NOT NULL"""))
def _(spark, sf):
    return items(spark, sf).select("item_id", Vl.quantity(F.col("text")).alias("q")).where(F.col("q").isNotNull()).select(
        "item_id", "q.operator", "q.value_low", "q.value_high", "q.unit")


_TF = "CASE " + " ".join(f"WHEN {rx(p)} THEN {i}" for i, (p, _) in enumerate(P.TIMEFRAMES)) + " END"
_TFG = lambda n: "CASE f " + " ".join(f"WHEN {i} THEN {_g(p, n, '(?i)')}" for i, (p, _) in enumerate(P.TIMEFRAMES)) + " END"
_TFO = "CASE f " + " ".join(f"WHEN {i} THEN '{o}'" for i, (_, o) in enumerate(P.TIMEFRAMES)) + " END"


@query("e13_timeframes", V.oracle("items", f"""SELECT item_id, {_TFO} AS operator, CAST({_TFG(1)} AS DOUBLE) AS value, regexp_replace(lower({_TFG(2)}), 's+$', '') || 's' AS unit
       FROM (SELECT *, {_TF} AS f FROM items) WHERE f IS NOT NULL"""))
def _(spark, sf):
    return items(spark, sf).select("item_id", Vl.timeframe(F.col("text")).alias("t")).where(F.col("t").isNotNull()).select("item_id", "t.operator", "t.value", "t.unit")


_MAIN = f"CASE WHEN {rx(P.EXCEPTION)} THEN regexp_extract(text, '(?is)^(.*?){P.EXCEPTION}', 1) ELSE text END"
_MASK = f"regexp_replace(regexp_replace({_MAIN}, '(?i)\\bnot limited to\\b', '..............', 'g'), '(?i)\\bnot amenable to\\b', '...............', 'g')"
_NEGP = f"CASE WHEN {rx(P.NEGATION, 'mk')} THEN length(regexp_extract(mk, '(?is)^(.*?){P.NEGATION}', 1)) END"


@query("e14_negation", V.oracle("items", f"SELECT item_id, {_NEGP} AS negation_start FROM (SELECT *, {_MASK} AS mk FROM items)"))
def _(spark, sf):
    return items(spark, sf).select("item_id", Vl.negation_start(F.col("text")).alias("negation_start"))


@query("e14_negated_mentions", V.oracle_with("items", f"{_MENT},\nng AS (SELECT text, {_NEGP} AS p FROM (SELECT text, {_MASK} AS mk FROM txt))",
       """SELECT m.text, m.mention FROM ment m JOIN ng USING (text) WHERE p IS NOT NULL AND ("start" >= p OR NOT EXISTS (SELECT 1 FROM ment o WHERE o.text = m.text AND o."start" >= p))"""))
def _(spark, sf):
    return _tagged(spark, sf).select("text", F.explode(Vl.negated_mentions(F.col("text"), F.col("mentions"))).alias("mention"))


@query("e15_exception_split", V.oracle("items", f"SELECT item_id, trim(regexp_extract(text, '(?is)^.*?{P.EXCEPTION}(.*)$', 1)) AS exception_text FROM items WHERE {rx(P.EXCEPTION)}"))
def _(spark, sf):
    return items(spark, sf).select("item_id", Vl.exception_text(F.col("text")).alias("exception_text")).where(F.col("exception_text").isNotNull())


@query("e16_logic_operator", V.oracle("items", f"SELECT item_id, CASE WHEN {rx(P.OR_WORD)} OR {rx(P.AND_OR)} THEN 'OR' ELSE 'AND' END AS logic_operator FROM items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", Vl.logic_operator(F.col("text")).alias("logic_operator"))


# -------------------------------------------------------------- classification

_SIG = ", ".join(f"{rx(p)} AS {n}" for n, p in C.SIGNALS.items()) + ", " + ", ".join(f"{first_case(r)} AS {n}" for n, r in C.FLAG_SETS.items())
_TEXT_CAT = """CASE WHEN s_age THEN 'age' WHEN v_admin IS NOT NULL THEN 'administrative_requirement' WHEN v_behavior IS NOT NULL THEN 'behavioral_constraint'
    WHEN v_repro IS NOT NULL THEN 'reproductive_status' WHEN v_device IS NOT NULL THEN 'device_constraint' WHEN s_cns THEN 'cns_metastases'
    WHEN s_procedure THEN 'procedural_requirement' WHEN s_status AND NOT s_prior THEN 'disease_status' WHEN s_current THEN 'diagnosis' WHEN s_line THEN 'line_of_therapy'
    WHEN s_prior THEN 'prior_therapy' WHEN s_stage THEN 'disease_stage' WHEN s_histology THEN 'histology' WHEN s_vaccine OR s_steroid OR s_immuno THEN 'concomitant_medication'
    WHEN s_molecular THEN 'molecular_alteration' WHEN s_concomitant OR s_cyp THEN 'concomitant_medication' WHEN s_organ THEN 'organ_function' ELSE 'other' END"""
_DIAG = """(nd > 0 AND NOT s_numstage AND NOT s_tnm AND nb = 0 AND (s_current OR s_diagnosis OR (s_confirmed AND NOT s_anchor) OR (nd >= 2 AND NOT s_anchor) OR (s_hint AND (NOT s_anchor OR s_confirmed))))"""
_MENT_CAT = f"""CASE WHEN s_age THEN 'age' WHEN {_DIAG} THEN 'diagnosis' WHEN v_admin IS NOT NULL THEN 'administrative_requirement' WHEN v_behavior IS NOT NULL THEN 'behavioral_constraint'
    WHEN v_repro IS NOT NULL THEN 'reproductive_status' WHEN v_device IS NOT NULL THEN 'device_constraint' WHEN s_cns THEN 'cns_metastases' WHEN s_line THEN 'line_of_therapy'
    WHEN s_procedure THEN 'procedural_requirement' WHEN s_vaccine OR s_concomitant OR s_cyp OR s_steroid OR s_immuno THEN 'concomitant_medication'
    WHEN s_status AND NOT (ndr > 0 OR s_prior) THEN 'disease_status' WHEN nb > 0 AND s_molecular THEN 'molecular_alteration' WHEN s_current THEN 'diagnosis'
    WHEN (nb > 0 AND s_targeted) OR s_prior OR ndr > 0 THEN 'prior_therapy' WHEN s_stage THEN 'disease_stage' WHEN s_histology THEN 'histology' WHEN np > 0 THEN 'performance_status'
    WHEN nb > 0 THEN 'biomarker' WHEN s_molecular THEN 'molecular_alteration' WHEN nl > 0 THEN 'lab_value' WHEN nd > 0 THEN 'diagnosis' ELSE cat_text END"""
_SIGS = f"sg AS (SELECT *, {_TEXT_CAT} AS cat_text FROM (SELECT text, {_SIG} FROM (SELECT DISTINCT text FROM items)))"
_DICT = f"""{_MENT},
{_SIGS},
cnt AS (SELECT sg.*, coalesce(nm, 0) AS nm, coalesce(nd, 0) AS nd, coalesce(ndr, 0) AS ndr, coalesce(nb, 0) AS nb, coalesce(nl, 0) AS nl, coalesce(np, 0) AS np FROM sg LEFT JOIN (
  SELECT text, count(*) AS nm, count(*) FILTER (WHERE label = 'DISEASE') AS nd, count(*) FILTER (WHERE label = 'DRUG') AS ndr, count(*) FILTER (WHERE label = 'BIOMARKER') AS nb,
    count(*) FILTER (WHERE label = 'LAB_TEST') AS nl, count(*) FILTER (WHERE label = 'PERF_SCALE') AS np FROM ment GROUP BY text) USING (text)),
cls AS (SELECT *, CASE WHEN nm > 0 THEN {_MENT_CAT} ELSE cat_text END AS category FROM cnt)"""


def _signals(spark, sf, tagged: bool):
    d = _tagged(spark, sf) if tagged else items(spark, sf).select("text").distinct().withColumn("mentions", F.array().cast(f"array<{G.MENTION}>"))
    return C.add_label_counts(C.add_signals(d))


@query("e17_category_with_mentions", V.oracle_with("items", _DICT, "SELECT text, category FROM cls"))
def _(spark, sf):
    return C.add_category(_signals(spark, sf, True)).select("text", "category")


@query("e18_category_from_text", V.oracle_with("items", _SIGS, "SELECT text, cat_text AS category FROM sg"))
def _(spark, sf):
    return _signals(spark, sf, False).select("text", C.category_from_text().alias("category"))


@query("e18_document_categories", f"""WITH ln AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM conversations),
sg AS (SELECT *, {_TEXT_CAT} AS cat_text FROM (SELECT text, {_SIG} FROM ln)) SELECT cat_text AS category, count(*) AS n FROM sg GROUP BY 1""")
def _(spark, sf):
    V.register(spark, sf)
    d = spark.table("conversations").select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    return C.add_signals(d).select(C.category_from_text().alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("e19_diagnosis_primary", V.oracle_with("items", _DICT, f"SELECT text, {_DIAG} AS is_primary FROM cnt"))
def _(spark, sf):
    return _signals(spark, sf, True).select("text", C.diagnosis_primary().alias("is_primary"))


_POLICY = """CASE WHEN cat_text IN ('histology', 'diagnosis', 'cns_metastases', 'disease_stage', 'disease_status', 'procedural_requirement', 'administrative_requirement',
      'behavioral_constraint', 'reproductive_status', 'device_constraint', 'prior_therapy', 'line_of_therapy') THEN 'parsed|0.6|false'
    WHEN cat_text = 'concomitant_medication' THEN CASE WHEN s_complex AND NOT (s_vaccine OR s_steroid OR s_cyp) THEN 'partial|0.3|true' ELSE 'parsed|0.6|false' END
    WHEN cat_text = 'organ_function' AND NOT s_organ_complex THEN 'parsed|0.6|false' WHEN s_hyper THEN 'partial|0.6|false' WHEN cat_text = 'other' THEN 'unparsed|0.0|true' ELSE 'partial|0.3|true' END"""


@query("e20_text_only_policy", V.oracle_with("items", _SIGS, f"SELECT text, {_POLICY} AS policy FROM sg"))
def _(spark, sf):
    d = C.add_category(_signals(spark, sf, False)).withColumn("p", C.text_only_policy())
    return d.select("text", F.concat_ws("|", "p.parse_status", F.col("p.base").cast("string"), F.col("p.review").cast("string")).alias("policy"))


@query("e21_patient_flags", V.oracle_with("items", _SIGS, "SELECT text, v_admin, v_behavior, v_repro, v_device FROM sg"))
def _(spark, sf):
    return _signals(spark, sf, False).select("text", "v_admin", "v_behavior", "v_repro", "v_device")


_WORD = f"""CASE WHEN {rx(P.LIVE_VACCINE)} THEN lower({_g(P.LIVE_VACCINE, 0, '(?i)')}) WHEN {rx(P.VACCINE)} THEN lower({_g(P.VACCINE, 0, '(?i)')}) WHEN {rx(P.CYP)} THEN 'cyp3a4 inhibitors/inducers'
    WHEN {rx(P.CORTICOSTEROID)} THEN lower({_g(P.CORTICOSTEROID, 0, '(?i)')}) WHEN {rx(P.IMMUNOSUPPRESSIVE)} THEN lower({_g(P.IMMUNOSUPPRESSIVE, 0, '(?i)')}) END"""


@query("e22_value_text", V.oracle_with("items", _SIGS, f"""SELECT text, CASE cat_text WHEN 'administrative_requirement' THEN v_admin WHEN 'behavioral_constraint' THEN v_behavior WHEN 'reproductive_status' THEN v_repro
       WHEN 'device_constraint' THEN v_device WHEN 'concomitant_medication' THEN {_WORD} WHEN 'disease_status' THEN lower({_g(P.DISEASE_STATUS, 0, '(?i)')})
       WHEN 'disease_stage' THEN lower({_g(P.STAGE_VALUE, 1, '(?i)')})
       WHEN 'prior_therapy' THEN CASE WHEN {rx(P.THERAPY_FIRST)} THEN lower({_g(P.THERAPY_FIRST, 0, '(?i)')}) WHEN {rx(P.THERAPY_LAST)} THEN lower({_g(P.THERAPY_LAST, 0, '(?i)')}) END
       WHEN 'line_of_therapy' THEN CASE WHEN {rx(P.THERAPY_LAST)} THEN lower({_g(P.THERAPY_LAST, 0, '(?i)')}) END END AS value_text FROM sg"""))
def _(spark, sf):
    return C.add_category(_signals(spark, sf, False)).select("text", C.semantic_value().alias("value_text"))


def _medication(spark, sf):
    d = C.add_category(_signals(spark, sf, True))
    t = F.col("text")
    return C.add_medication(d.withColumn("exception_text", Vl.exception_text(t)).withColumn("timeframe", Vl.timeframe(t)))


_MED = f"""{_DICT},
med AS (SELECT text, trim(regexp_extract(text, '(?is)^.*?{P.EXCEPTION}(.*)$', 1)) AS exc, {_TF} IS NOT NULL AS timed FROM cls WHERE category = 'concomitant_medication'),
drugs AS (SELECT med.text, count(*) FILTER (WHERE "start" >= strpos(lower(med.text), lower(exc)) - 1) AS n_exc FROM med JOIN ment USING (text) WHERE label = 'DRUG' AND exc <> '' GROUP BY med.text)"""


@query("e23_medication_semantics", V.oracle_with("items", _MED, f"""SELECT text, CASE WHEN {rx(P.PHYSIOLOGIC, "text || ' ' || exc")} THEN 'prohibited_with_allowance' WHEN coalesce(n_exc, 0) > 0 AND NOT {rx(P.PHYSIOLOGIC, 'exc')} THEN 'prohibited_with_exception'
       WHEN timed THEN 'washout_window' ELSE 'restriction' END AS mode, CASE WHEN {rx(P.PHYSIOLOGIC, 'exc')} THEN 0 ELSE coalesce(n_exc, 0) END AS n_exceptions FROM med LEFT JOIN drugs USING (text)
       WHERE {_WORD} IS NOT NULL OR text IN (SELECT text FROM ment WHERE label = 'DRUG')"""))
def _(spark, sf):
    return _medication(spark, sf).where(F.col("exception_logic").isNotNull()).select(
        "text", F.col("exception_logic.mode").alias("mode"), F.size("exception_entities").alias("n_exceptions"))


_INCLUDING = rx("\\bincluding\\b")


@query("e24_review_gate", V.oracle_with("items", _DICT, f"""SELECT text, ((nb > 0 OR s_molecular) AND (s_stage OR s_tnm))
       OR (category IN ('prior_therapy', 'line_of_therapy') AND {_INCLUDING} AND len(regexp_extract_all(text, '(?i){P.AT_LEAST_COUNT}')) >= 2)
       OR (category = 'cns_metastases' AND s_allow AND s_cns)
       OR (s_complex AND NOT (category = 'concomitant_medication' AND ({_WORD} IS NOT NULL OR ndr > 0)) AND (nm <> 1 OR category = 'molecular_alteration')) AS gated FROM cls"""))
def _(spark, sf):
    return _medication(spark, sf).select("text", C.review_gate().alias("gated"))


@query("e25_context_facets", V.oracle("items", f"""SELECT DISTINCT text, {first_case(P.SPECIMENS)} AS specimen_type, {first_case(P.MODALITIES)} AS testing_modality,
       CASE WHEN {rx(P.NSCLC)} THEN 'non-small cell' WHEN {rx(P.SCLC)} THEN 'small cell' END AS disease_subtype,
       nullif(array_to_string(list_distinct(list_sort(regexp_extract_all(lower(text), '{P.HISTOLOGY_VALUE}'))), ', '), '') AS histology_text FROM items"""))
def _(spark, sf):
    d = C.add_context(_medication(spark, sf))
    return d.select("text", F.get("specimen_types", 0).alias("specimen_type"), F.get("testing_modalities", 0).alias("testing_modality"), "disease_subtype", "histology_text")


@query("e26_confidence", None)
def _(spark, sf):
    d = items(spark, sf).select("text").distinct().withColumn("key", F.xxhash64("text"))
    t = G.mentions_of(d, Dc.phrase_table(spark), Dc.default_abbreviations())
    return C.classify(t, ["key"]).select("text", "path", "category", "parse_status", F.round("confidence", 6).alias("confidence"))


@query("e27_age_from_timeframe", V.oracle("items", """SELECT DISTINCT text, 'gte' AS operator, CAST(regexp_extract(text, 'at least (\\d+) years', 1) AS DOUBLE) AS value_low, 'years' AS unit
       FROM items WHERE text LIKE 'Patients must be at least % years old.'"""))
def _(spark, sf):
    d = items(spark, sf).select("text").distinct().withColumn("key", F.xxhash64("text"))
    t = C.classify(G.mentions_of(d, Dc.phrase_table(spark), Dc.default_abbreviations()), ["key"])
    return t.where((F.col("category") == "age") & F.col("timeframe_unit").isNull() & (F.col("operator") == "gte") & F.col("text").startswith("Patients must")).select(
        "text", "operator", "value_low", "unit")


@query("e28_extraction", None)
def _(spark, sf):
    return X.extract(docs(spark, sf)).select(
        "doc_id", "ord", "original_text", "type", "category", "parse_status", "operator", "value_low", "value_high", "value_text", "unit", "negated",
        "timeframe_operator", "timeframe_value", "timeframe_unit", "logic_operator", F.round("confidence", 6).alias("confidence"), "review_required", "review_reason")
