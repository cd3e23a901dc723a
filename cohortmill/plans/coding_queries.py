"""Registered terminology-coding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.functions import text as T
from cohortmill.functions.scale import each, stage
from cohortmill.operators import coding as K
from cohortmill.plans import views as V
from cohortmill.plans.registry import query
from cohortmill.sources import dictionaries as Dc


def lookups(spark, sf):
    c = V.table(spark, sf, "catalogue")
    return c.select("system", "code", "display", F.array("syn1", "syn2").alias("synonyms"), "place")


def mentions(spark, sf):
    m = V.table(spark, sf, "mentions")
    none = F.lit(None).cast("string")
    return m.withColumn("variants", K.lookup_variants(F.col("text"), none, F.array().cast("array<string>")))


def requests(spark, sf):
    """Distinct lookups of all mentions."""
    return stage(mentions(spark, sf).select("label", "variants", "fuzzy").distinct().withColumn(
        "request_id", F.sha1(F.concat_ws("|", "label", F.array_join("variants", "~"), F.col("fuzzy").cast("string")))))


def asked(spark, sf):
    return K._with_systems(requests(spark, sf), V.CODE_SYSTEMS)


_ALNUM = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
NORM = lambda x: _ALNUM(f"regexp_replace(replace(lower({x}), '+', ' positive '), '([a-z0-9_])-(\\s|$)', '\\1 negative \\2', 'g')")
CNORM = lambda x: _ALNUM(f"replace(lower({x}), '+', ' positive ')")
STRIPPED = lambda x: f"trim(regexp_replace(regexp_replace({x}, '(?i)\\s*\\((?:[a-z0-9][a-z0-9\\-/ ]{{0,15}})\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_TRI = lambda x: f"""list_distinct(flatten(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
_INF = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP})))"
# Words after a leading "non": the derived texts put it first or not at all.
_NEG = lambda x: f"CASE WHEN {x} LIKE 'non %' THEN list_distinct([array_to_string(string_split({x}, ' ')[2:2], ' '), array_to_string(string_split({x}, ' ')[2:3], ' '), array_to_string(string_split({x}, ' ')[2:4], ' ')]) ELSE [] END"

_BASE = f"""req AS (SELECT DISTINCT label, text, fuzzy FROM mentions),
var AS (SELECT DISTINCT label, text, fuzzy, n AS variant_no, v FROM (SELECT *, 0 AS n, trim(text) AS v FROM req UNION ALL SELECT *, 1, {STRIPPED('text')} FROM req WHERE {STRIPPED('text')} <> trim(text))),
sys(label, system, sr) AS (VALUES {', '.join(f"('{lab}', '{s}', {i})" for lab, names in V.CODE_SYSTEMS.items() for i, s in enumerate(names))}),
nq AS (SELECT DISTINCT {NORM('v')} AS nv FROM var),
q AS (SELECT var.*, system, sr, {NORM('v')} AS nv FROM var JOIN sys USING (label)),
ctext AS (SELECT system, code, display, 0 AS k, display AS t FROM catalogue UNION ALL SELECT system, code, display, 1, syn1 FROM catalogue UNION ALL SELECT system, code, display, 2, syn2 FROM catalogue),
ex AS (SELECT q.*, c.code, c.display, 1 AS tier, 0.0 AS score FROM q JOIN catalogue c ON c.system = q.system AND {CNORM('c.display')} = q.nv),
qf AS (SELECT DISTINCT q.*, unnest([v, lower(v), nv, {STRIPPED('v')}, lower({STRIPPED('v')}), {NORM(STRIPPED('v'))}, trim(regexp_replace(translate(v, '/_', '  '), '\\s+', ' ', 'g')),
    lower(trim(regexp_replace(translate(v, '/_', '  '), '\\s+', ' ', 'g')))]) AS form FROM q),
syn AS (SELECT DISTINCT qf.* EXCLUDE (form), c.code, c.display, 2 AS tier, 0.0 AS score FROM qf JOIN ctext c ON c.system = qf.system AND c.k > 0 AND c.t = qf.form)"""
_ORD = "ORDER BY tier, variant_no, score, sr, lower(display), lower(code)"
_ONE = lambda src: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, text, fuzzy {_ORD}) AS rn FROM {src}) WHERE rn = 1)"
_FZ = f"""{_BASE},
direct AS {_ONE('(SELECT * FROM ex UNION ALL SELECT * FROM syn)')},
left_q AS (SELECT q.* FROM q LEFT JOIN direct d ON d.label = q.label AND d.text = q.text AND d.fuzzy = q.fuzzy WHERE d.text IS NULL AND q.fuzzy),
ct AS (SELECT *, {CNORM('t')} AS cn, {NORM('t')} AS qn FROM ctext),
un AS (SELECT DISTINCT system, nv, {_TRI('nv')} AS qt FROM left_q),
uc AS (SELECT DISTINCT system, cn, {_TRI('cn')} AS ctri FROM ct),
sim AS (SELECT system, nv, cn, len(list_intersect(qt, ctri)) / (len(qt) + len(ctri) - len(list_intersect(qt, ctri))) AS s FROM un JOIN uc USING (system)),
ci AS (SELECT DISTINCT system, code, qn, {_INF('qn')} AS ctok, {_NEG('qn')} AS cneg FROM ct),
qi AS (SELECT DISTINCT system, nv, {_INF('nv')} AS qtok, {_NEG('nv')} AS qneg FROM left_q),
via AS (SELECT DISTINCT qi.system, nv, code, qn FROM qi JOIN ci USING (system) WHERE len(list_intersect(qtok, ctok)) > 0 AND (len(ctok) <= 2 OR len(list_intersect(qtok, ctok)) * 2 >= len(ctok))
    AND NOT coalesce(list_bool_or(list_transform(qneg, lambda p: contains(' ' || qn || ' ', ' ' || p || ' ') AND NOT list_contains(cneg, p))), FALSE)
    AND NOT coalesce(list_bool_or(list_transform(cneg, lambda p: contains(' ' || nv || ' ', ' ' || p || ' ') AND NOT list_contains(qneg, p))), FALSE)),
best AS (SELECT system, nv, code, any_value(display) AS display, max(s) AS s FROM (SELECT DISTINCT sim.system, nv, code, display, s FROM sim JOIN ct ON ct.system = sim.system AND ct.cn = sim.cn WHERE s >= 0.55 - 1e-12) GROUP BY 1, 2, 3),
tri AS (SELECT l.*, b.code, b.display, 3 AS tier, -b.s AS score FROM left_q l JOIN best b ON b.system = l.system AND b.nv = l.nv JOIN (SELECT DISTINCT system, nv, code FROM via) w ON w.system = b.system AND w.nv = b.nv AND w.code = b.code),
tri1 AS {_ONE('tri')},
left_2 AS (SELECT l.* FROM left_q l LEFT JOIN tri1 t ON t.label = l.label AND t.text = l.text WHERE t.text IS NULL),
ed AS (SELECT l.*, ct.code, ct.display, 4 AS tier, CAST(levenshtein(l.nv, ct.qn) AS DOUBLE) AS score FROM left_2 l JOIN ct ON ct.system = l.system AND abs(length(l.nv) - length(ct.qn)) <= 2 AND levenshtein(l.nv, ct.qn) <= 2
  WHERE EXISTS (SELECT 1 FROM via w WHERE w.system = l.system AND w.nv = l.nv AND w.code = ct.code AND (ct.k = 0 OR w.qn = ct.qn)))"""
NV = "mentions catalogue"


@query("k1_normalised_texts", V.oracle(NV, f"SELECT mention_id, {NORM('text')} AS lookup_norm, {CNORM('text')} AS catalogue_norm, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS term FROM mentions"))
def _(spark, sf):
    m = V.table(spark, sf, "mentions")
    return m.select("mention_id", T.normalize_lookup(F.col("text")).alias("lookup_norm"), T.normalize_catalogue(F.col("text")).alias("catalogue_norm"), T.normalize_term(F.col("text")).alias("term"))


@query("k2_lookup_variants", V.oracle_with(NV, _BASE, "SELECT DISTINCT label, text, CAST(variant_no AS INT) AS variant_no, v AS variant FROM var"))
def _(spark, sf):
    return mentions(spark, sf).select("label", "text", F.posexplode("variants").alias("variant_no", "variant")).distinct()


_CODABLE = " OR ".join(f"(category = '{c}' AND label = '{lab}')" for c, lab in K.CODABLE.items())


@query("k3_codable_mentions", V.oracle("criteria mentions", f"""SELECT mention_id, category, label FROM (SELECT m.mention_id, c.category, m.label, m.text, c.exception_entity FROM mentions m JOIN criteria c ON c.criterion_id = m.mention_id)
       WHERE ({_CODABLE}) AND NOT (category = 'concomitant_medication' AND coalesce({CNORM('text')} = {CNORM('exception_entity')}, FALSE))"""))
def _(spark, sf):
    c = V.criteria(spark, sf).select(F.col("criterion_id").alias("mention_id"), "category", "exception_entities")
    m = V.table(spark, sf, "mentions").join(c, "mention_id")
    return m.where(K.should_code(F.col("category"), F.col("label"), F.col("text"), F.col("exception_entities"))).select("mention_id", "category", "label")


def _tier_sql(src):
    return V.oracle_with(NV, _BASE, f"SELECT DISTINCT label, v AS variant, system, code, display FROM {src} JOIN (SELECT 1) ON TRUE")


def _tier(name, fn, src):
    def run(spark, sf):
        a = requests(spark, sf)
        q = K._with_systems(a, V.CODE_SYSTEMS).join(a.select("request_id", "label"), "request_id")
        return fn(q, K.catalogue_index(lookups(spark, sf))).select("label", "variant", "system", "code", "display").distinct()
    query(name, _tier_sql(src))(run)


_tier("k4_exact_codes", K.exact_matches, "ex")
_tier("k5_synonym_codes", K.synonym_matches, "syn")


@query("k6_trigram_pairs", V.oracle_with(NV, _FZ, "SELECT system, nv AS norm, cn AS cand, round(s, 6) AS similarity FROM sim WHERE s >= 0.55 - 1e-12"))
def _(spark, sf):
    q, index = _leftovers(spark, sf)
    texts = F.concat(F.array("display"), F.col("synonyms"))
    c = index.select("system", F.explode(texts).alias("one")).select("system", T.normalize_catalogue(F.col("one")).alias("cand"))
    return K.trigram_pairs(q.select("system", T.normalize_lookup(F.col("variant")).alias("norm")), c).withColumn("similarity", F.round("similarity", 6))


def _leftovers(spark, sf):
    index = K.catalogue_index(lookups(spark, sf))
    a = stage(asked(spark, sf))
    d = K._best(K.exact_matches(a, index).select(*K._COLS).unionByName(K.synonym_matches(a, index).select(*K._COLS)))
    return stage(a.where("fuzzy").join(d.select("request_id"), "request_id", "left_anti")), index


@query("k7_edit_distance_codes", V.oracle_with(NV, _FZ, "SELECT DISTINCT nv AS norm, system, code, score FROM ed"))
def _(spark, sf):
    q, index = _leftovers(spark, sf)
    near = K._best(K.trigram_matches(q, index).select(*K._COLS))
    rest = q.join(near.select("request_id"), "request_id", "left_anti")
    e = K.edit_matches(rest, index)
    names = rest.select("request_id", "variant_no", T.normalize_lookup(F.col("variant")).alias("norm")).distinct()
    return e.join(names, ["request_id", "variant_no"]).select("norm", "system", "code", "score").distinct()


@query("k8_viable_candidates", V.oracle_with(NV, _FZ, "SELECT DISTINCT b.system, b.nv AS norm, b.code FROM best b JOIN via w ON w.system = b.system AND w.nv = b.nv AND w.code = b.code"))
def _(spark, sf):
    q, index = _leftovers(spark, sf)
    t = K.trigram_matches(q, index)
    names = q.select("request_id", "variant_no", "system", T.normalize_lookup(F.col("variant")).alias("norm")).distinct()
    return t.join(names, ["request_id", "variant_no", "system"]).select("system", "norm", "code").distinct()


@query("k9_negated_phrases", V.oracle_with(NV, _BASE, f"""SELECT DISTINCT norm, phrase FROM (
  SELECT nv AS norm, array_to_string(ws[i + 1:i + k], ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3]) AS k FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT nv, string_split(nv, ' ') AS ws FROM nq)))
  WHERE ws[i] = 'non' AND i + k <= len(ws) AND len(list_filter(ws[i + 1:i + k], lambda x: x NOT IN ({_STOP}))) > 0
  UNION ALL SELECT nv, substr(w, 4) FROM (SELECT nv, unnest(string_split(nv, ' ')) AS w FROM nq) WHERE starts_with(w, 'non') AND length(w) > 4 AND substr(w, 4) NOT IN ({_STOP}))"""))
def _(spark, sf):
    # equal texts have equal variants: they are read once
    m = V.table(spark, sf, "mentions").select("text").distinct()
    v = each(m.select(K.lookup_variants(F.col("text"), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("vs")), F.col("vs"), "at", "v")
    n = v.select(T.normalize_lookup(F.col("v")).alias("norm")).distinct()
    return each(n.select("norm", K.negated_phrases(F.col("norm")).alias("ps")), F.col("ps"), "at", "phrase").select("norm", "phrase")


_TIERED = f"""{_FZ},
found AS (SELECT * FROM direct UNION ALL SELECT * FROM tri1 UNION ALL SELECT * FROM {_ONE('ed')})"""


@query("k10_coded_mentions", V.oracle_with(NV, _TIERED, """SELECT m.mention_id, f.system, f.code, f.display, CASE f.tier WHEN 1 THEN 'exact' WHEN 2 THEN 'synonym' WHEN 3 THEN 'fuzzy' WHEN 4 THEN 'fuzzy' END AS match_type,
       CASE f.tier WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.6 WHEN 4 THEN 0.6 ELSE CASE WHEN m.label = 'OTHER' THEN 0.0 ELSE 0.4 END END AS confidence,
       m.label <> 'OTHER' AND (f.tier IS NULL OR f.tier > 2) AS review_required
       FROM mentions m LEFT JOIN found f ON f.label = m.label AND f.text = m.text AND f.fuzzy = m.fuzzy"""))
def _(spark, sf):
    return K.code_mentions(mentions(spark, sf), lookups(spark, sf), V.CODE_SYSTEMS).select(
        "mention_id", "system", "code", "display", "match_type", "confidence", "review_required")


def _tagged_items(spark, sf):
    from cohortmill.operators import tagging as G

    d = V.table(spark, sf, "items").select("text").distinct()
    return G.mentions_of(d, Dc.phrase_table(spark), Dc.default_abbreviations())


@query("k11_alias_context", V.oracle("items", """SELECT DISTINCT text, 'PD-1/PD-L1 inhibitor therapy' AS mention, 'pd-1/pd-l1 inhibitor therapy' AS variant FROM items WHERE text LIKE 'Has received PD-1%'
       UNION SELECT DISTINCT text, 'KRAS inhibitor', 'kras-targeted therapy' FROM items WHERE text LIKE 'Has received PD-1%'"""))
def _(spark, sf):
    d = _tagged_items(spark, sf).select("text", "mentions", F.explode("mentions").alias("m"))
    return d.select("text", F.col("m.text").alias("mention"), F.explode(K.alias_context(F.col("text"), F.col("m"), F.col("mentions"))).alias("variant"))


@query("k12_therapy_class", V.oracle("items", """SELECT DISTINCT text, CASE WHEN text LIKE 'Has received PD-1%' THEN 'pd-1/pd-l1 inhibitor therapy' END AS therapy_class FROM items"""))
def _(spark, sf):
    return V.table(spark, sf, "items").select("text").distinct().select("text", K.therapy_class(F.col("text")).alias("therapy_class"))


def _coded(spark, sf):
    m = K.code_mentions(mentions(spark, sf), lookups(spark, sf), V.CODE_SYSTEMS)
    # variants and keys of a mention are as long as its text; they end here
    return stage(m.select(
        "criterion_id", "mention_no", "label", "system", "code", "display", "match_type", "confidence", "review_required", "review_reason",
        F.lit("diagnosis").alias("category"), F.col("text").alias("source"), F.lit(False).alias("has_exception")))


_CODED = f"""{_TIERED},
cm AS (SELECT m.criterion_id, m.mention_no, m.label, f.system, f.code, f.display, f.tier, CASE f.tier WHEN 3 THEN 0.6 WHEN 4 THEN 0.6 ELSE 0.4 END AS cf
  FROM mentions m LEFT JOIN found f ON f.label = m.label AND f.text = m.text AND f.fuzzy = m.fuzzy)"""


@query("k13_concept_dedupe", V.oracle_with(NV, _CODED, """SELECT criterion_id, system, code, CASE min(tier) WHEN 1 THEN 'exact' WHEN 2 THEN 'synonym' ELSE 'fuzzy' END AS match_type FROM cm
       WHERE code IS NOT NULL GROUP BY criterion_id, system, code"""))
def _(spark, sf):
    return K.dedupe_concepts(_coded(spark, sf)).select("criterion_id", "system", "code", "match_type")


# The fold in order, unrolled: criteria of the derived view have at most five coded mentions.
_FOLDED = f"""{_CODED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY criterion_id ORDER BY mention_no) AS n FROM cm WHERE label <> 'OTHER'),
f0 AS (SELECT DISTINCT criterion_id, CAST(0.7 AS DOUBLE) AS c FROM cm),
""" + ",\n".join(f"""f{i} AS (SELECT f.criterion_id, CASE o.tier WHEN 1 THEN greatest(c, 0.9) WHEN 2 THEN greatest(c, 0.82) WHEN 3 THEN least(c, 0.6) WHEN 4 THEN least(c, 0.6)
    ELSE CASE WHEN o.n IS NULL THEN c ELSE least(c, 0.4) END END AS c FROM f{i - 1} f LEFT JOIN ordered o ON o.criterion_id = f.criterion_id AND o.n = {i})""" for i in range(1, 6))


@query("k14_coding_merge", V.oracle_with(NV, _FOLDED, """SELECT criterion_id, any_value(c) AS confidence, bool_or(label <> 'OTHER' AND coalesce(tier, 3) > 2) AS review_required,
       CASE WHEN bool_or(tier IS NULL AND label <> 'OTHER') AND bool_or(tier > 2) THEN 'mixed_coding_review' WHEN bool_or(tier IS NULL AND label <> 'OTHER') THEN 'uncoded_entity' WHEN bool_or(tier > 2) THEN 'fuzzy_match' END AS review_reason
       FROM cm JOIN f5 USING (criterion_id) GROUP BY criterion_id"""))
def _(spark, sf):
    coded = _coded(spark, sf)
    criteria = coded.select("criterion_id").distinct().select(
        "criterion_id", F.lit("diagnosis").alias("category"), F.lit(0.7).alias("confidence"), F.lit(False).alias("review_required"), F.lit(None).cast("string").alias("review_reason"))
    return K.merge_coding(criteria, coded).select("criterion_id", "confidence", "review_required", "review_reason")
