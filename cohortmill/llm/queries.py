"""Registered queries of the numbered operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.ship import ship
from cohortmill.llm import context_tree, decontaminate, licences, minhash, mixing, neighbours, prefix_trie, quality, secret_scan, sharding, substrings, token_pairs, urls
from cohortmill.llm.rows import text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URL_LIMIT, URL_Z = 0.5, 1.645


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _shrink_sql(name: str, groups: str, parent: str, keys: str) -> str:
    """CTEs of one shrinkage level: ``groups`` has n, bad and ``parent`` (the parent's mean)."""
    return f"""
{name}_fit AS (
  SELECT CASE WHEN sum(n * (n - 1) * {parent} * (1 - {parent})) > 0
    THEN greatest(0.0001, least(0.5, sum((bad - n * {parent}) * (bad - n * {parent}) - n * {parent} * (1 - {parent})) / sum(n * (n - 1) * {parent} * (1 - {parent}))))
    ELSE 0.5 END AS rho FROM {groups}),
{name}_k AS (SELECT greatest(1.0, least(10000.0, 1 / CAST(rho AS DOUBLE) - 1)) AS k FROM {name}_fit),
{name} AS (SELECT {keys}, (bad + k * {parent}) / (n + k) AS mean, k + n AS strength FROM {groups}, {name}_k)"""


_RULES_SQL = " ".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{verdict}:{rule}'"
    for verdict, rule in sorted(URL_RULES, key=lambda r: -len(r[1])) for name, _, rest in [rule.partition("/")]
)
_TWO_SQL = ", ".join(f"'{s}'" for s in urls.TWO_PART_SUFFIXES)

OP1_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (
  SELECT *, string_split(host, '.') AS labels, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM parts),
p AS (
  SELECT page_id, host, path, CASE WHEN two IN ({_TWO_SQL}) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN ({_TWO_SQL}) THEN two ELSE labels[-1] END AS suffix FROM named),
h AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM p JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY host),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
o AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS overall FROM s),
s0 AS (SELECT s.*, overall FROM s, o),{_shrink_sql("s1", "s0", "overall", "suffix")},
d0 AS (SELECT d.*, mean AS up FROM d JOIN s1 USING (suffix)),{_shrink_sql("d1", "d0", "up", "domain")},
h0 AS (SELECT h.*, mean AS up FROM h JOIN d1 USING (domain)),{_shrink_sql("h1", "h0", "up", "host")},
rated AS (
  SELECT p.*, coalesce(h1.mean, d1.mean, s1.mean, overall) AS m, coalesce(h1.strength, d1.strength, s1.strength, 1) AS k
  FROM p LEFT JOIN h1 ON h1.host = p.host LEFT JOIN d1 ON d1.domain = p.domain LEFT JOIN s1 ON s1.suffix = p.suffix, o),
judged AS (SELECT *, round(m, 6) AS bad_rate, round(m - {URL_Z} * sqrt(m * (1 - m) / (k + 1)), 6) AS lower_bound, CASE {_RULES_SQL} END AS hit FROM rated)
SELECT page_id, host, path, CASE WHEN hit IS NOT NULL THEN substr(hit, strpos(hit, ':') + 1) END AS rule,
  coalesce(split_part(hit, ':', 1), CASE WHEN lower_bound > {URL_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, lower_bound
FROM judged"""


@query("op1_url_reputation", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every page; outcomes are the labels of the same id (bad: low quality or toxic)."""
    labels = table(spark, sf, "labels")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0)))
    return urls.judge_urls(table(spark, sf, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), URL_RULES, URL_LIMIT, URL_Z)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^ \t-\r]+'), []) AS words FROM documents),
pos AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
again AS (SELECT win FROM pos GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM pos JOIN again USING (win)),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""


@query("op2_suffix_trees", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the 35-word sequences that stand elsewhere, too."""
    out = substrings.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_licence_classifier")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    out = licences.scan_licences(table(spark, sf, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return out.select(
        "doc_id", "n_paragraphs", F.size("licences").alias("n_predicted"), F.size(sure).alias("n_confirmed"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("predicted"),
    )


MIX_BUDGET, MIX_SEED = 0.5, 23


def _level_sql(name: str, rows: str, keys: str) -> str:
    """Column ``level`` of ``rows`` (raw, cap): raw times a common scale, at most cap, summing to 1. Places by cap per raw give the scale."""
    return f"""s_{name} AS (SELECT cap / raw AS ratio, (1 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(raw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM {rows} WHERE raw > 0 WINDOW o AS (ORDER BY cap / raw, {keys})),
t_{name} AS MATERIALIZED (SELECT *, least(cap, coalesce(raw * (SELECT arg_min(scale, ratio) FROM s_{name} WHERE scale <= ratio), cap)) AS target FROM {rows})"""


def _margin_sql(dim: str, raw: str) -> str:
    return f"""g_{dim} AS (SELECT {dim}, CAST({raw} AS DOUBLE) AS raw, n / ({MIX_BUDGET} * (SELECT total FROM a)) AS cap FROM (SELECT {dim}, sum(n) AS n FROM c GROUP BY {dim}) x),
{_level_sql(dim, f"g_{dim}", dim)}"""


def _rake_sql() -> str:
    """Rounds of the three margins, until the gap of a round is within the tolerance or hardly less than before; then the budget is filled."""
    last = f"it WHERE round < {mixing.ROUNDS} AND gap > {mixing.TOLERANCE} AND gap <= prior - {mixing.TOLERANCE / 4}"
    for dim in ("source", "lang", "topic"):
        last = f"(SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0 THEN w * t_{dim} / sum(w) OVER (PARTITION BY {dim}) ELSE w END AS w) FROM {last})"
    gaps = ", ".join(f"abs(sum(w) OVER (PARTITION BY {dim}) - t_{dim})" for dim in ("source", "lang", "topic"))
    columns = "source, lang, topic, n, cap, t_source, t_lang, t_topic"
    return f"""it AS (
  SELECT 0 AS round, source, lang, topic, n, n / ({MIX_BUDGET} * total) AS cap, t_source.target AS t_source, t_lang.target AS t_lang, t_topic.target AS t_topic, n / total AS w,
    CAST(9 AS DOUBLE) AS gap, CAST(99 AS DOUBLE) AS prior
  FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic), a
  UNION ALL
  SELECT round, {columns}, w, greatest(max(g) OVER (), abs(sum(w) OVER () - {min(1.0, 1.0 / MIX_BUDGET)})) AS gap, prior
  FROM (SELECT *, greatest({gaps}) AS g FROM (SELECT round + 1 AS round, {columns}, least(w, cap) AS w, gap AS prior FROM {last}))),
g_fit AS MATERIALIZED (SELECT source, lang, topic, n, cap, w AS raw FROM it WHERE round = (SELECT max(round) FROM it)),
{_level_sql("fit", "g_fit", "source, lang, topic")}"""


_COUNTS_SQL = " UNION ALL ".join(
    "SELECT rid, " + " + ".join(f"(length(low) - length(replace(low, '{e}', ''))) // {len(e)}" for e in endings) + f" AS c, {-i} AS k, '{t}' AS t FROM d"
    for i, (t, endings) in enumerate(sorted(mixing.TOPICS.items()), 1))
_LANG_SQL = ", ".join(f"('{k}', {v})" for k, v in mixing.LANGUAGES.items())
OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS tokens,
    lower(coalesce(text, '')) AS low, coalesce(text, '') AS text FROM documents),
tc AS ({_COUNTS_SQL}),
tp AS (SELECT rid, CASE WHEN max(c) > 0 THEN arg_max(t, c * 100 + k) ELSE 'other' END AS topic FROM tc GROUP BY rid),
x AS MATERIALIZED (SELECT d.*, topic FROM d JOIN tp USING (rid)),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS n FROM x GROUP BY ALL),
a AS MATERIALIZED (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c),
l(lang, share) AS (VALUES {_LANG_SQL}),
{_margin_sql("source", "sqrt(n)")},
{_margin_sql("topic", "sqrt(n)")},
{_margin_sql("lang", "coalesce((SELECT max(share) FROM l WHERE l.lang = x.lang), (SELECT min(share) FROM l))")},
{_rake_sql()},
rates AS (SELECT source, lang, topic, round(CASE WHEN n > 0 THEN least(1.0, target * ({MIX_BUDGET} * (SELECT total FROM a)) / n) ELSE 0.0 END, 9) AS keep_rate FROM t_fit)
SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, topic, keep_rate,
  CAST(('0x' || substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(text)), 1, 8)) AS BIGINT) / 4294967296.0 < keep_rate AS selected
FROM x JOIN rates USING (source, lang, topic)"""


@query("op4_raked_mixture", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Keep rate and choice of every document."""
    out = mixing.mix_sources(table(spark, sf, "documents"), budget=MIX_BUDGET, seed=MIX_SEED)
    return out.select("doc_id", "tokens", "topic", "keep_rate", "selected")


OP5_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i FROM w WHERE len(words) > 0)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
pos AS (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(words) >= n),
hit AS (SELECT rid, i, v.n, item_id FROM (SELECT rid, i, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM pos) a JOIN v USING (n, win)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)"""


@query("op5_fm_index", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark hits of all documents."""
    out = decontaminate.find_benchmark(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+'), []) AS words FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(words[i:i + least(3, len(words)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pair AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b USING (shingle) WHERE a.rid <> b.rid GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pair JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.other GROUP BY reach.rid)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN low USING (rid) LEFT JOIN n USING (rid)"""


@query("op6_signature_join", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups of all documents: three words, 85 per cent."""
    out = minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), shingle_words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_two_pass_shuffle")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of all documents by the ``key`` law, from the written shard files."""
    out = sharding.shuffle_shards(table(spark, sf, "documents").select("doc_id", "text"), shards=8)
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.crc32(text_of("text")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"),
    )


def _spans_sql(rule: secret_scan.Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
m{rank} AS (
  SELECT rid, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS lens,
    list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x)) AS judged FROM d),
s{rank} AS (
  SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS b, list_sum(gaps[1:i]) + list_sum(lens[1:i]) AS e
  FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM m{rank}) WHERE judged[i] >= {rule.least})"""


_ALL_RULES = secret_scan.BASE + secret_scan.MORE
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{",".join(_spans_sql(r, i) for i, r in enumerate(_ALL_RULES))},
s AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(_ALL_RULES)))}),
g AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


@query("op9_secret_index", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of all documents."""
    out = secret_scan.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.BASE]))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"), secret_scan.spans_text(F.col("secrets")).alias("spans"),
    )


@query("op10_site_quality")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Posterior quality of all documents."""
    out = quality.judge_quality(table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality"))
    return out.select("doc_id", F.round("quality_evidence", 6).alias("evidence"), F.round("quality", 6).alias("quality"), "accepted")


OP8_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.rid <> b.rid AND a.fine AND b.fine AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(rid, other) AS (SELECT rid, rid FROM v UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.other GROUP BY reach.rid),
deg AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low USING (rid) LEFT JOIN deg USING (rid)"""


@query("op8_nn_descent", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Links and groups of all embeddings."""
    return neighbours.near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))[0]


OP13_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
s AS MATERIALIZED (SELECT conv_id, list({'role': role, 'text': text} ORDER BY p) AS t FROM o GROUP BY conv_id),
h AS (
  SELECT conv_id, t, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM s),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h], []), h.t[h + 1:]) AS t FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 5),
k AS (SELECT conv_id, d, t[1:d] AS node, d = len(t) AS ends FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM k GROUP BY node, d),
c AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.node[-1].text) ELSE 0 END AS saved FROM n LEFT JOIN c USING (node)),
a AS (
  SELECT node[1:j] AS node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM x) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN a USING (node) LEFT JOIN n u ON x.d > 0 AND u.d = x.d - 1 AND u.node = x.node[1:x.d - 1]"""


@query("op13_conversation_trie", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Trie over all conversations, each begun with up to eight turns of the one whose id is the next lower multiple of five."""
    seqs = prefix_trie.sequences(table(spark, sf, "conversations"))
    c = F.col("conv_id")
    return prefix_trie.conversation_trie(prefix_trie.graft_heads(seqs, c - c % 5, F.crc32(c.cast("string")) % 9))


TOKENIZERS = "/opt/tokenizers"


@query("op11_token_pairs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment of two public tokenizers over all documents."""
    files = token_pairs.Files(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    out = token_pairs.align_tokenizers(table(spark, sf, "documents").select("doc_id", "text"), files, digest=True).documents
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query("op12_context_tree")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents; a tenth of the ids is held out. A null id counts as empty."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return context_tree.score_texts(docs, held_out)
