"""Pruned token index, interval sweep and distributed rank against plain forms, with a patient that owns a third of all rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.functions import scale as S
from cohortmill.functions import text as T
from cohortmill.operators import coding as K
from cohortmill.operators import matching as M


def test_token_hits_equal_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["of"] * 8 + ["cell"] * 4
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])))
    code = lambda: [("s", rng.choice("abc"), None, None)] if rng.random() < 0.2 else []
    schema = "trial_id int, criterion_id int, fact_kind string, match_text string, coded_concepts array<struct<system:string,code:string,display:string,match_type:string>>"
    rules = spark.createDataFrame([(i % 9, i, rng.choice(["lab", "condition", None]), text(), code()) for i in range(120)] + [(1, 900, "lab", None, None)], schema)
    facts = spark.createDataFrame(
        [(0 if i % 3 == 0 else i % 7, rng.choice(["lab", "condition"]), rng.choice([text(), text() + "|x", None]), code()) for i in range(150)],
        "patient_id int, kind string, description string, coded_concepts array<struct<system:string,code:string,display:string,match_type:string>>")
    asked = spark.createDataFrame([(p, t) for p in range(7) for t in range(9)], "patient_id int, trial_id int")
    got = lambda **k: {tuple(r) for r in M.fact_hits(asked, rules, facts, **k).select("patient_id", "criterion_id", "kind", "fact_key").collect()}
    f = M._searchable(facts).select("patient_id", "kind", "fact_key", T.tokens(F.col("description")).alias("f"), F.col("codes").alias("fc")).distinct()
    r = asked.join(rules, "trial_id").select("patient_id", "criterion_id", F.col("fact_kind").alias("kind"), T.tokens(F.col("match_text")).alias("t"), M.concept_keys(F.col("coded_concepts")).alias("tc"))
    n = F.size(F.array_intersect("t", "f"))
    plain = r.join(f, ["patient_id", "kind"]).where((n >= 2) | ((n > 0) & (n == F.least(F.size("t"), F.size("f")))) | F.arrays_overlap("tc", "fc"))
    want = {tuple(x) for x in plain.select("patient_id", "criterion_id", "kind", "fact_key").collect()}
    assert got() == want and got(hot_patients=["0"]) == want and len(want) > 200
    every = r.select("patient_id", "criterion_id", "kind", F.explode("t").alias("key")).join(f.select("patient_id", "kind", "fact_key", F.explode("f").alias("key")), ["patient_id", "kind", "key"])
    by_text = M.fact_candidates(asked, rules, facts).where(~F.col("key").startswith("c:"))
    assert 2 * by_text.count() < every.count()


def test_intervals_of_many_values(spark):
    rng = random.Random(2)
    values = [(0, rng.randrange(10**6) / 7) for _ in range(100_000)] + [(p, float(rng.randrange(50))) for p in range(1, 20) for _ in range(3)] + [(3, float("nan"))]
    asked = [(i, p, low, low + rng.choice([0.0, 0.05, 3.0])) for i in range(2_000) for p, low in [(0 if i % 3 == 0 else i % 22, float(rng.randrange(60)) if i % 3 else rng.randrange(10**6) / 7)]]
    asked += [(5_000, 1, float("-inf"), 10.0), (5_001, 2, 5.0, float("nan")), (5_002, 21, float("-inf"), float("nan"))]
    got = {r.c for r in M.in_interval(spark.createDataFrame(asked, "c int, p int, low double, high double"), spark.createDataFrame(values, "p int, value double"), ["p"], ["c"]).collect()}
    of = {}
    for p, v in values:
        of.setdefault(p, []).append(v)
    want = {c for c, p, low, high in asked if any((v >= low or v != v) and (v <= high or high != high) for v in of.get(p, []))}
    assert got == want and 100 < len(want) < len(asked)


def test_rank_over_ranges(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 else (None if i % 5 == 0 else i % 40), rng.randrange(4), f"NCT{i:08d}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "g int, s int, id string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = S.range_rank(df, ["g"], [-F.col("s"), F.col("id")], "r")
        got = {tuple(r) for r in ranked.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {tuple(r) for r in df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(-F.col("s"), "id"))).collect()}
    assert got == want


def test_edit_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    texts = {"", "a", "ab", "abc", "hot cell", "non small cell lung cancer", "x" * 40}
    for _ in range(250):
        t = rng.choice(sorted(texts))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "a", "b ", "é"]) + t[at + rng.randrange(2):]
        texts.add(t)
    rows = spark.createDataFrame([(s, t) for s in ("one", "two") for t in sorted(texts)], "system string, norm string")
    cat = rows.where("length(norm) % 3 <> 1 or system = 'one'").withColumnRenamed("norm", "cand")
    got = {tuple(r) for r in K.edit_pairs(rows, cat).collect()}
    want = {tuple(r) for r in rows.join(cat, "system").withColumn("distance", F.levenshtein("norm", "cand")).where("distance <= 2").collect()}
    assert got == want and len(want) > 2 * len(texts)


def test_trigram_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["lung", "lungs", "cancer", "cancers", "small", "smell", "cell", "breast", "b", "non"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    rows = spark.createDataFrame([("one", t) for t in texts], "system string, norm string")
    got = {(r.norm, r.cand): round(r.similarity, 9) for r in K.trigram_pairs(rows, rows.withColumnRenamed("norm", "cand")).collect()}
    tri = {t: {f"  {w} "[i:i + 3] for w in t.split() for i in range(len(w) + 1)} for t in texts}
    want = {(a, b): round(len(tri[a] & tri[b]) / len(tri[a] | tri[b]), 9) for a in texts for b in texts if len(tri[a] & tri[b]) / len(tri[a] | tri[b]) >= K.THRESHOLD - 1e-12}
    assert got == want
