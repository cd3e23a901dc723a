"""Skew-safe shapes give the plain answer."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortmill.functions import scale as S
from cohortmill.operators import coding as K
from cohortmill.operators import matching as M
from cohortmill.operators.match_runs import MatchStore
from cohortmill.plans import matching_queries as Q
from cohortmill.plans import views as V

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_split_join_equals_join(spark):
    left = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = S.hot_keys(left, ["k"], hot_rows=100)
    assert hot == {"k": ["1"]}
    for how in ("inner", "left", "left_semi"):
        assert rows(S.split_join(left, right, "k", ["id"], hot["k"], how)) == rows(left.join(right, "k", how))


def test_two_level_rank_equals_row_number(spark):
    rnd = random.Random(1)
    data = [(rnd.randint(0, 2), rnd.choice([0.0, 0.5, 1.0]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, s double, i int")
    order = [F.desc("s"), F.asc("i")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert rows(S.two_level_rank(df, ["g"], [-F.col("s"), F.floor(F.col("i") / 10)], order, "r")) == rows(plain)


def test_hot_requests_change_nothing(spark):
    i = Q.inputs(spark, SF)
    rules = S.stage(Q.rules_of(i))
    plain = M.evaluate(**i, rules=rules)
    split = M.evaluate(**i, rules=rules, hot_rows=30)
    assert plain.exceptAll(split).count() == 0 and plain.count() == split.count()


def test_match_invariants_and_persistence(spark, tmp_path):
    ev, rules, i = Q.evaluated(spark, SF)
    ev = S.stage(ev)
    store = MatchStore(spark, str(tmp_path))
    store.write("1", i["requests"], ev, rules, i["trials"])
    res = store.read("match_results")
    eff = M.collapse_groups(ev, rules)
    per_pair = eff.groupBy("patient_id", "trial_id").count()
    total = sum(F.col(c) for c in ["favorable_count", "unfavorable_count", "unknown_count", "requires_review_count"])
    assert res.join(per_pair, ["patient_id", "trial_id"]).where(total != F.col("count")).count() == 0
    assert res.count() == per_pair.count() == res.select("patient_id", "trial_id").distinct().count()
    runs = store.read("match_runs")
    assert runs.agg(F.sum("total_trials_evaluated")).first()[0] == res.count()
    assert store.read("match_review_items").count() > 0


def test_requests_for_named_patients(spark):
    trials = spark.range(4).select(F.col("id").alias("trial_id"))
    assert M.requests_for(trials, [7, 8]).count() == 8


def test_trigram_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    words = ["small", "smell", "cell", "lung", "long", "breast", "cancer", "canser", "node", "nodes"]
    make = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
    q, c = {make() for _ in range(60)}, {make() for _ in range(60)}

    def tri(t):
        return {("  " + w + " ")[j:j + 3] for w in t.split() for j in range(len(w) + 1)}

    want = {(a, b) for a in q for b in c if len(tri(a) & tri(b)) / len(tri(a) | tri(b)) >= 0.55}
    qd = spark.createDataFrame([("s", t) for t in q], "system string, norm string")
    cd = spark.createDataFrame([("s", t) for t in c], "system string, cand string")
    got = {(r["norm"], r["cand"]) for r in K.trigram_pairs(qd, cd).collect()}
    assert got == want


def test_coding_tiers(spark):
    cat = [("mesh", "D1", "Breast Neoplasms", ["breast cancer", "breast carcinoma"]), ("mesh", "D2", "Small Cell Lung Carcinoma", ["small cell lung cancer"]),
           ("mesh", "D3", "Carcinoma, Non-Small-Cell Lung", ["non-small cell lung cancer"]), ("nci_thesaurus", "C1", "HER2 Negative", ["her2 negative"])]
    lookups = spark.createDataFrame(cat, "system string, code string, display string, synonyms array<string>")
    asks = [(1, "DISEASE", ["breast neoplasms"], True), (2, "DISEASE", ["Breast Cancer"], True), (3, "DISEASE", ["breast cancre"], True),
            (4, "DISEASE", ["non small cell lung cancr"], True), (5, "DISEASE", ["something else"], True), (6, "BIOMARKER", ["HER2-"], True),
            (7, "MEASURE", ["5 mg"], True), (8, "DISEASE", ["breast cancre"], False)]
    req = spark.createDataFrame(asks, "request_id int, label string, variants array<string>, fuzzy boolean")
    got = {r["request_id"]: (r["code"], r["match_type"], r["confidence"], r["review_reason"]) for r in K.code_requests(req, lookups).collect()}
    assert got[1] == ("D1", "exact", 0.95, None)
    assert got[2] == ("D1", "synonym", 0.85, None)
    assert got[3] == ("D1", "fuzzy", 0.60, "fuzzy_match")
    assert got[4] == ("D3", "fuzzy", 0.60, "fuzzy_match")
    assert got[5] == (None, None, 0.40, "uncoded_entity")
    assert got[6] == ("C1", "exact", 0.95, None)
    assert got[7] == (None, None, 0.0, None)
    assert got[8][0] is None


def test_stored_views_are_written_once(spark):
    assert V.table(spark, SF, "requests").inputFiles() == V.table(spark, SF, "requests").inputFiles()
