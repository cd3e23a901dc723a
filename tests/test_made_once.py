"""Costly texts are read once: no expression is copied into a filter, into every item of its document or into every equal mention."""

import re

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions import text as T
from cohortmill.functions.scale import each
from cohortmill.operators import coding as K
from cohortmill.operators import narrative as N
from cohortmill.operators import tagging as G


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_and_headers_are_made_once_per_document(spark):
    docs = spark.createDataFrame([("a", "Inclusion Criteria:\n- Age over 18\n- No prior drug"), ("b", None), ("c", " "), ("d", "Inclusion:")], "doc_id string, text string")
    text = plan(N.split_items(docs))
    assert text.count("flatten(transform(split(") == 1
    # headers are looked for below the items, not above
    assert text.index("headed") and "headed" in text[text.index("Generate"):] and text.count("RLIKE(concat(") == 1 and text.index("RLIKE(concat(") > text.index("Generate")
    assert [(r.doc_id, r.item_no, r.text, r.type) for r in N.split_items(docs).orderBy("doc_id", "item_no").collect()] == [
        ("a", 0, "Age over 18", "inclusion"), ("a", 1, "No prior drug", "exclusion")]
    assert "size(coalesce" not in plan(N.decompose(N.split_items(docs)))


def test_each_drops_null_and_empty_arrays_only(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, xs array<string>")
    assert sorted(map(tuple, each(df, F.col("xs"), "at", "x").select("k", "at", "x").collect()), key=str) == sorted([(1, 0, "a"), (1, 1, None)], key=str)


def test_white_is_unicode_white_space(spark):
    rows = [(f"{chr(c)}a{chr(c)} b{chr(c)}{chr(c)}",) for c in [*range(1, 0x180), 0x1680, 0x180e, *range(0x2000, 0x2070), 0x205f, 0x3000, 0xfeff]]
    df = spark.createDataFrame(rows, "t string").select(T.strip_ws(F.col("t")).alias("x"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("y"))
    assert df.where("x <> y").collect() == []
    assert "regexp_replace(t" not in plan(df.select(T.strip_ws(F.col("x"))))


@pytest.mark.parametrize("text", ["MUST NOT x", "Should  not", "CANNOT", "No Prior", "no known", "no concurrent", "AbSence of", "exclude if", "EXCLUDED \u0130f", "\u0131nel\u0130gible if",
                                  "have not received", "not have known", "W\u0131THOUT ev\u0130dence", "ab\u017fence of", "notable", "now", None, ""])
def test_polarity_finds_what_the_signals_find(spark, text):
    hit = F.lit(False)
    for p in P.EXCLUSION_SIGNALS:
        hit = hit | T.has(F.col("t"), p)
    got = spark.createDataFrame([(text,)], "t string").select(N.polarity(F.col("t")), F.when(hit, "exclusion").otherwise("inclusion")).first()
    assert got[0] == got[1]


def test_long_texts_are_tagged_in_small_parts(spark, monkeypatch):
    phrases = spark.createDataFrame([("a b", "lower", "X"), ("b", "lower", "Y"), ("a", "lower", "Z")], "phrase string, kind string, label string")
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else "A b a " * (i % 7)) for i in range(300)], "i int, text string").coalesce(1)
    assert G.CHUNK < 300
    for r in G.tag(docs, phrases).collect():
        n = 0 if r.i % 50 == 0 else r.i % 7
        assert [(m.text, m.label) for m in r.mentions] == [("A b", "X"), ("a", "Z")] * n
        assert [m.start for m in r.mentions] == [x for k in range(n) for x in (6 * k, 6 * k + 4)]


def test_mentions_are_not_sorted_for_their_lookups(spark, monkeypatch):
    """The lookups of mentions come from a distinct; no sort of the mentions themselves."""
    seen = []
    real = K.stage
    monkeypatch.setattr(K, "stage", lambda df, *a: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    m = spark.createDataFrame([(i, "DRUG", ["aspirin"], True) for i in range(5)], "mention_id int, label string, variants array<string>, fuzzy boolean")
    c = spark.createDataFrame([("nci", "1", "Aspirin", ["asa"])], "system string, code string, display string, synonyms array<string>")
    assert {r.code for r in K.code_mentions(m, c, {"DRUG": ["nci"]}).collect()} == {"1"}
    first = seen[0]
    assert re.search(r"HashAggregate\(keys=\[[^\]]*variants#", first) and "SortAggregate" not in first, first
