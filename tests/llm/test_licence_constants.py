"""Templates are constants of the licence scan, and a paragraph's words are made once."""

from pyspark.sql import functions as F

from cohortmill.llm import licences


def test_template_pairs_are_constants(spark):
    texts = [t for _, t in licences.TEMPLATES] + ["Word", "one two one two"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_distinct(licences.pairs_of(licences.words_of(F.col("t")))).alias("p"))
    assert {r.t: r.p for r in df.collect()} == {t: licences.template_pairs(t) for t in texts}
    plan = licences.other_paragraphs(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
