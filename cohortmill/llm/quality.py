"""Hierarchical empirical-Bayes quality: document classifier, host and path posteriors."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rows import least_hashes, stored, text_of
from cohortmill.llm.urls import shrink

FIT_ROWS = 20_000     # labelled rows the classifier is fitted on, at most
SOFT = 0.25           # weight of an unlabelled document's classifier probability in the counts of its path
OWN = ("quality_evidence", "quality", "accepted")


def features(text: Column) -> dict[str, Column]:
    """Shape of a whole text: shares of its characters, words and lines. An empty text has 0 everywhere."""
    size = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.greatest(F.size(words), F.lit(1))
    return {
        "f_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / size,
        "f_marks": F.length(F.regexp_replace(text, r"[^!?*#$%&|~^]+", "")) / size,
        "f_digits": F.length(F.regexp_replace(text, "[^0-9]+", "")) / size,
        "f_distinct": F.size(F.array_distinct(words)) / n,
        "f_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "f_word": F.least(size / n, F.lit(50.0)),
        "f_long": F.log1p(F.size(words).cast("double")),
    }


@dataclass
class Classifier:
    weights: dict[str, float]
    intercept: float
    rows: int
    held_out: float | None

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for name, w in sorted(self.weights.items()):
            out = out + F.lit(w) * F.col(name)
        return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))


def fit(labelled: DataFrame, names: list[str], fit_rows: int = FIT_ROWS) -> Classifier:
    """Logistic regression on at most ``fit_rows`` labelled rows (least hashes of their id), a fifth of them held out.

    Without both classes in the fitted part the text says nothing: all weights are 0 and the evidence is the log odds of good labels, one added to
    either class. ``rows`` counts all labelled rows drawn; without any the evidence is 0.
    """
    sample = least_hashes(labelled.withColumn("_h", F.xxhash64("doc_id", "label")), "_h", fit_rows)
    sample = stored(sample.withColumn("_held", F.pmod("_h", F.lit(5)) == 0).select("label", "_held", *names), "sample")
    seen = {(r["label"], r["_held"]): r["n"] for r in sample.groupBy("label", "_held").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, good = sum(seen.values()), sum(n for (label, _), n in seen.items() if label)
    if len({label for label, held in seen if not held}) < 2:
        return Classifier({n: 0.0 for n in names}, log((good + 1) / (rows - good + 1)), rows, None)
    vectors = VectorAssembler(inputCols=names, outputCol="x")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001, maxIter=60).fit(vectors.transform(sample.where("not _held").withColumn("label", F.col("label").cast("double"))))
    out = Classifier(dict(zip(names, map(float, model.coefficients))), float(model.intercept), rows, None)
    right = sample.where("_held").agg(F.avg(((out.logit() > 0).cast("int") == F.col("label")).cast("double")).alias("a")).first()["a"]
    out.held_out = right
    return out


def log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def judge_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id", text: str = "text",
                  fit_rows: int = FIT_ROWS, limit: float = 0.5, model: Classifier | None = None) -> DataFrame:
    """Columns of ``docs`` plus quality_evidence (classifier log odds), quality (posterior probability) and accepted (quality >= limit).

    ``labels``: (doc_id, quality 0 / 1), null or repeated labels do not count more than once per id (the least one holds). One pass over all
    texts takes their features; labelled documents fit the classifier. Counts of good documents (labels, plus SOFT times the
    probabilities of unlabelled ones) are summed per path and host; the host's rate is shrunk towards the global one and the path's
    towards its host's by fitted beta-binomial priors, so a sparse site stays near the global rate. The document's log odds are
    moved by the difference between its path's log odds and the global ones. Texts are never shuffled; a site with a third of
    all rows costs one row per task.

    Null or empty text: quality 0, not accepted. Null host or path: a group of its own. No labels at all: everything else is
    accepted at its prior. Labels of one class: sites move around that class's rate. Repeated rows are judged alike. Empty table: no rows. Input columns with the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in OWN]
    marks = features(text_of(text))
    names = list(marks)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    shape = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("h"), F.col(path).alias("p"), F.length(text_of(text)).alias("size"), *[c.alias(n) for n, c in marks.items()]), "shape")
    shape = shape.where("size > 0").join(known, "doc_id", "left")
    model = model or fit(shape.where(F.col("label").isNotNull()).select("doc_id", "label", *names), names, fit_rows)
    good = 1 / (1 + F.exp(-model.logit()))
    counts = stored(
        shape.withColumn("bad", F.when(F.col("label").isNotNull(), 1.0 - F.col("label")).otherwise(SOFT * (1 - good)))
        .withColumn("n", F.when(F.col("label").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT)))
        .groupBy("h", "p").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "sites")
    total = counts.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    overall = (total["bad"] + 1) / (total["n"] + 2)
    hosts = shrink(counts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), F.lit(overall)).select(F.col("h").alias("_hh"), F.col("mean").alias("_up"))
    paths = shrink(counts.join(hosts, F.col("h").eqNullSafe(F.col("_hh"))), F.col("_up")).select(F.col("h").alias("_h"), F.col("p").alias("_p"), F.col("mean").alias("_bad"))
    paths = stored(paths, "paths")  # so its size is known, and the texts need not move for a small table
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    whole = docs.select(row.alias("r"), F.col(host).alias("h"), F.col(path).alias("p"), F.length(text_of(text)).alias("size"), *[c.alias(n) for n, c in marks.items()])
    whole = whole.select("r", "h", "p", "size", model.logit().alias("evidence"))
    same = F.col("h").eqNullSafe(F.col("_h")) & F.col("p").eqNullSafe(F.col("_p"))
    # Without any label the classifier says nothing and the documents stand at their prior.
    shift = log_odds(1 - F.coalesce(F.col("_bad"), F.lit(overall))) - log_odds(F.lit(1 - overall)) if model.rows else F.lit(0.0)
    posterior = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.col("evidence") + shift))))
    out = whole.join(paths, same, "left").withColumn("quality", posterior)
    return out.select(*[F.col(f"r.`{c}`") for c in keep], F.col("evidence").alias("quality_evidence"), "quality", (F.col("quality") >= limit).alias("accepted"))
