"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.scale import barrier
from cohortmill.llm.rows import least_hashes, stored, text_of

BACKGROUND = 2_000    # corpus paragraphs that train the unknown class, at most
COMMON = 0.01         # a template word in more of the corpus's other paragraphs is no cue
SHARE = 0.75          # share of a template's word pairs that a confirmed paragraph holds
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)
UNKNOWN = "unknown"

#: Notices by family. Public licence names and short notices.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission of the publisher."),
]
#: Sentences around licences that grant nothing.
NOT_LICENCES = [
    "The driver showed a valid license to the officer.", "You may not use this road after dark.", "The work is under way and free of charge.",
    "Version 2.0 of the software was released in May.", "All rights were discussed at the public meeting.", "The general public may visit the foundation.",
    "MIT students published the paper.", "Permission to enter was granted to any person with a copy of the letter.", "The Apache helicopter landed.",
    "This work is in the public library.", "Commercial use of the hall is common in 4.0 per cent of cases.",
]


WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, with dots and hyphens between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs_of(words: Column) -> Column:
    """Distinct word pairs; a single word is its own pair."""
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(words)


def template_pairs(text: str) -> list[str]:
    """Those of a template, as constants: made of Column expressions they would be made anew for every row."""
    w = re.findall(WORD, text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:]))) if len(w) > 1 else w


def constants(texts: Iterable[str]) -> Column:
    return F.array(*map(F.lit, texts)).cast("array<string>")


def grams_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs_of(words)).otherwise(F.array().cast("array<string>"))))


@dataclass
class Model:
    families: list[str]
    cues: list[str]                    # words of the templates that are rare elsewhere
    weights: dict[str, list[float]]    # cue or word pair with a cue: weight per family
    intercepts: list[float]
    temperature: float
    held_out: float | None

    def features(self, words: Column) -> Column:
        return F.array_intersect(grams_of(words), F.array(*map(F.lit, self.weights)))

    def probabilities(self, grams: Column) -> Column:
        """Calibrated probability per family from the features of a paragraph."""
        table = F.from_json(F.lit(json.dumps({g: [float(f"{x:.4g}") for x in w] for g, w in self.weights.items()})), "map<string,array<double>>")
        start = F.array(*map(F.lit, self.intercepts))
        logits = F.aggregate(grams, start, lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
        scaled = F.transform(F.array(logits), lambda x: F.transform(x, lambda v: F.exp((v - F.array_max(x)) / F.lit(self.temperature))))
        return F.transform(scaled, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, z: a + z)))[0]


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\n+"), lambda p: F.length(F.trim(p)) > 0)


def blocks_of(text: Column) -> Column:
    """Neighbouring lines without a blank one between them, joined: (first and last paragraph number, text) where there are several."""
    parts = F.transform(F.split(text, r"\n[^\S\n]*\n"), paragraphs_of)
    sizes = F.transform(parts, F.size)
    before = F.transform(parts, lambda b, i: F.struct(b.alias("b"), F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda acc, n: acc + n).alias("n")))
    return F.transform(F.filter(before, lambda x: F.size(x["b"]) > 1), lambda x: F.struct((x["n"] + 1).alias("paragraph"), (x["n"] + F.size(x["b"])).alias("last"), F.array_join(x["b"], " ").alias("text")))


def other_paragraphs(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, text, w) of every paragraph that holds less than half of the word pairs of each template: a seeded hash, the text, its words."""
    wanted = [template_pairs(t) for _, t in templates]
    lines = docs.select(F.col(doc_id).alias("id"), F.posexplode(paragraphs_of(text_of(text))).alias("n", "text"))
    # Words and pairs are made once per paragraph; the filter, copied into them, would make them again for every template.
    worded = barrier(lines.select(F.xxhash64("id", "n", "text").alias("h"), "text", words_of(F.col("text")).alias("w")))
    held = barrier(worded.withColumn("g", F.array_intersect(pairs_of(F.col("w")), constants(dict.fromkeys(p for want in wanted for p in want)))))
    few = F.lit(True)
    for want in wanted:
        few = few & (F.size(F.array_intersect("g", constants(want))) < 0.5 * len(want))
    return held.where((F.size("g") == 0) | few).drop("g")


def word_counts(paragraphs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """Paragraphs (w) that hold each template word, and under "" all of them: one aggregate whose keys are the template words."""
    known = F.array(*map(F.lit, sorted({w for _, t in templates for w in re.findall(WORD, t.lower())})))
    words = paragraphs.select(F.explode(F.array_append(F.array_intersect("w", known), F.lit(""))).alias("w"))
    return {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(spark: SparkSession, background: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, counts: dict[str, int] | None = None) -> Model:
    """Sparse multinomial logistic regression over word 1- and 2-grams of the templates.

    Cues are template words that at most COMMON of the paragraphs of ``counts`` hold (see ``word_counts``; by default those of the
    background); features are cues and pairs with a cue, so a paragraph without a cue has no feature and gets the unknown class by
    the intercepts alone.

    Examples: each template whole, with a copyright line before it, with a sentence of the corpus after it, and without its last words; the
    unknown class from ``background`` (text) and NOT_LICENCES. Every fifth example is held out: there the temperature with the
    least log loss is chosen, which calibrates the probabilities of all classes, unknown included.
    """
    texts = [re.findall(WORD, t.lower()) for _, t in templates]
    counts = word_counts(background.select(words_of(F.col("text")).alias("w")), templates) if counts is None else counts
    common = {w for w, n in counts.items() if n > COMMON * counts[""]}
    cues = sorted({w for t in texts for w in t} - common)
    pairs = {f"{a} {b}" for t in texts for a, b in zip(t, t[1:]) if a in cues or b in cues}
    vocabulary = [*cues, *sorted(pairs)]
    model = Model([UNKNOWN, *sorted({f for f, _ in templates})], cues, {g: [] for g in vocabulary}, [], 1.0, None)
    plain = spark.createDataFrame([*templates, *[(UNKNOWN, t) for t in NOT_LICENCES]], "family string, text string")
    variants = F.array(
        F.col("text"), F.concat(F.lit("Copyright (c) 2021 The Authors. "), F.col("text")), F.concat(F.col("text"), F.lit(" See the file for details.")),
        F.concat(F.lit("# "), F.col("text")), F.array_join(F.slice(F.split("text", " "), 1, F.greatest(F.lit(1), (F.size(F.split("text", " ")) * 0.85).cast("int"))), " "),
    )
    label = F.lit(0.0)
    for i, f in enumerate(model.families):
        label = F.when(F.col("family") == f, float(i)).otherwise(label)
    rows = plain.select("family", F.explode(variants).alias("text")).unionByName(background.select(F.lit(UNKNOWN).alias("family"), "text"))
    rows = stored(
        rows.select(label.alias("label"), model.features(words_of(F.col("text"))).alias("grams"), F.pmod(F.xxhash64("family", "text"), F.lit(5)).alias("fold"))
        .withColumn("weight", F.when(F.col("label") == 0, 1.0).otherwise(20.0)).coalesce(2), "examples")
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x")
    fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=0.0005, maxIter=40, standardization=False)
    fitted = fitted.fit(terms.setBinary(True).transform(rows.where("fold > 0")))
    columns = fitted.coefficientMatrix.toArray().T.tolist()
    model.weights, model.intercepts = dict(zip(vocabulary, columns)), [float(v) for v in fitted.interceptVector]
    model.intercepts += [-20.0] * (len(model.families) - len(model.intercepts))
    model.weights = {g: w + [0.0] * (len(model.families) - len(w)) for g, w in model.weights.items()}
    losses = []
    for t in TEMPERATURES:
        model.temperature = t
        losses.append(F.avg(-F.log(F.greatest(F.lit(1e-9), F.get(model.probabilities(F.col("grams")), F.col("label").cast("int"))))).alias(f"t{t}"))
    model.temperature = 1.0
    best = F.transform(F.array(model.probabilities(F.col("grams"))), lambda p: F.array_position(p, F.array_max(p)))[0] - 1
    scores = rows.where("fold = 0").agg(*losses, F.avg((best == F.col("label").cast("int")).cast("double")).alias("right")).first()
    known = [(scores[i], t) for i, t in enumerate(TEMPERATURES) if scores[i] is not None]
    model.temperature, model.held_out = (min(known)[1] if known else 1.0), scores["right"]
    return model


def scan_licences(docs: DataFrame, model: Model | None = None, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.5, share: float = SHARE,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` plus n_paragraphs and licences: array of (paragraph, family, probability, confirmed) by paragraph number.

    Paragraphs are lines with text. Each one's most probable family counts if it isn't the unknown class and has a probability of at least
    ``least``; it is confirmed if the paragraph holds ``share`` of the word pairs of one of the family's templates. Everything is
    computed inside the row: no shuffle, weights and templates are constants of fixed size. Template words that are common in the
    corpus are told by counts over all its paragraphs, bar those that hold half of a template's word pairs; the classifier is fitted
    on the templates and on BACKGROUND of those paragraphs, drawn from all of them by the least values of a hash.

    A notice may be wrapped: neighbouring lines are judged joined, too, and count under their first line's number if they are confirmed
    and none of the lines is confirmed for that family by itself.

    Null or empty text: no paragraphs. Ties between families go to the first in order. Repeated rows and null ids are judged alike.
    Empty table: no rows. Input columns of the added names are replaced.
    """
    spark = docs.sparkSession
    by_family: dict[str, list[str]] = {}
    for f, t in templates:
        by_family.setdefault(f, []).append(t)

    def confirmed(words: Column, family: Column) -> Column:
        out = F.lit(False)
        for f, texts in by_family.items():
            holds = F.lit(False)
            for t in texts:
                want = template_pairs(t)
                holds = holds | (F.size(F.array_intersect(pairs_of(words), constants(want))) >= F.lit(share) * len(want))
            out = F.when(family == f, holds).otherwise(out)
        return out

    if model is None:
        others = other_paragraphs(docs, templates, doc_id, text)
        counts = word_counts(others, templates)
        some = least_hashes(others.select("h", "text"), "h", BACKGROUND, counts.get("", 0))
        model = fit(spark, stored(some.select("text"), "background"), templates, counts)
    keep = [c for c in docs.columns if c not in ("n_paragraphs", "licences")]
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")
    parts = paragraphs_of(text_of(text))
    lines = F.transform(parts, lambda p, i: F.struct((i + 1).alias("paragraph"), F.lit(0).alias("last"), p.alias("text")))
    worded = F.transform(F.concat(lines, blocks_of(text_of(text))), lambda u: F.struct(u["paragraph"].alias("paragraph"), u["last"].alias("last"), words_of(u["text"]).alias("w")))
    featured = F.transform(worded, lambda u: F.struct(u["paragraph"].alias("paragraph"), u["last"].alias("last"), u["w"].alias("w"), model.features(u["w"]).alias("g")))
    judged = F.transform(featured, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["last"].alias("last"), x["w"].alias("w"), model.probabilities(x["g"]).alias("p")))
    best = F.transform(judged, lambda j: F.struct(j["paragraph"].alias("paragraph"), j["last"].alias("last"), j["w"].alias("w"), F.array_max(j["p"]).alias("top"), F.get(F.array(*map(F.lit, model.families)), (F.array_position(j["p"], F.array_max(j["p"])) - 1).cast("int")).alias("family")))
    numbered = F.transform(best, lambda b: F.struct(b["paragraph"].alias("paragraph"), b["last"].alias("last"), b["family"].alias("family"), F.round(b["top"], 6).alias("probability"), b["w"].alias("w")))
    likely = F.filter(numbered, lambda b: (b["family"] != UNKNOWN) & (b["probability"] >= least))
    sure = F.transform(likely, lambda b: F.struct(b["paragraph"].alias("paragraph"), b["family"].alias("family"), b["probability"].alias("probability"), confirmed(b["w"], b["family"]).alias("confirmed"), b["last"].alias("last")))
    single = lambda o, b: F.exists(o, lambda x: (x["last"] == 0) & x["confirmed"] & (x["family"] == b["family"]) & x["paragraph"].between(b["paragraph"], b["last"]))
    wanted = F.transform(F.array(sure), lambda o: F.filter(o, lambda b: (b["last"] == 0) | (b["confirmed"] & ~single(o, b))))[0]
    out = F.array_sort(F.transform(wanted, lambda b: F.struct(b["paragraph"].alias("paragraph"), b["family"].alias("family"), b["probability"].alias("probability"), b["confirmed"].alias("confirmed"))))
    if model.intercepts[0] == max(model.intercepts):  # a text without a cue is unknown throughout
        cue = F.arrays_overlap(words_of(text_of(text)), F.array(*map(F.lit, model.cues)))
        out = F.when(cue, out).otherwise(none)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.size(parts).alias("n_paragraphs"), out.alias("licences"))
