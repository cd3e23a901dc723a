"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.llm.rows import stored, text_of

#: Topics by word endings (with the space after them) counted in the lower-cased text; the most frequent one holds, ties by name, none
#: at all is "other".
TOPICS = {"agents": ["er ", "or ", "eur "], "deeds": ["ing ", "ung ", "ment "], "things": ["tion ", "heit ", "eau ", "dad "]}
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
ROUNDS, TOLERANCE = 40, 0.002
OWN = ("tokens", "topic", "keep_rate", "selected")


def topic_of(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    low = F.lower(text)

    def count(ending: str) -> Column:
        return F.round((F.octet_length(low) - F.octet_length(F.replace(low, F.lit(ending), F.lit("")))) / len(ending.encode())).cast("int")

    ranked = [
        F.struct(sum((count(e) for e in endings), F.lit(0)).alias("n"), F.lit(-i).alias("k"), F.lit(t).alias("t")) for i, (t, endings) in enumerate(sorted(topics.items()), 1)
    ]
    best = F.array_max(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit("other").alias("t")), *ranked)).getField("t")
    return F.coalesce(best, F.lit("other"))  # never null, so a join on it needs no null test that counts once more


def draw(seed: int, doc_id: str, text: str) -> Column:
    """Number in [0, 1) fixed by seed, id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(text_of(text))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def level(df: DataFrame, raw: str, cap: str, whole: float = 1.0) -> Column:
    """``raw`` times a common scale, but at most ``cap``, so that all rows sum to ``whole`` (to the sum of ``cap`` if that is less).

    The scale is raised until no further row reaches its cap, by one aggregated row a step.
    """
    have = df.agg(F.sum(raw)).first()[0]
    if not have:
        return F.col(raw)
    scale, held = whole / have, 0
    while True:
        full = F.col(raw) * F.lit(scale) > F.col(cap)
        row = df.agg(F.count_if(full).alias("held"), F.sum(F.when(full, F.col(cap))).alias("used"), F.sum(F.when(~full, F.col(raw))).alias("free")).first()
        if row["held"] == held:
            return F.least(cap, F.col(raw) * F.lit(scale))
        held = row["held"]
        if not row["free"]:
            return F.when(F.col(raw) > 0, F.col(cap)).otherwise(0.0)
        scale = max(scale, (whole - row["used"]) / row["free"])


def margin(cells: DataFrame, column: str, share: DataFrame | None, power: float, stock: float) -> DataFrame:
    """Target share per value of ``column``: the given one (values without one get the least given), else tokens to ``power``; made to sum to 1.

    ``stock`` is the number of tokens that a share of 1 stands for. A value never gets more than it has (``n`` / ``stock``); what it has to leave
    goes to the others in proportion to their shares. Columns: the value, ``asked`` (before that) and ``target``.
    """
    have = cells.groupBy(column).agg(F.sum("n").alias("n"))
    if share is None:
        raw = have.select(column, F.pow("n", F.lit(power)).alias("raw"), "n")
    else:
        least = share.agg(F.min("share")).first()[0]
        raw = have.join(share.withColumnRenamed("value", column), column, "left").select(column, F.coalesce("share", F.lit(least)).alias("raw"), "n")
    raw = stored(raw.select(column, "raw", (F.col("n") / F.lit(stock)).alias("cap")), "margin")
    total = raw.agg(F.sum("raw")).first()[0]
    return raw.select(column, (F.col("raw") / F.lit(total)).alias("asked"), level(raw, "raw", "cap").alias("target"))


def rake(cells: DataFrame, margins: dict[str, DataFrame], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (n tokens) plus ``w``, the share of tokens wanted of each: fitted to one margin after the other, and after each
    round held to what the cell has (``n`` / (``budget`` * all tokens)) so that no document is needed twice. What a held cell gives up is
    made up by the other cells of its margins in the next round.

    Rounds end when no margin value and not the whole is further than ``tolerance`` (a share of all wanted tokens) from its target, or when a
    round brings them nearer by less than a quarter of that, at the latest after ``rounds``. Margins may be such that no sample meets all of them
    (a source of one language, say). The budget comes first then: what is missing is taken from all cells that have more, in proportion to
    their share, and ``marginals`` tells how near the margins came. A round reads the gap of the round before in its own passes.

    A source has a cell per language and topic, so its sum is a small window. Language sums are an aggregate with map-side combine
    joined back. Topics are a parameter or a column of few values, so their sums become constants. Each round ends in a stored table.
    """
    total = cells.agg(F.sum("n")).first()[0]
    if not total:
        return cells.withColumn("w", F.lit(0.0))
    out = cells.withColumn("w", F.col("n") / F.lit(float(total)))
    for column, target in margins.items():
        out = out.join(target.select(column, F.col("target").alias(f"t{column}")), column)
    out = stored(out, "cells")
    topics = {r["_topic"]: r["target"] for r in margins["_topic"].collect()}
    whole = min(1.0, 1.0 / budget)

    def fitted(have: Column, column: str) -> Column:
        return F.when(have > 0, F.col("w") * F.col(f"t{column}") / have).otherwise(F.col("w"))

    def off(have: Column, column: str) -> Column:
        return F.abs(have - F.col(f"t{column}"))

    last = 9.0
    for i in range(rounds + 1):
        have = F.sum("w").over(Window.partitionBy("_source"))
        first = out.withColumn("_old", F.col("w")).withColumn("_gap", off(have, "_source")).withColumn("w", fitted(have, "_source"))
        sums = first.groupBy("_lang").agg(F.sum("w").alias("_sum"), F.sum("_old").alias("_was"))
        second = first.join(sums, "_lang").withColumn("w", fitted(F.col("_sum"), "_lang")).withColumn("_gap", F.greatest("_gap", off(F.col("_was"), "_lang")))
        second = stored(second.drop("_sum", "_was"), "cells")
        rows = second.groupBy("_topic").agg(F.sum("w").alias("s"), F.sum("_old").alias("old"), F.max("_gap").alias("gap")).collect()
        gap = max([r["gap"] for r in rows] + [abs(r["old"] - topics[r["_topic"]]) for r in rows] + [abs(sum(r["old"] for r in rows) - whole)])
        if i == rounds or (i and (gap <= tolerance or gap > last - tolerance / 4)):
            break
        last = gap if i else last
        have = F.lit(0.0)
        for row in rows:
            have = F.when(F.col("_topic") == row["_topic"], F.lit(row["s"])).otherwise(have)
        out = second.withColumn("w", fitted(have, "_topic")).withColumn("w", F.least("w", F.col("n") / F.lit(budget * total))).drop("_old", "_gap")
    fit = second.withColumn("cap", F.col("n") / F.lit(budget * total))
    return fit.select("_source", "_lang", "_topic", "n", level(fit, "_old", "cap", whole).alias("w"))


def marginals(wanted: DataFrame, margins: dict[str, DataFrame]) -> DataFrame:
    """(margin, value, asked, target, reached): shares asked for, what of them the stock allows, and what the fitted cells give."""
    parts = [
        wanted.groupBy(c).agg(F.sum("w").alias("reached")).join(target, c).select(F.lit(c[1:]).alias("margin"), F.col(c).alias("value"), "asked", "target", "reached")
        for c, target in margins.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _cell_of(source: str, lang: str, text: str, topic: str | None, topics: dict[str, list[str]] | None) -> list[Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    tokens = F.regexp_count(text_of(text), F.lit(r"[^ \t-\r]+")).cast("long")
    theme = named(topic) if topic else topic_of(text_of(text), topics or TOPICS)
    return [named(source).alias("_source"), named(lang).alias("_lang"), theme.alias("_topic"), tokens.alias("_tokens")]


def fit_mixture(docs: DataFrame, budget: float = 0.5, languages: dict[str, float] | None = None, source_power: float = 0.5, topic_power: float = 0.5,
                topics: dict[str, list[str]] | None = None, source: str = "source", lang: str = "lang", text: str = "text", topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep rate per cell (_source, _lang, _topic), and the report of ``marginals``. Documents without any token: all rates 0, an empty report."""
    spark = docs.sparkSession
    cells = stored(docs.select(*_cell_of(source, lang, text, topic, topics)).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        rates = cells.select("_source", "_lang", "_topic", F.lit(0.0).alias("keep_rate"))
        return rates, spark.createDataFrame([], "margin string, value string, asked double, target double, reached double")
    share = spark.createDataFrame([(k, float(v)) for k, v in sorted((languages or LANGUAGES).items())], "value string, share double")
    stock = float(budget * total)
    margins = {"_source": margin(cells, "_source", None, source_power, stock), "_lang": margin(cells, "_lang", share, 1.0, stock), "_topic": margin(cells, "_topic", None, topic_power, stock)}
    wanted = rake(cells, margins, budget)
    rates = wanted.select("_source", "_lang", "_topic", F.round(F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(stock) / F.col("n"))).otherwise(0.0), 9).alias("keep_rate"))
    return rates, marginals(wanted, margins)


def mix_sources(docs: DataFrame, budget: float = 0.5, languages: dict[str, float] | None = None, source_power: float = 0.5, topic_power: float = 0.5,
                topics: dict[str, list[str]] | None = None, seed: int = 23, source: str = "source", lang: str = "lang", doc_id: str = "doc_id", text: str = "text",
                topic: str | None = None) -> DataFrame:
    """Columns of ``docs`` plus tokens (words), topic, keep_rate and selected: a sample whose tokens follow target marginals.

    Token counts per cell (source, language, topic) are raked to three margins: sources to tokens ** ``source_power``, topics to
    tokens ** ``topic_power``, languages to the given shares. A document is selected with probability budget * all tokens * w / n
    of its cell (at most 1), by a draw fixed by seed, id and text. Targets above the stock of a value pass to the others (``margin``);
    ``fit_mixture`` returns the wanted and reached marginals. ``topic`` names a column with topics (few values); without it topics
    come from word endings. Texts are read twice and never shuffled unless the cell table is too large to broadcast; a source with a third
    of all rows costs one row per cell and task.

    Null source, language or given topic: the value ``(none)``. Null or empty text: no tokens, keep rate of its cell (0 where the cell has no
    tokens). Repeated rows share their draw. Empty table: no rows. Input columns with the added names are replaced.
    """
    keep = [c for c in docs.columns if c not in OWN]
    rates, _ = fit_mixture(docs, budget, languages, source_power, topic_power, topics, source, lang, text, topic)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r")
    out = docs.select(row, *_cell_of(source, lang, text, topic, topics), draw(seed, doc_id, text).alias("_u")).join(rates, ["_source", "_lang", "_topic"])
    return out.select(*[F.col(f"r.`{c}`") for c in keep], F.col("_tokens").alias("tokens"), F.col("_topic").alias("topic"), "keep_rate", (F.col("_u") < F.col("keep_rate")).alias("selected"))
