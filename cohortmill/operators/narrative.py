"""Narrative text to criterion texts: sections, items, polarity and clause decomposition.

All of it happens inside the row that holds the text, with regular-expression splits and array
functions, so turning narratives into items needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions import text as T
from cohortmill.functions.scale import each

_EOL = r"(?=\n|\z)"
_HEADER = f"(?:{P.INCLUSION_HEADER}|{P.EXCLUSION_HEADER}){_EOL}"
_BOUNDARY = f"(?:{P.MARKER}|{P.INTRO_LINE}{_EOL})"


def _lines_joined(piece: Column) -> Column:
    return T.strip_ws(F.when(piece.contains("\n"), F.regexp_replace(piece, r"(?U)\s*\n\s*", " ")).otherwise(piece))


def _drop_line(piece: Column) -> Column:
    return F.regexp_replace(piece, r"(?d)\A[^\n]*\n?", "")


def polarity(text: Column) -> Column:
    """exclusion when any exclusion signal occurs, else inclusion."""
    hit = F.lit(False)
    for p, hint in zip(P.EXCLUSION_SIGNALS, P.EXCLUSION_HINTS, strict=True):
        hit = hit | (F.lower(text).contains(hint) & T.has(text, p))
    return F.when(hit, "exclusion").otherwise("inclusion")


def has_headers(text: Column) -> Column:
    return T.has(F.concat(F.lit("\n"), T.strip_ws(text)), f"\\n{_HEADER}")


def _region_items(region: Column) -> Column:
    """Items of one region: a marker line with everything under it is one item; under a header, an
    introduction or an empty marker every unindented line starts an item."""
    unmarked = F.regexp_replace(region, T.ci(rf"\A{P.MARKER}"), "")
    is_marker = region.rlike(T.ci(rf"\A{P.MARKER}"))
    first_has_text = unmarked.rlike(r"(?Ud)\A[^\n]*\S")
    is_intro = region.rlike(T.ci(rf"\A{P.INTRO_LINE}{_EOL}"))
    loose = F.when(is_intro | is_marker, _drop_line(region)).otherwise(region)
    pieces = F.transform(F.split(loose, r"(?Ud)\n(?=\S)"), _lines_joined)
    return F.when(is_marker & first_has_text, F.array(_lines_joined(unmarked))).otherwise(pieces)


def section_items(text: Column) -> Column:
    """ARRAY<STRUCT<section, text>> of a narrative, in order. ``section`` is the header's type."""
    body = F.regexp_replace(T.strip_ws(text), r"(?Ud)(?:\n[^\S\n]*)+(?=\n)", "")
    sections = F.split(body, T.ci(rf"\n(?={_HEADER})"))

    def items(section: Column) -> Column:
        headed = section.rlike(T.ci(rf"\A{_HEADER}"))
        kind = F.when(section.rlike(T.ci(rf"\A{P.EXCLUSION_HEADER}{_EOL}")), "exclusion").otherwise("inclusion")
        content = F.concat(F.lit("\n"), F.when(headed, _drop_line(section)).otherwise(section))
        regions = F.transform(F.split(content, T.ci(rf"\n(?={_BOUNDARY})")), lambda r: F.regexp_replace(r, r"\A\n", ""))
        texts = F.filter(F.flatten(F.transform(regions, _region_items)), lambda t: F.length(t) > 0)
        return F.transform(texts, lambda t: F.struct(kind.alias("section"), t.alias("text")))

    return F.flatten(F.transform(sections, items))


def split_items(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per item: key, item_no, text, type, review flag of a polarity override."""
    rows = (
        # what holds for the whole text is made before its items, or it would be made again for each of them
        each(docs.where(F.length(T.strip_ws(F.col("text"))) > 0)
             .select(key, has_headers(F.col("text")).alias("headed"), section_items(F.col("text")).alias("_items")), F.col("_items"), "item_no", "item")
        .select(key, "headed", "item_no", F.col("item.section").alias("section"), F.col("item.text").alias("text"))
    )
    detected = polarity(F.col("text"))
    override = F.col("headed") & (F.col("detected") == "exclusion") & (F.col("section") == "inclusion")
    return rows.withColumn("detected", detected).select(
        key, "item_no", "text",
        F.when(F.col("headed") & ~override, F.col("section")).otherwise(F.col("detected")).alias("type"),
        override.alias("review_required"),
        F.when(override, "polarity_override").alias("review_reason"),
        "headed", "detected",
    )


# ------------------------------------------------------------ clause splitting

def _depth_after(piece: Column, depth: Column) -> Column:
    """Bracket depth after ``piece``; unmatched closing brackets do not go below zero."""
    marks = F.filter(F.split(F.regexp_replace(piece, r"[^()]", ""), ""), lambda c: c != "")
    return F.aggregate(marks, depth, lambda d, c: F.when(c == "(", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))


def split_top_level(text: Column, delimiter: str) -> Column:
    """Split at ``delimiter`` outside brackets; parts are stripped of " ,;" and empties dropped.

    The text is cut at every delimiter first and pieces inside brackets are put together again, so
    the fold runs over pieces, not characters.
    """
    cut = F.split(F.regexp_replace(text, f"(?iUd)({delimiter})", "\u0001$1\u0001"), "\u0001")
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"), F.lit(0).alias("i"))

    def step(s: Column, piece: Column) -> Column:
        is_delim = s["i"] % 2 == 1
        split_here = is_delim & (s["depth"] == 0)
        return F.struct(
            F.when(is_delim, s["depth"]).otherwise(_depth_after(piece, s["depth"])).alias("depth"),
            F.when(split_here, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]).alias("parts"),
            F.when(split_here, F.lit("")).otherwise(F.concat(s["now"], piece)).alias("now"),
            (s["i"] + 1).alias("i"),
        )

    parts = F.aggregate(cut, zero, step, lambda s: F.concat(s["parts"], F.array(s["now"])))
    return F.filter(F.transform(parts, lambda p: T.strip_chars(p, " ,;")), lambda p: F.length(p) > 0)


def split_and(text: Column) -> Column:
    return split_top_level(text, " and ")


def split_or(text: Column) -> Column:
    return split_top_level(text, " and/or | or ")


def split_commas(text: Column) -> Column:
    return split_top_level(text, ",")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(text, T.ci(pattern), n)


def _rstrip(col: Column, chars: str) -> Column:
    return F.rtrim(col) if chars == " " else F.regexp_replace(col, f"[{chars}]+$", "")


def _bare(part: Column) -> Column:
    return F.regexp_replace(T.strip_ws(F.regexp_replace(T.strip_ws(part), r"^[* ]+", "")), r"(?i)^(?:and|or)\s+", "")


def _clauses(ok: Column, texts: Column, operator: str) -> Column:
    return F.when(ok, F.struct(texts.alias("texts"), F.lit(operator).alias("operator")))


def labelled_clauses(text: Column) -> Column:
    """"..., including: a) X; b) Y" for documented HER2-positive breast cancer: two AND clauses."""
    prefix, first, second = (T.strip_ws(_group(text, P.LABELLED, n)) for n in (1, 2, 3))
    first = _rstrip(first, ".;")
    ok = (
        text.contains(";") & T.has(text, P.LABELLED) & T.has(prefix, r"histopathology\s+and/or\s+cytology\s+documented")
        & F.lower(first).contains("breast cancer") & F.lower(second).contains("her2-positive")
    )
    suffix = "documented by histopathology and/or cytology"
    first = F.when(F.lower(first).contains(suffix), first).otherwise(F.concat(first, F.lit(" " + suffix)))
    return _clauses(ok, F.array(first, second), "AND")


def diagnosis_medication_clauses(text: Column) -> Column:
    """Diagnosis or medication: OR clauses, the shared time tail repeated on each medication."""
    g = lambda n: _group(text, P.DIAGNOSIS_OR_MEDICATION, n)
    medication = T.strip_ws(g(4))
    verb = T.strip_ws(_group(medication, P.MEDICATION_LEMMA, 1))
    body = T.strip_ws(_group(medication, P.MEDICATION_LEMMA, 2))
    tail = T.strip_ws(F.regexp_extract(body, T.ci(P.TEMPORAL_TAIL), 0))
    head = F.when(T.has(body, P.TEMPORAL_TAIL), T.strip_chars(F.regexp_replace(body, T.ci(P.TEMPORAL_TAIL), ""), " ,;")).otherwise(body)
    parts = split_or(head)
    parts = F.filter(F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(head)), _bare), lambda p: F.length(p) > 0)
    diagnosis = T.strip_ws(F.concat(g(1), g(2), F.lit(" a diagnosis of "), T.strip_ws(g(3))))
    meds = F.transform(parts, lambda p: T.strip_ws(F.concat(
        g(1), verb, F.lit(" "), p, F.when(F.length(tail) > 0, F.concat(F.lit(" "), tail)).otherwise(F.lit("")))))
    ok = T.has(text, P.DIAGNOSIS_OR_MEDICATION) & T.has(medication, P.MEDICATION_SIGNAL) & T.has(medication, P.MEDICATION_LEMMA) & (F.size(parts) > 0)
    return _clauses(ok, F.concat(F.array(diagnosis), meds), "OR")


def including_progression_clauses(text: Column) -> Column:
    """"Has X, including disease progression after receiving Y": head and tail as AND clauses."""
    lemma, head, tail = (T.strip_ws(_group(text, P.INCLUDING_PROGRESSION, n)) for n in (1, 2, 3))
    first = _rstrip(T.strip_ws(F.concat(lemma, F.lit(" "), head)), ";,")
    tail = _rstrip(tail, " .;")
    second = T.strip_ws(F.concat(lemma, F.when(F.lower(tail).startswith("disease progression"), " documented ").otherwise(" "), tail))
    return _clauses(text.contains(",") & T.has(text, P.INCLUDING_PROGRESSION), F.array(first, second), "AND")


def progression_clauses(text: Column) -> Column:
    """"progression after receiving A and B": the prefix is repeated on each part."""
    prefix = T.strip_ws(_group(text, P.PROGRESSION_AFTER, 1))
    parts = split_and(_group(text, P.PROGRESSION_AFTER, 2))
    texts = F.transform(parts, lambda p: T.strip_ws(F.concat(prefix, F.lit(" "), T.strip_ws(p))))
    return _clauses(F.lower(text).contains("after") & T.has(text, P.PROGRESSION_AFTER) & (F.size(parts) >= 2), texts, "AND")


def following_types_clauses(text: Column) -> Column:
    """"of the following types: A, B, who ...": prefix, item and tail for each item, as OR clauses."""
    prefix = _rstrip(T.strip_ws(_group(text, P.FOLLOWING_TYPES, 1)), ":,")
    prefix = T.strip_chars(F.regexp_replace(prefix, T.ci(r"\bsolid\s+tumou?rs?\b\s*$"), ""), " ,:")
    items = split_commas(_group(text, P.FOLLOWING_TYPES, 2))
    tail = T.strip_ws(_group(text, P.FOLLOWING_TYPES, 3))
    names = F.filter(F.transform(items, _bare), lambda p: F.length(p) > 0)
    # array_join over non-empty pieces keeps single spaces
    texts = F.transform(names, lambda n: T.strip_ws(F.array_join(F.filter(F.array(prefix, n, tail), lambda x: F.length(x) > 0), " ")))
    ok = text.contains(":") & T.has(text, P.FOLLOWING_TYPES) & (F.size(items) >= 2) & (F.size(names) >= 2)
    return _clauses(ok, texts, "OR")


RULES = {
    "labelled": labelled_clauses,
    "diagnosis_medication": diagnosis_medication_clauses,
    "including_progression": including_progression_clauses,
    "progression_after": progression_clauses,
    "following_types": following_types_clauses,
}


def decompose(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Items to atomic clauses: the first rule that applies wins; other items pass unchanged.

    A split item gets a group id from its key and position, the same on every run.
    """
    stripped = T.strip_ws(F.col("text"))
    out = items
    for name, rule in RULES.items():
        out = out.withColumn(f"_{name}", rule(stripped))
    chosen = F.coalesce(*[F.col(f"_{n}") for n in RULES])
    which = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in RULES])
    group = F.sha1(F.concat_ws(":", F.col(key).cast("string"), F.col("item_no").cast("string")))
    read = out.withColumn("_split", chosen).withColumn("split_rule", which).select(
        *[c for c in items.columns if c != "text"], F.col("text").alias("source_sentence"), "split_rule",
        F.when(F.col("_split").isNotNull(), group).alias("logic_group_id"),
        F.col("_split.operator").alias("logic_operator"),
        F.coalesce(F.col("_split.texts"), F.array("text")).alias("_texts"),
    )
    return each(read, F.col("_texts"), "clause_no", "text").drop("_texts").withColumn("source_clause_text", F.col("text"))
