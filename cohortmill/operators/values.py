"""Quantities, timeframes, negation and AND/OR reading of one criterion text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions import text as T

QUANTITY = "struct<operator:string,value_low:double,value_high:double,unit:string,raw_expression:string>"


def _unit(text: Column) -> Column:
    u = F.regexp_replace(T.strip_ws(text), r"[.,;:]+$", "")
    return F.when(F.length(u) > 0, u)


def _symbol(op: Column) -> Column:
    return F.when(op.isin("≤", "<=", "<"), "lte").otherwise("gte")


def quantity(text: Column) -> Column:
    """STRUCT of the first quantity form that applies, or null.

    Order: scientific, a-b, "a to b", word comparison at the start, symbol comparison. A symbol is
    never strict: > reads as gte and < as lte.
    """
    t = T.strip_ws(text)
    cs = lambda p: T.CS + p
    g = lambda p, n: F.regexp_extract(t, p, n)
    num = lambda p, n: g(p, n).try_cast("double")
    none_d = F.lit(None).cast("double")

    def made(op: Column, low: Column, high: Column, unit: Column) -> Column:
        return F.struct(op.alias("operator"), low.alias("value_low"), high.alias("value_high"), unit.alias("unit"),
                        t.alias("raw_expression"))

    sci, rng, cmp_ = cs(P.SCIENTIFIC), cs(P.RANGE), cs(P.COMPARISON)
    rng_w, word = T.ci(P.RANGE_WORDS), T.ci(P.WORD_COMPARISON)
    exponent = F.translate(g(sci, 3), P.SUPERSCRIPTS, "0123456789").try_cast("int")
    sci_unit = _unit(g(sci, 4))
    sci_unit = F.when(sci_unit.startswith("/"), sci_unit).otherwise(F.concat(F.lit("/"), sci_unit))
    word_op = F.when(F.lower(g(word, 1)).isin(P.UPWARD_WORDS), "gte").otherwise("lte")
    cmp_unit = _unit(g(cmp_, 3))
    relative = (cmp_unit.contains("ULN") | cmp_unit.contains("LLN")) & ~cmp_unit.startswith("×")
    cmp_unit = F.when(relative, F.concat(F.lit("× "), cmp_unit)).otherwise(cmp_unit)
    return (
        F.when(t.rlike(sci), made(_symbol(g(sci, 1)), num(sci, 2) * F.pow(F.lit(10.0), exponent), none_d, sci_unit))
        .when(t.rlike(rng), made(F.lit("range"), num(rng, 1), num(rng, 2), _unit(g(rng, 3))))
        .when(t.rlike(rng_w), made(F.lit("range"), num(rng_w, 1), num(rng_w, 2), _unit(g(rng_w, 3))))
        .when(t.rlike(word), made(word_op, num(word, 2), none_d, _unit(g(word, 3))))
        .when(t.rlike(cmp_), made(_symbol(g(cmp_, 1)), num(cmp_, 2), none_d, cmp_unit))
    )


def timeframe(text: Column) -> Column:
    """STRUCT<operator, value, unit> of the first timeframe form that occurs, or null."""
    out = F.lit(None).cast("struct<operator:string,value:double,unit:string>")
    for pattern, op in reversed(P.TIMEFRAMES):
        unit = F.concat(F.rtrim(F.regexp_replace(F.lower(F.regexp_extract(text, T.ci(pattern), 2)), "s+$", "")), F.lit("s"))
        found = F.struct(F.lit(op).alias("operator"), F.regexp_extract(text, T.ci(pattern), 1).try_cast("double").alias("value"),
                         unit.alias("unit"))
        out = F.when(T.has(text, pattern), found).otherwise(out)
    return out


def _position(text: Column, pattern: str) -> Column:
    """0-based position of the first match, or null."""
    before = F.regexp_extract(text, f"(?iUds)^(.*?)(?:{pattern})", 1)
    return F.when(T.has(text, pattern), F.length(before))


def exception_text(text: Column) -> Column:
    """Text after the first exception cue, or null when there is no cue."""
    after = F.regexp_extract(text, f"(?iUds)^.*?{P.EXCEPTION}(.*)$", 1)
    return F.when(T.has(text, P.EXCEPTION), T.strip_ws(after))


def exception_start(text: Column) -> Column:
    return _position(text, P.EXCEPTION)


def main_text(text: Column) -> Column:
    """Text before the first exception cue."""
    return F.when(T.has(text, P.EXCEPTION), F.regexp_extract(text, f"(?iUds)^(.*?){P.EXCEPTION}", 1)).otherwise(text)


def negation_start(text: Column) -> Column:
    """0-based position of the first negation before any exception cue, or null.

    "not limited to" and "not amenable to" are blanked out first, keeping positions.
    """
    masked = F.regexp_replace(main_text(text), T.ci(r"\bnot (?=limited to\b|amenable to\b)"), "....")
    return _position(masked, P.NEGATION)


def negated_mentions(text: Column, mentions: Column) -> Column:
    """Texts of the mentions after the negation; all of them when none follows it."""
    at = negation_start(text)
    after = F.filter(mentions, lambda m: m["start"] >= at)
    scope = F.when(F.size(after) > 0, after).otherwise(mentions)
    return F.when(at.isNotNull(), F.transform(scope, lambda m: m["text"])).otherwise(F.array().cast("array<string>"))


def logic_operator(text: Column) -> Column:
    """OR when and/or occurs, or an "or" outside phrases such as "cell or cell-free DNA"."""
    left = F.regexp_replace(text, T.ci(P.SAME_WORD_OR), " ")
    return F.when(T.has(text, P.AND_OR) | T.has(left, P.OR_WORD), "OR").otherwise("AND")
