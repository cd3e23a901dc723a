"""Secret scan behind a trigram inverted index."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rows import stored, text_of

BLOCK_ROWS = 4096
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds for Java, RE2 and Python alike. ``fold``: ASCII letters of the pattern's words match in either case
    (written out as classes, so that no engine folds other letters). A match counts when group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    fold: bool = False
    words: tuple[str, ...] = field(default=())


def either_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")

#: Fixed values of the base kinds, in their order; further kinds follow.
BASE = (
    Rule("assign", "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),  # runs are maximal, so shorter ones need not be matched first
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", "gh[opsru]_[A-Za-z0-9]{36,}", 1),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 1),
    Rule("google_api", "AIza[0-9A-Za-z_-]{35}", 1),
)


def _strings(node) -> set[str] | None:
    """All texts (lower case) that a parsed pattern can match, or None when they are not few."""
    out = {""}
    for op, arg in node:
        if op is rc.LITERAL:
            new = {chr(arg).lower()}
        elif op is rc.IN:
            new = set()
            for kind, value in arg:
                if kind is rc.LITERAL:
                    new.add(chr(value).lower())
                elif kind is rc.RANGE and value[1] - value[0] < 8:
                    new.update(chr(c).lower() for c in range(value[0], value[1] + 1))
                else:
                    return None
        elif op is rc.SUBPATTERN:
            new = _strings(arg[3])
        elif op is rc.BRANCH:
            parts = [_strings(p) for p in arg[1]]
            new = None if any(p is None for p in parts) else set().union(*parts)
        elif op is rc.MAX_REPEAT and arg[1] <= 1:
            new = _strings(arg[2])
            if new is not None and arg[0] == 0:
                new = new | {""}
        else:
            return None
        if new is None or len(out) * len(new) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in new}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Boolean trigram query: clauses that all hold; of a clause one alternative; of an alternative all trigrams.

    Runs of the pattern whose matches can be listed give a clause; other parts demand nothing. Empty list: no mandatory trigrams.
    """
    clauses, run = [], {""}

    def close() -> None:
        nonlocal run
        if run and min(map(len, run)) >= 3:
            alts = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((a for a in alts if not any(b < a for b in alts)), key=sorted))  # a longer demand adds nothing to a shorter one
        run = {""}

    for item in rp.parse(pattern):
        new = _strings([item])
        if new is None or len(run) * len(new) > MOST_STRINGS:
            close()
            run = new if new is not None else {""}
        else:
            run = {a + b for a in run for b in new}
    close()
    return clauses


def trigram_postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(block, trigram, ids): sorted row keys of a block of rows whose lower-cased text has the trigram.

    Each trigram of the queries is looked for in the text by itself: a list of all trigrams of a text would be larger than the text.
    """
    low = rows.select("block", "key", F.explode(F.array(F.lower(F.col("text")))).alias("low"))  # lower-cased once, not once per trigram
    have = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return (
        low.select("block", "key", F.explode(have).alias("trigram")).groupBy("block", "trigram")
        .agg(F.sort_array(F.collect_set("key")).alias("ids"))
    )


def candidates(postings: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(key, kinds): rows that satisfy each kind's Boolean query, by intersecting and uniting the postings of a block."""
    trigrams = sorted({t for clauses in queries.values() for c in clauses for alt in c for t in alt})
    empty = F.array().cast("array<bigint>")
    blocks = postings.groupBy("block").agg(*[
        F.coalesce(F.max(F.when(F.col("trigram") == t, F.col("ids"))), empty).alias(f"t{i}") for i, t in enumerate(trigrams)
    ])
    at = {t: F.col(f"t{i}") for i, t in enumerate(trigrams)}

    def fold(parts: list[Column], op) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = op(out, p)
        return out

    def tagged(ids: Column, kind: str) -> Column:
        return F.transform(ids, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))

    found = [
        tagged(fold([fold([fold([at[t] for t in sorted(alt)], F.array_intersect) for alt in clause], F.array_union) for clause in clauses], F.array_intersect), kind)
        for kind, clauses in queries.items()
    ]
    return (
        blocks.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.key").agg(F.collect_set("c.kind").alias("kinds"))
    )


def running_sums(values: Column) -> Column:
    """Sums of all values up to each place, in log2(n) passes over the array: each pass adds the value 1, 2, 4, … places before."""
    def add(sums: Column, step: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(0), step), F.slice(sums, F.lit(1), F.size(sums) - step))
        return F.zip_with(sums, before, lambda x, y: x + y)

    def summed(v: Column) -> Column:
        return F.aggregate(F.filter(F.array(*[F.lit(2**i) for i in range(31)]), lambda step: step < F.size(v)), v, add)

    return F.transform(F.array(values), summed)[0]  # bound to a variable, so that ``values`` is computed once


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) in code points of the rule's leftmost non-overlapping matches that count.

    Linear in the text but for the running sums, n log n in the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    parts = F.zip_with(F.zip_with(gaps, F.transform(whole, F.length), lambda g, w: F.struct(g.alias("gap"), F.coalesce(w, F.lit(0)).alias("len"))), F.transform(judged, F.length),
                       lambda x, j: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.coalesce(j, F.lit(-1)).alias("judged")))

    def spans(p: Column) -> Column:
        ends = running_sums(F.transform(p, lambda x: x["gap"] + x["len"]))
        placed = F.zip_with(p, ends, lambda x, e: F.struct((e - x["len"]).alias("start"), F.lit(rule.kind).alias("kind"), e.alias("end"), x["judged"].alias("judged")))
        return F.transform(F.filter(placed, lambda x: x["judged"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return F.when(text.rlike(rule.pattern), F.transform(F.array(parts), spans)[0]).otherwise(none)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Columns of ``docs`` plus ``secrets``: array of (start, kind, end), by start and then by the order of ``rules``.

    Each rule's pattern gives a Boolean trigram query. Trigrams that occur in a query are posted from the whole texts, in blocks of
    about ``block_rows`` rows so that no posting list grows with the table; the lists of a block are intersected and united, and only
    rows that satisfy a rule's query are matched against its pattern. Rules without mandatory trigrams scan every text.
    Row keys are hashes of id and text: repeated rows share one posting, and a collision only adds a candidate.
    Null text: empty, no secrets. Null ids are kept. Empty table: no rows. An input column ``secrets`` is replaced.
    """
    wanted = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    key = F.xxhash64(F.col(doc_id), text_of(text))
    n = docs.select(F.lit(1)).count()
    blocks = max(1, -(-n // block_rows))
    rows = docs.select(key.alias("key"), text_of(text).alias("text")).withColumn("block", F.pmod("key", F.lit(blocks)))
    trigrams = sorted({t for clauses in wanted.values() for c in clauses for alt in c for t in alt})
    keep = [c for c in docs.columns if c != "secrets"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), text_of(text).alias("t"), key.alias("key"))
    if trigrams:
        postings = stored(trigram_postings(rows, trigrams), "postings")
        whole = whole.join(candidates(postings, wanted), "key", "left")
    else:
        whole = whole.withColumn("kinds", F.lit(None).cast("array<string>"))
    t = F.col("t")
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    found = [
        F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), matches(t, r)).otherwise(none) if r.kind in wanted else matches(t, r)
        for r in rules
    ]

    def with_rank(f: Column, i: int) -> Column:
        return F.transform(f, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    ranked = F.array_sort(F.flatten(F.array(*[with_rank(f, i) for i, f in enumerate(found)])))
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return whole.select(*[F.col(f"r.`{c}`") for c in keep], spans.alias("secrets"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
