"""Dictionary tagging of criterion texts: mentions as ARRAY<STRUCT<text,label,start,end,expanded_text>>."""

from __future__ import annotations

import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.functions import patterns as P
from cohortmill.functions import text as T

MENTION = "struct<text:string,label:string,start:int,end:int,expanded_text:string>"
INLINE_PHRASES = 5_000
CHUNK = 64  # texts whose mentions are Python objects at a time


def _mention(text: Column, label, start: Column, end: Column) -> Column:
    return F.struct(
        text.alias("text"), (F.lit(label) if isinstance(label, str) else label).alias("label"),
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(None).cast("string").alias("expanded_text"))


def longest_first(spans: Column) -> Column:
    """Non-overlapping spans, longer ones first and then earlier ones; returned in text order."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        (-s["words"]).alias("w"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label"))))
    empty = F.array().cast("array<struct<w:int,start:int,end:int,text:string,label:string>>")
    kept = F.aggregate(ranked.cast("array<struct<w:int,start:int,end:int,text:string,label:string>>"), empty, lambda acc, s: F.when(
        F.exists(acc, lambda a: (s["start"] < a["end"]) & (a["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["text"], s["label"])))


def _variants(raw: str, words: list[str]) -> tuple[tuple[str, str], ...]:
    return ("exact", raw), ("lower", " ".join(raw.lower().split())), ("loose", " ".join(words))


def _phrase_parts(phrase: str, kind: str) -> tuple[list[str], tuple[str, str]]:
    words = [w.lower() for w in _WORD.findall(phrase)]
    return words, _variants(phrase, words)[_KINDS.index(kind)]


_WORD = re.compile(r"[^\W_]+")
_KINDS = ["exact", "lower", "loose"]


def _spans(text: str, reach: dict[str, int] | None, widest: int):
    """(raw, words, start, end) of the word runs that may be a phrase."""
    found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    for i, (word, start, _) in enumerate(found):
        limit = widest if reach is None else reach.get(word, 0)
        for n in range(1, min(limit, len(found) - i) + 1):
            end = found[i + n - 1][2]
            yield text[start:end], [w for w, _, _ in found[i:i + n]], start, end


def tag(df: DataFrame, phrases: DataFrame, text: str = "text", inline: int = INLINE_PHRASES) -> DataFrame:
    """Adds ``mentions`` from a phrase table (phrase, kind, label): longest phrase first, then the
    earlier one, no overlaps.

    A dictionary within ``inline`` phrases travels with the task and texts are tagged in Arrow
    batches. A larger one is never shipped: the word runs of each text are joined to it and the
    hits are grouped back by text. Both give the same mentions: an exact phrase goes before one in any
    case, that before one without punctuation; of several labels the least in order holds; a phrase
    without a word is never found.
    """
    rows = phrases.select("phrase", "kind", "label").limit(inline + 1).collect()
    if len(rows) > inline:
        return _tag_joined(df, phrases, text)
    table: dict[tuple[str, str], str] = {}
    reach: dict[str, int] = {}
    for r in rows:
        words, key = _phrase_parts(r["phrase"], r["kind"])
        if not words:
            continue
        table[key] = min(table.get(key, r["label"]), r["label"])
        reach[words[0]] = max(reach.get(words[0], 0), len(words))
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("expanded_text", pa.string())]))

    @F.arrow_udf(f"array<{MENTION}>")
    def mentions(column: pa.Array) -> pa.Array:
        # long texts hold many hits: only those of a few texts are Python objects at a time
        parts = [pa.array([found(v.as_py()) for v in column.slice(at, CHUNK)], type=kind) for at in range(0, len(column), CHUNK)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    def found(value: str | None) -> list[dict]:
        hits = []
        for raw, words, start, end in _spans(value or "", reach, 0):
            label = next((table[v] for v in _variants(raw, words) if v in table), None)
            if label:
                hits.append((-len(words), start, end, raw, label))
        # kept spans do not overlap, so a new one has to clear its two neighbours only
        starts, kept = [], []
        for h in sorted(hits):
            i = bisect_left(starts, h[1])
            if (i == 0 or kept[i - 1][2] <= h[1]) and (i == len(kept) or h[2] <= kept[i][1]):
                starts.insert(i, h[1])
                kept.insert(i, h)
        return [dict(text=k[3], label=k[4], start=k[1], end=k[2], expanded_text=None) for k in kept]

    return df.withColumn("mentions", mentions(F.col(text)))


def _tag_joined(df: DataFrame, phrases: DataFrame, text: str) -> DataFrame:
    split = F.filter(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    widest = phrases.select(F.max(F.size(split)).alias("w")).first()["w"] or 0
    kind = pa.list_(pa.struct([("key", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf("array<struct<key:string,text:string,start:int,end:int,words:int>>")
    def runs(column: pa.Array) -> pa.Array:
        return pa.array([[
            dict(key=f"{_KINDS.index(k)}:{v}", text=raw, start=start, end=end, words=len(words))
            for raw, words, start, end in _spans(value or "", None, widest) for k, v in _variants(raw, words)
        ] for value in column.to_pylist()], type=kind)

    low = F.lower("phrase")
    value = F.when(F.col("kind") == "exact", F.col("phrase")).when(F.col("kind") == "lower", F.regexp_replace(low, r"\s+", " ")).otherwise(
        F.array_join(split, " "))
    rank = F.when(F.col("kind") == "exact", "0").when(F.col("kind") == "lower", "1").otherwise("2")
    table = phrases.where(F.size(split) > 0).groupBy(F.concat_ws(":", rank, value).alias("key")).agg(F.min("label").alias("label"))
    texts = df.select(F.col(text).alias("_t")).distinct()
    hits = texts.select("_t", F.explode(runs(F.col("_t"))).alias("r")).select("_t", "r.*").join(table, "key")
    # a key begins with the place of its kind
    one = hits.groupBy("_t", "start", "end").agg(F.min(F.struct("key", "text", "words", "label")).alias("h"))
    grouped = one.groupBy("_t").agg(F.collect_list(F.struct(
        F.col("h.text").alias("text"), "start", "end", F.col("h.words").alias("words"), F.col("h.label").alias("label"))).alias("_hits"))
    found = F.transform(longest_first(F.col("_hits")), lambda s: _mention(s["text"], s["label"], s["start"], s["end"]))
    joined = df.join(grouped, F.col(text) == F.col("_t"), "left")
    return joined.withColumn("mentions", F.coalesce(found, F.array().cast(f"array<{MENTION}>"))).drop("_t", "_hits")


def add_regex_mentions(mentions: Column, text: Column, pattern: str, label: str) -> Column:
    """Adds spans of ``pattern`` unless a mention with the same label overlaps them."""
    pieces = F.split(text, T.ci(pattern))
    found = F.regexp_extract_all(text, F.lit(T.ci(pattern)), F.lit(0))
    # start of match k = lengths of the pieces up to k plus the matches before it
    spans = F.transform(found, lambda m, k: _mention(
        m, label,
        F.aggregate(F.slice(pieces, 1, k + 1), F.lit(0), lambda a, p: a + F.length(p))
        + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda a, p: a + F.length(p)),
        F.aggregate(F.slice(pieces, 1, k + 1), F.lit(0), lambda a, p: a + F.length(p))
        + F.aggregate(F.slice(found, 1, k + 1), F.lit(0), lambda a, p: a + F.length(p))))
    new = F.filter(spans, lambda s: ~F.exists(mentions, lambda m: (m["label"] == label) & (s["start"] < m["end"]) & (m["start"] < s["end"])))
    return F.when(T.has(text, pattern), F.concat(mentions, new)).otherwise(mentions)


def augment(df: DataFrame, text: str = "text") -> DataFrame:
    """Long spelled-out drug names, counted quantities ("at least 3") and durations ("18 years")."""
    t = F.col(text)
    d = df.withColumn("mentions", add_regex_mentions(F.col("mentions"), t, P.LONG_FORM_DRUG, "DRUG"))
    d = d.withColumn("mentions", add_regex_mentions(F.col("mentions"), t, P.CARDINAL, "CARDINAL"))
    return d.withColumn("mentions", add_regex_mentions(F.col("mentions"), t, P.DURATION, "DATE"))


def expand_abbreviations(df: DataFrame, abbreviations: dict[str, str]) -> DataFrame:
    """Sets expanded_text on single-word mentions found in the abbreviation dictionary."""
    lookup = F.from_json(F.lit(json.dumps(abbreviations)), "map<string,string>")
    keys = list(abbreviations)

    def expanded(m: Column) -> Column:
        low = F.lower(m["text"])
        value = F.when(~F.trim(m["text"]).contains(" ") & low.isin(keys), F.element_at(lookup, low))
        return F.struct(m["text"].alias("text"), m["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end"), value.alias("expanded_text"))

    return df.withColumn("mentions", F.transform("mentions", expanded))


def _mention_tokens(m: Column) -> Column:
    source = F.lower(F.coalesce(m["expanded_text"], m["text"]))
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def suppress_redundant(df: DataFrame) -> DataFrame:
    """Drops a mention whose words are a proper subset of another's: a disease under a disease or
    biomarker; a biomarker, drug or lab test under one with the same label."""
    tokened = F.transform("mentions", lambda m: F.struct(m.alias("m"), _mention_tokens(m).alias("t")))

    def subsumed(x: Column, all_: Column) -> Column:
        return F.exists(all_, lambda y: (F.size(y["t"]) > F.size(x["t"])) & (F.size(F.array_except(x["t"], y["t"])) == 0) & (
            ((x["m"]["label"] == "DISEASE") & y["m"]["label"].isin("DISEASE", "BIOMARKER"))
            | ((x["m"]["label"] == y["m"]["label"]) & x["m"]["label"].isin("BIOMARKER", "DRUG", "LAB_TEST"))))

    d = df.withColumn("_tm", tokened)
    kept = F.filter("_tm", lambda x: (F.size(x["t"]) == 0) | ~subsumed(x, F.col("_tm")))
    return d.withColumn("mentions", F.transform(kept, lambda x: x["m"])).drop("_tm")


def mentions_of(df: DataFrame, phrases: DataFrame, abbreviations: dict[str, str], text: str = "text") -> DataFrame:
    """Tagging, augmentation, abbreviation expansion and suppression in order."""
    return suppress_redundant(expand_abbreviations(augment(tag(df, phrases, text), text), abbreviations))
