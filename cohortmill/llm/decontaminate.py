"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm.fm_index import FMIndex
from cohortmill.llm.tokens import LOWER, NOT_ALNUM, Words, text_chunks

WINDOW = 13
BLOCK_BYTES = 16 << 20  # benchmark text searched at once
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
OWN = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_words": SPAN, "hit_chars": SPAN, "items": T.ArrayType(T.StringType())}


@dataclass
class Phrases:
    """Distinct windows of benchmark items as symbols 1..len(words); ``by_length``: (windows, item indices of each window)."""

    hashes: np.ndarray
    words: list[bytes]
    by_length: dict[int, tuple[np.ndarray, list[list[int]]]]
    items: list[str]


def phrases_of(rows: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of ``window`` words of each (item id, text); a shorter item, unless empty, is one window."""
    texts = [t or "" for _, t in rows]
    symbol: dict[bytes, int] = {}
    hashes: list[int] = []
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    at = 0
    for i, j, data, bounds in text_chunks(pa.array(texts, pa.large_string())):
        w = Words(data, bounds, NOT_ALNUM, lower=True)
        for k in range(j - i):
            ids = []
            for p in range(w.first[k], w.first[k + 1]):
                word = LOWER[np.frombuffer(w.word(p), np.uint8)].tobytes()
                if word not in symbol:
                    symbol[word] = len(symbol) + 1
                    hashes.append(int(w.hash[p]))
                ids.append(symbol[word])
            n = min(window, len(ids))
            for p in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[p:p + n]), set()).add(at + k)
        at += j - i
    if len(set(hashes)) < len(hashes):
        raise ValueError("two benchmark words share a hash")
    return Phrases(np.array(hashes, np.uint64), list(symbol), {n: (np.array(list(f), np.int64).reshape(-1, n), [sorted(x) for x in f.values()]) for n, f in found.items()},
                   ["null" if i is None else str(i) for i, _ in rows])


def _occurrences(w: Words, ph: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """First word, length and items of every occurrence of a window in a shard's texts."""
    none = np.zeros(0, np.int64)
    if not ph.by_length or not len(w.hash):
        return none, none, []
    by_hash = np.argsort(ph.hashes)
    k = np.minimum(np.searchsorted(ph.hashes, w.hash, sorter=by_hash), len(by_hash) - 1)
    symbols = np.where(ph.hashes[by_hash[k]] == w.hash, by_hash[k] + 1, 0)
    # Only runs of benchmark words within a text can hold a window; each run is a text of the index.
    known = symbols > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    firsts = w.first[:-1][w.first[:-1] < len(known)]
    begins[firsts] = known[firsts]
    start = np.flatnonzero(begins)
    breaks = np.flatnonzero(np.concatenate((~known | begins, [True])))
    end = breaks[np.searchsorted(breaks, start, side="right")]
    long_enough = end - start >= min(ph.by_length)
    start, end = start[long_enough], end[long_enough]
    if not len(start):
        return none, none, []
    size = end - start + 1  # with the closing 0
    base = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(base, size) + np.repeat(start, size)
    texts = symbols[np.minimum(place, len(symbols) - 1)]
    texts[base + size - 1] = 0
    index = FMIndex(texts, len(ph.hashes) + 1)
    at, length, items = [none], [none], []
    for n, (windows, owners) in ph.by_length.items():
        lo, hi = index.ranges(windows)
        hit = np.flatnonzero(lo < hi)
        if not len(hit):
            continue
        count = hi[hit] - lo[hit]
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)
        at.append(place[index.locate(rows)])
        length.append(np.full(len(rows), n))
        items.extend(owners[h] for h in np.repeat(hit, count))
    at, length = np.concatenate(at), np.concatenate(length)
    # Compare the words themselves, once for each word of an occurrence.
    step = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    touched = np.flatnonzero(np.cumsum(step)[:-1])
    lower = LOWER[w.data]
    wrong = [p for p in touched if lower[w.start[p]:w.end[p]].tobytes() != ph.words[symbols[p] - 1]]
    if wrong:
        bad = np.zeros(len(symbols) + 1, np.int64)
        bad[np.array(wrong) + 1] = 1
        bad = np.cumsum(bad)
        good = bad[at + length] == bad[at]
        at, length, items = at[good], length[good], [x for x, g in zip(items, good) if g]
    return at, length, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(batches: Iterator[pa.RecordBatch], ph: Phrases, text: str, keep: list[str], earlier: bool) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        for i, j, data, bounds in text_chunks(column):
            w = Words(data, bounds, NOT_ALNUM, lower=True)
            at, length, owners = _occurrences(w, ph)
            row = np.searchsorted(w.first, at, side="right") - 1
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for r, a, n, own in zip(row.tolist(), at.tolist(), length.tolist(), owners):
                a -= int(w.first[r])
                spans.setdefault(r, []).append((a, a + n))
                items.setdefault(r, set()).update(ph.items[o] for o in own)
            part = batch.slice(i, j - i)
            if earlier:  # what the blocks before have found
                for r, (old, was) in enumerate(zip(part.column("hit_words").to_pylist(), part.column("items").to_pylist())):
                    if old:
                        spans.setdefault(r, []).extend((s["start"], s["end"]) for s in old)
                        items.setdefault(r, set()).update(was)
            n = j - i
            hit_words, hit_chars, found = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            n_hit = np.zeros(n, np.int64)
            for r, s in spans.items():
                s = _merged(s)
                f = int(w.first[r])
                n_hit[r] = sum(b - a for a, b in s)
                hit_words[r] = [{"start": a, "end": b} for a, b in s]
                chars = np.cumsum((data[bounds[r]:bounds[r + 1]] & 0xC0) != 0x80)
                hit_chars[r] = [{"start": int(chars[w.start[f + a] - bounds[r]]) - 1, "end": int(chars[w.end[f + b - 1] - bounds[r] - 1])} for a, b in s]
                found[r] = sorted(items[r])
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.names.index(c)) for c in keep]
                + [pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hit_words, span), pa.array(hit_chars, span), pa.array(found, pa.list_(pa.string()))],
                names=keep + list(OWN),
            )


def contaminated() -> Column:
    """At least one word in 20 is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``docs`` plus n_words, n_hit, hit_words and hit_chars (merged spans, end exclusive) and items.

    A task reads its documents in shards of a few MB. Of each shard it indexes all runs of words that occur in the benchmark (a
    window can lie nowhere else), finds the windows by backward search and locates every occurrence. Nothing is shuffled.
    The benchmark is searched in blocks of about ``block_bytes``; only one block's phrases are on the driver and in a task at a
    time, and each further block is one more pass that merges its spans with the ones before.

    Null text: no words, no hits. An item with null or wordless text has no window; one of fewer than ``window`` words is one
    window; a null item id is listed as ``null``. Repeated rows are judged one by one. Empty benchmark: no hits; empty table: no
    rows. Input columns with the names of the added ones are replaced.
    """
    keep = [c for c in docs.columns if c not in OWN]
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks))
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*out.schema.fields, *[T.StructField(c, t) for c, t in OWN.items()]])
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in benchmark.where(block == b).select(item_id, item_text).collect()]
        ph = phrases_of(rows, window)
        search = (lambda ph, earlier: lambda it: _search(it, ph, text, keep, earlier))(ph, b > 0)
        out = out.mapInArrow(search, schema)
    return out
