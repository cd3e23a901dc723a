"""Removal of repeated word sequences with prefix-partitioned suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm.rows import id_key, text_of
from cohortmill.llm.tokens import SPACES, Words, mix, ngrams, text_chunks

WINDOW = 35
PREFIX = 8            # words of the shortest prefix
GROUP_ROWS = 50_000   # a prefix with more suffixes is lengthened to the whole window
TREE_ROWS = 30_000    # suffixes in memory at once, whole groups only

_Q = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Starts:
    """Chosen suffix starts of a chunk: of each window the leftmost smallest prefix hash, so equal windows choose alike.

    ``at`` word index, ``low``/``high`` least and greatest distance of the windows that chose it, ``text`` its row, ``key`` its prefix hash.
    """

    def __init__(self, w: Words, window: int, prefix: int):
        width = window - prefix + 1
        n = len(w.hash)
        self.w, self.window = w, window
        none = np.zeros(0, np.int64)
        self.at, self.low, self.high, self.text, self.key = none, none, none, none, np.zeros(0, np.uint64)
        if n < window:
            return
        g = ngrams(w.hash, prefix)
        best, size = np.arange(len(g)), 1
        while size * 2 <= width:
            a, b = best[:len(best) - size], best[size:]
            best = np.where(g[a] <= g[b], a, b)
            size *= 2
        if width > size:
            gap = width - size
            a, b = best[:len(best) - gap], best[gap:]
            best = np.where(g[a] <= g[b], a, b)
        text_of_word = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        begin = np.arange(len(best))
        begin = begin[text_of_word[:len(best)] == text_of_word[window - 1:]]  # windows within one text
        if not len(begin):
            return
        at = best[begin]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        self.at, self.high, self.low = at[new], at[new] - begin[new], at[new] - begin[last]
        self.text, self.key = text_of_word[self.at], g[self.at]

    def take(self, rows: np.ndarray) -> None:
        self.at, self.low, self.high, self.text, self.key = (x[rows] for x in (self.at, self.low, self.high, self.text, self.key))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit identity of words, distances and prefix place of each start's stretch."""
        b, e = self.at - self.high, self.at + self.window - self.low
        out = []
        for q in _Q:
            power = np.full(len(self.w.hash) + 1, q, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            inverse = np.full(len(self.w.hash) + 1, np.uint64(pow(int(q), -1, 2**64)), np.uint64)
            inverse[0] = 1
            inverse = np.multiply.accumulate(inverse)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.w.hash * power[:-1], dtype=np.uint64)))
            out.append(mix((total[e] - total[b]) * inverse[b] + (self.low * 64 + self.high).astype(np.uint64) * q))
        return out[0].view(np.int64), out[1].view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Prefix hash and how often each text's starts have it."""
    for batch in batches:
        r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, _, data, bounds in text_chunks(batch.column(2)):
            s = Starts(Words(data, bounds, SPACES, lower=False), window, prefix)
            order = np.lexsort((s.key, s.text))
            key, text = s.key[order], s.text[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate((new, [len(key)])))
            t = text[new] + i
            yield pa.RecordBatch.from_arrays([pa.array(r1[t]), pa.array(r2[t]), pa.array(key[new].view(np.int64)), pa.array(count.astype(np.int64))], names=["r1", "r2", "key", "n"])


def _repeated_starts(batch: pa.RecordBatch, window: int, prefix: int) -> Iterator[tuple[int, Starts]]:
    """(first row, starts with a repeated prefix); those of lengthened prefixes are split into single windows."""
    names = batch.schema.names
    keys, hot = batch.column(names.index("keys")), batch.column(names.index("hot"))
    for i, j, data, bounds in text_chunks(batch.column(names.index("text"))):
        s = Starts(Words(data, bounds, SPACES, lower=False), window, prefix)
        cut = np.searchsorted(s.text, np.arange(j - i + 1))
        keep, split = np.zeros(len(s.at), bool), np.zeros(len(s.at), bool)
        for r in range(j - i):
            if cut[r] == cut[r + 1]:
                continue
            own = s.key[cut[r]:cut[r + 1]].view(np.int64)
            keep[cut[r]:cut[r + 1]] = np.isin(own, keys[i + r].values.to_numpy())
            if len(hot[i + r]):
                split[cut[r]:cut[r + 1]] = np.isin(own, hot[i + r].values.to_numpy())
        whole, parts = np.flatnonzero(keep & ~split), np.flatnonzero(keep & split)
        each = s.high[parts] - s.low[parts] + 1
        rows = np.concatenate((whole, np.repeat(parts, each)))
        single = np.arange(len(rows)) >= len(whole)
        step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        s.take(rows)
        s.low[single] += step
        s.high[single] = s.low[single]
        s.single = single
        yield i, s


def _stretches(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Distinct stretches of a chunk: words around a start that all its windows cover. Lengthened prefixes need no words."""
    for batch in batches:
        for _, s in _repeated_starts(batch, window, prefix):
            c1, c2 = s.ids()
            _, first, count = np.unique(c1, return_index=True, return_counts=True)
            begin, end = s.at - s.high, s.at + window - s.low
            words = [None if s.single[r] else s.w.raw(begin[r], end[r]) for r in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.key[first].view(np.int64)), pa.array(c1[first]), pa.array(c2[first]), pa.array(s.low[first].astype(np.int32)),
                 pa.array(s.high[first].astype(np.int32)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64))],
                names=["key", "c1", "c2", "low", "high", "words", "n"])


def _places(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Where stretches stand: row, identity and word index of the last window."""
    for batch in batches:
        r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, s in _repeated_starts(batch, window, prefix):
            c1, c2 = s.ids()
            yield pa.RecordBatch.from_arrays(
                [pa.array(r1[s.text + i]), pa.array(r2[s.text + i]), pa.array(c1), pa.array(c2), pa.array((s.at - s.low - s.w.first[s.text]).astype(np.int32))],
                names=["r1", "r2", "c1", "c2", "last"])


def _nodes(columns: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
    """Node of every suffix at depth 0, 1, ...: each level splits the nodes by the next word, top down."""
    node = root
    yield node
    for depth in range(columns.shape[1]):
        _, node = np.unique(node * (columns[:, depth].max() + 2) + columns[:, depth] + 1, return_inverse=True)
        yield node


def repeated_windows(key: np.ndarray, words: Words, low: np.ndarray, high: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Per stretch a bit for each of its windows (distance ``low`` first) whose words also stand elsewhere.

    The stretch's words from the start on form a suffix; the words before it, read backwards, form another. A window at distance d
    is repeated if its suffix node of depth window - d and its backward node of depth d are shared, which is an internal node of
    the subtree at the depth of the whole window.
    """
    _, ids = np.unique(words.hash, return_inverse=True)
    rows = len(key)
    first, count = words.first[:-1], np.diff(words.first)

    def table(depth: int, step: int, size: np.ndarray) -> np.ndarray:
        k = np.arange(depth)
        place = (first + high)[:, None] + (k if step > 0 else -1 - k)[None, :]
        return np.where(k[None, :] < size[:, None], ids[np.clip(place, 0, len(ids) - 1)], -1)

    _, root = np.unique(key, return_inverse=True)
    right = list(_nodes(table(window, 1, count - high), root))
    left = list(_nodes(table(int(high.max()), -1, high), np.zeros(rows, np.int64)))
    mask = np.zeros(rows, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        have = np.flatnonzero((low <= d) & (d <= high))
        if len(have):
            _, node = np.unique(right[window - d][have] * rows + left[d][have], return_inverse=True)
            leaves = np.bincount(node, weights=n[have])
            mask[have] |= np.where(leaves[node] > 1, np.int64(1) << (d - low[have]), 0)
    return mask


def _subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    def build(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        for i, j, data, bounds in text_chunks(t.column("words"), limit=1 << 60):
            low, high = t.column("low").to_numpy().astype(np.int64), t.column("high").to_numpy().astype(np.int64)
            mask = repeated_windows(t.column("key").to_numpy(), Words(data, bounds, SPACES, lower=False), low, high, t.column("n").to_numpy(), window)
            hit = pa.array(mask != 0)
            yield pa.RecordBatch.from_arrays([t.column("c1").combine_chunks().filter(hit), t.column("c2").combine_chunks().filter(hit), pa.array(mask).filter(hit)], names=["c1", "c2", "mask"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TREE_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if whole:
                yield from build(t.slice(0, whole).combine_chunks())
                t = t.slice(whole).combine_chunks()
            held, size = t.to_batches(), t.num_rows
    if held:
        yield from build(pa.Table.from_batches(held).combine_chunks())


def _remove(batches: Iterator[pa.RecordBatch], window: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        found = batch.column(names.index("found"))
        for i, j, data, bounds in text_chunks(batch.column(names.index("text"))):
            w = Words(data, bounds, SPACES, lower=False)
            cover = np.zeros(len(w.hash) + 1, np.int64)
            for r in range(j - i):
                if found[i + r].is_valid:
                    s = found[i + r].values
                    last, mask = s.field("last").to_numpy().astype(np.int64), s.field("mask").to_numpy()
                    bit = np.flatnonzero((mask[:, None] >> np.arange(window)[None, :]).ravel() & 1)
                    begin = w.first[r] + last[bit // window] - bit % window
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[w.first[1:]] - total[w.first[:-1]]
            kept = np.flatnonzero(~gone)
            edges = np.searchsorted(kept, w.first)
            texts = [b" ".join([w.word(p) for p in kept[edges[r]:edges[r + 1]]]) for r in range(j - i)]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.names.index("payload")), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["payload", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, plus n_words, n_removed and kept_text (kept words joined by one space).

    A word is removed if one of the ``window``-word sequences of its text that cover it also starts anywhere else. Suffix starts are chosen by content (of the prefixes in a window the smallest hash), so that equal windows have the same start.
    1. Prefix hashes are counted with map-side combine; a prefix that occurs once has no internal node below it.
    2. Suffixes are grouped by prefix: PREFIX words, or the whole window where a prefix has more than ``group_rows`` suffixes. The stretch of words
       around a start travels once per distinct stretch, so thousands of copies are one leaf with a count.
    3. Per group the subtree is built top down, level by level; internal nodes as deep as the window mark repeated windows. A whole-window
       prefix is such a node itself, and its count decides.
    4. Marks go back to the rows that hold the stretch and the covered words are cut.
    Rows meet by (id, hash of text): equal rows get equal marks. The text is shuffled once, by that key, for steps 2 and 4.

    Null text: no words, kept_text ''. Fewer words than the window: nothing removed. Null ids are kept; repeated rows repeat each other, so
    their windows go. Empty table: no rows. Input columns n_words, n_removed and kept_text are replaced.
    """
    extra = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_text")]
    base = docs.select(id_key(doc_id).alias("r1"), F.xxhash64(text_of(text)).alias("r2"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("payload"), text_of(text).alias("text"))
    counted = base.select("r1", "r2", "text").mapInArrow(lambda it: _prefixes(it, window, prefix), "r1 long, r2 long, key long, n long")
    repeated = counted.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1")
    by_row = (
        counted.join(repeated, "key").groupBy("r1", "r2")
        .agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("all") > group_rows, F.col("key"))).alias("hot"))
    )
    marked = base.join(by_row, ["r1", "r2"])
    stretches = marked.mapInArrow(lambda it: _stretches(it, window, prefix), "key long, c1 long, c2 long, low int, high int, words string, n long")
    nodes = stretches.groupBy("key", "c1", "c2", "low", "high", "words").agg(F.sum("n").alias("n"))
    short = nodes.where("words is not null").repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _subtrees(it, window), "c1 long, c2 long, mask long")
    whole = nodes.where("words is null and n > 1").select("c1", "c2", F.lit(1).cast("long").alias("mask"))
    places = marked.mapInArrow(lambda it: _places(it, window, prefix), "r1 long, r2 long, c1 long, c2 long, last int")
    found = places.join(short.unionByName(whole), ["c1", "c2"]).groupBy("r1", "r2").agg(F.collect_set(F.struct("last", "mask")).alias("found"))
    schema = T.StructType([base.schema["payload"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    done = base.join(found, ["r1", "r2"], "left").select("payload", "text", "found").mapInArrow(lambda it: _remove(it, window, extra), schema)
    return done.select(*[F.col(f"payload.`{c}`") for c in extra], "n_words", "n_removed", "kept_text")
