"""Near-duplicate documents: an inverted join over min-hash signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.components import components, relabel
from cohortmill.llm.rows import NO_ID, id_key, stored, text_of
from cohortmill.llm.tokens import SPACES, Words, mix, ngrams, text_chunks

COORDINATES = 129
JOINED = 3  # coordinates posted together
SHARED = 8       # of their rarest shingles that two similar sets share, where the beginnings are so many longer
MISS = 1e-9  # chance that a pair just at the threshold falls below the match threshold

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def least_collisions(similarity: float, posts: int = COORDINATES // JOINED, joined: int = JOINED, miss: float = MISS) -> int:
    """Most collisions m such that a pair of this similarity has fewer than m with a chance of at most ``miss``."""
    p, below, m = similarity**joined, 0.0, 0
    while below + comb(posts, m) * p**m * (1 - p) ** (posts - m) <= miss:
        below += comb(posts, m) * p**m * (1 - p) ** (posts - m)
        m += 1
    return max(1, m)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words; with fewer words the whole sequence is one."""
    return np.unique(ngrams(words, min(k, len(words)))) if len(words) else words


def signature(sh: np.ndarray) -> np.ndarray:
    """Smallest scrambled value per coordinate."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sh), 1024):
        x = sh[i:i + 1024, None] ^ _XOR
        x *= _MUL
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    posts = COORDINATES // JOINED
    for batch in batches:
        for i, j, data, bounds in text_chunks(batch.column(2)):
            w = Words(data, bounds, SPACES, lower=True)
            n = np.zeros(j - i, np.int64)
            one, two = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            sig = np.zeros((j - i, COORDINATES), np.uint64)
            for r in range(j - i):
                sh = shingles(w.hash[w.first[r]:w.first[r + 1]], k)
                n[r] = len(sh)
                if len(sh):
                    one[r], two[r] = mix(sh ^ _XOR[0]).sum(), mix(sh ^ _XOR[1]).sum()
                    sig[r] = signature(sh)
            sig = mix(sig)
            keys = np.zeros((j - i, posts), np.uint64)
            for c in range(JOINED):
                keys = mix(keys + sig[:, c::JOINED])
            keys = mix(keys + np.arange(posts, dtype=np.uint64))  # a coordinate value counts at its own coordinate only
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, posts, 0)))), pa.int32())
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(keys[n > 0].ravel().view(np.int64)))],
                names=["r1", "r2", "n", "s1", "s2", "keys"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row per distinct shingle of a text."""
    for batch in batches:
        for i, j, data, bounds in text_chunks(batch.column(1)):
            w = Words(data, bounds, SPACES, lower=True)
            sets = [shingles(w.hash[w.first[r]:w.first[r + 1]], k) for r in range(j - i)]
            row = pa.array(np.repeat(np.arange(i, j), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, last_set = None, None
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        left = batch.column(2)
        for i, j, data, bounds in text_chunks(batch.column(3)):
            w = Words(data, bounds, SPACES, lower=True)
            for r in range(j - i):
                b = shingles(w.hash[w.first[r]:w.first[r + 1]], k)
                text = left[i + r].as_py()
                if text != last:
                    _, _, d, bo = next(text_chunks(pa.array([text])))
                    last, last_set = text, shingles(Words(d, bo, SPACES, lower=True).hash, k)
                common = len(np.intersect1d(last_set, b, assume_unique=True))
                keep[i + r] = 100 * common >= percent * (len(last_set) + len(b) - common)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


NODE = "struct<r:bigint,s:bigint>"


def near_duplicates(docs: DataFrame, shingle_words: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id, kept, first) per row: groups of documents linked by Jaccard similarity of their
    shingle sets of at least ``percent`` per cent. ``row_hash`` is xxhash64 of the text.

    Equal sets are one class, so copies are never paired. Classes are posted under their signature coordinates, JOINED of them at a
    time. Prefix: first the lists that a pair above the match threshold cannot all avoid are merged against their most connected
    members. Collisions of these pairs are counted over all coordinates; pairs with enough of them are confirmed on full sets, which puts most
    members of a list into one component. Skip: lists whose members are all connected are passed over. Members of the other lists
    meet exactly: two sets as similar as wanted share one of their rarest shingles (as many as may differ and one more) and SHARED of the
    beginnings that are as much longer, so only these are posted and merged, pairs within a component are skipped, and the rest are counted and confirmed alike. No list of near copies is
    expanded into its pairs, and a pair within one component needs no link of its own, so components are complete.

    Words are split at space and \\t to \\r, A-Z lower-cased; fewer words than a shingle: the whole sequence is one.
    Null or wordless text: no shingles, linked with nothing. A null id sorts last and gives a null component only to itself;
    repeated rows form one group. ``kept``: doc_id = component_id; ``first``: the one row (up to repeated rows) that stays of a
    group. Empty table: no rows.
    """
    rows = docs.select(id_key(doc_id).alias("r1"), F.xxhash64(text_of(text)).alias("r2"), text_of(text).alias("text"))
    signed = stored(rows.mapInArrow(lambda it: _signatures(it, shingle_words), "r1 long, r2 long, n long, s1 long, s2 long, keys array<long>"), "signatures")
    full = signed.where("n > 0")
    classes = stored(
        full.groupBy("n", "s1", "s2").agg(F.min(F.struct("r1", "r2")).alias("rep"), F.first("keys").alias("keys"))
        .select("n", "s1", "s2", F.struct(F.col("rep.r1").alias("r"), F.col("s1").alias("s")).alias("node"), F.col("rep.r2").alias("r2"), "keys"), "classes")
    posts = COORDINATES // JOINED
    enough = least_collisions(percent / 100)
    posted = classes.select("node", F.posexplode("keys").alias("place", "key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stored(posted.join(sizes, "key"), "postings")
    central = met.groupBy("node").agg(F.sum("size").alias("weight"))
    lists = stored(met.join(central, "node").select("place", "key", "node", "weight"), "lists")
    wanted = classes.join(central, "node", "left_semi").select(F.col("node.r").alias("r1"), "r2", "node", "keys")
    texts = stored(rows.join(wanted, ["r1", "r2"]).groupBy("node").agg(F.first("text").alias("text"), F.first("keys").alias("keys")), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs with enough collisions whose full sets are similar enough."""
        with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb"), F.col("keys").alias("kb")), "b")
        both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta"), F.col("keys").alias("ka")), "a")
        both = both.where(F.size(F.array_intersect("ka", "kb")) >= enough).select("a", "b", "ta", "tb")
        return both.mapInArrow(lambda it: _confirm(it, shingle_words, percent), f"a {NODE}, b {NODE}")

    # Prefix: a pair with enough collisions has one at these places. The most connected member of a list leads it.
    leaders = lists.where(F.col("place") <= posts - enough).groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    led = lists.join(leaders, "key").where(F.col("node") != F.col("top.node")).select(
        F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    labels = components(confirmed(led))
    # Skip: lists whose members are all connected are done with. The members of the others are compared over their rarest shingles.
    named = lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("key")
    open_ = stored(named.join(mixed, "key", "left_semi").groupBy("node").agg(F.first("label").alias("label")), "open")
    listed = stored(texts.join(open_, "node", "left_semi").select("node", "text").mapInArrow(lambda it: _shingle_rows(it, shingle_words), f"node {NODE}, shingle long"), "shingles")
    often = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    sets = listed.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s")).withColumn("n", F.size("s"))
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)).cast("int") + 1
    lead = F.transform(F.slice("s", 1, prefix + SHARED - 1), lambda x: x["shingle"])
    rare = sets.select("node", "n", lead.alias("lead"), F.posexplode(F.slice("s", 1, prefix)).alias("at", "x")).where("x.often > 1").join(open_, "node")
    rare = stored(rare.select("x.shingle", "node", "label", "n", (F.col("at") + 1).alias("at"), "lead"), "rare")
    left = rare.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "at", "lead")])
    right = rare.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "at", "lead")])
    # What two sets of these sizes have in common at least; what follows their first common shingle, and the beginnings of both, must allow it.
    common = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent)).cast("int")
    begin = lambda side: F.slice(f"lead_{side}", F.lit(1), F.col(f"n_{side}") - common + SHARED)
    fits = (
        (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= common)
        & (F.size(F.array_intersect(begin("a"), begin("b"))) >= F.least(F.lit(SHARED), common))
    )
    rest = left.join(right, "shingle").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = confirmed(rest)
    of = labels.select(F.col("node"), F.col("label"))
    between = (
        more.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    further = components(between)
    all_labels = relabel(labels, further).unionByName(further.join(labels, "node", "left_anti"))
    of_class = classes.join(all_labels, "node", "left").select("n", "s1", "s2", F.coalesce("label", "node").alias("label"), "node", F.col("r2").alias("rep2"))
    out = signed.select("r1", "r2", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(
        back(F.col("r1")).alias("doc_id"), F.col("r2").alias("row_hash"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, back(F.col("r1"))).otherwise(back(F.col("label.r"))).alias("component_id"),
        ((F.col("n") == 0) | (F.col("label.r") == F.col("r1"))).alias("kept"),
        ((F.col("n") == 0) | ((F.col("label") == F.col("node")) & (F.col("node.r") == F.col("r1")) & (F.col("rep2") == F.col("r2")))).alias("first"),
    )
