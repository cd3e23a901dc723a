"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cohortmill.llm.components import components, relabel
from cohortmill.llm.rows import least_hashes, stored

LIST = 16        # neighbours kept per vector while the graph is refined
TREES = 10       # random hyperplane splits that start the graph
LEAF = 64        # vectors compared with one another at the start
ROUNDS = 2       # refinements between two audits
AUDITS = 12      # audits below RECALL, after which the search fails
RECALL = 0.97    # of a vector's links, on average, at which refinement ends
ASKED = 256      # vectors of an audit
LINKED = 64      # unsaturated vectors with links that an audit asks for
FURTHER = 1_024  # unsaturated vectors drawn next until there are so many; each draw is twice the last
LARGEST = 8_192  # vectors of one draw, at most
BLOCK = 256      # vectors compared at once in an enlarged neighbourhood

EDGES = "node long, near array<struct<sim:double,other:long>>, roots array<long>"


def _matrix(column: pa.Array, rows: np.ndarray, kind: str) -> np.ndarray:
    """Vectors of equally long binaries as unit rows in double precision."""
    x = np.stack([np.frombuffer(column[r].as_buffer(), kind) for r in rows.tolist()]).astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        size = np.linalg.norm(x, axis=1)
    odd = ~np.isfinite(size) | (size < 1e-140)
    if odd.any():  # squares of these would leave the range of doubles
        x[odd] /= np.abs(x[odd]).max(axis=1)[:, None]
        size[odd] = np.linalg.norm(x[odd], axis=1)
    return x / size[:, None]


def _equal_runs(*columns: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def _planted(batches: Iterator[pa.RecordBatch], depth: int, seed: int, trees: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Side of each hyperplane per tree, and one more projection that orders a leaf."""
    for batch in batches:
        column = batch.column(1)
        width = np.array([len(v.as_buffer()) for v in column])
        for size in np.unique(width).tolist():
            rows = np.flatnonzero(width == size)
            x = _matrix(column, rows, kind)
            planes = np.random.default_rng([seed, size]).normal(size=(x.shape[1], trees, depth + 1))
            side = np.einsum("nd,dtk->ntk", x, planes)
            code = ((side[:, :, :depth] > 0) << np.arange(depth)).sum(axis=2) if depth else np.zeros((len(rows), trees), np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t * 1_000_000 + size, np.int64)), pa.array(code[:, t].astype(np.int64)), pa.array(side[:, t, depth]),
                     batch.column(0).take(pa.array(rows)), column.take(pa.array(rows)), batch.column(2).take(pa.array(rows))], names=["tree", "code", "place", "node", "v", "group"])


def _tables(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Sorted batches joined to tables of about ``least`` rows that end where the keys change."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            runs = _equal_runs(*[t.column(k).to_numpy() for k in keys])
            if len(runs) > 2:
                yield t.slice(0, int(runs[-2])).combine_chunks()
                t = t.slice(int(runs[-2])).combine_chunks()
            elif size >= 4 * least:  # one long run
                yield t
                t = t.slice(t.num_rows)
            held, size = t.to_batches(), t.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(nodes: np.ndarray, sims: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sims]))).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(sims) if sims else np.zeros(0)), pa.array(np.concatenate(others) if others else np.zeros(0, np.int64))], names=["sim", "other"])
    roots = pa.ListArray.from_arrays(pa.array(np.zeros(len(nodes) + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(offsets), flat), roots], names=["node", "near", "roots"])


def _ties(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The links (a, b) as one row per node: the smallest node that it is connected with."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    low, new = None, np.arange(len(ids))
    while low is None or (new != low).any():
        low = new
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
    rows = np.flatnonzero(low != np.arange(len(ids)))
    none = _lists(ids[rows], [np.zeros(0)] * len(rows), [np.zeros(0, np.int64)] * len(rows))
    roots = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), pa.array(ids[low[rows]]))
    return pa.RecordBatch.from_arrays([none.column(0), none.column(1), roots], names=["node", "near", "roots"])


def _leaves(batches: Iterator[pa.RecordBatch], size: int, keep: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Nearest of each vector in pieces of at most 2 * size rows of a leaf, those of its group excluded, and what links tie together."""
    for t in _tables(batches, ["tree", "code"], 4096):
        node, group, v = t.column("node").to_numpy(), t.column("group").to_numpy(), t.column("v").chunk(0)
        one, two = [], []
        runs = _equal_runs(t.column("tree").to_numpy(), t.column("code").to_numpy())
        nodes, sims, others = [], [], []
        for a, b in zip(runs[:-1], runs[1:]):
            for lo in range(a, b, 2 * size):
                rows = np.arange(lo, min(b, lo + 2 * size))
                if len(rows) < 2:
                    continue
                x = _matrix(v, rows, kind)
                s = x @ x.T
                s[group[rows][:, None] == group[rows][None, :]] = -2
                k = min(keep, len(rows) - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(s, best, 1)
                fine = near > -2
                nodes.append(node[rows])
                sims.extend(near if fine.all() else [r[f] for r, f in zip(near, fine)])
                others.extend(node[rows][best] if fine.all() else [node[rows][r[f]] for r, f in zip(best, fine)])
                i, j = np.nonzero(np.triu(s >= threshold))
                one.append(node[rows[i]])
                two.append(node[rows[j]])
        if nodes:
            yield _lists(np.concatenate(nodes), sims, others)
            yield _ties(np.concatenate(one), np.concatenate(two))


def _local_join(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Pairs among a centre's members of different groups that are nearer than the worst neighbour of either, and what links tie together."""
    for t in _tables(batches, ["centre"], 4096):
        node, group, worst, v = t.column("node").to_numpy(), t.column("group").to_numpy(), t.column("worst").to_numpy(), t.column("v").chunk(0)
        runs = _equal_runs(t.column("centre").to_numpy())
        a, b, sim, one, two = [], [], [], [], []
        for lo, hi in zip(runs[:-1], runs[1:]):
            if hi - lo < 2:
                continue
            x = _matrix(v, np.arange(lo, hi), kind)
            s = x @ x.T
            s[group[lo:hi][:, None] == group[lo:hi][None, :]] = -2
            i, j = np.nonzero(s > np.maximum(worst[lo:hi, None], -2))
            a.append(node[lo + i])
            b.append(node[lo + j])
            sim.append(s[i, j])
            i, j = np.nonzero(np.triu(s >= threshold))
            one.append(node[lo + i])
            two.append(node[lo + j])
        if not a:
            continue
        yield _ties(np.concatenate(one), np.concatenate(two))
        a, b, sim = np.concatenate(a), np.concatenate(b), np.concatenate(sim)
        order = np.lexsort((b, a))
        a, b, sim = a[order], b[order], sim[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        a, b, sim = a[first], b[first], sim[first]
        runs = _equal_runs(a)
        yield _lists(a[runs[:-1]], [sim[x:y] for x, y in zip(runs[:-1], runs[1:])], [b[x:y] for x, y in zip(runs[:-1], runs[1:])])


def _asked(batches: Iterator[pa.RecordBatch], nodes: np.ndarray, vectors: list[bytes], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """All links of the asked vectors, by comparison with every vector."""
    column = pa.array(vectors, pa.binary())
    width = np.array([len(v) for v in vectors])
    for batch in batches:
        mine = np.array([len(v.as_buffer()) for v in batch.column(1)])
        node = batch.column(0).to_numpy()
        for size in np.intersect1d(width, mine).tolist():
            q, every = np.flatnonzero(width == size), np.flatnonzero(mine == size)
            x = _matrix(column, q, kind)
            for lo in range(0, len(every), 2048):
                r = every[lo:lo + 2048]
                i, j = np.nonzero(x @ _matrix(batch.column(1), r, kind).T >= threshold)
                off = nodes[q[i]] != node[r[j]]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[q[i[off]]]), pa.array(node[r[j[off]]])], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Links of each vector of a pair of blocks: how many other vectors, copies of it excluded."""
    for t in _tables(batches, ["label", "one", "two"], 1024):
        node, weight, side, v = t.column("node").to_numpy(), t.column("size").to_numpy(), t.column("block").to_numpy(), t.column("v").chunk(0)
        runs = _equal_runs(t.column("label").to_numpy(), t.column("one").to_numpy(), t.column("two").to_numpy())
        one, two = t.column("one").to_numpy(), t.column("two").to_numpy()
        for lo, hi in zip(runs[:-1], runs[1:]):
            rows = np.arange(lo, hi)
            left, right = rows[side[lo:hi] == one[lo]], rows[side[lo:hi] == two[lo]]
            if not len(left) or not len(right):
                continue
            near = _matrix(v, left, kind) @ _matrix(v, right, kind).T >= threshold
            near &= node[left][:, None] != node[right][None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array((near * weight[right]).sum(axis=1).astype(np.int64))], names=["node", "links"])
            if one[lo] != two[lo]:
                yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array((near * weight[left][:, None]).sum(axis=0).astype(np.int64))], names=["node", "links"])


def merged(lists: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest different neighbours of each node, and all nodes it is tied to."""
    return lists.groupBy("node").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False), 1, keep).alias("near"), F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))


def vector_bytes(column: str, kind: str):
    """Components one after another in binary; null where the vector has none or a null or non-finite one."""
    fine = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & F.exists(column, lambda x: x != 0)


def _packed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.asarray(x.values.to_numpy(zero_copy_only=False), kind).tobytes() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(v, pa.binary())], names=["node", "rep", "size", "v"])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, keep: int = LIST, trees: int = TREES, rounds: int = ROUNDS, seed: int = 5,
                 vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[str, float]]:
    """(vec_id, n_links, component_id, kept) per row, and the audit: links found and asked for, recall (of all and of unsaturated vectors), rounds.

    Equal vectors are one class. Random hyperplanes give the first neighbour lists; each round joins the neighbours of neighbours: the
    members of a node's list and of a bounded part of those it is listed in are compared with one another. An audit compares ASKED vectors with all others and
    measures the recall of links: the mean over vectors that have links, each vector counting alike, and the same over unsaturated ones alone,
    for which more of those are drawn, without limit, until LINKED have links or every one was asked: where links are rare the audit goes on to
    ask all vectors, in draws of bounded size, and a recall of 1 without any linked vector means that there is none. While either is below RECALL further trees and rounds follow;
    after AUDITS audits below it a RuntimeError states the audit, no rows are returned. Lists whose neighbours are all
    links are saturated: they are enlarged to everything reachable over links, compared in pairs of blocks of about BLOCK vectors, each
    a task's work. All links are decided in double precision. Links of other nodes are those of the lists, in either direction.

    Every compared pair that links ties its nodes together before lists are cut, as one row per node and batch with the smallest node
    connected there, so no link between two saturated lists is lost to the components. Components with saturated lists then search
    on among one another: trees and rounds over their vectors alone, whose lists leave out the own component, until no compared pair links two.

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing; vectors of different length do not
    link. A null vec_id sorts last; repeated rows link with each other. Empty table: no rows, recall 1.
    """
    spark = vectors.sparkSession
    kind = "f8" if isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType) else "f4"
    element = "double" if kind == "f8" else "float"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("e"), vector_bytes(vector, kind).alias("fine"))
    last = F.coalesce("vec_id", F.lit(2**63 - 1))
    grouped = rows.where("fine").groupBy("e").agg(F.min(last).alias("rep"), F.count(F.lit(1)).alias("size"))
    named = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = stored(named.select("node", "rep", "size", "e").mapInArrow(lambda it: _packed(it, kind), "node long, rep long, size long, v binary"), "vectors")

    def planted(pool: DataFrame, n: int, s: int) -> DataFrame:
        depth = max(0, ceil(log2(max(1, pool.count()) / LEAF)))
        spread = pool.mapInArrow(lambda it: _planted(it, depth, s, n, kind), "tree long, code long, place double, node long, v binary, group long")
        dealt = spread.repartitionByRange("tree", "code", "place").sortWithinPartitions("tree", "code", "place")
        return dealt.mapInArrow(lambda it: _leaves(it, LEAF, keep, threshold, kind), EDGES)

    def refined(graph: DataFrame, pool: DataFrame, inside: DataFrame | None = None) -> DataFrame:
        """``graph`` after a round; the lists of ``inside`` show the way, too."""
        lists = graph.select("node", "near") if inside is None else graph.select("node", "near").unionByName(inside.select("node", "near"))
        pairs = lists.select("node", F.explode("near").alias("n")).select(F.col("node").alias("centre"), F.col("n.other").alias("node"))
        some = Window.partitionBy("centre").orderBy(F.xxhash64("centre", "node"), "node")
        back = pairs.select(F.col("node").alias("centre"), F.col("centre").alias("node")).withColumn("i", F.row_number().over(some)).where(F.col("i") <= keep).drop("i")
        own = pool.select(F.col("node").alias("centre"), "node")
        members = pairs.unionByName(back).unionByName(own).distinct()
        worst = graph.select("node", F.when(F.size("near") >= keep, F.array_min(F.transform("near", lambda x: x["sim"]))).otherwise(-2.0).alias("worst"))
        known = pool.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
        groups = members.join(known, "node").repartition("centre").sortWithinPartitions("centre")
        return stored(merged(graph.unionByName(groups.mapInArrow(lambda it: _local_join(it, threshold, kind), EDGES)), keep), "graph")

    def tied(graph: DataFrame) -> DataFrame:
        return graph.select(F.col("node").alias("a"), F.explode("roots").alias("b"))

    def joined(labels: DataFrame, crowded: DataFrame, graph: DataFrame, s: int) -> tuple[DataFrame, DataFrame]:
        """``labels`` and ``crowded`` after the crowded components have been searched for links among one another."""
        while crowded.select("label").distinct().limit(2).count() == 2:
            pool = stored(crowded.join(nodes, "node").select("node", "v", F.col("label").alias("group")), "pool")
            inside = graph.join(crowded.select("node"), "node", "left_semi")
            outside = stored(merged(planted(pool, trees, s), keep), "graph")
            for _ in range(rounds):
                outside = refined(outside, pool, inside)
            to = crowded.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            more = components(tied(outside).join(crowded.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(to, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
            if not more.limit(1).count():
                break
            labels, crowded, s = stored(relabel(labels, more), "labels"), stored(relabel(crowded, more), "crowded"), s + 1
        return labels, crowded

    def links_of(graph: DataFrame) -> DataFrame:
        out = graph.select(F.col("node").alias("a"), F.explode("near").alias("n")).where(F.col("n.sim") >= threshold).select("a", F.col("n.other").alias("b"))
        return stored(out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")

    asked: list[int] = []

    def truth_of(pool: DataFrame, n: int, first: bool) -> DataFrame:
        """(a, b, first): all links of ``n`` more vectors of ``pool``."""
        new = pool.join(spark.createDataFrame([(i,) for i in asked], "node long"), "node", "left_anti")
        drawn = least_hashes(new.select("node", "v", F.xxhash64(F.lit(seed), "node").alias("h")), "h", n).select("node", "v").collect()
        ids, held = np.array([r["node"] for r in drawn], np.int64), [bytes(r["v"]) for r in drawn]
        asked.extend(ids.tolist())
        return stored(nodes.select("node", "v").mapInArrow(lambda it: _asked(it, ids, held, threshold, kind), "a long, b long").withColumn("first", F.lit(first)), "truth")

    truth = truth_of(nodes, ASKED, True)
    single = nodes.select("node", "v", F.col("node").alias("group"))
    graph, done, audit = None, 0, {}
    while True:
        first = planted(single, trees, seed + done)
        graph = stored(merged(first if graph is None else graph.unionByName(first), keep), "graph")
        for _ in range(rounds):
            graph = refined(graph, single)
        done += 1
        links = links_of(graph)
        labels = components(links.unionByName(tied(graph)))
        full = graph.where(F.size("near") >= keep).where(F.array_min(F.transform("near", lambda x: x["sim"])) >= threshold).select("node")
        crowded = stored(labels.join(labels.join(full, "node", "left_semi").select("label").distinct(), "label", "left_semi").select("node", "label"), "crowded")
        labels, crowded = joined(labels, crowded, graph, seed + 1000 * done)
        free = nodes.join(crowded, "node", "left_anti")
        draw = FURTHER
        while truth.join(crowded.select(F.col("node").alias("a")), "a", "left_anti").select("a").distinct().count() < LINKED:
            before = len(asked)
            truth = truth.unionByName(truth_of(free, draw, False))
            if len(asked) == before:
                break
            draw = min(2 * draw, LARGEST)
        both = truth.join(crowded.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(crowded.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        hit = both.join(links.withColumn("found", F.lit(True)), ["a", "b"], "left").groupBy("a", "first", F.col("la").isNull().alias("free")).agg(
            F.count(F.lit(1)).alias("all"), F.sum((F.coalesce("found", F.lit(False)) | F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).cast("int")).alias("hit"))
        share = F.col("hit") / F.col("all")
        seen = hit.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("all"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit"), F.coalesce(F.avg(F.when(F.col("first"), share)), F.avg(share), F.lit(1.0)).alias("every"),
                       F.coalesce(F.avg(F.when(F.col("free"), share)), F.lit(1.0)).alias("free"), F.count(F.when(F.col("free"), 1)).alias("n_free"), F.count(F.lit(1)).alias("n")).first()
        audit = {"asked": len(asked), "linked": seen["n"], "linked_unsaturated": seen["n_free"], "links": seen["all"], "found": seen["hit"], "recall": seen["every"],
                 "recall_unsaturated": seen["free"], "rounds": done * rounds}
        if min(audit["recall"], audit["recall_unsaturated"]) >= RECALL:
            break
        if done == AUDITS:
            raise RuntimeError(f"recall of links stayed below {RECALL}: {audit}")
    sizes = crowded.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = crowded.join(sizes, "label").join(nodes.select("node", "size", "v"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "node", "size", "v")
    dealt = dealt.repartition("label", "one", "two").sortWithinPartitions("label", "one", "two")
    inside = dealt.mapInArrow(lambda it: _blocks(it, threshold, kind), "node long, links long")
    listed = links.join(crowded.select(F.col("node").alias("a")), "a", "left_anti").join(nodes.select(F.col("node").alias("b"), F.col("size").alias("links")), "b").select(F.col("a").alias("node"), "links")
    n_links = inside.unionByName(listed).groupBy("node").agg(F.sum("links").alias("links"))
    least = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("low"))
    of = named.join(n_links, "node", "left").join(labels.join(least, "label").select("node", "low"), "node", "left").select(
        "e", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("low", "rep").alias("low"))
    out = rows.where("fine").join(of, "e").select("vec_id", "n_links", "low").unionByName(
        rows.where("not fine or fine is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), last.alias("low")))
    low = F.when(F.col("low") != 2**63 - 1, F.col("low"))
    return out.select("vec_id", "n_links", low.alias("component_id"), (last == F.col("low")).alias("kept")), audit
