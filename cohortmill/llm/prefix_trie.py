"""Prefix trie of conversations from vertical bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortmill.llm.rows import stored

SHARD_CONVS = 8_192       # conversations of a shard, and bits of its bitmaps
SHARD_TURNS = 1_000_000   # turns after which a shard is closed
HEAD = 8                  # turns that a conversation can take over from another
KEY = 32                  # hex digits that stand for a turn's role and text (128 bits)
BOTH, LEFT, RIGHT = 0, 1, 2

_PARTS = (
    "shard long, node int, parent int, depth long, conv_id long, n_convs long, size long, n_children long, n_leaves long, saved long, "
    "parent_conv long, ends string, first_end long, name string, parent_name string, side int"
)
_ARROW = pa.schema([
    ("shard", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("size", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("parent_conv", pa.int64()), ("ends", pa.string()), ("first_end", pa.int64()),
    ("name", pa.string()), ("parent_name", pa.string()), ("side", pa.int32()),
])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each as a key of its role and text and the bytes of its text.

    Order: turn (null first), then role, then text. Null role or text counts as empty. Rows without conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. Texts are sorted on disk where they do not fit; what is
    kept of a conversation in one row is 40 bytes a turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, KEY)
    placed = rows.select("conv_id", place.alias("p"), key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "key", "size")))
    return placed.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def graft_heads(seqs: DataFrame, root: Column, length: Column, head: int = HEAD) -> DataFrame:
    """``seqs`` with the first ``length`` (at most ``head``) turns of each conversation replaced by those of conversation ``root``.

    All of ``root``'s turns if it has fewer, none if it is absent. Conversations that name the same ``root`` are expected to be few.
    """
    heads = seqs.select(F.col("conv_id").alias("_root"), F.slice("turns", 1, head).alias("_head"))
    cut = seqs.withColumn("_root", root).withColumn("_h", length.cast("int")).join(heads, "_root", "left")
    own = F.slice(F.col("turns"), F.col("_h") + 1, F.size("turns") + 1)
    taken = F.coalesce(F.slice(F.col("_head"), F.lit(1), F.col("_h")), F.slice(F.col("turns"), 1, 0))
    return cut.select("conv_id", F.concat(taken, own).alias("turns"))


@dataclass
class _Node:
    parent: int
    depth: int
    bits: int
    size: int
    key: str
    children: int = 0   # of a boundary node only those that are no boundary nodes
    leaves: int = 0
    saved: int = 0
    ends: int = 0
    name: str = field(default="")


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def shard_trie(ids: list[int], paths: list[str], sizes: list[list[int]]) -> Iterator[tuple]:
    """Nodes of one shard, whose conversations come in the order of their paths; rows as in ``_PARTS``.

    Conversation i in the order of ids is bit i. Postings hold the bitset of each (position, turn) and of each (position, end). A
    node's children are found by intersecting its bitset with the posting of the turn of its lowest member not seen yet.
    Nodes that hold the first or last conversation may go on in the neighbouring shards: their figures count what lies wholly
    inside this shard, and they carry a name to be merged by.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    bit = {i: b for b, i in enumerate(order)}
    first, last = 1 << bit[0], 1 << bit[len(ids) - 1]
    turns = [[paths[i][p:p + KEY] for p in range(0, len(paths[i]), KEY)] for i in order]
    length = [sizes[i] for i in order]
    of = [ids[i] for i in order]
    postings: list[dict[str, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    ended: dict[int, int] = {}
    for b, t in enumerate(turns):
        ended[len(t)] = ended.get(len(t), 0) | 1 << b
        for at, key in zip(postings, t):
            at[key] = at.get(key, 0) | 1 << b
    nodes = []
    stack = [_Node(-1, 0, (1 << len(of)) - 1, 0, "")]
    while stack:
        x = stack.pop()
        me = len(nodes)
        nodes.append(x)
        if x.bits & (first | last) and x.depth:
            x.name = hashlib.sha256((nodes[x.parent].name + x.key).encode()).hexdigest()
        x.ends = x.bits & ended.get(x.depth, 0)
        rest = x.bits ^ x.ends
        while rest:
            b = (rest & -rest).bit_length() - 1
            key = turns[b][x.depth]
            members = x.bits & postings[x.depth][key]
            rest ^= members
            stack.append(_Node(me, x.depth + 1, members, length[b][x.depth], key))
    for x in reversed(nodes[1:]):
        up = nodes[x.parent]
        if not x.bits & (first | last):
            x.leaves += not x.children
            x.saved += (x.bits.bit_count() - 1) * x.size
            up.children += 1
        up.leaves += x.leaves
        up.saved += x.saved
    for me, x in enumerate(nodes):
        low = of[(x.bits & -x.bits).bit_length() - 1]
        ends = [of[b] for b in _bits(x.ends)]
        text = ",".join(map(str, ends))
        figures = (me, x.parent, x.depth, low, x.bits.bit_count(), x.size, x.children, x.leaves, x.saved)
        if not x.bits & (first | last):
            up = nodes[x.parent]
            above = None if up.bits & (first | last) else of[(up.bits & -up.bits).bit_length() - 1]
            yield *figures, above, hashlib.sha256(text.encode()).hexdigest(), None, None, None, None
        else:
            side = BOTH if x.bits & first and x.bits & last else LEFT if x.bits & first else RIGHT
            yield *figures, None, text, ends[0] if ends else None, x.name, nodes[x.parent].name if x.depth else None, side


def _shards(batches: Iterator[pa.RecordBatch], convs: int, turns: int) -> Iterator[pa.RecordBatch]:
    task, seen = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    paths: list[str] = []
    sizes: list[list[int]] = []

    def close() -> Iterator[pa.RecordBatch]:
        shard = (task << 32) + seen
        rows = [(shard, *r) for r in shard_trie(ids, paths, sizes)]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 10_000]), _ARROW)], schema=_ARROW)

    held = 0
    for batch in batches:
        for i, path, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "sizes"))):
            ids.append(i)
            paths.append(path)
            sizes.append(size)
            held += len(size)
            if len(ids) >= convs or held >= turns:
                yield from close()
                seen, held, ids, paths, sizes = seen + 1, 0, [], [], []
    if ids:
        yield from close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined end lists of each name; rows come sorted by name and first id, so only a hash state is held."""
    name, state = None, None
    for batch in batches:
        names, out = [], []
        for n, ends in zip(batch.column("name").to_pylist(), batch.column("ends").to_pylist()):
            if n != name:
                if state is not None:
                    names.append(name)
                    out.append(state.hexdigest())
                name, state = n, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["name", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])


def conversation_trie(seqs: DataFrame, convs: int = SHARD_CONVS, turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct beginning of the sequences (conv_id, turns array<struct<key, size>>), from the empty root on.

    conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (bytes of last turns held n_convs - 1 times too often, over the subtree), ends_sha256 (ids of the sequences that end there, ascending).

    Sequences are dealt by range of (turns, conv_id), so copies of one sequence, however many, spread over tasks; a task cuts its
    rows into shards of at most ``convs`` sequences and ``turns`` turns. A sequence stands in one row. Every node off a shard's two
    outer paths is finished inside the shard. Nodes of the outer paths (two paths a shard) are merged by name; each merged node
    counts once, in the first shard that holds it, and sums along a path are windows over one shard's paths, so nothing is expanded
    by depth and no node's members meet in one task. Only a digest of ends passes through one task, as a stream.

    Null turns count as none; a sequence without turns ends in the root; without sequences there is no node. conv_id is expected
    to be unique and not null, as ``sequences`` returns it.
    """
    filled = F.coalesce("turns", F.slice(F.col("turns"), 1, 0))
    path = F.coalesce(F.array_join(F.transform("turns", lambda t: t["key"]), ""), F.lit(""))
    sizes = F.coalesce(F.transform(filled, lambda t: t["size"]), F.array().cast("array<bigint>"))
    keyed = seqs.select("conv_id", path.alias("path"), sizes.alias("sizes"))
    dealt = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = stored(dealt.mapInArrow(lambda it: _shards(it, convs, turns), _PARTS), "trie-parts")
    edge = parts.where("name is not null")

    merged = edge.groupBy("name").agg(
        F.max("parent_name").alias("parent_name"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.max("size").alias("size"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("shard").alias("shard"),
    )
    merged = stored(merged, "trie-edges")
    outer = merged.where("parent_name is not null").groupBy(F.col("parent_name").alias("name")).agg(F.count("*").alias("outer"))
    merged = merged.join(outer, "name", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    merged = stored(merged.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("size")), "trie-edges")

    owned = edge.select("shard", "name", "depth", "side").join(merged.select("shard", "name", "own_leaf", "own_saved"), ["shard", "name"], "left").na.fill(0)
    whole, side = Window.partitionBy("shard"), Window.partitionBy("shard", "side")

    def under(col: str) -> Column:
        """Sum over the nodes further down: of an outer path its own, of their common beginning those of both."""
        over = [F.coalesce(F.sum(col).over(w.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for w in (whole, side)]
        return F.when(F.col("side") == BOTH, over[0]).otherwise(over[1])

    totals = owned.select("name", under("own_leaf").alias("l"), under("own_saved").alias("s")).groupBy("name").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    lists = edge.where("first_end is not null").select("name", "first_end", "ends")
    digests = lists.repartition("name").sortWithinPartitions("name", "first_end").mapInArrow(_digests, "name string, ends_sha256 string")
    above = merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("parent_conv_id"))
    joined = merged.join(totals, "name").join(digests, "name", "left").join(above, "parent_name", "left")
    out = joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("own_leaf") + F.col("l")).alias("n_leaves"),
        (F.col("saved") + F.col("own_saved") + F.col("s")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    up = edge.select("shard", F.col("node").alias("parent"), "name").join(merged.select("name", F.col("conv_id").alias("edge_conv")), "name").drop("name")
    inner = parts.where("name is null").join(up, ["shard", "parent"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv", "edge_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
    return out.unionByName(inner)
