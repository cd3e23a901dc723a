"""The conversation trie against brute force, with nulls, ties, repeated rows and shards of a few conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortmill.llm import prefix_trie


def brute(rows):
    """Nodes of the grafted conversations: {(depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, digest)} as a sorted list."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + t[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = []
    for n, members in nodes.items():
        below = [x for x in nodes if x[:len(n)] == n]
        ends = sorted(c for c in members if len(built[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), sum(x not in kids for x in below),
                    sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("own")).withColumn("shard", F.lit(1))
    c = F.col("conv_id")
    seqs = prefix_trie.graft_heads(prefix_trie.sequences(df), c - c % 5, F.crc32(c.cast("string")) % 9)
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in cols) for r in prefix_trie.conversation_trie(seqs, **limits).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in list(range(60)) + [77, 78, 79, 1003, 1004]:
        for t in range(rng.randrange(1, 12)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 20])))
    out += [(5, None, "user", "first"), (5, None, "user", None), (6, 3, "b", "tie"), (6, 3, "a", "tie"), (6, 3, "a", "tie"), (None, 0, "user", "nobody")]
    out += [(200 + i, t, "user", "same") for i in range(70) for t in range(9)]
    out += [(300, t, "user", f"t{t}") for t in range(400)] + [(301, t, "user", f"t{t}") for t in range(400)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("limits", [{}, {"convs": 3}, {"convs": 1}, {"convs": 20, "turns": 40}])
def test_nodes(spark, rows, limits):
    assert trie(spark, rows, **limits) == brute(rows)


def test_without_rows(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversation(spark):
    rows = [(c, 0, "user", "hello") for c in (1, 2, 3, 4, 8, 13)]
    assert trie(spark, rows) == brute(rows)
    assert any(d == 0 and n > 0 for _, d, _, n, *_ in trie(spark, rows))
