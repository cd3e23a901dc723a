"""Context-tree weighting against a recursive brute force, and its scores of held-out text."""

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.functions.ship import ship
from cohortmill.llm import context_tree

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, depth):
    """{id: (n_tokens, n_known, train_tokens, base, score)} by one recursion per context."""
    texts = [(i, (t or "").translate(LOW), h) for i, t, h in rows]
    count = Counter()  # (context, leading bits) -> [zeros, ones]
    bits = {}

    def steps(t):
        line = bytes([255]) * depth + t.encode() + b"\xff"
        for p in range(depth, len(line)):
            yield bytes(reversed(line[p - depth:p])), line[p]

    for _, t, h in texts:
        if not h:
            for ctx, byte in steps(t):
                for k in range(8):
                    for d in range(depth + 1):
                        bits.setdefault((ctx[:d], k, byte >> (8 - k)), [0, 0])[byte >> (7 - k) & 1] += 1
    children = {}
    for ctx, k, lead in bits:
        if ctx:
            children.setdefault((ctx[:-1], k, lead), []).append((ctx, k, lead))

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    @lru_cache(None)
    def weighted(node):
        own = kt(*bits[node])
        if len(node[0]) == depth:
            return own, 1.0
        below = sum(weighted(c)[0] for c in children[node])
        m = max(own, below)
        return m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(below - m)), 1 / (1 + math.exp(min(700, below - own)))

    words = [re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for _, t, _ in texts]
    for w, (_, _, h) in zip(words, texts):
        if not h:
            count.update(w)
    n, v = sum(count.values()), len(count)
    out = []
    for w, (i, t, h) in zip(words, texts):
        score = 0.0
        for ctx, byte in steps(t):
            for k in range(8):
                p, seen, b = 0.5, False, byte >> (7 - k) & 1
                for d in range(depth, -1, -1):
                    node = (ctx[:d], k, byte >> (8 - k))
                    if node in bits:
                        z = bits[node]
                        own, share = (z[b] + 0.5) / (sum(z) + 1), weighted(node)[1] if seen else 1.0
                        p, seen = share * own + (1 - share) * p, True
                score += math.log10(p)
        out.append((i, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), score))
    return out


def scores(spark, rows, **limits):
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id int, text string, h boolean").withColumn("score", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("low", F.lit(2)).repartition(3)
    out = context_tree.score_texts(df, F.col("h"), **limits)
    assert out.columns == ["doc_id", "h", "row", "low", *context_tree.OWN]
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()), key=lambda r: (r[0] is None, r))


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=lambda r: (r[0] is None, r))):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9, atol=1e-9), (g, w)


@pytest.mark.parametrize("limits", [{}, {"depth": 2}, {"depth": 3, "run_bytes": 400, "fan_in": 2, "buckets": 3}])
def test_scores(spark, limits):
    rng = random.Random(4)
    words = ["The", "thé", "cat", "CATS", "sat", "on", "mat", "日本", "x1", "\t", "\n", "zebra" * 9]
    rows = [(i, " ".join(rng.choice(words[:8 + i % 5]) for _ in range(rng.randrange(1, 30))), i % 4 == 0) for i in range(40)]
    rows += [(100, None, False), (101, "", True), (102, "  ", False), (103, "same same", False), (103, "same same", False), (104, "unseenwordonly", True), (None, "no id", True), (105, "a\x00b", False)]
    same(scores(spark, rows, **limits), brute(rows, limits.get("depth", context_tree.DEPTH)))


def test_large_counts():
    n = np.array([0, 1, 2, 65_535, 65_536, 65_537, 1_000_000, 10_000_000])
    want = [math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1) for z, o in zip(n.tolist(), n[::-1].tolist())]
    assert np.allclose(context_tree.log_kt(n, n[::-1]), want, rtol=1e-9, atol=1e-7)


def test_nothing_to_learn_from(spark):
    got = scores(spark, [(1, "abc", True), (2, None, True)])
    same(got, brute([(1, "abc", True), (2, None, True)], context_tree.DEPTH))
    assert got[0][3] == 0 and abs(got[0][5] - 32 * math.log10(0.5)) < 1e-9
    assert scores(spark, []) == []


def test_probabilities_of_the_next_byte_sum_to_one():
    text = np.frombuffer(("the cat sat on the mat and the hat " * 20).encode(), np.uint8)
    grams, _ = context_tree.sequences_of(text, np.array([0, len(text)]), 4)
    keys, counts = np.unique(grams, return_counts=True)
    tree = context_tree.subtree(keys, counts, 4, 2)
    top = context_tree.Top(*context_tree.top_cells(tree))
    for ctx in (b"eht ", b"zht ", b"zzz ", b"\x00\x01\x02\x03"):
        at = int.from_bytes(ctx, "big") << 8
        assert abs((10 ** context_tree.log10_probability(at + np.arange(256), tree, top, 4)).sum() - 1) < 1e-9


def test_held_out_text_is_told_from_noise(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ka", "mo", "ri") for b in ("tel", "vun") for c in ("o", "ash", "ing")]
    prose = [(i, " ".join(rng.choice(words) for _ in range(80)), i % 5 == 0) for i in range(60)]
    noise = [(1000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), True)]
    got = {g[0]: g for g in scores(spark, prose + noise)}
    size = {i: len(t) + 1 for i, t, _ in prose + noise}
    rate = {i: -g[5] / math.log10(2) / size[i] for i, g in got.items()}
    assert max(rate[i] for i, _, h in prose if h) < 1.5 < 4 < rate[1000]
