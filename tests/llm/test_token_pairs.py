"""Alignment of two tokenizers against brute force, with few links a run and a low fan-in so that all levels of merging occur."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.functions.ship import ship
from cohortmill.llm import token_pairs

DIR = "/opt/tokenizers"
FILES = token_pairs.Files(f"{DIR}/byte_bpe_50k.json", f"{DIR}/piece_bpe_32k.model", f"{DIR}/byte_bpe_50k.tiktoken")
SLOW = token_pairs.Files(FILES.a, FILES.b)


def brute(texts):
    """Figures of each text, tokens joined one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(FILES.a)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    names = {i: t for t, i in json.load(open(FILES.a))["model"]["vocab"].items()}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in keep}
    byte.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in keep)})

    def a_bytes(i):
        return bytes(byte[c] for c in names[i])

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        raw = (" " + t).encode() if t else b""
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        groups, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                ga.append(a[i])
                at_a += len(a_bytes(a[i]))
                i += 1
            else:
                gb.append(b[j])
                at_b += len(b_bytes(b[j]))
                j += 1
            if at_a == at_b and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        found.append((len(a), len(b), groups))
    count = Counter()
    for _, _, groups in found:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for n_a, n_b, groups in found:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), shown))
    return out, count, top


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["the", "Über", "naïve", "tokenizers", "2024", "x1y2", "<s>", "</s>", "<|endoftext|>", "don't", "日本語", "🙂🙂", "▁", "aaaa", "\t", "\n\n", "  ", "été", "ﬁ", "é", "’s", "0x41", "<0x41>", "\x00", "\x85"]
    out = [" ".join(rng.choice(words[:14] if k % 3 else words) for _ in range(rng.randrange(1, 60))) for k in range(60)]
    out += ["same text here"] * 40 + [None, "", " ", "\n", "a" * 5000, "ab" * 3000, "日本語のテキスト" * 200, "".join(rng.choice("abcdef0123456789") for _ in range(4000)), "long " * 20000]
    return out


@pytest.mark.parametrize("limits", [{}, {"run_links": 300, "fan_in": 3, "buckets": 5}])
def test_alignment(spark, texts, limits):
    ship(spark)
    df = spark.createDataFrame([(i, t, "mine", -1) for i, t in enumerate(texts)], "doc_id long, text string, run string, n_a int").repartition(3)
    want, count, top = brute(texts)
    out = token_pairs.align_tokenizers(df, FILES, **limits)
    assert out.documents.columns == ["doc_id", "run", *token_pairs.OWN] and {r.run for r in out.documents.select("run").collect()} == {"mine"}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.documents.collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in out.pairs.collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_ranks_give_the_same_ids(texts):
    fast, slow = token_pairs.Pair(FILES), token_pairs.Pair(SLOW)
    some = [" " + t for t in texts if t]
    raw = [t.encode() for t in some]
    for x, y in zip(fast.encode_a(some, raw), slow.encode_a(some, raw)):
        assert np.array_equal(x, y)
    assert any(token_pairs._ordinary(r) for r in raw) and not all(token_pairs._ordinary(r) for r in raw)


def test_large_groups_are_multiplied():
    pair = token_pairs.Pair(SLOW)
    limit, texts = token_pairs.LARGE_GROUP, ["日本語 tokenizers été " * 30]
    plain = token_pairs.align(texts, pair)
    try:
        token_pairs.LARGE_GROUP = 0
        large = token_pairs.align(texts, pair)
    finally:
        token_pairs.LARGE_GROUP = limit
    want = Counter(zip(plain.a.tolist(), plain.b.tolist()))
    got = Counter()
    for a, b, n in zip(large.a.tolist(), large.b.tolist(), large.times.tolist()):
        got[a, b] += n
    assert got == want and plain.times is None


def test_empty_table(spark):
    ship(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    out = token_pairs.align_tokenizers(df, FILES, digest=True)
    assert out.documents.count() == 0 and out.pairs.count() == 0
    one = token_pairs.align_tokenizers(df.unionByName(spark.createDataFrame([(None, None)], df.schema)), FILES, digest=True).documents.first()
    assert (one.doc_id, one.n_a, one.groups, one.count_sum) == (None, 0, "", 0)


def test_repeated_rows_count_one_by_one(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "alpha"), (1, "alpha")], "doc_id long, text string").withColumn("extra", F.lit(1))
    assert {r.n_docs for r in token_pairs.align_tokenizers(df, FILES).pairs.collect()} == {2}
