"""Alignment of two tokenizers over a corpus, its pairs counted by external merging of sorted runs."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortmill.llm.rows import stored
from cohortmill.llm.runs import BLOCK, FAN_IN, one_by_one, packed, send_back, starts, tallied, totals_of, unpacked

RUN_LINKS = 6_000_000   # token links sorted at once in a task: a run
CHUNK_BYTES = 1 << 20   # text aligned at once; a longer text is a chunk of its own
BUCKETS = 16            # radix buckets by the id of the first tokenizer
DOC_BITS = 20           # documents of a run, in bits
LARGE_GROUP = 4_096     # links of a group from which distinct ids are multiplied instead of tokens
PLAIN_BYTE = 0xCA       # texts with bytes from here on (U+0280 and up) are left to the first tokenizer's own library
PIECE = 2_000           # so are texts with a longer stretch of only white space, or of none

OWN = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(), "n_best": T.LongType(), "count_sum": T.LongType()}
#: The pattern of the byte-level tokenizer (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Files:
    """Vocabulary files on every machine: ``a`` (byte-level BPE as JSON), ``b`` (a sentence-piece model) and, optionally, ``ranks``: the vocabulary of ``a``
    as ranks, by which ordinary Latin texts are encoded three times as fast to the same ids."""

    a: str
    b: str
    ranks: str | None = None


class Pair:
    """Both tokenizers in a worker, with bytes, byte lengths and printed forms of their ids."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.fast = None
        if files.ranks:
            with open(files.ranks, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(files.a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.size_b)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Printed ids with what follows them: a before a, a before b, b before b, b before a.
        self.printed = [b"%d%b" % (i, sep) for n, sep in ((self.size_a, b","), (self.size_a, b"|"), (self.size_b, b","), (self.size_b, b";")) for i in range(n)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode_a(self, texts: list[str], raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; ``raw`` are its bytes."""
        out: list = [None] * len(texts)
        rest = list(range(len(texts)))
        if self.fast is not None:
            ordinary = [i for i in rest if _ordinary(raw[i])]
            for i, ids in zip(ordinary, (self.fast.encode_ordinary(texts[i]) for i in ordinary)):
                out[i] = np.array(ids, np.int64)
            rest = [i for i in rest if out[i] is None]
        for i, e in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = np.array(e.ids, np.int64)
        return out


_SPACE = np.array([b in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) for b in range(256)])


def _ordinary(raw: bytes) -> bool:
    data = np.frombuffer(raw, np.uint8)
    if data.max(initial=0) >= PLAIN_BYTE:
        return False
    if len(data) <= PIECE:
        return True
    space = _SPACE[data]
    turns = np.flatnonzero(space[1:] != space[:-1])
    return bool(np.diff(turns, prepend=-1, append=len(data) - 1).max() <= PIECE)


_loaded: dict[Files, Pair] = {}


def pair_of(files: Files) -> Pair:
    if files not in _loaded:
        _loaded[files] = Pair(files)
    return _loaded[files]


@dataclass
class Aligned:
    """Figures of each text of a chunk, and the ids and the text number of each link."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    a: np.ndarray
    b: np.ndarray
    text: np.ndarray
    times: np.ndarray | None


def align(texts: list[str | None], pair: Pair) -> Aligned:
    """Cut tokens of both tokenizers into groups at the byte offsets where both end one, and link all of a group.

    A text that is null, empty or not spelt out again by both has no tokens.
    """
    spaced = [" " + t if t else "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in spaced]
    some = [i for i, t in enumerate(spaced) if t]
    none = np.zeros(0, np.int64)
    ids_a, ids_b = [none] * len(texts), [none] * len(texts)
    encoded_a = pair.encode_a([spaced[i] for i in some], [raw[i] for i in some])
    encoded_b = pair.b.encode([texts[i] for i in some], num_threads=1) if some else []
    for i, a, b in zip(some, encoded_a, encoded_b):
        if b"".join(map(pair.bytes_a.__getitem__, a.tolist())) == raw[i] == b"".join(map(pair.bytes_b.__getitem__, b)):
            ids_a[i], ids_b[i] = a, np.array(b, np.int64)
        else:
            raw[i] = b""
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
    ends = np.cumsum(np.array([len(r) for r in raw], np.int64))
    end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    at = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.uint8)
    at[end_a] = 1
    at[end_b] |= 2
    closed = at == 3
    before = np.cumsum(closed)
    group_a, group_b = before[end_a - 1], before[end_b - 1]
    n = int(before[-1])
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    owner = np.searchsorted(ends, np.flatnonzero(closed), side="left")
    size = in_a * in_b
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, owner, size)
    # Printed groups: every token at its place in the order a of group, b of group.
    order = np.empty(len(a) + len(b), np.int64)
    past_a = np.cumsum(in_a)
    past_b = np.cumsum(in_b) - in_b
    order[np.arange(len(a)) + past_b[group_a]] = a + pair.size_a * closed[end_a]
    order[np.arange(len(b)) + past_a[group_b]] = b + 2 * pair.size_a + pair.size_b * closed[end_b]
    groups, start = [], 0
    for length in (n_a + n_b).tolist():
        groups.append(b"".join(map(pair.printed.__getitem__, order[start:start + length].tolist()))[:-1])
        start += length
    # Links of ordinary groups one by one, of large ones by distinct ids.
    times = np.where(size[group_a] <= LARGE_GROUP, in_b[group_a], 0)
    left = np.repeat(np.arange(len(a)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    right = past_b[group_a[left]] + step
    out_a, out_b, out_t, count = [a[left]], [b[right]], [owner[group_a[left]]], None
    large = np.flatnonzero(size > LARGE_GROUP)
    if len(large):
        count = [np.ones(len(left), np.int64)]
        for g in large.tolist():
            ua, ca = np.unique(a[past_a[g] - in_a[g]:past_a[g]], return_counts=True)
            ub, cb = np.unique(b[past_b[g]:past_b[g] + in_b[g]], return_counts=True)
            out_a.append(np.repeat(ua, len(ub)))
            out_b.append(np.tile(ub, len(ua)))
            out_t.append(np.full(len(ua) * len(ub), owner[g]))
            count.append(np.outer(ca, cb).ravel())
        count = np.concatenate(count)
    return Aligned(n_a, n_b, np.bincount(owner, minlength=len(texts)), n_links, groups, np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_t), count)


class _Radix:
    """Pair numbers whose order is bucket, then id of a, then id of b."""

    def __init__(self, pair: Pair, buckets: int):
        self.buckets, self.size_b = buckets, pair.size_b
        self.span = -(-pair.size_a // buckets)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % self.buckets * self.span + a // self.buckets) * self.size_b + b

    def bounds(self) -> np.ndarray:
        return np.arange(self.buckets + 1) * (self.span * self.size_b)

    def side(self, number: np.ndarray) -> np.ndarray:
        return number // self.size_b

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.side(number)
        return x % self.span * self.buckets + x // self.span, number % self.size_b


def _runs(batches: Iterator[pa.RecordBatch], files: Files, text: str, digest: bool, buckets: int, run_links: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and for each run one row per bucket with its sorted (pair, document) records."""
    pair = pair_of(files)
    radix = _Radix(pair, buckets)
    task, seen, docs, held = TaskContext.get().partitionId(), 0, 0, 0
    keys: list[np.ndarray] = []
    times: list[np.ndarray | None] = []

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def close() -> pa.RecordBatch:
        weights = None if all(t is None for t in times) else np.concatenate([np.ones(len(k), np.int64) if t is None else t for k, t in zip(keys, times)])
        key, often = tallied(np.concatenate([np.zeros(0, np.int64), *keys]), weights)
        number = key >> DOC_BITS
        first = starts(number)
        count = np.diff(first, append=len(number))
        distinct = number[first]
        cut = np.searchsorted(distinct, radix.bounds())
        out: dict[str, list] = {"bucket": [], "keys": [], "counts": [], "members": [], "times": []}
        for k in range(buckets):
            i, j = int(cut[k]), int(cut[k + 1])
            if i == j:
                continue
            s = slice(int(first[i]), int(first[j]) if j < len(first) else len(key))
            out["bucket"].append(k)
            out["keys"].append(packed(distinct[i:j], ascending=True))
            out["counts"].append(packed(count[i:j]))
            out["members"].append(packed(key[s] & ((1 << DOC_BITS) - 1)))
            out["times"].append(packed(often[s]))
        n = len(out["bucket"])
        return rows({"run": pa.array([(task << 32) + seen] * n, pa.int64()), "docs": pa.array([docs] * n, pa.int64()), "bucket": pa.array(out.pop("bucket"), pa.int32())}
                    | {c: pa.array(v, pa.binary()) for c, v in out.items()})

    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        sizes = np.array([len(t) if t else 0 for t in column.to_pylist()])
        i = 0
        while i < len(sizes):
            j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i:]), CHUNK_BYTES, side="right")))
            got = align(column.slice(i, j - i).to_pylist(), pair)
            if docs and (held + len(got.a) > run_links or docs + j - i > 1 << DOC_BITS):
                yield close()
                seen, docs, held, keys, times = seen + 1, 0, 0, [], []
            keys.append(radix.number(got.a, got.b) << DOC_BITS | got.text + docs)
            times.append(got.times)
            shown = [hashlib.sha256(g).hexdigest() if g else "" for g in got.groups] if digest else [g.decode() for g in got.groups]
            yield rows({
                "run": pa.array([(task << 32) + seen] * (j - i), pa.int64()), "doc": pa.array(np.arange(docs, docs + j - i), pa.int32()),
                "row": batch.column(batch.schema.names.index("row")).slice(i, j - i), "n_a": pa.array(got.n_a), "n_b": pa.array(got.n_b),
                "n_groups": pa.array(got.n_groups), "n_links": pa.array(got.n_links), "groups": pa.array(shown, pa.string()),
            })
            docs, held, i = docs + j - i, held + len(got.a), j
    if docs:
        yield close()


def _best(pairs: np.ndarray, counts: np.ndarray, radix: _Radix) -> np.ndarray:
    """Whether a pair's count is the highest of its id of a; pairs come in the order of that id."""
    side = radix.side(pairs)
    first = starts(side)
    if not len(first):
        return np.zeros(0, bool)
    highest = np.maximum.reduceat(counts, first)
    return counts == np.repeat(highest, np.diff(first, append=len(side)))


def _send_back(records: pa.Table, totals: pa.Table, files: Files, buckets: int) -> pa.Table:
    """For each run of a bucket: what its documents get from the bucket's counts."""
    out: dict[str, list] = {"run": [], "best": [], "sums": []}
    if len(records):
        pairs, counts = unpacked(totals.column("keys")[0].as_py(), True), unpacked(totals.column("counts")[0].as_py())
        best = _best(pairs, counts, _Radix(pair_of(files), buckets))
    for run, docs, p, c, members, times in one_by_one(records, ["run", "docs", "keys", "counts", "members", "times"]):
        at = np.searchsorted(pairs, unpacked(p, True))
        at = np.repeat(at, unpacked(c))
        members, times = unpacked(members), unpacked(times)
        sums, tops = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
        np.add.at(sums, members, times * counts[at])
        np.add.at(tops, members, times * best[at])
        out["run"].append(run)
        out["best"].append(packed(tops))
        out["sums"].append(packed(sums))
    return pa.table({"run": pa.array(out["run"], pa.int64()), "best": pa.array(out["best"], pa.binary()), "sums": pa.array(out["sums"], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    best = sum(unpacked(x.as_py()) for x in table.column("best"))
    sums = sum(unpacked(x.as_py()) for x in table.column("sums"))
    return pa.table({"run": pa.array(np.full(len(sums), table.column("run")[0].as_py()), pa.int64()), "doc": pa.array(np.arange(len(sums)), pa.int32()),
                     "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(sums, pa.int64())})


@dataclass
class Alignment:
    """``documents``: columns of the input but the text, plus those of OWN; ``pairs``: a_id, b_id, n_docs, best."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, files: Files, text: str = "text", digest: bool = False, buckets: int = BUCKETS, run_links: int = RUN_LINKS, fan_in: int = FAN_IN) -> Alignment:
    """Tokens of every text by two tokenizers, their groups between common byte offsets, and corpus-wide counts of linked id pairs.

    n_a, n_b (tokens), n_groups, n_links (pairs of occurrences in a group), groups (``a1,a2|b1;a3|b2,b3``, or its SHA-256 with
    ``digest``), n_best (links whose pair is in the most documents of all pairs of its id of a; ties count) and count_sum (documents of
    the pair, summed over links).

    A task sorts its (pair, document) records in memory-sized runs, cut by radix into buckets of ids of a, each a compressed row. Per
    bucket the runs' pair counts, not their records, are merged by heap, ``fan_in`` at a time and in as many levels as that takes, so a
    frequent pair costs one entry a run, whatever its number of documents. The merge is in the order of ids of a, which gives maxima
    in passing. Counts then go back to the runs, a few runs of a bucket at a time, and each run adds them up for its documents. No
    task holds more than ``fan_in`` runs of a bucket, or its distinct pairs (at most ids of a in the bucket x ids of b).

    Null and empty texts, and texts that either tokenizer does not spell out again: zeros and ''. Repeated rows count one by one. Empty
    table: no rows. A single text's links have to fit a task. Input columns with the names of added ones are replaced.
    """
    keep = [c for c in docs.columns if c not in OWN and c != text]
    packed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([
        *[T.StructField(c, t) for c, t in (("run", T.LongType()), ("doc", T.IntegerType()))], packed.schema["row"],
        *[T.StructField(c, t) for c, t in OWN.items() if c not in ("n_best", "count_sum")],
        *[T.StructField(c, t) for c, t in (("docs", T.LongType()), ("bucket", T.IntegerType()), *((c, T.BinaryType()) for c in ("keys", "counts", "members", "times")))],
    ])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    arrow = to_arrow_schema(schema)
    parts = stored(packed.mapInArrow(lambda it: _runs(it, files, "text", digest, buckets, run_links, arrow), schema), "token-runs")
    records = parts.where("bucket is not null")

    n = records.select("run").distinct().count()
    totals = totals_of(records, n, fan_in)
    sent = send_back(records.select("run", "docs", "bucket", "keys", "counts", "members", "times"), totals, n, lambda r, t: _send_back(r, t, files, buckets),
                     "run long, best binary, sums binary")
    gained = sent.groupBy("run").applyInArrow(_added, "run long, doc int, n_best long, count_sum long")
    own = parts.where("doc is not null").select("run", "doc", "row", *[c for c in OWN if c not in ("n_best", "count_sum")])
    documents = own.join(gained, ["run", "doc"], "left").select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], *[c for c in OWN if c not in ("n_best", "count_sum")],
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
    )

    def spelt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix = _Radix(pair_of(files), buckets)
        for batch in it:
            for p, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                p, c = unpacked(p, True), unpacked(c)
                a, b = radix.ids(p)
                best = _best(p, c, radix)
                for i in range(0, len(p), BLOCK):
                    s = slice(i, i + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(c[s]), pa.array(best[s])], names=["a_id", "b_id", "n_docs", "best"])

    return Alignment(documents, totals.select("keys", "counts").mapInArrow(spelt, "a_id long, b_id long, n_docs long, best boolean"))
