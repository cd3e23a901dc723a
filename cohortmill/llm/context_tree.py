"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortmill.llm.rows import stored
from cohortmill.llm.runs import BLOCK, FAN_IN, merged, one_by_one, packed, send_back, starts, tallied, totals_of, unpacked
from cohortmill.llm.tokens import LOWER, SPACES, Words, mix, text_chunks

DEPTH = 5               # bytes of the longest context
RUN_BYTES = 24 << 20    # text whose sequences are sorted at once in a task: a run
RUN_DOCS = 1 << 18
COUNT_BYTES = 4 << 20   # text of a run whose sequences are held one by one
CHUNK_BYTES = 1 << 19   # text handled at once; a longer text is a chunk of its own
BUCKETS = 64            # of the two nearest context bytes, and of words
EDGE = 0xFF             # ends a text and stands before it; occurs in no UTF-8 text
END_WORD = np.uint64(0x5BD1E995CAFEF00D)  # key of the token that ends a text
TABLE = 1 << 16         # counts whose log factorials are tabled

OWN = {"held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(),
       "n_bytes": T.LongType(), "bits_per_byte": T.DoubleType()}
GRAM, WORD = 0, 1

_half = np.concatenate(([0.0], np.cumsum(np.log(np.arange(TABLE) + 0.5))))       # log of (1/2)(3/2)...(n - 1/2)
_whole = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, TABLE + 1)))))     # log n!


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; for large x exact to double precision."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def _from(table: np.ndarray, n: np.ndarray, shift: float, less: float) -> np.ndarray:
    small = n <= TABLE
    out = table[np.where(small, n, 0)]
    if not small.all():
        out[~small] = _log_gamma(n[~small] + shift) - less
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a sequence of so many zeros and ones."""
    half = 0.5 * np.log(np.pi)
    return _from(_half, zeros, 0.5, half) + _from(_half, ones, 0.5, half) - _from(_whole, zeros + ones, 1.0, 0.0)


class _Nodes:
    """Binary nodes (context, leading bits of the next byte) of one depth and bit level, in the order of their keys."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.deeper: np.ndarray | None = None  # log weighted probability of the contexts one byte longer

    def weigh(self) -> None:
        """Log weighted probability, and the share in it of the node's own estimate."""
        own = log_kt(self.zeros, self.ones)
        if self.deeper is None:
            self.log_w, self.share = own, np.ones(len(own))
        else:
            self.log_w = np.logaddexp(own, self.deeper) - np.log(2)
            self.share = np.exp(-np.logaddexp(0, self.deeper - own))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def probability(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        zeros, ones = self.zeros[at], self.ones[at]
        return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)


def shorter(pairs: np.ndarray) -> np.ndarray:
    """(context, byte) without the context's farthest byte."""
    return pairs >> 16 << 8 | pairs & 255


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> dict[tuple[int, int], _Nodes]:
    """Weighted nodes {(depth, bit level)} of contexts of ``top`` to ``depth`` bytes; all sequences of a context of ``top`` bytes have to be there."""
    pairs, counts = grams[counts > 0], counts[counts > 0]
    out: dict[tuple[int, int], _Nodes] = {}
    for d in range(depth, top - 1, -1):
        if d < depth:
            pairs, counts = tallied(shorter(pairs), counts)
        for level in range(8):
            keys = pairs >> (8 - level)
            first = starts(keys)
            ones = np.add.reduceat(np.where(pairs >> (7 - level) & 1, counts, 0), first) if len(first) else first
            total = np.add.reduceat(counts, first) if len(first) else first
            nodes = out[d, level] = _Nodes(keys[first], total - ones, ones)
            if d < depth:
                below = out[d + 1, level]
                parent = below.keys >> (8 + level) << level | below.keys & ((1 << level) - 1)
                nodes.deeper = np.bincount(np.searchsorted(nodes.keys, parent), weights=below.log_w, minlength=len(nodes.keys))
            nodes.weigh()
    return out


class Top:
    """Nodes of contexts of no byte and of one byte as whole tables: 256 and 65,536 entries, whatever the corpus."""

    def __init__(self, cells: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray):
        size = 1 << 16
        self.one = self._table(size, cells, zeros, ones, deeper)
        self.none = self._table(256, cells & 255, zeros, ones, self.one.log_w[cells])

    @staticmethod
    def _table(size: int, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray) -> _Nodes:
        whole = _Nodes(np.arange(size), np.zeros(size, np.int64), np.zeros(size, np.int64))
        np.add.at(whole.zeros, at, zeros)
        np.add.at(whole.ones, at, ones)
        whole.deeper = np.bincount(at, weights=deeper, minlength=size)
        whole.weigh()
        return whole


def top_cells(tree: dict[tuple[int, int], _Nodes]) -> tuple[np.ndarray, ...]:
    """What contexts of two bytes add to those of one: (cell = byte * 256 + node, zeros, ones, log weighted probability)."""
    cells, zeros, ones, deeper = [], [], [], []
    for level in range(8):
        n = tree[2, level]
        cells.append(n.keys >> (8 + level) << 8 | 1 << level | n.keys & ((1 << level) - 1))
        zeros.append(n.zeros)
        ones.append(n.ones)
        deeper.append(n.log_w)
    cell = np.concatenate(cells)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = starts(cell)
    added = [np.add.reduceat(np.concatenate(x)[order], first) if len(first) else np.concatenate(x) for x in (zeros, ones, deeper)]
    return cell[first], *added


def log10_probability(grams: np.ndarray, tree: dict[tuple[int, int], _Nodes], top: Top, depth: int) -> np.ndarray:
    """Of each sequence's last byte after the ones before, bit by bit: estimates of all its contexts seen in training, mixed from the longest to none."""
    out = np.zeros(len(grams))
    pairs = {depth: grams}
    for d in range(depth - 1, 1, -1):
        pairs[d] = shorter(pairs[d + 1])
    nearest = grams >> (8 * depth)
    for level in range(8):
        bit = (grams >> (7 - level) & 1).astype(bool)
        p, seen = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        inner = 1 << level | (grams & 255) >> (8 - level)
        steps = [(tree[d, level], *tree[d, level].find(pairs[d] >> (8 - level))) for d in range(depth, 1, -1)]
        for nodes, at in ((top.one, nearest * 256 + inner), (top.none, inner)):
            steps.append((nodes, at, nodes.zeros[at] + nodes.ones[at] > 0))
        for nodes, at, found in steps:
            at, b = at[found], bit[found]
            share = np.where(seen[found], nodes.share[at], 1.0)
            p[found] = share * nodes.probability(at, b) + (1 - share) * p[found]
            seen |= found
        out += np.log10(p)
    return out


def sequences_of(data: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of each text and its end: the byte and the ``depth`` ones before as one number, nearest first; and the text's number."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds) + 1)
    # One line of all texts, each with ``depth`` edges before and one after it; ``own`` marks what is to be coded.
    line = np.full(len(text) + depth * n, EDGE, np.uint8)
    own = np.ones(len(line), bool)
    begin = bounds[:-1] + np.arange(n) * (depth + 1)
    own[(begin[:, None] + np.arange(depth)).ravel()] = False
    filled = own.copy()
    filled[bounds[1:] + np.arange(1, n + 1) * depth + np.arange(n)] = False
    line[filled] = data
    out = np.zeros(len(line) - depth if n else 0, np.int64)
    for back in range(1, depth + 1):
        out |= line[depth - back:len(line) - back]
        out <<= 8
    out |= line[depth:]
    return out[own[depth:]], text


def _bucket_bits(depth: int, buckets: int) -> np.ndarray:
    """For each two context bytes their bucket, in the bits above a sequence."""
    return (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64) << (8 * (depth + 1))


def _gram_keys(data: np.ndarray, bounds: np.ndarray, depth: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams, text = sequences_of(data, bounds, depth)
    grams |= bits[grams >> (8 * (depth - 1))]
    return grams, text


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Value of each key; equal keys are brought together first, so the large table is asked once for each."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = starts(ordered)
    out = np.empty(len(keys))
    out[order] = np.repeat(values[np.searchsorted(known, ordered[first])], np.diff(first, append=len(keys)))
    return out


def _word_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hash of every word of lower-cased texts and of each text's end, with the text's number."""
    words = Words(data, bounds, SPACES, lower=False)
    n = len(bounds) - 1
    keys = np.concatenate((words.hash, np.full(n, END_WORD)))
    return (keys >> np.uint64(2)).astype(np.int64), np.concatenate((np.repeat(np.arange(n), np.diff(words.first)), np.arange(n)))


def _runs(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, run_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their lower-cased text, and per run and bucket the sorted sequences and words with their counts in texts to learn from."""
    task, seen, docs, held = TaskContext.get().partitionId(), 0, 0, 0
    keys: dict[int, list[np.ndarray]] = {GRAM: [], WORD: []}      # of the last texts, with the lowest bit for a text to learn from
    counted: dict[int, list[tuple]] = {GRAM: [], WORD: []}         # of the texts before: distinct keys and counts
    fresh = 0
    bits = _bucket_bits(depth, buckets)
    cut = {GRAM: np.arange(1, buckets) << (8 * (depth + 1)), WORD: np.arange(1, buckets) * ((1 << 62) // buckets)}

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def count() -> None:
        for kind, parts in keys.items():
            if parts:
                both = np.concatenate(parts)
                parts.clear()
                both.sort()
                first = starts(both >> 1)
                counted[kind].append((both[first] >> 1, np.add.reduceat(both & 1, first)))

    def close() -> pa.RecordBatch:
        count()
        out: dict[str, list] = {"kind": [], "bucket": [], "keys": [], "counts": []}
        for kind, parts in counted.items():
            pieces = list(merged(parts))
            parts.clear()
            distinct, counts = np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces])
            ends = [0, *np.searchsorted(distinct, cut[kind]).tolist(), len(distinct)]
            for b, (i, j) in enumerate(zip(ends, ends[1:])):
                if i < j:
                    for name, v in zip(out, (kind, b, packed(distinct[i:j], True), packed(counts[i:j]))):
                        out[name].append(v)
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        n = len(out["kind"])
        return rows({"run": pa.array([(task << 32) + seen] * n, pa.int64())} | {c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    for batch in batches:
        names = batch.schema.names
        learn = ~np.array(batch.column(names.index("held_out")).to_pylist(), bool)
        for i, j, data, bounds in text_chunks(batch.column(names.index("text")), CHUNK_BYTES):
            if docs and (held + len(data) > run_bytes or docs + j - i > RUN_DOCS):
                yield close()
                seen, docs, held, fresh = seen + 1, 0, 0, 0
            low = LOWER[data]
            for kind, (key, text) in ((GRAM, _gram_keys(low, bounds, depth, bits)), (WORD, _word_keys(low, bounds))):
                key <<= 1
                key |= learn[i:j][text]
                keys[kind].append(key)
            fresh += len(data)
            if fresh > COUNT_BYTES:
                count()
                fresh = 0
            offsets = pa.py_buffer(bounds.astype(np.int64))
            yield rows({
                "run": pa.array([(task << 32) + seen] * (j - i), pa.int64()), "row": batch.column(names.index("row")).slice(i, j - i),
                "held_out": batch.column(names.index("held_out")).slice(i, j - i),
                "low": pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, offsets, pa.py_buffer(low)]),
            })
            docs, held = docs + j - i, held + len(data)
    if docs:
        yield close()


def _without_bucket(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys & ((1 << (8 * (depth + 1))) - 1)


def _answers(records: pa.Table, totals: pa.Table) -> pa.Table:
    """For each run of a bucket the value of each of its keys."""
    out: dict[str, list] = {"run": [], "kind": [], "bucket": [], "keys": [], "values": []}
    if len(records):
        total = unpacked(totals.column("keys")[0].as_py(), True)
        values = np.frombuffer(totals.column("values")[0].as_py(), np.float64)
    for run, kind, bucket, keys in one_by_one(records, ["run", "kind", "bucket", "keys"]):
        for name, v in zip(out, (run, kind, bucket, keys, values[np.searchsorted(total, unpacked(keys, True))].tobytes())):
            out[name].append(v)
    return pa.table({"run": pa.array(out["run"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
                     "keys": pa.array(out["keys"], pa.binary()), "values": pa.array(out["values"], pa.binary())})


def _scored(docs: pa.Table, answers: pa.Table, depth: int, buckets: int, tokens: int, distinct: int, names: list[str]) -> pa.Table:
    """Scores of one run's documents."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    order = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")]) if len(answers) else answers
    for kind in (GRAM, WORD):
        rows = [(k, v) for n, k, v in one_by_one(order, ["kind", "keys", "values"]) if n == kind]
        known[kind] = (np.concatenate([np.zeros(0, np.int64), *[unpacked(k, True) for k, _ in rows]]), np.concatenate([np.zeros(0), *[np.frombuffer(v, np.float64) for _, v in rows]]))
    out: dict[str, list] = {c: [] for c in OWN if c != "held_out"}
    text = docs.column("low").combine_chunks() if len(docs) else pa.array([], pa.binary())
    text = pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text
    bits = _bucket_bits(depth, buckets)
    for i, j, data, bounds in text_chunks(text, CHUNK_BYTES):
        n = j - i
        value, n_keys = {}, {}
        for kind, (key, owner) in ((GRAM, _gram_keys(data, bounds, depth, bits)), (WORD, _word_keys(data, bounds))):
            value[kind], n_keys[kind] = (looked_up(key, *known[kind]), owner), np.bincount(owner, minlength=n)
        count, owner = value[WORD]
        base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))
        score = np.bincount(value[GRAM][1], weights=value[GRAM][0], minlength=n)
        size = np.diff(bounds)
        for name, v in (("n_tokens", n_keys[WORD]), ("n_known", np.bincount(owner, weights=count > 0, minlength=n).astype(np.int64)), ("train_tokens", np.full(n, tokens)),
                        ("base_score", np.bincount(owner, weights=base, minlength=n)), ("score", score), ("n_bytes", size), ("bits_per_byte", -score / np.log10(2) / (size + 1))):
            out[name].append(v)
    columns = {"row": docs.column("row"), "held_out": docs.column("held_out")} | {c: pa.array(np.concatenate(v) if v else []) for c, v in out.items()}
    return pa.table({c: columns[c] for c in names})


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", depth: int = DEPTH, buckets: int = BUCKETS, run_bytes: int = RUN_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Log10 probability of every text under a context-tree weighting of the rows that are not ``held_out``, beside a unigram base.

    The columns of ``docs`` but the text, plus: held_out; n_tokens (words and one end), n_known (of them met in training), train_tokens,
    base_score (unigram with 0.1 added to each count); score (log10 probability of the lower-cased bytes and the end), n_bytes,
    bits_per_byte (code length, the end counted as a byte).

    A context is the 0 to ``depth`` (2 to 5) bytes before; the next byte is eight binary choices, each a node with Krichevsky-Trofimov
    counts in every context. A node's weighted probability is half its own estimate plus half the product over the contexts one byte
    longer. The share of the first half, once all training text is counted, mixes estimates when a bit is scored; a context without
    training text has no say, so the weight stays with the longest one that has some. Contexts are padded with an edge byte.

    A task counts sequences of ``depth`` + 1 bytes in memory-sized runs; the runs' counts are merged per bucket of the two nearest
    bytes (heap merge, in levels). All contexts of two or more bytes of a bucket lie inside it; those of no and one byte are 65,536 cells
    at most, summed by an aggregate and handed to every task. The probability of each sequence goes back to the runs that hold it, and
    each run sums it over its documents. Hot sequences and words cost one entry a run. Words are told apart by a 62-bit hash.

    Null text counts as empty: an end only. Null ``held_out`` counts as false. Nothing to learn from: every bit has 1/2, the base
    0 tokens. Repeated rows count one by one. Empty table: no rows. A long text is a run of its own and has to fit a task.
    Input columns with the names of added ones are replaced.
    """
    if not 2 <= depth <= 5:
        raise ValueError("depth has to be 2 to 5")
    keep = [c for c in docs.columns if c not in OWN and c != text]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    source = docs.select(row, F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("run", T.LongType()), T.StructField("row", source.schema["row"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("low", T.BinaryType()),
        T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)
    parts = stored(source.mapInArrow(lambda it: _runs(it, depth, buckets, run_bytes, arrow), schema), "ctw-runs")
    # One numbering for both kinds: buckets of sequences, then of words.
    records = parts.where("kind is not null").select("run", "kind", (F.col("kind") * buckets + F.col("bucket")).alias("bucket"), "keys", "counts")
    runs = records.select("run").distinct().count()
    totals = totals_of(records, runs, fan_in)
    grams, words = totals.where(F.col("bucket") < buckets), totals.where(F.col("bucket") >= buckets)

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                tree = subtree(_without_bucket(unpacked(keys.as_py(), True), depth), unpacked(counts.as_py()), depth, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in top_cells(tree)], names=["cell", "zeros", "ones", "deeper"])

    found = grams.select("keys", "counts").mapInArrow(cells, "cell long, zeros long, ones long, deeper double").groupBy("cell")
    found = found.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("deeper").alias("deeper")).orderBy("cell").toArrow()
    top = Top(*[found.column(c).to_numpy() for c in ("cell", "zeros", "ones", "deeper")])

    def tokens_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts = [unpacked(c.as_py()) for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], names=["n", "v"])

    n, v = words.select("counts").mapInArrow(tokens_of, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def valued(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for bucket, keys, counts in zip(*(batch.column(c) for c in ("bucket", "keys", "counts"))):
                count = unpacked(counts.as_py())
                value = count.astype(np.float64)
                if bucket.as_py() < buckets:
                    key = _without_bucket(unpacked(keys.as_py(), True), depth)
                    tree = subtree(key, count, depth, 2)
                    for i in range(0, len(key), BLOCK):
                        value[i:i + BLOCK] = log10_probability(key[i:i + BLOCK], tree, top, depth)
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()], pa.int32()), pa.array([keys.as_py()], pa.binary()), pa.array([value.tobytes()], pa.binary())],
                                                 names=["bucket", "keys", "values"])

    values = stored(totals.mapInArrow(valued, "bucket int, keys binary, values binary"), "ctw-values")
    answers = send_back(records.select("run", "kind", "bucket", "keys"), values, runs, _answers, "run long, kind int, bucket int, keys binary, values binary")
    result = T.StructType([T.StructField("row", parts.schema["row"].dataType), *[T.StructField(c, t) for c, t in OWN.items()]])
    scored = parts.where("low is not null").select("run", "row", "held_out", "low").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(
        lambda d, a: _scored(d, a, depth, buckets, n, v, ["row", *OWN]), result)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *OWN)

