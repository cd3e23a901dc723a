"""Sorted runs of counted keys: packing, heap merge in levels, and the way back from totals to runs."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rows import stored

FAN_IN = 64      # runs merged at once
SALT = 16        # runs of a bucket that one task sends totals to
BLOCK = 1 << 16  # keys between two bounds of a merge


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Zstandard frame of a non-negative integer array: a byte for the item size, then items, as steps if they ascend."""
    if ascending:
        x = np.diff(x, prepend=0)
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def unpacked(x: bytes, ascending: bool = False) -> np.ndarray:
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), f"u{x[0]}").astype(np.int64)
    return np.cumsum(out) if ascending else out


def starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def tallied(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    if times is None:
        keys.sort()
        first = starts(keys)
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = starts(keys)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def merged(runs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Heap merge of ascending (keys, counts) runs into ascending pieces without repeats.

    The heap holds the last key of each run's next block. Everything up to the least of them is complete in all runs' next blocks,
    so a piece is at most one block of each run.
    """
    place = [0] * len(runs)
    heap = [(int(k[min(block, len(k)) - 1]), r) for r, (k, _) in enumerate(runs) if len(k)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for r, (k, c) in enumerate(runs):
            j = place[r] + int(np.searchsorted(k[place[r]:place[r] + block], bound, side="right"))
            keys.append(k[place[r]:j])
            counts.append(c[place[r]:j])
            place[r] = j
        yield tallied(np.concatenate(keys), np.concatenate(counts))
        while heap and heap[0][0] <= bound:
            r = heapq.heappop(heap)[1]
            k = runs[r][0]
            if place[r] < len(k):
                heapq.heappush(heap, (int(k[min(place[r] + block, len(k)) - 1]), r))


def _merge_group(table: pa.Table) -> pa.Table:
    runs = [(unpacked(k, True), unpacked(c)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    pieces = [*merged(runs), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    keys, counts = np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces])
    first = table.slice(0, 1)
    return pa.table({"bucket": first.column("bucket"), "part": first.column("part"), "keys": pa.array([packed(keys, True)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary())})


def totals_of(records: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """(bucket, keys, counts), one row per bucket, of ``records`` (run, bucket, keys, counts): counts of equal keys added up.

    Runs are merged ``fan_in`` at a time on average, in as many levels as that takes; each level is a stored table. A task holds the
    packed runs of one group and their distinct keys.
    """
    shape = "bucket int, part long, keys binary, counts binary"
    level = records.select("bucket", F.xxhash64("run").alias("part"), "keys", "counts")
    while runs > fan_in:
        runs = -(-runs // fan_in)
        level = stored(level.withColumn("part", F.pmod("part", F.lit(runs))).groupBy("bucket", "part").applyInArrow(_merge_group, shape), "merge")
        level = level.withColumn("part", F.xxhash64("part"))
    return stored(level.withColumn("part", F.lit(0).cast("long")).groupBy("bucket", "part").applyInArrow(_merge_group, shape).drop("part"), "totals")


def send_back(records: DataFrame, totals: DataFrame, runs: int, answer: Callable[[pa.Table, pa.Table], pa.Table], shape: str) -> DataFrame:
    """``answer(records, totals)`` for the records of at most some ``SALT`` runs of a bucket at a time, with the bucket's one row of totals.

    Both have a column ``bucket``, ``records`` a column ``run``; totals are copied once for each group of runs.
    """
    salts = max(1, -(-runs // SALT))
    left = records.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(salts)))
    right = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(answer, shape)


def one_by_one(table: pa.Table, columns: list[str]) -> Iterator[tuple]:
    """Rows of an Arrow table as tuples of Python values, unpacked one at a time."""
    for row in table.select(columns).to_batches(max_chunksize=1):
        yield tuple(c[0].as_py() for c in row.columns)
