"""Best-fit packing of token sequences by exact complements.

Every document's ids, with an end id, are cut into pieces of at most `capacity`; of a longer document only the first
piece may be shorter. The plan needs the pieces' lengths alone: how many there are of each, at most `capacity` numbers.
From the longest length down, a piece's gap is filled exactly by one length, else a pair, else a triple whose sum is
the gap, as often as all of them are still available. An index, filled once, lists the pairs of each sum and the first
members of the triples of each sum (the rest of such a triple is a pair); entries whose lengths have run out are passed
over. What has no exact complement is packed best-fit, longest first. Each step uses up a length or an open
gap, so the plan has a few rows for each length whatever the number of documents, and is broadcast. Pieces are
numbered within their length and the task that writes them, and the counts of earlier tasks are added, so that no length
meets in one task; the number says which sequence of the plan a piece goes to.

A null or empty text has the end id alone. Repeated rows are packed each. An empty table gives an empty result. Other
columns of the input are ignored. Ties between pieces of equal length go by the order they are read in.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ready, stored
from .units import ByteBpe, Encoder, ragged

CAPACITY, END = 1024, 2
_ROWS, _BYTES = 512, 4_000_000


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(ByteBpe(path))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = _ROWS, size: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded rows and bytes; a longer text comes alone."""
    for b in batches:
        to = np.cumsum(np.nan_to_num(pc.binary_length(b[column]).to_numpy(zero_copy_only=False)))
        at = 0
        while at < b.num_rows:
            n = int(np.searchsorted(to, (to[at - 1] if at else 0) + size, side="right")) - at
            n = max(1, min(n, rows))
            yield b.slice(at, n)
            at += n


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32): the pieces of every whole text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in slices(batches):
            order, ids, counts = encoder(b["text"])
            lengths = counts + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), end, dtype="<u4")
            flat[ragged(ends - lengths, counts)] = ids
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = ragged(np.zeros(len(n), np.int64), n)
            first = lengths - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at, data = ((ends - lengths)[doc] + start) * 4, memoryview(flat.tobytes())
            crc = [zlib.crc32(data[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            keys = b["key"].take(pa.array(order)).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])
            del b, flat, data, ids, keys
            pa.default_memory_pool().release_unused()

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


class Plan:
    """runs: (length, first number, how many, first sequence, offset). Pieces number first .. first + how many - 1 of
    that length go to as many sequences from the first sequence on, each at that offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self._left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self._left[length] = n
        self._given = np.zeros(capacity + 1, np.int64)
        self._open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, how many)
        self._index()
        rest = {length: n for length in range(capacity, 0, -1) if (n := self._complement(length))}
        for length, n in rest.items():
            self._left[length] = n
            self._best_fit(length)

    def _give(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self._given[length]), n, sequence, offset))
        self._given[length] += n
        self._left[length] -= n

    def _fill(self, lengths: list[int]) -> bool:
        """As many new sequences of these lengths as there are pieces for."""
        n = min(int(self._left[x]) // k for x, k in Counter(lengths).items())
        if not n:
            return False
        offset = 0
        for x in lengths:
            self._give(x, n, self.sequences, offset)
            offset += x
        self.sequences += n
        if offset < self.capacity:
            self._open[self.capacity - offset].append((self.sequences - n, n))
        return True

    def _index(self) -> None:
        """Of each sum: the larger members of the pairs that give it, and the first members of the triples that do, so
        that the first one is the largest; both from the largest down."""
        held = self._left > 0
        self._pair_sums: list[np.ndarray] = []
        for total in range(self.capacity + 1):
            large = np.arange(total - 1, (total + 1) // 2 - 1, -1) if total > 1 else np.zeros(0, np.int64)
            self._pair_sums.append(large[held[large] & held[total - large]])
        some = np.array([len(x) > 0 for x in self._pair_sums])
        self._triple_sums: list[np.ndarray] = []
        for total in range(self.capacity + 1):
            first = np.arange(total - 2, 0, -1)
            self._triple_sums.append(first[held[first] & some[total - first]] if total > 2 else np.zeros(0, np.int64))

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available lengths with this sum, the larger one first and as large as possible."""
        if total < 2:
            return
        large = self._pair_sums[total]
        for x in large[(large <= most) & (self._left[large] > 0) & (self._left[total - large] > 0)].tolist():
            yield x, total - x

    def _firsts(self, total: int, most: int) -> list[int]:
        """Available first members of triples with this sum."""
        first = self._triple_sums[max(0, total)]
        return first[(first <= most) & (self._left[first] > 0)].tolist()

    def _complement(self, length: int) -> int:
        """Fills the gaps of this length exactly; how many pieces of it are left."""
        gap = self.capacity - length
        if not gap:
            if self._left[length]:
                self._fill([length])
            return 0
        if self._left[length]:
            self._fill([length, gap]) if self._left[gap] else None
        for pair in self._pairs(gap, length) if self._left[length] else ():
            self._fill([length, *pair])
            if not self._left[length]:
                break
        if self._left[length]:
            for x in self._firsts(gap, length):
                for pair in self._pairs(gap - x, x) if self._left[x] else ():
                    self._fill([length, x, *pair])
                    if not self._left[length] or not self._left[x]:
                        break
                if not self._left[length]:
                    break
        left, self._left[length] = int(self._left[length]), 0
        return left

    def _best_fit(self, length: int) -> None:
        while n := int(self._left[length]):
            gap = min((g for g, held in self._open.items() if g >= length and held), default=None)
            if gap is None:
                times = self.capacity // length
                self._fill([length] * min(times, n))
                continue
            first, many = self._open[gap].pop()
            k = min(n, many)
            self._give(length, k, first, self.capacity - gap)
            if k < many:
                self._open[gap].append((first + k, many - k))
            if gap > length:
                self._open[gap - length].append((first, k))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the number of a piece among the task's pieces of its length."""
    task, seen = TaskContext.get().partitionId(), defaultdict(int)
    for b in batches:
        length = b["length"].to_numpy(zero_copy_only=False)
        by = np.argsort(length, kind="stable")
        kinds, first, n = np.unique(length[by], return_index=True, return_counts=True)
        row = np.empty(len(length), np.int64)
        row[by] = np.arange(len(length)) - np.repeat(first, n) + np.repeat([seen[k] for k in kinds.tolist()], n)
        for k, m in zip(kinds.tolist(), n.tolist(), strict=True):
            seen[k] += m
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), task), pa.int32()), pa.array(row)], names=[*b.schema.names, "_task", "_row"])


def _schema(fields: list, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), extra])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, a table of pieces with a length (long), with sequence_id and offset added."""
    spark, fields = cut.sparkSession, cut.schema.fields
    ready(spark)
    numbered = stored(cut.mapInArrow(_number, _schema(fields, "_task int, _row long")))
    counts = numbered.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    groups = stored(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    lengths = groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    runs = np.array(sorted(Plan({r["length"]: r["n"] for r in lengths}, capacity).runs), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(runs)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        of = runs[:, 0] << 44 | runs[:, 1]
        for b in batches:
            length, number = (b[c].to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.searchsorted(of, length << 44 | number, side="right") - 1
            extra = [pa.array(runs[at, 3] + number - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), *extra], names=[*names, "sequence_id", "offset"])

    # (length, task) pairs are many, but each has no more pieces than one task wrote
    met = numbered.join(groups.select("length", "_task", "_before"), ["length", "_task"]).withColumn("_number", F.col("_before") + F.col("_row"))
    return met.select(*names, "_number").mapInArrow(run, _schema(fields, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs."""
    return pack(pieces(docs, path, key, text, capacity, end), capacity)
