"""BPE encoding and decoding through a table of distinct words.

encode: Spark splits the texts into units, block by block; the distinct units of all blocks meet by hash, each is
encoded once, and the ids go back to their blocks, where a unit's place in its text tells where they belong.
Only distinct units and their places are shuffled, never the texts. The texts are split twice, for the units and for
their places, so they must come in the same order both times, as from files or a written table; if they don't, the
job fails rather than return other ids. decode: a join from id to piece. The piece table
is as large as the vocabulary and no larger, whatever the corpus, so each task holds it as a broadcast.

Nulls and empty texts have no ids and decode to the empty text. Rows with equal or null ids stay separate rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, ready
from .units import ByteBpe, ragged, spelled, split

#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000

_BLOCK = "block long, part int, keys array<long>, numbers binary, words array<string>"


@lru_cache(2)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, one plane of bytes after another, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _row(block: int, part: int, keys, numbers: np.ndarray, words) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([_packed(numbers)], pa.binary()), pa.array([words], pa.list_(pa.string()))],
        names=["block", "part", "keys", "numbers", "words"],
    )


def _blocks(parts: int):
    """A row for the block (part -1): its documents' keys, then numbers = how many units each has and which; and a row
    for each part of its distinct units: numbers = their numbers in the block, words = the units."""

    def one(block: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches).combine_chunks()
        order, units, counts = split(both["text"].combine_chunks() if isinstance(both["text"], pa.ChunkedArray) else both["text"])
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        keys = both["key"].to_pylist()
        seen = zlib.crc32("\0".join(words).encode())
        yield _row(block, -1, [keys[i] for i in order], np.concatenate([counts, coded.indices.to_numpy(zero_copy_only=False), [len(words), seen]]), None)
        part = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64) % parts
        by = np.argsort(part, kind="stable")
        for places in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else []:
            yield _row(block, int(part[places[0]]), None, np.concatenate([places, [seen]]), [words[i] for i in places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for start in range(0, b.num_rows, 256):
                x = b.slice(start, 256)
                n = pc.sum(pc.binary_length(x["text"])).as_py() or 0
                if held and size + n > BLOCK_BYTES:
                    yield from one(block, held)
                    block, held, size = block + 1, [], 0
                    pa.default_memory_pool().release_unused()
                held.append(x)
                size += n
        if held:
            yield from one(block, held)

    return run


def _encode_part(path: str):
    """All blocks' units of one part: each distinct one encoded once, the ids dealt back to the blocks."""

    def run(t: pa.Table) -> pa.Table:
        lists = t["words"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        ids, counts = vocabulary(path).encode([spelled(w) for w in coded.dictionary.to_pylist()])
        at = np.cumsum(counts) - counts
        used = np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1])
        out = [_packed(np.concatenate([counts[k], ids[ragged(at[k], counts[k])]])) for k in used]
        return pa.table({"block": t["block"], "places": t["numbers"], "ids": pa.array(out, pa.binary())})

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with their ids, little-endian unsigned 32-bit numbers in one binary."""
    keys = left["keys"].to_pylist()[0] if left.num_rows else []
    numbers = _unpacked(left["numbers"].to_pylist()[0]) if left.num_rows else np.zeros(0, np.uint32)
    numbers, (size, seen) = (numbers[:-2], numbers[-2:]) if len(keys) else (numbers, (0, 0))
    held = [(_unpacked(p).astype(np.int64), _unpacked(i)) for p, i in zip(right["places"].to_pylist(), right["ids"].to_pylist(), strict=True)]
    if any(p[-1] != seen for p, _ in held) or sum(len(p) - 1 for p, _ in held) != size:
        raise ValueError("the documents came in another order the second time: write them to a table first")
    held = [(p[:-1], i) for p, i in held]
    places = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in held)])
    counts = np.concatenate([np.zeros(0, np.int64), *(i[: len(p)] for p, i in held)]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, np.uint32), *(i[len(p) :] for p, i in held)])
    at, n = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    at[places], n[places] = np.cumsum(counts) - counts, counts
    units, used = numbers[: len(keys)].astype(np.int64), numbers[len(keys) :]
    many = n.astype(np.int32)[used]
    per_unit = np.concatenate([[0], np.cumsum(many)])
    ends = per_unit[np.concatenate([[0], np.cumsum(units)])] * 4
    del per_unit
    data = ids.astype("<u4", copy=False)[ragged(at.astype(np.int32)[used], many)]
    blob = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    pa.default_memory_pool().release_unused()
    return pa.table({"key": pa.array(keys, pa.int64()), "ids": blob.cast(pa.binary())})


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of every whole text as little-endian unsigned 32-bit numbers in one binary; special strings in
    a text are their special id, none is added."""
    spark = docs.sparkSession
    ready(spark)
    parts = partitions(spark)
    blocks = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_blocks(parts), _BLOCK)
    words = blocks.filter("part >= 0").select("part", "block", "numbers", "words")
    ids = words.groupBy("part").applyInArrow(_encode_part(path), "block long, places binary, ids binary")
    whole = blocks.filter("part < 0").select("block", "keys", "numbers")
    out = whole.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble, "key long, ids binary")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the text of each row's ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
    ready(encoded.sparkSession)
    pieces = encoded.sparkSession.sparkContext.broadcast(vocabulary(path).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.large_binary())
        for b in batches:
            lengths = np.nan_to_num(pc.binary_length(b["ids"]).to_numpy(zero_copy_only=False)).astype(np.int64) // 4
            flat = np.frombuffer(b"".join(x or b"" for x in b["ids"].to_pylist()), "<u4")
            joined = table.take(pa.array(flat))
            to = np.frombuffer(joined.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            ends, data = to[np.concatenate([[0], np.cumsum(lengths)])], joined.buffers()[2] or pa.py_buffer(b"")
            whole = memoryview(data)
            texts = [str(whole[ends[i] : ends[i + 1]], "utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b["key"], b["ids"], pa.array(texts, pa.string())], names=["key", "ids", "text"])

    out = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key long, ids binary, text string")
    return out.withColumnRenamed("key", key).withColumnRenamed("ids", ids)
