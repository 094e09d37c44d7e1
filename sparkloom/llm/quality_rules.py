"""Quality rules: word and symbol counts of every whole text, and compression bands.

Base counts take words as runs without a space or U+0009 to U+000D. A text fails the base rule with fewer than
MIN_WORDS words, or when over a fifth of its words lie in 5-word windows that the text has twice or more. The method's
verdict compares zstandard ratios (compressed over plain bytes) with limits that depend on length: of the whole text,
where repetition far apart shows, and of each fixed chunk of it, where local repetition or noise shows. A ratio below
its low limit is repetitive, above its high limit incompressible. In texts below the first length (200 bytes) the format's
own overhead outweighs what a text shares with itself, so good and poor ones have the same ratios; the base rule alone
judges them.

A null or empty text has no words and fails the base rule. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
CHUNK_BYTES = 4096
#: Lowest and highest ratio at a number of bytes; between two of them the limits go with the logarithm of the length,
#: beyond the last they stay. Longer texts share more with themselves, so limits fall. The low ones lie 2.5 % and more below the
#: least ratio of any text labelled good in 10,000 documents, the high ones stay clear of prose in any script.
WHOLE_BANDS = [(200, 0.54, 0.90), (700, 0.508, 0.80), (1_400, 0.466, 0.72), (2_800, 0.444, 0.68), (5_600, 0.422, 0.65), (11_000, 0.408, 0.62), (25_000, 0.388, 0.60), (100_000, 0.355, 0.60)]
#: The same for a chunk; a last chunk below the first length counts with the one before it.
CHUNK_BANDS = [(1_000, 0.465, 0.80), (2_000, 0.445, 0.75), (4_096, 0.435, 0.72)]
#: So large a share of a text's chunks must lie outside their band to reject the text.
BAD_CHUNKS = 0.25
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = "\x20\x09-\x0d"
_RUNS = re.compile(f"[{_SPACE}]+")
_SCHEMA = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole_ratio double, worst_low double, bad_chunks double, base_failed boolean, verdict string"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def repeated_in_windows(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words lie in a window of words that the text has twice or more. codes: the words
    of all texts in order, equal numbers for equal words; counts: how many words each text has."""
    total, ends = len(codes), np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(np.arange(total) + window <= np.repeat(ends, counts))
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) * _ODD[0]
        mixed ^= mixed >> np.uint64(29)
        value = text[starts].astype(np.uint64) * _ODD[5]
        for k in range(window):
            value = (value ^ mixed[starts + k]) * _ODD[1 + k % 4]
            value ^= value >> np.uint64(31)
    by = np.argsort(value, kind="stable")
    same = value[by][1:] == value[by][:-1]
    twice = np.zeros(len(starts), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    cover = np.zeros(total + 1, np.int64)
    hit = starts[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(text[inside], minlength=len(counts)).astype(np.int64)


def _band(size: int, bands: list) -> tuple[float, float] | None:
    """The limits of a text of so many bytes, None below the first length."""
    if size < bands[0][0]:
        return None
    length, low, high = zip(*bands, strict=True)
    at = np.log(size)
    return float(np.interp(at, np.log(length), low)), float(np.interp(at, np.log(length), high))


def bands(data: bytes, whole: zstandard.ZstdCompressor, part: zstandard.ZstdCompressor) -> tuple[float | None, float | None, float, str | None]:
    """(ratio of the whole, least ratio of a chunk, share of chunks outside their band, what speaks against the text)."""
    limits = _band(len(data), WHOLE_BANDS)
    if limits is None:
        return None, None, 0.0, None
    ratio = len(whole.compress(data)) / len(data)
    why = "repetitive" if ratio < limits[0] else "incompressible" if ratio > limits[1] else None
    cuts = list(range(0, len(data), CHUNK_BYTES))
    if len(cuts) > 1 and len(data) - cuts[-1] < CHUNK_BANDS[0][0]:
        cuts.pop()
    chunks = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    least, bad, low = None, 0, 0
    for c in chunks:
        if (own := _band(len(c), CHUNK_BANDS)) is None:
            continue
        r = len(part.compress(c)) / len(c)
        least = r if least is None else min(least, r)
        bad, low = bad + (not own[0] <= r <= own[1]), low + (r < own[0])
    share = bad / len(chunks)
    if why is None and share >= BAD_CHUNKS:
        why = "repetitive chunks" if 2 * low >= bad else "incompressible chunks"
    return ratio, least, share, why


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, part = zstandard.ZstdCompressor(level=3, write_content_size=False), zstandard.ZstdCompressor(level=1, write_content_size=False)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            texts = pc.fill_null(b["text"], "")
            flat = texts
            for c in "\t\n\x0b\x0c\r":
                flat = pc.replace_substring(flat, c, " ")
            lists = pc.split_pattern(flat, " ")
            words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            words, of = words.filter(pa.array(real)), of[real]
            counts = np.bincount(of, minlength=b.num_rows).astype(np.int64)
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            chars = np.bincount(of, weights=pc.utf8_length(words).to_numpy(zero_copy_only=False), minlength=b.num_rows).astype(np.int64)
            repeats = repeated_in_windows(codes, counts)
            symbols = pc.count_substring_regex(texts, f"[{SYMBOLS}]").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = []
            for i, t in enumerate(texts.to_pylist()):
                seen: set[str] = set()
                dup = 0
                for line in t.split("\n"):
                    if line in seen:
                        dup += bool(_RUNS.sub("", line)) if line[:1].isspace() or not line else 1
                    else:
                        seen.add(line)
                n, again = int(counts[i]), int(repeats[i])
                failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
                ratio, least, share, why = bands(t.encode("utf-8", "surrogatepass"), whole, part)
                rows.append((n, int(chars[i]), int(symbols[i]), dup, again, ratio, least, share, failed, why))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_(), pa.string()]
            names = [*COUNTS, "whole_ratio", "worst_low", "bad_chunks", "base_failed", "verdict"]
            yield pa.RecordBatch.from_arrays([b["key"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", *names])


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, whole_ratio, worst_low, bad_chunks, base_failed, verdict, kept): a row for each row of docs.
    verdict: what the compression bands hold against the text, null if nothing."""
    ready(docs.sparkSession)
    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_measure, _SCHEMA)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("verdict").isNull()).withColumnRenamed("key", key)


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that the rules reject, all columns, judged where they are read (no shuffle)."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                own = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), pc.cast(part[text], pa.string())], names=["key", "text"])
                verdict = next(iter(_measure(iter([own]))))
                yield part.filter(pc.and_(pc.invert(verdict["base_failed"]), pc.is_null(verdict["verdict"])))
                del own, part, verdict
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
