"""Exact token counts of every prefix, by dynamic programming over the vocabulary of a piece BPE.

A sequence of pieces is what BPE makes of a text if and only if BPE keeps every two neighbours of it apart. So each
prefix ends in exactly one piece that fits behind the last piece of a shorter prefix, and its count is one more than
that prefix's: a table of last pieces and counts is filled from left to right and no prefix is encoded again. Merges
never cross the units of a text (no piece has a space after another character), so the table of a text is the sum of
the counts before a unit and the table of the unit, which is computed once for each distinct unit a task meets, for
many units at a time. The count of each whole unit is compared with the library's; should they ever differ, the unit's prefixes are encoded one by
one instead.

From the table come the token count of a text and the longest prefix within a budget, without encoding again.

A null or empty text has 0 tokens. Special strings in a text are ordinary text. Repeated rows each get a row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .shared import ready
from .units import ragged, split

LIMIT = 4096
_SPACE = "▁"
#: Units and their characters, and neighbours, after which a task's tables of them are emptied.
_UNITS, _UNIT_CHARS, _PAIRS = 500_000, 16_000_000, 1_500_000
#: Characters of units that are filled together, and how many units at a time.
_LOCKSTEP, _TOGETHER = 40, 65_536


class _Lookup:
    """Whole numbers to whole numbers, many at once: open addressing in numpy arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self._values = np.full(1 << bits, -1, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self._values[at] < 0
            self._keys[at[free]] = keys[free]
            mine = free & (self._keys[at] == keys)
            self._values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self._mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        at = self._place(keys)
        held = self._keys[at]
        out = np.where(held == keys, self._values[at], np.int32(-1))
        going = np.flatnonzero((held != keys) & (self._values[at] >= 0))
        while len(going):
            at[going] = (at[going] + 1) & self._mask
            held, found = self._keys[at[going]], self._values[at[going]]
            hit = held == keys[going]
            out[going[hit]] = found[hit]
            going = going[~hit & (found >= 0)]
        return out


class PrefixCounter:
    def __init__(self, path: str):
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._library.get_piece_size())
        special = lambda i: self._library.is_control(i) or self._library.is_unknown(i) or self._library.is_byte(i)
        self.score = {self._library.id_to_piece(i): self._library.get_score(i) for i in ids if not special(i)}
        if any(_SPACE in p.lstrip(_SPACE) or ("\n" in p and len(p) > 1) for p in self.score):
            raise ValueError("pieces of this vocabulary cross units")
        merged = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        self._rank = {p: i for i, p in enumerate(merged, 1)}
        self._halves = {p: self._last_merge(p) for p in merged}
        self._tails = {p[k:] for p in self.score for k in range(len(p))}
        self._apart: dict[tuple[str, str], bool] = {}
        self._arrays()
        self._clear()

    def _arrays(self) -> None:
        """The vocabulary as arrays: pieces are numbered; the number after the last stands for any character that is no
        piece, the next one for the start of a unit."""
        number = {p: i for i, p in enumerate(self.score)}
        self._unknown, self._start = len(number), len(number) + 1
        self._rank_of = np.zeros(len(number) + 2, np.int32)
        self._left, self._right = np.full(len(number) + 2, self._unknown, np.int32), np.full(len(number) + 2, self._unknown, np.int32)
        self._possible = np.ones(len(number) + 2, bool)
        for p, r in self._rank.items():
            self._rank_of[number[p]] = r
            if halves := self._halves[p]:
                self._left[number[p]], self._right[number[p]] = (number.get(h, self._unknown) for h in halves)
            else:
                self._possible[number[p]] = False
        pairs = [(number[p[:k]] << 20 | number[p[k:]], r) for p, r in self._rank.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self._joined = _Lookup(np.array([k for k, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int32))
        # a trie of the pieces read backwards: from the node of a tail and the character before it to the longer tail's
        node = {"": 0} | {t: i for i, t in enumerate(sorted(self._tails), 1)}
        steps = [(node[t[1:]] << 21 | ord(t[0]), node[t]) for t in self._tails]
        self._before = _Lookup(np.array([k for k, _ in steps], np.uint64), np.array([n for _, n in steps], np.int32))
        self._piece = np.full(len(node), -1, np.int32)
        for p, i in number.items():
            self._piece[node[p]] = i

    def _clear(self) -> None:
        self._of: dict[str, int] = {}
        self._tables: list[bytes | np.ndarray] = []
        self._size = 0
        self._tokens, self._chars = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that BPE makes this one of; None if BPE ends in more than one."""
        parts = list(piece)
        while len(parts) > 2:
            best = max((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == -np.inf:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _fits(self, before: str, piece: str) -> bool:
        """Whether BPE keeps the two apart (before is empty at the start): undoing their merges, latest first, never
        shows neighbours that would have become one earlier."""
        if self._halves.get(piece, piece) is None:
            return False
        known = self._apart.get((before, piece))
        if known is not None or not before:
            return known is not False
        rank, halves, a, b, limit = self._rank, self._halves, before, piece, len(self._rank) + 1
        while rank.get(a + b, limit) >= limit:
            of_a, of_b = rank.get(a, 0), rank.get(b, 0)
            if of_a > of_b:
                limit, a = of_a, halves[a][1]
            elif of_b:
                limit, b = of_b + 1, halves[b][0]
            else:
                self._apart[before, piece] = True
                return True
        self._apart[before, piece] = False
        return False

    def table(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, .. all characters of a unit, spaces written as U+2581."""
        last, count = [""], [0]
        score, tails, fits = self.score, self._tails, self._fits
        for i in range(1, len(text) + 1):
            found, k = [i - 1], 1
            while k < i and text[i - k - 1 : i] in tails:
                k += 1
                if text[i - k : i] in score:
                    found.append(i - k)
            for at in reversed(found):
                piece = text[at:i]
                if fits(last[at], piece):
                    last.append(piece)
                    count.append(count[at] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass"))))
                    break
            else:  # only where merges don't come in order of score
                return self._by_library(text)
        return count

    def _by_library(self, text: str) -> list[int]:
        return [0, *(len(self._library.encode(text[:i].replace(_SPACE, " ")[text[0] == _SPACE :])) - (text[0] != _SPACE) for i in range(1, len(text) + 1))]

    def _fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """_fits of many pairs of numbered pieces."""
        out = self._possible[piece].copy()
        at = np.flatnonzero(out & (before != self._start))
        a, b, limit = before[at], piece[at], np.full(len(at), len(self._rank) + 1, np.int32)
        while len(at):
            joined = self._joined(a.astype(np.int64) << 20 | b)
            early = (joined >= 0) & (joined < limit)
            out[at[early]] = False
            of_a, of_b = self._rank_of[a], self._rank_of[b]
            undo = of_a > of_b
            limit = np.where(undo, of_a, of_b + 1)
            a, b = np.where(undo, self._right[a], a), np.where(undo, b, self._left[b])
            going = ~early & (undo | (of_b > 0))
            at, a, b, limit = at[going], a[going], b[going], limit[going]
        return out

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, done): the tables of units, longest first, one column each, filled for all units at once from the
        left to the right; done: false where merges don't come in order of score."""
        lengths = np.array([len(u) for u in units], np.int64)
        most, n = int(lengths[0]), len(units)
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        codes = np.zeros((most, n), np.int64)
        codes[ragged(np.zeros(n, np.int64), lengths), np.repeat(np.arange(n), lengths)] = flat
        last, count = np.full((most + 1, n), self._start, np.int32), np.zeros((most + 1, n), np.int32)
        done = np.ones(n, bool)
        for i in range(1, most + 1):
            m = int(np.searchsorted(-lengths, -i, side="right"))
            at, node, found = np.arange(m), np.zeros(m, np.int64), []
            for k in range(1, i + 1):  # pieces that end here, the longest last
                node = self._before(node << 21 | codes[i - k, at])
                alive = node >= 0
                piece = np.where(alive, self._piece[node], -1)
                if k == 1:
                    piece = np.where(piece < 0, self._unknown, piece)
                held = piece >= 0
                found.append((at[held], piece[held]))
                at, node = at[alive], node[alive].astype(np.int64)
                if not len(at):
                    break
            open_ = np.ones(m, bool)
            for k in range(len(found), 0, -1):
                at, piece = found[k - 1]
                wanted = open_[at]
                at, piece = at[wanted], piece[wanted]
                fits = self._fit(last[i - k, at], piece)
                at, piece = at[fits], piece[fits]
                code = codes[i - 1, at]
                size = np.where(piece == self._unknown, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
                last[i, at], count[i, at], open_[at] = piece, count[i - k, at] + size, False
            done[:m][open_] = False
        return count, done

    def _filled(self, spelled: list[str]) -> list[bytes | np.ndarray]:
        """The table of each unit. Units of up to _LOCKSTEP characters are filled together, longer ones one by one."""
        tables: list[bytes | np.ndarray] = [b""] * len(spelled)
        order = sorted(range(len(spelled)), key=lambda k: -len(spelled[k]))
        short = next((k for k, i in enumerate(order) if len(spelled[i]) <= _LOCKSTEP), len(order))
        for k in order[:short]:
            tables[k] = np.array(self.table(spelled[k]), np.int32)
        for start in range(short, len(order), _TOGETHER):
            part = order[start : start + _TOGETHER]
            count, done = self._together([spelled[k] for k in part])
            wide = count.shape[0]
            data = count.T.astype(np.uint8).tobytes()  # at most 4 tokens for each of _LOCKSTEP characters
            for j, k in enumerate(part):
                tables[k] = data[j * wide : j * wide + len(spelled[k]) + 1]
            for j in np.flatnonzero(~done):
                tables[part[j]] = np.array(self._by_library(spelled[part[j]]), np.int32)
        return tables

    def _add(self, fresh: list[str]) -> None:
        """fresh: short forms of units. A first unit has the space that the library puts before a text."""
        if len(self._apart) > _PAIRS:
            self._apart.clear()
        spelled = [("" if u[:1] == "\n" else _SPACE) + u.removeprefix("\x01").replace(" ", _SPACE) for u in fresh]
        tables = self._filled(spelled)
        given = [u[1:] if u[:1] == "\x01" else u for u in fresh]
        whole = self._library.encode(given, num_threads=1)
        for k, (u, ids) in enumerate(zip(fresh, whole, strict=True)):
            true = len(ids) - (u[:1] == "\n") if given[k] else 1
            if tables[k][-1] != true:
                tables[k] = np.array(self._by_library(spelled[k]), np.int32)
                if tables[k][-1] != true:
                    raise ValueError(f"units of this vocabulary don't add up: {u!r}")
        self._of.update(zip(fresh, range(len(self._of), len(self._of) + len(fresh)), strict=True))
        self._tables += tables
        self._size += sum(map(len, spelled))
        self._tokens = np.concatenate([self._tokens, [t[-1] for t in tables]]).astype(np.int64)
        self._chars = np.concatenate([self._chars, [len(s) - (u[:1] == "\x01") for u, s in zip(fresh, spelled, strict=True)]]).astype(np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, used, ends): texts in a new order of rows; the numbers of all their units; where each text's end."""
        order, units, counts = split(texts)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._of) + len(words) > _UNITS or self._size > _UNIT_CHARS:
            self._clear()
        if fresh := [w for w in words if w not in self._of]:
            self._add(fresh)
        used = np.fromiter(map(self._of.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        return order, used, np.cumsum(counts)

    def tokens(self, used: np.ndarray) -> np.ndarray:
        return self._tokens[used]

    def longest(self, used: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of a text, given by its units, that has at most so many tokens."""
        before = np.cumsum(self._tokens[used]) - self._tokens[used]
        k = int(np.searchsorted(before, budget, side="right")) - 1
        if k < 0:
            return 0
        table = self._tables[used[k]]
        lead = len(table) - 1 - int(self._chars[used[k]])  # the space before a text is none of its characters
        j = max((j for j in range(len(table)) if before[k] + table[j] <= budget), default=0)
        return int(self._chars[used[:k]].sum()) + max(0, j - lead)

    def prefixes(self, used: np.ndarray) -> list[int]:
        """The token count of every prefix of a text, from none of its characters to all."""
        out, before = [0], 0
        for k in used:
            table = self._tables[k]
            lead = len(table) - 1 - int(self._chars[k])
            out += [before + int(n) for n in table[1 + lead :]]
            before += int(table[-1])
        return out


@lru_cache(1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _each(docs: DataFrame, path: str, key: str, text: str, schema: str, rows):
    """rows(counter, texts, order, used, ends) gives the columns after the key, in that order of rows."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counter(path)
        for b in slices(batches):
            order, used, ends = held.texts(b["text"])
            keys = b["key"].take(pa.array(order))
            columns = rows(held, b["text"].take(pa.array(order)), used, ends)
            yield pa.RecordBatch.from_arrays([keys, *columns.values()], names=["key", *columns])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, f"key long, {schema}").withColumnRenamed("key", key)


def count(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fits_chars): fits_chars is the longest prefix, in code points, of at most
    limit tokens."""

    def rows(held: PrefixCounter, texts: pa.Array, used: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        total = np.concatenate([[0], np.cumsum(held.tokens(used))])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        tokens = total[ends] - total[starts]
        chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.flatnonzero(tokens > limit):
            chars[i] = held.longest(used[starts[i] : ends[i]], limit)
        n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
        return {"n_bytes": n_bytes, "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit), "fits_chars": pa.array(chars, pa.int64())}

    return _each(docs, path, key, text, "n_bytes long, n_tokens long, over_limit boolean, fits_chars long", rows)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): an array with the token count of every prefix, from 0 code points to all of them."""

    def rows(held: PrefixCounter, texts: pa.Array, used: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return {"tokens": pa.array([held.prefixes(used[a:b]) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32()))}

    return _each(docs, path, key, text, "tokens array<int>", rows)
