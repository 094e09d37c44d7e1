"""Units: the pieces of a text that a byte-level BPE never merges across.

A unit starts at a space or line feed that follows a character which is surely not white space (nor U+2581, which stands for a space in some vocabularies), so the
pre-tokenizer's pattern always has a boundary there and each unit can be encoded alone. Units are kept in a short
form that Arrow can split out at C++ speed: "\\x01" + unit for the first one of a text, else the unit itself when it
starts with a line feed, and the unit without its leading space otherwise.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: Every character that some definition counts as white space, control separators and zero-width ones included.
DOUBTFUL = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{2060}\\x{2581}\\x{3000}\\x{feff}"
#: Texts in which white space isn't only single spaces and line feeds between other characters.
_IRREGULAR = f"[{DOUBTFUL}][{DOUBTFUL}]|^[{DOUBTFUL}]|[{DOUBTFUL}]$|[\\t\\f\\r\\x01{DOUBTFUL[2:]}]"
_CUT = re.compile("(?<=[^" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", DOUBTFUL) + "])(?=[ \\n])")
#: Fixed value: the pre-tokenizer's published pattern for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"


def _short(unit: str) -> str:
    return unit if unit[0] == "\n" else unit[1:] if unit[0] == " " and unit[1:2] not in ("\n", "\x01") else "\x01" + unit


def spelled(short: str) -> str:
    """The unit that a short form stands for."""
    return short[1:] if short[:1] == "\x01" else short if short[:1] == "\n" else " " + short


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(order, units, counts): texts in a new order of rows, all their units in short form, and how many each text has.

    A null or empty text has no unit. Concatenating a text's spelled units gives the text.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.match_substring_regex(texts, _IRREGULAR), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    plain = pc.binary_join_element_wise("\x01", pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), "")
    lists = pc.split_pattern(plain, " ")
    counts = [pc.list_value_length(lists).to_numpy(zero_copy_only=False)]
    rest = [["\x01" + u if k == 0 else _short(u) for k, u in enumerate(_CUT.split(t))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    counts.append(np.array([len(x) for x in rest], dtype=np.int64))
    units = pa.concat_arrays([lists.flatten(), pa.array([u for x in rest for u in x], lists.type.value_type)])
    return order, units, np.concatenate(counts).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0].., starts[1].., each run as long as lengths says, in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 2**31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return at


class ByteBpe:
    """A byte-level BPE vocabulary file: ids of many units at once, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shifted = [b for b in range(256) if b not in set(printable)]
        of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(shifted)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self._plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe
        self._special = set(added)
        self.pieces: list[bytes] = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for x, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.pieces[i] = x
        self._lengths = np.array([len(x) for x in self.pieces], dtype=np.int64)

    def _one(self, text: str) -> list[int]:
        return self._plain.encode(text, self._special)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of spelled units. Those which start with a space and end in none are encoded as one text,
        cut again where their bytes end; the others one by one."""
        counts = np.zeros(len(units), dtype=np.int64)
        joined = [k for k, u in enumerate(units) if u[0] == " " and not u[-1].isspace() and u[-1] > " " and u[-1] not in "\u180e\u200b\ufeff" and SPECIAL not in u]
        ids = np.array(self._plain.encode_ordinary("".join([units[k] for k in joined])), dtype=np.uint32)
        ends = np.cumsum([len(units[k].encode()) for k in joined])
        upto = np.searchsorted(np.cumsum(self._lengths[ids]), ends, side="right") if joined else np.zeros(0, np.int64)
        counts[joined] = np.diff(upto, prepend=0)
        if len(joined) == len(units):
            return ids, counts
        taken = set(joined)
        single = {k: self._one(u) for k, u in enumerate(units) if k not in taken}
        for k, x in single.items():
            counts[k] = len(x)
        out, at = np.empty(int(counts.sum()), dtype=np.uint32), np.cumsum(counts) - counts
        out[ragged(at[joined], counts[joined])] = ids
        for k, x in single.items():
            out[at[k] : at[k] + len(x)] = x
        return out, counts


class Encoder:
    """Whole texts to ids, block by block. Units met before are looked up; the table of them is emptied when it has
    MOST, so a task's memory doesn't grow with what it reads."""

    MOST = 400_000

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self._clear()

    def _clear(self) -> None:
        self._of: dict[str, int] = {}
        self._ids, self._counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, counts): texts in a new order of rows, all their ids, and how many each text has."""
        order, units, counts = split(texts)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._of) + len(words) > self.MOST:
            self._clear()
        fresh = [w for w in words if w not in self._of]
        if fresh:
            self._of.update(zip(fresh, range(len(self._of), len(self._of) + len(fresh)), strict=True))
            ids, n = self.bpe.encode([spelled(w) for w in fresh])
            self._ids, self._counts = np.concatenate([self._ids, ids]), np.concatenate([self._counts, n])
        at = np.cumsum(self._counts) - self._counts
        used = np.array([self._of[w] for w in words], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self._counts[used]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.concatenate([[0], np.cumsum(counts)])]
        return order, self._ids[ragged(at[used], n)], np.diff(ends)
