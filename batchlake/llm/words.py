"""Vectorised word hashing over Arrow string buffers.

One Arrow array of texts is cut into slices of a few MB; in each slice all
words are found and hashed with a handful of numpy passes over the bytes, so
the cost is some nanoseconds a byte and no Python object is made per word. A text
longer than a slice is a slice of its own, whose hashes are summed chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SLICE_DOCS = 1 << 15
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

#: Byte classes: 0 is outside of words; a word is a run of bytes of one other class.
SPACED = (np.arange(256) > 32).astype(np.uint8)
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.array([chr(c).isalnum() or c == 95 or c > 127 for c in range(256)]).astype(np.uint8)
#: The same, and runs of punctuation as words of their own.
PUNCTUATED = np.where(ALNUM == 1, 1, 2 * SPACED).astype(np.uint8)


ASCII_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a chunk has places."""
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(CHUNK + 1, base & _MASK, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _rolled(values: np.ndarray, start: np.ndarray, end: np.ndarray, add: int = 0) -> np.ndarray:
    """Sum of (values[i] + add) * base**(i - start) over each of the ascending ranges, which don't overlap.

    Running sums are held for one chunk at a time, so a very long text needs little more than its bytes.
    """
    up, down = _tables()
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), CHUNK):
            to = min(at + CHUNK, len(values))
            v = values[at:to].astype(np.uint64)
            if add:
                v += np.uint64(add)
            v *= up[: to - at]
            sums = np.empty(to - at + 1, np.uint64)
            sums[0] = 0
            np.cumsum(v, out=sums[1:])
            i, j = np.searchsorted(end, at, "right"), np.searchsorted(start, to, "left")
            s, e = np.maximum(start[i:j], at) - at, np.minimum(end[i:j], to) - at
            part = (sums[e] - sums[s]) * down[s]
            if i < j and start[i] < at:  # it began in a chunk before
                part[0] *= np.uint64(pow(_BASE, int(at - start[i]), 1 << 64))
            out[i:j] += part
    return out


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each sequence h[start:end]; the ranges are ascending and don't overlap."""
    with np.errstate(over="ignore"):
        return mix(_rolled(h, start, end) + (end - start).astype(np.uint64))


class Words(NamedTuple):
    """Words of a slice: document (from 0 in the slice), byte range in the slice, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray  # of documents in data
    data: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) with at most SLICE_DOCS rows and about SLICE_BYTES, a longer text alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + SLICE_DOCS, len(texts))
        yield at, texts.slice(at, to - at)
        at = to


def words(part: pa.Array, lower: bool | str = True, inside: np.ndarray = ALNUM) -> Words:
    """All words of a slice of texts (large_string, without nulls).

    lower="ascii" lowers ASCII letters only, so byte offsets stay those of the text.
    """
    if lower is True:
        part = pc.utf8_lower(part)
    off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    if part.buffers()[2] is None or off[-1] == off[0]:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), off - off[0], np.zeros(0, np.uint8))
    data = np.frombuffer(part.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if lower == "ascii":
        data = ASCII_LOWER[data]
    cls = inside[data]
    isw = cls != 0
    change = cls[1:] != cls[:-1]
    first, last = isw.copy(), isw.copy()
    first[1:] &= change
    last[:-1] &= change
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = isw[begins]
    last[begins[1:] - 1] = isw[begins[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        h = _rolled(data, start, end, 1) + (end - start).astype(np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    return Words(doc, start, end, mix(h), off, data)


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    w = words(pa.array([word], pa.large_string()), lower=False, inside=np.ones(256, np.uint8))
    return int(w.hash[0]) if len(w.hash) else 0


class Lookup:
    """Which of many hashes are in a set, and their place in it: a table of the upper bits settles nearly all at once."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = np.unique(members.astype(np.uint64))
        self._may = np.zeros(1 << 16, bool)
        self._may[(self.members >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of hashes that are members, their places among the sorted members)."""
        i = np.flatnonzero(self._may[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.members) or not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.members, hashes[i]), len(self.members) - 1)
        ok = self.members[place] == hashes[i]
        return i[ok], place[ok]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, sorted; of a value its upper 48 bits count. Below 2**16 docs."""
    key = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
    return at, np.diff(np.append(at, len(sorted_values)))
