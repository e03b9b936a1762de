"""Words of whole Arrow batches, found and hashed with numpy over the text buffer.

A batch of texts is one run of UTF-8 bytes.  Word borders come from a 256-entry table of word
bytes, and a word's 64-bit hash is a difference of prefix sums of ``table[byte] * BASE**place``,
so no Python object is made per word.  ``spans`` cuts a batch in runs of a few MB, which keeps
the arrays small however long the batch or a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


BYTE_HASH = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n, grown by doubling."""
    have = _POWERS.get("up", np.ones(1, np.uint64)), _POWERS.get("down", np.ones(1, np.uint64))
    while len(have[0]) < n:
        k = len(have[0])
        have = tuple(np.concatenate([x, x * np.uint64(pow(b, k, 1 << 64))])
                     for x, b in zip(have, (BASE, INVERSE), strict=True))
        _POWERS["up"], _POWERS["down"] = have
    return have[0][:n], have[1][:n]


def byte_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


# The two word classes of the contracts: letters, digits and all non-ASCII; anything but white space.
ALNUM = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
NON_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of consecutive texts: bounds in ``data`` and the first word of each text."""

    data: np.ndarray          # lower-cased bytes of the run
    start: np.ndarray         # first byte of each word
    end: np.ndarray           # byte behind each word
    first: np.ndarray         # len(texts) + 1 word offsets
    rows: slice               # rows of the batch

    def hashes(self) -> np.ndarray:
        up, down = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_HASH[self.data] * up[:-1], out=total[1:])
        return _mix((total[self.end] - total[self.start]) * down[self.start])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def spans(column: pa.Array, word_bytes: np.ndarray, limit: int = RUN_BYTES) -> Iterator[Words]:
    data, offsets = text_buffers(column)
    for i, j in runs(offsets, limit):
        cut = offsets[i:j + 1] - offsets[i]
        part = LOWER[data[offsets[i]:offsets[j]]]
        inside = word_bytes[part]
        # a border stands where the class changes, and between two texts
        change = np.zeros(len(part) + 1, bool)
        if len(part):
            change[0] = inside[0]
            change[-1] = inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
        starts = change[:-1] & inside
        ends = change.copy()
        ends[:-1] &= ~inside
        ends[0] = False
        inner = cut[1:-1]
        inner = inner[(inner > 0) & (inner < len(part))]
        if len(inner):
            both = inner[inside[inner] & inside[inner - 1]]
            starts[both] = True
            ends[both] = True
        start = np.flatnonzero(starts)
        yield Words(part, start, np.flatnonzero(ends), np.searchsorted(start, cut), slice(i, j))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (crossing texts; the caller cuts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + words[k:k + n]
    return _mix(out)


def shingle_sets(found: Words, size: int, hashes: np.ndarray | None = None) -> list[np.ndarray]:
    """Per text the sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    hashes = found.hashes() if hashes is None else hashes
    shingles = shingle_hashes(hashes, size)
    sets = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(distinct(shingles[a:b - size + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = _mix(short * np.uint64(BASE) + h)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span of ``data``."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * up[:-1], out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices ``pool[start:start+count]`` one behind the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - count), count) + np.arange(total)]


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
