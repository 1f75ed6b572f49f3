"""Words of an Arrow text column as flat numpy arrays.

A word is a maximal run of bytes of one class, so every pattern used here (all
of them are classes of ASCII characters or their complements) gives the same
words on UTF-8 bytes as on characters. Each word gets a 64-bit hash: a
polynomial over random byte values, taken from one running sum over the whole
buffer, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes taken at a time: bounds the working arrays, whatever the length of a text.
PIECE = 1 << 19
#: Text bytes of documents taken together in one vectorised step.
GROUP_BYTES = 1 << 20

_U = np.uint64
_FULL = 1 << 64


def _class(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: the same as lower-casing A-Z
#: first and taking ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _class([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Words(NamedTuple):
    """``doc``/``start``/``end``/``hash`` per word; ``first[d]`` is the first word of
    text ``d`` and ``first[-1]`` the number of words."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (breaks the linearity of the polynomial)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x9E3779B97F4A7C15)
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, _FULL)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0xD6E8FEB86659FD93)
_WORDS = _Powers(0xA0761D6478BD642F)


def byte_values(seed: int, fold: bool) -> np.ndarray:
    """A random value per byte; with ``fold`` A-Z share those of a-z."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


PLAIN, FOLDED = byte_values(1, False), byte_values(1, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES, most: int = 50_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``limit`` bytes together (one text at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + most, n)
        yield at, to
        at = to


def _cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, at: int, end: int) -> int:
    """Where the piece starting at ``at`` ends: not inside a word."""
    to = at + PIECE
    if to >= end:
        return end
    edge = int(offsets[np.searchsorted(offsets, to, side="left")])
    while to < edge:
        step = min(to + 65536, edge)
        gap = ~table[data[to:step]]
        if gap.any():
            return to + int(np.argmax(gap))
        to = step
    return edge


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, values: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d + 1]]``."""
    starts, ends, hashes = [], [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = _cut(data, offsets, table, at, end)
        seg = data[at:to]
        word = table[seg]
        begins = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, to)] - at
        open_ = word.copy()
        open_[1:] &= ~word[:-1]
        open_[begins] = word[begins]
        close = word.copy()
        close[:-1] &= ~word[1:]
        inner = begins[begins > 0] - 1
        close[inner] = word[inner]
        s, e = np.flatnonzero(open_), np.flatnonzero(close) + 1
        up, down = _BYTES.to(len(seg) + 1)
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(values[seg] * up[:-1], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        zero = np.zeros(0, dtype=np.int64)
        return Words(zero, zero, zero, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    doc = np.searchsorted(offsets, s, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(doc, s, e, h, first)


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries of ``h`` (``len(h) - k + 1`` values)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n - k + 1])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive entries, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out
