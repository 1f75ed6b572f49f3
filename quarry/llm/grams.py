"""Byte n-grams of words, counted in arrays.

Text is lower-cased beforehand; every byte that is neither a-z nor above 0x7F
becomes a blank. An n-gram of 2 bytes or more may begin or end with a blank (a
word's boundary), but has none inside. It is packed into a UINT32, first byte
lowest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bytes counted at a time, and counts held before they are sent on.
PIECE, HELD = 1 << 20, 1 << 21

FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


def _piece(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Packed grams of ``b`` (with blanks at both ends)."""
    wide, blank = b.astype(np.uint32), b == 0x20
    out = []
    for n in sizes:
        m = len(b) - n + 1
        if m <= 0:
            continue
        code, ok = wide[:m].copy(), ~blank[:m] if n == 1 else ~(blank[:m] & blank[1:m + 1])
        for k in range(1, n):
            code |= wide[k:k + m] << np.uint32(8 * k)
            if 0 < k < n - 1:
                ok = ok & ~blank[k:k + m]
        out.append(code[ok])
    return out


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(codes, return_inverse=True)
    return unique, np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)


def grams(text: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the bytes ``text``, ascending, and their counts."""
    b = np.full(len(text) + 2, 0x20, dtype=np.uint8)
    b[1:-1] = FOLD[text]
    parts = []
    for at in range(0, len(b), PIECE):
        for n in sizes:  # a gram belongs to the piece that it begins in
            parts += [np.unique(g, return_counts=True) for g in _piece(b[at:at + PIECE + n - 1], (n,))]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    if len(b) > PIECE:
        return summed(codes, counts)
    order = np.argsort(codes, kind="stable")  # sizes share no code
    return codes[order], counts[order]


def count_grams(df: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``key, code, n`` over all rows of ``df(key string, text)`` (text lower-cased)."""
    def count(batches):
        held: dict[str, list] = {}
        size = 0
        for b in batches:
            keys = b.column(0).to_pylist()
            data, offsets = W.utf8(b.column(1))
            for key in dict.fromkeys(keys):
                mine = [data[offsets[d]:offsets[d + 1]] for d, k in enumerate(keys) if k == key]
                gap = np.full(1, 0x20, dtype=np.uint8)
                got = grams(np.concatenate([x for m in mine for x in (m, gap)]), sizes)
                held.setdefault(key, []).append(got)
                size += len(got[0])
            if size >= HELD:
                held = {k: [summed(*map(np.concatenate, zip(*v)))] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size >= HELD // 2:
                    yield from _sent(held)
                    held, size = {}, 0
        yield from _sent(held)

    return df.mapInArrow(count, "key string, code long, n long").groupBy("key", "code").agg(F.sum("n").alias("n"))


def _sent(held: dict):
    for key, parts in held.items():
        codes, counts = summed(*map(np.concatenate, zip(*parts)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
            ["key", "code", "n"])
