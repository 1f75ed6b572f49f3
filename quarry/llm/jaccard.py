"""Similarity join of documents on word n-grams by T-occurrence search.

A document's set are its distinct n-grams of words (shorter texts: the whole
sequence as one). Two documents link when ``den * |A and B| >= num * |A or B|``.
Such sets share at least ``T = ceil(num / den * |A|)`` n-grams, whichever of the
two is A.

1. Equal sets become one class. From here on there are only distinct sets.
2. In any fixed order of the n-grams, the first ``|A| - T + l`` of A and of B
   share ``l`` of them. Those n-grams (in hash order, with ``l`` of a tenth of ``T``)
   are counted in slices by hash, each in a task of its own; sets with too few that
   come twice link with nothing. Of the remaining sets all n-grams are counted in the
   same way, and a set with more than ``|A| - T`` n-grams of its own goes no further.
   What then remains is counted once more, for an order with the rarest first. Sets
   that share one of the first ``|A| - T + 1`` in this order may link, if their sizes
   and a bound of their overlap allow it (parities of their n-grams in ``SIGNS``
   classes: each parity that differs is an n-gram that only one of them has);
   connected ones form a candidate group.
3. Each group (in blocks of ``UNIT`` sets, each pair of blocks by itself if it is
   larger) is searched by DivideSkip: for a set's ``T``, the longest inverted lists
   are set aside, the short ones are merged, and sets that occur often enough in
   them are looked up in the long ones by binary search. Sets already connected
   with the searching one are skipped: the links found span every component.
4. Components of the links give each class the smallest document id.

Counts are by 35 to 46 bits of the hash and so at least the true ones: no link is lost.
Nothing but the bits of ``possible_members`` is collected or broadcast. N-grams are
compared by 64-bit hashes.

Defined results: null or empty text has an empty set, which links with nothing
(not even with another empty one); null ids count as larger than all others, and
a component of null ids only has a null component id; repeated rows have equal
sets and so one component; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NULL_ID, free_name, order_id, parts, stored, text_bytes
from .substring import _width

#: Sets searched together; two such blocks for a pair of blocks.
UNIT = 2000
#: DivideSkip's weight of a list's length (Li, Lu and Lu 2008).
MU = 0.0085
#: Share of a set that prefixes must have in common beyond one n-gram.
EXTRA = 10
MOST_CELLS = 1 << 27
#: Bytes of a hash that count as the key; text bytes whose keys make a slice; keys sent together.
KEY_BYTES, SLICE_TEXT, SENT = 6, 32 << 20, 1 << 20
#: Classes whose parities bound an overlap.
SIGNS = 512
#: Lists of at most so many sets are compared side by side.
SHORT_LIST = 8


def gram_sets(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, joined, and their offsets."""
    docs = len(w.first) - 1
    size = np.diff(w.first)
    g = W.runs_hash(w.hash, n)
    at = np.flatnonzero(w.doc[n - 1:] == w.doc[:len(w.doc) - n + 1]) if len(w.doc) >= n else np.zeros(0, np.int64)
    codes, owner = [g[at]], [w.doc[at]]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            codes.append(W.runs_hash(w.hash, k)[w.first[short]])
            owner.append(short)
    code, doc = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return code[new], np.searchsorted(doc[new], np.arange(docs + 1))


def least_overlap(size, num: int, den: int):
    return -(-size * num // den)


def _need(size, num: int, den: int):
    """Shared n-grams that the prefixes of two linked sets have at least."""
    return np.maximum(1, (size * num // den) // EXTRA)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(values.view(np.int64)))


def _cut_keys(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The low bytes of the values, ``sizes[i]`` of them in row ``i``."""
    at = np.concatenate([[0], np.cumsum(sizes * KEY_BYTES)]).astype(np.int64)
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists or of ``_cut_keys``, joined, and how many each row has."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())
    data, at = W.utf8(column)
    wide = np.zeros(((at[-1] - at[0]) // KEY_BYTES, 8), dtype=np.uint8)
    wide[:, :KEY_BYTES] = data[at[0]:at[-1]].reshape(-1, KEY_BYTES)
    return wide.view("<u8").reshape(-1), np.diff(at) // KEY_BYTES


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``start[i] .. start[i] + size[i]`` of all ``i``, joined."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def class_rows(docs: DataFrame, n: int, num: int, den: int, prefixes: bool) -> DataFrame:
    """``id, k, h, s, n, prefix`` per row of ``docs(id, k, h, t)``; ``s`` names the set.
    ``prefix`` has keys of its first n-grams, none without ``prefixes``."""
    def classes(batches):
        for b in batches:
            data, offsets = W.utf8(b.column(3))
            for lo, hi in W.groups(offsets):
                code, at = gram_sets(W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.FOLDED), n)
                size = np.diff(at)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(code), dtype=np.uint64)])
                name = W.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64)
                front = np.minimum(size, size - least_overlap(size, num, den) + np.maximum(1, size // EXTRA))
                front = front if prefixes else front * 0
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(name), pa.array(size),
                     _cut_keys(code[_slices(at[:-1], front)], front)], ["id", "k", "h", "s", "n", "prefix"])

    return docs.mapInArrow(classes, "id long, k long, h long, s long, n long, prefix binary")


def slices_for(nbytes: int) -> int:
    """A power of two: slices of the keys for texts of so many bytes."""
    return 1 << int(np.clip(math.ceil(math.log2(max(nbytes, 1) / SLICE_TEXT)), 3, 14))


def counted(rows: DataFrame, slices: int, shuffle: int, whole: bool, then, schema: str) -> DataFrame:
    """What ``then`` makes of the rows (longs, the last column has their keys) and of how
    often their keys come in all rows. It gets the longs, the number of keys of each row
    and, if ``whole``, the keys and for each the binary logarithm of its count, rounded
    up; otherwise none and for each row how many of its keys come twice or more.

    Keys go to the task of their slice, what it found comes back, both in large pieces.
    Rows must come in the same order when a task is run again.
    """
    def send(batches):
        part, piece, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pieces():
            keys, sizes = (np.concatenate(x) for x in zip(*(h[1] for h in held)))
            longs = np.concatenate([h[0] for h in held], axis=1)
            unit, place = (part << 32) + piece, (keys & np.uint64(slices - 1)).astype(np.uint16)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(slices + 1))
            short = (keys[order] >> np.uint64(16)).astype(np.uint32)
            row = np.repeat(np.arange(len(sizes)), sizes)[order]
            some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            bodies, each = [np.vstack([longs, sizes]).astype(np.int64).tobytes()], [keys.tobytes() if whole else b""]
            for k in some:
                bodies.append(short[cut[k]:cut[k + 1]].tobytes())
                each.append(b"" if whole else _steps(row[cut[k]:cut[k + 1]]))
            return pa.RecordBatch.from_arrays(
                [pa.array([unit % slices, *some], pa.int32()), pa.array([unit] * (len(some) + 1), pa.int64()),
                 pa.array([len(some)] + [-1] * len(some), pa.int32()), pa.array([len(sizes)] * (len(some) + 1), pa.int32()),
                 pa.array(bodies, pa.binary()), pa.array(each, pa.binary())], ["slice", "unit", "pieces", "rows", "body", "each"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = _keys(b.column(b.num_columns - 1))
            held.append((np.stack([b.column(c).to_numpy() for c in range(b.num_columns - 1)]), keys))
            size += len(keys[0])
            if size >= SENT:
                yield pieces()
                piece, held, size = piece + 1, [], 0
        if held:
            yield pieces()

    def tally(batches):
        for got in _runs(batches, 1):
            keys = [np.frombuffer(r["body"], np.uint32) for r in got if r["pieces"] < 0]
            if keys:
                _, place, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                found = (np.ceil(np.log2(count)).astype(np.uint8) if whole else count > 1)[place]
            at = 0
            for r in got:
                body, each = r["body"], r["each"]
                if r["pieces"] < 0:
                    mine = found[at:at + len(body) // 4]
                    at += len(mine)
                    body, each = mine.tobytes() if whole else _steps(_stepped(each)[mine]), b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((r["slice"] if r["pieces"] < 0 else -1, pa.int32()), (r["unit"], pa.int64()), (r["pieces"], pa.int32()),
                                                   (r["rows"], pa.int32()), (body, pa.binary()), (each, pa.binary()))],
                    ["slice", "unit", "pieces", "rows", "body", "each"])

    def gather(batches):
        for got in _runs(batches, 2):
            first, rest = got[0], got[1:]
            if first["slice"] >= 0 or first["pieces"] != len(rest):
                raise RuntimeError("pieces of counted keys are missing")
            longs = np.frombuffer(first["body"], np.int64).reshape(-1, first["rows"])
            if whole:
                keys = np.frombuffer(first["each"], np.uint64)
                order = np.argsort((keys & np.uint64(slices - 1)).astype(np.uint16), kind="stable")
                found = np.zeros(len(keys), dtype=np.uint8)
                found[order] = np.frombuffer(b"".join(r["body"] for r in rest), np.uint8)
            else:
                keys, found = None, np.zeros(first["rows"], dtype=np.int64)
                for r in rest:
                    found += np.bincount(_stepped(r["body"]), minlength=len(found))
            yield then(longs[:-1], longs[-1], keys, found)

    form = "slice int, unit long, pieces int, rows int, body binary, each binary"
    sent = rows.mapInArrow(send, form).repartition(slices, "slice").sortWithinPartitions("slice", "unit")
    back = sent.mapInArrow(tally, form).repartition(shuffle, "unit").sortWithinPartitions("unit", "slice")
    return back.mapInArrow(gather, schema)


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as steps of one byte, if that is enough, or four."""
    steps = np.diff(places, prepend=0)
    return b"\1" + steps.astype(np.uint8).tobytes() if steps.max(initial=0) < 256 else b"\4" + steps.astype("<u4").tobytes()


def _stepped(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(body, np.uint8 if body[0] == 1 else "<u4", offset=1), dtype=np.int64)


def _runs(batches, key: int):
    """Rows of sorted batches as dicts, those of one slice (``key`` 1) or unit (2) together."""
    name, held = ("slice", "unit")[key - 1], []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][name] != r[name]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def possible_members(keys: DataFrame):
    """A boolean column function of ``(k, h)``: false only for pairs that ``keys(k, h)``
    lacks. A bit array of 16 bits a key, at most ``MOST_CELLS`` bits (16 MB); when it
    fills up, more rows go on to the exact join behind it."""
    log_width = _width(8 * keys.count(), MOST_CELLS)
    cell = F.expr(f"shiftrightunsigned(xxhash64(k, h), {64 - log_width})")
    words = keys.select(cell.alias("c")).groupBy(F.expr("shiftright(c, 15)").alias("at")).agg(
        F.bitmap_construct_agg(F.expr("c & 32767")).alias("bits"))
    bits = np.zeros((max(1, (1 << log_width) >> 15), 4096), dtype=np.uint8)
    for r in words.collect():
        bits[r["at"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    @F.pandas_udf("boolean")
    def held(cells: pd.Series) -> pd.Series:
        c = cells.to_numpy()
        return pd.Series((shared.value[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1)

    return lambda k, h: held(F.shiftrightunsigned(F.xxhash64(k, h), 64 - log_width))


def named_classes(rows: DataFrame, n: int, num: int, den: int, slices: int, shuffle: int) -> DataFrame:
    """``k, h, s, n, near`` of each distinct set: its first row, and whether enough of its
    prefix comes in other prefixes."""
    def judged(longs, sizes, _, found):
        k, h, s, size = longs
        return pa.RecordBatch.from_arrays([*map(pa.array, (k, h, s, size, found >= _need(size, num, den)))], ["k", "h", "s", "n", "near"])

    first = class_rows(rows, n, num, den, True).filter("n > 0").groupBy("s", "n").agg(
        F.min(F.struct("k", "h")).alias("r"), F.any_value("prefix").alias("prefix")).sortWithinPartitions("s")
    return counted(first.select("r.k", "r.h", "s", "n", "prefix"), slices, shuffle, False, judged,
                   "k long, h long, s long, n long, near boolean")


def _signs(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities of each set's n-grams by class, ``SIGNS`` bits a row."""
    out = np.zeros((len(sizes), SIGNS // 64), dtype=np.uint64)
    place = (grams >> np.uint64(48)).astype(np.int64) % SIGNS
    np.bitwise_xor.at(out.reshape(-1), np.repeat(np.arange(len(sizes)), sizes) * (SIGNS // 64) + (place >> 6),
                      np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def candidate_sets(docs: DataFrame, kept: DataFrame, n: int, num: int, den: int, slices: int, shuffle: int) -> DataFrame:
    """``s, n, grams, front, signs``: sets that may link, and the n-grams that they may
    share among their first in the common order."""
    def whole(batches):
        for b in batches:
            data, offsets = W.utf8(b.column(1))
            for lo, hi in W.groups(offsets):
                code, at = gram_sets(W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.FOLDED), n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), _lists(code, np.diff(at))], ["s", "grams"])

    def enough(longs, sizes, _, found):
        return pa.RecordBatch.from_arrays([pa.array(longs[0][found >= least_overlap(sizes, num, den)])], ["s"])

    def fronts(longs, sizes, grams, level):
        row = np.repeat(np.arange(len(sizes)), sizes)
        ranked = np.lexsort((grams, level, row))
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = place < np.repeat(sizes - least_overlap(sizes, num, den) + 1, sizes)
        pick = ranked[first & (level[ranked] > 0)]
        front = np.bincount(row[pick], minlength=len(sizes))
        signs = pa.array([x.tobytes() for x in _signs(grams, sizes)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(longs[0]), pa.array(sizes), _lists(grams, sizes), _lists(grams[pick], front), signs],
                                          ["s", "n", "grams", "front", "signs"]).filter(pa.array(front > 0))

    texts = docs.filter(possible_members(kept.select("k", "h"))("k", "h")).join(kept, ["k", "h"]).dropDuplicates(["k", "h"])
    sets = stored(texts.select("s", "t").mapInArrow(whole, "s long, grams array<long>"))
    likely = stored(counted(sets, slices, shuffle, False, enough, "s long"))
    held = possible_members(likely.select(F.col("s").alias("k"), F.lit(0).alias("h")))
    return counted(sets.filter(held(F.col("s"), F.lit(0))), slices, shuffle, True, fronts,
                   "s long, n long, grams array<long>, front array<long>, signs binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) of ``edges(a, b)``, by
    alternating large-star and small-star steps; each round is stored."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        facts = tuple(edges.agg(F.count("*"), F.sum(F.expr("xxhash64(a, b) % 1000000007"))).first())
        if facts == seen or not facts[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = facts
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


class _Index:
    """Inverted lists of some sets: n-gram -> ascending places of sets."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        joined = np.concatenate([*sets, np.zeros(0, np.int64)])
        order = np.argsort(joined, kind="stable")
        self.gram, first = np.unique(joined[order], return_index=True)
        self.bound, self.owner = np.append(first, len(joined)), owner[order]

    def lists(self, grams: np.ndarray) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.gram, grams), max(len(self.gram) - 1, 0))
        at = at[self.gram[at] == grams] if len(self.gram) else at[:0]
        return [self.owner[self.bound[i]:self.bound[i + 1]] for i in at.tolist()]


def divide_skip(lists: list[np.ndarray], t: int):
    """Places in at least ``t`` of the lists can only be among the first result: places
    often enough in the short lists (with their counts, most frequent first). The
    second result are the long lists, left to be probed."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    aside = min(int(t / (MU * math.log2(max(len(lists[-1]), 2)) + 1)), t - 1)
    short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
    place, count = np.unique(np.concatenate(short), return_counts=True)
    often = count >= t - aside
    place, count = place[often], count[often]
    order = np.argsort(-count, kind="stable")
    return place[order], count[order], long


def probe(place: np.ndarray, count: np.ndarray, long: list[np.ndarray]) -> np.ndarray:
    """Overlap of each place: its count plus the long lists that hold it."""
    out = count.copy()
    for x in long:
        at = np.minimum(np.searchsorted(x, place), len(x) - 1)
        out += x[at] == place
    return out


def spanning_links(sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all components of the pairs between the places ``left`` and
    the others (or among all places, if all are left)."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    label = np.arange(len(sets))
    inside = bool(left.all())
    held = np.arange(len(sets)) if inside else np.flatnonzero(left)
    index = _Index([sets[i] for i in held])
    links = []
    for q in range(len(sets)):
        if not inside and left[q]:
            continue
        place, count, long = divide_skip(index.lists(sets[q]), int(least_overlap(size[q], num, den)))
        other = held[place]
        fits = (size[other] * den >= size[q] * num) & (size[other] * num <= size[q] * den)
        if inside:
            fits &= other < q
        place, count, other = place[fits], count[fits], other[fits]
        step = 4
        while True:
            apart = label[other] != label[q]
            place, count, other = place[apart], count[apart], other[apart]
            if not len(place):
                break
            overlap = probe(place[:step], count[:step], long)
            linked = overlap * den >= num * (size[other[:step]] + size[q] - overlap)
            for o in other[:step][linked].tolist():
                if label[o] != label[q]:
                    links.append((q, o))
                    label[label == label[o]] = label[q]
            place, count, other = place[step:], count[step:], other[step:]
            step *= 4
    return links


def may_link(n, other, signs, others, num: int, den: int) -> np.ndarray:
    """False only for sets of ``n`` and ``other`` n-grams that can't link, by their sizes
    or because their parities differ too often."""
    both = n + other
    apart = np.bitwise_count(signs ^ others).sum(axis=-1, dtype=np.int64)
    return (np.minimum(n, other) * den >= np.maximum(n, other) * num) & ((den + num) * (both - apart) >= 2 * num * both)


def connected(n: np.ndarray, signs: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Some of the pairs of places that may link; they span every component of all of them."""
    left, pairs = np.arange(len(n)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = may_link(n[x], n[left], signs[x], signs[left], num, den)
            found, left = left[near], left[~near]
            todo += found.tolist()
            pairs += [(x, y) for y in found.tolist()]
    return pairs


def candidate_pairs(candidates: DataFrame, num: int, den: int, shuffle: int) -> DataFrame:
    """``a, b``: pairs of sets that share an n-gram of both fronts and may link; enough to
    connect each group. A list of more than ``UNIT`` sets goes in pairs of blocks."""
    fronts = candidates.select(F.explode("front").alias("g"), "s", "n", "signs")
    often = fronts.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > UNIT).select(
        "g", F.ceil(F.col("c") / UNIT).cast("int").alias("blocks"))
    listed = fronts.join(F.broadcast(often), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("s", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    listed = listed.withColumn("own", own).withColumn("other", other).select(
        "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "s", "n", "signs")
    units = listed.repartition(shuffle, "g", "i", "j").sortWithinPartitions("g", "i", "j", "s")

    def compared(t):
        s, n = t.column(3).to_numpy(), t.column(4).to_numpy()
        signs = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(len(s), -1)
        new = _begins(t)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        unit = np.cumsum(new) - 1
        short = (size <= SHORT_LIST)[unit]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, SHORT_LIST):
            x = np.flatnonzero((unit[k:] == unit[:-k]) & short[k:])
            x = x[may_link(n[x], n[x + k], signs[x], signs[x + k], num, den)]
            a.append(s[x])
            b.append(s[x + k])
        for at, m in zip(first[size > SHORT_LIST].tolist(), size[size > SHORT_LIST].tolist()):
            pairs = connected(n[at:at + m], signs[at:at + m], num, den)
            if pairs:
                x, y = np.array(pairs).T
                a.append(s[at + x])
                b.append(s[at + y])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), dtype=bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    def pairs(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_batches([*held, b])
            whole = int(np.flatnonzero(_begins(t))[-1])  # the last list may go on
            if whole:
                yield compared(t.slice(0, whole))
            held = [t.slice(whole)]
        if held:
            yield compared(held[0])

    return units.mapInArrow(pairs, "a long, b long")


def _begins(t) -> np.ndarray:
    """Where a list ``g, i, j`` begins."""
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (t.column(c).to_numpy() for c in range(3))])
    return new


def class_links(candidates: DataFrame, num: int, den: int, shuffle: int) -> DataFrame:
    """``a, b``: links between classes that span every component."""
    group = components(candidate_pairs(candidates, num, den, shuffle))
    roots = group.select(F.col("root").alias("node"), "root").distinct()
    group = group.unionByName(roots)
    blocks = group.groupBy("root").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("blocks"))
    group = group.join(blocks, "root").withColumnRenamed("node", "s")
    grouped = possible_members(group.select(F.col("s").alias("k"), F.lit(0).alias("h")))
    placed = candidates.filter(grouped(F.col("s"), F.lit(0))).select("s", "grams").join(group, "s")
    own = F.pmod(F.xxhash64("s", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    pairs = placed.withColumn("own", own).withColumn("other", other).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", "grams")
    units = pairs.repartition(shuffle, "root", "i", "j").sortWithinPartitions("root", "i", "j", "s")

    def search(batches):
        key, names, left, sets = None, [], [], []

        def links():
            found = spanning_links(sets, np.array(left), num, den) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()),
                                               pa.array([names[y] for _, y in found], pa.int64())], ["a", "b"])

        for b in batches:
            root, i, j, own, s = (b.column(c).to_pylist() for c in range(5))
            for r in range(b.num_rows):
                if (root[r], i[r], j[r]) != key:
                    if sets:
                        yield links()
                    key, names, left, sets = (root[r], i[r], j[r]), [], [], []
                names.append(s[r])
                left.append(own[r] == i[r])
                sets.append(b.column(5)[r].values.to_numpy())
        if sets:
            yield links()

    return units.mapInArrow(search, "a long, b long")


def linked_classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, k, h, n, root, component`` per row of ``docs``: ``(k, h)`` names a row up to
    equal ids and texts, ``root`` its component (null without words), and ``component``
    is the smallest id (as ``k``) in it."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), order_id(id_col).alias("k"),
                       F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    nbytes = text_bytes(rows, "t")
    shuffle, slices = parts(docs.sparkSession, nbytes, 128 << 20), slices_for(nbytes)
    # The prefixes move once, for the classes; naming the sets again is cheap.
    found = class_rows(rows, n, num, den, False).drop("prefix")
    classes = stored(named_classes(rows, n, num, den, slices, shuffle))
    candidates = stored(candidate_sets(rows.select("k", "h", "t"), classes.filter("near").select("k", "h", "s"), n, num, den, slices, shuffle))
    links = class_links(candidates, num, den, shuffle)
    joined = components(links)
    least = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "s")
    smallest = least.join(classes.select("s", "k"), "s")
    per_root = smallest.groupBy("root").agg(F.min("k").alias("component"))
    per_class = classes.select("s", F.col("k").alias("own")).join(
        least.join(per_root, "root").select("s", "root", "component"), "s", "left").select(
        "s", F.coalesce("root", "s").alias("root"), F.coalesce("component", "own").alias("component"))
    return found.select("id", "k", "h", "s", "n").join(per_class, "s", "left").select(
        "id", "k", "h", "n", "root", F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("k")).alias("component"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one of smallest id, then text hash.
    Texts without words all stay."""
    rows = stored(linked_classes(docs, n, num, den, id_col, text_col).filter("n > 0").select("k", "h", "root"))
    first = stored(rows.groupBy("root").agg(F.min(F.struct("k", "h")).alias("r")).select("r.k", "r.h"))
    once = rows.groupBy("k", "h").agg(F.count("*").alias("c"))
    alone = first.join(once.filter("c = 1"), ["k", "h"]).select("k", "h")
    doubtful = once.select("k", "h").join(alone, ["k", "h"], "left_anti")
    k, h = free_name(docs, "order"), free_name(docs, "texthash")
    named = docs.withColumn(k, order_id(id_col)).withColumn(h, F.xxhash64(text_col))
    has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # Most texts stay where they are: only rows that may be repeated first ones move.
    doubt = possible_members(doubtful)(k, h)
    copies = named.filter(has_words & doubt & possible_members(first)(k, h)).join(
        first.withColumnsRenamed({"k": k, "h": h}), [k, h], "left_semi").dropDuplicates([k, h])
    return named.filter(~(has_words & doubt)).unionByName(copies).select(*docs.columns)


def op6_jaccard(spark, sf_dir):
    from .common import load
    rows = linked_classes(load(spark, sf_dir, "documents"), 4, 85, 100)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.expr(f"nullif(component, {NULL_ID}L)").alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 3], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""
