"""SentencePiece encoding with N-best segmentations, and decoding.

A text is read with one space in front. Pieces contain a space (``U+2581``) only
at their beginning, so the lattice of a text falls apart into units: spaces, then
characters up to the next space. A path's score is the sum of its pieces' scores;
a character without a piece is spelled in byte pieces, at a cost below all pieces.

* Every distinct unit of a batch gets its best and second best score by forward
  Viterbi, for all units of a length at once. A segmenter keeps the units of its
  last batches (``KEPT_UNITS``): what comes again isn't segmented again.
* The N best segmentations of a text differ from the best one only in the
  ``N - 1`` units with the smallest loss for their second best: a change elsewhere
  costs at least as much as each of these alone. On the lattice of those units, an
  A-star search goes backwards from the end; the forward Viterbi scores are the
  exact rest costs, so paths come out in order of their score. Each path of those
  units is put back among the best ids of the other units.

Ties go to the path with the longer last piece; among equal hypotheses the search
follows the one nearest to the start, so that runs of one character, which have
very many equal paths, cost no more than others. Decoding joins pieces and bytes;
it gives back every text.

Defined results: null and empty texts have no pieces, score 0 and one
segmentation; repeated rows get equal results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a space mark of the text itself: a character that no piece has.
HIDDEN = "\uffff"
#: Units up to this many characters are segmented together with their equals in length.
TOGETHER = 40
#: Characters of the texts whose units are segmented together.
GROUP_CHARS = 1 << 20
#: With more units than these, a segmenter forgets all of them before the next batch.
KEPT_UNITS = 1 << 18
#: Lattices of short units that a segmenter keeps.
KEPT_LATTICES = 1 << 12
#: Bits of a hash that tell most strings which are no piece.
_SIEVE = 18
NONE = -1e18
_UNITS = re.compile(r" *[^ ]+| +")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with scores; sorted hashes for lookups in arrays."""

    def __init__(self, proto: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=proto)
        usual = [i for i in range(p.get_piece_size())
                 if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.id = {p.id_to_piece(i): i for i in usual}
        # Runs of spaces have no rank of their own (-1e9): they come after all others.
        last = min(s for i in usual if (s := p.get_score(i)) > -1e8) - 1
        self.score = {i: float(max(p.get_score(i), last)) for i in usual}
        self.bytes = {b: p.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.spell = min(self.score.values()) - 10
        self.longest = max(map(len, self.id))
        self.chars = {i: len(piece) for piece, i in self.id.items()}
        self.raw = [b""] * p.get_piece_size()
        for piece, i in self.id.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        by_length: dict[int, list[str]] = {}
        for piece in self.id:
            by_length.setdefault(len(piece), []).append(piece)
        self.table, self.sieve = {}, {}
        for n, pieces in by_length.items():
            chars = np.array([[ord(c) for c in x] for x in pieces], dtype=np.uint64)
            h = chars[:, 0]
            for k in range(1, n):
                h = h * _BASE + chars[:, k]
            order = np.argsort(h)
            ids = np.array([self.id[x] for x in pieces])[order]
            self.table[n] = (h[order], ids, np.array([self.score[i] for i in ids.tolist()]))
            self.sieve[n] = np.zeros(1 << _SIEVE, dtype=bool)
            self.sieve[n][h >> np.uint64(64 - _SIEVE)] = True

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces of ``n`` characters with hashes ``h``."""
        found, which = np.full(h.shape, NONE), np.zeros(h.shape, np.int64)
        if n in self.table:
            known, ids, scores = self.table[n]
            maybe = np.flatnonzero(self.sieve[n][h >> np.uint64(64 - _SIEVE)])
            some = h.ravel()[maybe]
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            hit = known[at] == some
            found.ravel()[maybe[hit]], which.ravel()[maybe[hit]] = scores[at[hit]], ids[at[hit]]
        return found, which


class Arc(NamedTuple):
    begin: int
    end: int
    id: int
    score: float


def _hidden(unit: str) -> str:
    """The unit with leading spaces as pieces have them. A space mark of the text
    itself must not look like one: it becomes a character that no piece has."""
    spaces = len(unit) - len(unit.lstrip(" "))
    return SPACE * spaces + unit[spaces:].replace(SPACE, HIDDEN)


def arcs_of(unit: str, v: Vocabulary) -> list[Arc]:
    """The lattice of a unit; ids below 0 spell a character."""
    shown, out = _hidden(unit), []
    for i in range(len(shown)):
        for j in range(i + 1, min(len(shown), i + v.longest) + 1):
            k = v.id.get(shown[i:j])
            if k is not None:
                out.append(Arc(i, j, k, v.score[k]))
            elif j == i + 1:
                out.append(Arc(i, j, -1 - ord(unit[i]), v.spell))
    return out


def forward(length: int, arcs: list[Arc]) -> list[float]:
    """Best score from the start to each position."""
    best = [NONE] * (length + 1)
    best[0] = 0.0
    for a in sorted(arcs, key=lambda a: a.begin):
        best[a.end] = max(best[a.end], best[a.begin] + a.score)
    return best


def n_best(length: int, arcs: list[Arc], n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best paths of a lattice, best first: A-star from the end."""
    best = forward(length, arcs)
    into: list[list[Arc]] = [[] for _ in range(length + 1)]
    for a in arcs:
        into[a.end].append(a)
    # Of equals, the one nearest to the start, then the last made: one path is finished
    # before its equals are opened, so the heap holds at most n x length expansions.
    heap, made, out = [(-best[length], length, 0, 0.0, None)], 1, []
    while heap and len(out) < n:
        _, at, _, done, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((done, ids))
            continue
        for a in into[at]:
            heapq.heappush(heap, (-(done + a.score + best[a.begin]), a.begin, -made, done + a.score, (a.id, path)))
            made += 1
    return out


def _same_length(units: list[str], v: Vocabulary):
    """Best score, loss of the second best, and best ids of units of one length."""
    n, u = len(units[0]), len(units)
    # Characters by place and unit, so that a step over all units reads one stretch.
    own = np.ascontiguousarray(np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).reshape(u, n).T)
    # As ``_hidden``: the spaces of a unit are all in front.
    chars = np.where(own == ord(SPACE), np.uint64(ord(HIDDEN)), own.astype(np.uint64))
    chars[own == ord(" ")] = ord(SPACE)
    scores, ids, used, h = {}, {}, {}, None
    for k in range(1, min(n, v.longest) + 1):
        h = chars if k == 1 else h[:-1] * _BASE + chars[k - 1:]
        scores[k], ids[k] = v.find(k, h)
        used[k] = (scores[k] > NONE).any(axis=1).tolist()
    spelled = scores[1] == NONE
    scores[1][spelled] = v.spell
    ids[1][spelled] = -1 - own[spelled].astype(np.int64)
    best, second = np.full((n + 1, u), NONE), np.full((n + 1, u), 2 * NONE)
    back = np.ones((n + 1, u), dtype=np.int64)
    best[0] = 0
    for e in range(1, n + 1):
        for k in range(1, min(e, v.longest) + 1):
            if k > 1 and not used[k][e - k]:
                continue
            s = scores[k][e - k]
            one = best[e - k] + s
            np.maximum(second[e], second[e - k] + s, out=second[e])
            np.maximum(second[e], np.minimum(best[e], one), out=second[e])
            back[e][one >= best[e]] = k
            np.maximum(best[e], one, out=best[e])
    rows, at, found = np.arange(u), np.full(u, n), []
    while len(rows):
        k = back[at, rows]
        got = np.zeros(len(rows), dtype=np.int64)
        for size in np.unique(k).tolist():
            mine = k == size
            got[mine] = ids[size][at[mine] - size, rows[mine]]
        found.append((rows, got))
        at = at - k
        rows, at = rows[at > 0], at[at > 0]
    row, piece = (np.concatenate(x) for x in zip(*found))
    # Steps were gathered from the end: later steps come first in a unit.
    order = np.lexsort((-np.arange(len(row)), row))
    return best[n], best[n] - second[n], piece[order], np.bincount(row, minlength=u)


class _Places(dict):
    """Places of units; one that isn't there yet gets the next place."""

    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Segmenter:
    """Segments batches of texts."""

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        self._short = lru_cache(KEPT_LATTICES)(lambda unit: arcs_of(unit, v))
        self._forget()

    def _forget(self):
        self.place, self.known = _Places(), self._spelled_units([])

    def _arcs(self, unit: str) -> list[Arc]:
        return self._short(unit) if len(unit) <= TOGETHER else arcs_of(unit, self.v)

    def _learn(self, texts: list[str]) -> list[np.ndarray]:
        """Places of the units of each text, with the new ones of them segmented."""
        if len(self.place) > KEPT_UNITS:
            self._forget()
        before, rows = len(self.place), []
        for t in texts:
            found = _UNITS.findall(" " + t) if t else []
            rows.append(np.fromiter(map(self.place.__getitem__, found), np.int64, len(found)))
        score, loss, first, size, ids = self._spelled_units(list(self.place)[before:])
        self.known = tuple(np.concatenate(x) for x in zip(self.known, (score, loss, first + len(self.known[4]), size, ids)))
        return rows

    def _units(self, units: list[str]):
        """For all units: score, loss, first place and number of ids, and the ids."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if units else []
        score, loss = np.zeros(len(units)), np.zeros(len(units))
        first, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        parts, total = [], 0
        for members in groups:
            same = [units[i] for i in members.tolist()]
            if (length := len(same[0])) <= TOGETHER:
                s, d, ids, n = _same_length(same, self.v)
            else:
                got = [n_best(length, arcs_of(unit, self.v), 2) for unit in same]
                s = np.array([g[0][0] for g in got])
                d = np.array([g[0][0] - g[1][0] if len(g) > 1 else -NONE for g in got])
                ids = np.array([x for g in got for x in g[0][1]])
                n = np.array([len(g[0][1]) for g in got])
            score[members], loss[members], size[members] = s, d, n
            first[members] = total + np.cumsum(n) - n
            parts.append(ids)
            total += len(ids)
        return score, loss, first, size, np.concatenate([*parts, np.zeros(0, np.int64)])

    def _spelled_units(self, units: list[str]):
        """``_units`` with spelled characters as byte pieces."""
        score, loss, first, size, ids = self._units(units)
        pieces, bad = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        pieces[bad] = [len(chr(-1 - i).encode("utf-8")) for i in ids[bad].tolist()]
        place = np.concatenate([[0], np.cumsum(pieces)])
        return score, loss, place[first], place[first + size] - place[first], self._spelled(ids).astype(np.int32)

    def paths(self, texts: list[str]):
        """Per text: score and ids of each of the N best segmentations, best first, and
        whether decoding each of them gives the text."""
        rows = self._learn(texts)
        units = list(self.place)
        score, loss, first, size, ids = self.known
        for text, at in zip(texts, rows):
            if not len(at):
                yield [(0.0, np.zeros(0, np.int32))], True
                continue
            n = size[at]
            ends = np.cumsum(n)
            mine = ids[np.arange(n.sum()) + np.repeat(first[at] - (ends - n), n)]
            total = float(score[at].sum())
            near = loss[at]
            few = np.argsort(near, kind="stable")[:self.n - 1] if len(at) <= 64 else self._smallest(near)
            few = np.sort(few[near[few] < -NONE / 2])
            if not len(few):
                yield [(total, mine)], decode(mine.tolist(), self.v) == text
                continue
            arcs, length, cuts = [], 0, []
            for i in few.tolist():
                unit = units[at[i]]
                arcs += [Arc(a.begin + length, a.end + length, a.id, a.score) for a in self._arcs(unit)]
                length += len(unit)
                cuts.append(length)
            rest = total - float(score[at[few]].sum())
            # The best ids between those units, which all paths share.
            shared = np.split(mine, np.column_stack([ends[few] - n[few], ends[few]]).ravel())[::2]
            found, same = [], True
            for s, path in n_best(length, arcs, self.n):
                whole = [shared[0]]
                for i, own, behind in zip(few.tolist(), self._cut(path, cuts), shared[1:]):
                    # Bytes of a path are those of its units: with one whole path decoded,
                    # the others are by the units where they differ.
                    same = same and b"".join([self.v.raw[x] for x in own]) == units[at[i]].encode()
                    whole += [own, behind]
                found.append((rest + s, np.concatenate(whole, dtype=np.int32, casting="same_kind")))
            yield found, same and decode(found[0][1].tolist(), self.v) == text

    def texts(self, texts: list[str]):
        """Per text: ids of the best segmentation, and the scores of the N best."""
        for found, _ in self.paths(texts):
            yield found[0][1], [s for s, _ in found]

    def _cut(self, path: list[int], cuts: list[int]):
        """Ids of a path, spelled, for each of its units, which end at ``cuts``."""
        at, k, own = 0, 0, []
        for i in path:
            if i < 0:
                own += [self.v.bytes[b] for b in chr(-1 - i).encode("utf-8")]
                at += 1
            else:
                own.append(i)
                at += self.v.chars[i]
            if at == cuts[k]:
                yield own
                k, own = k + 1, []

    def _smallest(self, near: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(near <= np.partition(near, self.n - 1)[self.n - 1])
        return some[np.argsort(near[some], kind="stable")][:self.n - 1]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Ids with spelled characters as byte pieces."""
        bad = np.flatnonzero(ids < 0)
        if not len(bad):
            return ids
        out, at = [], 0
        for i in bad.tolist():
            out.append(ids[at:i])
            out.append(np.array([self.v.bytes[b] for b in chr(-1 - int(ids[i])).encode("utf-8")]))
            at = i + 1
        return np.concatenate([*out, ids[at:]])


def decode(ids: list[int], v: Vocabulary) -> str:
    return b"".join([v.raw[i] for i in ids]).decode("utf-8", "replace")[1:]


def _groups(texts: list[str]):
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= GROUP_CHARS):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def encode(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
           model_path: str = MODEL_PATH) -> DataFrame:
    """``id, best, best_sha256, round_trip`` per row of ``docs``: score and ids of each of
    the ``n`` best segmentations, best first, the digest of all of them, and whether
    decoding each of them gives the text."""
    with open(model_path, "rb") as f:  # read by the driver: workers need no such file
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        v = Vocabulary(proto.value)
        segment = Segmenter(v, n)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                found, same = zip(*segment.paths(texts[lo:hi]))
                flat = [path for paths in found for path in paths]
                ids = pa.ListArray.from_arrays(_offsets([len(i) for _, i in flat]), pa.array(np.concatenate([i for _, i in flat])))
                best = pa.ListArray.from_arrays(_offsets([len(paths) for paths in found]), pa.StructArray.from_arrays(
                    [pa.array([s for s, _ in flat], pa.float64()), ids], ["score", "ids"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), best, pa.array([_sha256(paths) for paths in found]), pa.array(same)],
                    ["id", "best", "best_sha256", "round_trip"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, best array<struct<score:double,ids:array<int>>>, best_sha256 string, round_trip boolean")


def _sha256(paths: list[tuple[float, np.ndarray]]) -> str:
    """Of score (double), number of ids and ids (int) of each path, little-endian."""
    h = hashlib.sha256()
    for score, ids in paths:
        h.update(struct.pack("<dq", score, len(ids)))
        h.update(np.ascontiguousarray(ids, "<i4"))
    return h.hexdigest()


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def digest(encoded: DataFrame) -> DataFrame:
    """One row a document: number of pieces and digest of the ids of the best
    segmentation, scores of the N best, and digest of the scores and ids of all N."""
    ids = F.get("best.ids", F.lit(0))
    return encoded.select(
        F.col("id").alias("doc_id"), F.size(ids).cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"), F.get("best.score", F.lit(0)).alias("best_score"),
        F.size("best").alias("n_best"), F.array_join("best.score", ",").alias("scores"),
        F.col("best_sha256").alias("n_best_sha256"), "round_trip")


def op9_pieces(spark, sf_dir):
    from .common import load
    return digest(encode(load(spark, sf_dir, "documents")))
