"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into blocks. Each block becomes one row of an index
table: its documents, and for every term the ascending list of positions at
which the block holds it. The table is stored once in the shared checkpoint
folder. A search broadcasts one bounded block of test phrases; every index block
then starts from the positions of a phrase's rarest term (rarest over the whole
index), moves them back by the term's offset, and intersects them with the
offset-adjusted lists of the other terms in order of frequency. Index blocks
never meet, so nothing is shuffled and a frequent word costs only its own
block's list. Test sets beyond one block of phrases are searched block by block
over the stored index.

Defined results: null text has no words; an empty table gives an empty result;
repeated rows are separate documents, each with a row of its own; a null
``item_id`` counts as the item id ``''``; repeated items count once. Documents
keep their (possibly null or repeated) ``doc_id``; a very long text is one document of
its block, cut into words in pieces of bounded size. Other columns, whatever their
names, are not read (:func:`keep_clean` passes them on).
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import batch, free_name, stored

#: Unused positions between two documents of a block: no phrase crosses them.
GAP = 64
#: Text bytes of one index block.
BLOCK_BYTES = 2 << 20
#: Phrases broadcast together (80 bytes each: at most 40 MB).
PHRASES_PER_PASS = 500_000

_INDEX = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
    ("terms", pa.binary()), ("bounds", pa.binary()), ("postings", pa.binary())])
_INDEX_DDL = ("block long, doc_ids array<long>, n_words array<long>, "
              "terms binary, bounds binary, postings binary")
_HITS = pa.schema([
    ("block", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string()))])
_HITS_DDL = ("block long, row int, doc_id long, n_words long, "
             "spans array<struct<start:long,end:long>>, items array<string>")


class Phrases(NamedTuple):
    """Distinct phrases of a block of test items. ``term[p, o]`` is the place in
    ``vocabulary`` of the term at offset ``o`` (-1: the phrase is shorter)."""

    vocabulary: np.ndarray
    term: np.ndarray
    length: np.ndarray
    items: list[list[str]]


def phrase_table(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``phrase, items``: the distinct phrases of ``window`` words (a shorter item is one
    phrase) as the hashes of their words, and the sorted ids of their items."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))

    def cut(batches):
        for b in batches:
            data, offsets = W.utf8(b.column(1))
            for lo, hi in W.groups(offsets):
                w = W.words_of(data, offsets[lo:hi + 1], W.ALNUM, W.FOLDED)
                for d in np.flatnonzero(np.diff(w.first)).tolist():
                    h = w.hash[w.first[d]:w.first[d + 1]]
                    runs = np.lib.stride_tricks.sliding_window_view(h, min(window, len(h)))
                    flat, size = np.ascontiguousarray(runs).tobytes(), 8 * runs.shape[1]
                    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(runs), [None, pa.py_buffer(flat)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([found, pa.repeat(b.column(0)[lo + d], len(runs))], ["phrase", "i"])

    return rows.mapInArrow(cut, "phrase binary, i string").groupBy("phrase").agg(F.array_sort(F.collect_set("i")).alias("items"))


def phrases_of(rows: DataFrame, window: int) -> Phrases:
    """A block of :func:`phrase_table`, collected."""
    t = rows.select("phrase", "items").toArrow()
    found = t.column("phrase").to_pylist()
    length = np.array([len(p) // 8 for p in found], dtype=np.int64)
    vocabulary, place = np.unique(np.frombuffer(b"".join(found), dtype=np.uint64), return_inverse=True)
    term = np.full((len(found), window), -1, dtype=np.int64)
    row = np.repeat(np.arange(len(found)), length)
    term[row, np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length)] = place
    return Phrases(vocabulary, term, length, t.column("items").to_pylist())


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents with the postings of all its terms."""
    def postings(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            data, offsets = W.utf8(b.column(1))
            for lo, hi in W.groups(offsets, BLOCK_BYTES):
                w = W.words_of(data, offsets[lo:hi + 1], W.ALNUM, W.FOLDED)
                at, h = np.arange(len(w.hash)) + w.doc * GAP, w.hash
                order = np.argsort(h, kind="stable")
                terms, first = np.unique(h[order], return_index=True)
                yield batch(_INDEX, [part << 32 | n], [b.column(0).slice(lo, hi - lo).to_pylist()],
                            [np.diff(w.first)], [terms.tobytes()],
                            [np.append(first, len(h)).astype(np.uint32).tobytes()],
                            [at[order].astype(np.uint32).tobytes()])
                n += 1

    return docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).mapInArrow(
        postings, _INDEX_DDL)


def _places(sorted_values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each ``h`` in ``sorted_values``, -1 where it isn't there."""
    if not len(sorted_values):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return np.where(sorted_values[at] == h, at, -1)


def _blocks(batches):
    """Index rows as arrays: (block, doc_ids, n_words, terms, bounds, postings)."""
    for b in batches:
        for k in range(b.num_rows):
            block, ids, n = (b.column(c)[k].as_py() for c in range(3))
            terms, bounds, at = (np.frombuffer(b.column(c)[k].as_buffer(), dtype=t)
                                 for c, t in ((3, np.uint64), (4, np.uint32), (5, np.uint32)))
            yield block, ids, np.array(n, dtype=np.int64), terms, bounds.astype(np.int64), at


def term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary term in the whole index (one number per term)."""
    asked = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total = np.zeros(len(asked.value), dtype=np.int64)
        for _, _, _, terms, bounds, _ in _blocks(batches):
            place = _places(asked.value, terms)
            np.add.at(total, place[place >= 0], np.diff(bounds)[place >= 0])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for r in index.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["t"]] = r["n"]
    return out


def _near(positions: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which ``wanted`` places have one of the sorted ``positions`` within ``slop``."""
    at = np.searchsorted(positions, wanted - slop)
    inside = at < len(positions)
    return inside & (positions[np.minimum(at, len(positions) - 1)] <= wanted + slop)


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Matches per document: ``block, row, doc_id, n_words, spans, items``.

    ``slop`` 0 asks for exact phrases. Above 0 it asks for proximity: the rarest
    term marks the place, and each other term must occur within ``slop`` words
    of its own place. Every document has a row, also without a match."""
    width = phrases.term.shape[1]
    if width + slop > GAP:
        raise ValueError(f"phrases of {width} words with slop {slop} exceed the index gap of {GAP}")
    count = np.append(term_counts(index, phrases.vocabulary), np.iinfo(np.int64).max)
    by_rarity = np.argsort(count[phrases.term], axis=1, kind="stable")
    asked = index.sparkSession.sparkContext.broadcast((phrases, by_rarity))

    def intersect(batches):
        (vocabulary, term, length, items), order = asked.value
        for block, ids, n_words, terms, bounds, at in _blocks(batches):
            at = at.astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n_words)])
            base = first[:-1] + np.arange(len(ids)) * GAP
            place = _places(terms, vocabulary)
            have = np.append(place >= 0, True)
            spans: dict[int, list] = {}
            named: dict[int, set[str]] = {}
            for p in np.flatnonzero(have[term].all(axis=1)):
                starts = None
                for o in order[p, :length[p]]:
                    t = place[term[p, o]]
                    listed = at[bounds[t]:bounds[t + 1]]
                    if starts is None:
                        starts = listed - o
                    else:
                        starts = starts[_near(listed, starts + o, slop)]
                    if not len(starts):
                        break
                if not len(starts):
                    continue
                doc = np.searchsorted(base, starts + order[p, 0], side="right") - 1
                begin = np.maximum(starts - base[doc], 0)
                end = np.minimum(starts - base[doc] + length[p], n_words[doc])
                for d, s, e in zip(doc.tolist(), begin.tolist(), end.tolist()):
                    spans.setdefault(d, []).append((s, e))
                    named.setdefault(d, set()).update(items[p])
            yield batch(_HITS, [block] * len(ids), list(range(len(ids))), ids, n_words,
                        [[{"start": s, "end": e} for s, e in _union(spans[d])] if d in spans else []
                         for d in range(len(ids))],
                        [sorted(named[d]) if d in named else [] for d in range(len(ids))])

    return index.mapInArrow(intersect, _HITS_DDL)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def covered(spans: str) -> Column:
    """Words inside any of the (possibly overlapping) ``spans``."""
    step = "named_struct('n', a.n + greatest(s.end - greatest(s.start, a.to), 0L), 'to', greatest(a.to, s.end))"
    return F.expr(f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0L), (a, s) -> {step}, a -> a.n)")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  per_pass: int = PHRASES_PER_PASS) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (ids of the items found, sorted), ``spans``
    (word ranges found), one row per row of ``docs``."""
    asked = stored(phrase_table(items, window, item_col, text_col))
    blocks = max(1, math.ceil(asked.count() / per_pass))
    index = stored(build_index(docs, id_col, text_col))
    if blocks == 1:
        hits = search(index, phrases_of(asked, window), slop)
    else:
        # A block of phrases after the other: one is on the driver and broadcast at a time.
        in_block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
        hits = search(index, phrases_of(asked.limit(0), window), slop)
        for k in range(blocks):
            hits = hits.unionByName(stored(search(index, phrases_of(asked.filter(in_block == k), window), slop).filter(F.size("items") > 0)))
        hits = hits.groupBy("block", "row", "doc_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return hits.select("doc_id", "n_words", covered("spans").alias("n_hit"), "items", "spans")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item."""
    h = free_name(docs, "texthash")
    named = docs.withColumn(h, F.xxhash64(text_col))
    # The id column of the index carries the text hash: equal texts share their fate.
    hit = contamination(named.select(F.col(h).alias("doc_id"), F.col(text_col).alias("text")), items, window).filter(
        "n_hit > 0").select(F.col("doc_id").alias(h)).distinct()
    return named.join(hit, h, "left_anti").select(*docs.columns)


def op4_decontaminate(spark, sf_dir):
    from .common import load
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
phrases AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS p
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, lengths WHERE len(w) >= n)),
hits AS (SELECT r, n, k, item FROM places JOIN phrases USING (n, p)),
hit_words AS (SELECT r, count(DISTINCT pos) AS n_hit
              FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
              FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""
