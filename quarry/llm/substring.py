"""Removal of repeated substrings (windows of consecutive words).

A window is removed from a document when the same window also starts in a
document with a smaller id. Two passes over the texts:

1. Every run of windows whose smallest inner ``gram`` hash is the same has one
   *anchor*. Equal windows have equal anchors, so the number of anchor runs
   bounds the number of windows from above. Each partition counts its anchors
   in a Count-min sketch; the sketches are merged cell by cell, and only two
   bits per cell are kept: counted twice or more, and counted ``HOT`` times or
   more.
2. Windows whose estimate is below two cannot repeat and go no further. The rest
   are grouped exactly: rows of a run travel by their anchor, at most ``HOT``
   of them per anchor, and are resolved side by side in arrays. Runs of anchors
   that may be frequent are first reduced to distinct contents; the smallest
   document of a content and of a window are partial and final minima, joined
   back (Spark splits a skewed join), so no group is ever collected.

The sketch only overestimates: it never loses a repeat, whatever its width. Its
width follows the size of the texts up to ``most_cells``; beyond that it lets
more windows through to the exact pass, with the same result.

Windows are compared by a 64-bit window hash within a 64-bit anchor hash.

Defined results: null text has no words; null ids count as larger than all
others; rows that repeat an id are not smaller than one another, so they don't
remove each other's words; an empty table gives an empty result; texts shorter
than a window stay whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import batch, order_id, parts, stored, text_bytes

#: Words of the grams among which a window's anchor is the smallest.
GRAM = 25
#: Anchors with this estimate or more are resolved window by window; fewer runs
#: (a few MB at most) are resolved together in arrays.
HOT = 8192
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The sketch is merged in this many slices of each row.
SLICES = 64
#: Cells gathered in a task before they are sent.
FLUSH = 1 << 21

_CELLS = pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_BITS = pa.schema([("slice", pa.int32()), ("twice", pa.binary()), ("hot", pa.binary())])
_RUNS = pa.schema([("anchor", pa.int64()), ("hot", pa.bool_()), ("k", pa.int64()), ("h", pa.int64()),
                   ("at", pa.int64()), ("windows", pa.list_(pa.int64()))])
_RUNS_DDL = "anchor long, hot boolean, k long, h long, at long, windows array<long>"
_SPANS = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS_DDL = "k long, h long, start long, end long"


def _anchors(h: np.ndarray, doc: np.ndarray, window: int, gram: int):
    """Places of the windows, their anchors, and where runs of one anchor begin."""
    low = W.sliding_min(W.runs_hash(h, gram), window - gram + 1)
    at = np.flatnonzero(doc[window - 1:] == doc[:len(doc) - window + 1]) if len(doc) >= window else np.zeros(0, int)
    low = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    return at, low, np.flatnonzero(new)


def _cells(anchors: np.ndarray, log_width: int) -> list[np.ndarray]:
    return [(W.mix(anchors * np.uint64(m)) >> np.uint64(64 - log_width)).astype(np.int64) for m in ROWS]


def sketch(df: DataFrame, keys_of, log_width: int, n: int, hot_from: int = 0):
    """Merged Count-min sketch of the 64-bit keys that ``keys_of`` takes from the
    batches of ``df``: bit arrays (rows x width) of cells counted twice or more,
    and ``hot_from`` (``HOT``) times or more."""
    per, hot_from = (1 << log_width) // SLICES, hot_from or HOT

    def send(cells):
        cell, count = np.unique(np.concatenate(cells), return_counts=True)
        cut = np.searchsorted(cell, np.arange(len(ROWS) * SLICES + 1) * per)
        count = np.minimum(count, 65535).astype(np.uint16)
        some = [s for s in range(len(ROWS) * SLICES) if cut[s] < cut[s + 1]]
        return batch(_CELLS, some,
                     [(cell[cut[s]:cut[s + 1]] - s * per).astype(np.uint32).tobytes() for s in some],
                     [count[cut[s]:cut[s + 1]].tobytes() for s in some])

    def count(batches):
        cells, size = [], 0
        for b in batches:
            for keys in keys_of(b):
                for row, c in enumerate(_cells(keys, log_width)):
                    cells.append(c + (row << log_width))
                    size += len(c)
                if size >= FLUSH:
                    yield send(cells)
                    cells, size = [], 0
        if size:
            yield send(cells)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, cell, count in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if s not in total:
                    total[s] = np.zeros(per, dtype=np.uint16)
                at = np.frombuffer(cell.as_buffer(), dtype=np.uint32)
                add = np.frombuffer(count.as_buffer(), dtype=np.uint16)
                total[s][at] = np.minimum(total[s][at].astype(np.int64) + add, 65535)
        for s, t in total.items():
            yield batch(_BITS, [s], [np.packbits(t >= 2).tobytes()], [np.packbits(t >= hot_from).tobytes()])

    twice = np.zeros((len(ROWS) * SLICES, per // 8), dtype=np.uint8)
    hot = np.zeros_like(twice)
    merged = df.mapInArrow(count, "slice int, cells binary, counts binary").repartition(
        min(n, len(ROWS) * SLICES), "slice").mapInArrow(merge, "slice int, twice binary, hot binary")
    for r in merged.collect():
        twice[r["slice"]] = np.frombuffer(r["twice"], dtype=np.uint8)
        hot[r["slice"]] = np.frombuffer(r["hot"], dtype=np.uint8)
    return twice.reshape(len(ROWS), -1), hot.reshape(len(ROWS), -1)


def _width(keys: float, most_cells: int) -> int:
    """Binary logarithm of the cells per row for about ``keys`` keys."""
    return int(np.clip(np.ceil(np.log2(max(2 * keys, 1))), 16, np.log2(most_cells)))


def _text_anchors(window: int, gram: int):
    def keys(b):
        data, offsets = W.utf8(b.column(0))
        for lo, hi in W.groups(offsets):
            w = W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.PLAIN)
            _, low, new = _anchors(w.hash, w.doc, window, gram)
            yield low[new]

    return keys


def _window_keys(anchor, lists) -> np.ndarray:
    """A key for each window of each run, from its anchor and its hash."""
    size = np.diff(lists.offsets.to_numpy())
    whole = lists.flatten().to_numpy().view(np.uint64)
    return W.mix(np.repeat(anchor.to_numpy().view(np.uint64), size) ^ W.mix(whole))


def _marked(bits: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(cells[0]), dtype=bool)
    for row, c in enumerate(cells):
        out &= (bits[row, c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return out


def estimated_repeats(docs: DataFrame, bits, log_width: int, window: int, gram: int) -> DataFrame:
    """Runs of windows of ``docs(k, h, t)`` that the sketch holds for repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def runs(batches):
        twice, hot = shared.value
        for b in batches:
            data, offsets = W.utf8(b.column(2))
            k, h = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi in W.groups(offsets):
                w = W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.PLAIN)
                at, low, new = _anchors(w.hash, w.doc, window, gram)
                cells = _cells(low[new], log_width)
                keep = _marked(twice, cells)
                if not keep.any():
                    continue
                whole = W.runs_hash(w.hash, window)[at].view(np.int64)
                size = np.diff(np.append(new, len(at)))
                first = new[keep]
                doc = w.doc[at[first]]
                windows = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)),
                    pa.array(whole[np.repeat(keep, size)]))
                yield batch(_RUNS, low[first].view(np.int64), _marked(hot, [c[keep] for c in cells]),
                            k[lo + doc], h[lo + doc], at[first] - w.first[doc], windows)

    return docs.select("k", "h", "t").mapInArrow(runs, _RUNS_DDL)


def _resolve(window: int):
    """Exact grouping of the runs that a partition holds, whole anchors together."""
    def resolve(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        anchor, k, h, at = (t.column(c).to_numpy() for c in ("anchor", "k", "h", "at"))
        lists = t.column("windows").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        run = np.repeat(np.arange(len(size)), size)
        whole = lists.flatten().to_numpy()
        place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((k[run], whole, anchor[run]))
        a, v = anchor[run][order], whole[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1])
        smallest = k[run[order]][new][np.cumsum(new) - 1]
        gone = np.zeros(len(run), dtype=bool)
        gone[order] = k[run[order]] > smallest
        hit = np.flatnonzero(gone)
        if not len(hit):
            return
        cut = np.ones(len(hit), dtype=bool)
        cut[1:] = (run[hit[1:]] != run[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(hit)) - 1
        r = run[hit[first]]
        yield batch(_SPANS, k[r], h[r], at[r] + place[hit[first]], at[r] + place[hit[last]] + window)

    return resolve


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = GRAM, most_cells: int = 1 << 27) -> DataFrame:
    """Word ranges to remove from ``docs(k, h, t)``: ``k`` orders the documents, ``h``
    tells rows of one ``k`` apart, ``spans`` holds some of the ranges."""
    spark = docs.sparkSession
    nbytes = text_bytes(docs, "t")
    # A word takes about six bytes, and an anchor lasts half the grams of a window.
    log_width = _width(nbytes / 6 / ((window - gram + 2) / 2), most_cells)
    n = parts(spark, nbytes, 128 << 20)
    bits = sketch(docs.select("t"), _text_anchors(window, gram), log_width, n)
    runs = stored(estimated_repeats(docs, bits, log_width, window, gram))
    few = runs.filter("NOT hot").repartition(n, "anchor").mapInArrow(_resolve(window), _SPANS_DDL)
    many = _resolve_frequent(runs.filter("hot"), window, n, most_cells)
    return few.select("k", "h", F.array(F.struct("start", "end")).alias("spans")).unionByName(many)


def _resolve_frequent(runs: DataFrame, window: int, n: int, most_cells: int) -> DataFrame:
    """Exact grouping of runs whose anchor may be frequent. Equal runs are one
    content with one smallest document. A sketch over the windows of the distinct
    contents leaves those estimated to be in two contents or more, which are
    grouped exactly; the runs then take the minima of their content."""
    runs = runs.withColumn("c", F.xxhash64("windows"))
    contents = stored(runs.groupBy("anchor", "c").agg(
        F.min("k").alias("k"), F.count("*").alias("n"), F.any_value("windows").alias("windows")))
    size = contents.agg(F.sum(F.size("windows")).alias("s")).first()["s"] or 0
    log_width = _width(2 * size, most_cells)
    bits, _ = sketch(contents.select("anchor", "windows"), lambda b: [_window_keys(b.column(0), b.column(1))],
                     log_width, n)
    shared = runs.sparkSession.sparkContext.broadcast(bits)

    def repeated(batches):
        for b in batches:
            keep = _marked(shared.value, _cells(_window_keys(b.column(0), b.column(3)), log_width))
            sizes = np.diff(b.column(3).offsets.to_numpy())
            run = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = pa.array(run[keep])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(at) for c in range(3)), pa.array(place[keep]),
                 b.column(3).flatten().filter(pa.array(keep))], ["anchor", "c", "k", "i", "w"])

    single = contents.select("anchor", "c", "k", "windows").mapInArrow(
        repeated, "anchor long, c long, k long, i long, w long")
    smallest = single.groupBy("anchor", "w").agg(F.min("k").alias("least"))
    minima = single.join(smallest, ["anchor", "w"]).groupBy("anchor", "c").agg(
        F.collect_list(F.struct("i", "least")).alias("minima"))
    # Windows that only one content has: its own smallest document is theirs.
    alone = contents.filter("n > 1").select("anchor", "c", F.col("k").alias("own"))
    begin, least = F.col("at"), F.col("own")
    whole = F.when(F.col("k") > least, F.array(F.struct(
        begin.alias("start"), (begin + F.size("windows") + window - 1).alias("end"))))
    copied = runs.join(alone, ["anchor", "c"]).select("k", "h", whole.alias("spans")).filter("spans IS NOT NULL")
    gone = F.filter("minima", lambda m: m["least"] < F.col("k"))
    across = runs.join(minima, ["anchor", "c"]).withColumn("gone", gone).filter(F.size("gone") > 0).select(
        "k", "h", F.transform("gone", lambda m: F.struct(
            (begin + m["i"]).alias("start"), (begin + m["i"] + window).alias("end"))).alias("spans"))
    return copied.unionByName(across)


def _cut_words(batches):
    """Text without the words of its ranges; counts of words and of removed words."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_text", pa.large_string())])
    for b in batches:
        ids, spans = b.column(0), b.column(2)
        data, offsets = W.utf8(b.column(1))
        n_words, n_removed, kept = [], [], []
        for d in range(b.num_rows):
            words = data[offsets[d]:offsets[d + 1]].tobytes().split()
            n_words.append(len(words))
            ranges = spans[d].as_py() or []
            if ranges:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in ranges:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                words = [w for w, x in zip(words, stay.tolist()) if x]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(kept, pa.large_binary()).cast(pa.large_string())], schema=schema)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, most_cells: int = 1 << 27) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` per row of ``docs``."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), order_id(id_col).alias("k"),
                       F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t"))
    spans = repeated_spans(rows, window, gram, most_cells).groupBy("k", "h").agg(
        F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.join(spans, ["k", "h"], "left").select("id", "t", "spans").mapInArrow(
        _cut_words, "id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark, sf_dir):
    from .common import load
    kept = remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM win JOIN least_doc USING (h) WHERE doc_id > m),
gone_list AS (SELECT doc_id, list(pos) AS g FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone_list USING (doc_id) LEFT JOIN kept USING (doc_id)"""
