"""Importance resampling of documents towards a target distribution.

Features are runs of 1 to ``max_run`` consecutive words; each falls into one of
``buckets`` by the CRC-32 of its bytes. A bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus. A document's weight is the mean
gain of its features; Gumbel noise from a hash of its id turns the highest scores
into a sample drawn in proportion to the weights.

1. Head: words, and pairs of words, that make up ``1 / HEAD`` of all words or more
   (so at most ``HEAD`` of each, whatever the input) are broadcast as two sorted
   arrays: a word with the CRC state behind its last byte, a pair with its bucket.
2. Tail: all other features take the CRC directly, byte by byte; a pair with a
   known first word goes on from its state. Both give the same number, so the
   totals of the buckets are exact, whatever is in the head.
3. One pass over both tables gives the totals (``buckets`` rows a task at most,
   summed by Spark), one more the weights and scores.
4. The rank is a position in a distributed sort: rows are sorted over ranges, and
   each partition adds the sizes of those before it.

Words are told apart by 64-bit hashes.

Defined results: null and empty texts have no features, a weight of 0, and are
not drawn unless ``least_words`` is 0; a null id is hashed as the word ``null``
and ranks behind other ids of its score; repeated rows are separate documents;
very long texts are taken whole, cut into words in pieces of bounded size; an
empty corpus gives an empty result, an empty target ``T = 0``; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import stored

#: A word or pair is frequent from this fraction of all words on.
HEAD = 1 << 16
#: Words that a task counts before it drops the rare ones.
HELD = 1 << 19
#: Words up to this length go through the CRC side by side, longer ones one by one.
SIDE_BY_SIDE = 48

_FULL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = crc_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B]
_BLANK = np.array([0x20], dtype=np.uint8)


def crc_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """CRC-32 of ``x + byte`` from the CRC-32 of ``x``."""
    crc = crc ^ _FULL
    return _TABLE[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8)) ^ _FULL


def crc_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of the folded bytes of each word, going on from ``crc``."""
    out = np.zeros(len(start), dtype=np.uint32) if crc is None else crc.copy()
    size = end - start
    order = np.argsort(-size, kind="stable")
    first = int(np.searchsorted(-size[order], -SIDE_BY_SIDE, side="left"))
    for i in order[:first].tolist():
        out[i] = zlib.crc32(_FOLD[data[start[i]:end[i]]].tobytes(), int(out[i]))
    rest = order[first:]
    state, at, size = out[rest], start[rest], size[rest]
    for k in range(int(size[0]) if len(rest) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # words longer than k come first
        state[:n] = crc_step(state[:n], _FOLD[data[at[:n] + k]])
    out[rest] = state
    return out


class Head:
    """Sorted hashes of the frequent words with their CRC-32, and of the frequent
    pairs with their buckets."""

    def __init__(self, words: dict[int, int], pairs: dict[int, int]):
        self.word, self.state = self._sorted(words, np.uint32)
        self.pair, self.bucket = self._sorted(pairs, np.int64)

    @staticmethod
    def _sorted(known: dict[int, int], kind):
        keys = np.array(list(known), dtype=np.int64).view(np.uint64)
        values = np.array(list(known.values()), dtype=kind)
        order = np.argsort(keys)
        return keys[order], values[order]

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, h: np.ndarray):
        """Which ``h`` are known, and the values of those."""
        if not len(keys):
            return np.zeros(len(h), dtype=bool), values
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        return known, values[at[known]]


def _once(h: np.ndarray):
    """First places of the distinct ``h``, and which of them each one is."""
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    return first, place


def word_crc(data: np.ndarray, w: W.Words, head: Head) -> np.ndarray:
    """CRC-32 of every word: frequent words by their state, the others directly."""
    known, state = Head.find(head.word, head.state, w.hash)
    out = np.zeros(len(w.hash), dtype=np.uint32)
    out[known] = state
    tail = np.flatnonzero(~known)
    if len(tail):
        first, place = _once(w.hash[tail])
        out[tail] = crc_words(data, w.start[tail[first]], w.end[tail[first]])[place]
    return out


def feature_buckets(data: np.ndarray, w: W.Words, head: Head, max_run: int, buckets: int):
    """Text and bucket of every feature."""
    crc = word_crc(data, w, head)
    docs, found, state = [w.doc], [crc.astype(np.int64) % buckets], crc
    for run in range(2, max_run + 1):
        # Runs of one more word: on from the state behind the run before.
        inside = np.flatnonzero(w.doc[run - 1:] == w.doc[:len(w.doc) - run + 1]) if len(w.doc) >= run else np.zeros(0, np.int64)
        longer = np.zeros(max(len(w.doc) - run + 1, 0), dtype=np.uint32)
        bucket = np.zeros(len(inside), dtype=np.int64)
        h = W.runs_hash(w.hash, run)[inside]
        known = np.zeros(len(inside), dtype=bool)
        if run == 2:
            known, values = Head.find(head.pair, head.bucket, h)
            bucket[known] = values
        # A longer run needs the state of a pair, so there the head saves nothing.
        tail = np.flatnonzero(~known) if max_run == 2 else np.arange(len(inside))
        if len(tail):
            first, place = _once(h[tail])
            begin = inside[tail[first]]
            last = begin + run - 1
            got = crc_words(data, w.start[last], w.end[last], crc_step(state[begin], _BLANK))[place]
            longer[inside[tail]] = got
            bucket[tail] = got.astype(np.int64) % buckets
        docs.append(w.doc[inside])
        found.append(bucket)
        state = longer
    return np.concatenate(docs), np.concatenate(found)


def _words(batch_column):
    data, offsets = W.utf8(batch_column)
    for lo, hi in W.groups(offsets):
        yield lo, hi, data, W.words_of(data, offsets[lo:hi + 1], W.ALNUM, W.FOLDED)


def frequent(texts: DataFrame, max_run: int, buckets: int, head: int = HEAD) -> Head:
    """Frequent words and pairs of ``texts(t)``. A task sends those that reach the
    fraction among its own words; the sums of what was sent decide, and as they
    never exceed the true counts, at most ``head`` words and pairs remain."""
    none = Head({}, {})

    def count(batches):
        held: dict[int, list] = {1: [], 2: []}
        seen = 0

        def merged(run):
            h, crc, n = (np.concatenate(x) for x in zip(*held[run]))
            _, first, place = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(place, weights=n).astype(np.int64)
            often = n * head >= seen
            return h[first][often], crc[first][often], n[often]

        for b in batches:
            for _, _, data, w in _words(b.column(0)):
                crc = word_crc(data, w, none)
                seen += len(crc)
                first, place = _once(w.hash)
                held[1].append((w.hash[first], crc[first], np.bincount(place, minlength=len(first))))
                if max_run > 1 and len(crc) > 1:
                    at = np.flatnonzero(w.doc[1:] == w.doc[:-1])
                    h = W.runs_hash(w.hash, 2)[at]
                    first, place = _once(h)
                    last = at[first] + 1
                    pair = crc_words(data, w.start[last], w.end[last], crc_step(crc[at[first]], _BLANK))
                    held[2].append((h[first], pair, np.bincount(place, minlength=len(first))))
                for run in held:
                    if sum(len(x[0]) for x in held[run]) > HELD:
                        held[run] = [merged(run)]
        for run in held:
            if held[run]:
                h, crc, n = merged(run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), run)), pa.array(h.view(np.int64)), pa.array(crc.astype(np.int64)), pa.array(n)],
                    ["run", "h", "crc", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([0]), pa.array([seen])], ["run", "h", "crc", "n"])

    sent = stored(texts.mapInArrow(count, "run long, h long, crc long, n long").groupBy("run", "h", "crc").agg(F.sum("n").alias("n")))
    total = (sent.filter("run = 0").agg(F.sum("n").alias("n")).first()["n"] or 0) or 1
    rows = sent.filter((F.col("run") > 0) & (F.col("n") * head >= total)).select("run", "h", "crc").collect()
    return Head({r["h"]: r["crc"] for r in rows if r["run"] == 1}, {r["h"]: r["crc"] % buckets for r in rows if r["run"] == 2})


def bucket_totals(texts: DataFrame, head, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Features in each bucket, of ``texts(t, target)`` outside and inside the target."""
    def count(batches):
        total = np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            side = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, w in _words(b.column(0)):
                doc, bucket = feature_buckets(data, w, head.value, max_run, buckets)
                total += np.bincount(side[lo:hi][doc] * buckets + bucket, minlength=2 * buckets).reshape(2, buckets)
        side, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(bucket), pa.array(total[side, bucket])], ["side", "bucket", "n"])

    out = np.zeros((2, buckets), dtype=object)
    for r in texts.mapInArrow(count, "side long, bucket long, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["side"], r["bucket"]] = r["n"]
    return out[0], out[1]


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(target share / corpus share))`` per bucket, both smoothed by one."""
    m, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + m)) / ((a + 1) * (t + m)))) for a, b in zip(corpus, target)],
                    dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths."""
    key = f"{seed}:{'null' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, head, gain: np.ndarray, max_run: int, seed: int) -> DataFrame:
    """``id, n_words, n_features, weight, score`` per row of ``docs(id, t)``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, data, w in _words(b.column(1)):
                doc, bucket = feature_buckets(data, w, head.value, max_run, len(gain))
                n = np.bincount(doc, minlength=hi - lo)
                total = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(total, doc, gain[bucket])
                weight = total // np.maximum(n, 1)
                extra = np.array([noise(seed, i) for i in ids[lo:hi]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(n.astype(np.int64)), pa.array(weight),
                     pa.array(weight + extra)], ["id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def with_position(df: DataFrame, *order, name: str) -> DataFrame:
    """``df`` with the place (from 0) of each row in a sort by ``order``. Rows are
    sorted over ranges and numbered within their partition; only the partitions'
    sizes meet, one small row each."""
    at = F.shiftrightunsigned(F.col(name), 33)
    ranked = stored(stored(df).orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in ranked.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect())
    before, begin = {}, 0
    for p, n in sizes:
        before[p] = begin
        begin += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "_part long, _begin long")
    return ranked.withColumn("_part", at).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_begin") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("_part", "_begin")


def resampled(docs: DataFrame, target: DataFrame, max_run: int = 2, buckets: int = 10_000, share: int = 10,
              least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
              target_text: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` per row of ``docs``. ``rank`` is
    null outside the ``share`` per cent of the documents of ``least_words`` words or
    more that are drawn."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    both = rows.select("t", F.lit(0).alias("target")).unionByName(
        target.select(F.col(target_text).alias("t"), F.lit(1).alias("target")))
    head = spark.sparkContext.broadcast(frequent(both.select("t"), max_run, buckets))
    gain = gains(*bucket_totals(both, head, max_run, buckets))
    found = scored(rows, head, gain, max_run, seed)
    long_enough = F.col("n_words") >= least_words
    placed = with_position(found, long_enough.desc(), F.desc("score"), F.asc_nulls_last("id"), name="rank")
    drawn = placed.filter(long_enough).count() * share // 100
    return placed.withColumn("rank", F.when(long_enough & (F.col("rank") < drawn), F.col("rank") + 1))


def op13_resample(spark, sf_dir):
    from .common import load
    found = resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), max_run=1)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE bits(v, r, k) AS (SELECT v, v, 0 FROM (SELECT unnest(range(0, 256)) AS v)
    UNION ALL SELECT v, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
remainder AS (SELECT v, r FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, text FROM documents
          UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
c AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM c),
step(word, h, crc, k) AS (SELECT word, h, 4294967295::BIGINT, 0 FROM v
    UNION ALL SELECT word, h, xor(crc >> 8, r), k + 1 FROM step JOIN remainder
    ON v = xor(crc & 255, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(h)),
f AS (SELECT word, xor(crc, 4294967295) % 10000 AS bucket FROM step WHERE 2 * k = length(h)),
sums AS (SELECT bucket, CAST(sum(n) FILTER (side = 0) AS DOUBLE) AS s, CAST(sum(n) FILTER (side = 1) AS DOUBLE) AS t
         FROM c JOIN f USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((coalesce(s, 0) + 1) * (big_t + 10000)))) AS BIGINT) AS gain
         FROM sums, totals),
per AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
        FROM c JOIN f USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features,
           CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
           ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT AS h
           FROM texts LEFT JOIN per USING (id) WHERE side = 0),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scores),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed"""
