"""Near-duplicate documents by min-max hashing.

A document's set are its distinct n-grams of words (shorter texts: the whole
sequence as one). Two documents link when ``den * |A and B| >= num * |A or B|``.

1. Equal sets become one class. From here on there are only distinct sets.
2. Each of ``PERMUTATIONS`` permutations of the 64-bit n-gram hashes gives two
   values of a signature, the smallest and the largest: twice the values for one
   evaluation, and an unbiased estimate with a lower variance than one value from
   each of twice the permutations (Ji et al. 2013). ``ROWS`` permutations
   (twice as many values) make a band. Sets with an equal band share a bucket.
3. Star turns. Each bucket whose sets are not yet all in one component sends its
   hub to all its other sets, the hub being the set with the most neighbours over
   all its buckets. Pairs are confirmed on the full sets, and components of the
   links found so far are taken. A turn makes one pair a bucket entry at most,
   so a bucket of ``m`` sets never makes ``m * m`` pairs.
4. What is still apart in a bucket after ``TURNS`` hubs is compared in blocks:
   a task takes two blocks of a bucket's sets (or of all sets of buckets that hang
   together, if that moves less), counts overlaps over an inverted index of one of them,
   and skips sets that are already connected. So nothing is capped: every two sets of
   a bucket are compared or in one component.
5. Components give each class the smallest document id.

Links are confirmed exactly, up to 64-bit hashes of the n-grams. Two sets of
similarity ``j`` have no bucket in common with probability ``(1 - j**4)**32`` or
about that: 6e-11 at 0.85 (1.2e-10 for unions of seven n-grams), 4e-8 at 0.8.

Defined results: null or empty text has an empty set, which links with nothing
(not even with another empty one); null ids count as larger than all others, and
a component of null ids only has a null component id, of which one row is kept;
repeated rows have equal sets and so one component, and rows that share the
component's id are all marked as kept; very long texts are cut into words in
pieces of bounded size and give one set of all their n-grams; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import NULL_ID, order_id, parts, stored, text_bytes
from .jaccard import components, gram_sets

#: Permutations of a signature, and those of a band.
PERMUTATIONS, ROWS = 64, 2
#: Hubs that each bucket tries before its rest is compared in blocks.
TURNS = 1
#: Sets, and n-grams together, of a block.
UNIT, UNIT_GRAMS = 1000, 1 << 18

_FACTORS = np.random.default_rng(1212).integers(1 << 62, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_names(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set ``code[at[d]:at[d + 1]]``, whatever its order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(code), dtype=np.uint64)])
    return W.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def min_max(code: np.ndarray, at: np.ndarray, factors: np.ndarray = _FACTORS) -> np.ndarray:
    """Signatures ``[set, permutation, smallest/largest]`` of sets without an empty one.
    A permutation multiplies by an odd number and folds the upper half in: a bijection."""
    out = np.empty((len(at) - 1, len(factors), 2), dtype=np.uint64)
    for p, f in enumerate(factors):
        x = code * f
        x ^= x >> np.uint64(29)
        out[:, p, 0] = np.minimum.reduceat(x, at[:-1])
        out[:, p, 1] = np.maximum.reduceat(x, at[:-1])
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band: equal only for equal values of ``rows`` permutations."""
    n, perms, _ = signature.shape
    values = signature.reshape(n, perms // rows, rows * 2)
    key = np.broadcast_to(np.arange(perms // rows, dtype=np.uint64) + np.uint64(1), values.shape[:2])
    for v in range(rows * 2):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ values[:, :, v])
    return key.view(np.int64)


def signed_rows(docs: DataFrame, n: int) -> DataFrame:
    """``id, k, h, s, n, bands`` per row of ``docs(id, k, h, t)``; ``s`` names the set."""
    def sign(batches):
        for b in batches:
            data, offsets = W.utf8(b.column(3))
            for lo, hi in W.groups(offsets):
                code, at = gram_sets(W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.FOLDED), n)
                size = np.diff(at)
                some = np.flatnonzero(size)
                keys = np.zeros((0, PERMUTATIONS // ROWS), np.int64)
                if len(some):
                    keys = bands(min_max(code, np.append(at[some], len(code))))
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, keys.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(set_names(code, at)), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                    ["id", "k", "h", "s", "n", "bands"])

    return docs.mapInArrow(sign, "id long, k long, h long, s long, n long, bands array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """``key, s, n, d`` of the buckets of two sets or more; ``d`` counts the
    neighbours of ``s`` over its buckets."""
    entries = classes.select("s", "n", F.explode("bands").alias("key"))
    # Stored before it is joined back, here and below: both sides are then plain
    # exchanges, and Spark splits a hot key.
    sizes = stored(entries.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = stored(entries.join(sizes, "key"))
    return shared.drop("m").join(shared.groupBy("s").agg(F.sum("m").alias("d")), "s")


def _overlaps(a: pa.Array, b: pa.Array, n: int):
    """Sizes of the sets of two equally long text columns, and of their intersections."""
    sets = []
    for column in (a, b):
        data, offsets = W.utf8(column)
        sets.append([gram_sets(W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.FOLDED), n) for lo, hi in W.groups(offsets)])
    flat = [[code[at[d]:at[d + 1]] for code, at in group for d in range(len(at) - 1)] for group in sets]
    both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*flat)]
    return *(np.array([len(x) for x in f], dtype=np.int64) for f in flat), np.array(both, dtype=np.int64)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The ``pairs(a, b)`` of ``texts(s, t)`` that link. The hub ``b`` is joined last: a
    hub of many pairs is one row there, and Spark splits the other side."""
    def check(batches):
        for batch in batches:
            x, y, o = _overlaps(batch.column(2), batch.column(3), n)
            yield batch.select(["a", "b"]).filter(pa.array((o > 0) & (o * den >= num * (x + y - o))))

    one = pairs.join(texts.select(F.col("s").alias("a"), F.col("t").alias("ta")), "a")
    two = one.join(texts.select(F.col("s").alias("b"), F.col("t").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def apart_links(sets: list[np.ndarray], left: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different labels that connect all components of the pairs
    between the places ``left`` and the others (or among all places, if all are left)."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    inside = bool(left.all())
    held = np.flatnonzero(left)
    owner = np.repeat(np.arange(len(held)), size[held])
    joined = np.concatenate([sets[i] for i in held])
    order = np.argsort(joined, kind="stable")
    gram, owner = joined[order], owner[order]
    label, links = label.copy(), []
    for q in range(len(sets)):
        if not inside and left[q]:
            continue
        fits = (label[held] != label[q]) & (size[held] * den >= size[q] * num) & (size[held] * num <= size[q] * den)
        if inside:
            fits &= held < q
        if not fits.any():
            continue
        begin, end = np.searchsorted(gram, sets[q]), np.searchsorted(gram, sets[q], side="right")
        n = end - begin
        places = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        overlap = np.bincount(owner[places], minlength=len(held))
        for i in held[fits & (overlap * den >= num * (size[held] + size[q] - overlap))].tolist():
            if label[i] != label[q]:
                links.append((q, i))
                label[label == label[i]] = label[q]
    return links


def _blocks(sets: str, grams: str):
    """Blocks for so many sets and n-grams."""
    return F.greatest(F.ceil(F.col(sets) / UNIT), F.ceil(F.col(grams) / UNIT_GRAMS)).cast("int")


def search_units(members: DataFrame) -> DataFrame:
    """``unit, blocks, s, root``: what is searched together for ``members(key, s, n, root)``.

    Buckets that share sets hang together in a group. A group is one unit if that moves
    fewer sets (a set once a block) than its buckets one by one, as with many
    bands of the same near copies; otherwise each bucket is one (once for all
    buckets of the same sets). Every two sets of a bucket are in one unit either way."""
    least = members.groupBy("key").agg(F.min("s").alias("m"))
    edges = members.join(stored(least), "key").filter("s <> m").select(F.col("s").alias("a"), F.col("m").alias("b"))
    found = components(edges)
    group = stored(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(
        F.col("node").alias("s"), F.col("root").alias("g")))
    placed = stored(members.join(group, "s"))
    facts = placed.groupBy("key").agg(
        F.any_value("g").alias("g"), F.count("*").alias("m"), F.sum("n").alias("grams"),
        F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y"))
    buckets_ = stored(facts.groupBy("g", "m", "grams", "x", "y").agg(F.min("key").alias("key")).withColumn("blocks", _blocks("m", "grams")))
    whole = placed.select("g", "s", "n").distinct().groupBy("g").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).withColumn(
        "group_blocks", _blocks("sets", "grams"))
    apart = buckets_.groupBy("g").agg(F.sum(F.col("m") * F.col("blocks")).alias("moved"))
    plan = stored(whole.join(apart, "g").select("g", "group_blocks", (F.col("sets") * F.col("group_blocks") <= F.col("moved")).alias("together")))
    one = placed.select("g", "s", "root").distinct().join(plan.filter("together"), "g").select(
        F.col("g").alias("unit"), F.col("group_blocks").alias("blocks"), "s", "root", F.lit(True).alias("grouped"))
    single = buckets_.join(plan.filter("NOT together").select("g"), "g").select("key", "blocks")
    each = placed.join(stored(single), "key").select(F.col("key").alias("unit"), "blocks", "s", "root", F.lit(False).alias("grouped"))
    return one.unionByName(each)


def block_links(members: DataFrame, texts: DataFrame, n: int, num: int, den: int, shuffle: int) -> DataFrame:
    """``a, b``: links between the sets of each bucket of ``members(key, s, n, root)``,
    block by block, that span its components."""
    placed = search_units(members).withColumn("own", F.pmod(F.xxhash64("s", F.lit(7)), "blocks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        F.xxhash64("unit", "grouped").alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", "root")
    units = pairs.join(texts, "s").select("key", "i", "j", "own", "s", "root", "t").repartition(
        shuffle, "key", "i", "j").sortWithinPartitions("key", "i", "j", "s")

    def search(batches):
        unit, names, left, roots, sets = None, [], [], [], []

        def links():
            label = np.unique(np.array(roots), return_inverse=True)[1]
            found = apart_links(sets, np.array(left), label, num, den) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()),
                                               pa.array([names[y] for _, y in found], pa.int64())], ["a", "b"])

        for b in batches:
            key, i, j, own, s, root = (b.column(c).to_pylist() for c in range(6))
            data, offsets = W.utf8(b.column(6))
            for lo, hi in W.groups(offsets):
                code, at = gram_sets(W.words_of(data, offsets[lo:hi + 1], W.SPACED, W.FOLDED), n)
                for r in range(lo, hi):
                    if (key[r], i[r], j[r]) != unit:
                        if sets:
                            yield links()
                        unit, names, left, roots, sets = (key[r], i[r], j[r]), [], [], [], []
                    names.append(s[r])
                    roots.append(root[r])
                    left.append(own[r] == i[r])
                    sets.append(code[at[r - lo]:at[r - lo + 1]].copy())
        if sets:
            yield links()

    return units.mapInArrow(search, "a long, b long")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("s"))
    return members.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))


def class_roots(members: DataFrame, texts: DataFrame, n: int, num: int, den: int, shuffle: int) -> DataFrame | None:
    """``node, root`` of the sets in the stored ``members(key, s, n, d)`` that link, without
    the roots themselves; None if no set does."""
    links = checked = roots = None
    for turn in range(TURNS + 1):
        rooted = _rooted(members, roots)
        apart = stored(rooted.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("d", "s", "n", "root")).alias("hub")).filter(
            "low <> high").select("key", "hub"))
        rooted = stored(rooted.join(apart, "key"))
        if rooted.isEmpty():
            break
        if turn == TURNS:
            found = block_links(rooted.select("key", "s", "n", "root"), texts, n, num, den, shuffle)
        else:
            pairs = rooted.filter((F.col("root") != F.col("hub.root")) & (F.col("n") * den >= F.col("hub.n") * num)
                                  & (F.col("n") * num <= F.col("hub.n") * den)).select(F.col("s").alias("a"), F.col("hub.s").alias("b"))
            pairs = pairs.distinct() if checked is None else pairs.distinct().join(
                checked.unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
            pairs = stored(pairs)
            checked = pairs if checked is None else checked.unionByName(pairs)
            found = confirmed(pairs, texts, n, num, den)
            members = rooted.filter("s <> hub.s").select("key", "s", "n", "d")
        found = stored(found)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return roots


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, component, kept`` per row of ``docs``: size of its set, smallest id that
    it reaches by links, and whether it is that document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), order_id(id_col).alias("k"),
                       F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    shuffle = parts(docs.sparkSession, text_bytes(rows, "t"), 128 << 20)
    signed = stored(signed_rows(rows, n))
    classes = stored(signed.filter("n > 0").groupBy("s", "n").agg(
        F.min(F.struct("k", "h")).alias("r"), F.any_value("bands").alias("bands")).select("r.k", "r.h", "s", "n", "bands"))
    members = stored(buckets(classes))
    wanted = classes.select("k", "h", "s").join(members.select("s").distinct(), "s")
    texts = stored(rows.select("k", "h", "t").join(wanted, ["k", "h"]).groupBy("s").agg(F.any_value("t").alias("t")))
    roots = class_roots(members, texts, n, num, den, shuffle)
    own = classes.select("s", F.col("k").alias("own"))
    if roots is None:
        per_class = own.withColumn("component", F.col("own"))
    else:
        named = _rooted(own, roots)
        least = stored(named.groupBy("root").agg(F.min("own").alias("component")))
        per_class = named.join(least, "root").select("s", "own", "component")
    joined = signed.select("id", "k", "s", "n").join(per_class.select("s", "component"), "s", "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("k"))
    return joined.select("id", "n", F.nullif(component, F.lit(NULL_ID)).alias("component"), (F.col("k") == component).alias("kept"))


def op12_minhash(spark, sf_dir):
    from .common import load
    return near_duplicates(load(spark, sf_dir, "documents"), 3, 85, 100).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 2], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""
