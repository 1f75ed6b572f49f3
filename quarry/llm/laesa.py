"""Product codes of vectors: integer k-means by parts, pruned by LAESA pivots.

A vector is scaled to integers and cut into consecutive parts. Each part position
has a codebook of ``entries`` integer vectors, begun with the parts of the first
vectors by id. A round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floored mean of
its parts.

LAESA (Mico, Oncina and Vidal 1994): ``PIVOTS`` fixed vectors of each part position,
chosen far apart among the first entries. The distances of all parts to them are
computed once and stored beside the vectors. A round computes only the distances
between pivots and entries: by the triangle inequality, the largest difference
``|d(part, pivot) - d(entry, pivot)|`` bounds the distance of a part and an entry
from below. Entries are taken in the order of their bounds; the exact integer distance
is evaluated only while a bound doesn't exceed the best distance so far. Bounds are
shrunk by more than the rounding of square roots, so pruning never changes a result.

Every task sends the sums of its parts (``parts * entries`` vectors, whatever its
input); Spark adds them up, and only these sums and the codebooks, never vectors,
meet on the driver.

Defined results: rows whose vector is null, holds a null, NaN or infinite
component, or one of ``LARGEST`` or more (its error might not fit a BIGINT) are dropped,
as are rows whose length differs from that of the first vector; a length that
isn't a multiple of the parts is cut as evenly as possible. Null ids count as larger
than all others; equal ids are ordered by their vectors. With fewer vectors than entries the
codebooks are smaller, an empty table gives an empty result. Repeated rows are coded
alike and each counts. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import order_id, stored

#: Fixed pivots of each part position.
PIVOTS = 4
#: Components of this size and more are out of range.
LARGEST = 1 << 14
#: Labels with this part of all rows or more are joined apart: at most so many.
HOT_SHARE = 1000

_MARGIN = 1e-9


class Codebooks(NamedTuple):
    """Entries of each part position (integers), and where the parts begin."""

    entries: list[np.ndarray]
    bounds: list[int]


def usable(vector: Column) -> Column:
    """Neither null nor with a null, non-finite or too large component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)) & ~F.isnan(x))


def scaled(vectors: pa.Array, scale: int) -> np.ndarray:
    """Floored integers, a row a vector (all of one length)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)


def first_codebooks(first: list[list[float]], parts: int, scale: int) -> Codebooks:
    x = np.floor(np.array(first, dtype=np.float64) * scale).astype(np.int64)
    bounds = [p * x.shape[1] // parts for p in range(parts + 1)]
    return Codebooks([x[:, a:b].copy() for a, b in zip(bounds, bounds[1:])], bounds)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and ``y``, pair by pair."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the entries, each the farthest from those before it."""
    picked = [0]
    near = squared(entries, entries[0][None])
    while len(picked) < min(n, len(entries)):
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, squared(entries, entries[picked[-1]][None]))
    return entries[picked]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p[None]) for p in pivots], axis=1).astype(np.float64))


def nearest(x: np.ndarray, entries: np.ndarray, to_pivot: np.ndarray, entry_to_pivot: np.ndarray):
    """Index of the nearest entry of each row of ``x``, its squared distance, and the
    number of exact evaluations."""
    n, k = len(x), len(entries)
    low = np.zeros((n, k))
    for p in range(to_pivot.shape[1]):
        a, b = to_pivot[:, p, None], entry_to_pivot[None, :, p]
        np.maximum(low, np.abs(a - b) - _MARGIN * (a + b + 1), out=low)
    low *= low * (1 - _MARGIN)
    order = np.argsort(low, axis=1, kind="stable")
    index = order[:, 0].copy()
    best = squared(x, entries[index])
    rows, evaluated = np.arange(n), n
    for step in range(1, k):
        # Later bounds are no smaller: a row that ends here has ended.
        rows = rows[low[rows, order[rows, step]] <= best[rows]]
        if not len(rows):
            break
        e = order[rows, step]
        d = squared(x[rows], entries[e])
        evaluated += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], e[better]
    return index, best, evaluated


class Coder(NamedTuple):
    """What a round broadcasts: codebooks and the pivots' distances to their entries."""

    books: Codebooks
    to_entry: list[np.ndarray]
    scale: int

    def assign(self, vectors: pa.Array, pivot_distances: pa.Array):
        """Per part position: integers of the parts, index, squared distance, evaluations."""
        x = scaled(vectors, self.scale)
        d = pivot_distances.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(self.to_entry), -1)
        for p, (a, b) in enumerate(zip(self.books.bounds, self.books.bounds[1:])):
            part = x[:, a:b]
            yield (part, *nearest(part, self.books.entries[p], d[:, p], self.to_entry[p]))


def with_pivots(vectors: DataFrame, books: Codebooks, pivots: list[np.ndarray], scale: int) -> DataFrame:
    """``vectors(id, label, v)`` with the distances of each part to its pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast((books.bounds, pivots))
    fields = vectors.schema

    def measure(batches):
        bounds, pivots = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = scaled(b.column(2), scale)
            d = np.stack([distances(x[:, s:e], p) for s, e, p in zip(bounds, bounds[1:], pivots)], axis=1)
            width = d.shape[1] * d.shape[2]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(d.reshape(-1)))], [*b.schema.names, "d"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return vectors.mapInArrow(measure, f"{ddl}, d array<double>")


def moved(measured: DataFrame, coder: Coder) -> tuple[Codebooks, int]:
    """The codebooks after one round over ``measured(v, d)``, and the exact evaluations."""
    shared = measured.sparkSession.sparkContext.broadcast(coder)
    books = coder.books

    def add(batches):
        coder = shared.value
        sums = [np.zeros_like(e) for e in coder.books.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in coder.books.entries]
        evaluated = 0
        for b in batches:
            if not b.num_rows:
                continue
            for p, (part, index, _, n) in enumerate(coder.assign(b.column(0), b.column(1))):
                evaluated += n
                for e in np.unique(index).tolist():
                    sums[p][e] += part[index == e].sum(axis=0)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        rows = [(p, e, j, int(x), 0) for p, s in enumerate(sums) for e in np.flatnonzero(counts[p]).tolist() for j, x in enumerate(s[e])]
        rows += [(p, e, -1, int(counts[p][e]), 0) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist()]
        rows.append((-1, 0, 0, 0, evaluated))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["p", "e", "j", "x", "n"])

    total = measured.select("v", "d").mapInArrow(add, "p long, e long, j long, x long, n long").groupBy("p", "e", "j").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
    found = {(r["p"], r["e"], r["j"]): int(r["x"]) for r in total}
    entries = [old.copy() for old in books.entries]
    for p, new in enumerate(entries):
        for e in range(len(new)):
            if (p, e, -1) in found:
                new[e] = [found[p, e, j] // found[p, e, -1] for j in range(new.shape[1])]
    return Codebooks(entries, books.bounds), sum(r["n"] for r in total if r["p"] < 0)


def coded(measured: DataFrame, coder: Coder) -> DataFrame:
    """``id, label, code, error`` per row of ``measured(id, label, v, d)``."""
    shared = measured.sparkSession.sparkContext.broadcast(coder)
    id_type, label_type = (measured.schema[c].dataType.simpleString() for c in ("id", "label"))

    def code(batches):
        hexes = np.array([f"{k:02x}" for k in range(256)])
        for b in batches:
            if not b.num_rows:
                continue
            error, text = np.zeros(b.num_rows, dtype=np.int64), np.full(b.num_rows, "", dtype=object)
            for _, index, d, _ in shared.value.assign(b.column(2), b.column(3)):
                error += d
                text = text + hexes[index].astype(object)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error)],
                                             ["id", "label", "code", "error"])

    return measured.mapInArrow(code, f"id {id_type}, label {label_type}, code string, error long")


def with_label_sums(rows: DataFrame) -> DataFrame:
    """``rows(label, error, ...)`` with ``label_error``, the errors summed over equal
    labels, nulls together. Labels that hold a thousandth of all rows or more are at
    most a thousand and go by broadcast; no other label makes a large group."""
    rows = stored(rows)
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("c")))
    total = sums.agg(F.sum("c").alias("n")).first()["n"] or 0
    is_hot = F.col("c") * HOT_SHARE >= total
    hot, cold = (sums.filter(x).select(F.col("label").alias("l"), "label_error") for x in (is_hot, ~is_hot))
    same = F.col("label").eqNullSafe(F.col("l"))
    first = rows.join(F.broadcast(hot), same).drop("l")
    return first.unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(cold, same).drop("l"))


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, pivots: int = PIVOTS,
               id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None, list[int]]:
    """``id, label, code, error``, the final codebooks, and the exact evaluations of each round."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    first = [r["v"] for r in kept.orderBy(order_id("id"), "v").limit(entries).select("v").collect()]
    if not first:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None, []
    kept = kept.filter(F.size("v") == len(first[0]))
    books = first_codebooks([v for v in first if len(v) == len(first[0])], parts, scale)
    fixed = [choose_pivots(e, pivots) for e in books.entries]
    measured = stored(with_pivots(kept, books, fixed, scale))

    def coder(books):
        return Coder(books, [distances(e, p) for e, p in zip(books.entries, fixed)], scale)

    work = []
    for _ in range(rounds):
        books, evaluated = moved(measured, coder(books))
        work.append(evaluated)
    return coded(measured, coder(books)), books, work


def books_sha256(books: Codebooks | None) -> str:
    text = ",".join(str(x) for part in (books.entries if books else []) for x in part.reshape(-1).tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def op11_laesa(spark, sf_dir):
    from .common import load
    rows, books, _ = compressed(load(spark, sf_dir, "embeddings"))
    return with_label_sums(rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                                        F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out, over one row a component."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST})) = 0),
x AS MATERIALIZED (SELECT r, (j - 1) // (len(v) // {parts}) AS p, (j - 1) % (len(v) // {parts}) AS j, CAST(floor(4096 * CAST(v[j] AS DOUBLE)) AS BIGINT) AS x
    FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS j FROM kept)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, x AS c FROM x WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e
    FROM (SELECT r, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{k} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (r, p) GROUP BY p, e, j),
c{k + 1} AS MATERIALIZED (SELECT p, e, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{k} LEFT JOIN m{k} USING (p, e, j))""")
    return "WITH" + ",\n".join(steps) + f""",
codes AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (r), book"""


OP11_SQL = _op11_sql()
