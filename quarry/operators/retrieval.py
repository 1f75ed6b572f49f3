"""Index and retrieval (RET-01…13): vector, keyword, TF-IDF and hybrid top-k.

Shape of every search: a grid of query blocks and slices of the index. Both
sides stay distributed, a cell gives k rows per query, and a window over these is
cut to k rows per query in every task before it shuffles. Adding to an index
moves the batch only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.tables import TASKS_A_SLOT

# --- fixed values: hybrid weights, default k, k bounds
SIM_WEIGHT, KW_WEIGHT = 0.7, 0.3
DEFAULT_K, MAX_K = 5, 20

#: Queries of a block, and index records of a part, of the search grid; queries
#: whose distances to a slice are held together.
QUERY_BLOCK, PART_ROWS, QUERIES_TOGETHER = 2048, 1 << 20, 256
TOKEN = r"[^\p{L}\p{N}_]+"
WORD_RUN = r"[\p{L}\p{N}_]+"


def _id_type(df: DataFrame, col: str) -> str:
    """Ids keep their type; whole numbers are BIGINT."""
    t = df.schema[col].dataType
    return "bigint" if isinstance(t, T.IntegralType) else t.simpleString()


def _element_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.elementType.simpleString()


def _slices(index: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``ids, v``: the records of one Arrow batch as one row, the vectors end to end."""
    kind = _id_type(index, id_col)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (b.column(0), flat)], ["ids", "v"])

    rows = index.select(F.col(id_col).cast(kind).alias("id"), F.col(vec).alias("v")).filter("v IS NOT NULL")
    return rows.mapInArrow(pack, f"ids array<{kind}>, v array<{_element_type(index, vec)}>")


def _grid(queries: DataFrame, slices: DataFrame, qid: str, n_queries: int, n_records: int) -> DataFrame:
    """Every block of ``queries(qid, ...)`` (as ``q``, an array of its rows) beside every row
    of ``slices(ids, ...)``.

    Queries are numbered into blocks, slices into parts, and cells of the grid are an
    equi-join on (block, part): a slice moves once a block of queries, a block once a
    part. Neither side is collected or broadcast whole, whatever its size."""
    spark = queries.sparkSession
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    parts = max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks), math.ceil(n_records / PART_ROWS))
    packed = queries.groupBy(F.pmod(F.xxhash64(qid), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(*queries.columns)).alias("q"))
    left = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = slices.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return right.join(left, ["block", "part"]).select("q", *slices.columns)


def vector_topk(queries: DataFrame, index: DataFrame, k: int = DEFAULT_K, qid: str = "qid",
                id_col: str = "id", vec: str = "embedding", where: Column | None = None) -> DataFrame:
    """RET-01/02/03: the ``k`` nearest index records per query by squared L2
    distance (nearest first, ties to the lower id), with ``score = 1 - distance``.

    Both sides stay distributed: a grid of (query block, index slice) cells, in each a
    local top-k (``k`` rows a query and slice), then a window over what is left, which
    Spark limits to ``k`` rows a query in every task before it shuffles.
    ``where`` filters the index *before* scoring (pushed into the scan).
    Distances are rounded to 6 places before ranking so results are stable.
    Ids may be of any type that sorts (RET-06 makes strings); a query id that is
    repeated counts once; null vectors are left out.
    Output: ``qid, id, distance, score, rank``.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be in 1..{MAX_K}")
    index = index if where is None else index.filter(where)
    # An id that is repeated counts once; so a block's size is bounded by the hash.
    once = queries.filter(F.col(vec).isNotNull()).groupBy(F.col(qid).cast(_id_type(queries, qid)).alias("qid")).agg(F.min(vec).alias("v"))
    cells = _grid(once, _slices(index, id_col, vec), "qid", queries.count(), index.count())
    cand = cells.mapInArrow(_local_topk(k), f"qid {_id_type(queries, qid)}, id {_id_type(index, id_col)}, distance double")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "distance",
                      (F.lit(1.0) - F.col("distance")).alias("score"), F.col("rank").cast("int").alias("rank"))


def _vectors(flat: pa.Array, n: int) -> np.ndarray:
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _local_topk(k: int):
    """The ``k`` best of each cell's slice for each of its queries, under (distance, id)."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, ids = b.column(0)[r].values, b.column(1)[r].values
                qids, X = q.field(0), _vectors(b.column(2)[r].values, len(ids))
                Q = _vectors(q.field(1).flatten(), len(qids))
                order = np.empty(len(ids), dtype=np.int64)
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                xn = (X * X).sum(axis=1)
                for at in range(0, len(Q), QUERIES_TOGETHER):
                    yield _best(qids, Q[at:at + QUERIES_TOGETHER], at, ids, X, xn, order, k)
    return run


def _best(qids, Q, at, ids, X, xn, order, k) -> pa.RecordBatch:
    D = (Q * Q).sum(axis=1)[:, None] + xn[None, :] - 2.0 * (Q @ X.T)
    D = np.round(np.maximum(D, 0.0), 6)
    last = min(k, D.shape[1]) - 1
    # all that tie with the last one, then cut by id
    rows, cols = np.nonzero(D <= np.partition(D, last, axis=1)[:, last][:, None])
    d = D[rows, cols]
    sort = np.lexsort((order[cols], d, rows))
    rows, cols, d = rows[sort], cols[sort], d[sort]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = place < k
    return pa.RecordBatch.from_arrays([qids.take(pa.array(rows[keep] + at)), ids.take(pa.array(cols[keep])), pa.array(d[keep])],
                                      ["qid", "id", "distance"])


def index_stats(index: DataFrame, type_col: str = "entity_type") -> DataFrame:
    """RET-05: record count per type (missing type -> UNKNOWN), reading one column."""
    return index.groupBy(F.coalesce(F.col(type_col).cast("string"), F.lit("UNKNOWN")).alias("entity_type")) \
        .agg(F.count(F.lit(1)).alias("n"))


def upsert_index(index: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """RET-06: add records by id; an id already stored, or repeated in the
    batch, keeps its first row (plain add, never update)."""
    o = F.col(order) if order else F.col(id_col)
    w = Window.partitionBy(id_col).orderBy(o)
    batch = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    fresh = batch.join(index.select(id_col), id_col, "left_anti")
    return index.unionByName(fresh.select(*index.columns))


def create_index(spark: SparkSession, name: str, schema: T.StructType, path: str, id_col: str = "id", buckets: int = 64) -> None:
    """SRC-12/RET-06: an index table at ``path``, bucketed and sorted by id. Creating it
    again over the same files (in another session) opens it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{id_col}`) SORTED BY (`{id_col}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")


def fresh_records(index: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """The rows of ``new`` whose id is not in the bucketed ``index``, the first of each.
    Only the batch is shuffled, into the index's buckets; stored rows stay where they
    are, and only their ids are read."""
    w = Window.partitionBy(id_col).orderBy(F.col(order) if order else F.col(id_col))
    batch = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return batch.join(index.select(id_col), id_col, "left_anti").select(*index.columns)


def add_to_index(spark: SparkSession, name: str, new: DataFrame, id_col: str = "id", order: str | None = None) -> None:
    """RET-06: add ``new`` to the index table ``name`` (:func:`create_index`) by id: an id
    that is stored, or repeated in the batch, keeps its first row. Adding a batch
    again adds nothing, so a job that failed can simply be run again; empty input is a
    no-op. One writer at a time."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    # Stored first: a table can't be read and appended to in one job.
    fresh_records(spark.table(name), new, id_col, order).checkpoint().write.insertInto(name)
    spark.catalog.refreshTable(name)


# ---- keyword and TF-IDF ----------------------------------------------------

def tokens(text) -> Column:
    """Lower-cased runs of letters, digits and ``_`` (Unicode). Extracting the
    runs gives the same list as splitting on the complement and dropping
    empties, without an interpreted lambda over every token."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), 0)


def term_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, t, tf)``: counts of the terms (as 64-bit hashes) per key, aggregated map-side."""
    return df.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, F.xxhash64("term").alias("t")).agg(
        F.count(F.lit(1)).cast("int").alias("tf"))


def keyword_score(queries: DataFrame, docs: DataFrame, qid: str = "qid", qtext: str = "text",
                  did: str = "doc_id", dtext: str = "text") -> DataFrame:
    """RET-08: share of a query's distinct keywords present among a document's
    tokens, for every pair that shares one: an equi-join on the token, with partial counts
    per (document, query). :func:`text_topk` ranks without this table of pairs."""
    qt = queries.select(F.col(qid).alias("_q"), F.explode(F.array_distinct(tokens(qtext))).alias("term"))
    qn = qt.groupBy("_q").agg(F.count(F.lit(1)).alias("_nq"))
    dt = docs.select(F.col(did).alias("_d"), F.explode(F.array_distinct(tokens(dtext))).alias("term"))
    hits = dt.join(qt, "term").groupBy("_q", "_d").agg(F.count(F.lit(1)).alias("_hit"))
    return hits.join(qn, "_q").select(
        F.col("_q").alias(qid), F.col("_d").alias(did), (F.col("_hit") / F.col("_nq")).alias("keyword_score"))


def hybrid_topk(sim: DataFrame, kw: DataFrame, k: int = DEFAULT_K, qid: str = "qid", did: str = "doc_id") -> DataFrame:
    """RET-09 over given scores: ``0.7 * similarity + 0.3 * keyword`` over the union of both
    candidate sets (a missing side scores 0), top ``k`` per query."""
    j = sim.join(kw, [qid, did], "full_outer").select(
        qid, did, F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"))
    j = j.withColumn("score", F.round(F.lit(SIM_WEIGHT) * F.col("similarity") + F.lit(KW_WEIGHT) * F.col("keyword_score"), 6))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(did))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def glob_regex(glob: str) -> str:
    """RET-10: fixed glob -> anchored regex translation (``*`` any run, ``?`` one
    character, ``[...]`` a class, ``[!...]`` a negated class)."""
    out, i = ["^"], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = glob.find("]", i + 2 if glob[i + 1:i + 2] in ("!", "]") else i + 1)
            if j < 0:
                out.append(r"\[")
            else:
                body = glob[i + 1:j]
                if body.startswith("!"):
                    body = "^" + body[1:]
                out.append("[" + body.replace("\\", r"\\") + "]")
                i = j
        else:
            out.append("\\" + ch if not ch.isalnum() and ch != "_" else ch)
        i += 1
    out.append("$")
    return "(?s)" + "".join(out)


def glob_filter(df: DataFrame, path_col: str, glob: str | None) -> DataFrame:
    return df if not glob else df.filter(F.col(path_col).rlike(glob_regex(glob)))


def retrieve(goals: DataFrame, hits: DataFrame, qid: str = "qid", fields: tuple[str, ...] = ()) -> DataFrame:
    """RET-11/12: one row per goal with its ranked context array (empty when the
    search found nothing: left join, so every goal survives)."""
    ctx = hits.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("context"))
    return goals.join(ctx, qid, "left").withColumn(
        "context", F.coalesce(F.col("context"), F.array().cast(ctx.schema["context"].dataType)))


def search_query() -> Column:
    """RET-11: the plan's query, or the goal text when it is missing or empty."""
    return F.coalesce(F.nullif(F.col("search_query"), F.lit("")), F.col("user_goal"))


# ---- index records <-> entities (RET-04, RET-07) --------------------------------

_REHYDRATED_KEYS = ("entity_type", "name", "file_path", "start_line", "end_line", "parent", "docstring",
                    "signature", "imports")


def rehydrate(records: DataFrame, metadata: str = "metadata", document: str = "document",
              distance: str | None = "distance") -> DataFrame:
    """RET-04: index record -> entity row. Every missing key gets its default
    (STANDALONE, ``unknown``, ``unknown.py``, line 1, no parent/doc/signature,
    no imports); the code is cut out of the document (ENT-20); other metadata
    keys are kept in ``extra``; ``similarity_score = 1 - distance``."""
    from .entities import document_code
    m = F.col(metadata)
    g = lambda k, t="string": F.get_json_object(m, f"$.{k}") if t == "string" else F.get_json_object(m, f"$.{k}").try_cast(t)
    extra = F.map_filter(F.from_json(m, "map<string,string>"), lambda k, v: ~k.isin(*_REHYDRATED_KEYS))
    out = records.select(
        "*",
        F.coalesce(g("entity_type"), F.lit("STANDALONE")).alias("entity_type"),
        F.coalesce(g("name"), F.lit("unknown")).alias("name"),
        document_code(F.col(document)).alias("content"),
        F.coalesce(g("file_path"), F.lit("unknown.py")).alias("file_path"),
        F.coalesce(g("start_line", "int"), F.lit(1)).alias("start_line"),
        F.coalesce(g("end_line", "int"), F.lit(1)).alias("end_line"),
        F.nullif(g("parent"), F.lit("")).alias("parent"),
        F.nullif(g("docstring"), F.lit("")).alias("docstring"),
        F.nullif(g("signature"), F.lit("")).alias("signature"),
        F.coalesce(F.from_json(F.get_json_object(m, "$.imports"), "array<string>"), F.array().cast("array<string>")).alias("imports"),
        extra.alias("extra"))
    if distance and distance in records.columns:
        out = out.withColumn("similarity_score", F.lit(1.0) - F.col(distance))
    return out.drop(metadata)


def add_chunks(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """RET-07: legacy whole-file chunks -> entities (ENT-13) -> added by id (RET-06)."""
    from .entities import chunks_to_entities, entity_id
    ents = chunks_to_entities(chunks).withColumn("id", entity_id())
    return upsert_index(index, ents.select(*index.columns))


# ---- top-k text ranking (RET-08, 09, 13) ------------------------------------------

#: Weights of similarity and keyword share in each rank.
RANKS = {"similarity": (1.0, 0.0), "keyword_score": (0.0, 1.0), "score": (SIM_WEIGHT, KW_WEIGHT)}
#: Scores (query by document) held together in a task.
SCORES_TOGETHER = 1 << 21


class TextIndex(NamedTuple):
    """``docs(doc, norm, t, tf)``: the terms of a document (64-bit hashes), their counts, and
    the norm of its TF-IDF weights; ``terms(t, idf)``; the number of documents."""

    docs: DataFrame
    terms: DataFrame
    n: int


def _stored(df: DataFrame) -> DataFrame:
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def build_text_index(docs: DataFrame, did: str = "doc_id", dtext: str = "text") -> TextIndex:
    """RET-13: the index of ``docs``, stored in the shared checkpoint folder; idf =
    ln((1 + N) / (1 + df)) + 1. Document frequencies stay a table: no vocabulary
    comes to the driver or into a broadcast variable.

    Texts move once, by document, and are counted where they arrive. After that only
    numbers move: a hash and a count a term and document for the norms, and the
    documents' arrays to their norms."""
    n = docs.count()
    spark = docs.sparkSession
    tasks = max(TASKS_A_SLOT * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col(did).cast(_id_type(docs, did)).alias("doc"), F.col(dtext).alias("text")).repartition(tasks, "doc")
    listed = term_table(texts, "doc", "text").groupBy("doc").agg(F.collect_list(F.struct("t", "tf")).alias("x"))
    counts = _stored(listed.select("doc", F.col("x.t").alias("t"), F.col("x.tf").alias("tf")))
    # Stored before it is joined, so that both sides are plain exchanges and Spark can split a frequent term.
    idf = _stored(counts.select(F.explode("t").alias("t")).groupBy("t").agg((F.log(F.lit(float(1 + n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf")))
    pairs = counts.select("doc", F.explode(F.arrays_zip("t", "tf")).alias("x")).select("doc", "x.t", "x.tf")
    norms = pairs.join(idf, "t").groupBy(F.col("doc").alias("of")).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    whole = counts.join(norms, F.col("doc").eqNullSafe(F.col("of")))
    return TextIndex(_stored(whole.select("doc", "norm", "t", "tf")), idf, n)


def _text_slices(index: TextIndex) -> DataFrame:
    """``ids, sizes, norms, t, tf``: the documents of one Arrow batch as one row."""
    kind = index.docs.schema["doc"].dataType.simpleString()

    def pack(batches):
        for b in batches:
            if b.num_rows:
                doc, norm, t, tf = b.columns
                columns = (doc, t.value_lengths(), norm, t.flatten(), tf.flatten())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns],
                                                 ["ids", "sizes", "norms", "t", "tf"])

    return index.docs.mapInArrow(pack, f"ids array<{kind}>, sizes array<int>, norms array<double>, t array<long>, tf array<int>")


def text_topk(queries: DataFrame, index: TextIndex, k: int = DEFAULT_K, rank_by: str = "score",
              qid: str = "qid", qtext: str = "text", did: str = "doc_id") -> DataFrame:
    """RET-08/09/13: the ``k`` best documents per query by TF-IDF cosine
    (``similarity``), share of the query's keywords (``keyword_score``) or both
    (``score``); among documents that hold a term of the query.

    The grid of the vector search: a cell scores a slice of documents against a block of
    queries in arrays, term by term, and gives ``k`` rows a query; so neither a
    vocabulary nor a table of pairs exists anywhere, and a term that all texts share
    costs its own postings only. One plan at every size. Terms are told apart by
    64-bit hashes. Output: ``qid, doc, similarity, keyword_score, score, rank`` (values
    rounded to 6 places)."""
    missing = F.lit(math.log(1 + index.n) + 1)
    kind = _id_type(queries, qid)
    own = term_table(queries.select(F.col(qid).cast(kind).alias("q"), F.col(qtext).alias("text")), "q", "text")
    known = own.join(index.terms, "t", "left").withColumn("qidf", F.coalesce("idf", missing))
    # Terms that no document holds count in the norm and the shares. A weight holds the
    # term's idf twice: the query's own, and the documents', which keep plain counts.
    vectors = known.groupBy("q").agg(
        F.sqrt(F.sum((F.col("tf") * F.col("qidf")) ** 2)).alias("norm"), F.count(F.lit(1)).alias("n"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("t", (F.col("tf") * F.col("idf") ** 2).alias("w")))).alias("v"))
    cells = _grid(vectors.select("q", "norm", "n", "v"), _text_slices(index), "q", queries.count(), index.n)
    doc_kind = index.docs.schema["doc"].dataType.simpleString()
    cand = cells.mapInArrow(_score_cells(k, *RANKS[rank_by]), f"q {kind}, doc {doc_kind}, similarity double, keyword_score double, r double")
    w = Window.partitionBy("q").orderBy(F.desc("r"), "doc")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    score = F.round(SIM_WEIGHT * F.col("similarity") + KW_WEIGHT * F.col("keyword_score"), 6)
    return top.select(F.col("q").alias(qid), F.col("doc").alias(did), F.round("similarity", 6).alias("similarity"),
                      F.round("keyword_score", 6).alias("keyword_score"), score.alias("score"), F.col("rank").cast("int").alias("rank"))


def _score_cells(k: int, alpha: float, beta: float):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, ids, *numbers = (b.column(c)[r].values for c in range(6))
                yield from _score_cell(q, ids, *(x.to_numpy(zero_copy_only=False) for x in numbers), k, alpha, beta)
    return run


def _score_cell(q, ids, sizes, norms, t, tf, k, alpha, beta):
    names, v = q.field(0), q.field(3)
    asked = np.repeat(np.arange(len(q)), v.value_lengths().to_numpy(zero_copy_only=False))
    terms, weights = (v.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    weights = weights / q.field(1).to_numpy(zero_copy_only=False)[asked]
    share = 1.0 / q.field(2).to_numpy(zero_copy_only=False)[asked]
    by_term = np.argsort(terms, kind="stable")
    asked, terms, weights, share = asked[by_term], terms[by_term], weights[by_term], share[by_term]
    order = np.empty(len(ids), dtype=np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    ends = np.cumsum(sizes)
    step = max(1, SCORES_TOGETHER // len(q))
    for at in range(0, len(ids), step):
        to = min(at + step, len(ids))
        lo, hi, m = int(ends[at] - sizes[at]), int(ends[to - 1]), to - at
        doc = np.repeat(np.arange(m), sizes[at:to])
        first, last = (np.searchsorted(terms, t[lo:hi], side=side) for side in ("left", "right"))
        n = last - first
        place = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        of = np.repeat(np.arange(hi - lo), n)
        cell = asked[place] * m + doc[of]
        sim, kw = (np.bincount(cell, weights=x, minlength=len(q) * m) for x in ((tf[lo:hi] / norms[at:to][doc])[of] * weights[place], share[place]))
        hit = np.flatnonzero(kw > 0)
        rank = np.round(alpha * sim[hit] + beta * kw[hit], 6)
        row = hit // m
        sort = np.lexsort((order[at + hit % m], -rank, row))
        row, keep = row[sort], hit[sort]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        keep = keep[best]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(keep // m)), ids.take(pa.array(at + keep % m)), pa.array(sim[keep]), pa.array(kw[keep]), pa.array(rank[sort][best])],
            ["q", "doc", "similarity", "keyword_score", "r"])
