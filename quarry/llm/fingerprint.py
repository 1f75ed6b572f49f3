"""SimHash fingerprints, with DataFrame functions only.

Terms are the words of a text. Each occurrence of a word votes on each of the 128
bits of its hash: for the bit if it is set, against it if not. Its weight is the
word's length, up to ``MOST_WEIGHT``, so that the short words that all texts share
don't decide. The fingerprint has the bits with more weight for than against; no
words give all zeros.

The votes are plain sums: four 16-bit lanes of a BIGINT count four bits at once,
so a word costs 32 additions in generated code, and partial sums reduce a text
to one row per ``CHUNK`` words before anything is shuffled. Long texts are summed
over their chunks.

``within_radius`` finds all pairs of fingerprints within a Hamming radius: with
the 128 bits cut into ``blocks`` blocks, two fingerprints at distance ``r`` or
less agree on at least ``blocks - r`` of them. There is one table for each choice
of ``blocks - r`` blocks (a permutation that puts them in front), and candidates
are equal on a table's leading blocks. Documents with equal fingerprints are one
class, and tables hold distinct fingerprints.

Defined results: null text is empty; repeated ids are ordered by text hash, and
identical rows by nothing (they are interchangeable); null ids come last; a
single document is its own next document; an empty table gives an empty result; a
very long text is voted on in chunks of words; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id, stored

#: CHUNK x MOST_WEIGHT votes must fit into 15 bits, so that the upper lane's sum
#: stays a positive BIGINT.
CHUNK, MOST_WEIGHT = 2048, 15
LANE = 0x0001000100010001
#: Documents and text bytes of one range of ids, about, and the cuts made at once.
RANGE_ROWS, RANGE_BYTES, MOST_CUTS = 4096, 32 << 20, 4096
#: Bits in which a neighbour's fingerprint may differ.
RADIUS = 3


def _votes(word_hash: str, weight: str, name: str) -> list[Column]:
    """16 sums of four lanes: lane ``j`` of sum ``k`` counts bit ``k + 16 j``."""
    return [F.expr(f"sum((shiftrightunsigned({word_hash}, {k}) & {LANE}L) * {weight})").alias(f"{name}{k}")
            for k in range(16)]


def simhash(words: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fp_hi, fp_lo`` of ``words(keys, chunk, word)``; the empty word has no vote."""
    voted = words.select(*keys, "chunk", F.xxhash64("word").alias("a"), F.xxhash64("word", F.lit(1)).alias("b"),
                         F.least(F.length("word"), F.lit(MOST_WEIGHT)).cast("bigint").alias("weight"))
    chunks = voted.groupBy(*keys, "chunk").agg(
        F.sum("weight").alias("weight"), *_votes("a", "weight", "a"), *_votes("b", "weight", "b"))
    lane = lambda n, k, j: f"sum(shiftrightunsigned({n}{k}, {16 * j}) & 65535L)"
    bit = lambda n, k, j: f"if(2 * {lane(n, k, j)} > sum(weight), shiftleft(1L, {k + 16 * j}), 0L)"
    word = lambda n: F.expr(" | ".join(bit(n, k, j) for k in range(16) for j in range(4)))
    return chunks.groupBy(*keys).agg(word("a").alias("fp_hi"), word("b").alias("fp_lo"))


def split_words(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per word; a text without words has one empty word."""
    return df.select(*keys, F.posexplode(F.split(F.trim(F.col(text)), r"[\x20\x09-\x0D]+")).alias("at", "word")).select(
        *keys, F.expr(f"at div {CHUNK}").alias("chunk"), "word")


def hamming(hi: str, lo: str, other_hi: str, other_lo: str) -> Column:
    return F.expr(f"bit_count({hi} ^ {other_hi}) + bit_count({lo} ^ {other_lo})")


def as_text(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, range, place, text, next_text, next_k, next_u`` and ``k, u``: each document
    beside the next one by ascending id, cyclically. ``(range, place)`` is a row's
    own; ``(k, u)`` names it up to equal ids and texts.

    The ids are cut into ranges at approximate quantiles and each range is ordered
    by itself; the first document of a range also stands at the end of the range
    before. The number of ranges follows the rows and the bytes: beyond ``MOST_CUTS``, each
    range is cut again. What is broadcast is a few numbers a range."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), order_id(id_col).alias("k"), text.alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    wanted = max(1, size["n"] // RANGE_ROWS, (size["b"] or 0) // RANGE_BYTES)
    coarse = min(wanted, MOST_CUTS)
    fine = math.ceil(wanted / coarse)
    cuts = rows.agg(F.percentile_approx("k", [i / coarse for i in range(1, coarse)] or [0.5], 10_000).alias("q")).first()["q"]
    placed = rows.withColumn("u", F.xxhash64("text")).withColumn("range", _cell("k", sorted(set(cuts or [])) if coarse > 1 else []))
    if fine > 1:
        inner = stored(placed.groupBy("range").agg(
            F.array_distinct(F.percentile_approx("k", [i / fine for i in range(1, fine)], 10_000)).alias("inner")))
        placed = placed.join(F.broadcast(inner), "range").withColumn(
            "range", F.col("range") * fine + F.size(F.filter("inner", lambda c: c <= F.col("k")))).drop("inner")
    firsts = stored(placed.groupBy("range").agg(F.min("k").alias("first")))
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.lit(firsts.agg(F.max("range").alias("r")).first()["r"]))
    # Rows with a range's smallest id (one, unless ids repeat) also end the range before.
    ends = placed.join(F.broadcast(firsts.withColumn("before", before)), "range").filter(F.col("k") == F.col("first")).withColumn(
        "range", F.col("before")).drop("first", "before")
    both = placed.withColumn("last", F.lit(0)).unionByName(ends.withColumn("last", F.lit(1)))
    w = Window.partitionBy("range").orderBy("last", "k", "u")
    following = [F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "k", "u")]
    return both.select("id", "k", "u", "text", "last", "range", F.row_number().over(w).alias("place"),
                       *following).filter("last = 0").drop("last")


def _cell(col: str, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted ``cuts`` are at most ``col``: first among every
    ``step``-th of them, then within that stretch."""
    heads, stretches = cuts[step - 1::step], [cuts[i:i + step - 1] for i in range(0, len(cuts) + 1, step)]
    at_most = lambda c: c <= F.col(col)
    longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    head = F.size(F.filter(longs(heads), at_most))
    return (head * step + F.size(F.filter(F.get(F.array(*map(longs, stretches)), head), at_most))).cast("int")


def edited(text: str, next_text: str) -> Column:
    """The last half of ``text`` replaced by as much of the beginning of ``next_text``."""
    return F.expr(f"concat(left({text}, length({text}) - length({text}) div 2), left({next_text}, length({text}) div 2))")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256``, and ``hi, lo`` of the text, of the edited text
    (``e_hi, e_lo``) and of the next document (``n_hi, n_lo``)."""
    pairs = with_next(docs, id_col, text_col).withColumn("edited", edited("text", "next_text"))
    row = ["range", "place", "id", "k", "u", "next_k", "next_u"]
    keys = [*row, "n_chars", "edited_sha256"]
    facts = pairs.select(*row, F.length("text").cast("bigint").alias("n_chars"),
                         F.sha2("edited", 256).alias("edited_sha256"),
                         F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                                           F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    words = split_words(facts.select(*keys, F.col("x.kind").alias("kind"), F.col("x.t").alias("t")), "t", [*keys, "kind"])
    prints = simhash(words, [*keys, "kind"])
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    rows = prints.groupBy(*keys).agg(pick("fp_hi", 0).alias("hi"), pick("fp_lo", 0).alias("lo"),
                                     pick("fp_hi", 1).alias("e_hi"), pick("fp_lo", 1).alias("e_lo"))
    by_row = rows.groupBy(F.col("k").alias("next_k"), F.col("u").alias("next_u")).agg(
        F.max("hi").alias("n_hi"), F.max("lo").alias("n_lo"))
    return rows.join(by_row, ["next_k", "next_u"])


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``(query_hi, query_lo, hi, lo, distance)`` of distinct fingerprints of
    ``queries(hi, lo)`` and ``prints(hi, lo)`` at most ``radius`` bits apart."""
    if not 0 <= radius < blocks <= 16:
        raise ValueError("radius must be below blocks, and blocks at most 16")
    bits = F.concat(F.lpad(F.bin("hi"), 64, "0"), F.lpad(F.bin("lo"), 64, "0"))
    edge = [round(i * 128 / blocks) for i in range(blocks + 1)]

    def tables(df: DataFrame) -> DataFrame:
        cut = [F.substring("bits", edge[i] + 1, edge[i + 1] - edge[i]) for i in range(blocks)]
        # The leading bits by their hash: what agrees by chance falls out by its distance.
        keyed = [F.struct(F.lit(t).alias("table"), F.xxhash64(*[cut[i] for i in chosen]).alias("lead"))
                 for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
        return df.select("hi", "lo").distinct().withColumn("bits", bits).select(
            "hi", "lo", F.explode(F.array(*keyed)).alias("x")).select("hi", "lo", "x.table", "x.lead")

    q = tables(queries).withColumnsRenamed({"hi": "query_hi", "lo": "query_lo"})
    near = q.join(tables(prints), ["table", "lead"]).withColumn(
        "distance", hamming("hi", "lo", "query_hi", "query_lo"))
    return near.filter(F.col("distance") <= radius).select("query_hi", "query_lo", "hi", "lo", "distance").distinct()


def with_neighbours(rows: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = 6) -> DataFrame:
    """The stored ``rows(hi, lo, ...)`` with ``n_near``: for rows that are ``asked``, the number
    of other distinct fingerprints of all rows within the radius; null for the others."""
    queries = rows.filter(asked).select("hi", "lo").distinct()
    found = within_radius(rows.select("hi", "lo"), queries, radius, blocks).groupBy("query_hi", "query_lo").agg(
        F.count_if(F.col("distance") > 0).alias("n_near"))
    counts = stored(found).select(F.col("query_hi").alias("hi"), F.col("query_lo").alias("lo"), "n_near")
    near = rows.filter(asked).join(counts, ["hi", "lo"])
    rest = rows.filter(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("bigint"))
    return near.unionByName(rest)


def op5_fingerprint(spark, sf_dir):
    from .common import load
    rows = with_neighbours(stored(neighbour_fingerprints(load(spark, sf_dir, "documents"))), F.col("id") % 20 == 0)
    likeness = lambda hi, lo: 1 - hamming("hi", "lo", hi, lo) / F.lit(128.0)
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text("hi", "lo").alias("fingerprint"),
        as_text("e_hi", "e_lo").alias("edited_fingerprint"), likeness("e_hi", "e_lo").alias("near_edited"),
        likeness("n_hi", "n_lo").alias("near_next"), "n_near")

