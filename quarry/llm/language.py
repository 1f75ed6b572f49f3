"""Language identification by rank-order profiles.

A profile lists the ``PROFILE`` most frequent byte n-grams (1 to 4 bytes, within
words) in order of frequency. A language's profile comes from all its learning
rows. A document's own profile is compared to each: the distance is the sum, over
the document's n-grams, of how many places each stands out of its place in the
language's profile; an n-gram that the profile lacks counts ``PROFILE``. The
nearest language wins; ties go to the first in alphabetical order.

The score is ``d2 / (d1 + d2)`` for the nearest and second nearest distances (1
with one language, 0.5 for a tie), and 0 for ``und``.

Defined results: text that is null or has no letter is ``und``; so is all text
if nothing was learned; repeated rows get equal predictions; rows with a null id
are neither held out nor learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .grams import count_grams, grams

PROFILE, SIZES = 400, (1, 2, 3, 4)


def fold_of(id_col: str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def learn_profiles(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language -> packed n-grams in order of frequency, over all ``rows``."""
    counts = count_grams(rows.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("key"), F.lower(text_col).alias("text")), SIZES)
    top = counts.withColumn("place", F.row_number().over(
        Window.partitionBy("key").orderBy(F.desc("n"), "code"))).filter(F.col("place") <= PROFILE)
    found: dict[str, list] = {}
    for r in top.orderBy("key", "place").collect():  # PROFILE rows a language
        found.setdefault(r["key"], []).append(r["code"])
    return {lang: np.array(codes, dtype=np.uint32) for lang, codes in sorted(found.items())}


def ranks(profiles: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All profiled n-grams, ascending, and their place in each language's profile."""
    codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint32)]))
    place = np.full((len(codes), len(profiles)), -1, dtype=np.int64)
    for k, p in enumerate(profiles.values()):
        place[np.searchsorted(codes, p), k] = np.arange(len(p))
    return codes, place


def distances(text: np.ndarray, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Out-of-place distance of the text's profile to each language's."""
    code, n = grams(text, SIZES)
    # Most frequent first, then by code: one sort of packed keys.
    own = (np.sort((np.int64(1 << 30) - n << 32) | code.astype(np.int64))[:PROFILE] & 0xFFFFFFFF).astype(np.uint32)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    theirs = np.where((codes[at] == own)[:, None], place[at], -1)
    out = np.abs(theirs - np.arange(len(own))[:, None])
    return np.where(theirs < 0, PROFILE, out).sum(axis=0)


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast((list(profiles), *ranks(profiles)))

    def compare(batches):
        langs, codes, place = model.value
        for b in batches:
            data, offsets = W.utf8(b.column(1))
            letters = b.column(2).to_pylist()
            names, scores = [], []
            for d in range(b.num_rows):
                if not letters[d] or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                far = distances(data[offsets[d]:offsets[d + 1]], codes, place)
                order = np.argsort(far, kind="stable")
                names.append(langs[order[0]])
                first, second = (int(far[order[0]]), int(far[order[1]])) if len(langs) > 1 else (0, 1)
                scores.append(second / (first + second) if first + second else 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t"), letters.alias("letters")).mapInArrow(
        compare, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op3_language(spark, sf_dir):
    from .common import load
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.filter(fold_of("doc_id") != 2))
    return predict(docs, profiles).select(
        F.col("id").alias("doc_id"), F.coalesce(fold_of("id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
