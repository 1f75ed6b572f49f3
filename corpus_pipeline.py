"""Corpus cleaning, stage by stage, over ``documents``.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``; the last returns the pieces of the texts. Nulls, empty texts,
repeated rows and empty tables are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, pieces, pii, toxicity
from quarry.llm.common import free_name, load, stored
from quarry.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic:
    those with ``predicted = 0`` of operator 7."""
    ship(spark)
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    mark = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score_col=mark).filter(F.col(mark) < toxicity.TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 or more."""
    ship(spark)
    return jaccard.keep_one(docs, 5, 8, 10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship(spark)
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked."""
    ship(spark)
    return pii.redact(docs, length_col="n_chars")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text."""
    ship(spark)
    return pieces.digest(pieces.encode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("pieces", to_pieces),
]

#: A fitted classifier and a piece lattice are beyond SQL; tests hold each stage
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
