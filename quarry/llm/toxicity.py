"""Toxicity of text behind a noisy channel.

1. A character language model: counts of byte bigrams and trigrams within the
   words of all documents.
2. Restoration: a token with digits or signs for letters, a letter three times or
   more in a row, or letters spaced out one by one becomes a lattice. A sign may
   be one of the letters it stands for or nothing, a run of a letter one or two of
   it. Viterbi decoding takes the path that is most likely under the language
   model and the channel's costs. Other tokens are only lower-cased.
3. Scoring of the restored words: words and their first four and five letters
   that toxic learning documents have far more often than others carry log-odds
   weights; a logistic regression over a document's strongest weights and their
   number gives its score. Weights come from learning folds 0 and 1, the
   regression from fold 3, so that weights that are chance don't count as proof.

The language model covers all documents. The classifier is fitted on at most
about ``FIT_TEXTS`` distinct texts of each class, chosen by text hash.

Defined results: null and empty texts have no words and get the score of a
document without evidence; equal texts get equal scores; rows with a null id are
never learned from; without labels of both classes every score is the share of
toxic labels (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .grams import count_grams
from .language import fold_of

#: About the most distinct texts of a class that the classifier is fitted on.
FIT_TEXTS = 50_000
#: A feature needs this many toxic texts, this log-odds weight, and this many
#: standard deviations above chance.
LEAST_TEXTS, LEAST_WEIGHT, LEAST_SIGMA = 3, 1.5, 5.0
CACHE = 300_000
#: A document with this score or more counts as toxic, in the operator and the pipeline.
TOXIC_FROM = 0.3

# What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Costs of the channel, in nats: a sign for a letter, a sign for nothing, a
#: separator between letters, one letter for a run, two letters for a run.
SIGN, NOTHING, GAP, ONCE, TWICE = 0.5, 4.0, 0.2, 0.3, 0.6

_EDGES = re.compile(r"^[^\w@$€£|+(]+|[^\w@$€£|+]+$|[$@|+€£]{3,}$")
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:[ .\-_*][\w@$!|+]){2,}(?!\S)")
_LETTER = re.compile(r"[^\W\d_]")


class CharModel:
    """Counts of ``ab`` and ``abc`` by packed bytes; words are framed by blanks. It
    travels as two sorted arrays (12 bytes a gram) and is looked up in dicts, which a
    worker builds once."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order].astype(np.uint32), counts[order].astype(np.int64)
        self._tables = None

    def __getstate__(self):
        return self.codes, self.counts

    def __setstate__(self, state):
        self.codes, self.counts = state
        self._tables = None

    def tables(self) -> tuple[dict[int, int], dict[int, int]]:
        if self._tables is None:
            cut = int(np.searchsorted(self.codes, 1 << 16))
            two, three = (dict(zip(self.codes[x].tolist(), self.counts[x].tolist())) for x in (slice(cut), slice(cut, None)))
            two[-1] = sum(n for code, n in two.items() if code & 0xFF == 0x20)
            self._tables = two, three
        return self._tables

    def cost(self, a: int, b: int, c: int) -> float:
        """-log P(c | a b); ``a`` is -1 at the beginning of a word."""
        two, three = self._tables or self.tables()
        if a < 0:
            return -math.log((two.get(b | c << 8, 0) + 0.5) / (two.get(-1, 0) + 128.0))
        return -math.log((three.get(a | b << 8 | c << 16, 0) + 0.5) / (two.get(a | b << 8, 0) + 128.0))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counted over all texts; at most as many rows as there are byte trigrams."""
    counts = count_grams(docs.select(F.lit("").alias("key"), F.lower(text_col).alias("text")), (2, 3)).select("code", "n").toArrow()
    return CharModel(counts.column("code").to_numpy(), counts.column("n").to_numpy())


def lattice(token: str) -> list[list[tuple[bytes, float]]]:
    """Per stretch of a token, the letters it may be and their cost."""
    out, at = [], 0
    while at < len(token):
        ch, to = token[at], at + 1
        while to < len(token) and token[to] == ch:
            to += 1
        if _LETTER.match(ch):
            one = ch.encode()
            if to - at == 1:
                out.append([(one, 0.0)])
            elif to - at == 2:
                out.append([(one * 2, 0.0)])
            else:
                out.append([(one, ONCE), (one * 2, TWICE)])
        elif ch in SIGNS:
            out += [[(c.encode(), SIGN) for c in SIGNS[ch]] + [(b"", NOTHING)]] * min(to - at, 2)
        else:
            out.append([(b"", GAP)])
        at = to
    return out


def decode(token: str, model: CharModel) -> str:
    """The most likely letters of a noisy token: exact, a state for each pair of last
    bytes that the lattice offers."""
    states: dict[tuple[int, int], tuple[float, bytes]] = {(-1, 0x20): (0.0, b"")}
    for options in lattice(token):
        new: dict[tuple[int, int], tuple[float, bytes]] = {}
        for (a, b), (cost, text) in states.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for c in letters:
                    total += model.cost(x, y, c)
                    x, y = y, c
                if (x, y) not in new or (total, text + letters) < new[x, y]:
                    new[x, y] = (total, text + letters)
        states = new
    best = min((cost + (model.cost(a, b, 0x20) if a >= 0 else 0.0), text) for (a, b), (cost, text) in states.items())
    return best[1].decode("utf-8", "ignore")


class Restorer:
    """Restored words of texts; tokens seen before are remembered."""

    def __init__(self, model: CharModel):
        self.model, self.seen = model, {}

    def word(self, token: str) -> str:
        word = self.seen.get(token)
        if word is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            word = self.seen[token] = self._word(token)
        return word

    def _word(self, token: str) -> str:
        low = _EDGES.sub("", token.lower())
        if low.isalpha() and not _RUN.search(low):
            return low
        if not _LETTER.search(low):
            return ""
        return decode(low, self.model)

    def words(self, text: str) -> set[str]:
        out = {self.word(t) for t in set(text.split())}
        for m in _SPACED.finditer(text):
            out.add(self.word(m.group()))
        out.discard("")
        return out


def features(word: str) -> tuple[str, ...]:
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


def _texts(rows: DataFrame, model) -> DataFrame:
    """``feature, n`` over ``rows(t)``: texts with the feature."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        restore, held = Restorer(shared.value), {}
        for b in batches:
            for t in b.column(0):
                for f in {f for w in restore.words(t.as_py() or "") for f in features(w)}:
                    held[f] = held.get(f, 0) + 1
            if len(held) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()))], ["feature", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                         ["feature", "n"])

    return rows.select("t").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    chars: CharModel
    weights: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray


def evidence(words: set[str], weights: dict[str, float]) -> list[float]:
    """The three strongest weights, the number of words with one, and its share."""
    found = sorted((max(w) for word in words if (w := [weights[f] for f in features(word) if f in weights])), reverse=True)
    return [*(found + [0.0] * 3)[:3], math.log1p(len(found)), len(found) / max(1, len(words))]


def _evidence(rows: DataFrame, model: CharModel, weights: dict[str, float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model, weights))

    def find(batches):
        model, weights = shared.value
        restore = Restorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([evidence(restore.words(t.as_py() or ""), weights) for t in b.column(0)],
                                       pa.list_(pa.float64()))], ["y", "x"])

    return rows.select("t", "y").mapInArrow(find, "y int, x array<double>")


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, the intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = penalty * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    coef = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ coef)
        coef += step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_texts: int = FIT_TEXTS) -> Model:
    """Language model over ``docs``, classifier from their labels outside fold 2."""
    chars = char_model(docs, text_col)
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    rows = docs.filter(F.coalesce(fold_of(id_col) != 2, F.lit(False))).select(
        F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).join(marks, "i")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, fit_texts / n) for y, n in size.items()}
    none = np.zeros(5)
    if len(size) < 2:
        p = min(max(sum(n for y, n in size.items() if y) / max(1, sum(size.values())), 1e-9), 1 - 1e-9)
        return Model(chars, {}, none, none + 1, np.array([math.log(p / (1 - p)), 0, 0, 0, 0, 0]))
    # One row a distinct text: copies would make chance words look like evidence.
    rate = F.create_map(*[F.lit(x) for y, s in share.items() for x in (y, int(s * 1_000_000))])
    picked = stored(rows.filter(F.pmod("h", F.lit(1_000_000)) < rate[F.col("y")]).groupBy("h", "y").agg(
        F.min("i").alias("i")).select("i", "y", fold_of("i").alias("fold")))
    # About 2 x fit_texts rows of ids: the texts are read in place and not shuffled.
    chosen = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), "i")
    learn = chosen.filter("fold < 2")
    counts = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    toxic = _texts(learn.filter("y = 1"), chars).filter(F.col("n") >= LEAST_TEXTS).withColumnRenamed("n", "pos")
    clean = _texts(learn.filter("y = 0"), chars).withColumnRenamed("n", "neg")
    both = toxic.join(clean, "feature", "left").withColumn("neg", F.coalesce("neg", F.lit(0)))
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    expected = (F.col("pos") + F.col("neg")) * n_pos / max(1, n_pos + n_neg)
    # Features of the learning texts, whose number is bounded by ``fit_texts``; none is dropped by rank.
    telling = both.withColumn("w", weight).filter(
        (F.col("w") >= LEAST_WEIGHT) & (F.col("pos") - expected >= LEAST_SIGMA * F.sqrt(expected))).select("feature", "w").toArrow()
    weights = dict(zip(telling.column("feature").to_pylist(), telling.column("w").to_pylist()))
    seen = _evidence(chosen.filter("fold = 3"), chars, weights).collect()
    x, y = np.array([r["x"] for r in seen]).reshape(-1, 5), np.array([r["y"] for r in seen], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(chars, weights, none, none + 1, np.array([math.log(n_pos / max(n_neg, 1)), 0.3, 0.3, 0.3, 0, 0]))
    # The sample's share of classes is not the table's: weigh the intercept back.
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    coef = _regression((x - mean) / scale, y)
    coef[0] += math.log(share[0] / share[1])
    return Model(chars, weights, mean, scale, coef)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in the new column ``score_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        restore = Restorer(m.chars)
        for b in batches:
            x = np.array([evidence(restore.words(t.as_py() or ""), m.weights) for t in b.column(at)]).reshape(-1, 5)
            z = np.clip(m.coef[0] + ((x - m.mean) / m.scale) @ m.coef[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op7_toxicity(spark, sf_dir):
    from .common import load
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold_of("doc_id") == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
