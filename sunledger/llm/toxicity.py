"""Toxicity by character n-grams whose features are scaled by naive Bayes log-count ratios.

The n-grams of a document (3 to 5 characters within a word, word borders marked) count once.
Each n-gram is scaled by the logarithm of the ratio of its smoothed shares in toxic and other
training documents; a logistic regression on the scaled features is fitted by Spark ML.

* A null text counts as empty; an empty text has no feature and scores the model's intercept.
  Without training rows of both classes every text scores the training share (0 without rows).
* Every row gives one row, repeated rows included; a null id is kept as null and never trained
  on. Columns other than id and text are not read.
* Fitted on at most about ``max_rows`` labelled documents, with at most ``max_features``
  n-grams; these bounds limit what is sent to the executors.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from .common import folded_words, held_out, kept, labelled, raw, record_batch, scorer_of, table

LENGTHS = (3, 4, 5)
_CACHE_WORDS = 300_000


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for n in LENGTHS for i in range(len(padded) - n + 1)]


@lru_cache(30_000)
def _word_grams(word: bytes) -> frozenset[str]:
    return frozenset(grams(word.decode()))


def text_grams(text: bytes | None) -> set[str]:
    out: set[str] = set()
    return out.union(*map(_word_grams, set(folded_words(text, digits=True))))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold an n-gram, added up within a batch."""
    schema = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    for batch in batches:
        counted = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(),
                               batch.column("label").to_pylist()):
            counted[label].update(text_grams(text))
        items = list(counted[0].keys() | counted[1].keys())
        yield record_batch({"gram": items, "toxic": [counted[1][g] for g in items],
                            "other": [counted[0][g] for g in items]}, schema)


def ratios(rows: DataFrame, n_toxic: int, n_other: int, max_features: int) -> dict[str, float]:
    """Log-count ratios of the n-grams that tell the classes apart best (chi-squared)."""
    a, b = F.col("toxic"), F.col("other")
    c, d = F.lit(float(n_toxic)) - a, F.lit(float(n_other)) - b
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d + 1.0))
    ratio = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_other + 1.0))
    counted = rows.mapInArrow(_document_counts, "gram string, toxic bigint, other bigint")
    best = (counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"),
                                        F.sum("other").alias("other"))
            .where(a + b >= 3).select("gram", ratio.alias("ratio"), chi.alias("chi"))
            .orderBy(F.desc("chi"), "gram").limit(max_features))
    return {r["gram"]: r["ratio"] for r in best.toLocalIterator()}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_features: int = 3_000,
        regularisation: float = 0.001) -> tuple[dict[str, float], float]:
    """Weight of each n-gram (coefficient times ratio) and intercept."""
    rows = kept(labelled(docs, labels, "toxic", max_rows), "labelled")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.sum("label").alias("toxic")).first()
    n_all, n_toxic = n["all"], n["toxic"] or 0
    if not 0 < n_toxic < n_all:
        share = min(max(n_toxic / max(1, n_all), 1e-9), 1 - 1e-9)
        return {}, math.log(share / (1 - share))
    scale = ratios(rows, n_toxic, n_all - n_toxic, max_features)
    values = list(scale.values())
    shipped = rows.sparkSession.sparkContext.broadcast((scale, 0.0))

    @F.udf(VectorUDT())
    def features(text):
        scorer = scorer_of(shipped, Scorer)
        at = sorted(scorer.held(text))
        return Vectors.sparse(len(scorer.at), at, scorer.weights[at])

    vectors = kept(rows.select(features("text").alias("features"),
                               F.col("label").cast("double").alias("label"),
                               # the rarer class weighs more, by the root of the ratio
                               F.when(F.col("label") == 1, math.sqrt((n_all - n_toxic) / n_toxic))
                               .otherwise(1.0).alias("weight")), "features")
    model = LogisticRegression(maxIter=50, weightCol="weight", regParam=regularisation, standardization=False,
                               tol=1e-5).fit(vectors)
    weights = np.asarray(model.coefficients) * np.asarray(values)
    return {g: float(w) for g, w in zip(scale, weights) if w}, float(model.intercept)


class Scorer:
    """Scores texts in one task; remembers the n-grams of a bounded number of words."""

    def __init__(self, model: tuple[dict[str, float], float]):
        grams_of, self.intercept = model
        self.at = {g: i for i, g in enumerate(grams_of)}
        self.weights = np.array([*grams_of.values()])
        self.known: dict[bytes, tuple[int, ...]] = {}

    def held(self, text: bytes | None) -> set[int]:
        """The features of a text."""
        words = set(folded_words(text, digits=True))
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        at = self.at
        for word in words.difference(self.known):
            self.known[word] = tuple(at[g] for g in grams(word.decode()) if g in at)
        return {i for found in filter(None, map(self.known.__getitem__, words)) for i in found}

    def __call__(self, text: bytes | None) -> float:
        margin = self.intercept + float(self.weights[sorted(self.held(text))].sum())
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, margin))))


def toxicity(docs: DataFrame, model: tuple[dict[str, float], float]) -> Column:
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scorer = scorer_of(shipped, Scorer)
        return pd.Series([scorer(t) for t in texts], dtype="float64")

    return score(raw("text"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"),
                         toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
