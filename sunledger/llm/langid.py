"""Language identification, word first with backoff to character n-grams.

A word that the model knows adds its log frequency in every language. A word it does not know
is cut into the n-grams of the greatest length of which the model knows any, and adds the mean
of their log frequencies times the part of the word they cover; shorter n-grams are tried only
when no longer one is known.

* A null text, and a text without a letter, is ``und`` with score 0; without training rows
  every text is ``und``. Ties go to the language that sorts first.
* Every row gives one row, repeated rows included; a null id is kept as null and never
  trained on. Columns other than id, text and (for training) lang are not read.
* The model is fitted on at most about ``max_rows`` documents of each language, and holds at most
  ``max_words`` words and ``max_grams`` n-grams, which bounds what is sent to the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, folded_words, held_out, kept, raw, record_batch, scorer_of, table, unused

ORDERS = (4, 3, 2, 1)
_RUNS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000
Model = tuple[list[str], dict[bytes, int], dict[str, int], np.ndarray]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def training_rows(docs: DataFrame, max_rows: int) -> DataFrame:
    """``lang, text``; languages beyond ``max_rows`` keep their rows of smallest hash."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold() != 0))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), max_rows / F.count(F.lit(1)))
                                     .alias("_share"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return (rows.select("lang", raw("text").alias("text"), key.alias("_key"))
            .join(kept(share, "languages"), "lang").where("_key < _share")
            .select("lang", "text"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language, added up within a batch."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(lang, Counter()).update(folded_words(text))
        for lang, counted in words.items():
            runs: Counter = Counter()
            for word, times in counted.items():
                for run in _RUNS.findall(word.decode()):
                    runs[run] += times
            yield record_batch({"lang": [lang] * len(runs), "n": [0] * len(runs),
                                "item": list(runs), "count": list(runs.values())}, _COUNTED)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of counted words, added up within a batch."""
    for batch in batches:
        added: Counter = Counter()
        for lang, word, times in zip(*(batch.column(c).to_pylist()
                                       for c in ("lang", "item", "count"))):
            for n in ORDERS:
                for gram in grams(word, n):
                    added[lang, n, gram] += times
        yield record_batch({"lang": [k[0] for k in added], "n": [k[1] for k in added],
                            "item": [k[2] for k in added], "count": list(added.values())},
                           _COUNTED)


_COUNTED = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.string()),
                      ("count", pa.int64())])
_COUNTED_DDL = "lang string, n int, item string, count bigint"


def fit(docs: DataFrame, max_rows: int = 1500, max_words: int = 100_000,
        max_grams: int = 60_000) -> Model:
    """Languages; rows of words and of n-grams in a matrix of log frequencies by language."""
    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "n", "item").agg(F.sum("count").alias("count"))

    words = kept(added(training_rows(docs, max_rows).mapInArrow(_word_counts, _COUNTED_DDL)),
                 "words")
    parts = kept(added(words.mapInArrow(_gram_counts, _COUNTED_DDL)), "grams")
    both = words.unionByName(parts)
    totals = {(r["lang"], r["n"]): r["total"] for r in
              both.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return [], {}, {}, np.zeros((2, 0))

    def commonest(rows: DataFrame, most: int):
        by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"_{i}")
                   for i, lang in enumerate(langs)]
        wide = rows.groupBy("n", "item").agg(F.sum("count").alias("_all"), *by_lang)
        got = (wide.where("_all > 1").orderBy(F.desc("_all"), "n", "item").limit(most)
               .drop("_all").toArrow())
        counts = np.stack([got.column(f"_{i}").to_numpy() for i in range(len(langs))], axis=1)
        lengths = got.column("n").to_numpy()
        sums = np.array([[totals.get((lang, n), 0) + 1.0 for lang in langs]
                         for n in (0, *sorted(ORDERS))])
        return got.column("item").to_pylist(), np.log((counts + 0.05) / sums[lengths])

    names, of_words = commonest(words, max_words)
    pieces, of_grams = commonest(parts, max_grams)
    # rows 0 and 1 are empty evidence: no letter, and letters of which nothing is known
    matrix = np.concatenate([np.zeros((2, len(langs))), of_words, of_grams])
    return (langs, {w.encode(): 2 + i for i, w in enumerate(names)},
            {g: 2 + len(names) + i for i, g in enumerate(pieces)}, matrix)


def backoff(word: str, grams_of: dict[str, int]) -> tuple[list[int], int]:
    """Rows of the longest n-grams of which any is known, and how many the word has."""
    for n in ORDERS:
        pieces = grams(word, n)
        known = [grams_of[g] for g in pieces if g in grams_of]
        if known:
            return known, len(pieces)
    return [1], 1


class Scorer:
    """Scores batches of texts in one task; remembers a bounded number of unseen words."""

    def __init__(self, model: Model):
        self.langs, self.words, self.grams, self.matrix = model
        self.forget()

    def forget(self) -> None:
        self.rows = dict(self.words)
        self.unseen = np.zeros((1024, len(self.langs)))
        self.n_unseen = 0

    def learn(self, words: set[bytes]) -> None:
        """Give each unseen word a row: the mean of its known n-grams of one length."""
        picked, starts, parts = [], [], []
        for word in words:
            runs = [r for r in _RUNS.findall(word.decode()) if any(map(str.isalpha, r))]
            if not runs:
                self.rows[word] = 0
                continue
            starts.append(len(picked))
            parts.append(0)
            for run in runs:  # more than one where a mark outside ASCII stands between words
                known = self.words.get(run.encode())
                rows, size = ([known], 1) if known else backoff(run, self.grams)
                picked += rows
                parts[-1] += size
            self.rows[word] = len(self.matrix) + self.n_unseen + len(starts) - 1
        if starts:
            sums = np.add.reduceat(self.matrix[picked], starts) / np.array(parts)[:, None]
            while self.n_unseen + len(sums) > len(self.unseen):
                self.unseen = np.concatenate([self.unseen, np.zeros_like(self.unseen)])
            self.unseen[self.n_unseen:self.n_unseen + len(sums)] = sums
            self.n_unseen += len(sums)

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[tuple[str, float]]:
        for text in texts:
            words = folded_words(text)
            if not words or not self.langs:
                yield "und", 0.0
                continue
            if self.n_unseen > _CACHE_WORDS:
                self.forget()
            new = {w for w in words if w not in self.rows}
            if new:
                self.learn(new)
            rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            if not rows.any():
                yield "und", 0.0
                continue
            known = len(self.matrix)
            seen, unseen = rows[rows < known], rows[rows >= known] - known
            total = self.matrix[seen].sum(0) + self.unseen[unseen].sum(0)
            top = int(np.argmax(total))
            yield self.langs[top], float(1.0 / np.exp(total - total[top]).sum())


def predicted(docs: DataFrame, model: Model) -> Column:
    """(lang_pred, score) of each row's text; the score is the posterior of the language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(scorer_of(shipped, Scorer)(texts)), columns=["lang_pred", "score"])

    return score(raw("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return (rows.withColumn("_p", predicted(rows, model))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score"))


def keep_known_language(docs: DataFrame, model: Model,
                        min_score: float = 0.5) -> DataFrame:
    """Rows whose text has letters and one language likelier than all others together."""
    verdict = unused(docs, "_verdict")
    rows = docs.withColumn(verdict, predicted(docs, model))
    sure = (F.col(verdict)["lang_pred"] != "und") & (F.col(verdict)["score"] >= min_score)
    return rows.where(sure).select(*docs.columns)


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))
