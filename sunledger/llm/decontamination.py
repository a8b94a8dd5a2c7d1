"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``window`` consecutive words of an item (a shorter item is one window). A document
can hold a window only if it holds all of its shingles, so that the join needs one of them: the
one that is rarest over all documents, the window's prefix when shingles are ordered by rarity.
Documents look up these prefixes, the position of a match fixes where the window would start,
starts outside the document are dropped (positional and length bounds), and what is left is
verified word by word.

* A null or empty text, and an item without words, have no words and no windows. Null item ids
  take no part. Rows that share an item id are one item with the windows of all of them.
* The result has one row per document, repeated rows included; null ids are kept. Extra columns
  of documents pass through ``find_windows``; its own columns replace columns of those names.
* The words of the items are sent to the tasks in blocks of at most ``block_words`` different
  words; a larger benchmark takes more passes. Nothing that grows with the documents is sent.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import kept, raw, record_batch, table

WINDOW, SHINGLE = 10, 3
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else
              b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item_id, words``: the different windows of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                for p in range(max(1, len(words) - window + 1) if words else 0):
                    at.append(i)
                    out.append(b" ".join(words[p:p + window]))
            ids = batch.column("item_id").take(pa.array(at, pa.int64()))
            yield record_batch({"item_id": ids, "words": out}, pa.schema(
                [("item_id", ids.type), ("words", pa.binary())]))

    rows = items.where(F.col("item_id").isNotNull()).select("item_id", raw("text").alias("text"))
    return rows.mapInArrow(cut, f"item_id {kind}, words binary").distinct()


class Lexicon:
    """Numbers the words of a block of windows; finds runs of them in documents."""

    def __init__(self, windows: list[bytes], shingle: int):
        self.windows = [w.split() for w in windows]
        self.number: dict[bytes, int] = {}
        for window in self.windows:
            for word in window:
                self.number.setdefault(word, len(self.number))
        self.coded = [np.array([self.number[w] for w in window]) for window in self.windows]
        self.shingle = shingle
        runs: dict[tuple[int, ...], int] = {}
        self.parts: list[list[int]] = []
        for coded in self.coded:
            m = min(shingle, len(coded))
            self.parts.append([runs.setdefault(tuple(coded[p:p + m].tolist()), len(runs))
                               for p in range(len(coded) - m + 1)])
        # by length: sorted keys of the runs and what they stand for
        self.tables = {}
        for m in range(1, shingle + 1):
            own = [(self.key(np.array([r]))[0], i) for r, i in runs.items() if len(r) == m]
            if own:
                self.tables[m] = (np.array(sorted(k for k, _ in own)),
                                  np.array([i for _, i in sorted(own)]))
        self.n_runs = len(runs)

    def key(self, rows: np.ndarray) -> np.ndarray:
        base = len(self.number) + 1
        out = np.zeros(len(rows), np.int64)
        for c in range(rows.shape[1]):
            out = out * base + rows[:, c] + 1
        return out

    def code(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int64)

    def runs(self, coded: np.ndarray, wanted: np.ndarray | None = None):
        """Positions and numbers of the known runs in a coded document."""
        for m, (keys, numbers) in self.tables.items():
            if len(coded) < m:
                continue
            inside = coded[:len(coded) - m + 1] >= 0
            for c in range(1, m):
                inside = inside & (coded[c:len(coded) - m + 1 + c] >= 0)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            found = self.key(np.stack([coded[at + c] for c in range(m)], 1))
            where = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[where] == found
            at, number = at[hit], numbers[where[hit]]
            if wanted is not None:
                keep = wanted[number]
                at, number = at[keep], number[keep]
            yield at, number


class Prefixes(Lexicon):
    """With the rarest run of each window as its prefix."""

    def rank(self, counts: np.ndarray) -> None:
        self.wanted = np.zeros(self.n_runs, bool)
        self.by_prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, parts in enumerate(self.parts):
            offset = min(range(len(parts)), key=lambda p: (counts[parts[p]], parts[p]))
            self.wanted[parts[offset]] = True
            self.by_prefix[parts[offset]].append((i, offset))

    def occurrences(self, coded: np.ndarray):
        """(window, start) of every window in the document, verified."""
        for at, number in self.runs(coded, self.wanted):
            for p, run in zip(at.tolist(), number.tolist()):
                for window, offset in self.by_prefix[run]:
                    start, want = p - offset, self.coded[window]
                    if start >= 0 and start + len(want) <= len(coded) and \
                            np.array_equal(coded[start:start + len(want)], want):
                        yield window, start


def run_counts(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each run of the block occurs over all documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches):
        known = shipped.value
        total = np.zeros(known.n_runs, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, number in known.runs(known.code(words_of(text))):
                    total += np.bincount(number, minlength=known.n_runs)
        seen = np.flatnonzero(total)
        yield record_batch({"run": seen, "n": total[seen]},
                           pa.schema([("run", pa.int64()), ("n", pa.int64())]))

    rows = docs.select(raw("text").alias("text")).mapInArrow(count, "run bigint, n bigint")
    counts = np.zeros(lexicon.n_runs, np.int64)
    for row in rows.groupBy("run").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["run"]] = row["n"]
    return counts


def mark_block(docs: DataFrame, prefixes: Prefixes, owners: list[list]) -> DataFrame:
    """Add the hit words and the items of one block of windows to ``_hits`` and ``_items``."""
    shipped = docs.sparkSession.sparkContext.broadcast((prefixes, owners))

    def mark(batches):
        known, owner = shipped.value
        for batch in batches:
            hits, items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            for i, text in enumerate(batch.column("_text").to_pylist()):
                held, named = set(hits[i]), set(items[i])
                for window, start in known.occurrences(known.code(words_of(text))):
                    held.update(range(start, start + len(known.coded[window])))
                    named.update(owner[window])
                hits[i], items[i] = sorted(held), sorted(named)
            n = batch.schema.get_field_index
            columns = list(batch.columns)
            for name, value in (("_hits", hits), ("_items", items)):
                columns[n(name)] = pa.array(value, batch.schema.field(name).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mark, docs.schema)


def blocks_of(windows: DataFrame, block_words: int):
    """The windows in blocks of about ``block_words`` words, each with its items."""
    by_window = kept(windows.groupBy("words").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")), "windows")
    total = by_window.agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).first()[0]
    n = max(1, -(-(total or 0) // block_words))
    for b in range(n):
        own = by_window.where(F.pmod(F.xxhash64("words"), F.lit(n)) == b).toArrow()
        if own.num_rows:
            yield own.column("words").to_pylist(), own.column("items").to_pylist()


RESULT = ("n_words", "hit_words", "item_ids")


def _searched(docs: DataFrame, items: DataFrame, window: int, shingle: int, block_words: int
              ) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with ``_hits`` and ``_items``, and how to get its own columns back. The text
    goes through the tasks once, as bytes."""
    named = {c: "_text" if c.lower() == "text" else f"c{i}__" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[(F.col(c).cast("binary") if n == "_text" else docs[c]).alias(n)
                         for c, n in named.items()],
                       F.array().cast("array<int>").alias("_hits"),
                       F.array().cast("array<string>").alias("_items"))
    for windows, owners in blocks_of(item_windows(items, window), block_words):
        prefixes = Prefixes(windows, shingle)
        prefixes.rank(run_counts(docs, prefixes))
        rows = mark_block(rows, prefixes, owners)
    return rows, {c: F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in named.items()}


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                 block_words: int = 2_000_000) -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``hit_words`` (positions from 0 of the words
    inside item windows) and ``item_ids`` (as strings, sorted)."""
    rows, own = _searched(docs, items, window, shingle, block_words)
    n_words = F.regexp_count(F.coalesce(F.col("_text").cast("string"), F.lit("")),
                             F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return rows.select(*[v for c, v in own.items() if c.lower() not in RESULT],
                       n_words.cast("long").alias("n_words"), F.col("_hits").alias("hit_words"),
                       F.col("_items").alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    shingle: int = SHINGLE, block_words: int = 2_000_000) -> DataFrame:
    """Rows of ``docs`` that hold no item window; the columns stay as they are."""
    rows, own = _searched(docs, items, window, shingle, block_words)
    return rows.where(F.size("_hits") == 0).select(*own.values())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_windows(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT r, p, places.n AS n, item_id FROM places JOIN windows USING (n, s)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit
         FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items,
                 sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h
          FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
