"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are duplicates when they are equal, or at least ``min_chars`` characters long and one
edit (insertion, deletion or substitution of a character) apart; blanks at their ends do not
count. A line goes when an equal or duplicate line stands earlier, by document id and line
number; the earliest stays.

Lines within one edit share a variant: one of them unchanged and the other with one character
deleted, or both with one deleted. Every variant is emitted as a hashed key and equal keys are
joined. Half of a variant is untouched by the deletion, so its key is the hash of that half and
its length with the sum of the hashes of the other half's characters (their multiset): each
different character of that half gives one variant, whatever the position it is deleted at. Equal
variants have equal keys; candidates are verified with the edit distance. Variants are emitted only for
halves that two different lines share, which the variants of duplicates always do.

Equal lines are reduced to one row before anything else, by hash and partial aggregation, so a
line that fills a third of the table is one row in every later step.

* A null or empty text is one empty line. Empty and blank lines always stay. Rows that repeat
  both id and text get equal results, as if they were one document; a repeated id with another
  text is another document, ordered by the hash of its text. Null ids come first.
* ``duplicate_lines`` gives one row per row of the input, ``without_duplicate_lines`` keeps all
  columns and changes the text alone. An empty table gives an empty table.
* Lines are told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.chunks import once
from .common import kept, table, unused

MIN_CHARS = 20
_BLANKS = " \t\r\x0b\x0c"
_ID = ("h1", "h2")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, th, line_no, line, n, h1, h2``: the lines that are not blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(
        F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    rows = rows.select("doc_id", "th", "line_no", F.trim("line", F.lit(_BLANKS)).alias("line"))
    return rows.withColumns({"n": F.length("line"), "h1": F.xxhash64("line"),
                             "h2": F.xxhash64("line", F.lit(1))}).where("n > 0")


def _place() -> Column:
    return F.struct("doc_id", "th", "line_no")


def _halves(min_chars: int) -> dict[str, Column]:
    """Hashes of the untouched halves: of the line itself (0) and with a character less (1)."""
    n, line = F.col("n"), F.col("line")

    def key(side: str, length: Column, part: Column) -> Column:
        return F.when(n >= min_chars, F.xxhash64(F.lit(side), length, part))

    out = {}
    for role in (0, 1):
        length = n - role
        h = F.floor(length / 2).cast("int")
        out[f"front{role}"] = key("front", length, F.substring(line, F.lit(1), h))
        out[f"rear{role}"] = key("rear", length, F.substring(line, h + 1 + role, n))
    return out


SIDES = ("front0", "rear0", "front1", "rear1")


def _shared_halves(lines: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """Different lines with their first place; and those of them that share a half."""
    distinct = kept(lines.withColumns(_halves(min_chars)).groupBy(*_ID).agg(
        F.min(_place()).alias("first"), *[F.min(s).alias(s) for s in SIDES]), "lines")
    sides = distinct.select(*_ID, F.explode(F.array(*[
        F.struct(F.lit(i).alias("side"), F.col(s).alias("key")) for i, s in enumerate(SIDES)]))
        .alias("s")).select(*_ID, "s.side", "s.key").where("key IS NOT NULL")
    shared = sides.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    flags = sides.join(shared, "key", "left_semi").groupBy(*_ID).agg(*[
        F.coalesce(F.max(F.when(F.col("side") == i, True)), F.lit(False)).alias(s)
        for i, s in enumerate(SIDES)])
    return distinct.select(*_ID, "first"), flags


def _variants(texts: DataFrame) -> DataFrame:
    """``h1, h2, first, key``: hashed variants of lines that share a half."""
    n, line = F.col("n"), F.col("line")

    def hashed(char: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(char), 32)  # 32 bits: sums of a text stay in 64

    def bag(chars: Column) -> Column:
        return F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, c: acc + hashed(c))

    def variants(side: str, role: int) -> Column:
        length = n - role
        h = F.floor(length / 2).cast("int")
        front, rear = F.substring(line, F.lit(1), h), F.substring(line, h + 1 + role, n)
        if side == "front":
            still, chars = front, F.split(F.substring(line, h + 1, n), "")
        else:
            still, chars = rear, F.split(F.substring(line, F.lit(1), h + role), "")
        head = F.xxhash64(F.lit(side), length, still)
        if role == 0:
            keys = F.array(F.xxhash64(head, bag(chars)))
        else:
            row = F.array(F.struct(head.alias("head"), bag(chars).alias("all"),
                                   F.array_distinct(chars).alias("chars")))
            keys = F.flatten(F.transform(row, lambda r: F.transform(r["chars"], lambda c: F.xxhash64(
                r["head"], r["all"] - hashed(c)))))
        return F.when(F.col(f"{side}{role}"), keys).otherwise(F.array().cast("array<bigint>"))

    every = F.concat(*[variants(side, role) for role in (0, 1) for side in ("front", "rear")])
    return texts.select(*_ID, "first", F.explode(F.array_distinct(every)).alias("key"))


def _later_ones(texts: DataFrame) -> DataFrame:
    """Lines that have a duplicate with an earlier first place."""
    keys = kept(_variants(texts), "variants")
    early = keys.select(*[F.col(c).alias(f"{c}_") for c in (*_ID, "first")], "key")
    pairs = keys.join(early, "key").where("first_ < first").select(
        *_ID, "h1_", "h2_").distinct()
    words = texts.select(*_ID, "line")
    pairs = pairs.join(words, [*_ID]).join(
        words.select(*[F.col(c).alias(f"{c}_") for c in (*_ID, "line")]), ["h1_", "h2_"])
    return pairs.where(F.levenshtein("line", "line_", 1).between(0, 1)).select(*_ID).distinct()


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, th, dropped``: sorted numbers of the lines that go, where any does; one row per
    different id and text (``th`` is the hash of the text)."""
    lines = _lines(docs)
    distinct, flags = _shared_halves(lines, min_chars)
    texts = lines.select(*_ID, "line", "n", _place().alias("at")).join(
        flags.join(distinct, [*_ID]), [*_ID]).where("at = first").dropDuplicates([*_ID])
    texts = kept(texts.drop("at"), "shared")
    later = kept(_later_ones(texts), "later").withColumn("later", F.lit(True))
    verdict = distinct.join(later, [*_ID], "left")
    gone = lines.select(*_ID, _place().alias("at")).join(verdict, [*_ID]).where(
        F.col("later").isNotNull() | (F.col("at") != F.col("first")))
    return gone.groupBy("at.doc_id", "at.th").agg(
        F.sort_array(F.collect_set("at.line_no")).alias("dropped"))


def with_dropped(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``docs`` with the column ``_dropped`` (or ``__dropped`` ... if taken)."""
    name = unused(docs, "_dropped")
    gone = duplicate_lines(docs.select("doc_id", "text"), min_chars).select(
        F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th"),
        F.col("dropped").alias("_gone_lines"))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"])
                       & (F.xxhash64(docs["text"]) == gone["_gone_th"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], F.coalesce(
        gone["_gone_lines"], F.array().cast("array<int>")).alias(name))


def without_duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``; the text has lost its duplicate lines."""
    rows = with_dropped(docs, min_chars)
    gone = rows.columns[-1]
    parts = unused(rows, "_split")
    split = once(rows, {parts: F.split("text", "\n", -1)})
    # positions that stay, then their lines: linear in the lines of a document
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(
        F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return split.select(*[text.alias(c) if c == "text" else c for c in docs.columns])


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    rows = with_dropped(docs)
    return rows.select(
        "doc_id", n_lines.alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.col("_dropped").cast("array<string>")).alias("dropped"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, line_no, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d)),
firsts AS (
  SELECT line, length(line) AS n, min((doc_id, line_no)) AS first
  FROM lines WHERE line <> '' GROUP BY line),
long_ones AS (SELECT * FROM firsts WHERE n >= 20),
-- one edit leaves the first or the last half of the shorter line as it is
sides AS (
  SELECT line, n, first, n - role AS l, unnest([
    'a' || line[1:(n - role) // 2], 'b' || line[(n - role) // 2 + role + 1:n]]) AS half
  FROM long_ones, (SELECT unnest([0, 1]) AS role)),
pairs AS (
  SELECT DISTINCT b.line AS line, b.n AS n, a.line AS other, a.n AS m
  FROM sides a JOIN sides b ON a.half = b.half AND a.l = b.l AND a.first < b.first
  WHERE abs(a.n - b.n) <= 1),
spelt AS (SELECT line, n, other, m, least(n, m) AS k, string_split(line, '') AS x,
                 string_split(other, '') AS y FROM pairs),
matched AS (
  SELECT line, n, m, k,
    coalesce(list_position(list_transform(range(1, k + 1), lambda i: x[i] = y[i]), false) - 1, k) AS head,
    coalesce(list_position(list_transform(range(0, k), lambda i: x[n - i] = y[m - i]), false) - 1, k) AS tail
  FROM spelt),
later AS (SELECT DISTINCT line FROM matched WHERE head + tail >= greatest(n, m) - 1),
gone AS (
  SELECT doc_id, line_no FROM lines JOIN firsts USING (line)
  WHERE (doc_id, line_no) <> first OR line IN (SELECT line FROM later)),
listed AS (SELECT doc_id, count(*) AS n_dropped,
                  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped
           FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
  coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped
FROM d LEFT JOIN listed USING (doc_id)
"""
