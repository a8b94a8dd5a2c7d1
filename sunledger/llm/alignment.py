"""Alignment of the tokens of two tokenizers, and how often their ids are linked in the corpus.

Every text is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). The
cumulative ends of the tokens, in bytes of a space and the text, are dictionaries from end to
index; the intersection of their keys, sorted, slices both id lists into groups. Every A token of a
group is linked with every B token of it. The count of a pair of ids is the number of
documents (rows) that hold it linked.

Texts that are null, empty or not valid UTF-8, and texts whose joined token bytes of either side
differ from a space and the text, have no tokens: counts of 0, an empty digest.

Speed: a text of characters up to U+024F takes the byte-level model's table in a second encoder for
the same kind of model (equal on some million words made of all splits of all entries, and on random
ones), about four times as fast; any other text, and any other kind of model, takes the tokenizer itself.

Behind the encoders only the dictionaries handle one token at a time in Python; slices, links and the
text of the groups are array operations on the whole of a text.

Scale: every text is encoded once, in the task that reads it; what is kept per row are its sums, the
digest of its groups and its different pairs with how often it holds them. Counting pairs combines before
the shuffle. A pair that at least one of ``common_pairs`` of all (row, pair) entries hold is common; there are
at most ``common_pairs`` of them whatever the input, so their counts are broadcast and looked up
where the rows are, and no common pair ever becomes a key that rows meet at. All other pairs are joined
by pair and summed by row. The highest count of an A id is found over all pairs, common or not.
Long texts are encoded in reads of about ``CHARS`` characters, whole texts always. Repeated rows
are documents of their own; null ids stay; other columns are ignored whatever their name; an empty
table gives no rows. Tokenizer files are read by the tasks from ``folder``, a path that every executor must have.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept, raw, record_batch, table

FOLDER = "/opt/tokenizers"
CHARS, SMALL = 1 << 20, 4096
#: Fixed value: how a byte-level model of this kind cuts a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def printable_bytes() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself where it is visible,
    the next free one from 256 on otherwise."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


class ByteLevel:
    """A byte-level BPE read from its JSON file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        written, special = printable_bytes(), {t["content"]: t["id"] for t in told["added_tokens"]}
        table = {k: bytes(written[c] for c in k) for k in told["model"]["vocab"] if k not in special}
        ids = told["model"]["vocab"] | special
        self.bytes = [b""] * (max(ids.values()) + 1)
        for entry, i in ids.items():
            self.bytes[i] = table.get(entry, entry.encode())
        self.fast = None
        if told["pre_tokenizer"] == PLAIN_BYTE_LEVEL and not told["normalizer"]:
            self.fast = tiktoken.Encoding("fast", pat_str=BYTE_LEVEL_PATTERN, special_tokens={},
                                          mergeable_ranks={v: ids[k] for k, v in table.items()})

    def encode(self, texts: list[str]) -> list[list[int]]:
        quick = [self.fast is not None and max(t) <= "ɏ" for t in texts]
        slow = iter(self.model.encode_batch_fast([t for t, q in zip(texts, quick) if not q],
                                                 add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick)]


class Pieces:
    """A piece model with byte fallback, which puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.width, self.sides = len(self.b.bytes), (self.a, self.b)
        self.sizes = [np.array(list(map(len, side.bytes)), np.int64) for side in self.sides]
        self.bytes = [np.array(side.bytes, object) for side in self.sides]
        #: every id in decimal with "," behind it, then with what ends its side of a group
        self.written = np.array([b"%d%b" % (i, mark) for side, last in zip(self.sides, (b"|", b";"))
                                 for mark in (b",", last) for i in range(len(side.bytes))], object)
        self.starts = [0, 2 * len(self.a.bytes)]
        self.numbers = list(range(1, 1 << 16))  # made once for all texts of fewer tokens

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of every text; none where a side does not spell the text."""
        out, none = [], np.zeros(0, np.int64)
        for text, *both in zip(texts, self.a.encode([f" {t}" for t in texts]), self.b.encode(texts)):
            whole, ids = f" {text}".encode(), tuple(np.array(x, np.int64) for x in both)
            sound = all(b"".join(entries[x].tolist()) == whole for entries, x in zip(self.bytes, ids))
            out.append(ids if sound else (none, none))
        return out

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes behind the last token of every group, on both sides."""
        ends = [dict(zip(np.cumsum(sizes[ids]).tolist(),
                         self.numbers if len(ids) <= len(self.numbers) else range(1, len(ids) + 1)))
                for sizes, ids in zip(self.sizes, (a, b))]
        found = list(map(ends[1].get, ends[0]))  # ends grow, so keys are in order; no index is 0
        return (np.array(list(compress(ends[0].values(), found)), np.int64),
                np.array(list(filter(None, found)), np.int64))

    def links(self, a, b, cut_a, cut_b) -> tuple[np.ndarray, np.ndarray]:
        """Different pairs (A id times the size of B, plus B id), and how often each is linked."""
        from_a, from_b, heavy = _starts(cut_a), _starts(cut_b), Counter()
        wide, n_a, n_b = self.width, cut_a - from_a, cut_b - from_b
        small = n_a * n_b <= SMALL
        for i, m, k, n in zip(*(x[~small].tolist() for x in (from_a, cut_a, from_b, cut_b))):  # by different ids
            many = Counter(b[k:n].tolist())
            for x, times in Counter(a[i:m].tolist()).items():
                for y, more in many.items():
                    heavy[x * wide + y] += times * more
        from_a, from_b, n_a, n_b = (x[small] for x in (from_a, from_b, n_a, n_b))
        sizes = n_a * n_b
        group = np.repeat(np.arange(len(sizes)), sizes)
        x, y = np.divmod(np.arange(len(group)) - (np.cumsum(sizes) - sizes)[group], n_b[group])
        keys, times = np.unique(a[from_a[group] + x] * wide + b[from_b[group] + y], return_counts=True)
        if heavy:
            keys = np.concatenate([keys, np.fromiter(heavy, np.int64, len(heavy))])
            times = np.concatenate([times, np.fromiter(heavy.values(), np.int64, len(heavy))])
            keys, place = np.unique(keys, return_inverse=True)
            summed = np.zeros(len(keys), np.int64)
            np.add.at(summed, place, times)
            times = summed
        return keys, times

    def groups_text(self, a, b, cut_a, cut_b) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: decimal ids of the groups in order. A token of A stands behind all of A
        before it and all of B in earlier groups; one of B also behind all of A in its own group."""
        from_a, from_b = _starts(cut_a), _starts(cut_b)
        row = np.empty(len(a) + len(b), np.int64)
        for side, ids, cut, start, other in ((0, a, cut_a, from_a, from_b), (1, b, cut_b, from_b, cut_a)):
            code = ids + self.starts[side]
            code[cut - 1] += len(self.sides[side].bytes)
            row[np.arange(len(ids)) + np.repeat(other, cut - start)] = code
        return b"".join(self.written[row].tolist())[:-1]


def _starts(cut: np.ndarray) -> np.ndarray:
    """Index of the first token of every group."""
    return np.append(0, cut)[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _texts(batch):
    """Rows of a batch whose text has a chance of tokens, in reads of about ``CHARS`` characters."""
    part, size = [], 0
    for at, value in enumerate(batch.column("text").to_pylist()):
        try:
            text = value.decode()
        except UnicodeDecodeError:
            continue
        if text:
            part.append((at, text))
            size += len(text)
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    cuts = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def token_groups(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json",
                 b_file: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_cuts, b_cuts``: the ids of both sides and the index behind the last
    token of every group."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = aligner(f"{folder}/{a_file}", f"{folder}/{b_file}")
        for batch in batches:
            rows = [([], [], [], [])] * batch.num_rows
            for part in _texts(batch):
                for (at, _), (a, b) in zip(part, own.encode([t for _, t in part])):
                    rows[at] = (a, b, *own.cuts(a, b))
            ids = batch.column("doc_id")
            names = ["a_ids", "b_ids", "a_cuts", "b_cuts"]
            yield record_batch(
                {"doc_id": ids} | {n: pa.array([r[i] for r in rows], pa.list_(pa.int32()))
                                   for i, n in enumerate(names)},
                pa.schema([("doc_id", ids.type)] + [(n, pa.list_(pa.int32())) for n in names]))

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def token_links(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json",
                b_file: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = aligner(f"{folder}/{a_file}", f"{folder}/{b_file}")
        for batch in batches:
            none = np.zeros(0, np.int64)
            sums, digests = np.zeros((4, batch.num_rows), np.int64), [""] * batch.num_rows
            pairs, times = [none] * batch.num_rows, [none] * batch.num_rows
            for part in _texts(batch):
                for (at, _), (a, b) in zip(part, own.encode([t for _, t in part])):
                    if not len(a):
                        continue
                    cut_a, cut_b = own.cuts(a, b)
                    pairs[at], times[at] = own.links(a, b, cut_a, cut_b)
                    sums[:, at] = len(a), len(b), len(cut_a), times[at].sum()
                    digests[at] = hashlib.sha256(own.groups_text(a, b, cut_a, cut_b)).hexdigest()
            ids = batch.column("doc_id")
            yield record_batch(
                {"doc_id": ids, **dict(zip(_SUMS, sums)), "groups_sha256": digests,
                 "pairs": _lists(pairs, np.int64), "times": _lists(times, np.int64)},
                pa.schema([("doc_id", ids.type), *[(c, pa.int64()) for c in _SUMS], ("groups_sha256", pa.string()),
                           ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in _SUMS)
        + ", groups_sha256 string, pairs array<bigint>, times array<bigint>") \
        .withColumn("row", F.monotonically_increasing_id())


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """``pair, count, best``: rows that hold a pair, and whether no pair of its A id has more."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = kept(counts.withColumn("a", F.floor(F.col("pair") / width)), "pairs")
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    return kept(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")),
                "counts")


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = "byte_bpe_50k.json",
          b_file: str = "piece_bpe_32k.model", common_pairs: int = 200_000) -> DataFrame:
    """Per row ``doc_id``, its sums, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    links = kept(token_links(docs, folder, a_file, b_file), "links")
    counts = pair_counts(links, aligner(f"{folder}/{a_file}", f"{folder}/{b_file}").width)
    entries = counts.agg(F.sum("count")).first()[0] or 0
    # counts of at least this many entries: no more than common_pairs pairs can have them
    often = F.col("count") >= max(1, -(-entries // common_pairs))
    found = counts.where(often).orderBy("pair").toPandas()
    shipped = docs.sparkSession.sparkContext.broadcast(
        [found[c].to_numpy() for c in ("pair", "count", "best")])
    keep = [c for c in links.columns if c not in ("pairs", "times")]
    types = dict(links.dtypes)

    def look_up(batches):
        known, count, best = shipped.value
        for batch in batches:
            lists = batch.column("pairs")
            at, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
            hit = known[place] == at if len(known) else np.zeros(len(at), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], rows[hit], times[hit] * best[place[hit]])
            np.add.at(sums[1], rows[hit], times[hit] * count[place[hit]])
            left = [_lists(np.split(x[~hit], np.cumsum(np.bincount(rows[~hit], minlength=batch.num_rows))[:-1]),
                           np.int64) for x in (at, times)]
            schema = [batch.schema.field(c) for c in keep]
            yield record_batch(
                {**{c: batch.column(c) for c in keep}, "n_best": sums[0], "count_sum": sums[1],
                 "pairs": left[0], "times": left[1]},
                pa.schema([*schema, ("n_best", pa.int64()), ("count_sum", pa.int64()),
                           ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))

    rows = links.mapInArrow(look_up, ", ".join(f"{c} {types[c]}" for c in keep)
                            + ", n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    if counts.where(~often).isEmpty():
        return rows.drop("row", "pairs", "times")
    rows = kept(rows, "rows")
    rare = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")) \
        .select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rare.join(counts.where(~often), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    zero = F.lit(0)
    return rows.join(rest, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", zero),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", zero)}) \
        .drop("row", "pairs", "times", "more_best", "more_sum")


def op13_token_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))
