"""Substring dedup by level-wise doubling.

A window of ``window`` words is repeated when its words also start somewhere else. Three levels,
each about twice as long as the one before (9, 18 and 35 words): only positions whose seed
(lowest level) is repeated are looked at one level up, and only those that are repeated there
are compared as whole windows.

A window is filed under the smallest-hashed of the seeds inside it. Equal windows choose equal
seeds, so all levels of a seed are decided in the one bucket that holds it and rows are shuffled
once, whatever the number of levels. What travels is one run per seed: the windows filed under
it (a hash each), the hashes of the two double-length windows that start or end at it, and where
they are.

Frequent text does not pile up. Runs that are equal within a batch are sent once, marked as
repeated. A seed that occurs very often (counted over all documents first) is not used as an
address: its windows are dealt by their own hash, one by one.

* A null or empty text has no words. Documents with fewer words than a window keep all of them.
  Windows never cross documents; repeated rows are separate documents and repeat each other.
* One row per row of the input; null ids are kept. Extra columns are not read.
* Words are compared through 64-bit hashes of words and windows, windows within a bucket through
  more than 96 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import kept, raw, record_batch, table

WINDOW = 35
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


class Words:
    """Hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Batch:
    """All windows of the documents of one batch, and the seed each is filed under."""

    def __init__(self, texts: list[bytes], words: Words, window: int):
        self.window, self.half = window, -(-window // 2)
        self.seed = -(-self.half // 2)
        split = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.ends = np.cumsum(self.sizes)
        h1 = np.concatenate([words(w) for w in split]) if split else np.zeros(0, np.uint64)
        fits = self.sizes - window + 1
        docs = np.repeat(np.arange(len(split)), np.maximum(fits, 0))
        offsets = np.arange(len(docs)) - np.repeat(np.cumsum(np.maximum(fits, 0))
                                                   - np.maximum(fits, 0), np.maximum(fits, 0))
        self.doc, self.offset = docs, offsets
        self.at = (self.ends - self.sizes)[docs] + offsets
        if not len(docs):
            return
        self.h_seed = self._of_length(h1, self.seed)
        self.h_half = self._double(self.h_seed, self.seed, self.half)
        self.h_full = _mix(self._double(self.h_half, self.half, window))
        self.h_seed, self.h_half = _mix(self.h_seed), _mix(self.h_half)
        self.owner = self._smallest(window - self.seed + 1)[self.at]

    @staticmethod
    def _double(h: np.ndarray, length: int, target: int) -> np.ndarray:
        """From windows of ``length`` to windows of ``target`` (at most twice as long)."""
        shift = target - length
        return h[:len(h) - shift] * _BASE + _mix(h[shift:])

    def _of_length(self, h: np.ndarray, target: int) -> np.ndarray:
        length = 1
        while length < target:
            longer = min(target, 2 * length)
            h, length = self._double(h, length, longer), longer
        return h

    def _smallest(self, span: int) -> np.ndarray:
        """Position of the leftmost smallest seed among ``span`` from each position on."""
        best, length = np.arange(len(self.h_seed)), 1
        while length < span:
            longer = min(span, 2 * length)
            shift = longer - length
            left, right = best[:len(best) - shift], best[shift:]
            best = np.where(self.h_seed[right] < self.h_seed[left], right, left)
            length = longer
        return best

    def runs(self, frequent: np.ndarray):
        """Stretches of consecutive windows of one document under one seed."""
        key = self.h_seed[self.owner]
        often = np.isin(key, frequent)
        key = np.where(often, _mix(key ^ self.h_full[self.at]), key)
        new = np.ones(len(self.at), bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (self.doc[1:] != self.doc[:-1]) | often[1:]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(self.at)))
        return key[first], first, count

    def seeds(self) -> np.ndarray:
        """The seeds in use, one for each place."""
        return self.h_seed[np.unique(self.owner)] if len(self.at) else np.zeros(0, np.uint64)


def seed_counts(docs: DataFrame, window: int) -> DataFrame:
    """``seed, n``: seeds that a task met twice or more; seed null: all places."""
    def count(batches):
        words, met = Words(), []
        for batch in batches:
            met.append(Batch(batch.column("text").to_pylist(), words, window).seeds())
        met = np.concatenate(met) if met else np.zeros(0, np.uint64)
        seed, n = np.unique(met, return_counts=True)
        seeds = pa.array(seed[n > 1].view(np.int64).tolist() + [None], pa.int64())
        yield record_batch({"seed": seeds, "n": [*n[n > 1].tolist(), len(met)]},
                           pa.schema([("seed", pa.int64()), ("n", pa.int64())]))

    rows = docs.select(raw("text").alias("text")).mapInArrow(count, "seed bigint, n bigint")
    return rows.groupBy("seed").agg(F.sum("n").alias("n"))


#: columns of a bucket's row: packed arrays, one element for each run (or, for full, window)
_PACKED = {"key": "u8", "k1": "i8", "k2": "i8", "start": "u4", "back": "u1", "count": "u1",
           "left": "u4", "right": "u4", "state": "u1", "full": "u4"}
_LONE, _MANY, _KNOWN = 0, 1, 2


def filed(docs: DataFrame, frequent: np.ndarray, buckets: int, window: int) -> DataFrame:
    """One row per batch and bucket with the runs that belong there."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def pack(batches):
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _PACKED)])
        words = Words()
        for batch in batches:
            b = Batch(batch.column("text").to_pylist(), words, window)
            if not len(b.at):
                continue
            key, first, count = b.runs(shipped.value)
            at, owner = b.at[first], b.owner[first]
            full = b.h_full[b.at]
            last = full[first + count - 1]
            mark = _mix(full[first] * _BASE + last) + count.astype(np.uint64)
            _, rep, same, n = np.unique(mark, return_index=True, return_inverse=True,
                                        return_counts=True)
            state = np.full(len(first), _KNOWN, np.uint8)
            state[rep] = np.where(n > 1, _MANY, _LONE)
            ends, starts = b.ends[b.doc[first]], (b.ends - b.sizes)[b.doc[first]]
            before, after = owner - (b.half - b.seed), owner
            left = np.where(before >= starts, b.h_half[np.maximum(before, 0)], 0)
            right = np.where(after + b.half <= ends,
                             b.h_half[np.minimum(after, len(b.h_half) - 1)], 0)
            k1, k2 = (batch.column(c).to_numpy()[b.doc[first]] for c in ("k1", "k2"))
            columns = {"key": key, "k1": k1, "k2": k2, "start": b.offset[first],
                       "back": owner - at, "count": count, "left": left >> np.uint64(32),
                       "right": right >> np.uint64(32), "state": state}
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out: dict[str, list] = {c: [] for c in schema.names}
            for own in np.split(order, cuts):
                out["bucket"].append(int(bucket[own[0]]))
                for c, values in columns.items():
                    out[c].append(values[own].astype(_PACKED[c]).tobytes())
                sent = own[state[own] != _KNOWN]
                spread = np.repeat(first[sent] - np.cumsum(count[sent]) + count[sent], count[sent]) \
                    + np.arange(count[sent].sum())
                out["full"].append((full[spread] >> np.uint64(32)).astype("u4").tobytes())
            yield record_batch(out, schema)

    return docs.mapInArrow(pack, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))


def _repeated(key: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice, or once in a run that stands for several."""
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    marked = np.zeros(len(n), bool)
    marked[at[many]] = True
    return (n[at] > 1) | marked[at]


def repeated_windows(window: int, homes: int):
    """Decide the levels of one bucket; word ranges that go, packed by home of the document."""
    half = -(-window // 2)
    seed = -(-half // 2)

    def decide(rows: pa.Table) -> pa.Table:
        c = {name: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
             for name, kind in _PACKED.items()}
        known = c["state"] == _KNOWN
        first = [c["start"][known].astype(np.int64)]
        last = [first[0] + c["count"][known]]
        owner = [np.flatnonzero(known)]
        run = np.flatnonzero(~known)
        size = c["count"][run].astype(np.int64)
        begin = np.cumsum(size) - size
        # seeds
        many = c["state"][run] == _MANY
        live = _repeated(c["key"][run], many)
        run, size, begin, many = run[live], size[live], begin[live], many[live]
        # twice the length, ending with the seed and starting with it
        key = c["key"][run]
        ok_left = _repeated(_mix(key + c["left"][run]), many)
        ok_right = _repeated(_mix(key + c["right"][run].astype(np.uint64) * _BASE), many)
        # whole windows
        of = np.repeat(np.arange(len(run)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        back = c["back"][run].astype(np.int64)[of] - step
        live = ((back < half - seed) | ok_left[of]) & ((back > window - half) | ok_right[of])
        of, step, back = of[live], step[live], back[live]
        name = _mix(key[of] + _mix(c["full"][begin[of] + step].astype(np.uint64)
                                   + (back.astype(np.uint64) << np.uint64(40))))
        hit = _repeated(name, many[of])
        of, step = of[hit], step[hit]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (step[1:] != step[:-1] + 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(of)) - 1
        start = c["start"][run].astype(np.int64)[of[head]] if len(head) else head
        first.append(start + step[head])
        last.append(start + step[tail] + 1 if len(head) else head)
        owner.append(run[of[head]] if len(head) else head)
        first, last, owner = map(np.concatenate, (first, last, owner))
        home = (c["k1"][owner].view(np.uint64) % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        out: dict[str, list] = {name: [] for name in _RANGES}
        for own in np.split(order, cuts) if len(order) else []:
            out["home"].append(int(home[own[0]]))
            for name, values in (("k1", c["k1"][owner[own]]), ("k2", c["k2"][owner[own]]),
                                 ("first", first[own]), ("last", last[own] - 1 + window)):
                out[name].append(values.astype("i8" if name[0] == "k" else "u4").tobytes())
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (
            pa.int32(), *[pa.binary()] * 4))], names=list(_RANGES))

    return decide


_RANGES = ("home", "k1", "k2", "first", "last")


def by_document(rows: pa.Table) -> pa.Table:
    """The word ranges that go of every document of one home, as first, last, first, last ..."""
    k1, k2 = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "i8") for c in ("k1", "k2"))
    first, last = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "u4").astype(np.int32)
                   for c in ("first", "last"))
    order = np.lexsort((first, k2, k1))
    k1, k2, ranges = k1[order], k2[order], np.stack([first[order], last[order]], 1).ravel()
    new = np.ones(len(order), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    cuts = np.append(2 * np.flatnonzero(new), len(ranges)).astype(np.int32)
    return pa.table({"k1": k1[new], "k2": k2[new],
                     "ranges": pa.ListArray.from_arrays(cuts, pa.array(ranges))})


def _without(batches):
    """Words, removed words and what is kept of every text, given its ranges."""
    for batch in batches:
        n_words, n_removed, left = [], [], []
        for text, ranges in zip(batch.column("text").to_pylist(),
                                batch.column("ranges").to_pylist()):
            words = text.split()
            n_words.append(len(words))
            if not ranges:
                n_removed.append(0)
                left.append(b" ".join(words))
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            pairs = np.array(ranges).reshape(-1, 2)
            np.add.at(edge, pairs[:, 0], 1)
            np.add.at(edge, pairs[:, 1], -1)
            stays = np.cumsum(edge[:-1]) == 0
            n_removed.append(int(len(words) - stays.sum()))
            left.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]))
        ids = batch.column("doc_id")
        yield record_batch({"doc_id": ids, "n_words": n_words, "n_removed": n_removed,
                            "kept": left}, pa.schema([
                                ("doc_id", ids.type), ("n_words", pa.int64()),
                                ("n_removed", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seeds_per_bucket: int = 300_000,
                   frequent_from: int = 20_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (UTF-8 of the kept words, joined by one space)."""
    rows = docs.select("doc_id", raw("text").alias("text"),
                       F.xxhash64("doc_id", "text").alias("k1"),
                       F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"))
    counts = kept(seed_counts(docs, window), "seeds")
    total = counts.where("seed IS NULL").agg(F.sum("n")).first()[0] or 0
    # at most 20,000 seeds can reach the limit, so the list stays small
    limit = max(frequent_from, total // 20_000)
    frequent = np.array([r["seed"] for r in counts.where(
        F.col("seed").isNotNull() & (F.col("n") >= limit)).toLocalIterator()],
        np.int64).view(np.uint64)
    buckets = max(1, -(-total // seeds_per_bucket))
    homes = 2 * buckets
    ranges = (filed(rows.select("text", "k1", "k2"), frequent, buckets, window)
              .groupBy("bucket").applyInArrow(
                  repeated_windows(window, homes),
                  "home int, k1 binary, k2 binary, first binary, last binary")
              .groupBy("home").applyInArrow(by_document,
                                            "k1 bigint, k2 bigint, ranges array<int>"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges").mapInArrow(
        _without, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")


def op3_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, p, md5(array_to_string(w[p:p + 34], ' ')) AS s
           FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
repeated AS (SELECT s FROM places GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM places SEMI JOIN repeated USING (s)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n
              FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""
