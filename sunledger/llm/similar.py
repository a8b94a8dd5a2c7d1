"""Near-duplicate documents for the pipeline: SimHash first, MinHash bands for what it leaves.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is 0.8 or
more, and every link is verified on the whole sets. Candidates come from two places: fingerprints of
five-word shingles within three bits, by the trie join of ``simhash``, and equal bands of minima (25
bands of 5). Three bits find copies with few changes; a pair at similarity 0.8 differs in about ten
bits, and shares a band with probability 0.99995. Passages that many documents share do not
make them meet: two documents that share a fifth of their shingles meet in a band once in 125 pairs.

Members of a band are first compared with two of them, one for the whole group and one by a hash of
band and set; after that only pairs of different components that still share a band are compared, all of
them. A pair whose equal minima (of 125, 16 bits each) are fewer than 0.65, over four deviations below 0.8,
or whose sizes rule 0.8 out, is dropped before texts travel, so texts travel for near-duplicates only.

With ``originals`` a document is judged twice. First by its text there (same id, language, source and size,
unique on both sides; by its own text otherwise): line dedup leaves a near copy only the lines that differ,
and fragments are no longer similar. Then those that stay are judged by their own texts, what line dedup left
of them. One after the other, not as links of one graph: copies of different documents may be left with
the same text, often none, and would tie the documents together of which they are copies.

* Sets that are equal are one node (64 bits of hash). Texts of fewer than five words have one
  shingle, texts without words (null and empty ones too) have the same empty set.
* Words are cut and folded as for the fingerprints of ``simhash``. Texts of any length are read whole, in
  blocks of shingles. Ties, repeated rows, null ids: see ``simhash.survivors``. Extra columns may have any
  name. An empty table gives an empty table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import aside, kept, raw, record_batch, small_side
from .components import components
from .simhash import fingerprint, near_links, shingle_hashes, survivors

SHINGLE, SIMILARITY, BITS = 5, 0.8, 3
BANDS, WIDTH = 25, 5
LEAST_SHARE = 0.65
BLOCK = 4096


def _factors(many: int) -> np.ndarray:
    """Odd multipliers, one an order of the shingles."""
    return np.random.default_rng(7).integers(0, 1 << 63, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product of every factor with any hash, modulo 2^64."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at:at + BLOCK, None] * factors).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns but ``text``, and ``th, sig, n, fp, marks, bands``: hash of the text, hash and size
    of its set, fingerprint, low bits of the minima, and one key per band."""
    rest = [c for c in docs.columns if c != "text"]
    factors = _factors(BANDS * WIDTH)

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("sig", "n", "fp", "marks", "bands")}
            for text in batch.column("text").to_pylist():
                every = shingle_hashes(text, shingle)
                row = np.unique(every)
                least = minima(row, factors)
                out["sig"].append(xxhash.xxh64_intdigest(row.tobytes(), 42) - (1 << 63))
                out["n"].append(len(row))
                out["fp"].append(fingerprint(every))
                out["marks"].append(least.astype(np.uint16).tobytes())
                out["bands"].append([xxhash.xxh64_intdigest(part.tobytes(), at) - (1 << 63) for at, part in
                                     enumerate(least.reshape(BANDS, WIDTH))] if len(row) else [])
            fps = np.array(out.pop("fp"), np.uint64).view(np.int64)
            fields = [*[batch.schema.field(c) for c in rest], pa.field("th", pa.int64())]
            yield record_batch(
                {**{f.name: batch.column(f.name) for f in fields}, "fp": fps, **out},
                pa.schema([*fields, ("fp", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()),
                           ("marks", pa.binary()), ("bands", pa.list_(pa.int64()))]))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")
    return docs.select(*rest, F.xxhash64("text").alias("th"), raw("text").alias("text")).mapInArrow(
        run, f"{kinds}th bigint, fp bigint, sig bigint, n int, marks binary, bands array<bigint>")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fingerprint_pairs(sets: DataFrame, bits: int = BITS) -> DataFrame:
    """Sets within some bits of each other: every set with the first of its fingerprint, and the
    first ones of linked fingerprints."""
    first = kept(sets.groupBy("fp").agg(F.min("sig").alias("lead")), "leads")
    equal = sets.join(first, "fp").select(F.col("sig").alias("x"), F.col("lead").alias("y"))
    links = near_links(first.select("fp"), bits).toDF("p", "q")
    near = links.join(first.toDF("p", "x"), "p").join(first.toDF("q", "y"), "q").select("x", "y")
    return equal.union(near)


def likely(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs that sizes and minima do not rule out."""
    num, den = Fraction(str(similarity)).as_integer_ratio()
    need = int(LEAST_SHARE * BANDS * WIDTH)

    def run(batches):
        for batch in batches:
            equal = [np.count_nonzero(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))
                     for x, y in zip(batch.column("marks").to_pylist(), batch.column("marks_").to_pylist())]
            mask = pa.array(np.array(equal) >= need)
            yield record_batch({c: batch.column(c).filter(mask) for c in ("a", "b")},
                               pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    own = sets.select("sig", "n", "marks")
    both = pairs.join(own.toDF("a", "n", "marks"), "a").join(own.toDF("b", "n_", "marks_"), "b")
    return both.where(F.least("n", "n_") * den >= F.greatest("n", "n_") * num) \
        .select("a", "b", "marks", "marks_").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, shingle: int = SHINGLE,
             similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs of sets whose similarity is large enough, by their whole sets."""
    num, den = Fraction(str(similarity)).as_integer_ratio()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    need = kept(sets.select("sig", "th").join(ends, "sig", "left_semi"), "need")
    held = kept(texts.select(F.xxhash64("text").alias("th"), raw("text").alias("text"))
                .join(small_side(need), "th").groupBy("sig").agg(F.first("text").alias("text")), "texts")

    def run(batches):
        for batch in batches:
            good, last = [], {}
            for a, x, b, y in zip(*[batch.column(c).to_pylist() for c in ("a", "x", "b", "y")]):
                last = {k: last[k] if k in last else np.unique(shingle_hashes(t, shingle))
                        for k, t in ((a, x), (b, y))}
                both = len(np.intersect1d(last[a], last[b], assume_unique=True))
                good.append(both * den >= num * (len(last[a]) + len(last[b]) - both))
            mask = pa.array(good, pa.bool_())
            yield record_batch({c: batch.column(c).filter(mask) for c in ("a", "b")},
                               pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    full = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return full.select("a", "x", "b", "y").mapInArrow(run, "a bigint, b bigint")


def linked_sets(sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE,
                similarity: float = SIMILARITY) -> DataFrame | None:
    """``node, root`` of the sets that have a link; None without any."""
    keys = sets.select("sig", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("sig").alias("hub"), F.min_by("sig", F.xxhash64("sig", "key")).alias("hub_"),
                                     F.count(F.lit(1)).alias("sets")).where("sets > 1")
    members = kept(keys.join(shared, "key").select("sig", "key", "hub", "hub_"), "members")
    stars = members.select(F.col("sig").alias("x"), F.explode(F.array("hub", "hub_")).alias("y"))
    first = kept(_pairs(stars.union(fingerprint_pairs(sets))), "pairs")
    found = kept(verified(kept(likely(first, sets, similarity), "likely"), texts, sets, shingle, similarity), "near")
    roots = None if found.isEmpty() else kept(components(found), "roots")
    open_ = members.select("sig", "key", F.col("sig").alias("part")) if roots is None else \
        members.join(roots.toDF("sig", "root"), "sig", "left").select("sig", "key", F.coalesce("root", "sig").alias("part"))
    mixed = open_.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    open_ = kept(open_.join(mixed.select("key"), "key", "left_semi"), "open")
    met = open_.join(open_.toDF("sig_", "key", "part_"), "key").where("part < part_")
    rest = _pairs(met.select(F.col("sig").alias("x"), F.col("sig_").alias("y"))).join(first, ["a", "b"], "left_anti")
    rest = kept(likely(rest, sets, similarity), "rest")
    if not rest.isEmpty():
        found = kept(found.union(verified(rest, texts, sets, shingle, similarity)), "near")
        roots = None if found.isEmpty() else kept(components(found), "roots")
    return roots


def near_duplicates(docs: DataFrame, originals: DataFrame | None = None, shingle: int = SHINGLE,
                    similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, th, root``: hash of the own text, and the same root for all rows of a component."""
    told = ["doc_id", *[c for c in ("lang", "source", "n_chars") if c in docs.columns]]
    own, names = aside(docs, *told, "text")
    rows = own.select(*told, F.xxhash64("text").alias("own"))
    if originals is None or len(told) < 4:
        marked = kept(signatures(own.select("doc_id", "text")).withColumn("own", F.col("th")), "sets")
        texts = own.select("text")
    else:
        def alone(frame):
            return frame.groupBy(*told).agg(F.count(F.lit(1)).alias("rows"), F.first("own").alias("own")) \
                .where("rows = 1 AND doc_id IS NOT NULL").drop("rows")

        before = originals.select(*told, "text")
        match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in told]
        both = kept(alone(rows).alias("l").join(
            alone(before.select(*told, F.lit(0).alias("own"))).alias("r"), match, "left_semi"), "matched")
        marked = signatures(before).alias("l").join(both.alias("r"), match).select("l.*", "r.own")
        free = own.alias("l").join(small_side(both).alias("r"), match, "left_anti").select("doc_id", "text")
        texts = before.select("text")
        if both.count() < rows.count():
            free = kept(free, "free")
            marked = marked.drop(*told[1:]).unionByName(signatures(free).withColumn("own", F.col("th")))
            texts = texts.union(free.select("text"))
        marked = kept(marked.drop(*told[1:]), "sets")
    sets = kept(marked.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "fp", "marks", "bands")],
                                          F.min("th").alias("th")), "distinct")
    roots = linked_sets(sets, texts, shingle, similarity)
    found = marked.select("doc_id", "own", F.col("sig").alias("root")) if roots is None else \
        marked.join(roots.toDF("sig", "root"), "sig", "left").select(
            "doc_id", "own", F.coalesce("root", "sig").alias("root"))
    found = kept(found, "found")
    return found.select("doc_id", F.col("own").alias("th"), "root")


def one_of_each(docs: DataFrame, originals: DataFrame | None = None, shingle: int = SHINGLE,
                similarity: float = SIMILARITY) -> DataFrame:
    """One row of every component, all columns: see ``simhash.survivors``. With ``originals`` null ids come
    first, as in line dedup: of equal lines it leaves those of the document that stays here; and of those that
    stay by the originals, one of every component of their own texts stays."""
    left = survivors(docs, near_duplicates(docs, originals, shingle, similarity), originals is not None)
    if originals is None:
        return left
    left = kept(left, "left")
    return survivors(left, near_duplicates(left, None, shingle, similarity), True)
