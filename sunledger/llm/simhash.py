"""SimHash near-duplicates by a binary-trie self-join.

The fingerprint of a document has a bit where more than half of its word shingles have it in
their hash. Fingerprints that differ in few bits are found by walking pairs of trie nodes
together: a pair of nodes at a depth carries the bits in which their paths differ, descends to
the pairs of children, and is dropped as soon as the difference exceeds what is allowed.

Two tries share the work. With at most ``2 e + 1`` differing bits one half of the bits differs
in at most ``e``, so one trie starts with the upper half and the other with the lower half; in
the first half of its path each allows ``e`` bits only, below that the whole budget. The top
levels of a trie are dealt to tasks: a block is a node of depth ``top``, fingerprints travel to
the blocks whose path is within ``e`` bits of their own. A node pair is a pair of ranges of the
sorted fingerprints. A block returns a spanning forest of its links, not all pairs, and only
different fingerprints take part, so a group of copies of any size is one row.

* A null or empty text has fingerprint zero and is linked like any other. One row per document,
  repeated rows included. A null id is kept and is never a component id unless all ids of the
  component are null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import aside, kept, raw, record_batch, small_side, table, unused
from .components import components

SHINGLE, BITS = 3, 3
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if len(words) <= shingle:
        joined = [b" ".join(words)] if words else []
    else:
        joined = [b" ".join(s) for s in zip(*[words[i:] for i in range(shingle)])]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64, len(joined))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(hashes: np.ndarray, block: int = 65_536) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at:at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, th, fp``: hash of the text, and the fingerprint as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            fps = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield record_batch({"doc_id": ids, "th": batch.column("th"), "fp": fps}, pa.schema(
                [("doc_id", ids.type), ("th", pa.int64()), ("fp", pa.int64())]))

    return docs.select("doc_id", F.xxhash64("text").alias("th"), raw("text").alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, th bigint, fp bigint")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def node_pairs(a: np.ndarray, b: np.ndarray, top: int, half: int, budget: int,
               leaf: int = 16, same: bool = False):
    """Index pairs of two sorted runs of fingerprints within ``budget`` differing bits.

    Each run is the content of one trie node of depth ``top``. Yields arrays of positions;
    with ``same`` (both runs are one) each pair comes once.
    """
    spent = int(_ones((a[:1] ^ b[:1]) >> np.uint64(64 - top))[0]) if top else 0
    live = np.array([[0, len(a), 0, len(b), spent]], np.int64)
    for depth in range(top, 65):
        limit = half if depth <= 32 else budget
        live = live[live[:, 4] <= limit]
        small = np.minimum(live[:, 1] - live[:, 0], live[:, 3] - live[:, 2]) <= leaf
        if depth == 64:
            small[:] = True
        for a0, a1, b0, b1, _ in live[small]:
            x, y = a[a0:a1], b[b0:b1]
            rest = x[:, None] ^ y[None, :]
            near = (_ones(rest) <= budget) & (_ones(rest >> np.uint64(32)) <= half)
            i, j = np.nonzero(near)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        live = live[~small]
        if not len(live):
            return
        bit = np.uint64(1) << np.uint64(63 - depth)
        cuts = []
        for run, lo, hi in ((a, live[:, 0], live[:, 1]), (b, live[:, 2], live[:, 3])):
            # first position in each range that has the bit: ranges are sorted and share a path
            path = (run[lo] >> np.uint64(64 - depth) << np.uint64(64 - depth)) if depth else \
                np.zeros(len(lo), np.uint64)
            cuts.append(np.clip(np.searchsorted(run, path | bit), lo, hi))
        children = []
        for x in (0, 1):
            for y in (0, 1):
                a0, a1 = (live[:, 0], cuts[0]) if x == 0 else (cuts[0], live[:, 1])
                b0, b1 = (live[:, 2], cuts[1]) if y == 0 else (cuts[1], live[:, 3])
                child = np.stack([a0, a1, b0, b1, live[:, 4] + (x != y)], 1)
                keep = (a1 > a0) & (b1 > b0)
                if same:  # of two nodes of one run, the pair in order is enough
                    keep &= a0 <= b0
                children.append(child[keep])
        live = np.concatenate(children)


class Forest:
    """Union-find over positions; tells which links join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _turned(fp: np.ndarray, low_first: bool) -> np.ndarray:
    """Bits in the order of the trie's path."""
    return (fp << np.uint64(32)) | (fp >> np.uint64(32)) if low_first else fp


def block_links(home: np.ndarray, guests: np.ndarray, low_first: bool, top: int, half: int,
                budget: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a block and between its own and each guest path."""
    own = np.sort(_turned(home, low_first))
    far = np.sort(_turned(guests, low_first))
    nodes = np.concatenate([own, far])
    forest, links = Forest(len(nodes)), []
    starts = np.flatnonzero(np.concatenate(
        [[True], (far[1:] >> np.uint64(64 - top)) != (far[:-1] >> np.uint64(64 - top))])) \
        if len(far) else []
    runs = [(own, 0, True)] if len(own) else []
    runs += [(far[s:e], len(own) + s, False)
             for s, e in zip(starts, [*starts[1:], len(far)]) if len(own)]
    for other, shift, same in runs:
        for i, j in node_pairs(own, other, top, half, budget, same=same):
            links += [(x, y + shift) for x, y in zip(i.tolist(), j.tolist())
                      if forest.join(x, y + shift)]
    back = _turned(nodes, low_first)
    return [(back[x], back[y]) for x, y in links]


def near_links(fps: DataFrame, bits: int = BITS, per_block: int = 20_000) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``bits`` bits into their components.

    ``fps`` has one column ``fp`` of different values.
    """
    half = (bits - 1) // 2
    if 2 * half + 1 < bits:
        half += 1
    n = fps.count()
    top = min(24, max(0, (max(1, n) // per_block).bit_length()))
    turned = F.struct(F.lit(False).alias("low"), F.col("fp").alias("path")), F.struct(
        F.lit(True).alias("low"), F.shiftleft("fp", 32).bitwiseOR(
            F.shiftrightunsigned("fp", 32)).alias("path"))
    rows = fps.select("fp", F.explode(F.array(*turned)).alias("t")).select(
        "fp", "t.low", (F.shiftrightunsigned("t.path", 64 - top) if top else F.lit(0))
        .cast("long").alias("node"))
    # guests go to smaller nodes only, so that each pair of nodes meets in one block
    flips = [F.lit(0)]
    for r in range(1, half + 1):
        for at in _choose(top, r):
            flips.append(F.lit(sum(1 << i for i in at)))
    rows = rows.withColumn("flip", F.explode(F.array(*[f.cast("long") for f in flips])))
    rows = rows.withColumn("block", F.col("node").bitwiseXOR(F.col("flip"))) \
        .where("block <= node").select("low", "block", "fp", (F.col("flip") == 0).alias("home"))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        links = block_links(fp[home], fp[~home], key[0].as_py(), top, half, bits)
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("low", "block").applyInArrow(run, "a bigint, b bigint")


def _choose(n: int, r: int):
    from itertools import combinations
    return combinations(range(n), r)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS,
                    per_block: int = 20_000) -> DataFrame:
    """``doc_id, th, fp, component_id, root``: the smallest id reachable over links, per document;
    rows of one component share the root."""
    marked = kept(fingerprints(docs, shingle), "fingerprints")
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = kept(components(near_links(distinct.select("fp"), bits, per_block)), "roots")
    linked = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of every component, all columns: see ``survivors``."""
    return survivors(docs, near_duplicates(docs.select("doc_id", "text"), shingle, bits))


def survivors(docs: DataFrame, found: DataFrame, nulls_first: bool = False) -> DataFrame:
    """One row of ``docs`` of every component; ``found`` has ``doc_id, th, root`` of each row.

    First by id, nulls last (or first), then by the hash of the text, then by the hash of the whole row.
    Rows equal in all of these are the same row, so any of them may stand for the others and a
    task that is run again gives the same result.
    """
    texts = found.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    texts = kept(texts.withColumn("place", F.struct((F.col("doc_id").isNull() != F.lit(nulls_first)).alias("last"),
                                                    "doc_id", "th")), "texts")
    first = kept(texts.groupBy("root").agg(F.min("place").alias("first")), "first")
    judged = kept(texts.join(first, "root").select(
        F.col("doc_id").alias("_of_id"), F.col("th").alias("_of_th"), "rows",
        (F.col("place") == F.col("first")).alias("stays")), "judged")
    rows, names = aside(docs, "doc_id", "text")
    here = F.xxhash64("text")

    def of(frame: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        chosen = small_side(chosen.select("_of_id", "_of_th"))
        return frame.join(chosen, frame["doc_id"].eqNullSafe(chosen["_of_id"])
                          & here.eqNullSafe(chosen["_of_th"]), how)

    left = of(rows, judged.where("NOT stays"), "left_anti")
    again = judged.where("stays AND rows > 1")
    if not again.isEmpty():
        hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
        many = of(rows, again, "left_semi").select(
            "doc_id", here.alias("th"), F.xxhash64(*hashed).alias("h"), F.struct("*").alias("row"))
        one = many.groupBy("doc_id", "th").agg(F.min_by("row", "h").alias("row")).select("row.*")
        left = of(left, again, "left_anti").unionByName(one)
    return left.select(*[F.col(c).alias(old) for old, c in names.items()])


def op2_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
