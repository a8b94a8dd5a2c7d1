"""Exact top-k search with vector-approximation files.

Every component is an integer, ``floor(256 * x)``. A cell of ``2 ** bits`` equal slices per
dimension stands for a component; the file of cells is scanned against the queries, block by
block, for an upper and a lower bound of each inner product. Per query, the k-th best lower
bound of a block already rules out every vector whose upper bound is smaller; the k-th best
over all blocks rules out more. Exact vectors are read for the rest alone, best bound first,
until no bound left can reach the k-th exact score.

Copies do not pile up: of equal vectors only the k + 1 smallest ids can be among the k best of
any query (one of them may be the query itself), so only they enter the file. A query with many
candidates reads them in several groups, each until its own k best are certain, and the groups'
results are ranked together.

* Vectors that are null, or hold a null or non-finite component, and rows without an id take
  no part. Of rows that share an id the smallest vector is taken. Vectors are compared with
  those of their own length. Equal scores are ordered by id. Fewer candidates than k give all.
* An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import kept, record_batch, table

BITS = 6


def whole_components(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v`` (array of bigint), one row per id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long"))
                       .alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def without_copies(vectors: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the ``most`` smallest ids; each map task keeps no more than that."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def slices(vectors: DataFrame, bits: int) -> DataFrame:
    """Per length and dimension, where the cells start and how wide they are."""
    spread = (vectors.select(F.size("v").alias("dim"), F.posexplode("v").alias("at", "c"))
              .groupBy("dim", "at").agg(F.min("c").alias("low"), F.max("c").alias("high")))
    spread = spread.withColumn("width", F.floor((F.col("high") - F.col("low")) / (1 << bits)) + 1)
    listed = F.sort_array(F.collect_list(F.struct("at", "low", "width")))
    return spread.groupBy("dim").agg(listed.alias("s")).select(
        "dim", F.col("s.low").alias("low"), F.col("s.width").alias("width"))


def approximations(vectors: DataFrame, bounds: DataFrame) -> DataFrame:
    """The file of cells: one small integer per component."""
    cells = F.transform(F.arrays_zip("v", "low", "width"), lambda z: F.floor(
        (z["v"] - z["low"]) / z["width"]).cast("int"))
    return (vectors.withColumn("dim", F.size("v")).join(bounds, "dim")
            .select("vec_id", "dim", cells.alias("cells"), "low", "width", "v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _bounded(k: int):
    """Candidates of one block of queries in one block of cells.

    A bound is the product with the middle of the cell plus or minus half the width of the
    cell times the query; with whole widths the half step is exact in doubles.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()),
                        ("lower", pa.float64()), ("upper", pa.float64())])

    def block(key, queries: pa.Table, cells: pa.Table) -> pa.Table:
        if not queries.num_rows or not cells.num_rows:
            return schema.empty_table()
        low, width = (np.array(cells.column(c)[0].as_py(), float) for c in ("low", "width"))
        middle = _matrix(cells.column("cells"), cells.num_rows) * width + low + (width - 1) / 2
        q = _matrix(queries.column("v"), queries.num_rows)
        slack = np.abs(q) @ ((width - 1) / 2)
        ids = cells.column("vec_id").to_numpy()
        out = []
        for name, row, room in zip(queries.column("vec_id").to_numpy(), q, slack):
            centre = middle @ row
            centre[ids == name] = -np.inf
            kth = np.partition(centre, -k)[-k] if len(centre) > k else -np.inf
            # one unit of room for rounding, which whole scores never need
            near = np.flatnonzero((centre + room >= kth - room - 1) & (centre > -np.inf))
            out.append((np.full(len(near), name), ids[near], centre[near] - room - 1,
                        centre[near] + room + 1))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                    schema=schema)
    return block


def candidates(vectors: DataFrame, queries: Column, k: int, bits: int = BITS,
               query_rows: int = 2048, cell_rows: int = 4096) -> DataFrame:
    """``query_id, vec_id, lower, upper`` of every vector that the bounds do not rule out."""
    file = kept(approximations(without_copies(vectors, k + 1), slices(vectors, bits)), "cells")
    asked = vectors.where(queries).withColumn("dim", F.size("v"))
    n_asked, n = asked.count(), file.count()
    query_blocks, cell_blocks = -(-n_asked // query_rows) or 1, -(-n // cell_rows) or 1

    def block_of(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = asked.select("vec_id", "v", "dim", block_of(query_blocks).alias("qb"),
                        every(cell_blocks).alias("cb"))
    right = file.select("vec_id", "cells", "low", "width", "dim",
                        block_of(cell_blocks).alias("cb"), every(query_blocks).alias("qb"))
    keys = ("dim", "qb", "cb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _bounded(k), "query_id bigint, vec_id bigint, lower double, upper double")


def _until_certain(k: int):
    """Read exact vectors by falling upper bound and stop when the k-th score is certain."""
    def read(key, group: pa.Table, asked: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _SCORED.empty_table()
        order = np.lexsort((group.column("vec_id").to_numpy(), -group.column("upper").to_numpy()))
        upper = group.column("upper").to_numpy()[order]
        ids = group.column("vec_id").to_numpy()[order]
        q, vectors = asked.column("q")[0].as_py(), group.column("v")
        best: list[tuple[int, int]] = []
        for at, (bound, vec) in enumerate(zip(upper, ids)):
            if len(best) == k and bound < -best[-1][0]:
                break
            v = vectors[int(order[at])].as_py()
            best = sorted([*best, (-sum(a * b for a, b in zip(q, v)), int(vec))])[:k]
        return pa.Table.from_batches([record_batch({
            "query_id": [key[0].as_py()] * len(best), "vec_id": [v for _, v in best],
            "score": [-s for s, _ in best]}, _SCORED)])
    return read


_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, rows_per_read: int = 500,
          **blocks: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query."""
    whole = kept(whole_components(vectors), "vectors")
    near = kept(candidates(whole, queries, k, **blocks), "candidates")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    floor = (near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k)
             .select("query_id", F.col("lower").alias("_floor")))
    reads = near.groupBy("query_id").agg(
        F.ceil(F.count(F.lit(1)) / rows_per_read).alias("_reads"))
    reads = kept(reads.join(floor, "query_id", "left"), "reads")
    near = (near.join(reads, "query_id")
            .where(F.col("_floor").isNull() | (F.col("upper") >= F.col("_floor")))
            .select("query_id", "vec_id", "upper",
                    F.pmod(F.xxhash64("vec_id"), F.col("_reads")).alias("_read")))
    asked = whole.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(
        reads.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_reads") - 1))
                     .alias("_read")), "query_id")
    # the vector of a query travels once for each of its reads
    keys = ("query_id", "_read")
    scored = near.join(whole, "vec_id").groupBy(*keys).cogroup(
        asked.groupBy(*keys)).applyInArrow(
            _until_certain(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op8_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
