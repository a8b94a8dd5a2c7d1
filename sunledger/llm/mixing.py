"""Mixing sources to target weights.

Every document gets a hash-random key; each source is cut into ranges of that key, sorted
inside a range, and the prefix sums of the token counts (sum inside the range plus the total
of the earlier ranges) say which documents fall inside the source's budget. A budget above
the size of the source takes whole epochs first.

* A null or empty text has size 0 and takes nothing; a null source is a source of its own and
  comes last; null ids are documents like any other.
* Repeated rows are separate documents; documents with equal keys are ordered by id and text
  hash, so that rows that still tie are equal and interchangeable.
* An empty table gives an empty table. Extra columns pass through; a column that clashes with
  a result is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, aside, kept, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
RESULT = ("size", "source_size", "target", "taken")


def ordered_sources(sources: DataFrame) -> DataFrame:
    """Number the sources 0, 1, ... by code point, null last, sorted in ranges."""
    order = F.col("_source").asc_nulls_last()
    numbered = kept(sources.repartitionByRange(order).sortWithinPartitions(order)
                    .withColumn("_at", F.monotonically_increasing_id()), "sources")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (numbered.join(starts, "_part")
            .withColumn("_rank", F.col("_start") + inside).drop("_part", "_start", "_at"))


def water_level(sources: DataFrame) -> float:
    """Words a unit of weight gets when what exceeds a source's cap is shared again by weight.

    Only sums leave the executors. Each round caps at least one more source or is the last.
    """
    level, capped = 0.0, -1
    while True:
        full = F.col("_weight") * F.lit(level) >= F.col("_cap")
        if capped < 0:
            full = F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("free"),
            F.sum(full.cast("long")).alias("capped")).first()
        if row["capped"] == capped or not row["total"] or not row["free"]:
            return level
        level, capped = (row["total"] - row["fixed"]) / row["free"], row["capped"]


def targets(docs: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row per source: size, rows and target."""
    sources = docs.groupBy("_source").agg(F.sum("size").alias("source_size"),
                                          F.count(F.lit(1)).alias("_rows"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = kept(ordered_sources(sources).withColumns({
        "_weight": F.get(cycle, (F.col("_rank") % len(weights)).cast("int")),
        "_cap": F.col("source_size") * F.lit(float(max_epochs))}), "weights")
    level = water_level(sources)
    return sources.select("_source", "source_size", "_rows", F.least(
        F.col("_cap"), F.col("_weight") * F.lit(level)).alias("target"))


def _placed(docs: DataFrame, size: Column | None, seed: int) -> tuple[DataFrame, dict[str, str], str]:
    """Rows with ``_size, _source, _key, _tie`` beside the columns, whose names meet no other."""
    counted = unused(docs, "_size")
    size = F.regexp_count("text", F.lit(WORD)) if size is None else size
    rows, names = aside(docs.withColumn(counted, F.coalesce(size, F.lit(0)).cast("long")),
                        "doc_id", "text", "source")
    return rows.withColumns({
        "_size": F.col(names[counted]), "_source": F.col("source"),
        "_key": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11),
        "_tie": F.xxhash64("text", F.lit(seed))}), names, counted


def mix_plan(narrow: DataFrame, weights: Sequence[float], max_epochs: int, rows_per_range: int) -> DataFrame:
    """One row per source: its size and target, the epochs that all its rows get, and the row at which
    one epoch more ends: its place, what the rows before it hold, and how often it stands there."""
    by_source = kept(targets(narrow.withColumnRenamed("_size", "size"), weights, max_epochs), "targets")
    budget = F.least(F.col("source_size") * max_epochs, F.floor(F.col("target") + 0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = by_source.withColumns({"_epochs": epochs, "_ranges": F.ceil(F.col("_rows") / rows_per_range)}) \
        .withColumn("_rest", budget - F.col("_epochs") * F.col("source_size")).withColumnRenamed("_source", "_of")
    rows = narrow.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_range", F.floor(F.col("_key") / F.lit(float(1 << 53)) * F.col("_ranges")))
    earlier = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_of", "_range", "_rest").agg(F.sum("_size").alias("_in")).withColumn(
        "_start", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    last = kept(ranges.where("_start <= _rest AND _rest < _start + _in").select(
        F.col("_of").alias("_cut_of"), F.col("_range").alias("_cut_range"), "_start"), "cuts")
    inside = (Window.partitionBy("_of", "_range").orderBy("_key", "doc_id", "_tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    place = F.struct("_key", "doc_id", "_tie")
    own = rows.join(last, F.col("_of").eqNullSafe(F.col("_cut_of")) & (F.col("_range") == F.col("_cut_range")))
    before = F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    own = own.select("_of", "_rest", "_size", place.alias("_cut"), before.alias("_before"))
    cuts = own.groupBy("_of", "_rest", "_cut", "_size").agg(
        F.min("_before").alias("_before"), F.count(F.lit(1)).alias("_copies")).where(
        "_before <= _rest AND _rest < _before + _size * _copies")
    cuts = cuts.select(F.col("_of").alias("_cut_of"), "_cut", "_before", "_copies")
    return kept(plan.join(cuts, F.col("_of").eqNullSafe(F.col("_cut_of")), "left")
                .drop("_cut_of", "_ranges", "_rows"), "plan")


def taken_by(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the columns of the plan and ``taken``. Only rows that are repeated at a cut are
    numbered; they are equal in id and text, so it does not matter which of them is whole."""
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")))
    place = F.struct("_key", "doc_id", "_tie")
    whole = F.col("_epochs") * F.col("_size")

    def at_cut(copy: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before") - copy * F.col("_size")))

    side = F.when(F.col("_cut").isNull(), F.lit(1)).when(place < F.col("_cut"), -1).when(place == F.col("_cut"), 0).otherwise(1)
    extra = F.when(side < 0, F.col("_size")).when(side > 0, F.lit(0)).otherwise(at_cut(F.lit(0)))
    if plan.where("_copies > 1").isEmpty():
        return rows.withColumn("taken", (whole + extra).cast("long"))
    repeated = (side == 0) & (F.col("_copies") > 1)
    alone = rows.where(~repeated).withColumn("taken", (whole + extra).cast("long"))
    copy = F.row_number().over(Window.partitionBy("_of").orderBy("_key")) - 1
    return alone.unionByName(rows.where(repeated).withColumn("_n", copy).withColumn(
        "taken", (whole + at_cut(F.col("_n"))).cast("long")).drop("_n"))


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS,
        max_epochs: int = 3, seed: int = 42, rows_per_range: int = 10_000) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, taken``.

    Sizes, keys and sources are written once; prefix sums and cuts work on those alone, and the
    documents stay where they are.
    """
    rows, names, counted = _placed(docs, size, seed)
    narrow = kept(rows.select("doc_id", "_source", "_size", "_key", "_tie"), "narrow")
    plan = mix_plan(narrow, weights, max_epochs, rows_per_range)
    carried = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in RESULT and c != counted]
    return taken_by(rows, plan).select(*carried, F.col("_size").alias("size"), "source_size", "target", "taken")


def op5_mix_sources(spark, sf_dir):
    rows, _, _ = _placed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), None, 42)
    narrow = kept(rows.select("doc_id", "_source", "_size", "_key", "_tie"), "narrow")
    mixed = taken_by(narrow, mix_plan(narrow, WEIGHTS, 3, 10_000))
    return mixed.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")
