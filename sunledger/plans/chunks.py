"""Ordered computations over long series without putting a series into one task.

A series is cut into chunks of ``chunk_steps`` grid positions. Frames of bounded
reach get the neighbouring rows they need by copying them into the next chunk (a
halo). Unbounded lookups and prefix sums combine a per-chunk summary, which is
``chunk_steps`` times smaller than the data, with a window inside each chunk. Both
give exactly the result of one window per series, whatever share of the rows one
series holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

CHUNK_STEPS = 2048
CHUNK = "_chunk"
KEY = "_key"
Build = Callable[[WindowSpec], Mapping[str, Column]]


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters refer to but never recompute.

    A filter on a projected column is pushed below the projection with the column's
    whole expression copied into it; long expressions then multiply. A generated row of
    one keeps them as values.
    """
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def chunk_of(order: str, chunk_steps: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk_steps))


def halo(df: DataFrame, order: str, before: int, after: int,
         chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Every row once for each chunk that needs it: its own, and those that look ``before`` rows
    back or ``after`` rows ahead to it."""
    first = F.floor((F.col(order) - F.lit(after)) / F.lit(chunk_steps))
    last = F.floor((F.col(order) + F.lit(before)) / F.lit(chunk_steps))
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last)))


def over_halo(df: DataFrame, keys: Sequence[str], order: str, *builds: Build,
              before: int = 0, after: int = 0, chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` ahead.

    Each build sees the columns of the builds before it; the reach must cover the
    sum of the nested frames. ``order`` is an integer position, unique per key.
    """
    out = halo(df, order, before, after, chunk_steps)
    window = Window.partitionBy(*keys, CHUNK).orderBy(order)
    for build in builds:
        out = out.withColumns(dict(build(window)))
    return out.where(chunk_of(order, chunk_steps) == F.col(CHUNK)).drop(CHUNK)


def boxed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the keys into one struct. A struct is never null and equal structs may hold nulls,
    so joins and filters on it keep the rows whose keys are null."""
    return df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(0))).drop(*keys)


def unboxed(df: DataFrame, keys: Sequence[str], first: Sequence[str]) -> DataFrame:
    """Undo ``boxed``: the columns named in ``first``, keys among them, then all others."""
    names = {k.lower(): k for k in keys}
    rest = [c for c in df.columns if c != KEY and c not in first]
    return df.select(*[F.col(KEY)[names[c.lower()]].alias(c) if c.lower() in names else F.col(c)
                       for c in (*first, *rest)])


def carry(df: DataFrame, keys: Sequence[str], order: str,
          forward: Mapping[str, Column] | None = None,
          backward: Mapping[str, Column] | None = None, strict: bool = False,
          chunk_steps: int = CHUNK_STEPS, levels: int = 2) -> DataFrame:
    """Last known value at or before each row, and next known value at or after it.

    ``strict`` leaves the row itself out. With ``levels`` above one the summaries of the
    chunks are cut into chunks again, so that a long series is not one task there either.
    """
    near = 1 if strict else 0
    forward, backward = dict(forward or {}), dict(backward or {})
    local = boxed(df.withColumns({
        CHUNK: chunk_of(order, chunk_steps),
        **{f"_f_{n}": e for n, e in forward.items()},
        **{f"_b_{n}": e for n, e in backward.items()},
    }), keys)

    def known(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(order))

    edges = local.groupBy(KEY, CHUNK).agg(
        *[F.max_by(f"_f_{n}", known(f"_f_{n}")).alias(f"_f_{n}") for n in forward],
        *[F.min_by(f"_b_{n}", known(f"_b_{n}")).alias(f"_b_{n}") for n in backward])
    if levels > 1:
        edges = carry(edges.select(F.col(KEY).alias("_outer"), F.col(CHUNK).alias("_at"),
                                   *edges.columns[2:]), ["_outer"], "_at",
                      {f"_fin_{n}": F.col(f"_f_{n}") for n in forward},
                      {f"_bin_{n}": F.col(f"_b_{n}") for n in backward}, True,
                      min(chunk_steps, CHUNK_STEPS), levels - 1).withColumnsRenamed({"_outer": KEY, "_at": CHUNK})
        edges = edges.drop(*[f"_f_{n}" for n in forward], *[f"_b_{n}" for n in backward])
    else:
        chunks = Window.partitionBy(KEY).orderBy(CHUNK)
        earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
        later = chunks.rowsBetween(1, Window.unboundedFollowing)
        edges = edges.select(
            KEY, CHUNK,
            *[F.last(f"_f_{n}", True).over(earlier).alias(f"_fin_{n}") for n in forward],
            *[F.first(f"_b_{n}", True).over(later).alias(f"_bin_{n}") for n in backward])
    rows = Window.partitionBy(KEY, CHUNK).orderBy(order)
    upto = rows.rowsBetween(Window.unboundedPreceding, -near)
    onward = rows.rowsBetween(near, Window.unboundedFollowing)
    out = local.join(edges, [KEY, CHUNK]).withColumns({
        **{n: F.coalesce(F.last(f"_f_{n}", True).over(upto), F.col(f"_fin_{n}"))
           for n in forward},
        **{n: F.coalesce(F.first(f"_b_{n}", True).over(onward), F.col(f"_bin_{n}"))
           for n in backward},
    })
    out = out.drop(CHUNK, *[f"{p}{n}" for n in forward for p in ("_f_", "_fin_")],
                   *[f"{p}{n}" for n in backward for p in ("_b_", "_bin_")])
    return unboxed(out, keys, df.columns)


def running_sum(df: DataFrame, keys: Sequence[str], order: str,
                values: Mapping[str, Column], chunk_steps: int = CHUNK_STEPS,
                strict: bool = False, levels: int = 2) -> DataFrame:
    """Prefix sums along each key; ``strict`` leaves the row itself out.

    With ``levels`` above one the totals of the chunks are cut into chunks again.
    """
    local = boxed(df.withColumns({CHUNK: chunk_of(order, chunk_steps),
                                  **{f"_v_{n}": e for n, e in values.items()}}), keys)
    totals = local.groupBy(KEY, CHUNK).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    if levels > 1:
        totals = running_sum(totals.withColumnsRenamed({KEY: "_outer", CHUNK: "_at"}), ["_outer"],
                             "_at", {f"_s_{n}": F.col(f"_t_{n}") for n in values},
                             min(chunk_steps, CHUNK_STEPS), True, levels - 1).withColumnsRenamed({"_outer": KEY, "_at": CHUNK})
        totals = totals.drop(*[f"_t_{n}" for n in values])
    else:
        earlier = (Window.partitionBy(KEY).orderBy(CHUNK)
                   .rowsBetween(Window.unboundedPreceding, -1))
        totals = totals.select(
            KEY, CHUNK, *[F.sum(f"_t_{n}").over(earlier).alias(f"_s_{n}") for n in values])
    upto = (Window.partitionBy(KEY, CHUNK).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    out = local.join(totals, [KEY, CHUNK]).withColumns({
        n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0))
        + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in values})
    out = out.drop(CHUNK, *[f"{p}{n}" for n in values for p in ("_v_", "_s_")])
    return unboxed(out, keys, df.columns)


def with_position(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos",
                  chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Number the present rows of each key 1, 2, ... in order."""
    return running_sum(df, keys, order, {name: F.lit(1).cast("long")}, chunk_steps)


def dense_grid(df: DataFrame, keys: Sequence[str], order: str,
               chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Every grid position between the first and the last of each key."""
    spans = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    chunks = spans.withColumn(CHUNK, F.explode(F.sequence(
        F.floor(F.col("_lo") / chunk_steps), F.floor(F.col("_hi") / chunk_steps))))
    start = F.greatest(F.col("_lo"), F.col(CHUNK) * chunk_steps)
    stop = F.least(F.col("_hi"), (F.col(CHUNK) + 1) * chunk_steps - 1)
    return (chunks.repartition(*[F.col(k) for k in keys], F.col(CHUNK))
            .select(*keys, F.explode(F.sequence(start, stop)).alias(order)))


def densify(df: DataFrame, keys: Sequence[str], order: str,
            chunk_steps: int = CHUNK_STEPS) -> DataFrame:
    """Reindex to the regular grid; absent rows carry nulls."""
    grid = boxed(dense_grid(df, keys, order, chunk_steps), keys)
    return unboxed(grid.join(boxed(df, keys), [KEY, order], "left"), keys, [*keys, order])
