"""Boosted regression trees whose leaves carry an L2 penalty.

Spark ML grows the trees of a round; the values of its leaves are estimated anew. A leaf of n sampled
training rows whose residuals sum to s adds ``rate * s / (n + l2)``, which is what a second-order booster
with squared error does. Leaf sums are one aggregate per round, at most 2 ** depth rows of it.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from ..session import materialise

STORE_EVERY = 20


def boosted_predictions(rows: DataFrame, rounds: int = 400, depth: int = 6, rate: float = 0.05,
                        l2: float = 1.0, rows_share: float = 0.9, columns_share: float = 0.6,
                        seed: int = 42, row_id: str = "row_id", train: str = "train") -> DataFrame:
    """``rows`` with ``predicted`` after all rounds; only rows whose ``split`` is ``train`` are learned from.

    Needs ``features`` (a vector), ``target``, ``split`` and a row id. Each round samples rows by a hash of
    id and round, so a task that runs again takes the same ones, and columns per node. The state is
    kept in memory and spills; every 20 rounds it is written, which ends its lineage.
    """
    learned = F.col("split") == train
    mean = rows.where(learned).agg(F.avg("target")).first()[0]
    columns = rows.columns
    state = materialise(rows.withColumn("predicted", F.lit(float(mean or 0.0))), "boosted")
    if mean is None:
        return state
    held = None
    for turn in range(rounds):
        place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(turn), row_id), 11) / F.lit(float(1 << 53))
        now = state.withColumns({"_residual": F.col("target") - F.col("predicted"),
                                 "_in": learned & (place < F.lit(rows_share))})
        tree = RandomForestRegressor(
            featuresCol="features", labelCol="_residual", predictionCol="_tree", leafCol="_leaf", numTrees=1,
            bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=str(columns_share) if columns_share < 1 else "all",
            maxDepth=depth, minInstancesPerNode=1, seed=seed + turn).fit(now.where("_in"))
        scored = tree.transform(now).withColumn("_at", vector_to_array("_leaf")[0].cast("int"))
        sums = scored.where("_in").groupBy("_at").agg(F.sum("_residual").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        values = F.create_map(*[F.lit(x) for r in sums for x in (r["_at"], rate * r["s"] / (r["n"] + l2))]) \
            if sums else F.create_map(F.lit(-1), F.lit(0.0))
        nxt = scored.withColumn("predicted", F.col("predicted") + F.coalesce(values[F.col("_at")], F.lit(0.0))) \
            .select(*columns, "predicted")
        if (turn + 1) % STORE_EVERY == 0 or turn + 1 == rounds:
            nxt = materialise(nxt, "boosted")
        else:
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
            nxt.count()
        if held is not None:
            held.unpersist()
        held = nxt if nxt.is_cached else None
        state = nxt
    return state
