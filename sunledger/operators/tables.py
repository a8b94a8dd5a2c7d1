"""Result tables built from the run registry, strata, transfer and coverage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.bands import rank_of
from ..functions.stats import t_critical
from ..schema import (FEATURE_REGIME_ORDER, GROUP_QUESTIONS, MATRIX_COLUMNS, MODEL_ORDER)
from .resample import stack

ARRIVAL = ("recorded_at", "run_no")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Earliest row of every key, as an aggregate with map-side partials."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        row.alias("_row")).select("_row.*")


def upsert_registry(log: DataFrame, key: str = "experiment_id",
                    order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Last write per run wins."""
    row = F.max_by(F.struct(*log.columns), F.struct(*order))
    return log.groupBy(F.col(key).alias("_key")).agg(row.alias("_row")).select("_row.*")


def model_rank(column: str = "model") -> Column:
    return rank_of(F.col(column), MODEL_ORDER)


def overall_comparison(registry: DataFrame, horizon: str = "1h", feature_spec: str = "full",
                       group: str = "B_ml_vs_dl") -> DataFrame:
    """One row per model at one horizon and input set; the group is preferred when present."""
    rows = registry.where((F.col("horizon") == horizon) & (F.col("feature_spec") == feature_spec))
    row, arrival = F.struct(*registry.columns), F.struct(*ARRIVAL)
    preferred = F.when(F.col("experiment_group") == group, arrival)
    models = rows.groupBy("model").agg(
        F.min_by(row, preferred).alias("_wanted"), F.min_by(row, arrival).alias("_any"))
    # the window spans one row per model
    present = F.max(F.col("_wanted").isNotNull()).over(Window.partitionBy(F.lit(1)))
    chosen = F.when(present, F.col("_wanted")).otherwise(F.col("_any"))
    return (models.select(chosen.alias("_row"))
            .where(F.col("_row").isNotNull()).select("_row.*")
            .withColumn("model_rank", model_rank()))


def horizon_comparison(registry: DataFrame,
                       groups: Sequence[str] = ("C_horizons", "B_ml_vs_dl")) -> DataFrame:
    """One row per model and horizon from the first group that has it."""
    priority = rank_of(F.col("experiment_group"), groups)
    rows = registry.where(F.col("experiment_group").isin(*groups)
                          & (F.col("feature_spec") == "full")).withColumn("_priority", priority)
    out = first_per(rows, ["model", "horizon"], ("_priority", *ARRIVAL)).drop("_priority")
    return out.withColumns({"source_group": F.col("experiment_group"), "model_rank": model_rank()})


def ranked_strata(stratified: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Regime, seasonal or full error table with the models' reading order."""
    rows = stratified if types is None else stratified.where(
        F.col("stratum_type").isin(*types))
    return rows.withColumn("model_rank", model_rank())


ABLATION_METRICS = ("rmse", "mae", "nrmse_capacity")


def feature_ablation(registry: DataFrame, group: str = "E_feature_ablation") -> DataFrame:
    """Ablation runs with the percent change against the same model's full inputs."""
    rows = registry.where(F.col("experiment_group") == group)
    base = first_per(rows.where("feature_spec = 'full'"), ["model"]).select(
        "model", *[F.col(m).alias(f"_full_{m}") for m in ABLATION_METRICS])
    out = rows.join(base, "model", "left").withColumns({
        f"{m}_vs_full_pct": 100.0 * (F.col(m) - F.col(f"_full_{m}")) / F.col(f"_full_{m}")
        for m in ABLATION_METRICS})
    return out.drop(*[f"_full_{m}" for m in ABLATION_METRICS]).withColumn(
        "model_rank", model_rank())


def feature_regimes(registry: DataFrame, group: str = "N_feature_regimes") -> DataFrame:
    """Additive input regimes, first run per model and regime, in information order."""
    rows = first_per(registry.where(F.col("experiment_group") == group),
                     ["model", "feature_spec"])
    return rows.withColumns({
        "regime_rank": rank_of(F.col("feature_spec"), FEATURE_REGIME_ORDER),
        "model_rank": model_rank()})


def composite_ablation(registry: DataFrame, composites: Sequence[str], backbones: Sequence[str],
                       group: str = "B_ml_vs_dl", keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Composite models against the best of their backbones by RMSE."""
    rows = first_per(registry.where((F.col("experiment_group") == group)
                                    & (F.col("feature_spec") == "full")), [*keys, "model"])
    best = rows.where(F.col("model").isin(*backbones)).groupBy(*keys).agg(
        F.min_by("model", F.struct("rmse", rank_of(F.col("model"), backbones)))
        .alias("backbone"), F.min("rmse").alias("backbone_rmse"))
    change = F.col("composite_rmse") - F.col("backbone_rmse")
    return (rows.where(F.col("model").isin(*composites))
            .select(*keys, F.col("model").alias("composite"), F.col("rmse").alias("composite_rmse"),
                    F.col("mae").alias("composite_mae"),
                    F.col("nrmse_capacity").alias("composite_nrmse_capacity"),
                    F.col("r2").alias("composite_r2"),
                    F.col("train_seconds").alias("composite_train_seconds"))
            .join(best, list(keys), "left")
            .withColumns({"rmse_change_w": change,
                          "rmse_change_pct": 100.0 * change / F.col("backbone_rmse")}))


def computational_cost(registry: DataFrame, cost: str = "train_seconds",
                       quality: str = "nrmse_capacity") -> DataFrame:
    """First full-input run per model and horizon with the cost/accuracy frontier flag.

    A run is on the frontier when it beats every cheaper run; runs are one per model and
    horizon, so the ordered pass is over a table of that size.
    """
    rows = first_per(registry.where("feature_spec = 'full'"), ["model", "horizon"]).withColumn(
        cost, F.coalesce(F.col(cost), F.lit(0.0)))
    cheaper = (Window.partitionBy("_table").orderBy(cost, quality, "model", "horizon")
               .rowsBetween(Window.unboundedPreceding, -1))
    best = F.min(quality).over(cheaper)
    return rows.withColumn("_table", F.lit(1)).withColumns({
        "pareto_optimal": F.coalesce(best.isNull() | (F.col(quality) < best), F.lit(False)),
        "requires_training": F.col(cost) > 0, "model_rank": model_rank()}).drop("_table")


def dataset_statistics(featured: DataFrame, stations: DataFrame,
                       columns: Sequence[str] = ("ghi",), target: str = "pv_power_w",
                       keys: Sequence[str] = ("site",), order: str = "step") -> DataFrame:
    """Long table of descriptive quantities per site."""
    y, lit = F.col(target), F.col("daylight")
    facts = featured.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("records"),
        F.max(y).alias("maximum observed power"), F.avg(y).alias("mean power (all steps)"),
        F.avg(F.when(lit, y)).alias("mean power (daylight)"),
        F.avg(lit.cast("double")).alias("daylight fraction"),
        F.avg(F.when(lit & y.isNotNull(), (y <= 0).cast("double")))
        .alias("zero-power fraction (daylight)"),
        *[F.avg(c).alias(f"{c} mean") for c in columns],
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c} missing") for c in columns],
        *[F.count_if(F.col("split") == s).cast("double").alias(f"{s} split size")
          for s in ("train", "val", "test")])
    facts = facts.join(stations.select(*keys, "rated_w"), list(keys), "left").withColumns({
        "rated capacity": F.col("rated_w"),
        "capacity factor": F.col("mean power (all steps)") / F.col("rated_w")}).drop("rated_w")
    names = [c for c in facts.columns if c not in keys]
    return facts.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("quantity"), F.col(f"`{n}`").cast("double").alias("value"))
        for n in names])))


def registry_summary(registry: DataFrame) -> DataFrame:
    """One row: counts, distinct labels, best runs by nRMSE and RMSE, runs without a score."""
    def labels(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ", ")

    return registry.agg(
        F.count(F.lit(1)).alias("n_experiments"), labels("experiment_group").alias("groups"),
        labels("model").alias("models"), labels("horizon").alias("horizons"),
        labels("feature_spec").alias("feature_specs"),
        F.count_if(F.col("rmse").isNull()).alias("n_errors_recorded"),
        *[F.min_by("experiment_id", F.when(F.col(m).isNotNull(), F.struct(m, *ARRIVAL)))
          .alias(f"best_{m}_run") for m in ("nrmse_capacity", "rmse")],
        F.min("nrmse_capacity").alias("best_nrmse_capacity"), F.min("rmse").alias("best_rmse"))


def beating_persistence(overall: DataFrame) -> DataFrame:
    return overall.where("skill_vs_persistence_rmse > 0").select(
        "model", "skill_vs_persistence_rmse")


# ---- canonical matrix ---------------------------------------------------------------

def _question(group: Column) -> Column:
    out = F.lit("")
    for name, question in GROUP_QUESTIONS.items():
        out = F.when(group == name, F.lit(question)).otherwise(out)
    return out


def _matrix(df: DataFrame, source: str, values: Mapping[str, Column]) -> DataFrame:
    return df.select(*[e.alias(n) for n, e in values.items()],
                     F.lit("executed").alias("status"), F.lit(source).alias("source"))


def matrix_from_registry(registry: DataFrame, site: str, protocol: str =
                         "within_site_chronological") -> DataFrame:
    """Runs of the registry; what it does not record (family, cost, parameters) stays null."""
    def c(name: str) -> Column:
        return F.col(name) if name in registry.columns else F.lit(None)

    return _matrix(registry, "registry", {
        "experiment_id": c("experiment_id"), "research_question": _question(c("experiment_group")),
        "experiment_group": c("experiment_group"), "protocol": F.lit(protocol),
        "model": c("model"), "model_family": c("model_family").cast("string"), "horizon": c("horizon"),
        "site": F.lit(site), "weather_regime": F.lit("all_daylight"), "season": F.lit("all"),
        "feature_regime": c("feature_spec"), "seed": c("seed").cast("long"),
        "n_observations": c("n_test").cast("long"), "mae": c("mae"), "rmse": c("rmse"),
        "nrmse": c("nrmse_capacity"), "smape": c("smape").cast("double"), "r2": c("r2"),
        "skill_vs_persistence": c("skill_vs_persistence_rmse"),
        "train_time": c("train_seconds"), "inference_time": c("inference_ms_per_window").cast("double"),
        "train_time_seconds": c("train_seconds"),
        "inference_ms_per_window": c("inference_ms_per_window").cast("double"),
        "n_parameters": c("n_parameters").cast("long")})


def matrix_from_strata(stratified: DataFrame, seed: int = 42) -> DataFrame:
    c = F.col
    kind, name = c("stratum_type"), c("stratum")
    identity = F.concat_ws("_", F.lit("S"), c("site"), c("model"), kind,
                           F.regexp_replace(name, " ", "_"), c("horizon"))
    return _matrix(stratified, "stratified", {
        "experiment_id": identity, "research_question": F.lit("RQ3"),
        "experiment_group": F.lit("D_regimes/G_seasonal"),
        "protocol": F.lit("within_site_chronological"), "model": c("model"),
        "horizon": c("horizon"), "site": c("site"),
        "weather_regime": F.when(kind == "regime", name).otherwise(F.lit("all_daylight")),
        "season": F.when(kind == "season", name).otherwise(F.lit("all")),
        "feature_regime": F.lit("full"), "seed": F.lit(seed).cast("long"),
        "n_observations": c("n"), "mae": c("mae"), "rmse": c("rmse"),
        "nrmse": c("nrmse_capacity"), "smape": c("smape"), "r2": c("r2"),
        "skill_vs_persistence": c("skill_vs_persistence_rmse")})


def matrix_from_transfer(transfer: DataFrame) -> DataFrame:
    c = F.col
    identity = F.concat_ws("_", F.lit("J"), c("protocol"), c("model"), c("horizon"),
                           F.regexp_replace("test_site", " ", "_"))
    return _matrix(transfer, "cross_site", {
        "experiment_id": identity, "research_question": F.lit("RQ6"),
        "experiment_group": F.lit("J_cross_site"), "protocol": c("protocol"),
        "model": c("model"), "horizon": c("horizon"), "site": c("test_site"),
        "weather_regime": F.lit("all_daylight"), "season": F.lit("all"),
        "feature_regime": F.lit("full"), "n_observations": c("n"), "mae": c("mae"),
        "rmse": c("rmse"), "nrmse": c("nrmse_capacity"), "smape": c("smape"), "r2": c("r2"),
        "skill_vs_persistence": c("skill_vs_persistence_rmse")})


def matrix_from_coverage(coverage: DataFrame) -> DataFrame:
    c = F.col
    identity = F.concat(F.lit("K_"), c("site"), F.lit("_"), c("model"), F.lit("_a"),
                        c("alpha").cast("string"), F.lit("_"), c("scope"), F.lit("_"), c("horizon"))
    return _matrix(coverage, "coverage", {
        "experiment_id": identity, "research_question": F.lit("RQ7"),
        "experiment_group": F.lit("K_uncertainty"), "model": c("model"),
        "horizon": c("horizon"), "site": c("site"), "season": F.lit("all"),
        "feature_regime": F.lit("full"), "n_observations": c("n")})


def build_matrix(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of the sources, always with all columns in the canonical order."""
    out = stack(parts)
    texts = MATRIX_COLUMNS[:11] + ["status", "source"]

    def column(c: str) -> Column:
        kind = "string" if c in texts else "bigint" if c in (
            "seed", "n_observations", "n_parameters") else "double"
        return (F.col(c) if c in out.columns else F.lit(None)).cast(kind).alias(c)

    return out.select(*[column(c) for c in MATRIX_COLUMNS])


def repeated_ids(matrix: DataFrame) -> DataFrame:
    """Experiment ids that more than one row of the matrix carries."""
    return matrix.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def matrix_coverage(matrix: DataFrame) -> DataFrame:
    """How much of the matrix was executed."""
    done = F.col("status") == "executed"

    def labels(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(done & (F.col(c) != ""), F.col(c)))),
                            ", ")

    return matrix.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("executed_rows"),
        labels("research_question").alias("research_questions"),
        labels("experiment_group").alias("groups"), labels("horizon").alias("horizons"),
        labels("model").alias("models"), labels("site").alias("sites"))


SEED_METRICS = ("mae", "rmse", "nrmse_capacity", "r2", "skill_vs_persistence_rmse")


def multiseed_summary(registry: DataFrame, group: str = "M_multiseed",
                      keys: Sequence[str] = ("model", "horizon"),
                      metrics: Sequence[str] = SEED_METRICS) -> DataFrame:
    """Mean, spread and t interval of every metric across seeds."""
    rows = registry.where(F.col("experiment_group") == group)
    out: dict[str, Column] = {
        "n_seeds": F.count_distinct("seed"),
        "seeds": F.array_join(F.transform(F.array_sort(F.collect_set("seed")),
                                          lambda s: s.cast("string")), ", ")}
    for m in metrics:
        n, mean = F.count(m), F.avg(m)
        std = F.when(n > 1, F.stddev_samp(m)).when(n == 1, F.lit(0.0))
        half = F.when(n > 1, t_critical(n - 1) * std / F.sqrt(n)).otherwise(F.lit(0.0))
        out |= {f"{m}_mean": mean, f"{m}_std": std, f"{m}_ci_low": mean - half,
                f"{m}_ci_high": mean + half, f"{m}_min": F.min(m), f"{m}_max": F.max(m)}
    return rows.groupBy(*keys).agg(*[e.alias(n) for n, e in out.items()])


def declared_runs(spark: SparkSession, **choices: Sequence) -> DataFrame:
    """Product of the declared choices, one column per choice."""
    out = spark.range(1).drop("id")
    for name, values in choices.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def missing_runs(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """Declared runs the registry does not hold."""
    return declared.join(registry.select(*declared.columns), declared.columns, "left_anti")
