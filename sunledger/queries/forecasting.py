"""Reference forecasts, regressors, scoring and importances."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, functions as F

from ..operators import boosting, forecast, importance, metrics, supervise, tables, windowed
from ..schema import FEATURE_REGIME_ORDER, LOOKBACK_STEPS, MODEL_INPUTS
from ..functions.draws import half_bits_sql, scattered_sql
from .base import TABLES, Given, query
from .preparation import SPECS


@query("persistence_forecasts", """
    SELECT site, horizon, origin_step, step, actual, reference_persistence, reference_smart_persistence
    FROM supervised""", doubles="actual reference_persistence reference_smart_persistence")
def persistence_forecasts(g: Given):
    return g.supervised().select("site", "horizon", "origin_step", "step", "actual",
                                 "reference_persistence", "reference_smart_persistence")


@query("persistence_from_lag", """
    SELECT site, step, lag(pv_power_w, 4) OVER (PARTITION BY site ORDER BY step) AS persistence
    FROM dense""", doubles="persistence")
def persistence_from_lag(g: Given):
    return forecast.persistence_from_lag(g.dense(), lag=4).select("site", "step", "persistence")


@query("smart_persistence_scores", """
    SELECT site, horizon, split, count(*) AS n, sqrt(avg((reference_smart_persistence - actual) ** 2)) AS rmse
    FROM supervised WHERE split IS NOT NULL GROUP BY site, horizon, split""", doubles="rmse")
def smart_persistence_scores(g: Given):
    e = F.col("reference_smart_persistence") - F.col("actual")
    return g.supervised().where("split is not null").groupBy("site", "horizon", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query("linear_fit_one_input", "SELECT site, horizon, slope, intercept, n_fit FROM fits",
       doubles="slope intercept")
def linear_fit_one_input(g: Given):
    train = g.predictions("train").where("model = 'persistence'")
    return forecast.simple_linear_fit(train, "reference_persistence", "actual",
                                      ["site", "horizon"])


TABLES["price_fit"] = """
    SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1,
           (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2
    FROM (SELECT l_returnflag AS site, count(*) AS n_fit, covar_pop(l_quantity, l_extendedprice) AS sxy,
            covar_pop(l_discount, l_extendedprice) AS szy, var_pop(l_quantity) AS sxx,
            var_pop(l_discount) AS szz, covar_pop(l_quantity, l_discount) AS sxz,
            avg(l_extendedprice) AS my, avg(l_quantity) AS mx, avg(l_discount) AS mz
          FROM lineitem GROUP BY 1)"""


@query("linear_fit_grouped", """
    SELECT site, n_fit, my - b1 * mx - b2 * mz AS intercept, b1 AS per_quantity, b2 AS per_discount
    FROM price_fit""", doubles="intercept per_quantity per_discount", digits=3)
def linear_fit_grouped(g: Given):
    rows = g.table("lineitem").withColumnRenamed("l_returnflag", "site")
    fit = forecast.grouped_linear_fit(rows, ["l_quantity", "l_discount"], "l_extendedprice",
                                      ["site"])
    c = F.col("coefficients")
    return fit.select("site", "n_fit", c[0].alias("intercept"), c[1].alias("per_quantity"),
                      c[2].alias("per_discount"))


def _training_rows(g: Given, lookback: int = LOOKBACK_STEPS):
    """Windows of all 33 inputs with their one-hour label as vectors, written once for all models."""
    names = supervise.flat_names(MODEL_INPUTS, lookback)

    def build():
        rows = g.featured().where("split IS NOT NULL").select(
            "site", "step", "split", "daylight", "rated_w", "pv_power_w",
            *[F.col(c).cast("double").alias(c) for c in MODEL_INPUTS])
        windows = supervise.build_windows(rows, MODEL_INPUTS, "pv_power_w", {"1h": 4}, lookback,
                                          ["site", "split"], ["daylight"])
        flat = F.flatten(F.transform("window", lambda s: F.array(*[s[c] for c in MODEL_INPUTS])))
        whole = windows.withColumn("_flat", flat).where(~F.exists("_flat", lambda x: x.isNull() | F.isnan(x)))
        return whole.select(
            "site", "split", "step", "target", "rated_w", F.col("label_daylight").alias("daylight"),
            F.xxhash64("site", "step").alias("row_id"), array_to_vector("_flat").alias("features"))
    return g.staged("assembled", build), names


# the study boosts 400 rounds; the README has the time of both
BOOSTED_ROUNDS = 5


def _scored(rows, name: str, **settings):
    model, out = forecast.fit_predict(
        forecast.regressor(name, **settings), rows.where("split = 'train'"),
        rows.where("split = 'test'"))
    return model, out


def _quality(scored, name: str):
    e = F.col("predicted") - F.col("target")
    return scored.groupBy("site").agg(
        F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def window_runs(g: Given, specs=("full",), inputs=MODEL_INPUTS, lookback=LOOKBACK_STEPS, **settings):
    """Least squares on the windows of every horizon and input set, and its forecasts."""
    rows = g.featured().where("split IS NOT NULL")
    return windowed.window_regression(rows, list(inputs), specs=specs, lookback=lookback,
                                      carried=["daylight", "rated_w", "regime"], **settings)


TABLES["window_rows"] = f"""
    SELECT *, count(known) OVER (PARTITION BY site, split ORDER BY step ROWS BETWEEN {LOOKBACK_STEPS - 1} PRECEDING
             AND CURRENT ROW) = {LOOKBACK_STEPS} AS whole
    FROM (SELECT *, CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_INPUTS)} THEN 1 END AS known
          FROM featured WHERE split IS NOT NULL)"""
TABLES["window_labels"] = """
    SELECT o.site, horizon, o.split, o.step AS origin_step, l.step, l.pv_power_w AS actual, l.daylight, o.ghi,
           o.pv_rolling_mean_24 AS recent, o.pv_power_w
    FROM window_rows o CROSS JOIN horizons JOIN window_rows l
      ON l.site = o.site AND l.split = o.split AND l.step = o.step + h WHERE o.whole"""


@query("linear_regression_windows", f"""
    SELECT site, horizon, {len(MODEL_INPUTS)} AS n_inputs, count(*) FILTER (split = 'train') AS n_fit,
           count(*) FILTER (split = 'test') AS n_scored,
           avg(actual) FILTER (split = 'train') AS fitted_mean,
           avg(actual * ghi) FILTER (split = 'train') / 100 AS fitted_by_ghi,
           avg(actual * recent) FILTER (split = 'train') / 100 AS fitted_by_recent
    FROM window_labels GROUP BY site, horizon HAVING count(*) FILTER (split = 'train') > 0""",
       doubles="fitted_mean fitted_by_ghi fitted_by_recent", ints="n_inputs", digits=2)
def linear_regression_windows(g: Given):
    """Fits on 24 steps of all 33 inputs at four horizons. Fitted values keep the mean of the labels
    and their products with every input: what makes a fit least squares, and SQL can say it."""
    rows = g.featured().where("split IS NOT NULL")
    inputs = list(MODEL_INPUTS)
    ready = g.keep(windowed.standardised(rows.select(
        "site", "split", "step", "pv_power_w", F.col("ghi").alias("ghi_now"),
        F.col("pv_rolling_mean_24").alias("recent_now"), *inputs), inputs, ["site"], F.col("split") == "train"))
    sums = windowed.lagged_sums(ready.where("split = 'train'"), inputs, "pv_power_w")
    fits = g.keep(windowed.fit_windows(sums, inputs))
    fitted = windowed.predict_windows(ready, fits, inputs, "pv_power_w")
    known = g.keep(fitted).join(ready.select("site", F.col("step").alias("origin_step"), "ghi_now", "recent_now"),
                                ["site", "origin_step"])
    train = F.col("split") == "train"

    def moment(by: Column) -> Column:
        return F.avg(F.when(train, F.col("predicted") * by))

    return known.groupBy("site", "horizon").agg(
        F.count_if(train).alias("n_fit"), F.count_if(F.col("split") == "test").alias("n_scored"),
        moment(F.lit(1.0)).alias("fitted_mean"), (moment(F.col("ghi_now")) / 100).alias("fitted_by_ghi"),
        (moment(F.col("recent_now")) / 100).alias("fitted_by_recent")) \
        .join(fits.select("site", "horizon", "n_inputs"), ["site", "horizon"])


def window_scores(g: Given):
    """Point metrics of every input set per site and horizon, in daylight, as rows of a run log."""
    fits, runs = window_runs(g, SPECS)
    table = metrics.compute_all(runs.where("daylight"), ["site", "horizon", "feature_spec"], "rated_w")
    return table.join(fits.select("site", "horizon", "feature_spec", "n_inputs", "n_fit", "rank"),
                      ["site", "horizon", "feature_spec"])


@query("window_input_sets")
def window_input_sets(g: Given):
    """Scores of every input set at 24 steps and four horizons: the ablation and the additive sets."""
    return window_scores(g)


@query("window_ablation")
def window_ablation(g: Given):
    """Leave-one-out input sets and additive ones as the result tables show them, from real runs."""
    runs = window_scores(g).select(
        F.concat_ws("__", "site", "horizon", "feature_spec").alias("experiment_id"),
        F.concat_ws("@", F.lit("linear_regression"), "site", "horizon").alias("model"), "site", "horizon",
        "feature_spec", F.col("n_inputs").alias("n_features"), "rmse", "mae",
        F.col("nrmse_capacity"), "r2", F.lit("E_feature_ablation").alias("experiment_group"),
        F.lit(42).alias("seed"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(0).alias("run_no"))
    return tables.feature_ablation(g.keep(runs)).withColumn(
        "regime_rank", tables.rank_of(F.col("feature_spec"), FEATURE_REGIME_ORDER)).select(
        "site", "horizon", "feature_spec", "n_features", "rmse", "mae", "nrmse_capacity", "r2", "rmse_vs_full_pct",
        "mae_vs_full_pct", "nrmse_capacity_vs_full_pct", "regime_rank")


@query("random_forest_windows")
def random_forest_windows(g: Given):
    rows, _ = _training_rows(g)
    scored = _scored(rows, "random_forest", numTrees=20, maxDepth=8)[1]
    return _quality(scored, "random_forest")


@query("gradient_boosting_windows")
def gradient_boosting_windows(g: Given):
    rows, _ = _training_rows(g)
    scored = _scored(rows, "gradient_boosting", maxIter=10)[1]
    return _quality(scored, "gradient_boosting")


@query("boosted_sampled_windows")
def boosted_sampled_windows(g: Given):
    rows, _ = _training_rows(g)
    scored = boosting.boosted_predictions(rows.where("split IN ('train', 'test')"), rounds=BOOSTED_ROUNDS)
    return _quality(scored.where("split = 'test'"), "boosted_sampled")


@query("tuned_forest")
def tuned_forest(g: Given):
    rows, _ = _training_rows(g)
    grid = [dict(numTrees=5, maxDepth=3), dict(numTrees=5, maxDepth=6)]
    best, table = forecast.tune("random_forest", grid, rows.where("split = 'train'"),
                                rows.where("split = 'val'"))
    scores = [(s["numTrees"], s["maxDepth"], mae, s == best[2]) for s, mae in table]
    return g.spark.createDataFrame(
        scores, "num_trees long, max_depth long, val_mae double, selected boolean")


@query("prediction_frame", """
    SELECT site, model, horizon, step, origin_step, actual, predicted, predicted - actual AS error,
           abs(predicted - actual) AS abs_error
    FROM predictions WHERE model = 'linear_regression'""",
       doubles="actual predicted error abs_error")
def prediction_frame(g: Given):
    rows = g.supervised().where("split = 'test'").join(
        forecast.simple_linear_fit(g.predictions("train").where("model = 'persistence'"),
                                   "reference_persistence", "actual", ["site", "horizon"]),
        ["site", "horizon"])
    scored = rows.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col(
        "reference_persistence"))
    return forecast.prediction_frame(scored, "linear_regression").select(
        "site", "model", "horizon", "step", "origin_step", "actual", "predicted", "error",
        "abs_error")


@query("forest_importance")
def forest_importance(g: Given):
    rows, names = _training_rows(g)
    model, _ = _scored(rows, "random_forest", numTrees=10, maxDepth=6)
    return forecast.collapse_importance(forecast.importance_rows(model, names, g.spark))


SMALL_INPUTS = ["ghi", "pv_power_w_lag_0"]
TABLES["ablation_rows"] = """
    SELECT o.site, horizon, o.split, l.step, l.pv_power_w AS y, l.daylight, o.ghi AS x, o.pv_power_w AS z
    FROM sky o CROSS JOIN horizons JOIN sky l ON l.site = o.site AND l.split = o.split AND l.step = o.step + h"""
TABLES["ablation_fits"] = """
    SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz
    FROM (SELECT site, horizon, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy, var_pop(x) AS sxx, var_pop(z) AS szz,
            covar_pop(x, z) AS sxz, avg(y) AS my, avg(x) AS mx, avg(z) AS mz
          FROM ablation_rows WHERE split = 'train' GROUP BY site, horizon)"""
TABLES["scaled_weights"] = """
    SELECT f.site, f.horizon, feature, abs(CASE feature WHEN 'ghi' THEN bx * sqrt(v.vx) ELSE bz * sqrt(v.vz) END) AS value
    FROM ablation_fits f JOIN (SELECT site, var_pop(ghi) AS vx, var_pop(pv_power_w) AS vz FROM sky WHERE split = 'train'
                               GROUP BY site) v USING (site)
    CROSS JOIN (VALUES ('ghi'), ('pv_power_w_lag_0')) n(feature)"""


@query("importance_collapsed", """
    SELECT site, feature, sum(value) AS importance,
           sum(value) / sum(sum(value)) OVER (PARTITION BY site) AS relative_importance
    FROM scaled_weights GROUP BY site, feature""", doubles="importance relative_importance", digits=5)
def importance_collapsed(g: Given):
    """Weights of scaled inputs, fitted for each horizon, collapsed to one share per variable."""
    fits, _ = window_runs(g, inputs=SMALL_INPUTS, lookback=1)
    return forecast.collapse_importance(windowed.step_weights(fits, SMALL_INPUTS, 1), ["site"])


@query("window_importance_collapsed")
def window_importance_collapsed(g: Given):
    """Weights of 24 steps of all inputs collapsed over the steps, per site and horizon."""
    fits, _ = window_runs(g)
    return forecast.collapse_importance(windowed.step_weights(fits, MODEL_INPUTS), ["site", "horizon"])


def _linear_scorer(df):
    return df.withColumn("predicted", 0.1 * F.col("visitor") + 2.0 * F.col("hour")
                         - 0.5 * F.col("kind"))


PERMUTED = ["visitor", "hour", "kind"]


def draw_sql(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def permutation_sql(source: str, row_id: str, keys: str, least: int, features: dict[str, str],
                    predicted: str) -> str:
    """Permutation importance of ``features`` (name: column) of rows with ``actual``.

    ``predicted`` holds every column in braces.
    """
    part = f"{keys}, " if keys else ""
    names = list(features)
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names, 1))
    base = predicted.format(**{c: c for c in features.values()})
    swapped = predicted.format(**{c: f"(CASE WHEN d.i = {i} THEN d.{c} ELSE b.{c} END)"
                                  for i, c in enumerate(features.values(), 1)})
    on = " AND ".join([*[f"b.{k.strip()} = d.{k.strip()}" for k in keys.split(",") if k.strip()],
                       "b.pos = d.place + 1"])
    own = "".join(f"b.{k.strip()}, " for k in keys.split(",") if k.strip())
    return f"""
    WITH RECURSIVE base AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {part} 1) AS n_windows,
                  avg(abs({base} - actual)) OVER (PARTITION BY {part} 1) AS baseline_mae,
                  row_number() OVER (PARTITION BY {part} 1 ORDER BY {row_id}) AS pos FROM {source})),
    walk AS (
        SELECT *, {scattered_sql(42, 'pos - 1', 'half', 'i * 10 + r')} AS place
        FROM (SELECT {part} pos, n_windows AS n, {half_bits_sql('n_windows')} AS half, i, feature, r,
                     {', '.join(features.values())}
              FROM base CROSS JOIN (VALUES {listed}) f(i, feature)
              CROSS JOIN (SELECT unnest(range(10)) AS r) t)
        UNION ALL
        SELECT * REPLACE ({scattered_sql(42, 'place', 'half', 'i * 10 + r')} AS place) FROM walk WHERE place >= n),
    moved AS (SELECT {own} d.feature, d.r, b.baseline_mae, b.n_windows, avg(abs({swapped} - b.actual)) AS m
              FROM base b JOIN walk d ON {on} WHERE d.place < d.n GROUP BY ALL),
    table_ AS (SELECT {part} feature, baseline_mae, n_windows, avg(m - baseline_mae) AS mean_mae_increase,
                 coalesce(stddev_samp(m - baseline_mae), 0) AS std_mae_increase, count(*) AS n_repeats
               FROM moved GROUP BY ALL)
    SELECT *, n_windows < {least} AS under_sampled,
           CASE WHEN baseline_mae > 0 THEN mean_mae_increase / baseline_mae END AS relative_increase,
           CASE WHEN sum(greatest(mean_mae_increase, 0)) OVER (PARTITION BY {part} 1) > 0
                THEN greatest(mean_mae_increase, 0) / sum(greatest(mean_mae_increase, 0)) OVER (PARTITION BY {part} 1)
                ELSE 0 END AS relative_importance
    FROM table_"""


VISIT_FEATURES = {c: c for c in PERMUTED}
VISIT_SCORE = "(0.1 * {visitor} + 2.0 * {hour} - 0.5 * {kind})"
PERMUTATION_DOUBLES = ("baseline_mae mean_mae_increase std_mae_increase relative_increase "
                       "relative_importance")


@query("permutation_importance", permutation_sql("visits", "row_id", "", 400, VISIT_FEATURES, VISIT_SCORE), doubles=PERMUTATION_DOUBLES, digits=4)
def permutation_importance(g: Given):
    return importance.permutation_importance(
        g.visits(), _linear_scorer, "row_id", "actual", {c: [c] for c in PERMUTED})


@query("permutation_by_condition", permutation_sql("visits", "row_id", "site", 400, VISIT_FEATURES, VISIT_SCORE),
       doubles=PERMUTATION_DOUBLES, digits=4)
def permutation_by_condition(g: Given):
    return importance.permutation_importance(
        g.visits(), _linear_scorer, "row_id", "actual", {c: [c] for c in PERMUTED}, keys=["site"])


@query("permutation_forest")
def permutation_forest(g: Given):
    """Importance of a fitted forest inside each regime, by the stored test rows."""
    inputs = ["pv_power_w", "ghi", "solar_elevation"]
    rows = supervise.build_target(g.sky().select("site", "step", "split", "regime", *inputs),
                                  horizons={"1h": 4}, keys=["site", "split"])
    model = forecast.regressor("random_forest", numTrees=5, maxDepth=5).fit(
        forecast.assemble(rows.where("split = 'train'"), inputs))
    test = rows.where("split = 'test' and regime <> 'Night'").withColumn(
        "row_id", F.col("step") * 8 + F.pmod(F.crc32("site"), F.lit(8)))

    def scorer(df):
        return model.transform(forecast.assemble(df, inputs)).drop("features")

    return importance.permutation_importance(
        g.keep(test), scorer, "row_id", "target", {c: [c] for c in inputs},
        keys=["regime"])


@query("generation_levels", """
    SELECT site, CASE WHEN actual / rated_w >= 0.35 THEN 'high_generation' ELSE 'low_generation' END AS level,
           count(*) AS n, avg(actual) AS mean_actual
    FROM predictions WHERE model = 'persistence' GROUP BY 1, 2""", doubles="mean_actual")
def generation_levels(g: Given):
    from ..functions.bands import generation_level
    level = generation_level(F.col("actual"), F.col("rated_w"))
    return g.predictions().where("model = 'persistence'").groupBy("site", level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual").alias("mean_actual"))


@query("dependence_sample", f"""
    SELECT row_id, actual, predicted, predicted - actual AS error, abs(predicted - actual) AS abs_error,
           visitor
    FROM (SELECT *, 0.1 * visitor + 2.0 * hour - 0.5 * kind AS predicted FROM visits)
    ORDER BY {draw_sql(42, "row_id")} LIMIT 2000""",
       doubles="actual predicted error abs_error")
def dependence_sample(g: Given):
    return importance.dependence_sample(_linear_scorer(g.visits()), "row_id", ["visitor"])


TABLES["input_rows"] = """
    SELECT r.site, r.horizon, r.step, r.y AS actual, my AS level0, bx * (x - mx) AS cx, bz * (z - mz) AS cz
    FROM ablation_rows r JOIN ablation_fits USING (site, horizon) WHERE r.split = 'test' AND r.daylight"""
INPUT_TABLE = permutation_sql("input_rows", "step", "site, horizon", 400, {"ghi": "cx", "pv_power_w_lag_0": "cz"},
                              "(level0 + {cx} + {cz})")


def _by_input(runs, inputs):
    """One column per input with what it adds, all its lags together, and the rest."""
    columns = {c: f"_c{i}" for i, c in enumerate(inputs)}
    rest = F.aggregate("parts", F.lit(0.0), lambda a, b: a + b)
    rows = runs.withColumns({**{n: F.col("parts")[i] for i, n in enumerate(columns.values())},
                             "_level": F.col("predicted") - rest}).drop("parts", "predicted")

    def scorer(df):
        total = F.col("_level")
        for n in columns.values():
            total = total + F.col(n)
        return df.withColumn("predicted", total)

    return rows, scorer, {c: [n] for c, n in columns.items()}


def _input_importance(g: Given):
    _, runs = window_runs(g, inputs=SMALL_INPUTS, lookback=1, by_input=True)
    rows, scorer, groups = _by_input(runs.where("daylight"), SMALL_INPUTS)
    return importance.permutation_importance(rows, scorer, "step", "actual", groups, keys=["site", "horizon"])


@query("family_importance", INPUT_TABLE.replace(
    "    SELECT *, n_windows < 400", "    , listed AS (SELECT *, n_windows < 400", 1) + """)
    SELECT site, horizon, CASE WHEN feature LIKE 'pv_%' THEN 'pv_history' ELSE 'weather' END AS feature_group,
           sum(relative_importance) AS total_importance, count(*) AS n_variables
    FROM listed GROUP BY ALL""", doubles="total_importance", digits=4)
def family_importance(g: Given):
    """Permutation importance of a fitted model's inputs, summed by family."""
    return importance.group_importance(_input_importance(g), keys=["site", "horizon"])


@query("top_features", INPUT_TABLE.replace(
    "    SELECT *, n_windows < 400", "    , listed AS (SELECT *, n_windows < 400", 1) + """)
    SELECT site, horizon, feature, mean_mae_increase FROM listed ORDER BY mean_mae_increase DESC, feature LIMIT 10""",
       doubles="mean_mae_increase", digits=4)
def top_features(g: Given):
    table = importance.top_features(_input_importance(g), 10)
    return table.select("site", "horizon", "feature", "mean_mae_increase")


@query("importance_by_model", """
    SELECT site, horizon, 'linear_regression' AS model, feature, value FROM scaled_weights
    UNION ALL
    SELECT f.site, f.horizon, 'linear_regression@pv_only', 'pv_power_w_lag_0', abs(szy / szz * sqrt(vz))
    FROM ablation_fits f JOIN (SELECT site, var_pop(pv_power_w) AS vz FROM sky WHERE split = 'train' GROUP BY site)
      USING (site)
    UNION ALL
    SELECT f.site, f.horizon, 'linear_regression@weather_only', 'ghi', abs(sxy / sxx * sqrt(vx))
    FROM ablation_fits f JOIN (SELECT site, var_pop(ghi) AS vx FROM sky WHERE split = 'train' GROUP BY site)
      USING (site)""", doubles="value", digits=5)
def importance_by_model(g: Given):
    """Weights of scaled inputs of three fitted models as one long table."""
    fits, _ = window_runs(g, ["full", "pv_only", "weather_only"], SMALL_INPUTS, lookback=1)
    weights = g.keep(windowed.step_weights(fits, SMALL_INPUTS, 1).where("value <> 0").select(
        "site", "horizon", "feature_spec", "feature", "value"))
    names = {"linear_regression": "full", "linear_regression@pv_only": "pv_only",
             "linear_regression@weather_only": "weather_only"}
    return importance.importance_frame({m: weights.where(F.col("feature_spec") == spec).drop("feature_spec")
                                        for m, spec in names.items()})


@query("window_importance_by_regime")
def window_importance_by_regime(g: Given):
    """Permutation of each of 33 inputs with its 24 lags, inside each regime of each site (one hour ahead)."""
    return _window_importance(g, ["regime"])


@query("window_importance_by_level")
def window_importance_by_level(g: Given):
    """The same inside each regime and generation level."""
    return _window_importance(g, ["regime", "level"])


def _window_importance(g: Given, conditions: list[str]):
    from ..functions.bands import generation_level
    _, runs = window_runs(g, by_input=True)
    runs = runs.where("horizon = '1h' AND daylight").withColumn(
        "level", generation_level(F.col("actual"), F.col("rated_w")))
    rows, scorer, groups = _by_input(runs, list(MODEL_INPUTS))
    return importance.permutation_importance(rows, scorer, "step", "actual", groups, keys=["site", *conditions])
