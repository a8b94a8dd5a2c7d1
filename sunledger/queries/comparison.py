"""Bootstrap intervals, significance tests, ranks and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import mixed_sql
from ..operators import inference
from .base import TABLES, Given, query
from .forecasting import SMALL_INPUTS, SPECS, window_runs

KEYS = ["site", "model", "horizon"]
TABLES["errors"] = """
    SELECT site, model, horizon, step, predicted - actual AS error, reference_persistence - actual AS reference_error,
           row_number() OVER (PARTITION BY site, model, horizon ORDER BY step) AS pos,
           count(*) OVER (PARTITION BY site, model, horizon) AS n
    FROM predictions WHERE daylight AND model <> 'persistence'"""
TABLES["losses"] = """
    SELECT site, model, horizon, step, pos, 'mae' AS loss, abs(error) - abs(reference_error) AS d FROM errors
    UNION ALL SELECT site, model, horizon, step, pos, 'rmse', error ** 2 - reference_error ** 2 FROM errors"""
TABLES["rank_losses"] = "SELECT * REPLACE (round(d, 6) AS d) FROM losses"
TABLES["best_of"] = """
    SELECT site, horizon, arg_min(model, (rmse, model)) AS model
    FROM (SELECT site, horizon, model, sqrt(avg(error ** 2)) AS rmse FROM errors GROUP BY ALL) GROUP BY site, horizon"""
TABLES["best_losses"] = """
    SELECT site, horizon, model, series, step, d, row_number() OVER (PARTITION BY site, horizon, series ORDER BY step) AS pos
    FROM (SELECT site, horizon, model, step, unnest(['error', 'mae', 'rmse']) AS series,
            unnest([error, abs(error) - abs(reference_error), error ** 2 - reference_error ** 2]) AS d
          FROM errors JOIN best_of USING (site, horizon, model))"""
TABLES["best_differentials"] = "SELECT * FROM best_losses WHERE series <> 'error'"
BEST_KEYS = ["site", "horizon", "model", "series"]


def _errors(g: Given):
    return g.predictions().where("daylight and model <> 'persistence'").select(
        *KEYS, "step", (F.col("predicted") - F.col("actual")).alias("error"),
        (F.col("reference_persistence") - F.col("actual")).alias("reference_error"))


def _best_losses(g: Given):
    return inference.best_differentials(g.predictions().where("daylight"))


def draws_sql(source: str, keys: str, sums: dict[str, str], resamples: int,
              blocks: list[int]) -> str:
    """Every resample by summing the rows of its blocks, one by one."""
    listed = ", ".join(f"({b}::BIGINT)" for b in blocks)
    start = mixed_sql(42, "resample", "b", "block_length")
    inner = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    on = " AND ".join(f"e.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
    SELECT {cols}, p.block_length, p.resample, p.n, {inner}
    FROM (SELECT * EXCLUDE (s, size), unnest(range(s + 1, s + size + 1)) AS at FROM (
          SELECT *, {start} % (n - len + 1) AS s, least(len, n - b * len) AS size
          FROM (SELECT *, unnest(range((n + len - 1) // len)) AS b
                FROM (SELECT {keys}, n, block_length, least(greatest(block_length, 1), n) AS len, resample
                      FROM (SELECT {keys}, count(*) AS n FROM {source} GROUP BY {keys})
                      CROSS JOIN (VALUES {listed}) v(block_length)
                      CROSS JOIN (SELECT unnest(range({resamples})) AS resample))))) p
    JOIN {source} e ON {on} AND e.pos = p.at
    GROUP BY {cols}, p.block_length, p.resample, p.n"""


METRIC_DRAWS = draws_sql("errors", "site, model, horizon", {"total": "e.error ** 2"}, 2000, [96])


@query("bootstrap_rmse", f"""
    SELECT site, model, horizon, point_estimate, quantile_cont(sqrt(total / n), 0.025) AS ci_low,
           quantile_cont(sqrt(total / n), 0.975) AS ci_high, count(*) AS n_resamples,
           stddev_samp(sqrt(total / n)) AS se
    FROM ({METRIC_DRAWS}) JOIN (SELECT site, model, horizon, sqrt(avg(error ** 2)) AS point_estimate
                                FROM errors GROUP BY ALL) USING (site, model, horizon)
    GROUP BY site, model, horizon, point_estimate""", doubles="point_estimate ci_low ci_high se")
def bootstrap_rmse(g: Given):
    return inference.bootstrap_metric(_errors(g))


SKILL_DRAWS = draws_sql("errors", "site, model, horizon",
                        {"m": "e.error ** 2", "r": "e.reference_error ** 2"}, 2000, [96])
SKILL = f"""
    SELECT site, model, horizon, point_estimate, quantile_cont(draw, 0.025) AS ci_low,
           quantile_cont(draw, 0.975) AS ci_high, count(draw) AS n_resamples, stddev_samp(draw) AS se
    FROM (SELECT *, CASE WHEN r > 0 THEN 1 - sqrt(m / n) / sqrt(r / n) END AS draw FROM ({SKILL_DRAWS}))
    JOIN (SELECT site, model, horizon, 1 - sqrt(avg(error ** 2)) / sqrt(avg(reference_error ** 2))
                   AS point_estimate FROM errors GROUP BY ALL) USING (site, model, horizon)
    GROUP BY site, model, horizon, point_estimate"""


@query("bootstrap_skill", SKILL, doubles="point_estimate ci_low ci_high se")
def bootstrap_skill(g: Given):
    return inference.bootstrap_skill(_errors(g))


BLOCKS = [1, 16, 48, 96, 192, 384]


@query("block_length_sensitivity", f"""
    SELECT *, block_length * 15 / 60.0 AS block_hours, ci_width / max(ci_width) OVER (
             PARTITION BY site, horizon, model, series) AS relative_width
    FROM (SELECT site, horizon, model, series, block_length, quantile_cont(total / n, 0.025) AS ci_low,
            quantile_cont(total / n, 0.975) AS ci_high, count(*) AS n_resamples,
            stddev_samp(total / n) AS se,
            quantile_cont(total / n, 0.975) - quantile_cont(total / n, 0.025) AS ci_width
          FROM ({draws_sql('best_differentials', 'site, horizon, model, series', {'total': 'e.d'}, 500, BLOCKS)})
          GROUP BY site, horizon, model, series, block_length)""",
       doubles="ci_low ci_high se ci_width block_hours relative_width")
def block_length_sensitivity(g: Given):
    return inference.block_length_sensitivity(
        _best_losses(g).where("series <> 'error'"), keys=BEST_KEYS, blocks=BLOCKS, n_resamples=500)


@query("loss_differentials", """
    SELECT site, loss, count(*) AS n, avg(d) AS mean_d, sum((d > 0)::INT) AS n_worse
    FROM (SELECT site, 'mae' AS loss, abs(predicted - actual) - abs(reference - actual) AS d FROM shipments
          UNION ALL SELECT site, 'rmse', (predicted - actual) ** 2 - (reference - actual) ** 2 FROM shipments)
    GROUP BY site, loss""", doubles="mean_d", digits=2, ints="n_worse")
def loss_differentials(g: Given):
    rows = g.shipments().select(
        "site", (F.col("predicted") - F.col("actual")).alias("error"),
        (F.col("reference") - F.col("actual")).alias("reference_error"))
    return inference.loss_rows(rows).groupBy("site", "loss").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"),
        F.count_if(F.col("d") > 0).alias("n_worse"))


def _p(z: str) -> str:
    """Twice the area beyond |z|, by Simpson's rule over ten units."""
    return (f"(sqrt(2 / pi()) * exp(-({z}) * ({z}) / 2) * 0.01 / 3 * list_sum(list_transform(range(0, 1001), "
            f"lambda i: CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-i * 0.01 * (abs({z}) + i * 0.005)))))")


def dm_sql(source: str, keys: str, horizon: int) -> str:
    h = max(0, horizon - 1)
    lags = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, max(h, 1) + 1))
    weighted = " ".join(f"+ 2 * {1 - k / (h + 1)} * coalesce(sum(c * l{k}), 0)" for k in range(1, h + 1))
    return f"""
    SELECT {keys}, n, mean_differential, statistic, CASE WHEN v > 0 THEN {_p('statistic')} ELSE 1.0 END AS p_value,
           CASE WHEN v > 0 THEN {_p('statistic')} ELSE 1.0 END < 0.05 AS significant,
           CASE WHEN s0 > 0 AND n > 2 THEN s1 / s0 ELSE 0 END AS lag_1_autocorrelation,
           CASE WHEN v > 0 THEN mean_differential / sqrt(spread / (n * n)) ELSE 0 END
             * sqrt((n + 1 - 2 * {horizon} + {horizon} * ({horizon} - 1) / n) / n) AS hln_statistic,
           mean_differential < 0 AS model_is_better
    FROM (SELECT *, CASE WHEN v > 0 THEN mean_differential / sqrt(v) ELSE 0.0 END AS statistic
          FROM (SELECT *, spread / (greatest(n - 1 - 2 * {h}, 1) * n) AS v
                FROM (SELECT {keys}, count(*) AS n, any_value(m) AS mean_differential, sum(c * c) AS s0,
                        coalesce(sum(c * l1), 0) AS s1, sum(c * c) {weighted} AS spread
                      FROM (SELECT *, {lags} FROM (SELECT *, d - avg(d) OVER (PARTITION BY {keys}) AS c,
                                                     avg(d) OVER (PARTITION BY {keys}) AS m FROM {source})
                            WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) GROUP BY {keys})))"""


DM_DOUBLES = "mean_differential statistic p_value lag_1_autocorrelation hln_statistic"


@query("diebold_mariano", dm_sql("losses", "site, model, horizon, loss", 1), doubles=DM_DOUBLES)
def diebold_mariano(g: Given):
    return inference.diebold_mariano(inference.loss_rows(_errors(g)))


@query("diebold_mariano_bandwidth", dm_sql("losses", "site, model, horizon, loss", 4),
       doubles=DM_DOUBLES)
def diebold_mariano_bandwidth(g: Given):
    return inference.diebold_mariano(inference.loss_rows(_errors(g)), horizon=4)


HOLM = f"""
    SELECT *, max(least((m - rank + 1) * p_value, 1.0)) OVER (
             PARTITION BY site, horizon, loss ORDER BY rank ROWS UNBOUNDED PRECEDING) AS p_value_adjusted
    FROM (SELECT *, row_number() OVER (PARTITION BY site, horizon, loss ORDER BY p_value, site, model, horizon) AS rank,
                 count(*) OVER (PARTITION BY site, horizon, loss) AS m
          FROM ({dm_sql('losses', 'site, model, horizon, loss', 1)}))"""


@query("holm_adjusted", f"SELECT site, model, horizon, loss, p_value, p_value_adjusted FROM ({HOLM})",
       doubles="p_value p_value_adjusted")
def holm_adjusted(g: Given):
    dm = inference.diebold_mariano(inference.loss_rows(_errors(g)))
    return inference.holm(dm, tie=KEYS).select(*KEYS, "loss", "p_value", "p_value_adjusted")


def rank_sql(source: str, keys: str) -> str:
    low, var = "least(w_plus, w_minus)", "(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)"
    z = f"(({low} - n * (n + 1) / 4.0) / sqrt({var}))"
    return f"""
    SELECT {keys}, CASE WHEN n > 0 THEN {low} END AS statistic, CASE WHEN n > 0 THEN {_p(z)} END AS p_value,
           CASE WHEN n > 0 THEN (w_plus - w_minus) / (w_plus + w_minus) ELSE 0 END AS effect_size_rank_biserial,
           n::BIGINT AS n_pairs, (n_all - n)::BIGINT AS n_zero_differences, n < 6 AS few_pairs
    FROM (SELECT {keys}, count(*) AS n_all FROM {source} GROUP BY {keys})
    LEFT JOIN (SELECT {keys}, coalesce(sum(rank) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rank) FILTER (d < 0), 0) AS w_minus,
                 count(*)::DOUBLE AS n, sum(t * t - 1) AS ties
               FROM (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d))
                       + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0 AS rank,
                       count(*) OVER (PARTITION BY {keys}, abs(d))::DOUBLE AS t FROM {source} WHERE d <> 0)
               GROUP BY {keys}) USING ({keys})"""


RANK_DOUBLES = "statistic p_value effect_size_rank_biserial"


@query("signed_ranks", rank_sql("rank_losses", "site, model, horizon, loss"), doubles=RANK_DOUBLES)
def signed_ranks(g: Given):
    return inference.signed_rank(inference.loss_rows(_errors(g)), decimals=6)


TABLES["shipment_losses"] = """
    SELECT site, round(abs(predicted - actual) - abs(reference - actual), 2) AS d FROM shipments"""


@query("signed_ranks_by_row", rank_sql("shipment_losses", "site"), doubles=RANK_DOUBLES)
def signed_ranks_by_row(g: Given):
    loss = F.abs(F.col("predicted") - F.col("actual")) - F.abs(F.col("reference") - F.col("actual"))
    return inference.signed_rank(g.shipments().select("site", F.round(loss, 2).alias("d")),
                                 keys=["site"])


@query("rank_biserial", f"""
    SELECT site, effect_size_rank_biserial, n_pairs FROM ({rank_sql('visit_losses', 'site')})
    """.replace("FROM visit_losses", "FROM (SELECT site, actual - 10.0 * hour AS d FROM visits)"),
       doubles="effect_size_rank_biserial")
def rank_biserial(g: Given):
    rows = g.visits().select("site", (F.col("actual") - 10.0 * F.col("hour")).alias("d"))
    return inference.signed_rank(rows, keys=["site"]).select(
        "site", "effect_size_rank_biserial", "n_pairs")


def acf_sql(max_lag: int) -> str:
    lags = ", ".join(f"lag(c, {k}) OVER w AS l{k}" for k in range(1, max_lag + 1))
    sums = ", ".join(f"coalesce(sum(c * l{k}), 0)" for k in range(1, max_lag + 1))
    return f"""
    SELECT site, horizon, model, series, n, unnest(range({max_lag + 1})) AS lag, unnest(v) AS s, s0
    FROM (SELECT site, horizon, model, series, count(*) AS n, sum(c * c) AS s0, [sum(c * c), {sums}] AS v
          FROM (SELECT *, {lags} FROM (SELECT *, d - avg(d) OVER (PARTITION BY site, horizon, series) AS c
                                       FROM best_losses)
                WINDOW w AS (PARTITION BY site, horizon, series ORDER BY pos)) GROUP BY site, horizon, model, series)"""


@query("autocorrelation", f"""
    SELECT site, horizon, model, series, n, lag, CASE WHEN lag < n AND s0 > 0 THEN s / s0 END AS autocorrelation,
           lag * 15 / 60.0 AS lag_hours FROM ({acf_sql(192)})""", doubles="autocorrelation lag_hours")
def autocorrelation(g: Given):
    return inference.autocorrelation(_best_losses(g), max_lag=192, keys=BEST_KEYS)


@query("effective_sample_size", f"""
    SELECT site, horizon, model, series, n, tau AS integrated_autocorrelation_time, n / tau AS effective_sample_size
    FROM (SELECT site, horizon, model, series, n, greatest(1, 1 + 2 * coalesce(sum(r) FILTER (
                CASE WHEN hits = 0 THEN lag = 1 ELSE cut IS NULL OR lag < cut END), 0)) AS tau
          FROM (SELECT *, s / s0 AS r, min(CASE WHEN abs(s / s0) < 0.05 THEN lag END) OVER k AS cut,
                       count(*) FILTER (abs(s / s0) >= 0.05) OVER k AS hits
                FROM ({acf_sql(192)}) WHERE lag >= 1 AND lag <= n - 2
                WINDOW k AS (PARTITION BY site, horizon, series)) GROUP BY site, horizon, model, series, n)""",
       doubles="integrated_autocorrelation_time effective_sample_size")
def effective_sample_size(g: Given):
    profile = inference.autocorrelation(_best_losses(g), max_lag=192, keys=BEST_KEYS)
    return inference.effective_sample_size(profile, BEST_KEYS)


@query("model_comparison", f"""
    SELECT d.* EXCLUDE (rank, m), p_value_adjusted < 0.05 AS significant_holm,
           count(DISTINCT significant) OVER (PARTITION BY site, model, horizon) = 1 AS losses_agree, r.statistic AS wilcoxon_statistic, r.p_value AS wilcoxon_p,
           r.effect_size_rank_biserial, r.n_pairs, s.point_estimate AS skill, s.ci_low AS skill_low,
           s.ci_high AS skill_high
    FROM ({HOLM}) d LEFT JOIN ({rank_sql('rank_losses', 'site, model, horizon, loss')}) r
      USING (site, model, horizon, loss)
    LEFT JOIN ({SKILL}) s USING (site, model, horizon)""",
       doubles=DM_DOUBLES + " p_value_adjusted wilcoxon_statistic wilcoxon_p effect_size_rank_biserial "
                            "skill skill_low skill_high")
def model_comparison(g: Given):
    return inference.compare_models(g.keep(_errors(g)), rank_decimals=6)


@query("best_models", """
    SELECT site, horizon, arg_min(model, (rmse, model)) AS best_model, min(rmse) AS best_rmse
    FROM (SELECT site, horizon, model, sqrt(avg((predicted - actual) ** 2)) AS rmse FROM predictions
          WHERE daylight GROUP BY ALL) GROUP BY site, horizon""", doubles="best_rmse")
def best_models(g: Given):
    return inference.best_run(g.predictions().where("daylight"), ["site", "horizon"])


TABLES["ablated"] = """
    SELECT *, row_number() OVER (PARTITION BY site, horizon, feature_spec ORDER BY step) AS pos
    FROM (SELECT r.site, r.horizon, s.feature_spec, r.step,
            my + (CASE s.feature_spec WHEN 'pv_only' THEN szy / szz * (z - mz) ELSE sxy / sxx * (x - mx) END) - y AS error,
            my + bx * (x - mx) + bz * (z - mz) - y AS reference_error
          FROM ablation_rows r JOIN ablation_fits USING (site, horizon)
          CROSS JOIN (VALUES ('pv_only'), ('weather_only')) s(feature_spec)
          WHERE r.split = 'test' AND r.daylight)"""
TABLES["ablated_losses"] = """
    SELECT site, horizon, feature_spec, step, pos, abs(error) - abs(reference_error) AS d FROM ablated"""
ABLATED_KEYS = "site, horizon, feature_spec"


@query("ablation_tests", f"""
    WITH points AS (SELECT {ABLATED_KEYS}, count(*) AS n_daylight, sqrt(avg(error ** 2)) AS rmse,
                      sqrt(avg(reference_error ** 2)) AS full_rmse FROM ablated GROUP BY {ABLATED_KEYS}),
    skills AS (SELECT {ABLATED_KEYS}, quantile_cont(1 - sqrt(m / n) / sqrt(r / n), 0.025) AS skill_low,
                 quantile_cont(1 - sqrt(m / n) / sqrt(r / n), 0.975) AS skill_high
               FROM ({draws_sql("ablated", ABLATED_KEYS, {"m": "e.error ** 2", "r": "e.reference_error ** 2"}, 2000, [96])})
               GROUP BY {ABLATED_KEYS}),
    tests AS (SELECT {ABLATED_KEYS}, statistic, p_value, lag_1_autocorrelation,
                max(least((m - rank + 1) * p_value, 1.0)) OVER (PARTITION BY site ORDER BY rank ROWS UNBOUNDED PRECEDING)
                  AS p_value_adjusted
              FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p_value, {ABLATED_KEYS}) AS rank,
                           count(*) OVER (PARTITION BY site) AS m
                    FROM ({dm_sql("ablated_losses", ABLATED_KEYS, 1)})))
    SELECT {ABLATED_KEYS}, n_daylight, rmse, full_rmse, 100 * (rmse / full_rmse - 1) AS rmse_increase_pct,
           1 - rmse / full_rmse AS skill, skill_low, skill_high, statistic, p_value, lag_1_autocorrelation,
           p_value_adjusted
    FROM points JOIN skills USING ({ABLATED_KEYS}) JOIN tests USING ({ABLATED_KEYS})""",
       doubles="rmse full_rmse rmse_increase_pct skill skill_low skill_high statistic p_value "
               "lag_1_autocorrelation p_value_adjusted", digits=5)
def ablation_tests(g: Given):
    """Least squares on one input against least squares on both, fitted on the training rows."""
    _, runs = window_runs(g, ["full", "pv_only", "weather_only"], SMALL_INPUTS, lookback=1)
    return inference.ablation_statistics(runs.where("daylight"), keys=["site", "horizon"])


@query("window_ablation_tests")
def window_ablation_tests(g: Given):
    """Every input set of 24 steps against all 33 inputs: skill, paired test, Holm within a site."""
    _, runs = window_runs(g, SPECS)
    return inference.ablation_statistics(g.keep(runs.where("daylight")), keys=["site", "horizon"])
