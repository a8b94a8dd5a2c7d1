"""Fixed values and raw file schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: grid and horizons --------------------------------------
STEP_SECONDS = 900
HORIZONS = {"15min": 1, "1h": 4, "6h": 24, "24h": 96}
LOOKBACK_STEPS = 24
UTC_OFFSET_HOURS = 8.0

# ---- fixed values: features ------------------------------------------------
TARGET_LAGS = [0, 1, 2, 4, 8, 12, 24, 48, 96]
ROLLING_WINDOWS = [4, 12, 24]
WEATHER_ROLLING_WINDOWS = [4, 24]
WEATHER_COLUMNS = [
    "ghi", "temperature", "relative_humidity", "sea_level_pressure",
    "wind_speed", "wind_direction", "visibility", "rainfall",
]
WEATHER_INPUTS = ["ghi", "temperature", "relative_humidity", "wind_speed"]
MODEL_INPUTS = [
    "ghi", "temperature", "relative_humidity", "wind_speed", "solar_elevation",
    "sin_solar_elevation", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    *[f"pv_power_w_lag_{k}" for k in TARGET_LAGS],
    *[f"pv_rolling_{s}_{w}" for w in ROLLING_WINDOWS for s in ("mean", "std")],
    *[f"{c}_rollmean_{w}" for c in ("ghi", "temperature") for w in WEATHER_ROLLING_WINDOWS],
    "ghi_delta_1", "ghi_slope_1", "ghi_delta_4", "ghi_slope_4",
]

# ---- fixed values: input families, and the families each input set leaves out ----
INPUT_FAMILIES = {
    "weather": [c for c in MODEL_INPUTS if c in WEATHER_INPUTS
                or c.startswith(("ghi_", "temperature_"))],
    "solar_geometry": ["solar_elevation", "sin_solar_elevation"],
    "calendar": ["hour_sin", "hour_cos", "doy_sin", "doy_cos"],
    "pv_history": [c for c in MODEL_INPUTS if c.startswith("pv_")],
}
INPUT_SETS = {
    "pv_only": ["weather", "solar_geometry", "calendar"],
    "weather_only": ["solar_geometry", "calendar", "pv_history"],
    "pv_weather": ["solar_geometry", "calendar"],
    "pv_weather_solar": ["calendar"],
    "full": [],
    "no_weather": ["weather"],
    "no_solar_geometry": ["solar_geometry"],
    "no_pv_history": ["pv_history"],
    "no_calendar": ["calendar"],
}
MINIMAL_INPUTS = ["pv_power_w_lag_0", "pv_rolling_mean_4", "pv_rolling_mean_12",
                  "pv_rolling_mean_24"]

# ---- fixed values: cleaning -------------------------------------------------
GHI_MIN, GHI_MAX = 0.0, 1200.0
SPIKE_WINDOW, SPIKE_RATIO, SPIKE_SIGMA = 15, 1.8, 6.0
MAD_TO_SIGMA = 1.4826
NIGHT_OFFSET_MAX = 5.0
NIGHT_ELEVATION_MAX = 0.0
MAX_GAP_TARGET, MAX_GAP_WEATHER = 4, 8
FLATLINE_STEPS, FLATLINE_TOLERANCE = 8, 1e-9
CAPACITY_HIGH, CAPACITY_LOW = 1.25, 0.35

# ---- fixed values: clear sky and regimes -----------------------------------
LINKE_TURBIDITY, EXTRATERRESTRIAL = 4.0, 1364.0
MIN_CLEAR_REFERENCE, MAX_CLEAR_INDEX = 50.0, 1.2
SCALE_QUANTILE, SCALE_MIN_ROWS = 0.99, 100
REGIME_ORDER = ["Clear", "Partly cloudy", "Cloudy", "High-variability", "Night"]
VARIABILITY_WINDOW, VARIABILITY_MIN_GHI, VARIABILITY_LIMIT = 16, 20.0, 0.60
CLEAR_KT, PARTLY_KT = 0.72, 0.45
SMART_MIN_CLEAR, SMART_MAX_RATIO = 20.0, 10.0

# ---- fixed values: strata ----------------------------------------------------
MIN_STRATUM_SIZE = 200
TIME_OF_DAY_BANDS = [
    ("Early morning (05-08)", 5.0, 8.0),
    ("Morning ramp (08-10)", 8.0, 10.0),
    ("Mid-morning (10-12)", 10.0, 12.0),
    ("Solar noon (12-14)", 12.0, 14.0),
    ("Afternoon (14-16)", 14.0, 16.0),
    ("Evening ramp (16-18)", 16.0, 18.0),
    ("Late evening (18-20)", 18.0, 20.0),
]
POWER_LEVEL_BANDS = [
    ("0-10% of capacity", 0.0, 0.10),
    ("10-25% of capacity", 0.10, 0.25),
    ("25-50% of capacity", 0.25, 0.50),
    ("50-75% of capacity", 0.50, 0.75),
    ("75-100% of capacity", 0.75, 1.0001),
]
RAMP_FRACTION = 0.10
GENERATION_SPLIT = 0.35

# ---- fixed values: statistics ------------------------------------------------
EPS = 1e-9
BLOCK_STEPS, RESAMPLES, CONFIDENCE = 96, 2000, 0.95
BLOCK_LENGTHS = [1, 16, 48, 96, 192, 384]
CALIBRATION_DAYS, MIN_CONFORMAL_ROWS = 31, 100

# ---- fixed values: result tables ---------------------------------------------
MODEL_ORDER = [
    "persistence", "smart_persistence", "linear_regression", "random_forest",
    "gradient_boosting", "xgboost", "lstm", "gru", "cnn_lstm", "attention_lstm",
    "transformer",
]
FEATURE_REGIME_ORDER = ["pv_only", "weather_only", "pv_weather", "pv_weather_solar", "full"]
GROUP_QUESTIONS = {
    "A_baselines": "RQ1", "B_ml_vs_dl": "RQ1", "C_horizons": "RQ2", "D_regimes": "RQ3",
    "G_seasonal": "RQ3", "J_cross_site": "RQ6", "E_feature_ablation": "RQ4",
    "F_model_ablation": "RQ4", "M_multiseed": "RQ1", "H_explainability": "RQ5",
    "I_cost": "RQ7", "K_uncertainty": "RQ7",
}
MATRIX_COLUMNS = [
    "experiment_id", "research_question", "experiment_group", "protocol", "model",
    "model_family", "horizon", "site", "weather_regime", "season", "feature_regime",
    "seed", "n_observations", "mae", "rmse", "nrmse", "smape", "r2",
    "skill_vs_persistence", "train_time", "inference_time",
    "train_time_seconds", "inference_ms_per_window",
    "n_parameters", "status", "source",
]
# two-sided 95% Student t critical values by degrees of freedom (published table)
T_CRITICAL_975 = {
    1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 4: 2.7764451052,
    5: 2.5705818356, 6: 2.4469118511, 7: 2.3646242516, 8: 2.3060041352,
    9: 2.2621571628, 10: 2.2281388520, 11: 2.2009851601, 12: 2.1788128297,
    13: 2.1603686565, 14: 2.1447866879, 15: 2.1314495456, 16: 2.1199052992,
    17: 2.1098155778, 18: 2.1009220402, 19: 2.0930240544, 20: 2.0859634473,
    21: 2.0796138447, 22: 2.0738730679, 23: 2.0686576104, 24: 2.0638985616,
    25: 2.0595385528, 26: 2.0555294386, 27: 2.0518305165, 28: 2.0484071418,
    29: 2.0452296421,
}

# ---- fixed values: raw files ---------------------------------------------------
TIME_PATTERNS = [
    "y-M-d H:m:s", "y/M/d H:m:s", "y/M/d H:m", "y-M-d H:m", "y/M/d H:m:s.SSSSSS",
]
POWER_CSV = T.StructType([
    T.StructField("Time", T.StringType()),
    T.StructField("power(W)", T.StringType()),
])
WEATHER_POSITIONS = {
    "ghi": 1, "temperature": 1, "relative_humidity": 1, "sea_level_pressure": 1,
    "visibility": 1, "wind_speed": 1, "wind_direction": 2, "rainfall": 1,
}
# fixed values: registry column, where a run record holds it, and its type
DAY_METRICS = ("rmse", "mae", "nrmse_capacity", "nrmse_mean", "r2", "smape", "bias", "peak_error",
               "persistence_rmse", "smart_persistence_rmse", "skill_vs_persistence_rmse",
               "skill_vs_smart_persistence_rmse")
RUN_FIELDS = {
    "experiment_id": ("$.spec.experiment_id", "string"),
    "experiment_group": ("$.spec.group", "string"),
    "model": ("$.spec.model", "string"),
    "model_family": ("$.metadata.model_family", "string"),
    "model_kind": ("$.metadata.model_kind", "string"),
    "horizon": ("$.spec.horizon", "string"),
    "horizon_steps": ("$.spec.horizon_steps", "bigint"),
    "features": ("$.spec.features", "string"),
    "feature_spec": ("$.spec.features", "string"),
    "seed": ("$.spec.seed", "bigint"),
    "n_features": ("$.metadata.n_features", "bigint"),
    **{f"n_{split}": (f"$.metadata.split_sizes.{split}", "bigint")
       for split in ("train", "val", "test")},
    **{f"{split}_{end}": (f"$.metadata.target_split_dates.{split}", end)
       for split in ("train", "val", "test") for end in ("start", "end")},
    **{name: (f"$.metrics_daylight.{name}", "double") for name in DAY_METRICS},
    **{f"{name}_all_steps": (f"$.metrics_all_steps.{name}", "double")
       for name in ("rmse", "mae", "r2")},
    "train_seconds": ("$.metadata.cost.train_seconds", "double"),
    "inference_ms_per_window": ("$.metadata.cost.inference_ms_per_window", "double"),
    "n_parameters": ("$.metadata.cost.n_parameters", "bigint"),
    "config_fingerprint": ("$.metadata.config_fingerprint", "string"),
    "git_revision": ("$.metadata.environment.git_revision", "string"),
    "python_version": ("$.metadata.environment.platform.python", "string"),
    "torch_version": ("$.metadata.environment.torch.version", "string"),
    "notes": ("$.spec.notes", "string"),
}
