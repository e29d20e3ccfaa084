"""Settings and fixed catalogues of the forecasting study."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

TIMESTAMP, TARGET, LOCAL_TZ, MODELING_TZ = "timestamp", "trip_count", "America/New_York", "UTC"

#: Other names of standard columns.
COLUMN_ALIASES = {"pickup_hour": "timestamp"}

#: Lags, windows and calendar columns by feature set.
LAGS = {"basic": [1, 24, 168], "advanced": [1, 2, 3, 6, 12, 24, 48, 72, 168]}
MEAN_WINDOWS = {"basic": [], "advanced": [3, 24, 168]}
STD_WINDOWS = {"basic": [], "advanced": [24]}
CALENDAR = {"basic": ["hour", "day_of_week"], "advanced": ["hour", "day_of_week", "is_weekend", "month"]}
#: Accepted names of the feature sets.
FEATURE_SET_NAMES = {"basic": "basic", "xgb_basic": "basic", "xgboost_basic": "basic", "advanced": "advanced", "xgb_advanced": "advanced", "xgboost_advanced": "advanced"}

#: Search spaces; the right-most parameter varies fastest.
PROPHET_SPACE = {"changepoint_prior_scale": [0.01, 0.05, 0.1, 0.5], "seasonality_prior_scale": [1.0, 5.0, 10.0], "seasonality_mode": ["additive", "multiplicative"]}
TREE_SPACE = {"n_estimators": [300, 600, 1000], "learning_rate": [0.03, 0.05, 0.1], "max_depth": [3, 5, 7], "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 5, 10]}

METRICS, PRIMARY_METRIC, SECONDARY_METRIC = ["mae", "rmse", "mape", "smape"], "mae", "rmse"

#: Columns of the runtime log.
RUNTIME_LOG_COLUMNS = [
    "timestamp_run", "experiment_name", "model_name", "feature_set", "fold", "parameter_set_id", "train_start", "train_end", "validation_start", "validation_end",
    "n_train_rows", "n_prediction_rows", "train_time_seconds", "prediction_time_seconds", "total_runtime_seconds", "status", "error_message",
]

#: Model labels in report order.
MODEL_ORDER = ["Prophet", "Prophet-Regressor-Basic", "XGBoost-Basic", "XGBoost-Advanced", "SARIMA-Auto"]


def feature_set(name: str) -> str:
    """The canonical name of a feature set; case and ``-`` don't matter."""
    key = name.strip().lower().replace("-", "_")
    if key not in FEATURE_SET_NAMES:
        raise ValueError(f"unknown feature set: {name}")
    return FEATURE_SET_NAMES[key]


def feature_columns(name: str) -> list[str]:
    """The ordered features of a set: lags, means, deviations, calendar."""
    s = feature_set(name)
    return [f"lag_{k}" for k in LAGS[s]] + [f"rolling_mean_{w}" for w in MEAN_WINDOWS[s]] + [f"rolling_std_{w}" for w in STD_WINDOWS[s]] + CALENDAR[s]


def required_history() -> int:
    """Rows that the longest lag or window of any set looks back."""
    return max(x for d in (LAGS, MEAN_WINDOWS, STD_WINDOWS) for xs in d.values() for x in xs)


def whole_number(value, name: str, least: int = 0) -> int:
    """An integer argument: integral floats and numeric strings pass, booleans don't."""
    if isinstance(value, bool):
        raise TypeError(f"{name} must be a whole number, not {value}")
    number = float(value)
    if number != int(number) or number < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value}")
    return int(number)


def positive_numbers(values, name: str) -> list[int]:
    out = [whole_number(v, name, 1) for v in values]
    if not out:
        raise ValueError(f"{name} is empty")
    return out


@dataclass(frozen=True)
class Settings:
    """Horizon, folds and hold-out of a study; checked on creation."""

    horizon: int = 24
    n_folds: int = 5
    val_horizon: int = 168
    gap: int = 0
    test_days: int = 30
    seed: int = 42
    data_path: str = ""

    def __post_init__(self):
        whole_number(self.horizon, "horizon", 1)
        whole_number(self.n_folds, "n_folds", 2)
        whole_number(self.gap, "gap", 0)
        whole_number(self.test_days, "test_days", 1)
        if self.val_horizon < self.horizon:
            raise ValueError("val_horizon must be at least horizon")

    def warnings(self) -> list[str]:
        return [f"no such file: {self.data_path}"] if self.data_path and not Path(self.data_path).exists() else []


@dataclass(frozen=True)
class SarimaSettings:
    """Orders and budgets of the seasonal model; checked on creation."""

    seasonal_period: int = 24
    max_train_rows: int = 0
    max_p: int = 2
    max_q: int = 2
    max_P: int = 1
    max_Q: int = 1
    max_d: int = 1
    max_D: int = 1
    max_order: int = 4
    maxiter: int = 20
    update_maxiter: int = 0

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            whole_number(getattr(self, name), name, 0)
        if self.seasonal_period < 2 or self.max_order < 1 or self.maxiter < 1:
            raise ValueError("seasonal_period, max_order or maxiter is too small")
        if 0 < self.max_train_rows < 14 * 24:
            raise ValueError("max_train_rows must be 0 or at least two weeks of hours")
