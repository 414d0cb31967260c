"""Settings that change results, gathered in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.fixed_values import DATETIME_FORMATS


@dataclass(frozen=True)
class EngineConfig:
    """Defaults follow the published settings; override with ``dataclasses.replace``."""

    raw_path: str = "data/raw_data.csv"
    processed_path: str = "data/processed_data.csv"
    features_path: str = "data/features_data.csv"
    model_path: str = "models/best_model"

    null_ratio_limit: float = 0.3
    outlier_method: str = "iqr"
    outlier_multiplier: float = 1.5
    datetime_formats: tuple[str, ...] = DATETIME_FORMATS
    nominal_ratio: float = 0.1
    nominal_limit: int = 50

    target: str | None = None
    task: str = "regression"
    encoding: str = "onehot"
    scaling: str = "standard"
    selection: str = "rfecv"
    test_share: float = 0.2
    folds: int = 5
    seed: int = 42
    alpha: float = 0.05

    forest_trees: int = 100
    forest_depth: int = 30
    boosting_stages: int = 100
    parallel_fits: int = 4
