"""The stages as compositions of operators, from raw table to what-if results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.config import EngineConfig
from plumbline.operators import charts, clean, derive, features as feats, inference, models, profile, sequences, whatif
from plumbline.plans.roles import analysis_target, categorical_columns, default_tests, has_time_series, numeric_columns, quoted, scalable_columns
from plumbline.session import materialise
from plumbline.sources.tables import save_model, save_results, save_table


def preprocess(
    df: DataFrame, config: EngineConfig = EngineConfig(), derived: Sequence[Mapping[str, str]] = (), keys: Sequence[str] = (),
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Clean, coerce, tag, remove outliers, derive: (table, reports).

    Missing values are handled before coercion and outliers, so no null reaches the removal. ``keys``
    identify rows and take no part in the outlier tests.
    """
    reports = {"profile": profile.dataset_profile(df, config.datetime_formats), "nulls": profile.null_profile(df)}
    df = clean.handle_missing(df, config.null_ratio_limit)
    df = clean.coerce_datetimes(df, config.datetime_formats)
    df = clean.tag_nominal(df, config.nominal_ratio, config.nominal_limit)
    measures = [c for c in numeric_columns(df) if c not in keys]
    reports["outliers"] = clean.detect_outliers(df, config.outlier_method, config.outlier_multiplier, measures)
    df = clean.remove_outliers(df, config.outlier_method, config.outlier_multiplier, measures)
    df, skipped = derive.add_derived_columns(df, derived)
    reports["skipped_columns"] = df.sparkSession.createDataFrame(
        [(s["column_name"], s["reason"]) for s in skipped], "column_name string, reason string"
    )
    return derive.add_calendar_columns(df), reports


@dataclass
class Features:
    table: DataFrame
    names: list[str]
    target: str
    keys: list[str]
    ranking: dict[str, int] = field(default_factory=dict)


def build_features(
    df: DataFrame, config: EngineConfig = EngineConfig(), target: str | None = None, keys: Sequence[str] = (),
    exclude: Sequence[str] | None = None, fit_on: str = "all", select: bool = True,
) -> Features:
    """Calendar features, encoding, scaling, selection.

    One target serves this stage and the analysis. The scaler sees all rows unless ``fit_on="train"``.
    ``exclude`` names categorical columns that are neither encoded nor used (by default the listed ones).
    """
    target = target or config.target or analysis_target(df)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    keys = list(keys)
    exclude = fixed.EXCLUDED_CATEGORICALS if exclude is None else list(exclude)
    df = derive.add_calendar_features(df)
    left_out = [*keys, *exclude, *([target] if config.task == "classification" else [])]
    categorical = categorical_columns(df, left_out)
    scalable = [c for c in scalable_columns(numeric_columns(df), categorical) if c not in left_out]
    if fit_on == "train":
        # The split needs the values as they came, so it is taken before encoding and scaling.
        df = df.withColumn("_test", models.is_test_row(keys or [*numeric_columns(df), *categorical], config.test_share, config.seed))
    by_score = select and config.selection == "selectkbest" and config.encoding == "onehot"
    if not by_score:  # else the places of categories are scored from counts, and only chosen ones become columns
        df = feats.encode(df, categorical, config.encoding)
    train = df.filter(~F.col("_test")) if fit_on == "train" else None
    df = feats.scale(df, scalable, config.scaling, train)
    df = df.drop("_test")
    names, ranking = feats.selectable_features(df, target, [*keys, *exclude]), {}
    df = feats.fill_features(df, names)
    if select and config.selection == "rfecv":
        folded = df.withColumn("_fold", models.hash_fold(keys or names, config.folds, config.seed))
        chosen, ranking = feats.recursive_elimination(folded, names, target, "_fold", config)
        df, names = feats.with_places(df, chosen, names)
    elif select and config.selection == "selectkbest":
        best = feats.best_features(df, names, target, categories=categorical if by_score else ())
        df, names = df.withColumns(best) if best else df, list(best)
    elif select:
        raise ValueError(f"unknown selection {config.selection!r}; use 'rfecv' or 'selectkbest'")
    return Features(feats.feature_table(df, [*keys, *names], target), names, target, keys, ranking)


def analyse(
    df: DataFrame, made: Features, config: EngineConfig = EngineConfig(),
    tests: Sequence[Mapping] | None = None, model_names: Sequence[str] | None = None,
) -> tuple[dict[str, DataFrame], models.Leaderboard]:
    """Describe, correlate, test, fit: (named result tables, leaderboard with the fitted models)."""
    measured = df.drop(*made.keys)  # row keys are no measures
    matrix = profile.correlations(measured)
    results = {"describe": profile.describe(measured), "correlations": matrix}
    if made.target in numeric_columns(df):
        results["target_correlations"] = profile.target_correlations(matrix, made.target)
    specs = tests if tests is not None else default_tests(df, made.target)
    results["tests"] = inference.run_tests(df, specs, config.alpha)
    data = models.prepare(made.table, made.names, made.target, made.keys or made.names, config)
    board = models.leaderboard(data, config, model_names)
    results["leaderboard"] = board.table
    results["coefficients"] = models.coefficient_ranking(df, board.models, data.slots)
    results["importances"] = models.importance_ranking(df, board.models, data.slots)
    return results, board


def time_series_samples(
    df: DataFrame, order: Sequence[str], features: Sequence[str], target: str, key: str | None = None, config: EngineConfig = EngineConfig(),
) -> DataFrame | None:
    """Sequence samples of a table that holds a time series, else None; the windows' length follows from the training rows."""
    if not has_time_series(df, features):
        return None
    names = [*([key] if key else []), *order]
    n_train = df.filter(~models.is_test_row(names, config.test_share, config.seed)).count()
    steps = sequences.default_steps(n_train)
    if steps < 1:
        return None
    return sequences.sequence_windows(df.filter(F.col(quoted(target)).isNotNull()), order, features, target, steps, key)


def save_all(results: Mapping[str, DataFrame], board: models.Leaderboard, config: EngineConfig, folder: str) -> dict[str, str]:
    """Writes what ``run_all`` returns: the cleaned table, the features, every report under ``folder``, the best model whatever it is."""
    kind = lambda path: "parquet" if ".parquet" in path else "csv"
    flat = {"cleaned": config.processed_path, "features": config.features_path}
    paths = {name: save_table(results[name], path, kind(path)) for name, path in flat.items()}
    paths |= save_results({n.replace(": ", "-"): t for n, t in results.items() if n not in flat}, folder, "parquet")
    paths["model"] = save_model(board.best_pipeline(), config.model_path)
    return paths


def what_if(df: DataFrame, specs: Sequence[Mapping], mode: str = "comparable", keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Baseline and scenarios; ``keys`` identify rows and count in no total."""
    df = df.drop(*keys)
    return {"baseline": whatif.baseline(df), "scenarios": whatif.what_if(df, specs, mode)}


def run_all(
    df: DataFrame, config: EngineConfig = EngineConfig(), derived: Sequence[Mapping[str, str]] = (),
    chart_specs: Sequence[Mapping] = (), tests: Sequence[Mapping] | None = None, scenarios: Sequence[Mapping] = (),
    keys: Sequence[str] = (), target: str | None = None, exclude: Sequence[str] | None = None,
    model_names: Sequence[str] | None = None, write_stages: bool = True,
) -> tuple[dict[str, DataFrame], models.Leaderboard]:
    """Every stage in order: (named DataFrames, leaderboard).

    With ``write_stages`` the cleaned table and the features are written once to the shared folder, since
    the later stages read them many times.
    """
    cleaned, results = preprocess(df, config, derived, keys)
    if write_stages:
        cleaned = materialise(cleaned, "cleaned")
    made = build_features(cleaned, config, target, keys, exclude)
    if write_stages:
        made.table = materialise(made.table, "features")
    results |= {"cleaned": cleaned, "features": made.table}
    drawn, _ = charts.chart_data(cleaned, chart_specs)
    results |= {f"chart: {spec['title']}": table for spec, table in drawn}
    analysed, board = analyse(cleaned, made, config, tests, model_names)
    results |= analysed
    results |= what_if(cleaned, scenarios, keys=keys)
    return results, board
