"""Splits, folds, model fitting on MLlib, metrics, leaderboards and model interpretation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.config import EngineConfig
from plumbline.functions.lookup import attach
from plumbline.functions.quantiles import MAP_LIMIT, order_statistics
from plumbline.functions.ranks import with_rank
from plumbline.operators import cells, linear
from plumbline.operators.features import label_ranks, vector_columns
from plumbline.operators.neighbours import knn_classify
from plumbline.plans.roles import quoted
from plumbline.session import materialise

_BUCKETS = 1000

REGRESSION_METRICS = ["train_mse", "test_mse", "train_mae", "test_mae", "train_r2", "test_r2"]
CLASSIFICATION_METRICS = [
    f"{part}_{m}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc") for part in ("train", "test")
]


# -- split and folds ---------------------------------------------------------------------------


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """Non-negative hash of the key columns and a seed: the same on every run, cluster and engine."""
    if not keys:
        raise ValueError("rows are told apart by at least one column")
    text = F.concat_ws("|", *[F.col(quoted(k)).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def is_test_row(keys: Sequence[str], share: float = 0.2, seed: int = 42) -> Column:
    return key_hash(keys, seed) % _BUCKETS < round(share * _BUCKETS)


def hash_fold(keys: Sequence[str], folds: int = 5, seed: int = 42) -> Column:
    """Fold number by key hash: no sort and no shuffle, sizes equal up to chance."""
    return (F.floor(key_hash(keys, seed) / _BUCKETS) % folds).cast("int")


def _starts(total: int, folds: int) -> list[int]:
    """First rank of each fold but the first; earlier folds take the extra rows."""
    sizes = [total // folds + (i < total % folds) for i in range(folds)]
    return [sum(sizes[:i]) for i in range(1, folds)]


def contiguous_fold(df: DataFrame, key: str, folds: int = 5, map_limit: int = MAP_LIMIT) -> Column:
    """Fold number of contiguous, equally large runs in the order of a unique numeric ``key``.

    The fold borders are order statistics of the key, so nothing is sorted or windowed.
    """
    total = df.agg(F.count(F.col(quoted(key)))).first()[0]
    starts = [s for s in _starts(total, folds) if 0 < s < total]
    found = order_statistics(df.select(F.col(quoted(key)).alias("k")), {"k": [(s, s) for s in starts]}, map_limit) if starts else {}
    fold = F.lit(0)
    for s in starts:
        fold = fold + (F.col(quoted(key)) >= F.lit(found["k", s])).cast("int")
    return fold


def with_stratified_fold(df: DataFrame, key: str, label: str, folds: int = 5, output: str = "fold") -> DataFrame:
    """``df`` with a fold number of equal class shares; within a class the folds are runs in the order of a unique ``key``.

    Rows without a label have no fold. Ranks over (label, key) give every class its start and size, and the rest is arithmetic
    on them, so neither classes nor borders are listed anywhere.
    """
    known, unknown = df.filter(F.col(quoted(label)).isNotNull()), df.filter(F.col(quoted(label)).isNull())
    ranked = with_rank(known, [quoted(label), quoted(key)], "_rank")
    classes = ranked.groupBy(quoted(label)).agg(F.count("*").alias("_n"), F.min("_rank").alias("_before"))
    placed = attach(ranked, classes.withColumn("_size", F.col("_n")), [label], "_n")
    # Sorted labels are dealt to the folds in turn; fold f gets the class's places off, off + folds, ...
    share = lambda f: F.ceil(F.greatest(F.col("_size") - F.pmod(F.lit(f) - F.col("_before"), F.lit(folds)), F.lit(0)) / folds)
    fold, start = F.lit(0), F.lit(0)
    for f in range(folds - 1):
        start = start + share(f)
        fold = fold + (F.col("_rank") - F.col("_before") >= start).cast("int")
    return placed.select(*[F.col(quoted(c)) for c in df.columns], fold.alias(output)).unionByName(unknown.withColumn(output, F.lit(None).cast("int")))


# -- metrics -----------------------------------------------------------------------------------


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, mse, mae, r2) from one aggregate over the predictions."""
    y, p = F.col(quoted(label)).cast("double"), F.col(quoted(prediction)).cast("double")
    mse = F.avg((y - p) * (y - p))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), mse.alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
    )


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, accuracy, precision, recall, f1), the last three weighted by class size.

    All from the counts of (label, prediction); an undefined ratio counts as 0.
    """
    by = list(by)
    cells = df.groupBy(*by, F.col(quoted(label)).alias("y"), F.col(quoted(prediction)).cast(df.schema[label].dataType).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"), hit.cast("bigint").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("bigint").alias("hit")),
    )
    classes = cells.select(*by, F.inline(roles)).groupBy(*by, "c").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit")
    )
    zero = lambda ratio: F.coalesce(ratio, F.lit(0.0))
    precision = zero(F.try_divide(F.col("hit"), F.col("claimed")))
    recall = zero(F.try_divide(F.col("hit"), F.col("support")))
    scored = classes.withColumns({"precision": precision, "recall": recall})
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    weighted = lambda c: F.try_divide(F.sum(F.col("support") * c), F.sum("support"))
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"),
        weighted(F.col("precision")).alias("precision"),
        weighted(F.col("recall")).alias("recall"),
        weighted(f1).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Exact area under the ROC curve of a 0/1 label, ties shared; None unless both classes occur."""
    if df.select(F.count_distinct(F.col(quoted(label)))).first()[0] != 2:
        return None
    rows = df.select(F.col(quoted(label)).cast("double").alias("label"), F.col(quoted(score)).cast("double").alias("score"))
    # numBins=0 keeps every distinct score; the default would thin them out.
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0).evaluate(rows)


# -- modelling data ----------------------------------------------------------------------------


@dataclass
class ModelData:
    """Written rows (id, features, label, is_test, fold) and what they were made from.

    ``vectors`` holds the width of each feature that is a vector, ``classes`` the label of each class value (``_y``).
    """

    rows: DataFrame
    features: list[str]
    assembler: VectorAssembler
    vectors: dict[str, int] = field(default_factory=dict)
    classes: DataFrame | None = None

    @cached_property
    def class_count(self) -> int:
        return 0 if self.classes is None else self.classes.count()

    @property
    def slots(self) -> list[str]:
        """One name per coefficient of a model: a vector feature has one per place."""
        return [name for f in self.features for name in ([f"{f}[{i}]" for i in range(self.vectors[f])] if f in self.vectors else [f])]

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("NOT is_test")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("is_test")


def prepare(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], config: EngineConfig = EngineConfig()) -> ModelData:
    """Assemble once, split by key hash and assign hash folds; class labels become 0..k-1 in order."""
    features = list(features)
    vectors = vector_columns(df, features)
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    numbers = df.filter(F.col(quoted(target)).isNotNull()).select(
        *[F.col(quoted(f)) if f in vectors else F.col(quoted(f)).cast("double").alias(f) for f in features if f not in keys],
        *[F.col(quoted(k)) for k in keys],
        F.col(quoted(target)).alias("_y"),
    )
    rows = assembler.transform(numbers).select(
        F.concat_ws("|", *[F.col(quoted(k)).cast("string") for k in keys]).alias("id"),
        "features", "_y",
        is_test_row(keys, config.test_share, config.seed).alias("is_test"),
        hash_fold(keys, config.folds, config.seed).alias("fold"),
    )
    classes = None
    if config.task == "classification":
        classes = materialise(label_ranks(numbers.select("_y"), "_y"), "classes")
        rows = attach(rows, classes, ["_y"], "n")
    label = F.col("label" if classes is not None else "_y").cast("double").alias("label")
    rows = materialise(rows.select("id", "features", label, "is_test", "fold"), "model-rows")
    return ModelData(rows, features, assembler, vectors, classes)


# -- estimators --------------------------------------------------------------------------------

Predictor = Callable[[DataFrame], DataFrame]


def _linear(train: DataFrame, config: EngineConfig):
    return _least(train, "linear", linear.least_squares)


def ridge(train: DataFrame, alpha: float = 1.0, label: str = "label", features: str = "features"):
    """min |y - Xw|^2 + alpha |w|^2."""
    return _least(train, "ridge", lambda m: linear.ridge(m, alpha), label, features, alpha)


def lasso(train: DataFrame, alpha: float = 1.0, label: str = "label", features: str = "features"):
    """min |y - Xw|^2 / (2n) + alpha |w|_1."""
    return _least(train, "lasso", lambda m: linear.lasso(m, alpha), label, features, alpha)


def _least(train: DataFrame, name: str, solver: Callable, label: str = "label", features: str = "features", alpha: float = 1.0):
    if linear.width_of(train, features) > linear.WIDEST:
        return linear.descend(train, name, alpha, features, label)
    return linear.fit(train, solver, features, label)


def _counted(train: DataFrame, trees: int, config: EngineConfig) -> cells.Cells | None:
    """Training rows counted by bins and fold, where rows are told apart and share bins."""
    if "id" not in train.columns:
        return None
    return cells.counted(train, F.col("fold") if "fold" in train.columns else F.lit(0), F.col("id"), trees, config.seed)


def _cell_forest(counted: cells.Cells, config: EngineConfig):
    return cells.forest(counted, config.forest_trees, config.forest_depth, config.seed)


def _cell_boosted(counted: cells.Cells, config: EngineConfig):
    return cells.boosted(counted, config.boosting_stages, 3, 0.1, config.seed)


# Fits that need no more than counted cells.
_FROM_CELLS = {"random_forest": _cell_forest, "gradient_boosting": _cell_boosted}


def _forest_regressor(train: DataFrame, config: EngineConfig):
    counted = _counted(train, config.forest_trees, config)
    if counted is not None:
        return _cell_forest(counted, config)
    return RandomForestRegressor(
        numTrees=config.forest_trees, maxDepth=config.forest_depth, featureSubsetStrategy="all", seed=config.seed
    ).fit(train)


def _boosted_regressor(train: DataFrame, config: EngineConfig):
    counted = _counted(train, 0, config)
    if counted is not None:
        return _cell_boosted(counted, config)
    return GBTRegressor(maxIter=config.boosting_stages, maxDepth=3, stepSize=0.1, seed=config.seed).fit(train)


REGRESSORS: dict[str, Callable] = {
    "linear": _linear,
    "ridge": lambda train, config: ridge(train),
    "lasso": lambda train, config: lasso(train),
    "random_forest": _forest_regressor,
    "gradient_boosting": _boosted_regressor,
}


def _logistic(train: DataFrame, config: EngineConfig):
    return LogisticRegression(regParam=1.0 / max(1, train.count()), standardization=False).fit(train)


def _tree(train: DataFrame, config: EngineConfig):
    return DecisionTreeClassifier(maxDepth=config.forest_depth, seed=config.seed).fit(train)


def _is_binary(train: DataFrame) -> bool:
    return train.agg(F.max("label")).first()[0] <= 1.0


# Numbers of the feature vectors in one task of a fit that passes over the rows hundreds of times.
_TASK_CELLS = 8_000_000


def _few_tasks(train: DataFrame, rows: int) -> DataFrame:
    """``train`` in no more tasks than its size asks for: each step of a fit is a job, and starting tasks costs more than short ones take."""
    return train.coalesce(max(1, -(-rows * linear.width_of(train, "features") // _TASK_CELLS)))


def _linear_svm(train: DataFrame, config: EngineConfig):
    rows = train.count()
    train = _few_tasks(train, rows)
    machine = LinearSVC(regParam=1.0 / max(1, rows), maxIter=50, tol=1e-4)
    return (machine if _is_binary(train) else OneVsRest(classifier=machine, parallelism=config.parallel_fits)).fit(train)


def _forest_classifier(train: DataFrame, config: EngineConfig):
    return RandomForestClassifier(numTrees=config.forest_trees, maxDepth=config.forest_depth, seed=config.seed).fit(train)


def _boosted_classifier(train: DataFrame, config: EngineConfig):
    booster = GBTClassifier(maxIter=config.boosting_stages, maxDepth=3, stepSize=0.1, seed=config.seed)
    return (booster if _is_binary(train) else OneVsRest(classifier=booster, parallelism=config.parallel_fits)).fit(train)


class NearestNeighbours:
    """k-nearest-neighbour classifier with the transform of a fitted model."""

    def __init__(self, train: DataFrame, k: int = 5):
        self.train = train.select("id", vector_to_array("features").alias("v"), "label")
        self.k = k

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``; rows are told apart by ``id``, which is made up where there is none."""
        given = rows.columns
        if "id" not in given:
            rows = materialise(rows.withColumn("id", F.monotonically_increasing_id().cast("string")), "probes")
        probes = rows.select("id", vector_to_array("features").alias("v"))
        return rows.join(knn_classify(self.train, probes, "label", "id", "v", self.k), "id").select(*given, "prediction")


CLASSIFIERS: dict[str, Callable] = {
    "logistic": _logistic,
    "decision_tree": _tree,
    "nearest_neighbours": lambda train, config: NearestNeighbours(train),
    "linear_svm": _linear_svm,
    "random_forest": _forest_classifier,
    "gradient_boosting": _boosted_classifier,
}


# -- leaderboards ------------------------------------------------------------------------------


def _scores(model, data: ModelData, task: str) -> dict[str, float | None]:
    """Metrics on both parts; the predictions are computed once and kept as three narrow columns."""
    predicted = model.transform(data.rows)
    has_score = task == "classification" and data.class_count == 2
    score = F.lit(None).cast("double")
    if has_score:
        score = vector_to_array("rawPrediction")[1] if "rawPrediction" in predicted.columns else F.col("prediction").cast("double")
    narrow = predicted.select("label", "is_test", "prediction", score.alias("score")).persist()
    try:
        if task == "regression":
            rows, names = regression_metrics(narrow, "label", by=["is_test"]).collect(), ("mse", "mae", "r2")
        else:
            rows = classification_metrics(narrow, "label", by=["is_test"]).collect()
            names = ("accuracy", "precision", "recall", "f1")
        out: dict[str, float | None] = {}
        for r in rows:
            out |= {f"{'test' if r['is_test'] else 'train'}_{m}": r[m] for m in names}
        if task == "classification":
            for part, flag in (("train", False), ("test", True)):
                out[f"{part}_roc_auc"] = roc_auc(narrow.filter(F.col("is_test") == flag), "label", "score") if has_score else None
        return out
    finally:
        narrow.unpersist()


def cross_validate(fit: Callable, data: ModelData, config: EngineConfig) -> tuple[float, float]:
    """Mean and population deviation of R2 or accuracy over the folds of the training rows."""
    def run(fold: int) -> float | None:
        train, held = data.train.filter(F.col("fold") != fold), data.train.filter(F.col("fold") == fold)
        predicted = fit(train, config).transform(held)
        if config.task == "regression":
            return regression_metrics(predicted, "label").first()["r2"]
        return classification_metrics(predicted, "label").first()["accuracy"]

    with ThreadPoolExecutor(config.parallel_fits) as pool:
        scores = list(pool.map(run, range(config.folds)))
    return _mean_and_deviation(scores)


def _mean_and_deviation(scores: Sequence[float | None]) -> tuple[float, float]:
    if not scores or any(s is None for s in scores):  # a fold without a score leaves no mean over all folds
        return float("nan"), float("nan")
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


@dataclass
class NeighbourPipeline:
    """Assembler and nearest neighbours: transforms like a pipeline; its training rows are saved with it."""

    assembler: VectorAssembler
    model: NearestNeighbours

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.assembler.transform(rows))

    def save(self, path: str) -> None:
        PipelineModel([self.assembler]).write().overwrite().save(f"{path}/assembler")
        self.model.train.withColumn("k", F.lit(self.model.k)).write.mode("overwrite").parquet(f"{path}/neighbours")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "NeighbourPipeline":
        rows = spark.read.parquet(f"{path}/neighbours")
        first = rows.select("k").first()
        model = NearestNeighbours.__new__(NearestNeighbours)
        model.train, model.k = rows.drop("k"), first["k"] if first else 5
        return cls(PipelineModel.load(f"{path}/assembler").stages[0], model)


@dataclass
class Leaderboard:
    table: DataFrame
    models: dict
    best: str
    data: ModelData

    def best_pipeline(self) -> PipelineModel | NeighbourPipeline:
        """Assembler and winner as one saveable model."""
        winner = self.models[self.best]
        if isinstance(winner, NearestNeighbours):
            return NeighbourPipeline(self.data.assembler, winner)
        return PipelineModel([self.data.assembler, winner])


def _errors(models: Mapping[str, object], data: ModelData) -> dict[str, dict[str, float | None]]:
    """Scores of fitted regressors on both parts, all from one pass over the rows."""
    predicted = data.rows
    for name, model in models.items():
        predicted = model.copy().setPredictionCol(f"_{name}").transform(predicted)
    y, aggregates = F.col("label"), []
    for name in models:
        off = y - F.col(f"_{name}")
        aggregates += [F.avg(off * off).alias(f"{name}_mse"), F.avg(F.abs(off)).alias(f"{name}_mae"), (1 - F.try_divide(F.avg(off * off), F.var_pop(y))).alias(f"{name}_r2")]
    scores: dict[str, dict[str, float | None]] = {name: {} for name in models}
    for row in predicted.filter(y.isNotNull()).groupBy("is_test").agg(*aggregates).collect():
        for name in models:
            scores[name] |= {f"{'test' if row['is_test'] else 'train'}_{m}": row[f"{name}_{m}"] for m in ("mse", "mae", "r2")}
    return scores


def _linear_board(data: ModelData, names: Sequence[str], config: EngineConfig) -> tuple[dict, dict[str, dict[str, float | None]]]:
    """Models and scores of the linear ones: all folds of all of them from one pass, their errors from another."""
    parts = linear.moments(data.rows, F.when(F.col("is_test"), F.lit(-1)).otherwise(F.col("fold")))
    folds = {f: parts[f] for f in range(config.folds) if f in parts}
    whole = linear.total(folds)
    if whole is None:
        raise ValueError("no training rows to fit models on")
    models = {name: linear.as_model(data.rows.sparkSession, *linear.SOLVERS[name](whole)) for name in names}

    scores = _errors(models, data)
    for name in names:
        held = []
        for f in range(config.folds):
            rest = linear.total(folds, but=f)
            held.append(folds[f].r2(*linear.SOLVERS[name](rest)) if f in folds and rest is not None else None)
        scores[name]["cv_mean"], scores[name]["cv_std"] = _mean_and_deviation(held)
    return models, scores


def _tree_board(data: ModelData, names: Sequence[str], config: EngineConfig) -> tuple[dict, dict[str, dict[str, float | None]]]:
    """Models and scores of tree ensembles, all fits from one count of cells; none where the rows share no cells."""
    counted = _counted(data.train, config.forest_trees if "random_forest" in names else 0, config)
    if counted is None:
        return {}, {}

    def held(task: tuple[str, int]) -> float | None:
        name, fold = task
        return cells.r2(_FROM_CELLS[name](counted.without(fold), config), counted.only(fold))

    tasks = [(name, fold) for name in names for fold in range(config.folds)]
    with ThreadPoolExecutor(config.parallel_fits) as pool:
        whole = {name: pool.submit(_FROM_CELLS[name], counted, config) for name in names}
        parts = dict(zip(tasks, pool.map(held, tasks)))
        models = {name: fit.result() for name, fit in whole.items()}
    scores = _errors(models, data)
    for name in names:
        scores[name]["cv_mean"], scores[name]["cv_std"] = _mean_and_deviation([parts[name, fold] for fold in range(config.folds)])
    return models, scores


def leaderboard(data: ModelData, config: EngineConfig = EngineConfig(), names: Sequence[str] | None = None) -> Leaderboard:
    """Fit every model, score it on both parts, cross-validate it, rank by test R2 or accuracy."""
    fits = REGRESSORS if config.task == "regression" else CLASSIFIERS
    metrics = REGRESSION_METRICS if config.task == "regression" else CLASSIFICATION_METRICS
    decider = "test_r2" if config.task == "regression" else "test_accuracy"
    names = list(names if names is not None else fits)
    summed = [n for n in names if fits is REGRESSORS and n in linear.SOLVERS and len(data.slots) <= linear.WIDEST]
    models, scores = _linear_board(data, summed, config) if summed else ({}, {})
    grown = [n for n in names if fits is REGRESSORS and n in _FROM_CELLS]
    if grown:
        from_cells = _tree_board(data, grown, config)
        models, scores = models | from_cells[0], scores | from_cells[1]
    for name in names:
        if name not in models:
            models[name] = fits[name](data.train, config)
            scores[name] = _scores(models[name], data, config.task)
            scores[name]["cv_mean"], scores[name]["cv_std"] = cross_validate(fits[name], data, config)
    columns = [*metrics, "cv_mean", "cv_std"]
    rank = lambda n: (-(scores[n].get(decider) if scores[n].get(decider) is not None else float("-inf")), n)
    rows = [(n, *[scores[n].get(c) for c in columns]) for n in sorted(names, key=rank)]
    table = data.rows.sparkSession.createDataFrame(rows, f"model string, {', '.join(f'{c} double' for c in columns)}")
    return Leaderboard(table, models, rows[0][0], data)


# -- interpretation ----------------------------------------------------------------------------


def coefficient_ranking(df: DataFrame, models: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """(model, rank, feature, coefficient, magnitude) of the linear models, largest first."""
    rows = []
    for name in ("linear", "ridge", "lasso"):
        if name in models:
            ranked = sorted(zip(features, models[name].coefficients.toArray()), key=lambda fc: (-abs(fc[1]), features.index(fc[0])))
            rows += [(name, i, f, float(c), abs(float(c))) for i, (f, c) in enumerate(ranked, start=1)]
    return df.sparkSession.createDataFrame(rows, "model string, rank int, feature string, coefficient double, magnitude double")


def importance_ranking(df: DataFrame, models: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """(model, rank, feature, importance) of the tree ensembles, largest first."""
    rows = []
    for name in ("random_forest", "gradient_boosting"):
        weights = getattr(models.get(name), "featureImportances", None)
        if weights is not None:
            ranked = sorted(zip(features, weights.toArray()), key=lambda fw: (-fw[1], features.index(fw[0])))
            rows += [(name, i, f, float(w)) for i, (f, w) in enumerate(ranked, start=1)]
    return df.sparkSession.createDataFrame(rows, "model string, rank int, feature string, importance double")
