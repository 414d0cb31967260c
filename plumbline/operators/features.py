"""Feature stage: encoding, scaling, selection, projection, assembly."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from plumbline.config import EngineConfig
from plumbline.functions.lookup import BROADCAST_ROWS, attach, bounded_copy
from plumbline.functions.ranks import with_rank
from plumbline.operators import cells
from plumbline.operators.profile import unpivot
from plumbline.plans.roles import datetime_columns, numeric_columns, quoted
from plumbline.session import materialise

# Widest one-hot block written as separate columns; beyond it the sparse vector form applies.
ONEHOT_COLUMNS = 2_000


def category_values(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, list[str] | None]:
    """Sorted distinct non-null values of each column, None for one with more than ``limit``."""
    if not cols:
        return {}
    distinct = unpivot(df, cols).filter("value IS NOT NULL").distinct()
    sizes = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
    values: dict[str, list[str] | None] = {c: [] if sizes.get(c, 0) <= limit else None for c in cols}
    narrow = [c for c, found in values.items() if found is not None]
    for r in distinct.filter(F.col("column").isin(narrow)).collect() if narrow else []:  # at most limit values a column
        values[r["column"]].append(r["value"])
    return {c: found if found is None else sorted(found) for c, found in values.items()}


def encode_onehot(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """0/1 columns ``{col}_{value}`` for every sorted value but the first; the source column goes.

    A column with more than ``limit`` values (``ONEHOT_COLUMNS`` by default) becomes one sparse vector ``{col}_onehot`` with the same places.
    """
    for c, values in category_values(df, cols, ONEHOT_COLUMNS if limit is None else limit).items():
        if values is None:
            df = encode_onehot_vector(df, c).drop(c)
            continue
        source = F.col(quoted(c))
        blocks = {f"{c}_{v}": F.coalesce((source == F.lit(v)).cast("double"), F.lit(0.0)) for v in values[1:]}
        df = df.withColumns(blocks).drop(c) if blocks else df.drop(c)
    return df


def encode_onehot_vector(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """The same encoding as one sparse vector, for columns too wide for separate columns.

    Position i stands for the (i+1)-th sorted value; the smallest value and NULL are all zeros.
    """
    ranks = label_ranks(df, column)
    width = max(ranks.count() - 1, 0)
    coded = attach(df, ranks, [column], "n")
    hot = F.col("label") > 0
    place = F.when(hot, F.array((F.col("label") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    one = F.when(hot, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    parts = F.struct(F.lit(0).alias("type"), F.lit(width).alias("size"), place.alias("indices"), one.alias("values"))
    # The encoder of MLlib names every place in the column's metadata, on the driver; here it only knows how many there are.
    name = output or f"{column}_onehot"
    kept = [F.col(quoted(c)) for c in df.columns if c != name]
    return coded.select(*kept, _sparse(parts).alias(name, metadata={"ml_attr": {"num_attrs": width}}))


def _sparse(parts: Column) -> Column:
    """A sparse vector from the struct of its stored form (type 0, size, indices, values); only JSON reads a struct into a type of the user's."""
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), StructType([StructField("v", VectorUDT())]))["v"]


def label_ranks(df: DataFrame, column: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(column, label, n): 0-based rank of each sorted distinct value.

    Few values are ranked in one small window. Many are put in order by one range partitioning, whose partition sizes give the ranks,
    so no task sorts them all and no value is compared with more than its neighbours.
    """
    counts = df.filter(F.col(quoted(column)).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    small = bounded_copy(counts, max_rows)
    if small is not None:
        order = Window.partitionBy(F.lit(0)).orderBy(column)
        return small.select(column, (F.row_number().over(order) - 1).cast("bigint").alias("label"), "n")
    return with_rank(counts, [quoted(column)], "label").select(column, "label", "n")


def encode_label(df: DataFrame, cols: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Replace each column by the 0-based rank of its sorted distinct values, in place."""
    order = df.columns
    for c in cols:
        ranks = label_ranks(df, c, max_rows=max_rows)
        coded = attach(df, ranks, [c], "n", max_rows)
        df = coded.drop(c).withColumnRenamed("label", c).select(*[F.col(quoted(n)) for n in order])
    return df


def encode(df: DataFrame, cols: Sequence[str], method: str = "onehot") -> DataFrame:
    if method == "onehot":
        return encode_onehot(df, cols)
    if method == "label":
        return encode_label(df, cols)
    raise ValueError(f"unknown encoding {method!r}; use 'onehot' or 'label'")


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard", refuse_empty: bool = False) -> dict[str, tuple[float, float]]:
    """(shift, width) per column from one aggregate; width 0 marks a constant column."""
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling {method!r}; use 'standard' or 'minmax'")
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(quoted(c)).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs, F.count("*").alias("rows")).first() if aggs else {}
    if cols and refuse_empty and not row["rows"]:
        raise ValueError("no rows to fit the scaler on")
    fitted = {}
    for i, c in enumerate(cols):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is None:
            fitted[c] = (0.0, 0.0)
        elif low == high:
            fitted[c] = (low, 0.0)
        elif method == "standard":
            fitted[c] = (row[f"m{i}"], row[f"s{i}"])
        else:
            fitted[c] = (low, high - low)
    return fitted


def fill_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing values of features take their column's mean, 0 where the column has none; models accept no NULL."""
    vectors = vector_columns(df, names)
    names = [n for n in names if df.schema[n].nullable and n not in vectors]
    if not names:
        return df
    row = df.agg(
        *[F.avg(F.col(quoted(n)).cast("double")).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.count_if(F.col(quoted(n)).isNull()).alias(f"z{i}") for i, n in enumerate(names)],
    ).first()
    filled = {
        n: F.coalesce(F.col(quoted(n)).cast("double"), F.lit(row[f"m{i}"] or 0.0)) for i, n in enumerate(names) if row[f"z{i}"]
    }
    return df.withColumns(filled) if filled else df


def apply_scaler(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Scaled columns in place; constant columns become 0 and NULL stays NULL."""

    def scaled(c: str) -> Column:
        shift, width = fitted[c]
        v = F.col(quoted(c)).cast("double") - F.lit(shift)
        return v / F.lit(width) if width else F.when(v.isNotNull(), F.lit(0.0))

    return df.select(*[scaled(c).alias(c) if c in fitted else F.col(quoted(c)) for c in df.columns])


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """Scale ``cols``; ``fit_on`` takes the statistics from other rows, such as the training part."""
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols, method, refuse_empty=fit_on is not None))


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """ANOVA F of each feature grouped by the target's values: (feature, score), best first.

    Feature vectors are summarised by target value, then the groups again: group means weighted by size give
    the spread between groups, group variances weighted by size - 1 the mean square within. Also right
    when the target has as many values as there are rows, as the groups stay on the executors. A first
    pass takes the overall means, since the summaries lose accuracy on columns far from zero.
    """
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.filter(F.col(quoted(target)).isNotNull()).select(
        F.col(quoted(target)).alias("_y"), *[F.col(quoted(c)).cast("double").alias(n) for n, c in zip(names, features)]
    )
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], "feature string, score double")
    means = assemble_vector(rows, names, "_v").agg(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    centred = rows.select("_y", *[(F.col(n) - F.lit(float(m))).alias(n) for n, m in zip(names, means)])
    vectors = assemble_vector(centred, names, "_v")
    per_group = Summarizer.metrics("mean", "variance").summary(F.col("_v"))
    groups = vectors.groupBy("_y").agg(per_group.alias("s"), F.count("*").cast("double").alias("w"))
    # The summary needs some weight even when every group has one row.
    inner = F.greatest(F.col("w") - 1, F.lit(1e-300))
    total = groups.agg(
        F.count("*").cast("double").alias("k"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("ww"),
        Summarizer.variance(F.col("s.mean"), F.col("w")).alias("spread"), Summarizer.mean(F.col("s.variance"), inner).alias("within"),
    )
    spread, within = vector_to_array("spread"), vector_to_array("within")
    # The summary's variance of weighted values is their sum of squares over n - sum(w^2) / n.
    share = (F.col("n") - F.try_divide(F.col("ww"), F.col("n"))) / F.nullif(F.col("k") - 1, F.lit(0.0))
    entries = [
        F.struct(F.lit(c).alias("feature"), _ratio(spread[i] * share, within[i]).alias("score"))
        for i, c in enumerate(features)
    ]
    return total.select(F.inline(F.array(*entries))).orderBy(F.col("score").desc_nulls_last(), "feature")


def _place_scores(places: DataFrame, sizes: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(``sums``..., score) from one row per place and target value: (``sums``..., _y, s, ss), the place's sum and sum of squares there.

    A place is 0 wherever it has no row, so what its column would add to the spread between and within the target's values follows from
    these sums and the sizes of the target's values.
    """
    groups = sizes.agg(F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("rows"))
    joined = attach(places, sizes.withColumn("_w", F.col("n")), ["_y"], "_w")
    totals = joined.groupBy(*sums).agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("explained"), F.sum("s").alias("s"), F.sum("ss").alias("ss")
    ).crossJoin(F.broadcast(groups))  # one row
    between = (F.col("explained") - F.col("s") * F.col("s") / F.col("rows")) / F.nullif(F.col("k") - 1, F.lit(0.0))
    left = F.col("ss") - F.col("explained")
    within = F.when(left > 1e-12 * F.col("ss"), left) / F.nullif(F.col("rows") - F.col("k"), F.lit(0.0))  # below that it is rounding
    return totals.select(*sums, _ratio(between, F.coalesce(within, F.lit(0.0))).alias("score"))


def _ratio(between: Column, within: Column) -> Column:
    """F; infinite for a feature that the target determines, NULL for a constant one or a constant target."""
    return F.when(within > 0, between / within).when(between > 0, F.lit(float("inf")))


def _target_sizes(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    known = df.filter(F.col(quoted(target)).isNotNull())
    return known, materialise(known.groupBy(F.col(quoted(target)).alias("_y")).agg(F.count("*").alias("n")), "target-sizes")


def category_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """ANOVA F of every 0/1 place that one-hot encoding would make of string columns: (feature, column, value, score).

    All follow from one count of (column, value, target), so no place needs a column, however many values there are. As in the encoding, the first
    value of a column has no place and NULL is in none.
    """
    known, sizes = _target_sizes(df, target)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("value")) for c in columns]
    cells = known.select(F.col(quoted(target)).alias("_y"), F.inline(F.array(*pairs))).filter("value IS NOT NULL")
    counts = materialise(cells.groupBy("column", "value", "_y").agg(F.count("*").cast("double").alias("s")), "cells").withColumn("ss", F.col("s"))
    first = df.select(F.inline(F.array(*pairs))).groupBy("column").agg(F.min("value").alias("_first"))  # one row per column
    scored = _place_scores(counts, sizes, ["column", "value"]).join(F.broadcast(first), "column").filter("value <> _first")
    return scored.select(F.concat_ws("_", "column", "value").alias("feature"), "column", "value", "score")


def _active(vector: str) -> Column:
    """The places of a vector that are not 0, with their values."""
    parts = F.unwrap_udt(F.col(quoted(vector)))
    places = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return F.filter(F.arrays_zip(places.alias("place"), parts["values"].alias("x")), lambda e: e["x"] != 0)


def vector_scores(df: DataFrame, vectors: Sequence[str], target: str) -> DataFrame:
    """ANOVA F of every place of vector columns: (feature, column, place, score), from sums over the places that are not 0."""
    known, sizes = _target_sizes(df, target)
    parts = []
    for v in vectors:
        cells = known.filter(F.col(quoted(v)).isNotNull()).select(F.col(quoted(target)).alias("_y"), F.explode(_active(v)).alias("e"))
        parts.append(cells.select(F.lit(v).alias("column"), F.col("e.place").alias("place"), "_y", F.col("e.x").alias("x")))
    cells = parts[0]
    for more in parts[1:]:
        cells = cells.unionByName(more)
    sums = cells.groupBy("column", "place", "_y").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    scored = _place_scores(sums, sizes, ["column", "place"])
    return scored.select(F.format_string("%s[%d]", "column", "place").alias("feature"), "column", "place", "score")


def best_features(df: DataFrame, features: Sequence[str], target: str, k: int = 10, categories: Sequence[str] = ()) -> dict[str, Column]:
    """The k best features by F score, best first, as names and expressions over ``df``; k is a report size, all are scored.

    Candidates are the number columns of ``features``, every place of its vector columns, and every one-hot place of the string columns
    ``categories``, which are not encoded for it. What is chosen does not depend on how many values a category has.
    """
    vectors = vector_columns(df, features)
    numbers = [f for f in features if f not in vectors]
    key = "feature string, score double, column string, value string, place int"
    none = lambda kind: F.lit(None).cast(kind)
    scored = df.sparkSession.createDataFrame([], key)
    if numbers:
        scored = scored.unionByName(f_scores(df, numbers, target).select("feature", "score", F.col("feature").alias("column"), none("string").alias("value"), none("int").alias("place")))
    if categories:
        scored = scored.unionByName(category_scores(df, categories, target).select("feature", "score", "column", "value", none("int").alias("place")))
    if vectors:
        scored = scored.unionByName(vector_scores(df, list(vectors), target).select("feature", "score", "column", none("string").alias("value"), "place"))
    chosen = {}
    for row in scored.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k).collect():
        source = F.col(quoted(row["column"]))
        if row["value"] is not None:
            chosen[row["feature"]] = F.coalesce((source == F.lit(row["value"])).cast("double"), F.lit(0.0))
        elif row["place"] is not None:
            chosen[row["feature"]] = _place(row["column"], row["place"])
        else:
            chosen[row["feature"]] = source
    return chosen


def _place(vector: str, place: int) -> Column:
    hit = F.filter(_active(vector), lambda e: e["place"] == place)
    return F.coalesce(F.get(hit, F.lit(0))["x"], F.lit(0.0))


def select_k_best(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> list[str]:
    """The names of the k best features by F score, best first; places of vector columns are named ``vector[place]``."""
    return list(best_features(df, features, target, k))


def vector_columns(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """The width of each named column that holds vectors; all rows of one have the same."""
    found = [n for n in names if isinstance(df.schema[n].dataType, VectorUDT)]
    row = df.select(*[F.col(quoted(n)) for n in found]).first() if found else None
    return {n: row[i].size if row else 0 for i, n in enumerate(found)}


def assemble_vector(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)


def _forest(task: str, config: EngineConfig, features_col: str, target: str):
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    return kind(
        featuresCol=features_col, labelCol=target, numTrees=config.forest_trees, maxDepth=config.forest_depth,
        featureSubsetStrategy="sqrt" if task == "classification" else "all", seed=config.seed,
    )


def _evaluator(task: str, target: str):
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol=target, metricName="accuracy")
    return RegressionEvaluator(labelCol=target, metricName="r2")


def _eliminate(fit: Callable, score: Callable | None, slots: Sequence[int], step: int | None, stop: int) -> tuple[list[list[int]], list[float]]:
    """Fit, score, drop the weakest, repeat down to ``stop`` places; ``fit`` and ``score`` are told the places left."""
    left, kept, scores = list(slots), [], []
    while True:
        model = fit(left)
        kept.append(list(left))
        if score is not None:
            scores.append(score(model, left))
        if len(left) <= stop:
            return kept, scores
        weight = dict(zip(left, model.featureImportances.toArray()))
        gone = step or max(1, len(left) // 10)
        weakest = set(sorted(left, key=lambda i: (weight[i], -i))[: min(gone, len(left) - stop)])
        left = [i for i in left if i not in weakest]


def recursive_elimination(
    df: DataFrame, features: Sequence[str], target: str, fold: str,
    config: EngineConfig = EngineConfig(), step: int | None = None, min_features: int = 1,
) -> tuple[list[str], dict[str, int]]:
    """Recursive elimination with cross-validation over the ``fold`` column: (kept, ranking).

    Each fold eliminates on its training rows and scores every subset on its held-out rows; the size
    with the best mean score (the smallest on a tie) is then eliminated to on all rows. Kept features
    rank 1, the others by the round that dropped them. A vector column counts as one feature per place, named ``vector[place]``, like the
    columns it stands for. A round drops ``step`` features, by default one of up to 19 and a tenth of more. Rows are assembled and written once; every fit reads them,
    or for regression their counted cells (``cells.counted``) where rows share them, folds side by side.
    """
    features = list(features)
    vectors = vector_columns(df, features)
    names = [n for f in features for n in ([f"{f}[{i}]" for i in range(vectors[f])] if f in vectors else [f])]
    cols = [F.col(quoted(c)) if c in vectors else F.col(quoted(c)).cast("double").alias(c) for c in features]
    rows = assemble_vector(df.select(*cols, F.col(quoted(target)).cast("double").alias("_y"), F.col(quoted(fold)).alias("_part")), features, "_all")
    rows = rows.select(F.col("_all").alias("all"), F.col("_y").alias("y"), F.col("_part").alias("part"), F.monotonically_increasing_id().alias("row"))
    data = materialise(rows, "elimination")
    counted = None if config.task == "classification" else cells.counted(data, F.col("part"), F.col("row"), config.forest_trees, config.seed, "all", "y")
    evaluator = _evaluator(config.task, "y")
    slicer = lambda left: VectorSlicer(inputCol="all", outputCol="features", indices=left)

    def fitted(part: int | None, left: list[int]):
        if counted is not None:
            train = counted if part is None else counted.without(part)
            return cells.forest(train.places(left), config.forest_trees, config.forest_depth, config.seed)
        train = data if part is None else data.filter(F.col("part") != part)
        return _forest(config.task, config, "features", "y").fit(slicer(left).transform(train).select("features", "y"))

    def scored(part: int, model, left: list[int]) -> float:
        if counted is not None:
            found = cells.r2(model, counted.only(part).places(left))
            return float("nan") if found is None else found
        return evaluator.evaluate(model.transform(slicer(left).transform(data.filter(F.col("part") == part))))

    def run(i: int) -> tuple[list[list[int]], list[float]]:
        return _eliminate(partial(fitted, i), partial(scored, i), range(len(names)), step, min_features)

    with ThreadPoolExecutor(config.parallel_fits) as pool:
        runs = list(pool.map(run, range(config.folds)))
    sizes = [len(s) for s in runs[0][0]]
    totals = [sum(scores[i] for _, scores in runs) for i in range(len(sizes))]
    best = max(range(len(sizes)), key=lambda i: (totals[i], -sizes[i]))
    kept, _ = _eliminate(partial(fitted, None), None, range(len(names)), step, sizes[best])
    ranking = {names[i]: 1 for i in kept[-1]}
    for rank, subset in enumerate(reversed(kept[:-1]), start=2):
        ranking |= {names[i]: rank for i in subset if names[i] not in ranking}
    return [names[i] for i in kept[-1]], ranking


def with_places(df: DataFrame, names: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for every name that is a place of a vector of ``features``, and the names of its feature columns.

    A vector all of whose places are named stays as it is.
    """
    names, wanted = list(names), set(names)
    for v, width in vector_columns(df, features).items():
        places = [f"{v}[{i}]" for i in range(width)]
        if width and wanted.issuperset(places):
            at = min(names.index(p) for p in places)
            own = set(places)
            names = [n for n in names[:at] if n not in own] + [v] + [n for n in names[at:] if n not in own]
        else:
            df = df.withColumns({p: _place(v, i) for i, p in enumerate(places) if p in wanted} or {v: F.col(quoted(v))})
    return df, names


def selectable_features(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric, boolean and vector columns but the target; datetimes drop out."""
    usable = set(numeric_columns(df)) | {f.name for f in df.schema if isinstance(f.dataType, (BooleanType, VectorUDT))}
    return [c for c in df.columns if c in usable and c != target and c not in exclude and c not in datetime_columns(df)]


def principal_components(df: DataFrame, features: Sequence[str], n: int = 2, keep: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
    """(rows with PC1..PCn and the ``keep`` columns, explained variance ratios).

    Columns are mean-centred first, which the transformer does not do itself. Signs are arbitrary.
    """
    means = df.agg(*[F.avg(F.col(quoted(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    centred = df.select(
        *[F.col(quoted(c)) for c in keep],
        *[(F.col(quoted(c)).cast("double") - F.lit(means[f"m{i}"])).alias(f"_x{i}") for i, c in enumerate(features)],
    )
    vectors = assemble_vector(centred, [f"_x{i}" for i in range(len(features))], "_v")
    model = PCA(k=n, inputCol="_v", outputCol="_pc").fit(vectors)
    parts = vector_to_array(F.col("_pc"))
    out = model.transform(vectors).select(
        *[F.col(quoted(c)) for c in keep], *[parts[i].alias(f"PC{i + 1}") for i in range(n)]
    )
    return out, [float(v) for v in model.explainedVariance]


def feature_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Selected features in order, the target last."""
    return df.select(*[F.col(quoted(c)) for c in [*features, target]])
