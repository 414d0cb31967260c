"""Regression trees fitted on counted cells: rows whose features fall into the same bins count as one weighted row.

A tree that splits between bins needs no more of its rows than the count, the bag weights and the label sums of every combination of bins. They
are counted once, for all folds and trees, and every level of every fit reads the cells instead of the rows. Every row is counted. A bin
is known by a value in its middle and ends halfway to the next one, which is where MLlib puts a threshold between two values, so a model
fitted on cells takes raw features. Squares of labels are not needed: the spread within a cell is the same on both sides of any split.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import Bucketizer, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.quantiles import MAP_LIMIT, SKETCH_ACCURACY, column_quantiles
from plumbline.operators.linear import width_of
from plumbline.session import materialise

# Bins of a feature, as many as MLlib's trees have by default.
BINS = 32
# More features than this hardly ever share cells.
MOST_FEATURES = 16
# Rows a cell must stand for on average; with fewer, fits read the rows themselves.
ROWS_PER_CELL = 4
# Cells in one task of a fit: each level of a tree is a job, and starting tasks costs more than short ones take.
_TASK_CELLS = 200_000
# Trees whose bag weights are summed in one pass.
_TREES_A_PASS = 20


def _poisson_borders() -> list[float]:
    """Where a uniform number becomes the next larger Poisson number of mean 1."""
    share, upto, borders = math.exp(-1), 0.0, [-math.inf]
    for k in range(1, 16):
        upto += share
        share /= k
        borders.append(upto)
    return [*borders, math.inf]


@dataclass(frozen=True)
class Cells:
    """``rows``: part, x (vector of the bins' values), n, y (mean label), off (summed squares around it), w and wy (bag weights and weighted labels by tree)."""

    rows: DataFrame
    size: int

    def without(self, part: int) -> Cells:
        return replace(self, rows=self.rows.filter((F.col("part") >= 0) & (F.col("part") != part)))

    def only(self, part: int) -> Cells:
        return replace(self, rows=self.rows.filter(F.col("part") == part))

    def places(self, slots: Sequence[int]) -> Cells:
        """With the named places of the vector alone."""
        sliced = VectorSlicer(inputCol="_all", outputCol="x", indices=list(slots)).transform(self.rows.withColumnRenamed("x", "_all"))
        return replace(self, rows=sliced.drop("_all"))

    @property
    def most_bins(self) -> int:
        """A limit from which MLlib looks at every cell for thresholds, not at a sample; it takes no more than there are values."""
        return max(BINS, math.isqrt(self.size) + 1)


def _middles(values: DataFrame, names: Sequence[str]) -> tuple[int, int, dict[str, list[float]]]:
    """(rows, parts, values that stand for the bins of each column): all values where there are no more than BINS, else quantiles."""
    aggs = [F.approx_count_distinct(c).alias(f"d_{c}") for c in names] + [F.max(F.abs(F.col(c))).alias(f"m_{c}") for c in names]
    seen = values.agg(F.count("*").alias("n"), F.approx_count_distinct("part").alias("parts"), *aggs).first()
    if not seen["n"] or any(math.isinf(seen[f"m_{c}"]) for c in names):
        return 0, 0, {}
    few = [c for c in names if seen[f"d_{c}"] <= 2 * BINS]
    found = values.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    found = {c: v for c, v in found.items() if len(v) <= BINS}
    probs = [(2 * i + 1) / (2 * BINS) for i in range(BINS)]
    narrow = [c for c in names if c not in found and seen[f"d_{c}"] <= MAP_LIMIT]
    wide = [c for c in names if c not in found and c not in narrow]
    if narrow:
        found |= column_quantiles(values, narrow, probs, narrow=narrow)[0]
    if wide:
        found |= column_quantiles(values, wide, probs, accuracy=SKETCH_ACCURACY)[0]
    middles = {}
    for c in names:
        kept: list[float] = []
        for v in sorted(set(found[c])):
            if not kept or kept[-1] < (kept[-1] + v) / 2 < v:
                kept.append(v)
        middles[c] = kept
    return seen["n"], seen["parts"] + 1, middles


def counted(rows: DataFrame, part: Column, row: Column, trees: int, seed: int, features: str = "features", label: str = "label") -> Cells | None:
    """The cells of ``rows`` by ``part``, or None where there are too many of them to be worth it.

    Tree t takes a row as often as a Poisson number drawn from a hash of ``row``, which tells rows apart, as in a bootstrap. Borders of bins follow from the features of all rows.
    """
    width = width_of(rows, features)
    if not 0 < width <= MOST_FEATURES:
        return None
    names = [f"x{i}" for i in range(width)]
    values = rows.select(F.coalesce(part.cast("int"), F.lit(-1)).alias("part"), row.alias("row"), F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x"))
    values = values.select("part", "row", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    total, parts, middles = _middles(values, names)
    if not total:
        return None
    keys = ["part", *[f"b{i}" for i in range(width)]]
    parted = [c for c in names if len(middles[c]) > 1]
    borders = [[-math.inf, *[math.nextafter((a + b) / 2, math.inf) for a, b in zip(middles[c], middles[c][1:])], math.inf] for c in parted]
    binned = Bucketizer(inputCols=parted, outputCols=[f"_{c}" for c in parted], splitsArray=borders).transform(values) if parted else values
    binned = binned.select("part", "row", "y", *[(F.col(f"_{c}") if c in parted else F.lit(0)).cast("tinyint").alias(f"b{i}") for i, c in enumerate(names)])
    if parts * math.prod(len(m) for m in middles.values()) * ROWS_PER_CELL > total:
        if binned.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0] * ROWS_PER_CELL > total:
            return None

    pieces = []
    for start in range(0, max(1, trees), _TREES_A_PASS):
        some = range(start, min(trees, start + _TREES_A_PASS))
        bagged, sums = binned, []
        if not pieces:
            sums = [F.count("*").cast("double").alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * F.count("*")).alias("off")]
        if some:
            even = {f"u{t}": F.shiftrightunsigned(F.xxhash64("row", F.lit(seed), F.lit(t)), 11) * F.lit(2.0**-53) for t in some}
            draw = Bucketizer(inputCols=list(even), outputCols=[f"w{t}" for t in some], splitsArray=[_poisson_borders()] * len(some))
            bagged = draw.transform(binned.withColumns(even))
            sums += [F.array(*[F.sum(f"w{t}") for t in some]).alias(f"w_{start}"), F.array(*[F.sum(F.col(f"w{t}") * F.col("y")) for t in some]).alias(f"wy_{start}")]
        pieces.append(bagged.groupBy(*keys).agg(*sums))
    whole = reduce(lambda left, right: left.join(right, keys), pieces)
    value = lambda i, c: F.element_at(F.array(*[F.lit(float(m)) for m in middles[c]]), F.col(f"b{i}").cast("int") + 1)
    starts = range(0, trees, _TREES_A_PASS)
    joined = lambda name: F.concat(*[F.col(f"{name}_{s}") for s in starts]).alias(name)
    vector = array_to_vector(F.array(*[value(i, c) for i, c in enumerate(names)])).alias("x")
    cells = materialise(whole.select("part", vector, "n", "y", "off", *([joined("w"), joined("wy")] if trees else [])), "cells")
    size = cells.count()
    return Cells(cells.coalesce(-(-size // _TASK_CELLS)), size)


def _bagged_tree(cells: Cells, t: int, depth: int, seed: int) -> DecisionTreeRegressionModel:
    rows = cells.rows.select("x", F.col("w")[t].alias("w"), (F.col("wy")[t] / F.col("w")[t]).alias("y")).filter("w > 0")
    return DecisionTreeRegressor(featuresCol="x", labelCol="y", weightCol="w", maxDepth=depth, maxBins=cells.most_bins, seed=seed).fit(rows)


def forest(cells: Cells, trees: int, depth: int, seed: int, features: str = "features") -> RandomForestRegressionModel:
    """A forest of the library Spark ships, whose trees choose among all features."""
    spark = cells.rows.sparkSession
    fitted = [_bagged_tree(cells, t, depth, seed) for t in range(trees)]
    jvm = spark._jvm.org.apache.spark.ml.regression
    listed = spark.sparkContext._gateway.new_array(jvm.DecisionTreeRegressionModel, trees)
    for t, tree in enumerate(fitted):
        listed[t] = tree._java_obj
    made = RandomForestRegressionModel(jvm.RandomForestRegressionModel(f"forest_{uuid.uuid4().hex[:12]}", listed, fitted[0].numFeatures))
    return made._set(numTrees=trees).setFeaturesCol(features)  # the mean over its trees divides by that parameter


def boosted(cells: Cells, stages: int, depth: int, step: float, seed: int, features: str = "features") -> GBTRegressionModel:
    """Boosted trees; residuals are linear in the label, so a cell's mean stands for its rows."""
    booster = GBTRegressor(featuresCol="x", labelCol="y", weightCol="n", maxIter=stages, maxDepth=depth, stepSize=step, maxBins=cells.most_bins, seed=seed)
    return booster.fit(cells.rows.select("x", "y", "n")).setFeaturesCol(features)


def r2(model, cells: Cells) -> float | None:
    """R2 of a model over the rows of ``cells``, each taken at its bins' values."""
    mean = cells.rows.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).first()[0]
    if mean is None:
        return None
    predicted = model.copy().setFeaturesCol("x").setPredictionCol("_p").transform(cells.rows)
    spread = lambda centre: F.sum(F.col("off") + F.col("n") * F.pow(F.col("y") - centre, F.lit(2.0)))
    return predicted.agg(1 - F.try_divide(spread(F.col("_p")), spread(F.lit(mean)))).first()[0]
