"""The data behind charts: bins, curves, points, boxes, bars, lines, intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.lookup import attach
from plumbline.functions.quantiles import MAP_LIMIT, grouped_quantiles
from plumbline.operators.profile import correlations
from plumbline.plans.roles import quoted

# Below this many distinct values a density is summed over counted values instead of rows.
COUNTED_VALUES = 100_000
_NORMAL_95 = 1.959963984540054


def _edges(df: DataFrame, x: str, bins: int) -> tuple[float, float] | None:
    """(first edge, bin width), None without values. A constant column gets a bin range of width 1."""
    v = F.col(quoted(x)).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return None
    if low == high:
        low, high = low - 0.5, high + 0.5
    return low, (high - low) / bins


def _bin(value: Column, low: float, width: float, bins: int) -> Column:
    """0-based bin; the last is closed on the right, and rounding never moves a value over an edge."""
    guess = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    edge = lambda i: F.lit(low) + i * F.lit(width)
    down = (value < edge(guess)).cast("int")
    up = ((value >= edge(guess + 1)) & (guess < bins - 1)).cast("int")
    return guess - down + up


def histogram(df: DataFrame, x: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, n) with equal widths over [min, max]; empty bins are present."""
    spark = df.sparkSession
    edges = _edges(df, x, bins)
    if edges is None:
        return spark.createDataFrame([], "bin int, low double, high double, n bigint")
    low, width = edges
    v = F.col(quoted(x)).cast("double")
    counts = df.filter(v.isNotNull()).groupBy(_bin(v, low, width, bins).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    # Both sides have one row per bin.
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def density(df: DataFrame, x: str, points: int = fixed.DENSITY_POINTS) -> DataFrame:
    """(point, x, density): Gaussian kernel density with Scott bandwidth on a grid over [min, max].

    Each task adds up its rows' kernels on the grid and emits one row per grid point; nothing is
    binned or sampled. A column with few distinct values is counted first.
    """
    v = F.col(quoted(x)).cast("double")
    n, low, high, std, distinct = df.agg(
        F.count(v), F.min(v), F.max(v), F.stddev_samp(v), F.approx_count_distinct(v)
    ).first()
    spark = df.sparkSession
    schema = "point int, x double, density double"
    if n < 2 or not std or low == high:
        return spark.createDataFrame([], schema)
    width = std * n ** (-0.2)
    grid = np.linspace(low, high, points)
    values = df.select(v.alias("v")).dropna()
    if distinct <= COUNTED_VALUES:
        values = values.groupBy("v").agg(F.count("*").cast("double").alias("w"))
    else:
        values = values.withColumn("w", F.lit(1.0))

    def add_kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.iloc[start : start + 4096]
                z = (grid[:, None] - part["v"].to_numpy()[None, :]) / width
                total += np.exp(-0.5 * z * z) @ part["w"].to_numpy()
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "s": total})

    sums = values.mapInPandas(add_kernels, "point int, s double").groupBy("point").agg(F.sum("s").alias("s"))
    scale = 1.0 / (n * width * float(np.sqrt(2 * np.pi)))
    step = (high - low) / (points - 1)
    return sums.select(
        "point", (F.lit(low) + F.col("point") * F.lit(step)).alias("x"), (F.col("s") * F.lit(scale)).alias("density")
    )


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """All complete (x, y) pairs."""
    return df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).alias("y")).dropna()


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """(x_bin, y_bin, n): every pair counted in a grid cell, for tables too large to draw point by point."""
    pairs = scatter_points(df, x, y)
    ex, ey = _edges(pairs, "x", bins), _edges(pairs, "y", bins)
    if ex is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, n bigint")
    cells = [_bin(F.col(c).cast("double"), *edges, bins).alias(f"{c}_bin") for c, edges in (("x", ex), ("y", ey))]
    return pairs.groupBy(*cells).agg(F.count("*").alias("n"))


def _with_fences(df: DataFrame, x: str, y: str, map_limit: int) -> DataFrame:
    quartiles = grouped_quantiles(df, x, y, (0.25, 0.5, 0.75), map_limit).select(
        F.col(quoted(x)).alias("x"), "n", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]
    )
    reach = F.lit(fixed.BOX_WHISKER) * (F.col("q3") - F.col("q1"))
    fences = quartiles.select("*", (F.col("q1") - reach).alias("low_fence"), (F.col("q3") + reach).alias("high_fence"))
    rows = df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).cast("double").alias("y")).dropna()
    return attach(rows, fences.withColumn("_rows", F.col("n")), ["x"], "_rows")


def box_stats(df: DataFrame, x: str, y: str, map_limit: int = MAP_LIMIT) -> DataFrame:
    """(x, n, q1, median, q3, low and high whisker, n_outliers) per group.

    Whiskers end at the extreme values within 1.5 interquartile ranges of the box.
    """
    inside = F.col("y").between(F.col("low_fence"), F.col("high_fence"))
    return (
        _with_fences(df, x, y, map_limit)
        .groupBy("x", "n", "q1", F.col("q2").alias("median"), "q3")
        .agg(
            F.min(F.when(inside, F.col("y"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("y"))).alias("high_whisker"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def box_outliers(df: DataFrame, x: str, y: str, map_limit: int = MAP_LIMIT) -> DataFrame:
    """(x, y) of every row beyond the whiskers."""
    return _with_fences(df, x, y, map_limit).filter("y < low_fence OR y > high_fence").select("x", "y")


def bars(df: DataFrame, x: str, y: str, estimator: str = "mean") -> DataFrame:
    """(x, n, value, low, high): mean or sum of y per x, with the normal 95 % interval."""
    if estimator not in ("mean", "sum"):
        raise ValueError(f"unknown estimator {estimator!r}; use 'mean' or 'sum'")
    rows = df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).cast("double").alias("y")).dropna()
    per = rows.groupBy("x").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.sum("y").alias("sum"), F.stddev_samp("y").alias("std")
    )
    error = F.col("std") / F.sqrt("n") * (F.col("n") if estimator == "sum" else F.lit(1.0))
    reach = F.lit(_NORMAL_95) * error
    value = F.col(estimator)
    return per.select("x", "n", value.alias("value"), (value - reach).alias("low"), (value + reach).alias("high"))


def lines(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y per x with its interval, sorted by x."""
    return bars(df, x, y).orderBy("x")


def poisson_bounds(most: int = 15) -> list[float]:
    """A uniform number has the Poisson(1) weight k when it is at or above k of these."""
    density_, total, bounds = float(np.exp(-1.0)), 0.0, []
    for k in range(1, most + 1):
        total += density_
        bounds.append(total)
        density_ /= k
    return bounds


@lru_cache(maxsize=4)
def resampling_weights(blocks: int, resamples: int, seed: int) -> np.ndarray:
    """(block, draw) Poisson(1) weights from hashes of their numbers: the same in every task, on every run."""
    uniform = np.fromiter(
        (int(hashlib.md5(f"{b}|{r}|{seed}".encode()).hexdigest()[:8], 16) for b in range(blocks) for r in range(resamples)), dtype=np.float64, count=blocks * resamples
    ).reshape(blocks, resamples) / 2.0**32
    return np.searchsorted(np.array(poisson_bounds()), uniform, side="right").astype(np.float64)


def bootstrap_intervals(
    df: DataFrame, x: str, y: str, key: Sequence[str] | None = None,
    resamples: int = fixed.BOOTSTRAP_RESAMPLES, blocks: int = 1024, seed: int = 42, estimator: str = "mean",
) -> DataFrame:
    """(x, n, mean, low, high): bootstrap 95 % interval of the mean per group, or (x, n, sum, low, high) of the sum.

    Every row goes to one of ``blocks`` hash blocks of its group and the blocks are resampled with
    Poisson(1) weights. Random blocks leave the variance of the mean unchanged in expectation. Counts and sums of the blocks are all that is shuffled,
    combined in each task first; then a group is one row of arrays, and all its resamples are one product with the matrix of weights,
    which all groups share. ``key`` should identify rows; all columns by default.
    """
    if estimator not in ("mean", "sum"):
        raise ValueError(f"unknown estimator {estimator!r}; use 'mean' or 'sum'")
    names = list(key) if key else [n for n, t in df.dtypes if not t.startswith("map")]
    text = F.concat_ws("|", *[F.col(quoted(n)).cast("string") for n in names], F.lit(str(seed)))
    block = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % blocks
    rows = df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).cast("double").alias("y"), block.cast("int").alias("block")).dropna()
    kind = rows.schema["x"].dataType.simpleString()
    sums = rows.groupBy("x", "block").agg(F.count("*").cast("double").alias("c"), F.sum("y").alias("s"))
    sums = sums.groupBy("x").agg(F.collect_list(F.struct("block", "c", "s")).alias("b"))  # at most one entry per block
    sums = sums.select("x", F.col("b.block").alias("block"), F.col("b.c").alias("c"), F.col("b.s").alias("s"))

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        for batch in batches:
            if weights is None:
                weights = resampling_weights(blocks, resamples, seed)
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                counts, totals = np.zeros((part.num_rows, blocks)), np.zeros((part.num_rows, blocks))
                at = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)), part.column(1).flatten().to_numpy(zero_copy_only=False)
                counts[at], totals[at] = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                n, total = counts.sum(axis=1), totals.sum(axis=1)
                value = total / n if estimator == "mean" else total
                drawn = totals @ weights
                if estimator == "mean":
                    drawn_rows = counts @ weights
                    drawn = np.divide(drawn, drawn_rows, out=np.full_like(drawn, np.nan), where=drawn_rows > 0)
                low, high = np.nanpercentile(drawn, [2.5, 97.5], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *map(pa.array, (value, low, high))], ["x", "n", estimator, "low", "high"])

    return sums.mapInArrow(resample, f"x {kind}, n long, {estimator} double, low double, high double")


def _bands(df: DataFrame, x: str, y: str, estimator: str = "mean") -> DataFrame:
    return bootstrap_intervals(df, x, y, estimator=estimator).withColumnRenamed(estimator, "value")


CHARTS = {
    "histogram": lambda df, x, y: histogram(df, x),
    "scatter": scatter_points,
    "boxplot": box_stats,
    "bar": bars,
    "line": lines,
    "heatmap": lambda df, x, y: correlations(df),
    "density": lambda df, x, y: density(df, x),
}
# With ``"interval": "bootstrap"`` in a spec.
BOOTSTRAPPED = {"bar": _bands, "line": lambda df, x, y: _bands(df, x, y).orderBy("x")}


def valid_specs(columns: Sequence[str], specs: Sequence[Mapping]) -> tuple[list[dict], list[dict]]:
    """(accepted, skipped with a reason): recommended, titled, with existing columns, no duplicates.

    A histogram ignores its y axis, which often names a computed frequency.
    """
    accepted, skipped, seen = [], [], set()
    for spec in specs:
        kind, title = spec.get("chart_type"), spec.get("title")
        x, y = spec.get("x_axis") or None, spec.get("y_axis") or None
        if kind in ("histogram", "heatmap", "density"):
            y = None
        if kind == "heatmap":
            x = None
        needed = {"histogram": [x], "density": [x], "heatmap": []}.get(kind, [x, y])
        if not spec.get("recommended", True):
            reason = "not recommended"
        elif not kind or not title:
            reason = "no chart type or title"
        elif kind not in CHARTS:
            reason = f"unsupported chart type {kind}"
        elif spec.get("interval") not in (None, "normal", *(["bootstrap"] if kind in BOOTSTRAPPED else [])):
            reason = f"unsupported interval {spec['interval']}"
        elif missing := [c for c in needed if c not in columns]:
            reason = f"no such column: {missing[0]}"
        elif (kind, x, y) in seen:
            reason = "duplicate"
        else:
            seen.add((kind, x, y))
            accepted.append({**spec, "x_axis": x, "y_axis": y})
            continue
        skipped.append({"title": title, "reason": reason})
    return accepted, skipped


def chart_data(df: DataFrame, specs: Sequence[Mapping]) -> tuple[list[tuple[dict, DataFrame]], list[dict]]:
    """The data of each valid chart spec, and the specs that were skipped."""
    accepted, skipped = valid_specs(df.columns, specs)
    draw = lambda spec: (BOOTSTRAPPED if spec.get("interval") == "bootstrap" else CHARTS)[spec["chart_type"]]
    return [(s, draw(s)(df, s["x_axis"], s["y_axis"])) for s in accepted], skipped
