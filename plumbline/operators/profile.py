"""Profiling: dataset summary, null profile, category profile, describe, correlation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.quantiles import MAP_LIMIT, column_quantiles
from plumbline.functions.sums import summed
from plumbline.plans.roles import (
    name_has,
    numeric_columns,
    possible_targets,
    quoted,
    string_columns,
)

QUARTILES = (0.25, 0.5, 0.75)
# More columns than this are correlated by matrix products.
WIDE_MATRIX = 8
_ORIGIN_ROWS = 1_000


def _plain_shape(fmt: str) -> str | None:
    """What every text that a purely numeric pattern can parse looks like with its digits as 0; None for other patterns."""
    fields = re.findall(r"[A-Za-z]+", fmt.replace("'T'", " "))
    return re.sub(r"[A-SU-Za-z]", "0", fmt.replace("'T'", "T")) if set(fields) <= {"yyyy", "MM", "dd", "HH", "mm", "ss", "yyyyMMdd"} else None


def parsed_datetime(column: str, formats: Sequence[str] = fixed.DATETIME_FORMATS) -> Column:
    """The first accepted pattern that parses; NULL when none does, never an error.

    A failed parse is costly, so the shape of a text, its digits as 0, chooses the patterns that are tried on it: with patterns of
    different shapes one at most, and none on a text that looks like no date.
    """
    text = F.trim(F.col(quoted(column)))
    shape = F.translate(text, "123456789", "0" * 9)
    shapes = [_plain_shape(f) for f in formats]
    parse = lambda f: F.try_to_timestamp(text, F.lit(f))
    if all(shapes):
        chosen = F.lit(None).cast("timestamp")
        for known in reversed(list(dict.fromkeys(shapes))):
            chosen = F.when(shape == known, F.coalesce(*[parse(f) for f, s in zip(formats, shapes) if s == known])).otherwise(chosen)
        return chosen.cast("timestamp_ntz")
    return F.coalesce(*[F.when(shape == s, parse(f)) if s else parse(f) for f, s in zip(formats, shapes)]).cast("timestamp_ntz")


def unparsed(column: str, formats: Sequence[str] = fixed.DATETIME_FORMATS) -> Column:
    """Number of non-null values that no pattern parses."""
    value = F.col(quoted(column))
    return F.count_if(value.isNotNull() & parsed_datetime(column, formats).isNull())


def unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) pairs of string columns; grouped right after, so it combines map-side."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("value")) for c in cols]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")


def dataset_profile(df: DataFrame, formats: Sequence[str] = fixed.DATETIME_FORMATS) -> DataFrame:
    """One row per column: type, class, row and null counts, datetime and target candidacy."""
    strings, numeric, targets = string_columns(df), numeric_columns(df), possible_targets(df)
    named = [c for c in df.columns if name_has(c, fixed.DATETIME_NAME_PARTS)]
    types = dict(df.dtypes)

    def is_datetime(c: str) -> Column:
        # pandas-style parsing takes numbers as instants, so only text can fail to parse.
        if c not in named or types[c] == "boolean":
            return F.lit(False)
        return (unparsed(c, formats) == 0) if c in strings else F.lit(True)

    row_per_column = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(types[c]).alias("data_type"),
            F.lit("numeric" if c in numeric else "categorical" if c in strings else "other").alias("class"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(quoted(c)).isNull()).alias("n_null"),
            is_datetime(c).alias("is_datetime"),
            ((~is_datetime(c)) & F.lit(c in targets)).alias("is_possible_target"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.array(*row_per_column).alias("rows")).select(F.inline("rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, pct_null rounded to 1 decimal) for columns that have nulls."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(quoted(c)).isNull()).alias("n_null"),
            F.round(F.try_divide(100.0 * F.count_if(F.col(quoted(c)).isNull()), F.count("*")), 1).alias("pct_null"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*entries).alias("rows")).select(F.inline("rows")).filter("n_null > 0")


def category_profile(
    df: DataFrame, cols: Sequence[str] | None = None, k: int = 5, count_null: bool = True
) -> DataFrame:
    """(column, n_distinct, sample: first k values in order, truncated).

    ``count_null`` counts NULL as a value, as the 5- and 10-value profiles do; the 3-value one does
    not. Distinct values are found by a shuffle on (column, value) and only k per column and task
    travel on (window group limit), so column size does not matter.
    """
    cols = list(cols if cols is not None else string_columns(df))
    distinct = unpivot(df, cols).distinct()
    if not count_null:
        distinct = distinct.filter("value IS NOT NULL")
    first = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())
    samples = (
        distinct.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s"))
        .select("column", F.col("s.value").alias("sample"))
    )
    counts = distinct.groupBy("column").agg(F.count("*").alias("n_distinct"))
    # Both sides have one row per column of the schema.
    return counts.join(F.broadcast(samples), "column").select(
        "column", "n_distinct", "sample", (F.col("n_distinct") > k).alias("truncated")
    )


def describe(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    decimals: int | None = None,
    accuracy: int | None = None,
    map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """One row per numeric column: count, mean, std (n-1), min, quartiles (linear), max.

    Exact by default; ``accuracy`` switches the quartiles to ``percentile_approx``.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    extra = []
    for i, c in enumerate(cols):
        v = F.col(quoted(c)).cast("double")
        extra += [
            F.count(v).alias(f"count{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
    quartiles, row = column_quantiles(df, cols, QUARTILES, extra, accuracy, map_limit)
    rows = [
        (c, row[f"count{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *quartiles[c], row[f"max{i}"])
        for i, c in enumerate(cols)
    ]
    out = df.sparkSession.createDataFrame(
        rows,
        "column string, count bigint, mean double, std double, min double,"
        " q25 double, q50 double, q75 double, max double",
    )
    if decimals is None:
        return out
    return out.select("column", "count", *[F.round(c, decimals).alias(c) for c in out.columns[2:]])


def describe_by_statistic(described: DataFrame) -> DataFrame:
    """The table turned: one row per statistic, one column per described column."""
    statistics = described.columns[1:]
    pairs = [F.struct(F.lit(i).alias("place"), F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value"))
             for i, s in enumerate(statistics)]
    names = [r["column"] for r in described.select("column").collect()]
    long = described.select("column", F.inline(F.array(*pairs)))
    return long.groupBy("place", "statistic").pivot("column", names).agg(F.first("value")).orderBy("place").drop("place")


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix in tidy form (a, b, r); NULL for a constant column.

    First one pass for null counts, ranges and means, then plain sums of the centred values and their
    products. A column without nulls is summed once; only pairs with nulls need sums of their own. Many
    columns are multiplied as matrices instead, since that many single sums are slow.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    if len(cols) > WIDE_MATRIX:
        return _wide_correlations(df, cols)
    value = {c: F.col(quoted(c)).cast("double") for c in cols}
    aggs = []
    for i, v in enumerate(value.values()):
        aggs += [F.count_if(v.isNull()).alias(f"nulls{i}"), F.avg(v).alias(f"mean{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    first = df.agg(*aggs).first() if cols else {}
    gaps = {c: first[f"nulls{i}"] > 0 for i, c in enumerate(cols)}
    varies = {c: first[f"lo{i}"] != first[f"hi{i}"] for i, c in enumerate(cols)}
    # Centring first keeps the sums accurate for columns far from zero.
    centred = {c: value[c] - F.lit(first[f"mean{i}"] or 0.0) for i, c in enumerate(cols)}
    place = {c: i for i, c in enumerate(cols)}
    sums: dict[str, Column] = {}

    def total(name: str, expression: Column) -> Column:
        sums.setdefault(name, expression.alias(name))
        return F.col(name)

    def moments(c: str, other: str) -> tuple[Column, Column]:
        """Sum and sum of squares of ``c`` over the rows where ``other`` is present too."""
        x, name = (F.when(value[other].isNotNull(), centred[c]), f"{place[c]}_{place[other]}") if gaps[other] else (centred[c], f"{place[c]}")
        if gaps[other]:
            # Varying over all rows does not mean varying over the shared ones.
            spread = total(f"max{name}", F.max(x)) > total(f"min{name}", F.min(x))
            return total(f"s{name}", F.sum(x)), F.when(spread, total(f"q{name}", F.sum(x * x)))
        return total(f"s{name}", F.sum(x)), total(f"q{name}", F.sum(x * x))

    def r(a: str, b: str) -> Column:
        if not (varies[a] and varies[b]):
            return F.lit(None).cast("double")
        i, j = place[a], place[b]
        both = value[a].isNotNull() & value[b].isNotNull()
        if gaps[a] or gaps[b]:
            n = total(f"n{i}_{j}", F.count_if(both))
        else:
            n = total("n", F.count("*"))
        (sa, qa), (sb, qb) = moments(a, b), moments(b, a)
        shared = total(f"p{i}_{j}", F.sum(centred[a] * centred[b])) - F.try_divide(sa * sb, n)
        spread = F.sqrt(F.greatest(qa - F.try_divide(sa * sa, n), F.lit(0.0)) * F.greatest(qb - F.try_divide(sb * sb, n), F.lit(0.0)))
        defined = qa.isNotNull() & qb.isNotNull() & (n > 1)
        ratio = F.when(defined, F.try_divide(shared, spread))
        return F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))

    entries = []
    for a in cols:
        own = F.lit(1.0 if varies[a] else None).cast("double")
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), own.alias("r")))
    for a, b in combinations(cols, 2):
        pair = r(a, b)
        entries += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), pair.alias("r")) for x, y in ((a, b), (b, a))]
    if not entries:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    sums = sums or {"n": F.count("*").alias("n")}
    return df.agg(*sums.values()).select(F.inline(F.array(*entries)))


def _wide_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same matrix from one pass of matrix products, gaps included.

    With values, from an origin near them and 0 where missing, and masks of what is present, four products hold all that the pairs need: rows
    shared, sums and sums of squares over the shared rows, sums of products. A column's values on the rows shared with another count as constant
    when their spread is lost in rounding.
    """
    values = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    rows, width = df.select(*values), len(cols)
    matrix = lambda batch: np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
    some = matrix(rows.limit(_ORIGIN_ROWS).toArrow().combine_chunks())  # any origin gives the same result; one near the data keeps its digits
    held = ~np.isnan(some)
    origin = np.where(held, some, 0.0).sum(axis=0) / np.maximum(held.sum(axis=0), 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        totals = np.zeros((4, width, width))
        for batch in batches:
            for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
                x = matrix(part) - origin
                there = ~np.isnan(x)
                x, mask = np.where(there, x, 0.0), there.astype(np.float64)
                for i, (left, right) in enumerate(((mask, mask), (x, mask), (x * x, mask), (x, x))):
                    totals[i] += left.T @ right
        return {0: totals.reshape(-1)}

    found = summed(rows, add_up).get(0, np.zeros(4 * width * width))
    n, s, q, p = found.reshape(4, width, width)
    n = np.round(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = q - s * s / n  # spread of the row's column over the rows it shares with the column's
        varies = (n > 1) & (own > 1e-12 * q) & (own > n * (1e-13 * origin[:, None]) ** 2)
        r = (p - s * s.T / n) / np.sqrt(own * own.T)
    r = np.clip(np.where(varies & varies.T, r, np.nan), -1.0, 1.0)
    r[np.diag_indices(width)] = np.where(varies.diagonal(), 1.0, np.nan)
    a, b = np.divmod(np.arange(width * width), width)
    names = pa.array(list(cols), pa.string())
    flat = r.reshape(-1)
    table = pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "r": pa.array(flat, mask=np.isnan(flat))})
    return df.sparkSession.createDataFrame(table, schema="a string, b string, r double")


def target_correlations(matrix: DataFrame, target: str) -> DataFrame:
    """The target's row of the matrix, strongest positive first, NULLs last."""
    return (
        matrix.filter(F.col("a") == target)
        .select(F.col("b").alias("column"), "r")
        .orderBy(F.col("r").desc_nulls_last(), "column")
    )
