"""Cleaning: sparse columns, fills, outliers, type coercion, nominal tagging."""

from __future__ import annotations

from collections.abc import Container, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import fixed_values as fixed
from plumbline.functions.quantiles import MAP_LIMIT, column_quantiles
from plumbline.operators.profile import parsed_datetime, unparsed, unpivot
from plumbline.plans.roles import numeric_columns, quoted, string_columns

OUTLIER_METHODS = ("iqr", "zscore")


def _require_method(method: str) -> None:
    if method not in OUTLIER_METHODS:
        raise ValueError(f"unknown outlier method {method!r}; use one of {OUTLIER_METHODS}")


@dataclass(frozen=True)
class MissingSummary:
    """Null counts of all columns and means of the numeric ones, from one pass."""

    rows: int
    nulls: dict[str, int]
    means: dict[str, float | None]

    def ratio(self, column: str) -> float:
        return self.nulls[column] / self.rows if self.rows else 0.0


def summarise_missing(df: DataFrame) -> MissingSummary:
    numeric = numeric_columns(df)
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.avg(F.col(quoted(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)],
    ).first()
    return MissingSummary(
        row["rows"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}, {c: row[f"m{i}"] for i, c in enumerate(numeric)}
    )


def drop_sparse_columns(df: DataFrame, limit: float = 0.3, summary: MissingSummary | None = None) -> DataFrame:
    """Drop columns whose null ratio is strictly above ``limit``."""
    summary = summary or summarise_missing(df)
    return df.drop(*[c for c in df.columns if summary.ratio(c) > limit])


def _filled(df: DataFrame, fill: Mapping[str, Column]) -> DataFrame:
    return df.select(*[fill[c].alias(c) if c in fill else F.col(quoted(c)) for c in df.columns])


def fill_means(df: DataFrame, cols: Sequence[str] | None = None, summary: MissingSummary | None = None) -> DataFrame:
    """Numeric nulls become the column mean; integer columns that had nulls turn double."""
    cols = list(cols if cols is not None else numeric_columns(df))
    summary = summary or summarise_missing(df.select(*[F.col(quoted(c)) for c in cols]))
    holed = [c for c in cols if summary.nulls[c] and summary.means[c] is not None]
    return _filled(df, {c: F.coalesce(F.col(quoted(c)).cast("double"), F.lit(summary.means[c])) for c in holed})


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent non-null value per string column, the smallest on a tie.

    Counts are shuffled by (column, value), so a column with very many values is spread over tasks.
    """
    if not cols:
        return {}
    counts = unpivot(df, cols).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("best"))
    return {r["column"]: r["best"]["value"] for r in best.collect()}  # one row per column


def fill_modes(df: DataFrame, cols: Sequence[str] | None = None, summary: MissingSummary | None = None) -> DataFrame:
    """String nulls become the column's mode; only columns with nulls are counted."""
    cols = list(cols if cols is not None else string_columns(df))
    summary = summary or summarise_missing(df.select(*[F.col(quoted(c)) for c in cols]))
    found = modes(df, [c for c in cols if summary.nulls[c]])
    return _filled(df, {c: F.coalesce(F.col(quoted(c)), F.lit(v)) for c, v in found.items()})


def handle_missing(df: DataFrame, limit: float = 0.3) -> DataFrame:
    """Drop sparse columns, fill means and modes: one pass, and one more when strings have nulls."""
    summary = summarise_missing(df)
    kept = drop_sparse_columns(df, limit, summary)
    return fill_modes(fill_means(kept, summary=summary), summary=summary)


def outlier_bounds(
    df: DataFrame, cols: Sequence[str], method: str = "iqr", multiplier: float = 1.5,
    accuracy: int | None = None, map_limit: int = MAP_LIMIT, narrow: Container[str] = (),
) -> dict[str, tuple[float, float] | None]:
    """Inclusive bounds of ordinary values per column; None when the column is empty or constant (z-score)."""
    _require_method(method)
    if method == "iqr":
        quartiles, _ = column_quantiles(df, cols, (0.25, 0.75), accuracy=accuracy, map_limit=map_limit, narrow=narrow)
        bounds = {}
        for c in cols:
            q1, q3 = quartiles[c]
            spread = None if q1 is None else multiplier * (q3 - q1)
            bounds[c] = None if q1 is None else (q1 - spread, q3 + spread)
        return bounds
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(quoted(c)).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    bounds = {}
    for i, c in enumerate(cols):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        flat = not std or row[f"lo{i}"] == row[f"hi{i}"]
        bounds[c] = None if flat else (mean - multiplier * std, mean + multiplier * std)
    return bounds


def _outside(column: str, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return F.lit(False)
    v = F.col(quoted(column)).cast("double")
    return (v < F.lit(bounds[0])) | (v > F.lit(bounds[1]))


def detect_outliers(
    df: DataFrame, method: str = "iqr", multiplier: float = 1.5, cols: Sequence[str] | None = None,
    accuracy: int | None = None, map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """(column, n_outliers, pct_outliers of all rows, low, high); one snapshot for all columns."""
    _require_method(method)
    cols = list(cols if cols is not None else numeric_columns(df))
    bounds = outlier_bounds(df, cols, method, multiplier, accuracy, map_limit)
    entries = []
    for c in cols:
        n = F.count_if(_outside(c, bounds[c]))
        low, high = bounds[c] or (None, None)
        entries.append(
            F.struct(
                F.lit(c).alias("column"), n.alias("n_outliers"),
                F.try_divide(100.0 * n, F.count("*")).alias("pct_outliers"),
                F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"),
            )
        )
    return df.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def outlier_values(
    df: DataFrame, method: str = "iqr", multiplier: float = 1.5, cols: Sequence[str] | None = None,
    map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """All outlying values as rows (column, value); they stay distributed."""
    cols = list(cols if cols is not None else numeric_columns(df))
    bounds = outlier_bounds(df, cols, method, multiplier, map_limit=map_limit)
    hits = [
        F.when(
            _outside(c, bounds[c]),
            F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("double").alias("value")),
        )
        for c in cols
    ]
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).select("h.column", "h.value")


def remove_outliers(
    df: DataFrame, method: str = "iqr", multiplier: float = 1.5, cols: Sequence[str] | None = None,
    snapshot: bool = False, accuracy: int | None = None, map_limit: int = MAP_LIMIT,
) -> DataFrame:
    """Keep rows whose numeric values lie within the bounds; a null in a tested column drops the row.

    Sequential by default: each column's bounds come from the rows the columns before it left.
    ``snapshot`` takes all bounds from the input in one go. The result is the input plus literal range
    filters, so every pass reads one column and the filters reach the scan; nothing is cached.

    A constant column has no z-scores and is skipped; the naive rule would empty the table.
    """
    _require_method(method)
    cols = list(cols if cols is not None else numeric_columns(df))
    groups = [cols] if snapshot else [[c] for c in cols]
    narrow: set[str] = set()
    if method == "iqr" and accuracy is None and len(groups) > 1:
        # Removal only lowers distinct counts, so columns that are narrow now stay so.
        row = df.agg(*[F.approx_count_distinct(F.col(quoted(c))).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        narrow = {c for i, c in enumerate(cols) if row[f"d{i}"] <= map_limit}
    for group in groups:
        bounds = outlier_bounds(df, group, method, multiplier, accuracy, map_limit, narrow)
        for c in group:
            if bounds[c] is not None:
                low, high = bounds[c]
                df = df.filter(F.col(quoted(c)).between(F.lit(low), F.lit(high)))
            elif method == "iqr":
                df = df.filter(F.col(quoted(c)).isNotNull())
    return df


def coerce_datetimes(
    df: DataFrame, formats: Sequence[str] = fixed.DATETIME_FORMATS, by_content: bool = True,
    name_parts: Sequence[str] | None = None,
) -> DataFrame:
    """String columns that hold datetimes become timestamps, all values or none.

    Candidates: columns with a datetime name; with ``by_content`` also columns whose sampled value (the
    smallest, so the choice is repeatable) has 8 to 20 characters. ``name_parts`` replaces the name rule
    by a contained-in-name rule. Two passes judge all candidates.
    """
    strings = string_columns(df)
    if name_parts is not None:
        named = [c for c in strings if any(p in c or p in c.lower() for p in name_parts)]
    else:
        named = [c for c in strings if c.lower() in fixed.DATETIME_NAMES]
    others = [c for c in strings if c not in named] if by_content else []
    tested = named + others
    if not tested:
        return df
    # All values parse only if the smallest does: one cheap pass leaves few columns to read in full.
    samples = df.agg(*[F.min(F.col(quoted(c))).alias(c) for c in tested])
    probe = samples.select(*[F.col(quoted(c)) for c in tested], *[parsed_datetime(c, formats).isNotNull().alias(f"_ok{i}") for i, c in enumerate(tested)]).first()
    low, high = fixed.DATETIME_LENGTHS
    likely = [c for i, c in enumerate(tested) if probe[f"_ok{i}"] and (c in named or low <= len(probe[c]) <= high)]
    if not likely:
        return df
    row = df.agg(*[unparsed(c, formats).alias(f"bad{i}") for i, c in enumerate(likely)]).first()
    chosen = {c for i, c in enumerate(likely) if row[f"bad{i}"] == 0}
    return df.select(*[parsed_datetime(c, formats).alias(c) if c in chosen else F.col(quoted(c)) for c in df.columns])


def nominal_report(df: DataFrame, ratio_limit: float = 0.1, count_limit: int = 50,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct with NULL as a value, ratio, is_categorical) per string column."""
    cols = list(cols if cols is not None else string_columns(df))
    entries = []
    for c in cols:
        v = F.col(quoted(c))
        n = F.count_distinct(v) + F.max(v.isNull().cast("int"))
        ratio = F.try_divide(n.cast("double"), F.count("*"))
        entries.append(
            F.struct(
                F.lit(c).alias("column"), n.alias("n_distinct"), ratio.alias("ratio"),
                ((ratio < ratio_limit) & (n < count_limit)).alias("is_categorical"),
            )
        )
    return df.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def tag_nominal(df: DataFrame, ratio_limit: float = 0.1, count_limit: int = 50) -> DataFrame:
    """Mark low-cardinality string columns in their metadata; the data is untouched."""
    strings = string_columns(df)
    if not strings:
        return df
    # A sketch rules out wide columns before anything exact is counted.
    row = df.agg(*[F.approx_count_distinct(F.col(quoted(c))).alias(f"d{i}") for i, c in enumerate(strings)]).first()
    near = [c for i, c in enumerate(strings) if row[f"d{i}"] < 2 * count_limit]
    if not near:
        return df
    report = nominal_report(df, ratio_limit, count_limit, near)
    nominal = {r["column"] for r in report.filter("is_categorical").collect()}
    return df.select(
        *[F.col(quoted(c)).alias(c, metadata={"nominal": True}) if c in nominal else F.col(quoted(c)) for c in df.columns]
    )


def is_nominal(df: DataFrame, column: str) -> bool:
    field = df.schema[column]
    return isinstance(field.dataType, T.StringType) and bool(field.metadata.get("nominal"))
