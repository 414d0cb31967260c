"""Derived columns from declarative expressions, group-relative columns, calendar columns."""

from __future__ import annotations

import re

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fixed
from plumbline.functions.lookup import attach
from plumbline.plans.roles import datetime_columns, quoted


# Java calls, and windows that bring the whole table into one task.
_REFUSED = re.compile(r"`?\b(?:try_)?(?:reflect|java_method)\b`?\s*\(|\bover\s*\((?!\s*partition\b)|\bover\s+(?!\()\w+", re.IGNORECASE)


@contextmanager
def _null_on_failure(spark: SparkSession) -> Iterator[None]:
    """Expressions resolved inside give NULL where a row has no result; those already resolved keep their ways."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def add_derived_columns(
    df: DataFrame, specs: Sequence[Mapping[str, str]]
) -> tuple[DataFrame, list[dict[str, str]]]:
    """Add ``column_name`` = Spark SQL ``calculation`` per spec, in order; later ones may use earlier ones.

    A spec that does not resolve is skipped and returned with its reason. The text is parsed as a Spark
    expression; calls that reach Java methods and windows over the whole table are refused the same way.
    A row on which an expression has no result (a zero divisor, text that is no number) gets NULL.
    """
    skipped = []
    for spec in specs:
        try:
            if found := _REFUSED.search(str(spec["calculation"])):
                raise KeyError(f"{found[0].strip()} is refused")
            with _null_on_failure(df.sparkSession):
                df = df.withColumn(spec["column_name"], F.expr(spec["calculation"]))
                df.schema  # resolves the plan
        except (AnalysisException, ParseException, KeyError) as problem:
            reason = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
            skipped.append({"column_name": spec.get("column_name", ""), "reason": reason})
    return df, skipped


def add_sales_measures(df: DataFrame, price: str, quantity: str, cost: str,
                       revenue: str = "revenue", profit: str = "profit", margin: str = "margin") -> DataFrame:
    """Revenue, profit and margin of each row; a zero price gives a NULL margin."""
    p, q, c = (F.col(quoted(n)) for n in (price, quantity, cost))
    return df.withColumns({revenue: p * q, profit: (p - c) * q, margin: F.try_divide(p - c, p)})


def add_conditional(df: DataFrame, name: str, condition: Column, value: str) -> DataFrame:
    """``value`` where the condition holds, else NULL."""
    return df.withColumn(name, F.when(condition, F.col(quoted(value))))


def add_group_means(df: DataFrame, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Group mean on every row; specs are (group column, value column, new column).

    Means come from one map-side-combined aggregate per group column and are joined back, by broadcast
    when there are few groups: the rows themselves are not shuffled, as a window would.
    """
    by_group: dict[str, list[tuple[str, str]]] = {}
    for group, value, name in specs:
        by_group.setdefault(group, []).append((value, name))
    for group, members in by_group.items():
        means = df.groupBy(group).agg(
            F.count("*").alias("_rows"), *[F.avg(F.col(quoted(v))).alias(n) for v, n in members]
        )
        df = attach(df, means.filter(F.col(quoted(group)).isNotNull()), [group], "_rows")
    return df


def add_ratio(df: DataFrame, name: str, value: str, base: str) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(quoted(value)), F.col(quoted(base))))


def add_calendar_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Year, month, day, weekday (Monday 0) and English day name per datetime column."""
    for c in cols if cols is not None else datetime_columns(df):
        d = F.col(quoted(c))
        parts = [F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d), F.date_format(d, "EEEE")]
        df = df.withColumns({f"{c}_{s}": p for s, p in zip(fixed.CALENDAR_SUFFIXES, parts)})
    return df


def add_calendar_features(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Quarter, weekend flag, month name, year-month and the three thirds of the month."""
    for c in cols if cols is not None else datetime_columns(df):
        d = F.col(quoted(c))
        day = F.dayofmonth(d)
        parts = [
            F.quarter(d),
            F.weekday(d).isin(5, 6).cast("int"),
            F.date_format(d, "MMMM"),
            F.date_format(d, "yyyy-MM"),
            (day <= 10).cast("int"),
            ((day > 10) & (day <= 20)).cast("int"),
            (day > 20).cast("int"),
        ]
        df = df.withColumns({f"{c}_{s}": p for s, p in zip(fixed.CALENDAR_FEATURE_SUFFIXES, parts)})
    return df
