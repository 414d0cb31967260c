"""Hypothesis tests from distributed moments and counts; only scalars reach the driver."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.tails import chi2_upper, f_upper, t_two_sided
from plumbline.plans.roles import quoted

RESULT_SCHEMA = (
    "test_name string, test_type string, statistic double, df1 double, df2 double,"
    " p_value double, reject boolean, decision string"
)


def _observed(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(F.col(quoted(group)).alias("g"), F.col(quoted(value)).cast("double").alias("v")).dropna()


def t_statistics(df: DataFrame, group: str, value: str, pooled: bool = False) -> DataFrame:
    """(statistic, df) of the two-sample t test; no row unless the group column has exactly 2 values.

    The first sample is the smaller group value. Pooled assumes equal variances, else Welch.
    """
    per_group = _observed(df, group, value).groupBy("g").agg(
        F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")
    )
    pair = per_group.agg(
        F.count("*").alias("groups"),
        F.min(F.struct("g", "n", "mean", "var")).alias("a"),
        F.max(F.struct("g", "n", "mean", "var")).alias("b"),
    ).filter("groups = 2")
    diff = F.col("a.mean") - F.col("b.mean")
    if pooled:
        dof = F.col("a.n") + F.col("b.n") - 2
        pool = F.try_divide((F.col("a.n") - 1) * F.col("a.var") + (F.col("b.n") - 1) * F.col("b.var"), dof)
        error = F.sqrt(pool * (1 / F.col("a.n") + 1 / F.col("b.n")))
    else:
        ea, eb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
        dof = F.try_divide(
            (ea + eb) * (ea + eb),
            F.try_divide(ea * ea, F.col("a.n") - 1) + F.try_divide(eb * eb, F.col("b.n") - 1),
        )
        error = F.sqrt(ea + eb)
    return pair.select(F.try_divide(diff, error).alias("statistic"), dof.alias("df"))


def anova_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """(statistic, df1, df2) of one-way ANOVA; no row with fewer than 2 groups."""
    rows = _observed(df, group, value)
    mean = rows.agg(F.avg("v")).first()[0] or 0.0
    centred = F.col("v") - F.lit(mean)
    per_group = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.sum(centred).alias("s"), F.sum(centred * centred).alias("q")
    )
    totals = per_group.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"),
        F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
    ).filter("k > 1")
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return totals.select(
        F.try_divide(between / df1, F.try_divide(within, df2)).alias("statistic"),
        df1.cast("double").alias("df1"), df2.cast("double").alias("df2"),
    )


def pearson_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """(r, statistic t, df) over complete pairs; NULL for a constant column."""
    pairs = df.select(F.col(quoted(a)).cast("double").alias("x"), F.col(quoted(b)).cast("double").alias("y")).dropna()
    moments = pairs.agg(
        F.count("*").alias("n"), F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")
    )
    ratio = F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))
    with_r = moments.select("n", F.when(ratio.isNotNull(), bounded).alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return with_r.select("r", t.alias("statistic"), (F.col("n") - 2).cast("double").alias("df"))


def chi2_statistics(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, df) of the independence test; Yates correction only for a 2 x 2 table.

    Σ(o-e)²/e over the occupied cells, and e for the empty ones, whose sum is what the occupied leave of n: the table is never
    filled in. Differences are taken in whole numbers, so large counts lose no digits. A 2 x 2 table takes its
    corrected form from the same counts.
    """
    cells = df.select(F.col(quoted(a)).alias("a"), F.col(quoted(b)).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("o"))
    total = cells.agg(F.sum("o")).first()[0] or 0
    rows = cells.groupBy("a").agg(F.sum("o").alias("row"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("col"))
    whole = lambda c: c.cast("decimal(19,0)")
    product = whole(F.col("row")) * whole(F.col("col"))
    placed = cells.join(rows, "a").join(cols, "b").select("a", "b", "o", product.alias("p"), (whole(F.col("o")) * whole(F.lit(total)) - product).alias("d"))
    d, p = F.col("d").cast("double"), F.col("p").cast("double")
    one = placed.agg(
        F.sum(d * d / p).alias("occupied"), F.sum("p").alias("p"), F.max(F.struct("o", "d")).alias("cell"), F.sum("o").alias("n"),
        F.count_distinct("a").alias("nr"), F.count_distinct("b").alias("nc"),
    )
    n = F.col("n").cast("double")
    plain = (F.col("occupied") + (whole(F.col("n")) * whole(F.col("n")) - F.col("p")).cast("double")) / n
    # In a 2 x 2 table all four cells deviate by the same amount, so any one of them gives the statistic.
    gap = F.abs(F.col("cell.d").cast("double")) / n
    reduced = gap - F.least(F.lit(0.5), gap)
    corrected = F.when(gap > 0, plain * reduced * reduced / (gap * gap)).otherwise(0.0)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    return one.select(
        F.when((F.col("nr") == 2) & (F.col("nc") == 2), corrected).otherwise(plain).alias("statistic"),
        dof.cast("double").alias("df"),
    )


def _t(df, spec, pooled):
    row = t_statistics(df, *spec["columns"], pooled=pooled).first()
    if row is None or row["statistic"] is None:
        return None
    return row["statistic"], row["df"], None, t_two_sided(row["statistic"], row["df"])


def _anova(df, spec):
    row = anova_statistics(df, *spec["columns"]).first()
    if row is None or row["statistic"] is None:
        return None
    return row["statistic"], row["df1"], row["df2"], f_upper(row["statistic"], row["df1"], row["df2"])


def _pearson(df, spec):
    row = pearson_statistics(df, *spec["columns"]).first()
    if row["r"] is None or row["df"] < 1:
        return None
    if row["statistic"] is None or math.isinf(row["statistic"]):
        return row["r"], row["df"], None, 0.0
    return row["r"], row["df"], None, t_two_sided(row["statistic"], row["df"])


def _chi2(df, spec):
    row = chi2_statistics(df, *spec["columns"]).first()
    if row["statistic"] is None or not row["df"]:
        return None
    return row["statistic"], row["df"], None, chi2_upper(row["statistic"], row["df"])


KINDS = {
    "t_welch": lambda df, spec: _t(df, spec, pooled=False),
    "t_pooled": lambda df, spec: _t(df, spec, pooled=True),
    "anova": _anova,
    "pearson": _pearson,
    "chi2": _chi2,
}


def run_tests(df: DataFrame, specs: Sequence[Mapping], alpha: float = 0.05) -> DataFrame:
    """One row per spec {test_name, kind, columns, alpha?}; specs that do not apply give no row.

    Rejects when p < alpha. The statistic is t, F, chi-square, or r for a Pearson test.
    """
    rows = []
    for spec in specs:
        if spec["kind"] not in KINDS:
            raise ValueError(f"unknown test kind {spec['kind']!r}; use one of {tuple(KINDS)}")
        missing = [c for c in spec["columns"] if c not in df.columns]
        found = None if missing else KINDS[spec["kind"]](df, spec)
        if found is None:
            continue
        statistic, df1, df2, p = found
        reject = p < spec.get("alpha", alpha)
        verdict = "significant" if reject else "not significant"
        rows.append((spec["test_name"], spec["kind"], statistic, df1, df2, p, reject, verdict))
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
