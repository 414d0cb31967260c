"""Baseline key figures and what-if parameter grids, each from one aggregate over the table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from numbers import Real

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.plans.roles import key_figure_roles, name_has, numeric_columns, quoted

# Rows of the baseline table: label pattern, role, statistic, in report order.
BASELINE_FIGURES = [
    ("平均{}", "price", "mean"),
    ("平均{}", "quantity", "mean"),
    ("平均{}", "cost", "mean"),
    ("平均{}", "profit", "mean"),
    ("总{}", "revenue", "sum"),
    ("总{}", "profit", "sum"),
    ("{}数", "product", "distinct"),
    ("{}数", "region", "distinct"),
]


def baseline(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """(figure, column, statistic, value) for every role the table has."""
    found = key_figure_roles(df, dict(roles or {}))
    statistic = {
        "mean": lambda c: F.avg(F.col(quoted(c)).cast("double")),
        "sum": lambda c: F.sum(F.col(quoted(c)).cast("double")),
        "distinct": lambda c: F.count_distinct(F.col(quoted(c))).cast("double"),
    }
    entries = [
        F.struct(
            F.lit(label.format(found[role])).alias("figure"),
            F.lit(found[role]).alias("column"),
            F.lit(kind).alias("statistic"),
            statistic[kind](found[role]).alias("value"),
        )
        for label, role, kind in BASELINE_FIGURES
        if role in found
    ]
    if not entries:
        return df.sparkSession.createDataFrame([], "figure string, column string, statistic string, value double")
    return df.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def touched_columns(parameter: str, numeric: Sequence[str]) -> list[str]:
    """Numeric columns a what-if parameter adjusts, by its name."""
    if parameter in fixed.PARAMETER_KEYWORDS:
        touched = [c for c in numeric if name_has(c, fixed.PARAMETER_KEYWORDS[parameter])]
    else:
        touched = [c for c in numeric if name_has(c, parameter.replace("_", " ").split())]
        if not touched and name_has(parameter.lower(), ["cost", "reduce"]):
            touched = [c for c in numeric if name_has(c, fixed.COST_NAME_PARTS)]
    return touched or [c for c in numeric if any(part in c for part in fixed.FALLBACK_NAME_PARTS)]


def adjustment(parameter: str, value: float) -> tuple[str, float]:
    """How a parameter changes a column: ('scale', factor), ('shift', amount) or ('lift_below', limit).

    The first rule whose word occurs in the name applies.
    """
    percent = value / 100
    rules = [
        (["range"], ("scale", 1 + percent)),
        (["threshold"], ("lift_below", value)),
        (["target"], ("scale", 1 + percent)),
        (["margin", "profit"], ("shift", percent)),
        (["cost", "reduction"], ("scale", 1 - percent)),
        (["increase", "growth"], ("scale", 1 + percent)),
        (["multiplier"], ("scale", value)),
    ]
    name = parameter.lower()
    return next((effect for words, effect in rules if any(w in name for w in words)), ("scale", 1 + percent))


def grid_rows(specs: Sequence[Mapping]) -> list[tuple[int, str, str, str, object]]:
    """(position, scenario type, title, parameter, value): parameters vary one at a time.

    Keyed by position, so a later scenario of the same type does not replace an earlier one.
    """
    rows = []
    for i, spec in enumerate(specs, start=1):
        if not spec.get("recommended", True):
            continue
        kind, title = spec.get("scenario_type", f"scenario_{i}"), spec.get("title", f"场景{i}")
        for parameter, values in spec.get("parameters", {}).items():
            values = values if isinstance(values, (list, tuple)) else [values]
            rows += [(i, kind, title, parameter, v) for v in values]
    return rows


def what_if(df: DataFrame, specs: Sequence[Mapping], mode: str = "comparable") -> DataFrame:
    """One row per scenario, parameter and value: current and scenario totals, change and change in %.

    ``mode="comparable"`` compares the same columns before and after. ``mode="reference"`` compares the
    adjusted revenue and profit columns against revenue alone (else profit, else 0), as published
    reports do; unchanged data then already shows a change.

    The adjustments are affine in the column, so sums and counts give every total; a threshold needs the sum of the values below it. All thresholds
    of a column part its values into buckets, a search over them puts each value into one, and sums from the first bucket up to a
    threshold are its sum: the table is read once whatever the size of the grid, and neither plan nor work per row grows with it.
    """
    if mode not in ("comparable", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    numeric = numeric_columns(df)
    totals = [c for c in numeric if any(part in c for part in fixed.TOTAL_NAME_PARTS)] or numeric
    grid, limits = [], {}
    for position, kind, title, parameter, v in grid_rows(specs):
        touched, effect = set(), None
        if isinstance(v, Real):
            touched = set(touched_columns(parameter, numeric)) & set(totals)
            effect = adjustment(parameter, v)
            if effect[0] == "lift_below":
                for c in touched:
                    limits.setdefault(c, set()).add(float(effect[1]))
        grid.append((position, kind, title, parameter, v, touched, effect))
    schema = (
        "position int, scenario_type string, title string, parameter string, value double,"
        " current_total double, scenario_total double, change double, change_pct double"
    )
    if not grid:
        return df.sparkSession.createDataFrame([], schema)
    sums, counts, below = _column_sums(df, sorted(set(totals), key=numeric.index), limits)

    def gain(c: str, effect: tuple[str, float]) -> float:
        kind, amount = effect
        if kind == "scale":
            return sums[c] * (float(amount) - 1.0)
        if kind == "shift":
            return counts[c] * float(amount)
        return below[c, float(amount)] * (fixed.THRESHOLD_FACTOR - 1)

    whole = sum(sums[c] for c in totals)
    if mode == "comparable":
        current = whole
    else:
        found = key_figure_roles(df)
        named = [found[r] for r in ("revenue", "profit") if found.get(r) in fixed.CURRENT_TOTAL_COLUMNS]
        current = sums[named[0]] if named and named[0] in sums else 0.0
    rows = []
    for position, kind, title, parameter, v, touched, effect in grid:
        after = whole + sum(gain(c, effect) for c in totals if c in touched)
        change = after - current
        rows.append((position, kind, title, parameter, float(v) if effect else None, current, after, change, change / current * 100 if current else 0.0))
    return df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")]).astype({"value": "float64"}), schema).replace(float("nan"), None, ["value"])


def _column_sums(df: DataFrame, columns: Sequence[str], limits: Mapping[str, set[float]]) -> tuple[dict, dict, dict]:
    """Sum and count of every column, and the sum of its values below each of its limits, from one pass."""
    values = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    if not limits:
        aggregates = [f(f"x{i}").cast("double").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("s", F.sum), ("n", F.count))]
        row = df.select(*values).agg(*aggregates).first() if columns else {}
        return {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)}, {c: row[f"n{i}"] for i, c in enumerate(columns)}, {}
    edges = [np.array(sorted(limits.get(c, ()))) for c in columns]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(e) + 1) for e in edges]
        counts = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        for batch in batches:
            for i, e in enumerate(edges):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                bucket = np.searchsorted(e, x, side="right")  # the first limit above the value
                sums[i] += np.bincount(bucket, x, len(e) + 1)
                counts[i] += np.bincount(bucket, minlength=len(e) + 1)
        for i, (s, n) in enumerate(zip(sums, counts)):
            filled = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(filled), i, dtype=np.int32)), pa.array(filled.astype(np.int32)), pa.array(s[filled]), pa.array(n[filled])], ["c", "b", "s", "n"])

    partial = df.select(*values).mapInArrow(add_up, "c int, b int, s double, n long")
    found = partial.groupBy("c", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # at most a row for each limit given, and one a column
    sums, counts = [np.zeros(len(e) + 1) for e in edges], [0] * len(edges)
    for r in found:
        sums[r["c"]][r["b"]] = r["s"]
        counts[r["c"]] += r["n"]
    below = {(c, float(limit)): float(x) for c, e, s in zip(columns, edges, sums) for limit, x in zip(e, np.cumsum(s))}
    return {c: float(s.sum()) for c, s in zip(columns, sums)}, dict(zip(columns, counts)), below


def business_scenarios(
    df: DataFrame, scenarios: Mapping[str, Sequence[float]] | None = None, roles: Mapping[str, str] | None = None
) -> DataFrame:
    """Revenue and profit recomputed from price, quantity and cost under each declared change.

    ``sales_increase`` scales quantity, ``price_change`` price and ``cost_reduction`` cost; the results
    follow from the sums of price*quantity and cost*quantity.
    """
    found = key_figure_roles(df, dict(roles or {}))
    price, quantity, cost = (F.col(quoted(found[r])).cast("double") for r in ("price", "quantity", "cost"))
    once = df.agg(F.sum(price * quantity).alias("pq"), F.sum(cost * quantity).alias("cq"))
    factors = {
        "sales_increase": lambda p: (1 + p, 1 + p),
        "price_change": lambda p: (1 + p, 1.0),
        "cost_reduction": lambda p: (1.0, 1 - p),
    }
    entries = []
    for scenario, values in (scenarios or fixed.CONFIG_SCENARIOS).items():
        for v in values:
            up, down = factors[scenario](v / 100)
            revenue = F.col("pq") * F.lit(up)
            profit = revenue - F.col("cq") * F.lit(down)
            base = F.col("pq") - F.col("cq")
            entries.append(
                F.struct(
                    F.lit(scenario).alias("scenario"), F.lit(float(v)).alias("value"),
                    revenue.alias("revenue"), profit.alias("profit"),
                    (profit - base).alias("profit_change"),
                    (F.try_divide(profit - base, base) * 100).alias("profit_change_pct"),
                )
            )
    return once.select(F.inline(F.array(*entries)))
