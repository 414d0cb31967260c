"""Rules over the schema: column classes, targets, key-figure roles, test plans.

Nothing here touches rows; every rule is a function of column names and types.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline import fixed_values as fixed


def numeric_columns(df: DataFrame) -> list[str]:
    """Integer, floating and decimal columns; booleans are not numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """String columns, nominal or not, without the excluded ones."""
    left_out = set(exclude)
    return [c for c in string_columns(df) if c not in left_out]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def column_classes(df: DataFrame) -> dict[str, list[str]]:
    return {
        "numeric": numeric_columns(df),
        "categorical": string_columns(df),
        "datetime": datetime_columns(df),
    }


def quoted(name: str) -> str:
    """A column name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def name_has(name: str, keywords: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(k in name or k in lowered for k in keywords)


def first_named(names: Sequence[str], keywords: Iterable[str]) -> str | None:
    keywords = list(keywords)
    return next((n for n in names if name_has(n, keywords)), None)


def scalable_columns(numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Numeric columns to scale: those whose name contains no categorical column's name."""
    return [n for n in numeric if not any(c in n for c in categorical)]


def feature_target(df: DataFrame, target: str | None = None) -> str:
    """Target of the feature stage: the given one, else the first numeric measure."""
    if target is not None:
        if target not in df.columns:
            raise ValueError(f"target column {target!r} is not in the table")
        return target
    for name in numeric_columns(df):
        lowered = name.lower()
        if lowered in fixed.NON_TARGET_NAMES:
            continue
        if any(part in lowered for part in fixed.NON_TARGET_PARTS):
            continue
        return name
    raise ValueError("no numeric column qualifies as target; name one")


def analysis_target(df: DataFrame, target: str | None = None) -> str | None:
    """Target of the analysis stage: given, else first keyword match, else the last numeric column.

    The two stages disagree by these rules, so flows resolve one target and pass it on.
    """
    if target is not None and target in df.columns:
        return target
    numeric = numeric_columns(df)
    match = next((n for n in numeric if any(k in n.lower() for k in fixed.TARGET_KEYWORDS)), None)
    return match or (numeric[-1] if numeric else None)


def possible_targets(df: DataFrame) -> list[str]:
    return [
        n for n in numeric_columns(df) if "id" not in n.lower() and "index" not in n.lower()
    ]


def key_figure_roles(df: DataFrame, roles: dict[str, str] | None = None) -> dict[str, str]:
    """Role to column, first match in schema order; ``roles`` overrides single entries."""
    pools = {role: numeric_columns(df) for role in ("price", "quantity", "cost", "profit", "revenue")}
    pools |= {role: string_columns(df) for role in ("product", "region")}
    found = {
        role: match
        for role, names in pools.items()
        if (match := first_named(names, fixed.ROLE_KEYWORDS[role])) is not None
    }
    return found | (roles or {})


def default_tests(df: DataFrame, target: str | None = None) -> list[dict]:
    """Test specs planned from column names alone."""
    names = df.columns
    role = {r: first_named(names, k) for r, k in fixed.TEST_ROLE_KEYWORDS.items()}
    specs: list[dict] = []
    if role["promotion"] and role["sales"]:
        specs.append(
            {"test_name": "promotion_impact", "kind": "t_pooled", "columns": [role["promotion"], role["sales"]]}
        )
    if role["category"] and target:
        specs.append({"test_name": "category_impact", "kind": "anova", "columns": [role["category"], target]})
    value = target or role["amount"]
    if role["region"] and value:
        specs.append({"test_name": "region_impact", "kind": "anova", "columns": [role["region"], value]})
    return specs


def has_time_series(df: DataFrame, feature_names: Iterable[str] = ()) -> bool:
    """True with a datetime column named like one, or a feature named after a calendar part."""
    if any(name_has(c, fixed.DATETIME_NAME_PARTS) for c in datetime_columns(df)):
        return True
    return any(part in f.lower() for f in feature_names for part in fixed.TIME_FEATURE_PARTS)
