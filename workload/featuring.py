"""Queries for encoding, scaling, selection and projection."""

from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.operators import features, models
from plumbline.plans import flows
from workload.tables import SALES_KEYS, SALES_SQL, rounded, sales

QUERIES, SQL = {}, {}
_KEYS = ", ".join(SALES_KEYS)

QUERIES["encode_onehot"] = lambda s, d: features.encode_onehot(sales(s, d).select(*SALES_KEYS, "category", "region"), ["category", "region"])
_ONE = [("category", v) for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
_ONE += [("region", v) for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
SQL["encode_onehot"] = f"WITH {SALES_SQL} SELECT {_KEYS}, " + ", ".join(
    f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}" """ for c, v in _ONE
) + "FROM sales"

QUERIES["encode_label"] = lambda s, d: features.encode_label(sales(s, d).select(*SALES_KEYS, "product", "region"), ["product", "region"])
SQL["encode_label"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, CAST(dense_rank() OVER (ORDER BY product) - 1 AS BIGINT) AS product,
  CAST(dense_rank() OVER (ORDER BY region) - 1 AS BIGINT) AS region FROM sales"""

# The way of a column with more values than a broadcast may hold.
QUERIES["encode_label_wide"] = lambda s, d: features.encode_label(
    sales(s, d).select(*SALES_KEYS, F.concat_ws("-", "product", "category", "region").alias("code")), ["code"], max_rows=100
)
SQL["encode_label_wide"] = f"""WITH {SALES_SQL} SELECT {_KEYS},
  CAST(dense_rank() OVER (ORDER BY product || '-' || category || '-' || region) - 1 AS BIGINT) AS code FROM sales"""


def _scaled(method):
    def run(s, d):
        df = sales(s, d).select(*SALES_KEYS, "quantity", "price", "profit", F.lit(2024.0).alias("fixed"))
        df = df.withColumnRenamed("quantity", "line_quantity")
        return rounded(features.scale(df, ["line_quantity", "price", "profit", "fixed"], method), 6, "line_quantity", "price", "profit", "fixed")

    return run


def _scaled_sql(form):
    cells = ", ".join(f"round({form.format(c)}, 6) AS {name}" for name, c in (("line_quantity", "quantity"), ("price", "price"), ("profit", "profit")))
    return f"WITH {SALES_SQL} SELECT {_KEYS}, {cells}, CAST(0 AS DOUBLE) AS fixed FROM sales"


QUERIES["scale_standard"] = _scaled("standard")
SQL["scale_standard"] = _scaled_sql("({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER ()")
QUERIES["scale_minmax"] = _scaled("minmax")
SQL["scale_minmax"] = _scaled_sql("({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ())")

_SCORED = ["price", "cost", "revenue", "profit", "discount"]
QUERIES["select_k_best_scores"] = lambda s, d: rounded(features.f_scores(sales(s, d), _SCORED, "quantity"), 4)
SQL["select_k_best_scores"] = f"WITH {SALES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round((sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) AS score FROM
    (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS w, any_value(a) AS a FROM sales, (SELECT avg({c}) AS a FROM sales) t GROUP BY quantity)"""
    for c in _SCORED
)

# Places of a category with few values and of one with more values than a table may have columns, next to numbers.
_CODED = "sale_code AS (SELECT *, l_partkey || '-' || region AS code FROM sales)"


def _coded(s, d):
    return sales(s, d).withColumn("code", F.concat_ws("-", "l_partkey", "region"))


def _place_score_sql(column, y):
    return f"""SELECT '{column}_' || {column} AS feature, ((sum(s * s / n) - sum(s) * sum(s) / any_value(r)) / (any_value(k) - 1)) / nullif((sum(s) - sum(s * s / n)) / (any_value(r) - any_value(k)), 0) AS score
    FROM (SELECT {column}, {y} AS y, CAST(count(*) AS DOUBLE) AS s FROM sale_code WHERE {column} > (SELECT min({column}) FROM sale_code) GROUP BY 1, 2)
    JOIN (SELECT {y} AS y, CAST(count(*) AS DOUBLE) AS n FROM sale_code GROUP BY 1) USING (y),
    (SELECT count(DISTINCT {y}) AS k, CAST(count(*) AS DOUBLE) AS r FROM sale_code) GROUP BY {column}"""


def _number_score_sql(c, y):
    return f"""SELECT '{c}' AS feature, (sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS score FROM
    (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS w, any_value(a) AS a FROM sale_code, (SELECT avg({c}) AS a FROM sale_code) t GROUP BY {y})"""


QUERIES["category_scores"] = lambda s, d: rounded(features.category_scores(_coded(s, d), ["category", "region", "code"], "quantity").select("feature", "score"), 6)
SQL["category_scores"] = f"WITH {SALES_SQL}, {_CODED} SELECT feature, round(score, 6) AS score FROM (" + " UNION ALL ".join(_place_score_sql(c, "quantity") for c in ("category", "region", "code")) + ")"


def _wide_places(s, d):
    """The place that each row has in the sparse form, none for the first value."""
    coded = features.encode_onehot_vector(_coded(s, d).select(*SALES_KEYS, "code"), "code")
    hot = F.unwrap_udt("code_onehot")
    return coded.select(*SALES_KEYS, hot["size"].alias("width"), F.get(hot["indices"], F.lit(0)).alias("place"), F.get(hot["values"], F.lit(0)).alias("x"))


QUERIES["encode_onehot_wide"] = _wide_places
SQL["encode_onehot_wide"] = f"""WITH {SALES_SQL}, {_CODED}, r AS (SELECT {_KEYS}, dense_rank() OVER (ORDER BY code) - 2 AS p FROM sale_code)
  SELECT {_KEYS}, (SELECT CAST(count(DISTINCT code) - 1 AS INTEGER) FROM sale_code) AS width, CAST(CASE WHEN p >= 0 THEN p END AS INTEGER) AS place, CASE WHEN p >= 0 THEN CAST(1 AS DOUBLE) END AS x FROM r"""


def _selected(s, d):
    """The feature stage with selection: chosen features in order, with their mean and deviation in the table it returns."""
    df = _coded(s, d).select(*SALES_KEYS, "quantity", "price", "profit", "discount", "category", "region", "code")
    made = flows.build_features(df, EngineConfig(selection="selectkbest"), target="quantity", keys=SALES_KEYS)
    row = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for i, n in enumerate(made.names)])
    stats = made.table.select(F.inline(row)).groupBy("rank", "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    return rounded(stats.withColumns({"mean": F.round("mean", 6) + 0.0}), 6)


QUERIES["build_features_selected"] = _selected
SQL["build_features_selected"] = f"""WITH {SALES_SQL}, {_CODED}, f AS (""" + " UNION ALL ".join(
    [_number_score_sql(c, "quantity") for c in ("price", "profit", "discount")] + [_place_score_sql(c, "quantity") for c in ("category", "region", "code")]
) + """), b AS (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS rank FROM f),
  v AS (SELECT feature, n FROM (""" + " UNION ALL ".join(f"SELECT '{c}_' || {c} AS feature, count(*) AS n FROM sale_code GROUP BY 1" for c in ("category", "region", "code")) + """)),
  t AS (SELECT CAST(count(*) AS DOUBLE) AS r FROM sale_code)
  SELECT CAST(rank AS INTEGER) AS rank, feature, CAST(r AS BIGINT) AS n, coalesce(round(n / r, 6), 0.0) AS mean, coalesce(round(sqrt(n / r * (1 - n / r)), 6), 1.0) AS deviation
  FROM b LEFT JOIN v USING (feature), t WHERE rank <= 10"""

QUERIES["feature_table"] = lambda s, d: rounded(features.feature_table(sales(s, d), ["price", "quantity", "discount"], "revenue"), 4)
SQL["feature_table"] = f"""WITH {SALES_SQL} SELECT round(price, 4) AS price, round(quantity, 4) AS quantity,
  round(discount, 4) AS discount, round(revenue, 4) AS revenue FROM sales"""


def _components(s, d):
    out, ratios = features.principal_components(sales(s, d), ["quantity", "discount"], 2, SALES_KEYS)
    parts = [F.abs(f"PC{i}").alias(f"size{i}") for i in (1, 2)]  # the sign of a component is arbitrary
    return rounded(out.select(*SALES_KEYS, *parts, *[F.lit(r).alias(f"ratio{i + 1}") for i, r in enumerate(ratios)]), 5)


QUERIES["principal_components"] = _components
SQL["principal_components"] = f"""WITH {SALES_SQL}, m AS (SELECT avg(quantity) AS mx, avg(discount) AS my, var_samp(quantity) AS a,
    covar_samp(quantity, discount) AS b, var_samp(discount) AS c FROM sales),
  e AS (SELECT *, 0.5 * atan2(2 * b, a - c) AS t, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 AS top FROM m)
  SELECT {', '.join(SALES_KEYS)}, round(abs((quantity - mx) * cos(t) + (discount - my) * sin(t)), 5) AS size1,
  round(abs((discount - my) * cos(t) - (quantity - mx) * sin(t)), 5) AS size2,
  round(top / (a + c), 5) AS ratio1, round(1 - top / (a + c), 5) AS ratio2 FROM sales, e"""


def _elimination(s, d):
    df = sales(s, d)
    df = df.select("price", "quantity", "discount", "revenue", models.hash_fold(SALES_KEYS, 3).alias("fold"))
    config = EngineConfig(forest_trees=5, forest_depth=5, folds=3, parallel_fits=3)
    kept, ranking = features.recursive_elimination(df, ["price", "quantity", "discount"], "revenue", "fold", config)
    return s.createDataFrame([(f, r, f in kept) for f, r in ranking.items()], "feature string, ranking int, kept boolean")


QUERIES["recursive_elimination"] = _elimination
