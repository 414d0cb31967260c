"""Queries for splits, folds, models, metrics and sequences."""

import uuid
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.operators import models, neighbours, sequences
from plumbline.plans import flows
from plumbline.session import shared_folder
from plumbline.sources.tables import load_model, save_model
from workload.tables import SALES_KEYS, SALES_SQL, rounded, sales, table

QUERIES, SQL = {}, {}

# Smaller ensembles than the defaults: these queries check that fitting runs on whole tables.
SMALL = EngineConfig(forest_trees=10, forest_depth=6, boosting_stages=10)
FEATURES = ["price", "quantity", "cost", "discount"]

_HASH = "CAST('0x' || substr(md5(concat_ws('|', {key}, '42')), 1, 8) AS BIGINT)"

QUERIES["train_test_split"] = lambda s, d: table(s, d, "orders").select("o_orderkey", models.is_test_row(["o_orderkey"]).alias("is_test"))
SQL["train_test_split"] = f"SELECT o_orderkey, {_HASH.format(key='o_orderkey')} % 1000 < 200 AS is_test FROM orders"

QUERIES["folds_hash"] = lambda s, d: table(s, d, "orders").select("o_orderkey", models.hash_fold(["o_orderkey"]).alias("fold"))
SQL["folds_hash"] = f"SELECT o_orderkey, CAST(({_HASH.format(key='o_orderkey')} // 1000) % 5 AS INTEGER) AS fold FROM orders"


def _contiguous(s, d):
    df = table(s, d, "orders")
    return df.select("o_orderkey", models.contiguous_fold(df, "o_orderkey").alias("fold"))


QUERIES["folds_contiguous"] = _contiguous
SQL["folds_contiguous"] = "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders"


def _stratified(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return models.with_stratified_fold(df, "o_orderkey", "o_orderstatus").drop("o_orderstatus")


QUERIES["folds_stratified"] = _stratified
SQL["folds_stratified"] = """WITH pos AS (SELECT o_orderkey, o_orderstatus AS y,
    row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS p,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS r FROM orders),
  share AS (SELECT y, p % 5 AS f, count(*) AS c FROM pos GROUP BY 1, 2),
  ends AS (SELECT y, f, c, sum(c) OVER (PARTITION BY y ORDER BY f) AS hi FROM share)
  SELECT o_orderkey, CAST(f AS INTEGER) AS fold FROM pos JOIN ends ON pos.y = ends.y AND r < hi AND r >= hi - c"""


def _single(fit):
    def run(s, d):
        rows = sales(s, d).select(F.col("quantity"), F.col("revenue").alias("label"))
        train = VectorAssembler(inputCols=["quantity"], outputCol="features").transform(rows)
        model = fit(train)
        # Joined to the row count so that the result says what it was fitted on.
        return rounded(
            train.agg(F.count("*").alias("n")).select("n", F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept")), 3
        )

    return run


def _single_sql(slope):
    return f"""WITH {SALES_SQL}, m AS (SELECT count(*) AS n, covar_pop(revenue, quantity) AS xy, var_pop(quantity) AS xx,
      avg(quantity) AS mx, avg(revenue) AS my FROM sales), w AS (SELECT *, {slope} AS b FROM m)
      SELECT n, round(b, 3) AS slope, round(my - b * mx, 3) AS intercept FROM w"""


QUERIES["linear_regression"] = _single(lambda t: models.REGRESSORS["linear"](t, SMALL))
SQL["linear_regression"] = _single_sql("xy / xx")
QUERIES["ridge_regression"] = _single(lambda t: models.ridge(t, 1000.0))
SQL["ridge_regression"] = _single_sql("n * xy / (n * xx + 1000.0)")
QUERIES["lasso_regression"] = _single(lambda t: models.lasso(t, 500.0))
SQL["lasso_regression"] = _single_sql("sign(xy) * greatest(abs(xy) - 500.0, 0) / xx")


def _predicted(s, d):
    return sales(s, d).withColumn("guess", F.col("quantity") * 1300 + 5000.0)


QUERIES["regression_metrics"] = lambda s, d: rounded(models.regression_metrics(_predicted(s, d), "revenue", "guess", ["region"]), 4)
SQL["regression_metrics"] = f"""WITH {SALES_SQL}, p AS (SELECT region, revenue AS y, quantity * 1300 + 5000.0 AS g FROM sales)
  SELECT region, count(*) AS n, round(avg((y - g) * (y - g)), 4) AS mse, round(avg(abs(y - g)), 4) AS mae,
  round(1 - avg((y - g) * (y - g)) / var_pop(y), 4) AS r2 FROM p GROUP BY 1"""


def _graded(s, d):
    joined = table(s, d, "labels").join(table(s, d, "documents"), "doc_id")
    return joined.select("quality", F.col("n_chars"), (F.col("n_chars") > 200).cast("int").alias("guess"))


QUERIES["classification_metrics"] = lambda s, d: rounded(models.classification_metrics(_graded(s, d), "quality", "guess"), 6)
SQL["classification_metrics"] = """WITH g AS (SELECT quality AS y, CAST(n_chars > 200 AS INTEGER) AS p FROM labels JOIN documents USING (doc_id)),
  k AS (SELECT c, (SELECT count(*) FROM g WHERE y = c) AS s, (SELECT count(*) FROM g WHERE p = c) AS q,
        (SELECT count(*) FROM g WHERE y = c AND p = c) AS h FROM (SELECT DISTINCT y AS c FROM g UNION SELECT DISTINCT p FROM g)),
  m AS (SELECT s, h, coalesce(h / nullif(q, 0), 0) AS pr, coalesce(h / nullif(s, 0), 0) AS re FROM k)
  SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(h) / sum(s), 6) AS accuracy, round(sum(s * pr) / sum(s), 6) AS "precision",
  round(sum(s * re) / sum(s), 6) AS recall, round(sum(s * coalesce(2 * pr * re / nullif(pr + re, 0), 0)) / sum(s), 6) AS f1 FROM m"""


def _auc(s, d):
    df = _graded(s, d)
    return df.agg(F.count("*").alias("n")).select("n", F.round(F.lit(models.roc_auc(df, "quality", "n_chars")), 6).alias("auc"))


QUERIES["roc_auc"] = _auc
SQL["roc_auc"] = """WITH g AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)),
  r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM g)
  SELECT count(*) AS n, round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r"""


def _leaderboard(names):
    def run(s, d):
        data = models.prepare(sales(s, d), FEATURES, "revenue", SALES_KEYS, SMALL)
        return models.leaderboard(data, SMALL, names).table

    return run


QUERIES["leaderboard_linear"] = lambda s, d: rounded(_leaderboard(["linear", "ridge", "lasso"])(s, d), 3)
QUERIES["leaderboard_trees"] = _leaderboard(["random_forest", "gradient_boosting"])


# Cost is 0.6 of price, so the two count as one feature of sqrt(1.36) prices in the models with squares, and lasso leaves the cost out.
_AXES = ("price", "quantity", "discount")


def _solved_sql(added):
    """Weights of three features by Cramer's rule from covariances ``c_ij`` and ``y_i``; ``added`` goes onto the diagonal."""
    entry = lambda i, j: f"(c{min(i, j)}{max(i, j)} + {added})" if i == j else f"c{min(i, j)}{max(i, j)}"
    minor = lambda m: f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    det = lambda m: "(" + " + ".join(f"{sign} * {m[0][j]} * {minor([[r[k] for k in range(3) if k != j] for r in m[1:]])}" for j, sign in enumerate((1, -1, 1))) + ")"
    matrix = [[entry(i, j) for j in range(3)] for i in range(3)]
    swap = lambda j: [[f"y{i}" if k == j else matrix[i][k] for k in range(3)] for i in range(3)]
    return [f"{det(swap(j))} / {det(matrix)}" for j in range(3)]


def _models_sql():
    """CTEs up to ``w (f, model, price, quantity, cost, discount, intercept)`` of all training rows (f = -1) and without each fold."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    z = ["sqrt(1.36) * price", "quantity", "discount"]
    cov = ", ".join(f"covar_pop({z[i]}, {z[j]}) AS c{i}{j}" for i, j in pairs) + ", " + ", ".join(f"covar_pop({x}, revenue) AS y{i}" for i, x in enumerate(z))
    means = ", ".join(f"avg({c}) AS m_{c}" for c in (*_AXES, "cost", "revenue"))
    least, squares = _solved_sql("0"), _solved_sql("1.0 / n")
    spread = lambda w: f"{w[0]} / sqrt(1.36) AS price, {w[1]} AS quantity, 0.6 * {w[0]} / sqrt(1.36) AS cost, {w[2]} AS discount"
    pull = lambda i, w: f"(q{i} - " + " - ".join(f"d{min(i, j)}{max(i, j)} * {w[j]}" for j in range(3) if j != i) + ")"
    soft = lambda i, w: f"(sign({pull(i, w)}) * greatest(abs({pull(i, w)}) - 1.0, 0) / d{i}{i})"
    raw = ", ".join(f"covar_pop({_AXES[i]}, {_AXES[j]}) AS d{i}{j}" for i, j in pairs) + ", " + ", ".join(f"covar_pop({x}, revenue) AS q{i}" for i, x in enumerate(_AXES))
    first = soft(0, ["w0", "w1", "w2"])
    return f"""{SALES_SQL}, rows AS MATERIALIZED (SELECT *, h % 1000 < 200 AS is_test, (h // 1000) % 5 AS fold FROM (SELECT *, {_HASH.format(key=', '.join(SALES_KEYS))} AS h FROM sales)),
  t AS MATERIALIZED (SELECT f, count(*) AS n, {cov}, {raw}, {means} FROM rows, (SELECT unnest(range(-1, 5)) AS f) WHERE NOT is_test AND fold <> f GROUP BY f),
  steps AS (WITH RECURSIVE s AS (SELECT f, 0 AS i, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2 FROM t UNION ALL
    SELECT f, i + 1, w0, w1, {soft(2, ["w0", "w1", "w2"])} FROM (SELECT f, i, w0, {soft(1, ["w0", "w1", "w2"])} AS w1, w2, t.* EXCLUDE (f) FROM (
      SELECT s.f, i, {first} AS w0, w1, w2 FROM s JOIN t USING (f) WHERE i < 100) JOIN t USING (f))) SELECT * FROM s WHERE i = 100),
  raw_w AS (SELECT f, 'linear' AS model, {spread(least)} FROM t UNION ALL SELECT f, 'ridge', {spread(squares)} FROM t
    UNION ALL SELECT f, 'lasso', w0, w1, CAST(0 AS DOUBLE), w2 FROM steps),
  w AS MATERIALIZED (SELECT raw_w.*, m_revenue - price * m_price - quantity * m_quantity - cost * m_cost - discount * m_discount AS intercept FROM raw_w JOIN t USING (f))"""


SQL["leaderboard_linear"] = f"""WITH {_models_sql()},
  e AS (SELECT f, model, is_test, fold, revenue AS y, revenue - w.intercept - w.price * r.price - w.quantity * r.quantity - w.cost * r.cost - w.discount * r.discount AS e
    FROM rows r CROSS JOIN w WHERE f = -1 OR (NOT is_test AND f = fold)),
  b AS (SELECT model, is_test, avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM e WHERE f = -1 GROUP BY ALL),
  v AS (SELECT model, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM (SELECT model, f, 1 - avg(e * e) / var_pop(y) AS r2 FROM e WHERE f >= 0 GROUP BY ALL) GROUP BY model)
  SELECT model, {', '.join(f"round(any_value({m}) FILTER ({'' if p == 'test' else 'NOT '}is_test), 3) AS {p}_{m}" for m in ('mse', 'mae', 'r2') for p in ('train', 'test'))},
  round(any_value(cv_mean), 3) AS cv_mean, round(any_value(cv_std), 3) AS cv_std FROM b JOIN v USING (model) GROUP BY model"""
SQL["coefficient_ranking"] = f"""WITH {_models_sql()},
  c AS (SELECT model, unnest(['price', 'quantity', 'cost', 'discount']) AS feature, unnest([0, 1, 2, 3]) AS place, unnest([price, quantity, cost, discount]) AS x FROM w WHERE f = -1)
  SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY abs(x) DESC, place) AS INTEGER) AS rank, feature, round(x, 3) AS coefficient, round(abs(x), 3) AS magnitude FROM c"""


def _class_board(names):
    def run(s, d):
        config = replace(SMALL, task="classification", forest_trees=5, boosting_stages=5, folds=3)
        vectors = table(s, d, "embeddings")
        # Every coordinate as a column, whole table; ten classes.
        wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
        data = models.prepare(wide, [f"x{i}" for i in range(64)], "label", ["vec_id"], config)
        return models.leaderboard(data, config, names).table

    return run


def _binary_board(names):
    def run(s, d):
        config = replace(SMALL, task="classification", forest_trees=5, boosting_stages=5, folds=3)
        joined = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(
            "doc_id", "quality", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines")
        )
        data = models.prepare(joined, ["n_chars", "n_words", "n_lines"], "quality", ["doc_id"], config)
        return models.leaderboard(data, config, names).table

    return run


QUERIES["leaderboard_multiclass"] = _class_board(["logistic", "decision_tree", "nearest_neighbours", "random_forest"])
QUERIES["leaderboard_binary"] = _binary_board(["logistic", "decision_tree", "linear_svm", "random_forest", "gradient_boosting"])


def _one_against_rest(name):
    """A two-class learner fitted once per class: predicted against true classes."""

    def run(s, d):
        config = replace(SMALL, task="classification", boosting_stages=3)
        vectors = table(s, d, "embeddings")
        wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
        data = models.prepare(wide, [f"x{i}" for i in range(64)], "label", ["vec_id"], config)
        predicted = models.CLASSIFIERS[name](data.train, config).transform(data.rows)
        return predicted.groupBy("label", "prediction", "is_test").agg(F.count("*").alias("n"))

    return run


QUERIES["linear_svm_multiclass"] = _one_against_rest("linear_svm")
QUERIES["gradient_boosting_multiclass"] = _one_against_rest("gradient_boosting")


def _rankings(kind):
    def run(s, d):
        data = models.prepare(sales(s, d), FEATURES, "revenue", SALES_KEYS, SMALL)
        names = ["linear", "ridge", "lasso"] if kind == "coefficients" else ["random_forest", "gradient_boosting"]
        fitted = {n: models.REGRESSORS[n](data.train, SMALL) for n in names}
        rank = models.coefficient_ranking if kind == "coefficients" else models.importance_ranking
        return rank(data.rows, fitted, FEATURES)

    return run


QUERIES["coefficient_ranking"] = lambda s, d: rounded(_rankings("coefficients")(s, d), 3)
QUERIES["importance_ranking"] = _rankings("importances")


def _nearest(s, d):
    df = table(s, d, "embeddings")
    flag = models.is_test_row(["vec_id"])
    return neighbours.knn_classify(df.filter(~flag), df.filter(flag), "label", "vec_id")


QUERIES["nearest_neighbour_classifier"] = _nearest
SQL["nearest_neighbour_classifier"] = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {_HASH.format(key='vec_id')} % 1000 < 200 AS t FROM embeddings),
  pairs AS (SELECT q.vec_id, b.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, b.e), b.vec_id) AS r
            FROM v q CROSS JOIN v b WHERE q.t AND NOT b.t),
  votes AS (SELECT vec_id, label, count(*) AS c FROM pairs WHERE r <= 5 GROUP BY 1, 2)
  SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS p FROM votes) WHERE p = 1"""


def _windows(segment_rows):
    def run(s, d):
        out = sequences.sequence_windows(table(s, d, "events"), ["ts", "event_id"], ["value"], "value", 5, "user_id", segment_rows)
        steps = out.select("user_id", "event_id", "label", F.posexplode("window").alias("step", "x"))
        return steps.select("user_id", "event_id", "label", "step", F.col("x")[0].alias("x"))

    return run


_WINDOWS_SQL = """WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
  SELECT a.user_id, a.event_id, a.value AS label, CAST(b.r - a.r + 5 AS INTEGER) AS step, b.value AS x
  FROM o a JOIN o b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 5 AND a.r - 1 WHERE a.r > 5"""
QUERIES["sequence_windows"] = _windows(sequences.SEGMENT_ROWS)
SQL["sequence_windows"] = _WINDOWS_SQL
# The way of keys too large for one task.
QUERIES["sequence_windows_segmented"] = _windows(40)
SQL["sequence_windows_segmented"] = _WINDOWS_SQL


def _packed(key, steps, segment_rows=sequences.SEGMENT_ROWS):
    """Packed segments, read back sample by sample."""

    def run(s, d):
        packed = sequences.packed_windows(table(s, d, "events"), ["ts", "event_id"], ["value"], "value", steps, key, segment_rows)
        out = sequences.expanded(packed, steps)
        total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
        return rounded(out.select("event_id", "label", F.size("window").alias("steps"), total.alias("total"), F.element_at("window", 1)[0].alias("first"), F.element_at("window", -1)[0].alias("last")), 4, "total")

    return run


def _packed_sql(key, steps):
    window = f"WINDOW w AS ({f'PARTITION BY {key} ' if key else ''}ORDER BY ts, event_id ROWS BETWEEN {steps} PRECEDING AND 1 PRECEDING)"
    return f"""WITH o AS (SELECT event_id, value AS label, CAST(count(*) OVER w AS INTEGER) AS steps, sum(value) OVER w AS total, first_value(value) OVER w AS first, last_value(value) OVER w AS last FROM events {window})
  SELECT event_id, label, steps, round(total, 4) AS total, first, last FROM o WHERE steps = {steps}"""


QUERIES["sequence_packed"] = _packed("user_id", 5)
SQL["sequence_packed"] = _packed_sql("user_id", 5)
# Long windows over one series, in segments ranked apart.
QUERIES["sequence_packed_long"] = _packed(None, 200, 700)
SQL["sequence_packed_long"] = _packed_sql(None, 200)


def _null_key_windows(s, d):
    """A third of all rows has no key and is cut into segments."""
    df = table(s, d, "events").withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END"))
    out = sequences.sequence_windows(df, ["ts", "event_id"], ["value"], "value", 5, "user_id", 700)
    return rounded(out.select("user_id", "event_id", "label", F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0]).alias("total")), 6, "total")


QUERIES["sequence_windows_null_key"] = _null_key_windows
SQL["sequence_windows_null_key"] = """WITH e AS (SELECT *  REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id) FROM events),
  o AS (SELECT user_id, event_id, value AS label, sum(value) OVER w AS total, count(*) OVER w AS c FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT user_id, event_id, label, round(total, 6) AS total FROM o WHERE c = 5"""


def _samples(s, d):
    out = flows.time_series_samples(table(s, d, "events").withColumnRenamed("ts", "event_time"), ["event_time", "event_id"], ["value"], "value")
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0])
    return rounded(out.select("event_id", "label", F.size("window").alias("steps"), total.alias("total")), 4, "total")


QUERIES["time_series_samples"] = _samples
SQL["time_series_samples"] = """WITH o AS (SELECT event_id, value AS label, sum(value) OVER w AS total, CAST(count(*) OVER w AS INTEGER) AS steps FROM events
    WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
  SELECT event_id, label, steps, round(total, 4) AS total FROM o WHERE steps = 30"""


def _saved_model(s, d):
    """A fitted pipeline is written, read again and used."""
    rows = sales(s, d).select(*SALES_KEYS, "quantity", F.col("revenue").alias("label"))
    assembler = VectorAssembler(inputCols=["quantity"], outputCol="features")
    fitted = models.REGRESSORS["linear"](assembler.transform(rows), SMALL)
    path = save_model(PipelineModel([assembler, fitted]), f"{shared_folder(s)}/workload-model-{uuid.uuid4().hex}")
    return rounded(load_model(path).transform(rows).select(*SALES_KEYS, "prediction"), 2, "prediction")


QUERIES["saved_model"] = _saved_model
SQL["saved_model"] = f"""WITH {SALES_SQL}, m AS (SELECT covar_pop(revenue, quantity) / var_pop(quantity) AS b, avg(quantity) AS mx, avg(revenue) AS my FROM sales)
  SELECT {', '.join(SALES_KEYS)}, round(my + b * (quantity - mx), 2) AS prediction FROM sales, m"""
