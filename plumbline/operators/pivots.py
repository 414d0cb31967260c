"""A tree of balls over vectors, grown level by level until every leaf has a bounded number of rows.

The rows of a node that is too large go to the nearest of some of its own rows, its pivots, and each pivot's rows become a node with the ball
that holds them. The rows of a node are dealt over blocks for that, so no task sees a large node. Nodes are a table, one row each; the
driver only counts how many are left to part. A search goes down the same levels with all its probes at once: a probe keeps the nodes
whose ball may hold one of its k nearest rows, judged by distances to pivots alone, and bounds sharpen on every level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.memory import give_back
from plumbline.functions.ranks import first_rows
from plumbline.session import materialise

FAN_OUT = 64
# Levels after which a node stays as it is; each divides the rows by up to FAN_OUT.
MOST_LEVELS = 16
_SLACK = 1e-9
# Rows whose distances are taken at a time.
_STRIP = 4_096


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.empty((0, 0))


def dense(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows of a matrix, without an object for each of them."""
    if not len(vectors):
        return np.empty((0, 0))
    widths = pc.min_max(pc.list_value_length(vectors)).as_py()
    if widths["min"] != widths["max"]:
        raise ValueError(f"vectors of {widths['min']} to {widths['max']} numbers in one column")
    out, done = np.empty((len(vectors), widths["min"])), 0
    for part in vectors.chunks:
        out[done : done + len(part)] = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1 if widths["min"] else 0)
        done += len(part)
    return out


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean, taken directly so that equal vectors are at distance 0."""
    out = np.empty((len(left), len(right)))
    for start in range(0, len(left), _STRIP):
        strip = left[start : start + _STRIP]
        for i, v in enumerate(right):
            out[start : start + _STRIP, i] = np.sqrt(((strip - v) ** 2).sum(axis=1))
    return out


@dataclass(frozen=True)
class PivotIndex:
    """``rows`` (id, v, node): every vector with its leaf. ``nodes`` (node, parent, level, v, radius, n, leaf): the tree, the root without a ball."""

    rows: DataFrame
    nodes: DataFrame
    levels: int
    total: int


def _split(rows: DataFrame, other: DataFrame, count: str, size: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt over blocks of about ``size`` within their node, and ``other``, few rows a node, repeated for each of the blocks."""
    sizes = rows.groupBy("node").agg(F.ceil(F.count("*") / size).cast("int").alias(count))
    left = rows.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64(salt), F.col(count)).cast("int")).drop(count)
    other = other.toDF(*other.columns)  # columns of its own, as it may come from the same table
    right = other.join(sizes.toDF(*sizes.columns), "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
    return left, right


def build(base: DataFrame, leaf_rows: int, block_rows: int, fan_out: int = FAN_OUT, most_leaves: int | None = None) -> PivotIndex:
    """The index of ``base`` (id, v). Leaves hold at most ``leaf_rows`` rows, unless they are copies of one vector.

    With ``most_leaves`` they may hold that share of the rows, up to ``block_rows``, so that a probe which no ball turns away is not sent to
    ever more of them.
    """
    spark = base.sparkSession
    id_kind = base.schema["id"].dataType.simpleString()
    large = materialise(base.select("id", "v", F.lit(0).cast("long").alias("node")), "pivot-rows")
    total = large.count()
    if most_leaves is not None:
        leaf_rows = max(leaf_rows, min(block_rows, -(-total // most_leaves)))
    # Made by Spark: rows given by Python would keep a second set of workers on every executor.
    root = {"node": F.lit(0).cast("long"), "parent": F.lit(None).cast("long"), "level": F.lit(0), "v": F.lit(None).cast("array<double>")}
    root |= {"radius": F.lit(float("inf")), "n": F.lit(total).cast("long"), "leaf": F.lit(total <= leaf_rows)}
    root = spark.range(1).select(*[value.alias(name) for name, value in root.items()])
    done, nodes, level = [], [root], 0
    if total <= leaf_rows:
        return PivotIndex(large, root, 0, total)

    id_type, vector_type = to_arrow_type(base.schema["id"].dataType), pa.list_(pa.field("element", pa.float64()))

    def nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({})
        pivots = pivots.sort_by("place")
        apart = distances(dense(rows["v"]), dense(pivots["v"]))
        at = apart.argmin(axis=1)
        parent = rows["node"].to_numpy()
        radius = apart[np.arange(len(at)), at]
        del apart
        give_back()
        node = parent * (fan_out + 1) + pivots["place"].to_numpy()[at]
        pivot = pivots["v"].take(pa.array(at)).cast(vector_type)
        return pa.table({"id": rows["id"].cast(id_type), "v": rows["v"].cast(vector_type), "node": node, "pivot": pivot, "radius": radius, "parent": parent})

    while level < MOST_LEVELS:
        level += 1
        sizes = large.groupBy("node").agg(F.least(F.lit(fan_out), F.ceil(2 * F.count("*") / leaf_rows) + 1).alias("wanted"))
        # Any vectors do as pivots, if they differ; a hash order makes the choice repeatable.
        differ = large.select("node", "v").distinct().withColumn("h", F.xxhash64("v", F.lit(level)))
        picked = first_rows(differ, ["node"], ["h", "v"], fan_out, "place")
        picked = picked.join(sizes, "node").filter(F.col("place") <= F.col("wanted")).select("node", "place", "v")
        left, right = _split(large, picked, "blocks", block_rows, "id")
        shape = f"id {id_kind}, v array<double>, node long, pivot array<double>, radius double, parent long"
        placed = materialise(left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(nearest, shape), "pivot-rows")
        made = placed.groupBy("node").agg(F.first("parent").alias("parent"), F.lit(level).alias("level"), F.first("pivot").alias("v"), F.max("radius").alias("radius"), F.count("*").alias("n"))
        last = F.lit(level == MOST_LEVELS)
        made = materialise(made.withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("radius") == 0) | last), "pivot-nodes")
        nodes.append(made)
        kinds = placed.join(made.select("node", "leaf"), "node")
        done.append(kinds.filter("leaf").select("id", "v", "node"))
        if made.filter("NOT leaf").isEmpty():
            break
        large = kinds.filter("NOT leaf").select("id", "v", "node")
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return PivotIndex(union(done), union(nodes), level, total)


def _bounded(found: DataFrame, k: int) -> DataFrame:
    """Without the nodes that cannot hold one of the k nearest rows: as many rows as k are certain within the bound of the others."""
    reach = F.when(F.sum("n").over(Window.partitionBy("probe").orderBy("high", "node").rowsBetween(Window.unboundedPreceding, 0)) >= k, F.col("high"))
    held = found.withColumn("_reach", reach)
    bound = F.coalesce(F.min("_reach").over(Window.partitionBy("probe")), F.lit(float("inf")))
    return held.withColumn("_bound", bound).filter(F.col("low") <= F.col("_bound") * (1 + _SLACK) + _SLACK).drop("_reach", "_bound")


def route(index: PivotIndex, probes: DataFrame, k: int, block_rows: int, leaves: int | None = None) -> DataFrame:
    """(query_id, v, node): the leaves in which each of ``probes`` (query_id, v) has to look for its k nearest rows.

    Exact, unless ``leaves`` says how many of the nearest leaves a probe looks into at most.
    """
    # Only numbers of probes travel with the nodes; their vectors are joined where they are needed.
    probes = materialise(probes.select("query_id", "v").withColumn("probe", F.monotonically_increasing_id()), "probes")
    # The root's number is computed, as a join on a literal would have no key left.
    root = {"node": F.pmod(F.xxhash64("probe"), F.lit(1).cast("long")), "n": F.lit(index.total).cast("long"), "leaf": F.lit(not index.levels), "low": F.lit(0.0), "high": F.lit(float("inf"))}
    at = probes.select("probe").withColumns(root)

    def descend(asked: pa.Table, children: pa.Table) -> pa.Table:
        """One row per probe and child, without the children that the others rule out."""
        if not asked.num_rows or not children.num_rows:
            return pa.table({})
        apart = distances(dense(asked["v"]), dense(children["c"]))
        radius, sizes = children["radius"].to_numpy(), children["n"].to_numpy()
        low = np.maximum(asked["low"].to_numpy()[:, None], np.maximum(apart - radius, 0.0))
        high = apart + radius
        order = high.argsort(axis=1, kind="stable")
        certain = sizes[order].cumsum(axis=1) >= k
        first = np.take_along_axis(high, np.take_along_axis(order, certain.argmax(axis=1)[:, None], 1), 1)
        bound = np.where(certain[:, -1:], first, np.inf)
        near = low <= bound * (1 + _SLACK) + _SLACK
        row, child = np.nonzero(near)
        found = {name: children[column].to_numpy()[child] for name, column in (("node", "child"), ("n", "n"), ("leaf", "leaf"))}
        found = pa.table({"probe": asked["probe"].to_numpy()[row], **found, "low": low[near], "high": high[near]})
        del apart, low, high, order, certain, near, row, child
        give_back()
        return found

    for level in range(1, index.levels + 1):
        children = index.nodes.filter(F.col("level") == level).select(F.col("parent").alias("node"), F.col("node").alias("child"), F.col("v").alias("c"), "radius", "n", "leaf")
        asked = at.filter("NOT leaf").select("probe", "node", "low").join(probes.select("probe", "v"), "probe")
        left, right = _split(asked, children, "blocks", max(1, block_rows // 8), "probe")
        shape = "probe long, node long, n long, leaf boolean, low double, high double"
        below = left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(descend, shape)
        at = materialise(_bounded(at.filter("leaf").select(*below.columns).unionByName(below), k), "pivot-routes")
    if leaves is not None:
        at = first_rows(at, ["probe"], ["low", "high", "node"], leaves, "_place")
    return at.select("probe", "node").join(probes, "probe").select("query_id", "v", "node")


def blocks_of(rows: DataFrame, routed: DataFrame, block_rows: int, names: Sequence[str] = ("id", "query_id"), probe_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over blocks of bounded size; every block of a leaf's rows meets every block of the probes routed to it."""
    row_id, probe_id = names
    counts = rows.groupBy("node").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("bs_n"))
    counts = counts.join(routed.groupBy("node").agg(F.ceil(F.count("*") / (probe_rows or block_rows)).cast("int").alias("ps_n")), "node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    left = rows.join(counts, "node").withColumn("bs", cell(row_id, "bs_n")).withColumn("ps", every("ps_n")).select("node", "bs", "ps", row_id, "v")
    right = routed.join(counts, "node").withColumn("ps", cell(probe_id, "ps_n")).withColumn("bs", every("bs_n")).select("node", "bs", "ps", probe_id, "v")
    return left, right
