"""Exact order statistics and quantiles whose memory use does not grow with the data.

While a column has few distinct values, which is checked first, they are counted in a shuffle by value and ranked.
Beyond that a bracket around the wanted rank is narrowed with sketches, its rank is verified by exact counts, and only
the few values left in the bracket are counted and ranked. Sketches are merged in two levels: many tasks' into a fixed
number of parts, then points of those parts, so no task receives a sketch of every other.
"""

from __future__ import annotations

import math
from collections.abc import Container, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from plumbline.functions.lookup import bounded_copy
from plumbline.plans.roles import quoted
from plumbline.session import materialise

# Distinct values one task may hold for one column or group.
MAP_LIMIT = 200_000
# percentile_approx has a rank error of at most 1/accuracy, and points of a grid stand for the values between them.
SKETCH_ACCURACY = 10_000
_GRID = 1000
_MARGIN = 2.5 / _GRID
_PARTS = 64


def interpolate(low: float, high: float, position: float) -> float:
    """Value at a fractional rank between its two neighbouring order statistics."""
    share = position - math.floor(position)
    return low if share == 0.0 or low == high else low + (high - low) * share


@dataclass(frozen=True)
class _Bracket:
    """Values low..high of one column that hold ranks first..last (0-based) of its sorted values."""

    column: str
    first: int
    last: int
    low: object
    high: object
    below: int
    inside: int
    distinct: int
    stuck: bool = False

    def holds(self, value: Column) -> Column:
        return value.between(F.lit(self.low), F.lit(self.high))


def _measure(df: DataFrame, brackets: Sequence[_Bracket]) -> list[tuple[int, int, int]]:
    """Per bracket: values below it, values in it, approximate distinct values in it; one pass."""
    aggs = []
    for i, b in enumerate(brackets):
        value = F.col(quoted(b.column))
        aggs += [
            F.count_if(value < F.lit(b.low)).alias(f"below{i}"),
            F.count_if(b.holds(value)).alias(f"inside{i}"),
            F.approx_count_distinct(F.when(b.holds(value), value)).alias(f"distinct{i}"),
        ]
    row = df.agg(*aggs).first()
    return [(row[f"below{i}"], row[f"inside{i}"], row[f"distinct{i}"]) for i in range(len(brackets))]


def _sketch(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., v, share): some of the values ``v`` of each key and about what share of its rows is not larger."""
    grid = [i / _GRID for i in range(_GRID + 1)]
    parts = hits.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(_PARTS))).groupBy(*keys, "_part").agg(
        F.percentile_approx("v", grid, SKETCH_ACCURACY).alias("s"), F.count("v").alias("c")
    )
    points = parts.select(*keys, "c", F.explode("s").alias("v"))  # at most _PARTS * (_GRID + 1) per key
    whole = Window.partitionBy(*keys)
    upto = F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return points.select(*keys, "v", (upto / F.sum("c").over(whole)).alias("share"))


def _hits(df: DataFrame, members: Sequence[tuple[int, _Bracket]]) -> DataFrame:
    """(id, v): the values of each bracket; all columns are of one type."""
    tagged = [
        F.when(b.holds(F.col(quoted(b.column))), F.struct(F.lit(i).alias("id"), F.col(quoted(b.column)).alias("v")))
        for i, b in members
    ]
    return df.select(F.inline(F.array_compact(F.array(*tagged))))


def _by_type(df: DataFrame, brackets: Sequence[_Bracket]) -> list[list[tuple[int, _Bracket]]]:
    types, kinds = dict(df.dtypes), {}
    for i, b in enumerate(brackets):
        kinds.setdefault(types[b.column], []).append((i, b))
    return list(kinds.values())


def _narrow(df: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """One round: sketch a tighter bracket around the ranks, keep it only if exact counts confirm it.

    Brackets that still share their borders share one sketch.
    """
    shared: dict[tuple, int] = {}
    for i, b in enumerate(brackets):
        shared.setdefault((b.column, b.low, b.high), i)
    tried = list(brackets)
    for members in _by_type(df, brackets):
        owner = {i: shared[b.column, b.low, b.high] for i, b in members}
        aggs = []
        for i, b in members:
            own = F.col("id") == owner[i]
            lo, hi = (b.first - b.below) / b.inside - _MARGIN, (b.last + 1 - b.below) / b.inside + _MARGIN
            aggs += [F.max(F.when(own & (F.col("share") <= lo), F.col("v"))).alias(f"lo{i}")]
            aggs += [F.min(F.when(own & (F.col("share") >= hi), F.col("v"))).alias(f"hi{i}")]
        row = _sketch(_hits(df, [(i, b) for i, b in members if owner[i] == i]), ["id"]).agg(*aggs).first()
        for i, b in members:
            low, high = row[f"lo{i}"], row[f"hi{i}"]
            tried[i] = replace(b, low=b.low if low is None else low, high=b.high if high is None else high)
    out = []
    for old, new, (below, inside, distinct) in zip(brackets, tried, _measure(df, tried)):
        confirmed = below <= old.first and below + inside > old.last
        if confirmed and inside < old.inside:
            out.append(replace(new, below=below, inside=inside, distinct=distinct))
        else:
            out.append(replace(old, stuck=True))
    return out


def _rank_brackets(df: DataFrame, brackets: Sequence[_Bracket]) -> dict[tuple[str, int], object]:
    """Count the values inside each bracket and read off the wanted ranks."""
    found: dict[tuple[str, int], object] = {}
    for members in _by_type(df, brackets):
        values = _hits(df, members).groupBy("id", F.col("v").alias("value")).agg(F.count("*").alias("n"))
        order = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = values.withColumn("upto", F.sum("n").over(order))
        wanted = F.lit(False)
        for i, b in members:
            for rank in {b.first, b.last}:
                offset = rank - b.below
                wanted = wanted | (
                    (F.col("id") == i) & (F.col("upto") > offset) & (F.col("upto") - F.col("n") <= offset)
                )
        rows = ranked.filter(wanted).collect()  # at most two rows per bracket
        for i, b in members:
            for rank in (b.first, b.last):
                offset = rank - b.below
                found[b.column, rank] = next(
                    r["value"] for r in rows if r["id"] == i and r["upto"] - r["n"] <= offset < r["upto"]
                )
    return found


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[tuple[int, int]]], map_limit: int = MAP_LIMIT
) -> dict[tuple[str, int], object]:
    """Values at the given 0-based ranks of each column's sorted non-null values.

    ``ranks`` maps a column to pairs (first, last) of neighbouring ranks; the result is keyed by
    (column, rank). No shuffle of the rows: every pass is one map-side-combined aggregate, and the
    number of passes is logarithmic in the row count.
    """
    cols = list(ranks)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(quoted(c))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.approx_count_distinct(v).alias(f"d{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs).first()
    open_ = [
        _Bracket(c, first, last, row[f"lo{i}"], row[f"hi{i}"], 0, row[f"n{i}"], row[f"d{i}"])
        for i, c in enumerate(cols)
        for first, last in ranks[c]
    ]
    done: list[_Bracket] = []
    while open_:
        done += [b for b in open_ if b.distinct <= map_limit or b.stuck]
        open_ = [b for b in open_ if not (b.distinct <= map_limit or b.stuck)]
        if open_:
            open_ = _narrow(df, open_)
    return _rank_brackets(df, done) if done else {}


def _counted_quantiles(df: DataFrame, values: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of columns with few distinct values, which are counted in a shuffle by column and value."""
    names = list(values)
    counts = df.select(F.posexplode(F.array(*values.values())).alias("id", "v")).filter("v IS NOT NULL").groupBy("id", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("id")
    ranked = counts.withColumn("upto", F.sum("n").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("n").over(whole))
    wanted = F.lit(False)
    for p in probs:
        position = F.lit(float(p)) * (F.col("total") - 1)
        for rank in (F.floor(position), F.ceil(position)):
            wanted = wanted | ((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    rows: dict[int, list[Row]] = {}
    for r in ranked.filter(wanted).collect():  # at most two rows per column and quantile
        rows.setdefault(r["id"], []).append(r)
    at = lambda found, rank: next(r["v"] for r in found if r["upto"] - r["n"] <= rank < r["upto"])
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        found = rows.get(i)
        places = [p * (found[0]["total"] - 1) for p in probs] if found else []
        result[c] = [interpolate(at(found, math.floor(x)), at(found, math.ceil(x)), x) for x in places] or [None] * len(probs)
    return result


def column_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    extra: Sequence[Column] = (),
    accuracy: int | None = None,
    map_limit: int = MAP_LIMIT,
    narrow: Container[str] = (),
) -> tuple[dict[str, list[float | None]], Row]:
    """Quantiles with linear interpolation per numeric column, plus ``extra`` aggregates of the same pass.

    Exact unless ``accuracy`` asks for ``percentile_approx``. Columns in ``narrow`` are already known to stay
    within ``map_limit`` distinct values; when all are and nothing extra is asked, the first pass is skipped.
    """
    probs = list(probs)
    as_double = {c: F.col(quoted(c)).cast("double") for c in cols}
    if accuracy is not None:
        aggs = [F.percentile_approx(v, probs, accuracy).alias(f"q{i}") for i, v in enumerate(as_double.values())]
        row = df.agg(*aggs, *extra).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}, row

    sizes = []
    for i, (c, v) in enumerate(as_double.items()):
        if c not in narrow:
            sizes += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v).alias(f"d{i}")]
    row = df.agg(*sizes, *extra).first() if sizes or extra else Row()
    result: dict[str, list[float | None]] = {}
    small = {c: i for i, c in enumerate(cols) if c in narrow or row[f"d{i}"] <= map_limit}
    wide = {c: i for i, c in enumerate(cols) if c not in small}
    if small:
        result |= _counted_quantiles(df, {c: as_double[c] for c in small}, probs)
    if wide:
        doubles = df.select(*[as_double[c].alias(c) for c in wide])
        position = {(c, p): p * (row[f"n{i}"] - 1) for c, i in wide.items() for p in probs}
        ranks = {
            c: [(math.floor(position[c, p]), math.ceil(position[c, p])) for p in probs] for c in wide
        }
        stats = order_statistics(doubles, ranks, map_limit)
        for c in wide:
            result[c] = [
                interpolate(stats[c, first], stats[c, last], position[c, p])
                for p, (first, last) in zip(probs, ranks[c])
            ]
    return result, row


def grouped_quantiles(
    df: DataFrame, group: str, value: str, probs: Sequence[float], map_limit: int = MAP_LIMIT
) -> DataFrame:
    """(group, n, q: array) with exact quantiles of ``value`` per group.

    Groups within ``map_limit`` distinct values use ``percentile``. Larger ones are narrowed together; no task ever sorts
    or holds a whole large group, and their state stays in written tables.
    """
    rows = df.select(F.col(quoted(group)).alias("g"), F.col(quoted(value)).cast("double").alias("v")).dropna()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("d"))
    hot = materialise(sizes.filter(F.col("d") > map_limit), "hot_groups")
    probs_col = F.array(*[F.lit(float(p)) for p in probs])
    direct = lambda part: part.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", probs_col).alias("q"))
    if hot.isEmpty():
        return direct(rows).withColumnRenamed("g", group)

    small = bounded_copy(hot.select("g"))
    cold = direct(rows.join(F.broadcast(small) if small is not None else hot.select("g"), "g", "left_anti"))
    large = _large_group_quantiles(rows, hot, probs, map_limit)
    return cold.unionByName(large).withColumnRenamed("g", group)


def _bracketed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows joined to the brackets of their group: all of them are broadcast when few, else repeated over salted parts of the groups."""
    small = bounded_copy(brackets)
    if small is not None:
        return rows.join(F.broadcast(small), "g")
    salted = brackets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).cast("bigint"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(_PARTS))).join(salted, ["g", "_salt"]).drop("_salt")


def _large_group_quantiles(rows: DataFrame, groups: DataFrame, probs: Sequence[float], map_limit: int) -> DataFrame:
    """Brackets (one per group ``g`` and quantile ``j``) are narrowed in rounds; a bracket closes when it holds few values."""
    inf = float("inf")
    bounds = F.array(*[F.struct(F.lit(j).alias("j"), (F.lit(float(p)) * (F.col("n") - 1)).alias("position")) for j, p in enumerate(probs)])
    brackets = groups.select("g", "n", F.inline(bounds)).select(
        "*", F.floor("position").alias("first"), F.ceil("position").alias("last"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"),
        F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(True).alias("open"),
    )
    names = brackets.columns
    brackets, closed = materialise(brackets, "brackets"), []
    within = F.col("v").between(F.col("low"), F.col("high"))
    while not brackets.isEmpty():
        hits = _bracketed(rows, brackets.select("g", "j", "low", "high")).filter(within)
        share = lambda rank, more: (F.col(rank) + more - F.col("below")) / F.col("inside")
        points = _sketch(hits, ["g", "j"]).join(brackets.select("g", "j", "first", "last", "below", "inside"), ["g", "j"])
        borders = points.groupBy("g", "j").agg(
            F.max(F.when(F.col("share") <= share("first", 0) - _MARGIN, F.col("v"))).alias("new_low"),
            F.min(F.when(F.col("share") >= share("last", 1) + _MARGIN, F.col("v"))).alias("new_high"),
        )
        tried = brackets.join(borders, ["g", "j"]).withColumns({"new_low": F.coalesce("new_low", "low"), "new_high": F.coalesce("new_high", "high")})
        tried = materialise(tried, "tried")
        low, high = F.col("new_low"), F.col("new_high")
        inside = F.col("v").between(low, high)
        counted = _bracketed(rows, tried.select("g", "j", "new_low", "new_high")).groupBy("g", "j").agg(
            F.count_if(F.col("v") < low).alias("new_below"), F.count_if(inside).alias("new_inside"),
            F.approx_count_distinct(F.when(inside, F.col("v"))).alias("d"),
        )
        sound = (F.col("new_below") <= F.col("first")) & (F.col("new_below") + F.col("new_inside") > F.col("last"))
        judged = tried.join(counted, ["g", "j"]).withColumn("sound", sound)
        judged = judged.withColumn("open", F.col("sound") & (F.col("new_inside") < F.col("inside")) & (F.col("d") > map_limit))
        better = {c: F.when(F.col("sound"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("low", "high", "below", "inside")}
        judged = materialise(judged.withColumns(better).select(*names), "judged")
        closed.append(judged.filter("NOT open"))
        brackets = judged.filter("open")

    final = reduce(DataFrame.unionByName, closed)
    hits = _bracketed(rows, final.select("g", "j", "low", "high")).filter(within)
    values = hits.groupBy("g", "j", "v").agg(F.count("*").alias("c")).join(final.drop("low", "high", "inside", "open"), ["g", "j"])
    order = Window.partitionBy("g", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.col("below") + F.sum("c").over(order))
    covers = lambda rank: (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("c") <= F.col(rank))
    return (
        ranked.groupBy("g", "j", "n", "position", "first")
        .agg(F.min(F.when(covers("first"), F.col("v"))).alias("a"), F.max(F.when(covers("last"), F.col("v"))).alias("b"))
        .select("g", "n", "j", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - F.col("first"))).alias("q"))
        .groupBy("g", "n")
        .agg(F.array_sort(F.collect_list(F.struct("j", "q"))).alias("s"))
        .select("g", "n", F.col("s.q").alias("q"))
    )
