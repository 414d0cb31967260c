"""Sequence samples for time-ordered models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.lookup import attach, bounded_copy
from plumbline.functions.ranks import with_rank
from plumbline.plans.roles import quoted

# A key with more rows than this is cut into time segments, so no task windows a whole hot key.
SEGMENT_ROWS = 5_000_000
# Rows of a packed segment, or as many as a window has steps.
PACK_ROWS = 1_024


def default_steps(train_rows: int) -> int:
    """Sequence length from the number of training rows."""
    return min(30, train_rows // 10)


def _windows(rows: DataFrame, within: Sequence[str], order: Sequence[str], steps: int) -> DataFrame:
    frame = Window.partitionBy(*within).orderBy(*order).rowsBetween(-steps, -1)
    sized = rows.withColumn("window", F.collect_list("_x").over(frame))
    return sized.filter(F.size("window") == steps)


def _places(rows: DataFrame, names: Sequence[str], segment_rows: int) -> DataFrame:
    """``rows`` with each row's ``_place`` within its key ``_k``; keys above ``segment_rows`` rows are not ranked in one task."""
    hot_keys = rows.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > segment_rows)
    numbered = lambda part: part.withColumn("_place", (F.row_number().over(Window.partitionBy("_k").orderBy(*names)) - 1).cast("long"))
    small = bounded_copy(hot_keys)
    if small is not None and small.isEmpty():
        return numbered(rows)
    listed = (F.broadcast(small) if small is not None else hot_keys).withColumnRenamed("_k", "_hot")
    same = F.col("_k").eqNullSafe(F.col("_hot"))
    ranked = with_rank(rows.join(listed, same, "left_semi"), ["_k", *names], "_rank")
    starts = ranked.groupBy(F.struct("_k").alias("_key")).agg(F.min("_rank").alias("_start"), F.count("*").alias("_n"))
    placed = attach(ranked.withColumn("_key", F.struct("_k")), starts, ["_key"], "_n").withColumn("_place", F.col("_rank") - F.col("_start"))
    return numbered(rows.join(listed, same, "left_anti")).unionByName(placed.select(*rows.columns, "_place"))


def packed_windows(
    df: DataFrame, order: Sequence[str], features: Sequence[str], label: str, steps: int,
    key: str | None = None, segment_rows: int = SEGMENT_ROWS, pack_rows: int = PACK_ROWS,
) -> DataFrame:
    """The samples of ``sequence_windows`` without copies: one row per segment of a key's time, ``x`` its rows in order, ``samples`` where they end.

    A segment holds up to ``max(pack_rows, steps)`` rows and the ``steps`` rows before them, so all segments together hold at most twice the rows,
    whatever ``steps`` is. Each entry of ``samples`` has the row's order columns, its label and the offset of its window in ``x``;
    ``expanded`` makes the windows when they are read.
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(
        (F.col(quoted(key)) if key else F.lit(0)).alias("_k"),
        *[F.col(quoted(o)).alias(n) for o, n in zip(order, names)],
        F.array(*[F.col(quoted(f)).cast("double") for f in features]).alias("_x"),
        F.col(quoted(label)).alias("_label"),
    )
    length = max(pack_rows, steps)
    placed = _places(rows, names, segment_rows).withColumn("_seg", F.floor(F.col("_place") / length)).withColumn("_halo", F.lit(False))
    before = placed.filter(F.col("_place") % length >= length - steps).withColumns({"_seg": F.col("_seg") + 1, "_halo": F.lit(True)})
    row = F.struct(*[F.col(n).alias(o) for n, o in zip(names, order)], F.col("_label").alias("label"))
    listed = lambda *cols: F.array_sort(F.collect_list(F.struct("_place", *cols)))  # a segment's rows; places differ within it
    segments = placed.unionByName(before).groupBy("_k", "_seg").agg(listed("_halo", "_x").alias("_r"), F.transform(listed(row.alias("_s")), lambda e: e["_s"]).alias("_e"))
    offset = F.transform("_e", lambda e, i: F.struct((i - steps).alias("offset"), e.alias("row")))
    own = F.filter(F.zip_with(offset, "_r", lambda s, r: F.struct(s["offset"].alias("offset"), s["row"].alias("row"), r["_halo"].alias("halo"))), lambda s: (s["offset"] >= 0) & ~s["halo"])
    samples = F.transform(own, lambda s: F.struct(*[s["row"][o].alias(o) for o in order], s["row"]["label"].alias("label"), s["offset"].alias("offset")))
    return segments.select(*([F.col("_k").alias(key)] if key else []), F.col("_seg").alias("segment"), F.col("_r._x").alias("x"), samples.alias("samples")).filter(F.size("samples") > 0)


def expanded(packed: DataFrame, steps: int) -> DataFrame:
    """One row per sample, like ``sequence_windows``: its order columns, ``label`` and ``window``."""
    keys = [c for c in packed.columns if c not in ("segment", "x", "samples")]
    one = packed.select(*[F.col(quoted(c)) for c in keys], "x", F.explode("samples").alias("_s"))
    fields = [f.name for f in packed.schema["samples"].dataType.elementType.fields if f.name not in ("label", "offset")]
    return one.select(*[F.col(quoted(c)) for c in keys], *[F.col("_s")[f].alias(f) for f in fields], F.slice("x", F.col("_s.offset") + 1, steps).alias("window"), F.col("_s.label").alias("label"))


def sequence_windows(
    df: DataFrame, order: Sequence[str], features: Sequence[str], label: str, steps: int,
    key: str | None = None, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per sample: key and order columns, ``window`` (steps x features) and ``label``.

    The window holds the ``steps`` rows before the row in ``order`` within its ``key``; the label is the
    row's own. Rows without enough history give no sample. ``order`` must identify rows within a key; its
    columns may have any type that sorts.

    Keys above ``segment_rows`` rows (all rows, without a key; NULL is a key like any other) are cut into segments of that many
    rows by their ranks. Each segment also receives the last ``steps`` rows of the one before, so the
    samples are the same as from one long window.
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    key_column = F.col(quoted(key)) if key else F.lit(0)
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(
        key_column.alias("_k"),
        *[F.col(quoted(o)).alias(n) for o, n in zip(order, names)],
        F.array(*[F.col(quoted(f)).cast("double") for f in features]).alias("_x"),
        F.col(quoted(label)).alias("label"),
    )
    hot_keys = rows.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > segment_rows)
    result = [*([F.col("_k").alias(key)] if key else []), *[F.col(n).alias(o) for n, o in zip(names, order)], "window", "label"]
    small = bounded_copy(hot_keys)
    if small is not None and small.isEmpty():
        return _windows(rows, ["_k"], names, steps).select(*result)

    listed = (F.broadcast(small) if small is not None else hot_keys).withColumnRenamed("_k", "_hot")
    same = F.col("_k").eqNullSafe(F.col("_hot"))
    cold = rows.join(listed, same, "left_anti")
    ranked = with_rank(rows.join(listed, same, "left_semi"), ["_k", *names], "_rank")
    # A key's rows have neighbouring ranks, so its smallest rank makes them places within the key.
    starts = ranked.groupBy(F.struct("_k").alias("_key")).agg(F.min("_rank").alias("_start"), F.count("*").alias("_n"))
    length = max(segment_rows, steps)
    place = F.col("_rank") - F.col("_start")
    placed = attach(ranked.withColumn("_key", F.struct("_k")), starts, ["_key"], "_n").select(
        "_k", *names, "_x", "label", F.floor(place / length).alias("_seg"), (place % length).alias("_place")
    )
    halo = placed.filter(F.col("_place") >= length - steps).withColumn("_seg", F.col("_seg") + 1)
    both = placed.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    from_hot = _windows(both, ["_k", "_seg"], names, steps).filter(~F.col("_halo"))
    from_cold = _windows(cold, ["_k"], names, steps)
    return from_hot.select(*result).unionByName(from_cold.select(*result))
