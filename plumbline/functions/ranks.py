"""Ranks over a whole table and the first rows of groups, without one task that sees everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import materialise

# Spark trims each task's rows before the shuffle up to this k only.
_TRIMMED = 1_000
_PARTS = 64
# A row's id holds its partition above this bit and its place in the partition below.
_PLACE_BITS = 33


def with_rank(df: DataFrame, order: Sequence[str], output: str) -> DataFrame:
    """``df`` with the 0-based rank of each row in ``order``, which should tell all rows apart.

    One range partitioning and a sort within partitions; the written table keeps each row's partition and place, and only the
    partitions' sizes reach the driver. Equal keys share a partition, so their rows should differ in a later column.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(output, F.monotonically_increasing_id())
    placed = materialise(placed, "ranked")
    part = F.shiftright(F.col(output), _PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    rows, before = [], 0
    for r in sizes:
        rows.append((r["_part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    place = F.col(output).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))  # one row per partition
    return joined.withColumn(output, F.col("_before") + place).select(*df.columns, output)


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], k: int, output: str) -> DataFrame:
    """The first ``k`` rows per key in ``order``, numbered from 1 in ``output``.

    Beyond the size that Spark trims by itself, each key is first trimmed in parts by a hash of the order columns.
    """
    if k > _TRIMMED:
        part = F.pmod(F.xxhash64(*order), F.lit(_PARTS))
        df = df.withColumn(output, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))).filter(F.col(output) <= k).drop(output)
    return df.withColumn(output, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(output) <= k)
