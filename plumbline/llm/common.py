"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import materialise

# A table is broadcast only after it was counted and found to stay within this many rows of a few numbers each.
BROADCAST_KEYS = 1_000_000


def once(key, make):
    """What ``make`` returned the first time it was called for ``key`` in this process; for bounded helpers of tasks."""
    held = sys.modules.setdefault("_made_once", types.ModuleType("_made_once")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Hands memory that a task has freed back to the system: workers wait beside the shuffles and joins of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def body(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written once so that it stays the same, and that column's name."""
    row = free(docs, "_row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is not among the ids of ``gone``, a narrow table with one column."""
    name = free(docs, "_gone")
    gone = gone.toDF(name).filter(F.col(name).isNotNull()).distinct()
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, F.col(key) == F.col(name), "left_anti")


def narrow(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` marked for broadcast when its counted rows stay within the bound, else as it is (a shuffled join)."""
    df = df.select(*keys)
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str, parts: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without bringing a group into one task.

    Rows of a group are dealt over ``parts`` hash cells; a row's number is its place in the cell plus the
    sizes of the group's earlier cells. Rows that are equal in ``order`` get adjacent numbers in any order.
    """
    cell, place, of, at, start = (free(df, n) for n in ("_cell", "_place", "_of", "_at", "_start"))
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(F.col(group).alias(of), F.col(cell).alias(at)).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(of, at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    placed = dealt.withColumn(place, F.row_number().over(Window.partitionBy(group, cell).orderBy(*order)))
    joined = placed.join(starts, (F.col(group) == F.col(of)) & (F.col(cell) == F.col(at)))
    return joined.withColumn(name, (F.col(start) + F.col(place) - 1).cast("long")).drop(cell, place, of, at, start)


def pieces_of(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Slices of a batch with about ``most_bytes`` of text each, so that a task's memory does not follow the batch size."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
