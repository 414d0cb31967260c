"""Sums of arrays that each task fills while it reads its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

# Numbers that travel in one row.
BLOCK = 16_384


def summed(rows: DataFrame, add_up: Callable[[Iterator[pa.RecordBatch]], Mapping[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums over all tasks of what ``add_up`` makes of a task's rows: one flat array of the same length for each part it met.

    Arrays travel in blocks, which are added in a shuffle; the driver sees one array per part, whatever the number of rows or tasks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat in add_up(batches).items():
            for block, a in enumerate(range(0, len(flat), BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([flat[a : a + BLOCK]], pa.list_(pa.float64()))], ["part", "block", "v"])

    partial = rows.mapInArrow(task, "part int, block int, v array<double>").select("part", "block", array_to_vector("v").alias("v"))
    blocks: dict[int, dict[int, np.ndarray]] = {}
    for row in partial.groupBy("part", "block").agg(Summarizer.sum(F.col("v")).alias("v")).collect():
        blocks.setdefault(row["part"], {})[row["block"]] = row["v"].toArray()
    return {part: np.concatenate([held[b] for b in sorted(held)]) for part, held in blocks.items()}
