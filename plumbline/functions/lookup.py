"""Attach a small-or-large lookup table to a fact table without trusting its size or its keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.roles import quoted
from plumbline.session import materialise

# A lookup is broadcast only when it was seen to stay within both bounds.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
# A key is hot when it holds more than this share of the rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1e-4


def bounded_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` as a local relation when it fits the bounds, else None."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > max_bytes:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    weight: str,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join of ``lookup`` (one row per key, ``weight`` = number of fact rows) onto ``facts``.

    A lookup within the bounds is broadcast, so the facts are not shuffled. A larger one is joined
    by shuffle after its hot keys, few by definition, were split off and broadcast: no shuffle
    partition can then hold a hot key.
    """
    keys = list(keys)
    small = bounded_copy(lookup, max_rows)
    if small is not None:
        return facts.join(F.broadcast(small.drop(weight)), keys, "left")

    lookup = materialise(lookup, "lookup")  # read several times from here on
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > max(1, int(total * HOT_SHARE))
    hot = bounded_copy(lookup.filter(is_hot), int(1 / HOT_SHARE) + 1)
    # NULL keys match nothing and would all meet in one partition of a join: they go around it.
    known = reduce(and_, [F.col(quoted(k)).isNotNull() for k in keys])
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name not in (*keys, weight)]
    unknown = facts.filter(~known).select("*", *added)
    facts = facts.filter(known)
    if hot is None:  # hot keys too long to send around: the join's large partitions are left to Spark to split
        return facts.join(lookup.drop(weight), keys, "left").unionByName(unknown)
    hot = hot.drop(weight)
    cold = lookup.filter(~is_hot).drop(weight)
    hot_rows = facts.join(F.broadcast(hot), keys, "inner")
    cold_rows = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return hot_rows.unionByName(cold_rows).unionByName(unknown)
