"""Shards by a weighted hash tree: region, rack and shard are drawn one after the other by hash.

At each level a row's draw for a child is ``-ln(u) / weight`` with ``u`` from a hash of the row's key and the
child's name; the smallest draw wins. A child whose weight grows only takes rows, one whose weight shrinks only
gives them, and all other subtrees keep theirs: rows move only into or out of subtrees whose weights change.

A null key is drawn like any other value (one shard for all of them). Null texts have no bytes. Repeated rows get the same shard
and slots of their own. An empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import numbered

_DIGITS = 13  # hex digits of a hash that a double holds exactly


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> list[Shard]:
    """Equal shards, numbered from 0, in equal racks of equal regions."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return [Shard(f"r{r}", f"r{r}k{k}", n) for n, (r, k) in enumerate(places)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard, in a region of its own: only the new region's weight changes, so rows move only there."""
    n = len(tree)
    return [*tree, Shard(f"r+{n}", f"r+{n}k0", n, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(name)).cast("binary")), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(16**_DIGITS))
    return -F.ln(u) / F.lit(weight)


def _smallest(draws: list[tuple[Column, Column]]) -> Column:
    """The value with the smallest draw; the first of equal ones."""
    if len(draws) == 1:
        return draws[0][1]
    rows = [F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(draws)]
    return F.least(*rows)["v"]


def tree_shard(key: Column, tree: list[Shard]) -> Column:
    """The shard number of each key."""
    by_region: dict[str, dict[str, list[Shard]]] = {}
    for shard in tree:
        by_region.setdefault(shard.region, {}).setdefault(shard.rack, []).append(shard)
    weigh = lambda shards: sum(s.weight for s in shards)
    regions = []
    for region, racks in by_region.items():
        inside = []
        for rack, shards in racks.items():
            leaves = [(_draw(key, f"shard {s.number}", s.weight), F.lit(s.number)) for s in shards]
            inside.append((_draw(key, rack, weigh(shards)), _smallest(leaves)))
        total = weigh([s for shards in racks.values() for s in shards])
        regions.append((_draw(key, region, total), _smallest(inside)))
    return _smallest(regions)


def shard_rows(docs: DataFrame, tree: list[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``; other columns but the text are kept."""
    placed = docs.select(
        *[F.col(c) for c in docs.columns if c != text and c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(F.col(key), tree).cast("int").alias("shard"),
        tree_shard(F.col(key), grown(tree)).cast("int").alias("grown_shard"),
    )
    return numbered(placed, "shard", [key, "text_crc32"], "slot")
