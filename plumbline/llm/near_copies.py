"""Near copies by MinHash with tensored bands, every candidate verified on full shingle sets.

Two small collections of band hashes are made per document; a table key joins one hash of each collection. ``m`` plus
``m`` bands give ``m * m`` tables, so hash work grows with the square root of the tables.

Documents with equal shingle sets are one class, and classes take part once. In each bucket every class is compared with the
bucket's smallest one only, never with all others. A bucket whose members are not all linked after that is not
given up: its classes are compared by an exact join on their rarest shingles (two sets over the limit must share
one of them), between groups that are not linked yet.

Words are runs of bytes other than space and ``\\x09-\\x0D`` after lower-casing A-Z. A text with fewer words than a shingle
is one shingle; null, empty and blank texts have none and are linked with nothing. An empty table gives no rows.

``near_copies`` judges ids: rows that repeat an id share its component, a null id is left out of links and is its own component.
``without_near_copies`` removes rows and links them by a number of their own, whatever ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import body, give_back, narrow, pieces_of, with_rows, without
from plumbline.session import materialise

BANDS = 9  # hashes in each of the two collections; their square is the number of tables
ROWS = 2  # minhashes in a band, so a key holds twice as many
SLOTS = 1 << 18  # counters that order shingles by rarity; a fixed size
CELL = 16  # rows of a shingle that are compared with each other before the exact join
TURNS = 12  # of cells at most; the exact join finds whatever they leave
KEPT_WORDS = 200_000
_BITS = [f"_s{i}" for i in range(8)]  # 64 parities of hashed shingles each


class _Words(dict):
    """64-bit hashes of words, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_PLACES = np.random.default_rng(11).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, known: _Words, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total += hashes[i : len(words) - width + 1 + i] * _PLACES[i]
    return np.unique(_mixed(total + np.uint64(width)))


def _signatures(size: int, bands: int, rows: int):
    drawn = np.random.default_rng(7)
    count = 2 * bands * rows
    times = drawn.integers(1 << 62, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = drawn.integers(1 << 62, size=count, dtype=np.uint64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in (part for whole in batches for part in pieces_of(whole, "_text", 4 << 20)):
            counts, prints, others, bands_of = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), known, size)
                counts.append(len(shingles))
                if not len(shingles):
                    prints.append(0), others.append(0), bands_of.append(None)
                    continue
                # The set is known by its size and two sums of independent hashes of its members.
                prints.append(int(shingles.sum().astype(np.int64)))
                others.append(int(_mixed(shingles + np.uint64(5)).sum().astype(np.int64)))
                least = np.array([((shingles * a + b) >> np.uint64(1)).min() for a, b in zip(times, plus)], dtype=np.uint64)
                joint = (least.reshape(2 * bands, rows) * _PLACES[:rows]).sum(axis=1, dtype=np.uint64)
                bands_of.append(_mixed(joint + np.arange(2 * bands, dtype=np.uint64)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.int64()), pa.array(others, pa.int64()), pa.array(bands_of, pa.list_(pa.int64()))],
                ["_id", "_n", "_p", "_o", "_bands"],
            )
        known.clear()
        give_back()

    return signed


def _sets(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in (part for whole in batches for part in pieces_of(whole, "_text", 4 << 20)):
            sets = [shingle_set(text.as_py(), known, size).astype(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_set"])
            del sets
        known.clear()
        give_back()

    return made


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (``a``, ``b``); the component is its smallest node.

    Large and small stars in turn: each round hangs a node's larger neighbours, then its smaller ones, on the smallest.
    A hub's minimum is combined before the shuffle and its edges are joined, not gathered.
    """
    edges = materialise(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "links")
    while True:
        # Large star: all larger neighbours of a node go to the smallest of its neighbourhood.
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of those.
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(least, F.col("hi") == F.col("u"))
        pairs = joined.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
        nxt = materialise(pairs.filter("lo < hi").distinct(), "links")
        state = nxt.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("leaves"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("sum")).first()
        before = edges.agg(F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")).alias("sum")).first()
        edges = nxt
        if state["n"] == 0 or (state["n"] == state["leaves"] and state["sum"] == before["sum"]):
            break
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets overlap by at least ``percent`` of their union."""
    one, other = sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.size("_sa") + F.size("_sb") - both
    return pairs.join(one, "a").join(other, "b").filter(both * 100 >= union * percent).select("a", "b")


def _fits(percent: int) -> Column:
    """What two rows ``a`` and ``b`` of one shingle must meet for their sets to be linked yet; each pair in one order only."""
    ordered = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("_ida") < F.col("_idb")))
    sizes = (F.col("_nb") <= F.col("_mosta")) & (F.col("_na") <= F.col("_mostb")) & (F.col("_na") * 100 >= F.col("_nb") * percent)
    # Every bit in which the parities differ stands for at least one shingle that only one of the sets has.
    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in _BITS), F.lit(0)) * (100 + percent)
    return ordered & sizes & (F.col("_la") != F.col("_lb")) & (apart <= (F.col("_na") + F.col("_nb")) * (100 - percent))


def _named(end: str) -> list[Column]:
    return [F.col(c).alias(c + end) for c in ("_id", "_n", "_most", "_l", *_BITS)]


def _pair() -> list[Column]:
    return [F.least("_ida", "_idb").alias("a"), F.greatest("_ida", "_idb").alias("b")]


def _rare_tokens(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """For each set its label and the shingles that come first in a global order of rarity, one of which it shares with whatever it can be linked with.

    If the first common shingle of two sets stands after ``p`` others of a set of ``n``, they share at most ``n - p``. That bounds the size of
    a partner, so a shingle is only a reason to meet for partners up to that size, ``_most``. Parities of hashed
    shingles bound from below how much two sets differ, so pairs that differ too much are never made.
    """
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(SLOTS))
    counted = sets.select(F.explode("_set").alias("_t")).groupBy(slot("_t").alias("_slot")).agg(F.count("*").alias("_n"))
    rows = counted.toArrow()  # at most SLOTS counters, whatever the input
    counters = np.zeros(SLOTS, dtype=np.int64)
    counters[rows["_slot"].to_numpy()] = rows["_n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counters)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        names = ["_id", "_t", "_n", "_most", *_BITS]
        for batch in batches:
            out = [[] for _ in names]
            slots = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            at = 0
            for name, found in zip(batch.column(0), batch.column(1)):
                own = np.array(found.values, dtype=np.int64)
                n = len(own)
                rare = counts[slots[at : at + n]]
                at += n
                need = n - -(-n * percent // 100) + 1
                kept = own[np.lexsort((own, rare))[:need]]
                most = (n - np.arange(len(kept))) * (100 + percent) // percent - n
                odd = np.packbits(np.bincount(own & (64 * len(_BITS) - 1), minlength=64 * len(_BITS)) & 1).view(np.int64)
                same = lambda value: np.full(len(kept), value)
                for column, values in zip(out, (same(name.as_py()), kept, same(n), most, *map(same, odd))):
                    column.append(values.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names)

    shape = ", ".join(f"{c} long" for c in ["_id", "_t", "_n", "_most", *_BITS])
    tokens = sets.select("_id", "_set", F.transform("_set", lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS))).alias("_slots")).mapInArrow(rarest, shape)
    return materialise(tokens.join(label, "_id", "left").withColumn("_l", F.coalesce("_l", "_id")), "tokens")


def _under_labels(tokens: DataFrame) -> DataFrame:
    """``tokens`` of the shingles under two labels, with the number of the shingle's rows and its label with most rows."""
    held = tokens.groupBy("_t", "_l").agg(F.count("*").alias("_c"))
    main = F.max_by("_l", F.struct("_c", "_l")).alias("_main")
    mixed = held.groupBy("_t").agg(F.count("*").alias("_labels"), F.sum("_c").alias("_held"), main).filter("_labels > 1")
    return materialise(tokens.join(mixed.drop("_labels"), "_t"), "mixed")


def _pairs_in_cells(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs within random cells of about ``CELL`` rows of a shingle, and for how many rows of the join of whole shingles each stands.

    A row makes a bounded number of pairs however many share its shingle. Shingles of one cell are left to the join of whole shingles.
    """
    dealt = mixed.filter(F.col("_held") > CELL).withColumn("_cells", F.ceil(F.col("_held") / CELL))
    dealt = dealt.withColumn("_cell", F.pmod(F.xxhash64("_id", "_t", F.lit(turn)), F.col("_cells")))
    one, other = dealt.select("_t", "_cell", "_cells", *_named("a")), dealt.select(F.col("_t").alias("_tb"), F.col("_cell").alias("_cellb"), *_named("b"))
    found = one.join(other, (F.col("_t") == F.col("_tb")) & (F.col("_cell") == F.col("_cellb")) & _fits(percent))
    return found.select(*_pair(), "_cells").groupBy("a", "b").agg(F.sum("_cells").alias("_rows"))


def _all_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs of differently labelled rows of a shingle that can still be linked.

    The smaller set of a pair must have the shingle early in its order, and the larger one seeks it among sets of the sizes that its own place
    allows. The label with most rows is not paired with itself.
    """
    octave = lambda n: F.floor(F.log2(n) * 8).cast("int")
    least = F.ceil(F.col("_n") * percent / 100)
    largest = F.least("_n", "_most")
    is_main = (F.col("_l") == F.col("_main")).alias("_is_main")
    small = mixed.filter("_most >= _n").select("_t", octave(F.col("_n")).alias("_o"), *_named("a"), is_main)
    large = mixed.filter(largest >= least).select("_t", F.explode(F.sequence(octave(least), octave(largest))).alias("_o"), *_named("b"), is_main)

    def meet(one: DataFrame, other: DataFrame) -> DataFrame:
        one, other = one.drop("_is_main").withColumnsRenamed({"_t": "_ta", "_o": "_oa"}), other.drop("_is_main")
        return one.join(other, (F.col("_ta") == F.col("_t")) & (F.col("_oa") == F.col("_o")) & _fits(percent)).select(*_pair())

    met = meet(small.filter("NOT _is_main"), large).unionByName(meet(small.filter("_is_main"), large.filter("NOT _is_main")))
    return met.distinct()


def _rare_pairs(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of differently labelled classes that can still be linked: none that is linked is missing."""
    return _all_pairs(_under_labels(_rare_tokens(sets, label, percent)), percent)


def _merged(label: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``_l, _to`` for the labels that change by the links among the written ``pairs``; nothing when none does."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    links = _verified(pairs.select("a", "b"), sets.join(narrow(ends, ["_id"]), "_id", "left_semi"), percent)
    of = lambda end: label.select(F.col("_id").alias(end), F.col("_l").alias("_l" + end))
    links = links.join(of("a"), "a").join(of("b"), "b").select(F.col("_la").alias("a"), F.col("_lb").alias("b"))
    links = materialise(links.filter("a <> b").distinct(), "between")
    if links.isEmpty():
        return None
    return narrow(components(links).filter("node <> component").toDF("_l", "_to"), ["_l", "_to"])


def _moved(rows: DataFrame, moves: DataFrame, column: str = "_l") -> DataFrame:
    return rows.join(moves.toDF(column, "_to"), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _finished(label: DataFrame, sets: DataFrame, open_sets: DataFrame, percent: int) -> DataFrame:
    """``label`` after all links among ``open_sets``.

    Of a large group that is linked in the end, an exact join would make every pair whose labels still differ. So labels are merged first,
    in turns of random cells, until the join of whole shingles is expected to make no more rows than it reads; it then finds what is left.
    """
    mixed = _under_labels(_rare_tokens(open_sets, label, percent))
    read = mixed.count()
    for turn in range(TURNS):
        pairs = materialise(_pairs_in_cells(mixed, turn, percent), "cells")
        expected = pairs.agg(F.sum("_rows")).first()[0] or 0
        moves = _merged(label, pairs, sets, percent) if expected else None
        if moves is None:
            break
        label = materialise(_moved(label, moves), "labels")
        mixed = materialise(_moved(_moved(mixed, moves), moves, "_main"), "mixed")
        if expected <= read:
            break
    moves = _merged(label, materialise(_all_pairs(mixed, percent), "rest"), sets, percent)
    return label if moves is None else _moved(label, moves)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row: links need ``percent`` overlap of shingle sets of ``size`` words."""
    given = docs.select(F.col(key).cast("long").alias("_id"), body(text).alias("_text"))
    signed = given.mapInArrow(_signatures(size, bands, rows), "_id long, _n long, _p long, _o long, _bands array<long>")
    signed = materialise(signed, "signed")
    classes = signed.filter("_n > 0 AND _id IS NOT NULL").groupBy("_n", "_p", "_o").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"))
    classes = materialise(classes, "classes")

    # Tables: a key per pair of one hash of each collection. Only keys that meet again are kept.
    left, right = F.slice("_bands", 1, bands), F.slice("_bands", bands + 1, bands)
    keys = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.xxhash64(x, y))))
    tables = classes.select("_rep", F.explode(keys).alias("_k"))
    firsts = tables.groupBy("_k").agg(F.min("_rep").alias("_first"), F.count("*").alias("_c")).filter("_c > 1")
    met = materialise(tables.join(firsts, "_k").select("_k", "_rep", "_first", "_c"), "met")

    pairs = materialise(met.filter("_rep <> _first").select(F.col("_first").alias("a"), F.col("_rep").alias("b")).distinct(), "pairs")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "ids")
    # An id may repeat, then its classes do; the sets of an id that stands for a class are told apart by their size and sums.
    sets = given.join(narrow(ids, ["_id"]), "_id", "left_semi").mapInArrow(_sets(size), "_id long, _set array<long>")
    sets = materialise(sets, "sets")
    links = materialise(_verified(pairs, sets, percent), "verified")
    label = components(links).select(F.col("node").alias("_id"), F.col("component").alias("_l"))
    label = materialise(ids.join(label, "_id", "left").select("_id", F.coalesce("_l", "_id").alias("_l")), "labels")

    # Buckets of three and more whose members are not all in one component: the pairs not yet compared.
    told = met.filter("_c > 2").select("_k", F.col("_rep").alias("_id")).join(label, "_id")
    mixed = told.groupBy("_k").agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi")).filter("_lo <> _hi").select("_k")
    open_ids = materialise(told.join(mixed, "_k").select("_id").distinct(), "open")
    rest = sets.join(narrow(open_ids, ["_id"]), "_id", "left_semi")
    label = _finished(label, sets, rest, percent)

    placed = classes.join(label, F.col("_rep") == F.col("_id"), "left").select("_n", "_p", "_o", F.coalesce("_l", "_rep").alias("_component"))
    same = (signed["_n"] == placed["_n"]) & (signed["_p"] == placed["_p"]) & (signed["_o"] == placed["_o"]) & (signed["_n"] > 0)
    out = signed.join(placed, same, "left").select(signed["_id"], signed["_n"], F.coalesce("_component", signed["_id"]).alias("_component"))
    return out.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the one with the smallest id, null ids last, of equal ids any one."""
    rows, row = with_rows(docs)
    judged = near_copies(rows, row, text, **options).select(F.col(row).alias("_at"), "component_id", "kept")
    judged = materialise(judged.join(rows.select(F.col(row).alias("_row"), F.col(key).alias("_id")), F.col("_at") == F.col("_row")), "judged")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")
    stay = judged.groupBy("component_id").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    stay = materialise(stay.select("component_id", F.col("_first._row").alias("_stays")), "stay")
    # Without a join by component, which may hold many rows: all members but the roots, then the roots, less those that stay.
    members = judged.filter("NOT kept").select("_row").unionByName(stay.select(F.col("component_id").alias("_row")))
    gone = materialise(members.join(stay.select("_stays"), F.col("_row") == F.col("_stays"), "left_anti"), "gone")
    return without(rows, gone, row).select(*docs.columns)
