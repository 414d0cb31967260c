"""Pack documents into token sequences by vector best fit over the histogram of piece lengths.

A piece needs room in three ways: tokens, one document, and attention cost (its length squared). All three
follow from its length, so pieces of one length are alike and the choice of sequences is made for lengths, not for
pieces: a summary with at most one row per length. Lengths go from long to short; each takes the open sequences, in runs of
like ones, whose residual room suits it best among those that meet every constraint. Pieces are numbered within
their length without gathering a length in one task, and a piece's number finds its run by a join.

Null texts are empty; an empty text is the end mark alone. Repeated rows are packed as often as they occur.
An empty table gives no rows. A document longer than a sequence is cut so that only its first piece is shorter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.byte_pairs import load_ranks
from plumbline.llm.common import BROADCAST_KEYS, body, numbered, once, pieces_of
from plumbline.session import materialise


@dataclass(frozen=True)
class Room:
    """What a sequence may hold, how residual room is weighed, and by which rule a run is chosen."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    choose: str = "norm"  # smallest residual norm, or "dot": largest weighted dot product of need and room

    def __post_init__(self):
        if self.choose not in ("norm", "dot"):
            raise ValueError("choose is norm or dot")
        if self.tokens**2 > self.cost or self.documents < 1:
            raise ValueError("a piece as long as a sequence has to fit")


def plan(counts: dict[int, int], room: Room) -> np.ndarray:
    """Runs ``(length, first number, pieces, first sequence, offset)`` that place ``counts[length]`` pieces of each length."""
    most = np.array([room.tokens, room.documents, room.cost], dtype=np.float64)
    weights = np.array(room.weights)
    left = np.zeros((1024, 3))  # residual room of each run of like sequences
    first, held = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    used = sequences = 0
    runs: list[tuple[int, int, int, int, int]] = []

    def add(residual, start, count):
        nonlocal left, first, held, used
        if used == len(held):
            open_ = held[:used] > 0
            n = int(open_.sum())
            left[:n], first[:n], held[:n] = left[:used][open_], first[:used][open_], held[:used][open_]
            used = n
            if n > len(held) // 2:
                left, first, held = np.vstack([left, np.zeros_like(left)]), np.append(first, np.zeros_like(first)), np.append(held, np.zeros_like(held))
        left[used], first[used], held[used] = residual, start, count
        used += 1

    shortest = min((n for n, c in counts.items() if c), default=0)
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        need = np.array([length, 1, length * length], dtype=np.float64)
        todo, number = counts[length], 0
        while todo:
            fits = (held[:used] > 0) & (left[:used] >= need).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                rest = left[at] - need
                score = ((rest / most) ** 2) @ weights if room.choose == "norm" else -((left[at] / most) * (need / most)) @ weights
                at = int(at[np.argmin(score)])
                residual, start, available = left[at].copy(), int(first[at]), int(held[at])
                fresh = False
            else:
                residual, start, available, fresh = most.copy(), sequences, todo, True
            each = int((residual // need).min())  # as long as it fits, the same sequence stays the best
            count = min(available, todo // each) if todo >= each else 1
            each = min(each, todo)
            for _ in range(each):
                runs.append((length, number, count, start, int(most[0] - residual[0])))
                residual = residual - need
                number += count
            todo -= each * count
            if fresh:
                sequences += count
            else:
                first[at], held[at] = start + count, available - count
            if residual[0] >= shortest and residual[1] >= 1:
                add(residual, start, count)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def special_tokens(path: str) -> dict[str, int]:
    """Special tokens and their ids in a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoded_pieces(docs: DataFrame, vocabulary: str, pattern: str, end: int = 0, tokens: int = 2048, key: str = "doc_id", text: str = "text", keep_ids: bool = False, special: Mapping[str, int] | None = None) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32`` and, on request, its ``ids``.

    ``vocabulary`` is a file of ranks; ``special`` holds the ids of special tokens, which a text is parted at first. Without it their text is ordinary text.
    """
    special = dict(special or {})
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        data = ranks.value
        encoder = once(("tiktoken", hash(data), pattern, str(special)), lambda: tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(data), special_tokens=special))
        for batch in (part for whole in batches for part in pieces_of(whole, "_text")):
            columns = [[], [], [], [], [], []]
            for name, words in zip(batch.column(0), batch.column(1)):
                ids = np.append(encoder.encode_to_numpy(words.as_py(), allowed_special="all", disallowed_special=()), end).astype("<u4")
                starts = [0, *range(len(ids) % tokens or tokens, len(ids), tokens), len(ids)]
                for piece, (a, b) in enumerate(zip(starts, starts[1:])):
                    row = (name, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if keep_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
            arrays = [pa.array([x.as_py() for x in columns[0]], batch.schema.field(0).type), pa.array(columns[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in columns[2:5]]
            names = ["_key", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(columns[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[key].dataType.simpleString()
    shape = f"_key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(key).alias("_key"), body(text).alias("_text")).mapInArrow(cut, shape).withColumnRenamed("_key", key)


def pack(pieces: DataFrame, room: Room = Room(), key: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pieces")  # texts are encoded once
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row per length, at most room.tokens
    runs = plan({r["length"]: r["n"] for r in sizes}, room)
    names = ["_length", "_from", "_count", "_sequence", "_offset"]
    table = spark.createDataFrame(pa.table({n: runs[:, i] for i, n in enumerate(names)}), ", ".join(f"{n} long" for n in names))
    if len(runs) <= BROADCAST_KEYS:
        table = F.broadcast(table)
    ranked = numbered(pieces, "length", [key, "piece", "ids_crc32"], "_rank")
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_count"))
    placed = ranked.join(table, inside)
    return placed.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))
