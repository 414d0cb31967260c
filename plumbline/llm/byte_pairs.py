"""Byte-level byte-pair encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last one of that prefix's encoding. The table of
these tokens is filled from left to right: a token that ends a prefix is its last one when the prefix before
it ends with a token that keeps its border with the new one. Walking back through the table gives the encoding.
Appending bytes only adds entries, and after an edit only entries near it change.

Texts: null counts as empty; an empty text has no ids. A text is split by a pattern and each match is encoded
by itself. Nothing depends on other rows: repeated rows give repeated results, an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from plumbline.llm.common import body, free, once, pieces_of

# Entries that a task's memory of pieces and of token borders may hold before it starts anew.
KEPT_PIECES = 150_000
KEPT_BORDERS = 250_000
NEVER = 1 << 62


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with one base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PrefixTable:
    """The last token of every prefix of some bytes; grows by ``append`` and is mended near a ``replace``."""

    def __init__(self, codec: "Codec", data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [None]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last[end] = self.codec.last_token(self.data, self.last, end)

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` in place of ``self.data[start:stop]``; returns how many entries were computed."""
        old, tail = self.last, stop
        shift = len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = self.last[: start + 1] + [None] * (len(self.data) - start)
        same = done = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last[end] = self.codec.last_token(self.data, self.last, end)
            done += 1
            # An entry depends on the bytes and entries of one longest token before it and no further.
            same = same + 1 if end - shift > tail and self.last[end] == old[end - shift] else 0
            if same >= self.codec.longest:
                self.last[end + 1 :] = old[end - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        return self.codec.walk_back(self.last)


class Codec:
    """Encodes and decodes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.edges: dict[int, tuple | None] = {}
        self.borders: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        # Every pair of tokens whose bytes together are a token, with the rank of that token.
        self.joint = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        }
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        self.suffixes = automaton.iter

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, None for one byte; False when merging never makes it."""
        parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
        if len(parts) == 1:
            return None
        while len(parts) > 2:
            found = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER) for a, b in zip(parts, parts[1:])]
            rank = min(found)
            if rank == NEVER:
                return False
            at = found.index(rank)
            parts[at : at + 2] = [rank]
        return tuple(parts)

    def edge(self, token: int) -> tuple | None:
        """Tokens on the left and right rim of ``token``'s merge tree, each with the rank that ends it; None if unreachable."""
        known = self.edges.get(token, 0)
        if known != 0:
            return known
        halves = self._halves(token)
        if halves is False:
            rim = None
        elif halves is None:
            rim = (((token, NEVER),), ((token, NEVER),))
        else:
            first, second = self.edge(halves[0]), self.edge(halves[1])
            if first is None or second is None:
                rim = None
            else:
                ended = lambda nodes: tuple((t, token if end == NEVER else end) for t, end in nodes)
                rim = (((token, NEVER), *ended(first[0])), ((token, NEVER), *ended(second[1])))
        self.edges[token] = rim
        return rim

    def border_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both together never joins bytes across their border.

        A node of the left token's right rim and one of the right token's left rim merge when their joint
        token comes before either is taken up by its own tree; of equal ranks the left place goes first.
        """
        key = (left, right)
        known = self.borders.get(key)
        if known is None:
            known = self._compare(left, right)
            if len(self.borders) >= KEPT_BORDERS:
                self.borders.clear()
            self.borders[key] = known
        return known

    def _compare(self, left: int, right: int) -> bool:
        one, other = self.edge(left), self.edge(right)
        if one is None or other is None:
            return False
        get = self.joint.get
        for a, end_a in one[1]:
            for b, end_b in other[0]:
                rank = get(a << 32 | b)
                if rank is not None and rank < end_a and rank <= end_b:
                    return False
        return True

    def last_token(self, data: bytes, last: list, end: int) -> int | None:
        get, borders = self.ranks.get, self.borders
        for start in range(max(0, end - self.longest), end):
            token = get(data[start:end])
            if token is None:
                continue
            if start == 0:
                if self.edge(token) is not None:
                    return token
            elif (before := last[start]) is not None:
                holds = borders.get((before, token))
                if self.border_holds(before, token) if holds is None else holds:
                    return token
        return None

    def walk_back(self, last: list) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern: a single token when there is one, else what the prefix table says.

        The tokens that end each prefix come from one automaton over the vocabulary instead of from slices.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        borders, last, done = self.borders, [None] * (len(data) + 1), 0
        for at, (token, size) in self.suffixes(data.decode("latin-1")):
            if at < done:
                continue  # the one last token of this prefix is found
            if at + 1 == size:
                if self.edge(token) is None:
                    continue
            else:
                before = last[at + 1 - size]
                if before is None:
                    continue
                holds = borders.get((before, token))
                if not (self.border_holds(before, token) if holds is None else holds):
                    continue
            last[at + 1] = token
            done = at + 1
        return self.walk_back(last)

    def encode(self, text: str) -> list[int]:
        known = self.pieces
        return [i for piece in self.find(text) for i in known[piece]]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Encoded pieces, filled on demand. When full, what was not used since the last time is let go; long pieces are not kept."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.codec.encode_piece(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def codec_of(data: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, made once in each worker process so that later tasks find its pieces."""
    return once(("codec", hash(data), pattern), lambda: Codec(load_ranks(data), pattern))


class BytePairs:
    """Encoding and decoding columns by one vocabulary file and one splitting pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = spark.sparkContext.broadcast(file.read())  # one vocabulary, its size does not follow the data
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        """An array of ids for each text; an empty one for empty or null text."""
        ranks, pattern = self.ranks, self.pattern

        @arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = codec_of(ranks.value, pattern)
            for texts in batches:
                counts = np.zeros(len(texts) + 1, dtype=np.int32)
                flat = []
                for i, text in enumerate(texts):
                    ids = np.array(codec.encode(text.as_py() or ""), dtype=np.int32)
                    counts[i + 1] = len(ids)
                    flat.append(ids)
                values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(values))

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of each array of ids; empty for null."""
        ranks = self.ranks

        @arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = load_ranks(ranks.value)
            by_id = [b""] * (max(tokens.values()) + 1)
            for token, rank in tokens.items():
                by_id[rank] = token
            for lists in batches:
                yield pa.array([b"".join(map(by_id.__getitem__, (x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []))) for x in lists], pa.binary())

        return decode(ids)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    return docs.withColumn(ids, BytePairs(docs.sparkSession, path, pattern).encode(body(text)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``ids`` and the ``decoded`` bytes made from them, in one pass over slices of bounded size."""
    ranks = BytePairs(docs.sparkSession, path, pattern).ranks
    others = [f for f in docs.schema if f.name not in (text, "ids", "decoded")]
    name = free(docs, "_text")
    given = docs.select(*[F.col(f"`{f.name}`") for f in others], body(text).alias(name))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern)
        for batch in (part for whole in batches for part in pieces_of(whole, name, 2 << 20)):
            lists, decoded = [], []
            for value in batch.column(len(others)):
                ids = codec.encode(value.as_py())
                lists.append(np.array(ids, dtype=np.int32))
                decoded.append(codec.decode(ids))
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], column, pa.array(decoded, pa.binary())], [*batch.schema.names[: len(others)], "ids", "decoded"])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["ids array<int>", "decoded binary"]
    return given.mapInArrow(both, ", ".join(shape))
