"""Stretches of words that repeat with a period, found by seeds on diagonals and extended.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(6, 4 q)`` words that no neighbouring word
extends. On the diagonal of lag ``q`` such a run matches itself over at least ``max(5, 3 q)`` words, so for the lags of one level,
``2**(j-1) < q <= 2**j``, grams of the level's smallest overlap are certain to occur in it twice. These grams are named exactly (a
gram's name is the pair of names of the two shorter grams that cover it) and only grams that occur again in the
same document are kept, for this level and the longer ones. A gram is at least as long as the level's lags: inside a run its next occurrence is
then exactly one smallest period away, so neighbouring occurrences are all the pairs there are to try, however often a gram occurs. Each
pair whose lag is of the level is a seed. A seed before the furthest place that its lag has covered is left out; the others are
extended in both directions, so no stretch of a diagonal is read twice.

Words are what ASCII white space parts. A null text has no words, nor has an empty one. Nothing depends on other rows: repeated rows give repeated
results, null keys are kept, an empty table gives none. A long text takes memory for its own length and about 50 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import body, pieces_of

LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 2 << 20
WHITE = b" \t\n\r\x0b\x0c"


class Numbers(dict):
    """Numbers things in the order they come."""

    def __missing__(self, thing):
        self[thing] = len(self)
        return self[thing]


def word_numbers(text: bytes, index: Numbers, at_once: int = 1 << 20) -> np.ndarray:
    """The numbers of a text's words; a long text is split part by part."""
    parts, start = [], 0
    while start < len(text):
        stop = min(start + at_once, len(text))
        while stop < len(text) and text[stop] not in WHITE:
            stop += 1
        parts.append(np.fromiter(map(index.__getitem__, text[start:stop].split()), dtype=np.int64))
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys`` and, for each place but the last of it, whether the next key is the same."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, ordered[1:] == ordered[:-1]


def _pairs(names: np.ndarray, gap: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose grams at the place and ``gap`` further both occur again, and a key for the two; the gram they cover has ``size`` words."""
    last = len(names) - size + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first, second = names[:last], names[gap : gap + last]
    places = np.flatnonzero((first >= 0) & (second >= 0))
    return places, first[places] * (len(names) + 1) + second[places]


def _named(n: int, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A name for every place whose key occurs again, -1 for all others."""
    names = np.full(n, -1, dtype=np.int64)
    if len(places):
        order, same = _again(keys)
        edge = np.zeros(len(order) + 1, dtype=bool)
        edge[1:-1] = same
        again = edge[1:] | edge[:-1]
        group = np.cumsum(~edge[:-1]) - 1
        names[places[order[again]]] = group[again]
    return names


def _ahead(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on where ``words`` and ``words`` a lag further differ."""
    last, step = len(words) - lag, 16
    while at < last:
        stop = min(at + step, last)
        differ = np.flatnonzero(words[at:stop] != words[at + lag : stop + lag])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, min(2 * step, 1 << 16)
    return at


def _behind(words: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch that ends before ``at`` in which ``words`` and ``words`` a lag further agree."""
    step = 16
    while at > 0:
        start = max(at - step, 0)
        differ = np.flatnonzero(words[start:at] != words[start + lag : at + lag])
        if len(differ):
            return start + int(differ[-1]) + 1
        at, step = start, min(2 * step, 1 << 16)
    return at


def find_runs(words: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start and period, in the words of several documents one after the other.

    ``document`` holds the number of each word's document and never falls. No gram is found in two documents: equal words of different
    documents count as different, and one that reaches over a border occurs once.
    """
    n = len(words)
    words = document * (int(words.max()) + 1) + words if n else words
    longest = int(np.bincount(document).max()) if n else 0
    names = _named(n, np.arange(n), words)
    held, found, level = 1, [], 0
    while LEAST_PERIODS * (lag := 1 if level == 0 else 2 ** (level - 1) + 1) <= longest:
        size = max(LEAST_WORDS - 1, (LEAST_PERIODS - 1) * lag)
        while 2 * held <= size:
            names = _named(n, *_pairs(names, held, 2 * held))
            held *= 2
        places, keys = _pairs(names, size - held, size)
        order, same = _again(keys)
        if not same.any():
            break  # longer grams hold these
        first, second = places[order[:-1][same]], places[order[1:][same]]
        fits = (second - first >= lag) & (second - first <= 2**level)
        found += _extended(words, first[fits], (second - first)[fits], size)
        level += 1
    runs = np.array(found, dtype=np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(words: np.ndarray, places: np.ndarray, lags: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    # Seeds side by side on one diagonal are one stretch: the first of them is extended.
    head = np.ones(len(places), dtype=bool)
    head[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
    ends = np.flatnonzero(np.append(head[1:], True)) if len(places) else head
    covered: dict[int, int] = {}
    runs = []
    for place, lag, last in zip(places[head].tolist(), lags[head].tolist(), places[ends].tolist()):
        if place < covered.get(lag, 0):
            continue
        start, stop = _behind(words, place, lag), _ahead(words, last + size, lag)
        covered[lag] = stop
        length = stop + lag - start
        if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
            runs.append((start, length, lag))
    return runs


def _joined(kept: np.ndarray, spelled: list[bytes], at_once: int = 1 << 17) -> bytes:
    return b" ".join(b" ".join(map(spelled.__getitem__, kept[a : a + at_once].tolist())) for a in range(0, len(kept), at_once))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_words``, its ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text without the words that a run holds after its first period, one space between words.
    """
    given = docs.select(F.col(key).alias("_key"), body(text).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces_of(whole, "_text", SLICE_BYTES)):
            index = Numbers()
            parts = [word_numbers(value.as_buffer().to_pybytes(), index) for value in batch.column(1)]
            ends = np.cumsum([0, *map(len, parts)])
            words = np.concatenate(parts)
            document = np.repeat(np.arange(len(parts)), np.diff(ends))
            runs = find_runs(words, document)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            keep = np.cumsum(change)[:-1] == 0
            spelled = list(index)
            collapsed = [_joined(words[a:b][keep[a:b]], spelled) for a, b in zip(ends, ends[1:])]
            owner = document[runs[:, 0]]
            counts = np.bincount(owner, minlength=len(parts))
            whole = lambda values: pa.array(values, pa.int64())
            struct = pa.StructArray.from_arrays([whole(runs[:, 0] - ends[owner]), whole(runs[:, 1]), whole(runs[:, 2])], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
            columns = [batch.column(0), whole(np.diff(ends)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    shape = f"_key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return given.mapInArrow(scan, shape).withColumnRenamed("_key", key)
