"""Byte-pair encoding of words by a minimal acyclic transducer over the corpus's frequent words.

The frequent words, counted over all rows, are compiled into an automaton that shares prefixes and suffixes. Every edge carries a
number, and the numbers along a word's path add up to the word's place, where its ids stand. The automaton is one file in the shared
folder that every executor fetches once and maps into memory; lost executors cost nothing but the fetch. Words are looked up side by side, one
byte of all of them at a time. A word that it does not hold is merged by the vocabulary's ranks, so the ids never depend on
which words are held.

Texts are parted as the vocabulary file says: its special tokens first, then canonical composition and lower case, then words, single
digits and strings of signs. Parts with combining marks, or with characters that this Python's tables do not know, are parted by the tokenizers
library's own tables.

Texts: null counts as empty; an empty one has no ids. Repeated rows give repeated results, null keys are kept, an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import body, once, pieces_of
from plumbline.llm.periodic_runs import Numbers
from plumbline.session import materialise, shared_folder

# Words the automaton holds at most, and bytes of the longest of them; all others are merged.
LEXICON_WORDS = 262_144
LEXICON_BYTES = 48
# Words whose counts a task holds before it hands them on.
COUNTED_AT_ONCE = 200_000
# Counts below two to this power are told apart when the least count of a frequent word is chosen.
COUNT_BITS = 12
SLICE_BYTES = 4 << 20
PART_LETTERS = 1 << 18
# Words of at most this many bytes are merged in a list, longer ones by a heap.
SHORT_WORD = 40
NEVER = (1 << 62, -1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Words, merges and special tokens of a vocabulary file with word ends."""

    def __init__(self, data: bytes):
        import regex

        self.data = data
        given = json.loads(data)
        model = given["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] is None or model["unk_token"] is not None:
            raise ValueError("needs a byte-pair model with word ends and without an unknown token")
        self.end = model["end_of_word_suffix"]
        self.id_of = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.id_of[a], self.id_of[b]): (rank, self.id_of[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.id_of[x] for x in letters]
        self.final = [self.id_of[x + self.end] for x in letters]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        spelled = {**{i: t for t, i in self.id_of.items()}, **{i: t for t, i in self.special.items()}}
        self.spelled = [spelled.get(i, "") for i in range(max(spelled) + 1)]
        split = next(p for p in given["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.part = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else lambda text: [text]
        self.space = regex.compile(r"[\x20\x09-\x0D]").search
        self.plain_letters: set[str] = set()
        self._library = None

    def words(self, text: str) -> Iterator[str | int]:
        """The words of a text in order, and the ids of its special tokens; a long text is taken part by part."""
        for segment in self.part(text):
            if segment in self.special:
                yield self.special[segment]
                continue
            start = 0
            while start < len(segment):
                stop = start + PART_LETTERS
                if stop < len(segment):
                    gap = self.space(segment, stop)
                    stop = gap.start() if gap else len(segment)
                yield from self._parted(segment[start:stop])
                start = stop

    def _parted(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        if not self._all_plain(text):
            return self._parted_by_library(text)
        # Letter by letter: no capital turns into a final form because of its neighbours.
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _all_plain(self, text: str) -> bool:
        """No letter that this Python's tables lack, no combining mark and no letter of the higher planes: there the library's tables, of another year, may order or compose otherwise."""
        new = set(text) - self.plain_letters
        other = {c for c in new if (kind := unicodedata.category(c)) == "Cn" or unicodedata.combining(c) or c > "\uffff" and kind[0] in "LM"}
        self.plain_letters |= new - other
        return not other

    def _parted_by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self._library is None:
            byte_of = {letter: b for b, letter in enumerate(byte_letters())}
            self._library = Tokenizer.from_buffer(self.data), byte_of
        library, byte_of = self._library
        parted = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        return [bytes(byte_of[x] for x in word).decode() for word, _ in parted]

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is joined first, of equal ranks the leftmost."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[b] for b in word[-1:]]
        return self._merged_in_place(ids) if len(ids) <= SHORT_WORD else self._merged_by_heap(ids)

    def _merged_in_place(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        pairs = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not NEVER:
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], best[1]), NEVER)
            if at < len(pairs):
                pairs[at] = get((best[1], ids[at + 1]), NEVER)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        merges, heap = self.merges, []
        for i in range(len(ids) - 1):
            pair = merges.get((ids[i], ids[i + 1]))
            if pair:
                heap.append((pair[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two was joined with another since
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0:
                    pair = merges.get((ids[a], ids[b]))
                    if pair:
                        heapq.heappush(heap, (pair[0], a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ids as the file spells them, one space between them: it names no decoder."""
        return " ".join(map(self.spelled.__getitem__, ids))


class Lexicon:
    """A minimal acyclic transducer from words to their ids, as arrays that can be mapped from a file."""

    ARRAYS = ("bits", "rank", "target", "added", "accepts", "starts", "ids", "longest")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def compile(words: Iterable[bytes], ids_of) -> "Lexicon":
        """From distinct words, in any order. States that accept the same endings are one: words come sorted, and a state is settled
        as soon as no later word can reach it, by the state that already has its edges."""
        words = sorted(words)
        settled: dict[tuple, int] = {}
        edges: list[tuple] = []
        sizes: list[int] = []  # words that a state accepts endings of

        def settle(accepts: bool, out: list) -> int:
            mark = (accepts, *out)
            state = settled.get(mark)
            if state is None:
                state = settled[mark] = len(edges)
                edges.append((accepts, out))
                sizes.append(accepts + sum(sizes[t] for _, t in out))
            return state

        path: list[list] = [[False, []]]  # states of the last word's path, with the edges they have so far
        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                accepts, out = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(accepts, out)))
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            accepts, out = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(accepts, out)))
        root = settle(*path[0])

        n = len(edges)
        bits, rank = np.zeros((n, 4), dtype=np.uint64), np.zeros((n, 4), dtype=np.uint32)
        target, added = [], []
        for state, (accepts, out) in enumerate(edges):
            counted, held = int(accepts), [0, 0, 0, 0]
            before = [0, 0, 0, 0]
            for at, (byte, to) in enumerate(out):
                held[byte >> 6] |= 1 << (byte & 63)
                for q in range((byte >> 6) + 1, 4):
                    before[q] = at + 1
                added.append(counted)
                target.append(to)
                counted += sizes[to]
            bits[state] = held
            rank[state] = [len(target) - len(out) + b for b in before]
        lists = [ids_of(word) for word in words]
        return Lexicon({
            "bits": bits, "rank": rank, "target": np.array(target, dtype=np.uint32), "added": np.array(added, dtype=np.uint32),
            "accepts": np.array([a for a, _ in edges], dtype=bool), "starts": np.cumsum([0, *map(len, lists)]).astype(np.uint32),
            "ids": np.array([i for ids in lists for i in ids], dtype=np.uint32), "longest": np.array([max(map(len, words), default=0), root], dtype=np.int64),
        })

    def to_bytes(self) -> bytes:
        """Every array after the other, each from a multiple of eight bytes on, after a head that says where."""
        head, blobs, at = {}, [], 0
        for name in self.ARRAYS:
            values = np.ascontiguousarray(getattr(self, name))
            blob = values.tobytes()
            blob += b"\0" * (-len(blob) % 8)
            head[name] = [values.dtype.str, values.shape, at]
            blobs.append(blob)
            at += len(blob)
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(blobs)

    @staticmethod
    def mapped(path: str) -> "Lexicon":
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(whole[:8].tobytes(), "little")
        head = json.loads(whole[8 : 8 + size].tobytes())
        arrays = {}
        for name, (kind, shape, at) in head.items():
            length = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays[name] = whole[8 + size + at : 8 + size + at + length].view(kind).reshape(shape)
        return Lexicon(arrays)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 for those the lexicon does not hold."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(length) - length
        longest, root = (int(x) for x in self.longest)
        state = np.full(len(words), root, dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        result = np.full(len(words), -1, dtype=np.int64)
        on = np.flatnonzero(length <= longest)
        for step in range(longest + 1):
            ends = on[length[on] == step]
            ends = ends[self.accepts[state[ends]]]
            result[ends] = number[ends]
            on = on[length[on] > step]
            if not len(on):
                break
            byte = data[start[on] + step]
            quarter, bit = byte >> 6, (byte & 63).astype(np.uint64)
            held = self.bits[state[on], quarter]
            there = (held >> bit) & np.uint64(1) == 1
            on, quarter, bit, held = on[there], quarter[there], bit[there], held[there]
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            edge = self.rank[state[on], quarter].astype(np.int64) + below
            number[on] += self.added[edge]
            state[on] = self.target[edge]
        return result


class Encoder:
    """Encodes texts by a vocabulary and a lexicon of its frequent words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's begin; the last entry is the end."""
        index, numbers = Numbers(), []
        for text in texts:
            numbers.append(np.array(array("I", map(index.__getitem__, self.vocabulary.words(text))), dtype=np.int64))
        words = [b"" if isinstance(w, int) else w.encode() for w in index]
        places = self.lexicon.places(words)
        held = places >= 0
        ids, begin, size = [self.lexicon.ids], np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        starts = self.lexicon.starts
        begin[held] = starts[places[held]]
        size[held] = starts[places[held] + 1].astype(np.int64) - starts[places[held]]
        more, at = array("I"), len(self.lexicon.ids)
        things = list(index)
        for i in np.flatnonzero(~held).tolist():
            made = [things[i]] if isinstance(things[i], int) else self.vocabulary.merged(words[i])
            begin[i], size[i] = at + len(more), len(made)
            more.extend(made)
        pool = np.concatenate([*ids, np.array(more, dtype=np.uint32)])
        flat = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        each = size[flat]
        ends = np.cumsum(each)
        taken = np.repeat(begin[flat] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
        borders = np.concatenate([[0], ends])[np.cumsum([0, *map(len, numbers)])]
        return pool[taken], borders


def _vocabulary(data: bytes) -> Vocabulary:
    return once(("words", hash(data)), lambda: Vocabulary(data))


def frequent_words(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """``word, n``: the most frequent words of all rows with their counts, ``most`` at most; words of equal counts come in or stay out together."""
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary, its size does not follow the data

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _vocabulary(data.value).words, Counter()

        def counted():
            kept = [(w.encode(), n) for w, n in counts.items() if isinstance(w, str)]
            kept = [(w, n) for w, n in kept if len(w) <= LEXICON_BYTES]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                counts.update(words(value.as_py()))
                if len(counts) >= COUNTED_AT_ONCE:
                    yield counted()
        yield counted()

    partial = docs.select(body(text).alias("_text")).mapInArrow(count, "word binary, n long")
    counted = materialise(partial.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Small counts have a class each, larger ones share one of a few thousand: where to cut is seen without sorting the words.
    fine = 1 << COUNT_BITS
    rank = F.when(F.col("n") < fine, F.col("n")).otherwise(fine + F.floor((F.log2(F.col("n").cast("double")) - COUNT_BITS) * 64))
    least, held = None, 0
    for row in sorted(counted.groupBy(rank.alias("c")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if held + row["words"] > most:
            break
        least, held = row["c"], held + row["words"]
    return counted.filter(rank >= least) if least is not None else counted.limit(0)


def shared_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Writes ``data`` to the shared folder and makes every executor fetch it on demand; returns the name to find it by."""
    name = f"plumbline-{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        for a in range(0, len(data), 1 << 20):
            out.write(bytearray(data[a : a + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def round_trip(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS, key: str = "doc_id", text: str = "text", packed: bool = False) -> DataFrame:
    """Per row: ``key``, its ``ids`` and the ``decoded`` text made from them.

    ``ids`` is an array, or with ``packed`` their unsigned 32-bit little-endian bytes. The driver sees at most ``most`` words of
    at most ``LEXICON_BYTES`` bytes each.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        content = file.read()
    words = frequent_words(docs, vocabulary, most, text).select("word").toArrow().column(0).to_pylist()
    name = shared_file(spark, Lexicon.compile(words, Vocabulary(content).merged).to_bytes(), "lexicon")
    data = spark.sparkContext.broadcast(content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(data.value)
        encoder = Encoder(words, Lexicon.mapped(SparkFiles.get(name)))
        for batch in (part for whole in batches for part in pieces_of(whole, "_text", SLICE_BYTES)):
            ids, borders = encoder.encode(value.as_py() for value in batch.column(1))
            if packed:
                made = [ids[a:b].astype("<u4").tobytes() for a, b in zip(borders, borders[1:])]
                column = pa.array(made, pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids.astype(np.int32)))
            decoded = [words.decode(ids[a:b].tolist()) for a, b in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(decoded, pa.string())], ["_key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("_key"), body(text).alias("_text"))
    return given.mapInArrow(encode, f"_key {kind}, ids {'binary' if packed else 'array<int>'}, decoded string").withColumnRenamed("_key", key)
