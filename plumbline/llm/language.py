"""Language of texts and of their parts: scripts narrow the candidates, Viterbi over word scores labels the spans.

A word is a run of letters. Its score for a language is the log likelihood of its letters in their context of three and of
four letters, hashed, learned from all labelled documents of the training side. The script of a word's first letter leaves only the languages
whose training words used that script. Viterbi chooses the best sequence of languages when every switch costs
``penalty``. A document's language is the one with the most letters; the score is its share of the letters.

Null texts and texts without a letter are ``und`` with score 0. A table without usable labels gives ``und`` for every row. Equal shares go to the
language that is first by name. Repeated rows get repeated results. An empty table gives no rows. Learned are all
labels that occur, whatever their number; the model has a fixed number of counters per label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import give_back, once, pieces_of

SLOTS = 1 << 16  # counters for contexts of three letters, and as many for four
PENALTY = 12.0
UNKNOWN = "und"
SLICE_BYTES = 2 << 20  # text that a task works on at a time
# First code points of blocks, and the script each belongs to: 0 Latin, 1 Greek, 2 Cyrillic, then one number per block.
BLOCKS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3400, 0xAC00, 0xD7B0]
SCRIPTS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 0, 1, 13, 14, 15, 16, 17, 18]
WIDTH = 2 * SLOTS + max(SCRIPTS) + 1


def training_row(key: Column) -> Column:
    """Whether a document belongs to the training side: crc32 of its id as text, modulo 3, is not 1; without an id it does."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class Words:
    """The words of some texts: context slots of every letter, and where words and texts begin."""

    three: np.ndarray
    four: np.ndarray
    firsts: np.ndarray  # place of each word's first letter among the letters
    letters: np.ndarray  # letters of each word
    scripts: np.ndarray
    texts: np.ndarray  # number of words before each text, and of all


def split_words(texts: list[str]) -> Words:
    is_letter = once("letters", _letter_table)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n\n" + "\n\n".join(lowered) + "\n\n").encode("utf-32-le"), dtype=np.uint32)
    mask = is_letter[codes]
    kept = np.where(mask, codes, 0).astype(np.uint64)
    at = np.flatnonzero(mask)
    before, here, after = kept[at - 1], kept[at], kept[at + 1]
    three = before * np.uint64(0x9E3779B97F4A7C15) + here * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    # The letter before that only counts within the word.
    four = three + np.where(before > 0, kept[at - 2], np.uint64(0)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0xA0761D6478BD642F)
    slot = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    firsts = np.flatnonzero(before == 0)
    letters = np.diff(np.append(firsts, len(at)))
    first_codes = here[firsts]
    scripts = np.zeros(len(firsts), dtype=np.int64)
    if len(first_codes) and first_codes.max() >= BLOCKS[1]:
        scripts = np.array(SCRIPTS)[np.searchsorted(BLOCKS, first_codes, side="right") - 1]
    ends = np.cumsum([2 + len(t) for t in lowered])
    texts_at = np.concatenate([[0], np.searchsorted(at[firsts], ends, side="left")]) if len(lowered) else np.zeros(1, dtype=np.int64)
    return Words(slot(three), slot(four) + SLOTS, firsts, letters, scripts, texts_at)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of slots and, after them, of scripts by label."""
    totals: dict[str, np.ndarray] = {}

    def give(label):
        total = totals.pop(label)
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["label", "slot", "n"])

    for batch in (part for whole in batches for part in pieces_of(whole, "_text", SLICE_BYTES)):
        by_label: dict[str, list[str]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_label.setdefault(label, []).append(text)
        for label, texts in by_label.items():
            words = split_words(texts)
            total = totals.setdefault(label, np.zeros(WIDTH, dtype=np.int64))
            for found in (words.three, words.four, words.scripts + 2 * SLOTS):
                total += np.bincount(found, minlength=WIDTH)
        while len(totals) > 32:  # labels without bound do not fill the task
            yield give(next(iter(totals)))
    for label in list(totals):
        yield give(label)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # slots by labels, log likelihoods
    scripts: np.ndarray  # scripts by labels, whether words of a script were seen


def learn(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model from all rows with a text and a label. Only its counters reach the driver."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"))
    counted = rows.mapInArrow(_tallies, "label string, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = counted["label"].combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    found = names.dictionary.to_pylist()
    labels = sorted(found)
    place = np.array([labels.index(x) for x in found], dtype=np.int64)
    counts = np.zeros((WIDTH, len(labels)))
    if len(labels):
        counts[counted["slot"].to_numpy(), place[names.indices.to_numpy(zero_copy_only=False)]] = counted["n"].to_numpy()
    weights = [np.log((part + 0.5) / (part + 0.5).sum(axis=0)) for part in (counts[:SLOTS], counts[SLOTS : 2 * SLOTS])]
    scripts = counts[2 * SLOTS :]
    # A script belongs to a language when at least one word in a thousand used it.
    seen = scripts >= np.maximum(1.0, 0.001 * scripts.sum(axis=0))
    return Model(labels, np.concatenate(weights).astype(np.float32), seen)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Words by labels: half the sum of both contexts' log likelihoods, 0 for the best label."""
    if not len(words.firsts):
        return np.zeros((0, len(model.labels)), dtype=np.float32)
    each = model.weights[words.three] + model.weights[words.four]
    scores = np.add.reduceat(each, words.firsts, axis=0) / 2
    allowed = model.scripts[words.scripts]
    ruled_out = ~allowed & allowed.any(axis=1)[:, None]
    scores = np.where(ruled_out, scores.min(axis=1)[:, None] - 50, scores)
    return (scores - scores.max(axis=1)[:, None]).astype(np.float32)


def best_paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of every word of several documents, step by step for all documents at once."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], dtype=np.int64)
    labels = scores[0].shape[1] if scores else 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([scores[i] for i in order]) if scores else np.zeros((0, labels))
    came = np.zeros((len(flat), labels), dtype=np.int16)
    ends = np.zeros(len(order), dtype=np.int64)
    best = np.zeros((len(order), labels))
    same = np.arange(labels)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, side="left"))  # documents longer than ``step``
        at = starts[:n] + step
        if step:
            top = best[:n].argmax(axis=1)
            jump = best[np.arange(n), top] - penalty
            stay = best[:n] >= jump[:, None]
            came[at] = np.where(stay, same, top[:, None])
            best[:n] = np.where(stay, best[:n], jump[:, None])
        best[:n] += flat[at]
        done = sizes[:n] == step + 1
        ends[:n][done] = best[:n][done].argmax(axis=1)
    out: list = [None] * len(order)
    paths = np.zeros(len(flat), dtype=np.int16)
    now = ends
    for step in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        n = int(np.searchsorted(-sizes, -step, side="left"))
        at = starts[:n] + step
        paths[at] = now[:n]
        now[:n] = came[at, now[:n]] if step else now[:n]
    for place, i in enumerate(order):
        out[i] = paths[starts[place] : starts[place + 1]]
    return out


def _labelled(model: Model, texts: list[str | None], penalty: float) -> list:
    """For each text the labels and letters of its words; None without a letter."""
    words = split_words([t or "" for t in texts])
    scores = word_scores(model, words)
    spans = list(zip(words.texts, words.texts[1:]))
    paths = iter(best_paths([scores[a:b] for a, b in spans if b > a], penalty))
    return [(next(paths), words.letters[a:b]) if b > a else None for a, b in spans]


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, spans: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; with ``spans`` also runs of words of one language (first word, words, label)."""
    given = docs.drop("lang_pred", "score", *(["spans"] if spans else []))
    kept = [f for f in given.schema if keep_text or f.name != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = [given.columns.index(f.name) for f in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in (part for whole in batches for part in pieces_of(whole, text, SLICE_BYTES)):
            labels, scores, runs = [], [], []
            found = _labelled(learned, batch.column(text).to_pylist(), penalty) if learned.labels else [None] * batch.num_rows
            for result in found:
                if result is None:
                    labels.append(UNKNOWN), scores.append(0.0), runs.append([])
                    continue
                path, letters = result
                share = np.bincount(path, weights=letters, minlength=len(learned.labels))
                top = int(share.argmax())
                labels.append(learned.labels[top]), scores.append(float(share[top] / share.sum()))
                cuts = (np.flatnonzero(np.diff(path)) + 1).tolist() if spans else []
                runs.append([{"first": a, "words": b - a, "label": learned.labels[path[a]]} for a, b in zip([0, *cuts], [*cuts, len(path)])] if spans else [])
            arrays = [batch.column(i) for i in places] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            names = [batch.schema.names[i] for i in places] + ["lang_pred", "score"]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("label", pa.string())]))
                arrays, names = [*arrays, pa.array(runs, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names)
            del found, arrays
        give_back()

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"]
    return given.mapInArrow(predict, ", ".join(shape + (["spans array<struct<first:int,words:int,label:string>>"] if spans else [])))


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""
    place = docs.columns.index(text)

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces_of(whole, text, SLICE_BYTES)):
            yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lettered, docs.schema)


def known_language(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language: those without a letter go, no others, whether or not labels were learned. Columns stay as they are."""
    model = learn(docs.filter(training_row(F.col(key))), text, label)
    if not model.labels:
        return with_letters(docs, text)
    return identify(docs, model, text).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
