"""Licence scans with a positional index of rare words.

Every template has its words by position and phrases it must have. The document frequencies of the templates' words
are counted over all documents; the rarest word of a template's mandatory phrase is its anchor. A file is looked up by its licence words of
highest inverse frequency that are anchors; each place of an anchor gives a start for its template, the postings
of the other words are intersected with it by relative position, and the mandatory phrases are verified in the file.

Null texts are empty. Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Repeated rows get repeated
results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import body, pieces_of

# Phrases whose every place counts, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of licence notices, by label, with the phrases that must stand in them.
NOTICES = {
    "gpl-2.0": ("under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("under the gnu general public license version 3", ["gnu general public license version 3"]),
    "lgpl": ("under the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl": ("under the gnu affero general public license", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", ["permission to use copy modify and or distribute"]),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    "epl": ("under the terms of the eclipse public license", ["eclipse public license"]),
    "cc0": ("cc0 1 0 universal", ["cc0 1 0 universal"]),
    "cc-by-nc": ("licensed under cc by nc", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa", ["cc by sa"]),
    "cc-by-nd": ("licensed under cc by nd", ["cc by nd"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
}

# A-Z to a-z, everything that is not in a word to a space. Bytes of 0x80 and above belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    base: bool


def templates(phrases: dict[str, str] = PHRASES, notices: dict = NOTICES) -> list[Template]:
    split = lambda s: tuple(words_of(s))
    out = [Template(label, split(p), (split(p),), True) for p, label in phrases.items()]
    return out + [Template(label, split(text), tuple(map(split, must)), False) for label, (text, must) in notices.items()]


class Index:
    """Anchors and postings of templates, by document frequencies of their words."""

    def __init__(self, known: list[Template], frequencies: dict[bytes, int], documents: int):
        self.known = known
        words = {w for t in known for w in t.words}
        self.idf = {w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in words}
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for number, template in enumerate(known):
            phrase = template.phrases[0]
            at = next(i for i in range(len(template.words)) if template.words[i : i + len(phrase)] == phrase)
            place = max(range(at, at + len(phrase)), key=lambda i: (self.idf[template.words[i]], -i))
            self.anchors.setdefault(template.words[place], []).append((number, place))
        self.weights = [sum(self.idf[w] for w in t.words) for t in known]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], float]:
        """Places (start, template) of base phrases, labels found, and the largest weighted share of a template's words in place."""
        anchors, places, labels, best = self.anchors, [], set(), 0.0
        count = len(words)
        for at in [i for i, w in enumerate(words) if w in anchors]:
            for number, place in anchors[words[at]]:
                template, start = self.known[number], at - place
                if template.base:
                    if start < 0 or tuple(words[start : start + len(template.words)]) != template.words:
                        continue
                    places.append((start, number))
                    share = 1.0
                else:
                    phrase = template.phrases[0]
                    lead = next(i for i in range(len(template.words)) if template.words[i : i + len(phrase)] == phrase)
                    if start + lead < 0 or tuple(words[start + lead : start + lead + len(phrase)]) != phrase:
                        continue
                    here = max(0, start), start + 2 * len(template.words)
                    near = words[here[0] : here[1]]
                    if not all(_holds(near, p) for p in template.phrases[1:]):
                        continue
                    met = sum(self.idf[w] for i, w in enumerate(template.words) if 0 <= start + i < count and words[start + i] == w)
                    share = met / self.weights[number]
                labels.add(template.label)
                best = max(best, share)
        return places, labels, best


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words) - len(phrase) + 1))


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents, over all rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        rows = 0
        for batch in (part for whole in batches for part in pieces_of(whole, "_text")):
            rows += batch.num_rows
            for value in batch.column(0):
                for word in vocabulary.intersection(words_of(value.as_py())):
                    counts[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), rows], pa.int64())], ["word", "n"])

    found = docs.select(body(text).alias("_text")).mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in found}  # one row per word of the templates
    return counts, counts.pop(b"", 0)


def scan_licences(docs: DataFrame, known: list[Template] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, places, base_labels, labels, score``; ``places`` are (start, label) of every base phrase, labels are sorted lists."""
    known = known if known is not None else templates()
    counts, total = frequencies(docs, {w for t in known for w in t.words}, text)
    index = Index(known, counts, total)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces_of(whole, "_text")):
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                words = words_of(value.as_py())
                places, labels, best = index.scan(words)
                row = (
                    len(words), [{"start": s, "label": known[n].label} for s, n in sorted(places)],
                    sorted({known[n].label for _, n in places}), sorted(labels), min(1.0, best),
                )
                for column, x in zip(out, row):
                    column.append(x)
            spot = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
            kinds = [pa.int64(), spot, pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["_key", "n_words", "places", "base_labels", "labels", "score"])

    kind = docs.schema[key].dataType.simpleString()
    shape = f"_key {kind}, n_words long, places array<struct<start:bigint,label:string>>, base_labels array<string>, labels array<string>, score double"
    return docs.select(F.col(key).alias("_key"), body(text).alias("_text")).mapInArrow(scanned, shape).withColumnRenamed("_key", key)
