"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

An entity's surrogate is a keyed permutation of what its format allows: digits become digits, letters become letters of
their script and kind, listed first names other names of their gender and script; separators, case and check digits are kept
valid. Names are found after a title, and then wherever the document has them again, whole or in part; in scripts without capitals a name ends after two parts. A permutation gives different entities of a format different surrogates and one entity the same one in every document, with no table
of entities, and is built without fixed points, so nothing is left as it was. ``replace_distinctly`` checks this over the mentions of a corpus and mends it.

Null texts stay null, texts without entities stay as they are, overlapping finds go to the earlier and then the longer one.
Repeated rows get repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import BROADCAST_KEYS, pieces_of
from plumbline.session import materialise

# Given names by script and gender, and the titles before names.
GIVEN = {
    ("latin", "f"): "anna maria emma laura julia sarah lisa sophie elena clara marie alice carmen lucia isabel ingrid helen ruth martha diana".split(),
    ("latin", "m"): "john peter paul thomas michael david daniel martin robert james carlos miguel jean pierre louis hans stefan andreas george henry".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья ирина татьяна светлана екатерина юлия".split(),
    ("cyrillic", "m"): "иван пётр алексей сергей дмитрий андрей михаил николай владимир павел".split(),
}
TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "señor", "señora", "sr", "sra", "г-н", "г-жа", "господин", "госпожа"]
# Letters that stand for one another.
LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäãåæèéêëìíîïòóôöõøùúûü", "çñßýÿ",
    "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
_LETTER = {c: i for i, letters in enumerate(LETTERS) for c in letters}
# Country codes of one and of two digits; all others have three.
COUNTRIES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
# Words within a name that stay as they are.
PARTICLES = "van von der den de del della di da dos du la le al el bin ibn ter zu".split()

# A part of a name: a capital or a letter without case, then letters with their marks; apostrophes may stand between.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x2100)) if unicodedata.category(c)[0] == "M")
_CAPITAL = "[" + "".join(c for c in map(chr, range(0x2100)) if c.isupper() or c.istitle()) + "]"
_REST = rf"(?:[^\W\d_]|[{_MARKS}])"
_TAIL = rf"(?:['’](?!s(?!\w)){_REST}+)*"
_WORD = lambda first: rf"{first}{_REST}*{_TAIL}"
_FIRST = r"[^\W\d_a-zа-яà-ÿ]"
_JOINT = rf"(?:[ ](?:(?:{'|'.join(PARTICLES)})[ ])*|[ \-]|(?<=\.))"
# A lone capital within a name has a dot or another part after it.
_NEXT = rf"(?:{_CAPITAL}\.|(?!{_CAPITAL}(?![\w'’])(?![ \-]{_CAPITAL}{_REST})){_WORD(_CAPITAL)})"
_NAME = rf"(?:(?:{'|'.join(PARTICLES)})[ ])*(?:{_CAPITAL}\.(?={_JOINT}{_FIRST})|{_WORD(_FIRST)})(?:{_JOINT}{_FIRST}{_REST}+{_TAIL})?(?:{_JOINT}{_NEXT})*"

PATTERNS = {
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<secret>[A-Za-z0-9_\-/+=.]{8,})""",
    "email": r"(?P<email>\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}\b)",
    "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "card": r"(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))",
    "ssn": r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    "ip": r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
    "phone": r"(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\w))",
    "name": r"\b(?:" + "|".join([t[0].upper() + t[1:] for t in TITLES] + [t for t in TITLES if t[0] in "гд"]) + rf")\b\.?[ ](?P<name>{_NAME})",
}
_HINT = re.compile(r"[0-9@]|" + PATTERNS["name"].replace("(?P<name>", "(?:") + "|(?i:token|secret|passw|key)")


def luhn_digit(digits: str) -> str:
    """The check digit after ``digits``."""
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[::-2])
    return str(-(sum(twice) + sum(map(int, digits[-2::-2]))) % 10)


class Permutation:
    """A keyed permutation without fixed points of the value vectors of some radices."""

    def __init__(self, key: bytes, kind: str, radices: list[int]):
        self.radices = radices
        self.base = hashlib.blake2b(f"{kind}|{radices}".encode(), key=key[:64])
        half = len(radices) // 2
        self.sides = math.prod(radices[:half]), math.prod(radices[half:])

    def _noise(self, turn: int, value: int) -> int:
        h = self.base.copy()
        h.update(f"{turn}|{value}".encode())
        return int.from_bytes(h.digest(), "big")

    def _swap(self, value: int, back: bool) -> int:
        one, other = divmod(value, self.sides[1])
        for turn in range(5, -1, -1) if back else range(6):
            sign = -1 if back else 1
            if turn % 2:
                other = (other + sign * self._noise(turn, one)) % self.sides[1]
            else:
                one = (one + sign * self._noise(turn, other)) % self.sides[0]
        return one * self.sides[1] + other

    def __call__(self, values: list[int]) -> list[int]:
        size = self.sides[0] * self.sides[1]
        if size < 2:
            return values
        number = 0
        for value, radix in zip(values, self.radices):
            number = number * radix + value
        # A shift between a permutation and its inverse: a permutation that leaves nothing in place.
        number = self._swap((self._swap(number, True) + 1 + self._noise(99, 0) % (size - 1)) % size, False)
        out = []
        for radix in reversed(self.radices):
            number, value = divmod(number, radix)
            out.append(value)
        return out[::-1]


def _permuted(key: bytes, kind: str, values: list[int], radices: list[int]) -> list[int]:
    return Permutation(key, kind, radices)(values)


def _low(c: str) -> str:
    """A letter's small form, one character for one; the final sigma counts as a sigma."""
    low = c.lower()
    return "σ" if low == "ς" else low if len(low) == 1 else c


def _cased(c: str) -> bool:
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


@functools.cache
def _page(number: int) -> dict[str, str]:
    """The letters of 256 code points that LETTERS leaves out, each with all those of its script and kind."""
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(256 * number, 256 * number + 256)):
        if c.isalpha() and _low(c) == c and c not in _LETTER:
            groups.setdefault((unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), _cased(c)), []).append(c)
    # A letter without another of its kind goes to the largest group of its script, or else of the page.
    for alone in [k for k, v in groups.items() if len(v) == 1]:
        others = sorted((k for k in groups if k != alone), key=lambda k: (k[0] != alone[0], -len(groups[k]), k))
        if alone in groups and len(groups[alone]) == 1 and others:
            groups[others[0]] += groups.pop(alone)
    return {c: "".join(v) for v in groups.values() for c in v}


def _alphabet(c: str) -> str:
    """The characters that a small letter or digit may become; none for anything else."""
    if c.isascii() and c.isdigit():
        return "0123456789"
    if c in _LETTER:
        return LETTERS[_LETTER[c]]
    return _page(ord(c) >> 8).get(c, "") if c.isalpha() else ""


def _shaped(key: bytes, kind: str, text: str) -> str:
    """Letters and digits permuted in place; case and everything else stay."""
    low = [_low(c) for c in text]
    spots = [(i, kinds) for i, c in enumerate(low) if len(kinds := _alphabet(c)) > 1]
    moved = _permuted(key, kind, [kinds.index(low[i]) for i, kinds in spots], [len(kinds) for _, kinds in spots])
    out = list(text)
    for (i, kinds), value in zip(spots, moved):
        new = kinds[value]
        out[i] = new.upper() if text[i].isupper() and text[i] != low[i] and _cased(new) else new
    return "".join(out)


def _digits(key: bytes, kind: str, text: str, first: int = 0) -> str:
    """The digits from the ``first`` on permuted, whatever stands between them."""
    spots = [i for i, c in enumerate(text) if c.isdigit()][first:]
    moved = _permuted(key, kind, [int(text[i]) for i in spots], [10] * len(spots))
    out = list(text)
    for i, value in zip(spots, moved):
        out[i] = str(value)
    return "".join(out)


def _name(key: bytes, text: str) -> str:
    """Each part of a name: a listed given name by another of its gender and script, any other by letters of its kind."""
    out = []
    for part in re.split(r"([ \-.])", text):
        if part in PARTICLES:
            out.append(part)
            continue
        known = next((names for names in GIVEN.values() if part.lower() in names), None)
        if known:
            moved = known[_permuted(key, f"given {known[0]}", [known.index(part.lower())], [len(known)])[0]]
            out.append(moved.upper() if part.isupper() else moved.capitalize())
        else:
            new = _shaped(key, "name", part)
            # Not a listed given name: an unlisted name would meet a listed one's surrogate.
            while any(new.lower() in names for names in GIVEN.values()) or new in PARTICLES:
                new = _shaped(key, "name", new)
            out.append(new)
    return "".join(out)


def surrogate(key: bytes, kind: str, text: str) -> str | None:
    """The replacement of an entity, or None when the text is not one of this kind after all."""
    new = _replaced(key, kind, text)
    if new == text:  # only signs
        assert not any(len(_alphabet(_low(c))) > 1 for c in text), f"a {kind} was left as it is"
        return None
    return new


def _replaced(key: bytes, kind: str, text: str) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        spots = [i for i, c in enumerate(text) if c.isdigit()]
        body = _digits(key, "card", text[: spots[-1]])
        return body + luhn_digit("".join(c for c in body if c.isdigit()))
    if kind == "iban":
        compact = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))
        if number(compact) % 97 != 1:
            return None
        moved = [c for c in _shaped(key, "iban", compact[4:])]
        check = 98 - number(compact[:2] + "00" + "".join(moved)) % 97
        chars = iter(compact[:2] + f"{check:02d}" + "".join(moved))
        return "".join(c if c == " " else next(chars) for c in text)
    if kind == "ip":
        return ".".join(map(str, _permuted(key, "ip", [int(x) for x in text.split(".")], [256] * 4)))
    if kind == "phone":
        # The country code follows from the digits alone, whatever stands between them.
        plain = canonical(kind, text)
        first = next((n for n in (1, 2) if plain[1 : 1 + n] in COUNTRIES), 3) if plain[0] == "+" else 0
        return _digits(key, f"phone {plain[1 : 1 + first]}", text, first)
    if kind == "email":
        stem, dot, top = text.rpartition(".")
        return _shaped(key, "email " + top.lower(), stem) + dot + top
    if kind == "name":
        return _name(key, text)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and kind == "secret":
        moved = _permuted(key, "hex", [int(c, 16) for c in text], [16] * len(text))
        new = "".join(f"{v:x}" for v in moved)
        return new.upper() if text.isupper() else new
    return _digits(key, kind, text) if kind == "ssn" else _shaped(key, kind, text)


def candidates(kind: str, text: str, start: int, stop: int) -> Iterator[int]:
    """The ends to try for an entity: where kinds with check digits end is known by those, so each end of a group, the longest first."""
    yield stop
    if kind in ("card", "iban"):
        least = 13 if kind == "card" else 16
        for end in range(stop - 1, start, -1):
            if text[end] in " -" and text[end - 1] not in " -" and sum(c.isalnum() for c in text[start:end]) >= least:
                yield end


class Finder:
    """Finds entities in texts and replaces them."""

    def __init__(self, key: bytes, turns: dict[tuple[str, str], int] | None = None):
        self.key = key
        self.turns = turns or {}  # how often an entity's surrogate is drawn anew, by kind and digest
        self.patterns = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS.items()]

    def surrogate(self, kind: str, text: str) -> str | None:
        turn = self.turns.get((kind, digest(self.key, kind, text)), 0) if self.turns else 0
        return surrogate(hashlib.blake2b(str(turn).encode(), key=self.key[:64]).digest() if turn else self.key, kind, text)

    def mentions(self, text: str) -> list[tuple[int, int, str, str]]:
        """``(start, stop, kind, surrogate)`` in order, not overlapping."""
        if not _HINT.search(text):
            return []
        found = []
        for rank, (kind, pattern) in enumerate(self.patterns):
            at = 0
            while match := pattern.search(text, at):
                start, stop = match.span(kind)
                for stop in candidates(kind, text, start, stop):
                    new = self.surrogate(kind, text[start:stop])
                    if new is not None:
                        found.append((start, -stop, rank, kind, new))
                        break
                # What is no entity from here may be one from a later group.
                at = stop if new is not None or kind not in ("card", "iban") else start + 1
        out, end = [], 0
        for start, stop, _, kind, new in sorted(found):
            if start >= end:
                out.append((start, -stop, kind, new))
                end = -stop
        return self._named_again(text, out)

    def _named_again(self, text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
        """``found`` and further mentions of its names, whole or by a part of two letters and more."""
        whole = {text[start:stop] for start, stop, kind, _ in found if kind == "name"}
        parts = {part for name in whole for part in re.split(r"[ \-.]+", name) if part not in PARTICLES}
        names = {n for n in whole | parts if sum(map(str.isalpha, n)) > 1}
        if not names:
            return found
        spellings = {v for n in names for v in (n, n.upper(), n.title(), n.capitalize())}
        known = re.compile(r"(?<![\w@])(?:" + "|".join(map(re.escape, sorted(spellings, key=lambda n: (-len(n), n)))) + r")(?!\w)")
        out, end = [], 0
        for start, stop, kind, new in [*found, (len(text), len(text), "", "")]:
            for match in known.finditer(text, end, start):
                if again := self.surrogate("name", match[0]):
                    out.append((*match.span(), "name", again))
            if kind:
                out.append((start, stop, kind, new))
            end = stop
        return out

    def replaced(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        found = self.mentions(text)
        parts, end = [], 0
        for start, stop, _, new in found:
            parts += [text[end:start], new]
            end = stop
        return "".join([*parts, text[end:]]) if found else text, found


def digest(key: bytes, kind: str, text: str) -> str:
    return hashlib.blake2b(canonical(kind, text).encode(), key=key[:64], digest_size=16).hexdigest()


def replace_pii(docs: DataFrame, key: bytes, text: str = "text", turns: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """``docs`` with entities in ``text`` replaced and ``entities``: start, kind, original digest and surrogate of each."""
    given = docs.drop("entities") if "entities" != text else docs
    place = given.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(key, turns)
        spot = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))
        for batch in (part for whole in batches for part in pieces_of(whole, text)):
            texts, entities = [], []
            for value in batch.column(place).to_pylist():
                new, found = finder.replaced(value) if value is not None else (None, [])
                texts.append(new)
                entities.append([{"start": s, "kind": k, "original": digest(key, k, value[s:e]), "surrogate": canonical(k, n)} for s, e, k, n in found])
            arrays = list(batch.columns)
            arrays[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(entities, spot)], [*batch.schema.names, "entities"])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema]
    return given.mapInArrow(replace, ", ".join([*shape, "entities array<struct<start:bigint,kind:string,original:string,surrogate:string>>"]))


def canonical(kind: str, text: str) -> str:
    """One spelling of an entity: what its mentions in different formats share."""
    text = "".join(str(int(c)) if c.isdecimal() else c for c in text)
    if kind in ("phone", "card", "iban"):
        return re.sub(r"[ .()\-]", "", text)
    return text.lower().replace("ς", "σ") if kind in ("email", "name") else text


def _mentioned(replaced: DataFrame) -> DataFrame:
    return replaced.select(F.explode("entities").alias("e")).select("e.kind", "e.original", "e.surrogate").distinct()


def collisions(replaced: DataFrame) -> DataFrame:
    """Distinctness and coreference over a corpus: surrogates of two entities, and entities with two surrogates. None are expected."""
    return _clashes(_mentioned(replaced))


def _clashes(mentions: DataFrame) -> DataFrame:
    twice = lambda of, other: mentions.groupBy("kind", F.col(of).alias("value")).agg(F.count(other).alias("n")).filter("n > 1").withColumn("of", F.lit(of))
    return twice("surrogate", "original").unionByName(twice("original", "surrogate"))


def replace_distinctly(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``replace_pii`` checked over the whole corpus: of entities that share a surrogate, all but the first by digest get a new one.

    The result and its distinct mentions are written before they are checked; only what is to be mended reaches the driver. An entity with
    two surrogates cannot be mended and is an error.
    """
    turns: dict[tuple[str, str], int] = {}
    while True:
        made = materialise(replace_pii(docs, key, text, turns), "surrogates")
        mentions = materialise(_mentioned(made), "mentions")
        found = _clashes(mentions)
        counts = {r["of"]: r["count"] for r in found.groupBy("of").count().collect()}
        if counts.get("original"):
            raise ValueError(f"{counts['original']} entities have two surrogates")
        if not counts:
            return made
        if counts["surrogate"] > BROADCAST_KEYS:
            raise ValueError(f"{counts['surrogate']} surrogates stand for two entities")
        shared = mentions.join(found.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"])
        first = shared.groupBy("kind", "surrogate").agg(F.min("original").alias("_first"))
        for row in shared.join(first, ["kind", "surrogate"]).filter("original <> _first").select("kind", "original").toLocalIterator():
            turns[row["kind"], row["original"]] = turns.get((row["kind"], row["original"]), 0) + 1
