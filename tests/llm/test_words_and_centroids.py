import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
import public_tokenizers as public
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plumbline.llm import centroid_clusters, periodic_runs, queries, word_pairs
from tests.llm.helpers import ODD, docs_of

digest = lambda b: hashlib.sha256(b).hexdigest()


# Periodic runs


def words_of(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def plain_runs(words):
    """All runs by the definition: every lag, every stretch that agrees with itself, no smaller period."""
    found = []
    for lag in range(1, len(words) // 4 + 1):
        at = 0
        while at + lag < len(words):
            start = at
            while at + lag < len(words) and words[at] == words[at + lag]:
                at += 1
            length = at - start + lag
            if at > start and length >= max(6, 4 * lag):
                if not any(all(words[i] == words[i + p] for i in range(start, start + length - p)) for p in range(1, lag)):
                    found.append((start, length, lag))
            at = max(at, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_in(docs):
    ends = np.cumsum([0, *map(len, docs)])
    words = np.array([w for d in docs for w in d], dtype=np.int64)
    runs = periodic_runs.find_runs(words, np.repeat(np.arange(len(docs)), np.diff(ends)))
    return [[(s - a, n, p) for s, n, p in runs.tolist() if a <= s < b] for a, b in zip(ends, ends[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=5), min_size=1, max_size=4))
def test_runs_by_definition(drawn):
    docs = [[w for unit, times in parts for w in unit * times] for parts in drawn]
    assert found_in(docs) == [plain_runs(d) for d in docs]


def test_long_periods_and_repeats_inside_a_period():
    rng = random.Random(3)
    for period in (2, 5, 6, 31, 32, 33, 64, 65, 200):
        unit = [rng.randint(0, 2) for _ in range(period - 1)] + [9]
        for times in (3.9, 4, 4.3, 9):
            words = [7] + (unit * 10)[: int(period * times)] + [8, 8]
            assert found_in([words]) == [plain_runs(words)]


def test_few_extensions_in_a_text_of_one_word(monkeypatch):
    calls = []
    real = periodic_runs._ahead
    monkeypatch.setattr(periodic_runs, "_ahead", lambda *a: calls.append(a) or real(*a))
    assert found_in([[1] * 100_000, [1] * 5, [2, 3] * 50_000]) == [[(0, 100_000, 1)], [], [(0, 100_000, 2)]]
    assert len(calls) == 2


def test_words_in_parts():
    text = ("some words é\x0b here\xa0too\x1c " * 50).encode()
    whole, parts = periodic_runs.Numbers(), periodic_runs.Numbers()
    assert periodic_runs.word_numbers(text, whole).tolist() == periodic_runs.word_numbers(text, parts, 7).tolist()
    assert [w.decode() for w in parts] == list(dict.fromkeys(words_of(text.decode())))


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 20)
    texts = [*ODD, "a b " * 9, "x " * 6 + "x", "c d e c d e c d e c d e f"]
    rows = sorted(periodic_runs.periodic_runs(docs_of(spark, texts)).collect())
    for row, text in zip(rows, texts, strict=True):
        words = words_of(text)
        runs = [(0, len(words), 1)] if len(words) > 5000 else plain_runs(words)
        assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (len(words), runs, collapsed(words, runs))
    assert periodic_runs.periodic_runs(docs_of(spark, [])).count() == 0
    keyless = spark.createDataFrame([(None, "a " * 9), (None, "a " * 9), ("k", None)], "doc_id string, text string")
    assert [r["doc_id"] for r in periodic_runs.periodic_runs(keyless).orderBy("doc_id").collect()] == [None, None, "k"]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for row in rows:
        words = planted(row["doc_id"], words_of(texts[row["doc_id"]]))
        if len(words) > 3000:
            assert row["n_words"] == len(words)
            continue
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert (row["runs_sha256"], row["collapsed_sha256"]) == (digest(lines.encode()), digest(collapsed(words, runs).encode()))


# Word pairs

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return word_pairs.Vocabulary(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def lexicon_of(vocabulary, words, folder):
    made = word_pairs.Lexicon.compile([w.encode() for w in words], vocabulary.merged)
    (folder / "lexicon").write_bytes(made.to_bytes())
    return word_pairs.Lexicon.mapped(str(folder / "lexicon"))


def check(encoder, library, texts):
    ids, borders = encoder.encode(texts)
    for text, a, b in zip(texts, borders, borders[1:]):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == expected, ascii(text[:200])
        assert encoder.vocabulary.decode(ids[a:b].tolist()) == library.decode(expected, skip_special_tokens=False)


WORDS = ["the", "then", "hen", "other", "mother", "brother", "é", "日本", "...", "a", "x" * 40]
MORE = [
    "the brothers' mother and THE hens ... don't 'TIS we'LL", "Hello <|endoftext|> World<|startoftext|><|ENDOFTEXT|> <|endoftext|≯", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul é क़ Å",
    "a" * 5000, "͸ Ɤ \U000323b1x", "A̖࢘́b \U00011935\U00011930", "\x1c\x85a b　c 12½٣", "x" * 40 + " " + "x" * 41, "🎉👩‍👩‍👧 é",
]


def test_ids_like_the_library(vocabulary, library, tmp_path):
    texts = [t or "" for t in ODD] + MORE
    for words in ([], WORDS, ["a"]):
        check(word_pairs.Encoder(vocabulary, lexicon_of(vocabulary, words, tmp_path)), library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_texts_like_the_library(vocabulary, library, texts):
    lexicon = word_pairs.Lexicon.compile([w.encode() for w in WORDS], vocabulary.merged)
    check(word_pairs.Encoder(vocabulary, lexicon), library, texts)


def test_every_letter_like_the_library(vocabulary, library):
    """Letters, digits, signs and marks of all planes, next to letters and to signs, and decomposed."""
    encoder = word_pairs.Encoder(vocabulary, word_pairs.Lexicon.compile([], vocabulary.merged))
    letters = [chr(c) for c in range(0x33480) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    apart = [f"a{c}1 !{c}! {unicodedata.normalize('NFD', c)}" for c in letters]
    ids, borders = encoder.encode(apart)
    for text, a, b, expected in zip(apart, borders, borders[1:], library.encode_batch(apart, add_special_tokens=False)):
        assert ids[a:b].tolist() == expected.ids, ascii(text)


def test_both_merges_agree(vocabulary):
    rng = random.Random(5)
    for _ in range(500):
        word = bytes(rng.choice(b"aeinrsth\xc3\xa9") for _ in range(rng.randint(1, 70)))
        symbols = lambda: [vocabulary.inner[b] for b in word[:-1]] + [vocabulary.final[word[-1]]]
        assert vocabulary._merged_in_place(symbols()) == vocabulary._merged_by_heap(symbols())


def test_the_automaton_is_minimal_and_exact(vocabulary):
    rng = random.Random(8)
    words = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(1, 7))) for _ in range(800)}
    lexicon = word_pairs.Lexicon.compile(words, lambda w: list(w))
    ordered = sorted(words)
    asked = ordered + [w + b"a" for w in ordered] + [w[:-1] for w in ordered] + [b"", b"zzz", b"a" * 100]
    places = lexicon.places(asked)
    assert places.tolist() == [ordered.index(w) if w in words else -1 for w in asked]
    for place, word in enumerate(ordered):
        assert lexicon.ids[lexicon.starts[place] : lexicon.starts[place + 1]].tolist() == list(word)
    # A minimal automaton has one state for each different set of endings.
    starts = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(s) :] for w in words if w.startswith(s)) for s in starts}
    assert len(lexicon.bits) == len(endings)


def test_frequent_words_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(word_pairs, "COUNTED_AT_ONCE", 3)
    docs = docs_of(spark, ["b a a c", None, "A b! " + "y" * 60, "d " * 4 + "<|endoftext|>"]).repartition(3)
    found = lambda most: {bytes(r["word"]).decode(): r["n"] for r in word_pairs.frequent_words(docs, PATH, most).collect()}
    expected = {"d": 4, "a": 3, "b": 2, "!": 1, "c": 1}
    for most, words in ((0, ""), (1, "d"), (3, "dab"), (4, "dab"), (5, "dab!c"), (99, "dab!c")):
        assert found(most) == {w: expected[w] for w in words}
    monkeypatch.setattr(word_pairs, "COUNT_BITS", 1)  # 2 and 3 fall into classes of their own, 1 into another
    assert found(4) == {"d": 4, "a": 3, "b": 2}


def test_word_columns(spark, library):
    texts = [*ODD, *MORE]
    for most in (0, 3, 1000):
        rows = word_pairs.round_trip(docs_of(spark, texts), PATH, most).orderBy("doc_id").collect()
        for row, text in zip(rows, texts, strict=True):
            expected = library.encode(text or "", add_special_tokens=False).ids
            assert row["ids"] == expected and row["decoded"] == library.decode(expected, skip_special_tokens=False)
    assert word_pairs.round_trip(docs_of(spark, []), PATH).count() == 0


def test_word_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_word_pairs"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(decoded.encode()))


# Centroids


def plain_clusters(rows, k, rounds, size, by=64):
    """The contract, row by row in Python's integers: ``{place in rows: (cluster, distance)}`` and the centroids."""
    floor = lambda x: math.floor(x * by) if abs(x) < 2**53 else int(x) * by
    kept = [(i, key, [floor(float(x)) for x in v], list(v)) for i, (key, v) in enumerate(rows) if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[1] is None, digest(f"1:{r[1]}".encode()), r[3]))
    centroids = [r[2] for r in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for r in kept:
            groups.setdefault(nearest(r[2])[1], []).append(r[2])
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]
    return [(r[1], *nearest(r[2])[::-1]) for r in kept], centroids


def compare(spark, rows, k, rounds, size):
    table = spark.createDataFrame([(key, v, 1, "x") for key, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    found, centroids = centroid_clusters.cluster(table, k, rounds, size)
    expected, middles = plain_clusters(rows, k, rounds, size)
    top = lambda x: x if x is not None and x < 2**63 else None
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(a, c, top(d)) for a, c, d in expected], key=key)
    inertia = [sum(d for _, c, d in expected if c == i) for i in range(len(middles))]
    sizes = [sum(c == i for _, c, _ in expected) for i in range(len(middles))]
    got = [(r["cluster"], [int(x) for x in r["centroid"]], r["n"], r["inertia"]) for r in centroids.orderBy("cluster").collect()]
    # An inertia is null as soon as one of its distances is.
    limit = [None if any(c == i and d >= 2**63 for _, c, d in expected) else top(x) for i, x in enumerate(inertia)]
    assert got == list(zip(range(len(middles)), middles, sizes, limit))


def test_ties_repeats_and_left_out_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), float(i % 3), 0.25 * (i % 2)]) for i in range(60)]
    rows += [(7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (None, [-1.0, 2.0, -0.01]), (None, [0.0, -0.0, 0.0])]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, nan, 2.0]), (105, [inf, 0.0, 0.0]), (106, [1.0] * 4)]
    compare(spark, rows, 7, 3, 3)
    compare(spark, rows, 1, 2, 3)
    compare(spark, [(1, [1.0, 1.0, 1.0])] * 5, 4, 3, 3)
    compare(spark, rows[60:63], 16, 3, 3)
    compare(spark, rows[64:], 4, 3, 3)
    compare(spark, [], 4, 3, 3)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(40)]
    rows += [(50, [1e300, 0.0, -1e300, 1.0]), (51, [1.7e308, -0.5, 0.0, 1.0]), (52, [1e8, 1.0, 0.0, -0.0]), (53, [1e8, 1.0, 0.001, 0.0]), (54, [2.0**53 + 2, 3.0, 0.5, 1e5]), (55, [-70000.5, 20000.25, 1.0, 1.0])]
    for k in (1, 3, 45):
        compare(spark, rows, k, 3, 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 20), st.integers(1, 4), st.integers(0, 10**6))
def test_the_walk_finds_the_nearest(k, size, spread, seed):
    rng = np.random.default_rng(seed)
    centroids, vectors = rng.integers(-spread, spread + 1, (k, size)), rng.integers(-spread, spread + 1, (30, size))
    number, apart = centroid_clusters.SortedLists(centroids).nearest(vectors)
    every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert number.tolist() == every.argmin(axis=1).tolist() and apart.tolist() == every.min(axis=1).tolist()


def test_the_walk_stops_early(monkeypatch):
    """With centroids far apart in every dimension, most are never looked at."""
    looked = []
    real = centroid_clusters.SortedLists._offer
    monkeypatch.setattr(centroid_clusters.SortedLists, "_offer", staticmethod(lambda rows, *a: looked.append(len(rows)) or real(rows, *a)))
    rng = np.random.default_rng(1)
    centroids = np.arange(200)[:, None] * 1000 + rng.integers(0, 50, (200, 8))
    vectors = centroids[rng.integers(0, 200, 500)] + rng.integers(-20, 20, (500, 8))
    centroid_clusters.SortedLists(centroids).nearest(vectors)
    assert sum(looked) < 500 * 3


def test_cluster_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected, middles = plain_clusters(rows, 16, 3, 64)
    inertia = [sum(d for _, c, d in expected if c == i) for i in range(16)]
    found = [tuple(r) for r in queries.QUERIES["op13_centroid_clusters"](spark, sf).collect()]
    spelled = [digest(",".join(map(str, c)).encode()) for c in middles]
    assert sorted(found) == sorted((key, c, d, inertia[c], sum(inertia), spelled[c]) for key, c, d in expected)
