"""Exact and near copies against brute force."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, exact_copies, near_copies, queries
from tests.llm.helpers import ODD, docs_of


@pytest.mark.parametrize("bound", [common.BROADCAST_KEYS, 0])
def test_exact_copies(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_copies, "BROADCAST_KEYS", bound)
    texts = ODD + ["same text", "same texu", "x" * 200 + "a", "x" * 200 + "b"]
    out = {r["doc_id"]: r for r in exact_copies.exact_copies(docs_of(spark, texts)).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        own = groups[t or ""]
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (max(own), len(own), i == max(own))
    assert out[len(ODD) + 1]["text_sha256"] is None  # told apart by its beginning
    kept = exact_copies.without_copies(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(max, groups.values())) and "_text" in kept.columns


def test_exact_copies_of_few_and_repeated_rows(spark):
    assert exact_copies.exact_copies(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["a", "b"]).unionByName(docs_of(spark, ["a", "b"]))
    assert {(r["doc_id"], r["group_size"], r["kept"]) for r in exact_copies.exact_copies(twice).collect()} == {(0, 2, True), (1, 2, True)}
    no_id = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_copies.exact_copies(no_id).collect()} == {(None, 1), (1, 1), (None, None)}


def test_rows_with_repeated_and_null_ids_are_removed(spark):
    schema = "doc_id long, text string, _row int"
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (2, "only"), (None, "c"), (None, "c"), (None, "d"), (4, "d"), (None, None), (None, ""), (5, "e")]
    kept = exact_copies.without_copies(spark.createDataFrame([(*r, 7) for r in rows], schema))
    wanted = [(1, "a"), (3, "b"), (2, "only"), (None, "c"), (4, "d"), (5, "e")]
    assert kept.columns == ["doc_id", "text", "_row"] and collections.Counter((r[0], r[1]) for r in kept.collect() if r[1]) == collections.Counter(wanted)
    assert kept.count() == len(wanted) + 1
    words = [" ".join(f"{mark}{i}" for i in range(100)) for mark in "uvw"]
    near = [(1, words[0]), (1, words[0] + " more"), (None, words[0] + " other"), (None, words[1]), (None, words[1] + " more"), (1, words[2]), (0, words[2] + " more"), (0, "alone in this"), (None, None), (None, "")]
    kept = near_copies.without_near_copies(spark.createDataFrame([(*r, 7) for r in near], schema)).collect()
    assert len(kept) == 6 and sum(1 for r in kept if r["text"] and r["text"].startswith("u0")) == 1 and sum(1 for r in kept if r["text"] and r["text"].startswith("v0")) == 1
    assert [(r["doc_id"], r["text"]) for r in kept if r["text"] and r["text"].startswith(("w0", "alone"))] in ([(0, words[2] + " more"), (0, "alone in this")], [(0, "alone in this"), (0, words[2] + " more")])
    assert all(r["doc_id"] == 1 for r in kept if r["text"] and r["text"].startswith("u0"))


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(texts, size, percent=80):
    """Component and set size by all pairs that share a shingle."""
    sets = {k: shingles(t, size) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for k, s in sets.items():
        for other, both in collections.Counter(o for x in s for o in holders[x] if o > k).items():
            if both * 100 >= percent * (len(s) + len(sets[other]) - both):
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in sets}


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def edited(base, places, mark):
    words = list(base)
    for p in places:
        words[p] = f"{mark}{p}"
    return " ".join(words)


def family():
    """A chain of edits, a group that shares most of a passage without links, and copies."""
    base = [f"w{i}" for i in range(120)]
    texts = [edited(base, range(0, 2 * n, 2), "c") for n in range(8)]
    texts += [edited(base, range(i % 7, 120, 9), f"g{i}x") for i in range(12)]
    return texts + [texts[0], texts[3].upper(), " ".join(base[:110]), " ".join(base[:90])]


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies(spark, size):
    texts = ODD + family()
    assert found(near_copies.near_copies(docs_of(spark, texts), size=size)) == brute(dict(enumerate(texts)), size)


def test_buckets_that_stay_open_are_finished_exactly(spark):
    # Bands of no hash: all texts meet in one bucket and are compared with its first only, the other links come from the exact join.
    texts = family()
    assert found(near_copies.near_copies(docs_of(spark, texts), size=4, bands=1, rows=0)) == brute(dict(enumerate(texts)), 4)


def test_rare_pairs_miss_no_link(spark):
    texts = dict(enumerate(family()))
    sets = docs_of(spark, list(texts.values())).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).mapInArrow(near_copies._sets(4), "_id long, _set array<long>")
    alone = spark.createDataFrame([], "_id long, _l long")
    met = {(r["a"], r["b"]) for r in near_copies._rare_pairs(sets, alone, 80).collect()}
    own = {k: shingles(t, 4) for k, t in texts.items()}
    linked = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) * 100 >= 80 * len(own[a] | own[b])}
    assert linked <= met


def pairs_compared(spark, monkeypatch, rows):
    """Pairs compared after the first text's, for texts that are linked with each other but not with the first, which all buckets compare them with."""
    base = [f"w{i}" for i in range(120)]
    texts = [edited(base, range(0, 120, 6), "first")] + [edited(base, [i % 120], f"t{i}x") for i in range(rows)]
    seen, verified = [], near_copies._verified

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    with monkeypatch.context() as patched:
        patched.setattr(near_copies, "_verified", counted)
        assert found(near_copies.near_copies(docs_of(spark, texts), bands=1, rows=0)) == brute(dict(enumerate(texts)), 5)
    return sum(seen[1:])


def test_pairs_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", 4, raising=False)
    few, many = (pairs_compared(spark, monkeypatch, rows) for rows in (100, 200))
    assert many < 3 * few and many < 199 * 100  # all pairs: 4950 and 19900


@pytest.mark.parametrize("turns", [0, 1, 3])
def test_links_that_cells_leave_are_found(spark, monkeypatch, turns):
    monkeypatch.setattr(near_copies, "CELL", 2)
    monkeypatch.setattr(near_copies, "TURNS", turns)
    texts = family()
    assert found(near_copies.near_copies(docs_of(spark, texts), size=4, bands=1, rows=0)) == brute(dict(enumerate(texts)), 4)


def test_near_copies_of_few_and_repeated_rows(spark):
    assert found(near_copies.near_copies(docs_of(spark, []))) == {}
    assert found(near_copies.near_copies(docs_of(spark, [None, ""]))) == {0: (0, 0), 1: (0, 1)}
    twice = docs_of(spark, family()[:3]).unionByName(docs_of(spark, family()[:3]))
    assert near_copies.near_copies(twice).count() == 6


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(500, 530)] + [(3, 529)]
    out = {r["node"]: r["component"] for r in near_copies.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 141)) and all(out[x] == 3 for x in [7, *range(500, 530)])


def test_queries(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert found(queries.QUERIES["op3_near_copies"](spark, sf)) == brute(texts, 4)
