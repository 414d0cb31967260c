"""Shards, top-k search, packing, the queries with SQL and the pipeline."""

import collections
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check_queries import TABLES, canonical
from plumbline.llm import byte_pairs, inner_product, packing, pii, queries, sharding
from tests.llm.helpers import ODD, docs_of
from tests.llm.test_copies import brute


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df, result = queries.QUERIES[name](spark, sf), db.sql(queries.SQL[name])
    assert canonical(df.columns, df.collect()) == canonical(list(result.columns), result.fetchall())


def test_shards(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_hash_tree_shards"](spark, sf).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data)) and r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    docs = docs_of(spark, ODD).unionByName(docs_of(spark, ODD)).withColumn("doc_id", F.nullif("doc_id", F.lit(3)))
    rows = sharding.shard_rows(docs, sharding.even_tree()).collect()
    assert len(rows) == 2 * len(ODD) and min(r["size"] for r in rows) == 1 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_rows(docs.limit(0), sharding.even_tree()).count() == 0


def test_rows_move_only_where_weights_change(spark):
    tree = sharding.even_tree()
    heavier = [sharding.Shard(s.region, s.rack, s.number, 3.0 if s.number == 5 else s.weight) for s in tree]
    ids = spark.range(4000)
    rows = ids.select(sharding.tree_shard(F.col("id"), tree).alias("a"), sharding.tree_shard(F.col("id"), heavier).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    # Shard 5 is in rack 2 of region 1: rows come from outside only into that region, and inside the rack only into the shard.
    assert moved and all(b in (4, 5, 6, 7) for _, b in moved) and not [1 for a, b in moved if a in (0, 1, 2, 3) and b in (0, 1, 2, 3)]
    assert all(b == 5 for a, b in moved if a in (4, 5)) and 350 < sum(r["a"] == 0 for r in rows) < 650


def test_top_k(spark):
    random = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in random.normal(size=(300, 8))]
    vectors[10] = vectors[20] = vectors[30] = vectors[0]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (0, vectors[0]), (None, vectors[1])]
    base = inner_product.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = base.filter(F.col("_id") % 10 == 0)
    whole = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64))
    scores = (whole @ whole.T).astype(int)
    wanted = {(q, n + 1, j, scores[q, j]) for q in range(0, 300, 10) for n, j in enumerate(sorted((j for j in range(300) if j != q), key=lambda j: (-scores[q, j], j))[:20])}
    for shard, block in ((20_000, 5_000), (60, 7)):
        out = {tuple(r) for r in inner_product.top_inner_products(base, asked, 20, shard, block).collect()}
        assert out == wanted
    few = base.filter("_id < 3")
    assert len(inner_product.top_inner_products(few, few, 20).collect()) == 6
    assert inner_product.top_inner_products(few.filter("false"), few.filter("false")).count() == 0


def test_top_k_of_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(60, 4))]
    vectors[5], vectors[10], vectors[11] = [1e300, 1.0, -1e300, 0.5], [1e8, 0.0, -0.0, 1.0], [1e8, -0.0, 0.0, 1.0 + 2**-30]
    vectors[20], vectors[21], vectors[30] = [1e12, 1e12, 1.0, 1.0], [2.0**53 + 2, 1.0, 0.3, 0.1], [1.7e308, 0.0, 0.0, 0.0]
    base = inner_product.scaled(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    whole = [[math.floor(x * 64) if abs(x) < 2.0**53 else int(x) * 64 for x in v] for v in vectors]
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    fits = lambda x: x if -(2**63) <= x < 2**63 else None
    wanted = set()
    for q in range(0, 60, 5):
        best = sorted((j for j in range(60) if j != q), key=lambda j: (-score(q, j), j))[:7]
        wanted |= {(q, n + 1, j, fits(score(q, j))) for n, j in enumerate(best)}
    for shard, block in ((20_000, 5_000), (13, 4)):
        assert {tuple(r) for r in inner_product.top_inner_products(base, base.filter("_id % 5 = 0"), 7, shard, block).collect()} == wanted


def test_branches_are_left_out():
    random = np.random.default_rng(3)
    rows = np.concatenate([random.normal(c, 0.1, size=(500, 4)) for c in (-50, 0, 50)])
    tree = inner_product.BallTree(rows, 100)
    assert sorted(tree.order) == list(range(1500)) and len(tree.nodes) > 8
    best = inner_product.search_shard(np.arange(1500), rows, np.array([-1]), np.full((1, 4), 1.0), np.array([-np.inf]), 5)
    assert list(best.ids[0]) == list(np.lexsort((np.arange(1500), -rows.sum(axis=1)))[:5])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=12), st.integers(1, 9), st.sampled_from(["norm", "dot"]))
def test_plans_meet_every_constraint(counts, most, choose):
    room = packing.Room(60, most, 60 * 60 // 2 + 1800, choose=choose)
    bins = collections.defaultdict(list)
    placed = collections.Counter()
    for length, number, count, first, offset in packing.plan(counts, room).tolist():
        assert number == placed[length]
        placed[length] += count
        for s in range(first, first + count):
            bins[s].append((offset, length))
    assert placed == collections.Counter(counts)
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 60 and len(pieces) <= most and sum(n * n for _, n in pieces) <= room.cost


def check_packed(rows, texts, tokenizer):
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    sequences = collections.defaultdict(list)
    covered = collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for k, parts in covered.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == len(ids[k]) and all(n == 2048 for _, _, n in parts[1:])
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert set(covered) == set(texts)
    return len(sequences), -(-sum(map(len, ids.values())) // 2048)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_packing_query(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packed(queries.QUERIES["op9_best_fit_packing"](spark, sf).collect(), texts, tokenizer)
    assert used <= least + 1


def test_packing_odd_rows(spark, tokenizer):
    pieces = lambda docs, **o: packing.encoded_pieces(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, special=packing.special_tokens(public.path("byte_bpe_50k.json")), **o)
    check_packed(packing.pack(pieces(docs_of(spark, ODD))).collect(), dict(enumerate(ODD)), tokenizer)
    assert packing.pack(pieces(docs_of(spark, []))).count() == 0
    twice = docs_of(spark, ODD[:4]).unionByName(docs_of(spark, ODD[:4]))
    assert len({(r["sequence_id"], r["offset"]) for r in packing.pack(pieces(twice, keep_ids=True)).collect()}) == 8


def test_pipeline(spark, sf, tokenizer):
    """run() against the stages' definitions written out plainly."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {k: r["text"] for k, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    last = {}
    for k in sorted(left):
        last[left[k]] = k
    left = {k: t for t, k in last.items()}
    left = {k: left[k] for k, (_, c) in brute(left, 5).items() if c == k}
    finder = pii.Finder(queries.SURROGATE_KEY)
    left = {k: finder.replaced(t)[0] for k, t in left.items()}
    used, least = check_packed(corpus_pipeline.run(spark, sf).collect(), left, tokenizer)
    assert used <= least + 1


def test_stages_of_odd_rows(spark, tmp_path):
    docs = docs_of(spark, ODD)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == docs.columns and out.count() > 0
            out.write.parquet(str(tmp_path / str(number)))
            docs = spark.read.parquet(str(tmp_path / str(number)))
