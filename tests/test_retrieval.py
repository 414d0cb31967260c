import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import neighbours, pivots, retrieval, sequences


def brute(base, probes, k):
    out = {}
    for pid, p in probes:
        d = sorted((float(np.sqrt(((np.array(b, float) - np.array(p, float)) ** 2).sum())), bid) for bid, b in base)
        out[pid] = [bid for _, bid in d[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors; a third of the base rows are copies of one vector."""
    rng = np.random.default_rng(2)
    base = [(i, (rng.normal(size=4) + 8 * (i % 4)).astype("float32").tolist()) for i in range(400)]
    base = [(i, base[0][1] if i % 3 == 0 else v) for i, v in base]
    probes = [(1000 + i, (rng.normal(size=4) + 8 * (i % 5)).astype("float32").tolist()) for i in range(60)]
    schema = "id bigint, embedding array<float>"
    return spark.createDataFrame(base, schema).cache(), spark.createDataFrame(probes, schema).cache(), base, probes


def ranked(df):
    pdf = df.toPandas().sort_values(["query_id", "rank"])
    return {q: list(part["id"]) for q, part in pdf.groupby("query_id")}


def test_search_is_exact(vectors):
    corpus, queries, base, probes = vectors
    assert ranked(neighbours.search(corpus, queries, 7, "id", "id")) == brute(base, probes, 7)
    assert neighbours.search(corpus, queries.filter("false"), 7, "id", "id").count() == 0
    assert neighbours.search(corpus.limit(3), queries, 7, "id", "id").count() == 3 * 60


@pytest.mark.parametrize("block_rows, fan_out", [(20_000, 64), (25, 3), (40, 64)])
def test_join_is_exact(vectors, block_rows, fan_out):
    corpus, queries, base, probes = vectors
    found = neighbours.knn_join(corpus, queries, 5, "id", "id", block_rows=block_rows, fan_out=fan_out)
    assert ranked(found) == brute(base, probes, 5)


def test_the_tree_of_pivots(spark):
    """Leaves are bounded, whatever holds a third of the rows; balls hold their rows; probes see a share of the rows that shrinks as there are more."""
    rng = np.random.default_rng(6)
    seen = {}
    for n in (600, 2400):
        points = rng.normal(size=(n, 3)) * 2 + 10 * rng.integers(0, 4, (n, 1))
        points[: n // 3] = points[0]
        base = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
        index = pivots.build(base, 40, 100, 4)
        leaves = {r["node"]: r for r in index.nodes.filter("leaf").collect()}
        rows = index.rows.collect()
        assert len(rows) == n and all(r["n"] <= 40 or r["radius"] == 0 for r in leaves.values()) and index.levels > 2
        assert all(np.linalg.norm(np.array(r["v"]) - leaves[r["node"]]["v"]) <= leaves[r["node"]]["radius"] + 1e-9 for r in rows)
        asked = spark.createDataFrame([(i, points[-i].tolist()) for i in range(1, 41)], "query_id long, v array<double>")
        routed = pivots.route(index, asked, 3, 20).collect()
        seen[n] = sum(min(leaves[r["node"]]["n"], 40) for r in routed) / 40 / n
    assert seen[2400] < 0.9 * seen[600] and seen[2400] < 0.2


def test_few_leaves_find_most(vectors):
    corpus, queries, base, probes = vectors
    exact = brute(base, probes, 5)
    found = ranked(neighbours.knn_join(corpus, queries, 5, "id", "id", block_rows=30, leaves=4))
    assert sum(len(set(found[q]) & set(exact[q])) for q in exact) >= 0.9 * sum(map(len, exact.values()))


def test_many_queries_take_the_join(vectors, monkeypatch):
    corpus, queries, base, probes = vectors
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    assert ranked(neighbours.search(corpus, queries, 3, "id", "id")) == brute(base, probes, 3)


def test_vectors_alike_in_distance_are_not_sent_to_ever_more_leaves(spark, monkeypatch):
    """No ball turns a probe away in 48 dimensions: what a probe is sent to stays bounded, whatever leaves were asked for, and results are exact."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(1500, 48))
    base = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>").cache()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)  # leaves meet the probes in several blocks
    asked = base.filter("id % 5 = 0")
    index = pivots.build(base.toDF("id", "v"), 10, 300, most_leaves=neighbours.MOST_LEAVES)
    sent = pivots.route(index, asked.toDF("query_id", "v"), 3, 300)
    found = ranked(neighbours.knn_join(base, asked, 3, "id", "id", block_rows=10))
    assert found == brute(list(enumerate(points)), [(i, points[i]) for i in range(0, 1500, 5)], 3)
    assert sent.count() < 300 * 5 * neighbours.MOST_LEAVES


def test_closest_takes_ties_by_id_whatever_is_bounded_first():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, (2500, 4)).astype(float)
    ids = np.array([f"i{x}" for x in rng.permutation(2500)], dtype=object)
    asked = base[:40] + 0.0
    q, b, d = neighbours.closest(asked, base, ids, 30)
    for i in range(40):
        apart = np.sqrt(((base - asked[i]) ** 2).sum(axis=1))
        wanted = sorted(zip(apart, ids))[:30]
        assert list(zip(d[q == i], ids[b[q == i]])) == wanted


def test_a_scan_keeps_a_bounded_number_of_hits(vectors, monkeypatch):
    corpus, queries, base, probes = vectors
    monkeypatch.setattr(neighbours, "KEPT_HITS", 100)
    found = neighbours.search(corpus, queries, 7, "id", "id")
    assert ranked(found) == brute(base, probes, 7)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 5  # 60 queries, 14 a scan


def test_the_tree_keeps_no_second_set_of_workers(spark):
    """Its nodes come from Spark alone: rows given by Python would be read by workers of their own, beside those of the join."""
    base = spark.range(90).select("id", F.array((F.col("id") % 9).cast("double"), F.sqrt("id")).alias("v"))
    index = pivots.build(base, 20, 100, 4)
    assert "RDD" not in index.nodes._jdf.queryExecution().optimizedPlan().toString()
    root = index.nodes.filter("level = 0").first().asDict()
    assert root == {"node": 0, "parent": None, "level": 0, "v": None, "radius": float("inf"), "n": 90, "leaf": False}


def test_a_block_is_held_in_few_copies():
    """Where most rows of a block are candidates, finding the nearest takes no more than a few times the block's own size."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20_000, 64))
    base[:1_000] *= 50  # those that bound the others are far away
    asked, ids = rng.normal(size=(60, 64)), np.arange(20_000)
    tracemalloc.start()
    q, b, d = neighbours.closest(asked, base, ids, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 59):
        apart = np.sqrt(((base - asked[i]) ** 2).sum(axis=1))
        assert list(b[q == i]) == list(apart.argsort(kind="stable")[:5])
    assert most < 7.3 * base.nbytes


def test_vectors_of_arrow_blocks():
    """Rows of a matrix whatever chunks they come in, gaps as NaN; vectors of different length are refused."""
    chunks = [pa.array([[1.0, 2.0], [3.0, None]]), pa.array([[0.0, 0.0], [5.0, 6.0], [7.0, 8.0]])[1:]]
    found = pivots.dense(pa.chunked_array(chunks))
    assert np.array_equal(found, np.array([[1, 2], [3, np.nan], [5, 6], [7, 8]]), equal_nan=True)
    assert pivots.dense(pa.chunked_array([], pa.list_(pa.float64()))).shape == (0, 0)
    with pytest.raises(ValueError):
        pivots.dense(pa.chunked_array([[[1.0, 2.0, 3.0], [4.0]]]))


def test_classify_votes(vectors):
    corpus, queries, base, probes = vectors
    train = corpus.withColumn("y", (F.col("id") % 4).cast("int"))
    found = {r["id"]: r["prediction"] for r in neighbours.knn_classify(train, queries, "y", "id", block_rows=50).collect()}
    for pid, near in brute(base, probes, 5).items():
        votes = pd.Series([i % 4 for i in near]).value_counts()
        assert found[pid] == min(votes[votes == votes.max()].index)


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, "x" * 700), (2, "short"), (3, ""), (4, None), (5, "y" * 251)], "doc_id int, text string")
    rows = retrieval.chunk_windows(df).orderBy("doc_id", "chunk_no").collect()
    assert [(r["doc_id"], r["chunk_no"], len(r["chunk"])) for r in rows] == [
        (1, 0, 250), (1, 1, 250), (1, 2, 250), (2, 0, 5), (5, 0, 250), (5, 1, 26)]
    with pytest.raises(ValueError):
        retrieval.chunk_windows(df, size=10, overlap=10)


def test_split_text_by_hand():
    assert retrieval.split_text("short text") == ["short text"]
    assert retrieval.split_text("  \n ") == []
    assert retrieval.split_text("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert retrieval.split_text("aa bb cc dd", 8, 3) == ["aa bb cc", "cc dd"]
    assert retrieval.split_text("one\n\ntwo three four", 9, 0) == ["one", "two", "three", "four"]
    assert retrieval.split_text("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert retrieval.split_text("abcdef", 4, 0, ["\n"]) == ["abcdef"]
    assert retrieval.split_text("ab cdefghijkl mn", 5, 0) == ["ab", "cdef", "ghijk", "l", "mn"]


def test_split_text_covers_everything():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(1, 40))) for _ in range(900)]
    text = "".join(w + rng.choice([" ", "\n", "\n\n", " "]) for w in words) + "".join(rng.choice(list("uvwxyz"), 900))
    chunks = retrieval.split_text(text)
    assert all(0 < len(c) <= 250 for c in chunks)
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - 300))
        assert found >= 0 and text[at:found].strip() == ""
        at = max(at, found + len(c))
    assert text[at:].strip() == ""


def test_chunk_recursive(spark):
    df = spark.createDataFrame([(1, "para one\n\n" + "w " * 200), (2, None), (3, "  ")], "doc_id int, text string")
    rows = retrieval.chunk_recursive(df).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in rows] == retrieval.split_text("para one\n\n" + "w " * 200)
    assert {r["doc_id"] for r in rows} == {1}


def test_formatting(spark):
    df = spark.createDataFrame([(1, "text", None, "n"), (2, "more", "c", None)], "rank int, chunk string, category string, api_name string")
    out = retrieval.format_results(df, keep=["rank"])
    assert [r["formatted"] for r in out.orderBy("rank").collect()] == [
        "- API: n (分类: 未知)\n  描述: text", "- API: 未知 (分类: c)\n  描述: more"]
    assert retrieval.retrieval_text(out).count("\n") == 4


@pytest.fixture(scope="module")
def series(spark):
    """One key holds half of the rows and has ties in the first order column."""
    df = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("k"),
        F.timestamp_seconds(F.col("id") / 10).cast("timestamp_ntz").alias("ts"),
        "id", (F.col("id") * 1.5).alias("x"), (-F.col("id")).alias("y"),
    )
    return df, df.toPandas()


@pytest.mark.parametrize("segment_rows", [5_000_000, 40, 9])
@pytest.mark.parametrize("key", ["k", None])
def test_sequences(series, segment_rows, key):
    df, pdf = series
    steps = 4
    out = sequences.sequence_windows(df, ["ts", "id"], ["x", "y"], "id", steps, key, segment_rows).collect()
    expected = {}
    for _, part in pdf.groupby("k") if key else [(0, pdf)]:
        part = part.sort_values(["ts", "id"])
        values = part[["x", "y"]].astype(float).to_numpy().tolist()
        for i in range(steps, len(part)):
            expected[part["id"].iloc[i]] = values[i - steps : i]
    assert {r["label"]: r["window"] for r in out} == expected and len(out) == len(expected)


def test_default_steps():
    assert sequences.default_steps(42) == 4 and sequences.default_steps(10_000) == 30


@pytest.mark.parametrize("segment_rows", [10_000, 50])
def test_packed_windows_hold_no_copies(spark, segment_rows):
    """The same samples as windows, from at most twice the rows; a key is NULL, one holds a third of the rows, one has too few."""
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"k{i % 7}", i // 2, i, float(i * 37 % 101), None if i % 11 == 0 else i) for i in range(900)] + [("few", 0, 1000, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, t int, id int, x double, y int").repartition(4)
    for steps, pack in ((1, 1), (4, 16), (60, 8)):
        packed = sequences.packed_windows(df, ["t", "id"], ["x", "t"], "y", steps, "k", segment_rows, pack)
        key = lambda r: (r["k"] or "", r["id"])
        found, wanted = sequences.expanded(packed, steps), sequences.sequence_windows(df, ["t", "id"], ["x", "t"], "y", steps, "k")
        assert found.columns == wanted.columns and sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)
        assert packed.select(F.sum(F.size("x"))).first()[0] <= 2 * len(rows)
    assert sequences.expanded(sequences.packed_windows(df.limit(0), ["t"], ["x"], "y", 3), 3).count() == 0
    with pytest.raises(ValueError):
        sequences.packed_windows(df, ["t"], ["x"], "y", 0)
