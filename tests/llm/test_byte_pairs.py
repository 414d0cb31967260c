import hashlib

import pytest
import public_tokenizers as public
import tiktoken
from hypothesis import given, settings, strategies as st

from plumbline.llm import byte_pairs, queries
from tests.llm.helpers import ODD, docs_of

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.Codec(byte_pairs.load_ranks(open(PATH, "rb").read()), public.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_like_the_library(codec, library):
    for text in [t for t in ODD if t] + ["a" * 3000, "  \n \n x", "🎉👩‍👩‍👧 é"]:
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(max_size=10), st.data())
def test_appends_and_edits_equal_new_tables(codec, data, more, draw):
    start = draw.draw(st.integers(0, len(data)))
    stop = draw.draw(st.integers(start, len(data)))
    table = byte_pairs.PrefixTable(codec, data)
    table.replace(start, stop, more)
    edited = data[:start] + more + data[stop:]
    assert table.data == edited and table.ids() == byte_pairs.PrefixTable(codec, edited).ids()
    table.append(data)
    assert table.ids() == byte_pairs.PrefixTable(codec, edited + data).ids()


def test_an_edit_is_mended_near_its_place(codec):
    data = b"the quick brown fox jumps over the lazy dog " * 40
    table = byte_pairs.PrefixTable(codec, data)
    done = table.replace(900, 905, b"house")
    assert done < 200 and table.ids() == byte_pairs.PrefixTable(codec, data[:900] + b"house" + data[905:]).ids()


def test_caches_that_fill_up_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT_PIECES", 5)
    monkeypatch.setattr(byte_pairs, "KEPT_BORDERS", 5)
    fresh = byte_pairs.Codec(codec.ranks, public.PATTERN)
    text = "some words repeat and some words do not, thhehaed oronea " * 5
    assert fresh.encode(text) == library.encode_ordinary(text)


def test_columns(spark, library):
    rows = byte_pairs.round_trip(docs_of(spark, ODD), PATH, public.PATTERN).collect()
    for row in rows:
        text = ODD[row["doc_id"]] or ""
        assert row["ids"] == library.encode_ordinary(text) and bytes(row["decoded"]) == text.encode() and row["source"] == "s"
    assert [r["ids"] for r in byte_pairs.encoded(docs_of(spark, ODD), PATH, public.PATTERN).orderBy("doc_id").collect()] == [r["ids"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert byte_pairs.round_trip(docs_of(spark, []), PATH, public.PATTERN).count() == 0


def test_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = queries.QUERIES["op1_byte_pairs"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row["doc_id"]])
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(texts[row["doc_id"]].encode()))
