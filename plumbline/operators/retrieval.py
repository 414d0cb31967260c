"""Document chunks and formatted search results."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fixed
from plumbline.operators.neighbours import search
from plumbline.plans.roles import quoted

# Texts split before their chunks are sent on.
_SPLIT_ROWS = 256


def chunk_windows(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP,
) -> DataFrame:
    """(keep..., chunk_no, chunk): fixed windows over whole texts, each ``overlap`` into the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    body = F.col(quoted(text))
    # The text is cut into steps once; a window is a step and what it needs of the steps after it.
    step = size - overlap
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    joined = pieces
    for later in range(1, -(-size // step)):
        joined = F.zip_with(joined, F.slice(pieces, later + 1, F.length(body)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    count = F.floor(F.greatest(F.lit(0), F.length(body) - (overlap + 1)) / step).cast("int") + 1
    chunks = F.transform(F.slice(joined, 1, count), lambda c: F.left(c, F.lit(size)))
    return df.filter(F.length(body) > 0).select(*keep, F.posexplode(chunks).alias("chunk_no", "chunk"))


def _pieces(text: str, low: int, high: int, separators: Sequence[str], size: int) -> Iterator[tuple[int, int, bool]]:
    """Spans covering text[low:high]; the flag marks spans too long for a chunk that nothing can split.

    A separator stays at the start of the span after it. Spans of ``size`` or more are split again by the
    finer separators.
    """
    for level, sep in enumerate(separators):
        if not sep or text.find(sep, low, high) >= 0:
            break
    else:
        yield low, high, True
        return
    if not sep:
        yield from ((i, i + 1, False) for i in range(low, high))
        return
    marks = [low]
    at = text.find(sep, low, high)
    while at >= 0:
        marks.append(at)
        at = text.find(sep, at + len(sep), high)
    marks.append(high)
    for a, b in zip(marks, marks[1:]):
        if a == b:
            continue
        if b - a < size:
            yield a, b, False
        else:
            yield a, b, True


def _pack(spans: Sequence[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy runs of neighbouring spans up to ``size`` long, each starting within ``overlap`` of the last end."""
    window: deque[tuple[int, int]] = deque()
    held = 0
    for a, b in spans:
        length = b - a
        if window and held + length > size:
            yield window[0][0], window[-1][1]
            while window and (held > overlap or held + length > size):
                gone = window.popleft()
                held -= gone[1] - gone[0]
        window.append((a, b))
        held += length
    if window:
        yield window[0][0], window[-1][1]


def _chunk_spans(text: str, low: int, high: int, separators: Sequence[str], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    short: list[tuple[int, int]] = []
    used = next((i for i, s in enumerate(separators) if not s or text.find(s, low, high) >= 0), len(separators))
    finer = separators[used + 1 :]
    for a, b, long_ in _pieces(text, low, high, separators, size):
        if not long_:
            short.append((a, b))
            continue
        yield from _pack(short, size, overlap)
        short = []
        if finer:
            yield from _chunk_spans(text, a, b, finer, size, overlap)
        else:
            yield a, b
    yield from _pack(short, size, overlap)


def split_text(
    text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP,
    separators: Sequence[str] = tuple(fixed.CHUNK_SEPARATORS),
) -> list[str]:
    """Chunks of one text along the coarsest separators that fit; outer whitespace is stripped."""
    return [text[a:b] for a, b in split_spans(text, size, overlap, separators)]


def split_spans(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[tuple[int, int]]:
    """Where the chunks of a text start and end."""
    spans = []
    for a, b in _chunk_spans(text, 0, len(text), separators, size, overlap):
        chunk = text[a:b]
        start = b - len(chunk.lstrip())
        stop = a + len(chunk.rstrip())
        if start < stop:
            spans.append((start, stop))
    return spans


def chunk_recursive(
    df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP,
    separators: Sequence[str] = tuple(fixed.CHUNK_SEPARATORS),
) -> DataFrame:
    """(keep..., chunk_no, start, chunk): separator-aware chunks of whole texts and where they start, Arrow batches in, no shuffle."""
    source = df.select(*keep, F.col(quoted(text)).alias("_text")).filter(F.col("_text").isNotNull())
    kinds = ", ".join(f"{quoted(c)} {source.schema[c].dataType.simpleString()}" for c in keep)
    keep = list(keep)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), _SPLIT_ROWS):
                part = batch.iloc[start : start + _SPLIT_ROWS]
                spans = part["_text"].map(lambda t: split_spans(t, size, overlap, separators))
                out = part.assign(chunk_no=spans.map(lambda s: list(range(len(s)))), span=spans)
                out = out[spans.map(len) > 0].explode(["chunk_no", "span"])
                if not len(out):
                    continue
                out = out.assign(chunk=[t[a:b] for t, (a, b) in zip(out["_text"], out["span"])], start=[a for a, _ in out["span"]])
                yield out.astype({"chunk_no": "int32", "start": "int64"})[[*keep, "chunk_no", "start", "chunk"]]

    return source.mapInPandas(split, f"{kinds}, chunk_no int, start long, chunk string")


def format_results(hits: DataFrame, text: str = "chunk", category: str = "category", api_name: str = "api_name",
                   keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., formatted): one entry per hit, unknown labels named as such."""
    label = lambda c: F.coalesce(F.col(quoted(c)), F.lit(fixed.UNKNOWN_LABEL))
    entry = F.concat(
        F.lit("- API: "), label(api_name), F.lit(" (分类: "), label(category), F.lit(")\n  描述: "),
        F.coalesce(F.col(quoted(text)), F.lit("")),
    )
    return hits.select(*keep, entry.alias("formatted"))


def retrieve(
    corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str = "embedding", text: str = "chunk",
    category: str = "category", api_name: str = "api_name",
) -> DataFrame:
    """(query_id, rank, formatted): the k chunks of ``corpus`` nearest to each query as entries, nearest first."""
    hits = search(corpus, queries, k, corpus_id, query_id, vector).drop("distance")
    chunks = corpus.select(F.col(quoted(corpus_id)).alias("id"), *[F.col(quoted(c)) for c in (text, category, api_name)])
    return format_results(hits.join(chunks, "id"), text, category, api_name, keep=["query_id", "rank"])


def retrieval_text(formatted: DataFrame, order: str = "rank") -> str:
    """One text from all hits of a single search, nearest first; the search's k bounds them."""
    rows = formatted.orderBy(order).collect()
    return fixed.SEARCH_HEADER + "\n" + "\n".join(r["formatted"] for r in rows)
