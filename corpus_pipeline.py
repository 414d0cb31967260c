"""From raw documents to packed sequences: language, exact copies, near copies, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each result is written as Parquet and read again as the next stage's documents.
A stage keeps the columns of its documents, but for the last, which returns one row per packed piece.

- language: documents without a letter (null, empty or only digits and signs) go
- exact copies: of identical texts the row with the largest id stays
- near copies: of every component of texts that share 80 % of their shingles of five words the row with the smallest id stays; texts without words stay
- surrogates: personal data is replaced; no document goes
- packing: every document left is packed into sequences of at most 2048 tokens
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import exact_copies, language, near_copies, packing, pii
from plumbline.llm.queries import SURROGATE_KEY, tokenizers
from plumbline.session import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_copies.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.without_near_copies(docs)


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows a text that was changed."""
    made = pii.replace_distinctly(docs, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        made = made.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return made.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    public = tokenizers()
    special = packing.special_tokens(public.path("byte_bpe_50k.json"))
    return packing.pack(packing.encoded_pieces(docs.select("doc_id", "text"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, special=special))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact copies", exact_stage),
    ("near copies", near_stage),
    ("surrogates", surrogate_stage),
    ("packing", packing_stage),
]

# Scores, hashes of shingles, keyed permutations and token ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
