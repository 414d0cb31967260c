"""Exact copies by progressive refinement: length, then a hash of the first bytes, then a hash of the whole text.

Each step only looks at rows whose group of the step before has a second member: texts without a partner of
equal length or beginning are never hashed in full. Only ids, lengths and hashes are shuffled, never texts.

Texts are equal when identical; null counts as empty, so null and empty texts form one group. The row with
the largest id stays. A null id is smaller than any other. An empty table gives no rows.

Rows that repeat an id and text count as members of their group and share its result: ``exact_copies`` judges ids, so it marks all of them as
kept when theirs is the largest id. ``without_copies`` removes rows: one row of a text stays, whatever ids repeat or are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import BROADCAST_KEYS, body, with_rows, without
from plumbline.session import materialise

BEGINNING = 64


def _hashed(docs: DataFrame, text: str, digest_all: bool, **columns: str) -> DataFrame:
    """For each row of ``docs`` the named columns, the beginning's hash, the digest and whether the beginning is shared."""
    kept = [*columns, "_start"]
    sized = docs.select(
        *(F.col(c).alias(name) for name, c in columns.items()),
        F.octet_length(body(text)).alias("_n"),
        F.xxhash64(F.octet_length(body(text)), F.substring(body(text), 1, BEGINNING)).alias("_start"),
        body(text).alias("_text"),
    )
    # Length, then beginning: one narrow pass; a length with a single row cannot hold a shared beginning.
    starts = sized.groupBy("_n", "_start").agg(F.count("*").alias("_rows"))
    lengths = starts.groupBy("_n").agg(F.sum("_rows").alias("_sized"))
    shared = starts.filter("_rows > 1").join(lengths.filter("_sized > 1"), "_n").select("_start", F.lit(True).alias("_shared"))
    shared = materialise(shared, "shared")
    few = shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    whole = F.sha2(F.col("_text"), 256)
    if few:
        # Full content is hashed in the scan, for rows of surviving groups only.
        told = sized.join(F.broadcast(shared), "_start", "left")
        return told.select(*kept, F.when(F.col("_shared") | F.lit(digest_all), whole).alias("_sha"), F.coalesce("_shared", F.lit(False)).alias("_shared"))
    # Too many groups to send around: hash in the scan and let go of what has no partner, so that texts stay where they are.
    told = sized.select(*kept, whole.alias("_sha")).join(shared, "_start", "left")
    return told.select(*kept, F.when(F.col("_shared") | F.lit(digest_all), F.col("_sha")).alias("_sha"), F.coalesce("_shared", F.lit(False)).alias("_shared"))


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    The digest is null for texts that were told apart before a full hash, unless ``digest_all`` asks for every row's.
    """
    hashed = _hashed(docs, text, digest_all, _id=key)
    groups = hashed.filter("_shared").groupBy(F.col("_sha").alias("_of")).agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    # The rows' side may hold one group with a third of all rows: a plain left join, whose large partitions Spark splits.
    # Rows without a partner keep keys of their own, so that they do not meet in one partition either.
    mark = F.when(F.col("_shared"), F.col("_sha")).otherwise(F.concat(F.lit("-"), F.col("_start").cast("string")))
    joined = hashed.withColumn("_mark", mark).join(groups, F.col("_mark") == F.col("_of"), "left")
    keep = F.when(F.col("_of").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(key), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each text the row with the largest id, of equal ids any one."""
    rows, row = with_rows(docs)
    shared = materialise(_hashed(rows, text, False, _id=key, _row=row).filter("_shared").select("_id", "_row", "_sha"), "shared")
    stay = shared.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_last")).select(F.col("_last._row").alias("_row"))
    gone = materialise(shared.select("_row").join(stay, "_row", "left_anti"), "gone")
    return without(rows, gone, row).select(*docs.columns)
