"""Reading and writing tables, models and document folders."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.config import EngineConfig
from plumbline.functions.lookup import attach, bounded_copy
from plumbline.plans.roles import quoted
from plumbline.session import materialise


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in floating columns becomes NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    cleaned = {c: F.when(~F.isnan(F.col(quoted(c))), F.col(quoted(c))) for c in floats}
    return df.select(*[cleaned[c].alias(c) if c in cleaned else F.col(quoted(c)) for c in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def load_table(
    spark: SparkSession,
    path: str | None = None,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    config: EngineConfig = EngineConfig(),
    normalise_nan: bool = True,
) -> DataFrame:
    """A table from CSV (header, types inferred unless ``schema`` is given) or Parquet.

    Pass ``schema`` for large CSV inputs: inference reads them once more. NaN becomes NULL on the way in;
    for a table known to hold none, ``normalise_nan=False`` lets range filters on floating columns reach
    the scan, which they cannot do through the replacing expression.
    """
    path = path or config.raw_path
    if not _exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    fmt = fmt or ("parquet" if ".parquet" in path else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(fmt).load(path)
    return nan_to_null(df) if normalise_nan else df


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Distributed write; one file per partition, header line for CSV."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def save_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    """Each named result table (label columns included) under ``folder``."""
    return {name: save_table(df, f"{folder.rstrip('/')}/{name}", fmt) for name, df in tables.items()}


def save_model(model, path: str | None = None, config: EngineConfig = EngineConfig()) -> str:
    """A pipeline of Spark's, or any model that saves itself; training rows that are part of a model are written with it."""
    path = path or config.model_path
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:
        model.save(path)
    return path


def load_model(path: str | None = None, config: EngineConfig = EngineConfig()):
    """The model saved at ``path``, ready to transform."""
    path = path or config.model_path
    spark = SparkSession.active()
    if _exists(spark, f"{path}/neighbours"):
        from plumbline.operators.models import NeighbourPipeline

        return NeighbourPipeline.load(spark, path)
    return PipelineModel.load(path)


# Largest file that is read as one document.
LARGEST_DOCUMENT = 1 << 30


def _inside(spark: SparkSession, folder: str) -> Column:
    """The path of a file inside ``folder``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    return F.substring("path", len(whole) + 2, 1 << 20).alias("doc_id")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, n_bytes) of the files of ``folder`` and its subfolders, listed once; ``doc_id`` is the path inside the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(_inside(spark, folder), "path", F.col("length").alias("n_bytes"))


def document_status(spark: SparkSession, folder: str, metadata: DataFrame | Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """One row for every file of ``folder`` and every file that ``metadata`` names: (doc_id, status, reason, n_bytes, text, category, api_name).

    ``status`` is ``read``, ``missing`` (named, but not in the folder), ``unnamed`` (in the folder, but not named; only with metadata, and
    not read) or ``unreadable``: larger than ``LARGEST_DOCUMENT``, lost or broken while it was read, or not UTF-8; ``reason`` says which.
    ``metadata`` has ``file_name`` (a path inside the folder), ``category`` and ``api_name``; of rows that repeat a name the smallest counts. The folder is listed once,
    by Spark's own readers, so it may lie in any store. Texts stay where they were read, unless the list of names is too large to send around.
    Those readers leave out files without a byte: named, they count as missing.
    """
    listed = document_files(spark, folder)
    known = None
    if metadata is not None:
        if not isinstance(metadata, DataFrame):
            rows = [(m["file_name"], m.get("category"), m.get("api_name")) for m in metadata]
            metadata = spark.createDataFrame(rows, "file_name string, category string, api_name string")
        one = metadata.filter("file_name IS NOT NULL").groupBy(F.col("file_name").alias("doc_id")).agg(F.min(F.struct("category", "api_name")).alias("m"))
        known = materialise(one.select("doc_id", "m.category", "m.api_name", F.lit(1).alias("_n")), "manifest")
    labels = [F.lit(None).cast("string").alias(c) for c in ("category", "api_name")]
    named = lambda rows: rows.select("*", *labels) if known is None else attach(rows, known, ["doc_id"], "_n")

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    content = reader.load(folder).filter(F.col("length") <= LARGEST_DOCUMENT).select(_inside(spark, folder), "path", F.col("length").alias("n_bytes"), "content")
    if known is not None:
        names = bounded_copy(known.select("doc_id"))
        content = content.join(known.select("doc_id") if names is None else F.broadcast(names), "doc_id", "left_semi")
    sound = F.is_valid_utf8(F.col("content").cast("string"))
    opened = content.select(
        "doc_id", "path", "n_bytes", F.when(sound, "read").otherwise("unreadable").alias("status"), F.when(~sound, "not UTF-8").alias("reason"),
        F.when(sound, F.col("content").cast("string")).alias("text"),
    )
    opened = materialise(opened, "opened")  # read once for the texts and once for their names
    columns = ["doc_id", "status", "reason", "n_bytes", "text", "category", "api_name"]
    closed = listed.join(opened.select("path"), "path", "left_anti")
    if known is not None:
        closed = closed.join(known.select("doc_id", F.lit(True).alias("_named")), "doc_id", "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
    else:
        closed = closed.withColumn("_named", F.lit(True))
    reason = F.when(F.col("n_bytes") > LARGEST_DOCUMENT, "too large").otherwise("lost or broken")
    closed = closed.select("doc_id", F.when(F.col("_named"), "unreadable").otherwise("unnamed").alias("status"), F.when(F.col("_named"), reason).alias("reason"), "n_bytes", F.lit(None).cast("string").alias("text"))
    found = named(opened.drop("path")).select(columns).unionByName(named(closed).select(columns))
    if known is None:
        return found
    absent = known.join(listed.select("doc_id"), "doc_id", "left_anti")
    absent = absent.select("doc_id", F.lit("missing").alias("status"), F.lit("no such file, or an empty one").alias("reason"), F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("string").alias("text"), "category", "api_name")
    return found.unionByName(absent)


def unread_documents(spark: SparkSession, folder: str, metadata: DataFrame | Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """(doc_id, status, reason) of the files that give no document."""
    return document_status(spark, folder, metadata).filter("status IN ('missing', 'unreadable')").select("doc_id", "status", "reason")


def load_documents(spark: SparkSession, folder: str, metadata: DataFrame | Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """Text files as (doc_id, text, category, api_name), one row per file.

    With ``metadata`` the files it names are taken, without it every file. Files that are missing or cannot be read are
    skipped with one warning that counts them and names a few.
    """
    status = materialise(document_status(spark, folder, metadata), "documents")
    skipped = status.filter("status IN ('missing', 'unreadable')")
    for row in skipped.groupBy("status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).collect():  # two rows at most
        warnings.warn(f"{row['n']} documents {row['status']}, skipped: {row['first']}{' and others' if row['n'] > 1 else ''}", stacklevel=2)
    return status.filter("status = 'read'").select("doc_id", "text", "category", "api_name")
