"""Cleaned text kept on disk under a name that covers source and options.

``cleaned`` trusts the caller's name for a source. ``cleaned_files`` looks at the files of a folder
and cleans those that are new or have changed since.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexmill.operators.cleaning import clean_rows
from lexmill.sources.workdir import materialize, new_path, work_root


def cache_key(source: str, **options) -> str:
    described = json.dumps({"source": source, "options": options}, sort_keys=True)
    return hashlib.sha256(described.encode()).hexdigest()[:32]


def cleaned(df: DataFrame, source: str, text_column: str = "text", **options) -> DataFrame:
    """Cleaned ``df``, read back if the same source was cleaned with the same options before.

    ``source`` names the data and its version; the caller vouches for it.
    """
    spark = df.sparkSession
    name = cache_key(source, text=text_column, schema=df.schema.json(), **options)
    # The entry is one row with the path of the data, written once the data is complete; a write
    # that failed half-way leaves no entry.
    entry = f"{work_root(spark)}/lexmill/cleaned/{name}"
    found = _entry(spark, entry)
    if found is None:
        found = new_path(spark, "cleaned")
        clean_rows(df, text_column, **options).write.parquet(found)
        spark.createDataFrame([(found,)], "path STRING").coalesce(1).write.mode("append").parquet(entry)
    return spark.read.schema(df.schema).parquet(found)


def _entry(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.schema("path STRING").parquet(path).head()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["path"] if row else None


MANIFEST = "_file_id STRING, file STRING, size LONG, modified LONG, _update STRING, at LONG"


def _file_id() -> Column:
    """A file's path, size and time of change as one name; a file written again gets another."""
    parts = F.col("_metadata.file_path"), F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string")
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(_file_id, file, size, modified) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(_file_id().alias("_file_id"), F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def cache_root(spark: SparkSession, path: str, schema: str, text_column: str = "text", fmt: str = "parquet", **options) -> str:
    return f"{work_root(spark)}/lexmill/cleaned-files/{cache_key(path, text=text_column, schema=schema, fmt=fmt, **options)}"


def _manifests(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """All manifests and the number of the last one; every manifest has a row without file, so none is empty."""
    try:
        kept = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, -1
    last = kept.agg(F.max("at")).first()[0]
    return (None, -1) if last is None else (kept, last)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The files a cache holds, and the update that cleaned each; None before the first update."""
    kept, last = _manifests(spark, root)
    return None if kept is None else kept.filter((F.col("at") == last) & F.col("file").isNotNull())


def cleaned_files(spark: SparkSession, path: str, schema: str, text_column: str = "text", fmt: str = "parquet", **options) -> DataFrame:
    """Cleaned rows of the files below the folder ``path``, of which only new and changed ones are cleaned now.

    An update cleans the files that the last manifest lacks into a folder of its own, and then
    writes the next manifest: all files there are, and the update that holds each one's rows.
    Rows count only if the manifest names their file and update, so rows of changed and vanished
    files go, and an update that failed half-way leaves nothing that counts. A folder without
    changes is only listed. ``schema`` may name partition columns of the folder. One update of a
    cache at a time. The driver gets the paths of the files to clean, which the scan of the same
    files needs there too. Runs jobs.
    """
    root = cache_root(spark, path, schema, text_column, fmt, **options)
    listed = materialize(listing(spark, path), "listing")
    known, last = manifest(spark, root), _manifests(spark, root)[1]
    new, gone = listed, None
    if known is not None:
        new, gone = (a.join(b, "_file_id", "left_anti") for a, b in ((listed, known), (known, listed)))
    paths = [r["file"] for r in new.select("file").collect()]
    if known is None or paths or not gone.isEmpty():
        update = uuid.uuid4().hex
        if paths or known is None:
            # Paths are taken as patterns; these are names.
            names = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
            reader = spark.read.schema(schema).format(fmt).option("basePath", path)
            rows = reader.load(names) if names else spark.createDataFrame([], schema)
            tagged = rows.select("*", _file_id().alias("_file_id")) if names else rows.withColumn("_file_id", F.lit(None).cast("string"))
            clean_rows(tagged, text_column, **options).write.parquet(f"{root}/rows/_update={update}")
        entries = new.withColumn("_update", F.lit(update))
        if known is not None:
            entries = entries.unionByName(known.join(listed, "_file_id", "left_semi").select(*entries.columns))
        entries = entries.unionByName(spark.createDataFrame([(None,) * 5], MANIFEST.removesuffix(", at LONG")))
        # A manifest is one file with a row per source file, so it is there whole or not at all.
        entries.coalesce(1).write.parquet(f"{root}/manifest/at={last + 1}")
    held = StructType.fromDDL(schema).add("_file_id", "string").add("_update", "string")
    rows, named = spark.read.schema(held).parquet(f"{root}/rows"), manifest(spark, root)
    return rows.join(named.select("_file_id", "_update"), ["_file_id", "_update"], "left_semi").select(*StructType.fromDDL(schema).names)
