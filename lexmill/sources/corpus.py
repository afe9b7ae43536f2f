"""Reading and writing labelled corpora.

A corpus is one frame with a key, ``text``, ``label``, ``lang`` and ``split``; language and split
are partition columns on disk, so asking for one of them reads only its files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from lexmill.operators.cleaning import clean_rows, map_labels, standardize_labels
from lexmill.operators.sampling import holdout_split, stratified_split
from lexmill.sources.workdir import materialize

SPLIT_SCHEMA = "text STRING, label INT"
# Texts hold line breaks, quotes and spaces at the ends; all of them survive the round trip.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\n",
    # Columns are matched by position; a header that names others is an error.
    "enforceSchema": "false",
}


SCAN_TASKS = "spark.lexmill.scanTasks"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan dealt out over as many tasks as the setting ``spark.lexmill.scanTasks`` says.

    Unset, as it should be on large inputs, rows stay where the scan has them. The setting is for
    a single small file, which cannot be split and would keep one core busy.
    """
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks), key) if tasks else df


def rename_columns(df: DataFrame, text: str, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """A raw source's own column names as ``text`` and ``label``."""
    return df.select(*keep, F.col(text).alias("text"), F.col(label).alias("label"))


def read_csv(spark: SparkSession, path: str, schema: str = SPLIT_SCHEMA) -> DataFrame:
    """CSV with a header and a given schema. Only empty fields are missing; "null" is a text."""
    try:
        return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    except AnalysisException as error:
        raise _missing(error, path) from error


def _missing(error: AnalysisException, path: str) -> Exception:
    if error.getCondition() == "PATH_NOT_FOUND":
        return FileNotFoundError(f"no data at {path}")
    return error


def read_split(
    spark: SparkSession, root: str, lang: str, split: str = "train", schema: str = SPLIT_SCHEMA, fmt: str = "csv"
) -> DataFrame:
    """One language and split with its partition columns; ``FileNotFoundError`` if it is not there."""
    path = f"{root}/lang={lang}/split={split}"
    reader = spark.read.schema(schema).option("basePath", f"{root}")
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    partitions = [F.lit(lang).alias("lang"), F.lit(split).alias("split")]
    try:
        data = reader.format(fmt).load(path)
    except AnalysisException as error:
        raise _missing(error, path) from error
    return data.select(*[c for c in data.columns if c not in ("lang", "split")], *partitions)


def read_files(spark: SparkSession, root: str, lang: str = "*", split: str = "*", schema: str = SPLIT_SCHEMA) -> DataFrame:
    """Plain files ``<lang>/<split>.csv`` as one frame; language and split come from the path.

    ``*`` takes whatever there is; a named file that is missing is a ``FileNotFoundError``.
    """
    path = F.col("_metadata.file_path")
    rows = read_csv(spark, f"{root}/{lang}/{split}.csv", schema)
    return rows.select(
        *rows.columns,
        F.regexp_extract(path, r"/([^/]+)/[^/]+\.csv$", 1).alias("lang"),
        F.regexp_extract(path, r"/([^/]+)\.csv$", 1).alias("split"),
    )


#: Equal rows that one task numbers.
COPIES = 100_000


def with_key(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A unique key for rows that have none, made from their content; the same however rows are dealt out.

    The key is the md5 of the row and its number among equal rows. Equal rows are counted, not
    gathered, and a row that occurs very often is numbered in stretches of ``COPIES`` by many tasks.
    Columns of map type are not supported. The rows are written once; runs a job.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    stretch = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"), F.lit(COPIES).cast("long"))).alias("_from")
    dealt = counted.select(*columns, "_copies", stretch).repartition(*columns, "_from")
    last = F.least(F.col("_from") + COPIES - 1, F.col("_copies"))
    numbered = dealt.select(*columns, F.explode(F.sequence(F.col("_from"), last)).alias("_number"))
    content = F.concat_ws("|", F.col("_number").cast("string"), F.to_json(F.struct(*columns)))
    return materialize(numbered.select(F.md5(content.cast("binary")).alias(key), *columns), "keyed")


@dataclass(frozen=True)
class Checked:
    """The rows of CSV files that fit the schema, and the records that do not, as they stand in the file.

    ``rows`` has the schema's columns and ``file``; ``malformed`` has ``file, record``.
    """

    rows: DataFrame
    malformed: DataFrame

    def counts(self) -> DataFrame:
        """``file, good, malformed``: together the records of each file."""
        good, bad = (df.select("file", F.lit(v).alias("_good")) for df, v in ((self.rows, 1), (self.malformed, 0)))
        return good.unionByName(bad).groupBy("file").agg(F.count_if(F.col("_good") == 1).alias("good"), F.count_if(F.col("_good") == 0).alias("malformed"))


def read_checked(spark: SparkSession, path: str, schema: str = SPLIT_SCHEMA) -> Checked:
    """CSV files taken apart into rows that fit the schema and malformed records; nothing is lost silently.

    Malformed are records with too few or too many fields and those whose value does not fit its
    type. An empty field is a missing value, not a fault. The files are read once and both parts
    come from the table written then; runs a job.
    """
    try:
        raw = spark.read.schema(f"{schema}, _record STRING").options(**CSV_OPTIONS).option("columnNameOfCorruptRecord", "_record").csv(path)
    except AnalysisException as error:
        raise _missing(error, path) from error
    columns = [c for c in raw.columns if c != "_record"]
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file")
    kept = materialize(raw.select("*", file), "checked-csv")
    return Checked(
        kept.filter(F.col("_record").isNull()).select(*columns, "file"),
        kept.filter(F.col("_record").isNotNull()).select("file", F.regexp_replace("_record", r"\n\z", "").alias("record")),
    )


def write_quarantine(malformed: DataFrame, root: str) -> None:
    """Malformed records beside a corpus, by file; reading a file again replaces what it left before.

    The folder's name begins with an underscore, which readers of the corpus pass over.
    """
    _by_folder(malformed, "overwrite", "file").parquet(f"{root}/_quarantine")


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("record STRING, file STRING").parquet(f"{root}/_quarantine")


def read_corpus(spark: SparkSession, root: str, schema: str = SPLIT_SCHEMA, fmt: str = "csv") -> DataFrame:
    """All languages and splits; a language or split that is absent yields no rows."""
    reader = spark.read.schema(f"{schema}, lang STRING, split STRING")
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    try:
        return reader.format(fmt).load(root)
    except AnalysisException as error:
        raise _missing(error, root) from error


def _by_folder(df: DataFrame, mode: str, *folders: str) -> DataFrameWriter:
    """A writer that overwrites the folders it has rows for and leaves the others as they are."""
    return df.hint("rebalance", *folders).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*folders)


def write_corpus(df: DataFrame, root: str, columns: Sequence[str] | None = ("text", "label"), fmt: str = "csv", mode: str = "error") -> None:
    """Write by language and split; ``columns=None`` keeps every column.

    With ``mode="overwrite"`` the languages and splits that ``df`` has are replaced and all others
    stay, so a language can be added or written again by itself, and a rerun leaves the same rows.

    Rows of a folder are brought together first, so that not every task adds a file to every
    folder; adaptive execution divides a folder that holds much of the data into several files.
    """
    chosen = df if columns is None else df.select(*columns, "lang", "split")
    writer = _by_folder(chosen, mode, "lang", "split").format(fmt)
    if fmt == "csv":
        writer = writer.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"})
    writer.save(root)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines in UTF-8, non-ASCII characters kept as they are."""
    df.write.mode(mode).json(path)


def holdout_source(
    labelled: DataFrame, given_test: DataFrame, fraction: float = 0.05, seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """A source whose labelled validation part becomes the test split.

    Validation data is held out of the training part, classes in proportion.
    """
    parts = holdout_split(labelled, fraction, seed, key)
    return parts.unionByName(given_test.withColumn("split", F.lit("test")))


def mapped_source(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """A source with its own splits and labels: labels mapped, unmapped classes dropped."""
    return map_labels(raw, mapping)


def raw_source(
    raw: DataFrame, languages: Sequence[str] | None = None, seed: int = 42, key: str = "doc_id", **ratios
) -> DataFrame:
    """Raw labels and texts made ready: labels standardised, texts cleaned, rows split 80/10/10.

    The cleaned rows are written once, because splitting looks at their keys more than once.
    """
    rows = raw if languages is None else raw.filter(F.col("lang").isin(*languages))
    ready = materialize(clean_rows(standardize_labels(rows)), "clean")
    return stratified_split(ready, seed=seed, key=key, **ratios)
