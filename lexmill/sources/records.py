"""Run records as JSON: metrics per run, learning-curve runs, training histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The fields of a run's metrics record, with one entry per test language.
METRICS = "STRUCT<n: BIGINT, accuracy: DOUBLE, precision: DOUBLE, recall: DOUBLE, f1: DOUBLE, confusion_matrix: ARRAY<ARRAY<BIGINT>>>"
RUN_SCHEMA = f"model STRING, train_samples BIGINT, best_val_f1 DOUBLE, test MAP<STRING, {METRICS}>"
CURVE_SCHEMA = f"positive_share DOUBLE, epochs BIGINT, steps BIGINT, test MAP<STRING, {METRICS}>"
# The fields of a training history; each row fills some of them.
HISTORY_SCHEMA = (
    "epoch DOUBLE, step BIGINT, loss DOUBLE, learning_rate DOUBLE, grad_norm DOUBLE, "
    "eval_loss DOUBLE, eval_accuracy DOUBLE, eval_precision DOUBLE, eval_recall DOUBLE, eval_f1 DOUBLE, "
    "train_loss DOUBLE, train_runtime DOUBLE"
)


# A run's folder is named by its mode; under it there may be one folder for each seed.
MODE = r"/(?:mode=)?([^/=]+)(?:/seed=?[0-9]+)?/[^/]+$"
SEED = r"/seed=?([0-9]+)/[^/]+$"


def _path_part(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _read(spark: SparkSession, root: str, schema: str, file_glob: str) -> DataFrame:
    """All matching files under ``root``, one record each, pretty-printed or not."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_glob)
        .json(root)
    )


def read_runs(spark: SparkSession, root: str, file_glob: str = "*.json") -> DataFrame:
    """``mode, seed, model, train_samples, lang, n, accuracy, ...`` of all records under ``root``.

    A record lies in ``<mode>/seed<seed>/``, or in ``<mode>/`` if its run has no seed, which is then
    NULL; both may lie in any folder below ``root``. Folders may also be partition folders (``mode=.../seed=...``). Missing runs give no rows.
    """
    runs = _read(spark, root, RUN_SCHEMA, file_glob).select(
        _path_part(MODE).alias("mode"),
        _path_part(SEED).try_cast("int").alias("seed"),
        "model", "train_samples", "best_val_f1",
        F.explode("test").alias("lang", "_m"),
    )
    return runs.select(*[c for c in runs.columns if c != "_m"], "_m.*")


def read_curve_runs(spark: SparkSession, root: str, file_glob: str = "*.json") -> DataFrame:
    """``condition, size, seed, positive_share, epochs, steps, lang, n, ...`` of all curve runs.

    Layout ``<condition>/n<size>/seed<seed>.json`` or partition folders.
    """
    runs = _read(spark, root, CURVE_SCHEMA, file_glob).select(
        _path_part(r"/(?:condition=)?([^/=]+)/(?:n|size=)[0-9]+/seed").alias("condition"),
        _path_part(r"/(?:n|size=)([0-9]+)/seed").try_cast("int").alias("size"),
        _path_part(r"/seed=?([0-9]+)[./]").try_cast("int").alias("seed"),
        "positive_share", "epochs", "steps",
        F.explode("test").alias("lang", "_m"),
    )
    return runs.select(*[c for c in runs.columns if c != "_m"], "_m.*")


def read_history(spark: SparkSession, root: str, file_glob: str = "*.json") -> DataFrame:
    """Training rows of all runs under ``root`` with ``mode`` and ``seed`` of their folder.

    A history is an array of rows that fill different fields; absent ones are NULL.
    """
    log = _read(spark, root, HISTORY_SCHEMA, file_glob)
    return log.select(
        _path_part(MODE).alias("mode"),
        _path_part(SEED).try_cast("int").alias("seed"),
        "*",
    )


def write_history(log: DataFrame, root: str, by: list[str], order: str = "step", mode: str = "error") -> None:
    """One JSON array per run under partition folders ``by``; a row holds its own fields only.

    A history has one row per logged step of a run and becomes one file.
    """
    fields = [c for c in log.columns if c not in by]
    rows = F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    arrays = log.groupBy(*by).agg(F.to_json(rows).alias("value"))
    arrays.write.mode(mode).partitionBy(*by).text(root)


def nested_records(runs: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Long metrics rows folded into one record per run, its languages in a map.

    ``carry`` names figures of the run as a whole, the same in all its rows.
    """
    fields = ["n", "accuracy", "precision", "recall", "f1", "confusion_matrix"]
    entry = F.struct("lang", F.struct(*[f for f in fields if f in runs.columns]).alias("m"))
    carried = [F.max(c).alias(c) for c in carry]
    return runs.groupBy(*by).agg(*carried, F.map_from_entries(F.collect_list(entry)).alias("test"))


def write_runs(runs: DataFrame, root: str, by: list[str], carry: list[str], mode: str = "error") -> None:
    """One JSON record per run under partition folders ``by``."""
    records = nested_records(runs, by, carry).repartition(*by)
    records.write.mode(mode).partitionBy(*by).json(root)
