"""Cleaning and label standardisation of whole frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from lexmill.functions import labels as L, text as X


def _as_text(df: DataFrame, column: str) -> Column:
    """The column if it holds strings; anything else counts as no text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column)
    return F.lit("")


def replace_rows(df: DataFrame, column: str, values: Column) -> DataFrame:
    """One row per element of the array ``values``, which takes the place of ``column``.

    The array stays inside ``explode``: as a named column it would be copied into a filter that
    the optimizer pushes towards the scan, and computed again there.
    """
    made = df.select("*", F.explode(values).alias("_value"))
    return made.select(*[F.col("_value").alias(c) if c == column else F.col(c) for c in df.columns])


def clean_rows(df: DataFrame, text_column: str = "text", drop_empty: bool = True, **switches) -> DataFrame:
    """``df`` with its text cleaned; rows left without text are dropped, other columns kept.

    Dropping is an ``explode`` of a zero- or one-element array. A filter on the cleaned column
    would make the optimizer run every pattern twice, once below and once above the filter.
    """
    cleaned = X.clean_text(_as_text(df, text_column), **switches)
    if not drop_empty:
        return df.withColumn(text_column, cleaned)
    return replace_rows(df, text_column, F.filter(F.array(cleaned), lambda t: t != ""))


def removed_count(df: DataFrame, text_column: str = "text", **switches) -> DataFrame:
    """Rows before and after cleaning, and rows removed, in one pass."""
    kept = X.clean_text(_as_text(df, text_column), **switches) != ""
    counted = df.select(kept.alias("kept")).agg(
        F.count("*").alias("before"), F.count_if("kept").alias("after")
    )
    return counted.withColumn("removed", F.col("before") - F.col("after"))


def clean_rows_counted(df: DataFrame, text_column: str = "text", **switches) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``clean_rows``, and a function that gives rows before, after and removed.

    The rows are counted as they stream through whatever action uses the frame first; the function
    waits for that action, and the data is not looked at again.
    """
    seen, kept = Observation(), Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    rows = clean_rows(rows, text_column, **switches).observe(kept, F.count(F.lit(1)).alias("rows"))

    def counts() -> dict[str, int]:
        before, after = seen.get["rows"], kept.get["rows"]
        return {"before": before, "after": after, "removed": before - after}

    return rows, counts


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"the frame must have a {column!r} column")


def map_labels(df: DataFrame, mapping: Mapping, column: str = "label") -> DataFrame:
    """Labels through a mapping of integers; rows whose label it lacks are dropped.

    Text is no integer, so string labels find no entry; standardise those instead.
    """
    _require(df, column)
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    mapped = L.map_label(F.col(column), mapping) if numeric else F.lit(None).cast("long")
    return df.withColumn(column, mapped).na.drop(subset=[column])


def standardize_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Labels as 0 and 1; neutral and unknown ones are dropped.

    String labels that are plain numbers keep their value. NULL is dropped for every type. A column
    of mixed types is one of VARIANT (``parse_json`` of raw JSON values, or a cast), in which every
    value follows the rule of its own type.
    """
    _require(df, column)
    label = L.standardize_label(F.col(column), df.schema[column].dataType)
    return df.withColumn(column, label.cast("long")).na.drop(subset=[column])


def split_lines(df: DataFrame, text_column: str = "text") -> DataFrame:
    """One row per non-blank line, with its 0-based number among them."""
    made = df.select("*", F.posexplode(X.lines(F.col(text_column))).alias("line_no", "_line"))
    rest = [F.col(c) for c in df.columns if c != text_column]
    return made.select(*rest, F.col("line_no"), F.col("_line").alias(text_column))
