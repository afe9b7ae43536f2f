"""Corpus statistics: sizes, balance, lengths, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions import text as X


def label_counts(label: str = "label") -> list[Column]:
    """Aggregates shared by the reports: rows, positives, negatives."""
    return [
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 1).alias("positive"),
        F.count_if(F.col(label) == 0).alias("negative"),
    ]


def share(part: Column, whole: Column) -> Column:
    """Ratio that is NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole)


def corpus_stats(df: DataFrame, by: Sequence[str] = (), text: str = "text", label: str = "label") -> DataFrame:
    """Rows, class counts, positive share, and length and word-count figures, in one aggregate."""
    measured = df.select(
        *by, label, X.char_count(F.col(text)).alias("_chars"), X.word_count(F.col(text)).alias("_words")
    )
    figures = measured.groupBy(*by).agg(
        *label_counts(label),
        F.avg("_chars").alias("avg_text_length"),
        F.max("_chars").cast("long").alias("max_text_length"),
        F.min("_chars").cast("long").alias("min_text_length"),
        F.avg("_words").alias("avg_word_count"),
        F.max("_words").cast("long").alias("max_word_count"),
    )
    ratio = share(F.col("positive"), F.col("total")).alias("positive_ratio")
    return figures.select(
        *by, "total", "positive", "negative", ratio,
        "avg_text_length", "max_text_length", "min_text_length", "avg_word_count", "max_word_count",
    )


def token_stats(df: DataFrame, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Mean, population deviation, range and exact percentiles of tokens per text.

    The percentile buffers count each distinct length once, so their size is bounded by the
    longest text and not by the number of texts.
    """
    lengths = df.select(*by, F.size(X.tokens(F.col(text))).cast("long").alias("_n"))
    figures = lengths.groupBy(*by).agg(
        F.avg("_n").alias("mean"),
        F.stddev_pop("_n").alias("std"),
        F.min("_n").alias("min"),
        F.max("_n").alias("max"),
        F.percentile("_n", [0.5, 0.95, 0.99]).alias("_marks"),
    )
    marks = [F.col("_marks")[i].alias(name) for i, name in enumerate(["median", "p95", "p99"])]
    return figures.select(*by, "mean", "std", "min", "max", *marks)


def length_sketches(df: DataFrame, by: Sequence[str], text: str = "text", k: int = 800) -> DataFrame:
    """``by, n, sketch``: mergeable quantile sketches (KLL) of the tokens per text.

    Sketches have a bounded size whatever the number of texts, so they can be kept per group and day
    and merged later without the texts. With ``k`` of 800 the rank of a quantile is off by about
    half a hundredth of the texts; ``token_stats`` is the exact form.
    """
    lengths = df.select(*by, F.size(X.tokens(F.col(text))).cast("long").alias("_n"))
    return lengths.groupBy(*by).agg(F.count("_n").alias("n"), F.kll_sketch_agg_bigint("_n", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger groups out of those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_marks(sketches: DataFrame, marks: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row per sketch and mark: ``mark`` and its ``value``, a length that occurs."""
    values = [F.struct(F.lit(float(m)).alias("mark"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(m))).alias("value")) for m in marks]
    return sketches.withColumn("sketch", F.explode(F.array(*values))).select(*[c for c in sketches.columns if c != "sketch"], "sketch.*")


def balance(df: DataFrame, by: Sequence[str] = ("lang", "split"), label: str = "label") -> DataFrame:
    """Class counts and percentages per group."""
    counted = df.groupBy(*by).agg(*label_counts(label))
    return (
        counted.withColumn("pos_pct", 100.0 * share(F.col("positive"), F.col("total")))
        .withColumn("neg_pct", 100.0 * share(F.col("negative"), F.col("total")))
    )


def positive_share(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(label).alias("positive_share"))


def class_weights(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` over the ``k`` classes present in each group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counted = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    weight = F.sum("n").over(group) / (F.count("*").over(group) * F.col("n"))
    return counted.withColumn("weight", weight)
