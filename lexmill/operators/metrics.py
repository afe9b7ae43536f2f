"""Binary classification metrics from one counting pass.

Every figure is derived from the four cells of the confusion matrix, so a corpus of any size is
reduced to one row per group by partial aggregation before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions.labels import label_name
from lexmill.functions.text import shorten
from lexmill.operators.sampling import first_per_bucket
from lexmill.sources.workdir import materialize

CELLS = ("tn", "fp", "fn", "tp")
# Error buckets and the confidence limits of the last two.
FALSE_POSITIVE = "false_positives"
FALSE_NEGATIVE = "false_negatives"
SURE_AND_WRONG = "high_confidence_wrong"
UNSURE_AND_RIGHT = "low_confidence_correct"
BUCKETS = (FALSE_POSITIVE, FALSE_NEGATIVE, UNSURE_AND_RIGHT, SURE_AND_WRONG)
HIGH_CONFIDENCE = 0.9
LOW_CONFIDENCE = 0.6


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """``tn, fp, fn, tp`` per group: rows are the truth, columns the prediction."""

    def cell(truth: int, guess: int, name: str) -> Column:
        return F.count_if((F.col(label) == truth) & (F.col(pred) == guess)).alias(name)

    return df.groupBy(*by).agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))


def matrix() -> Column:
    """The cells as the nested array ``[[tn, fp], [fn, tp]]``."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def _ratio(part: Column, whole: Column) -> Column:
    """Undefined ratios count as zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _class_figures() -> Column:
    """One struct per class, negative first."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)

    def figures(name: str, label: int, hit: Column, false_alarm: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(name).alias("class"),
            _ratio(hit, hit + false_alarm).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + false_alarm + missed).alias("f1"),
            (hit + missed).alias("support"),
            (hit + false_alarm + missed > 0).alias("present"),
        )

    return F.array(figures("negative", 0, tn, fn, fp), figures("positive", 1, tp, fp, fn))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, from confusion cells."""
    rows = cells.select(*by, F.inline(_class_figures()))
    return rows.drop("present")


def _macro(name: str) -> Column:
    present = F.filter("_classes", lambda c: c["present"])
    total = F.aggregate(present, F.lit(0.0), lambda acc, c: acc + c[name])
    return _ratio(total, F.size(present))


def _weighted(name: str) -> Column:
    total = F.aggregate("_classes", F.lit(0.0), lambda acc, c: acc + c[name] * c["support"])
    return _ratio(total, F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))


def summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Size, accuracy and macro precision, recall and F1, from confusion cells.

    The macro mean runs over the classes that occur in the truth or among the predictions.
    """
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cells.withColumn("_classes", _class_figures()).select(
        *by,
        n.alias("n"),
        _ratio(F.col("tn") + F.col("tp"), n).alias("accuracy"),
        *[_macro(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def evaluate(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    return summary(confusion(df, by, label, pred), by)


def evaluate_rollup(df: DataFrame, lang: str = "lang", by: Sequence[str] = (), total: str = "ALL") -> DataFrame:
    """Metrics per language and, under ``total``, pooled over all of them.

    The pooled row adds up the per-language cells; the corpus is counted once.
    """
    cells = confusion(df, [*by, lang])
    sums = [F.sum(c).alias(c) for c in CELLS]
    level = F.grouping(lang).alias("_level")
    if by:
        per = cells.withColumn("_level", F.lit(0))
        pooled = cells.groupBy(*by).agg(*sums).withColumn(lang, F.lit(None).cast("string")).withColumn("_level", F.lit(1))
        rolled = per.unionByName(pooled)
    else:
        rolled = cells.rollup(lang).agg(*sums, level)
    named = rolled.withColumn(lang, F.when(F.col("_level") == 1, total).otherwise(F.col(lang)))
    return summary(named.filter(F.col("tn").isNotNull()), [*by, lang])


def report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Classification report: one row per class, accuracy, macro and weighted averages."""
    measured = cells.withColumn("_classes", _class_figures()).withColumn(
        "_n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    )
    accuracy = _ratio(F.col("tn") + F.col("tp"), F.col("_n"))

    def line(name: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("_n").alias("support"),
        )

    classes = F.transform(
        F.filter("_classes", lambda c: c["present"]),
        lambda c: F.struct(c["class"].alias("row"), c["precision"], c["recall"], c["f1"], c["support"]),
    )
    rest = F.array(
        line("accuracy", accuracy, accuracy, accuracy),
        line("macro avg", _macro("precision"), _macro("recall"), _macro("f1")),
        line("weighted avg", _weighted("precision"), _weighted("recall"), _weighted("f1")),
    )
    return measured.select(*by, F.inline(F.concat(classes, rest)))


def error_buckets(label: Column, pred: Column, confidence: Column) -> Column:
    """Names of the buckets a scored row belongs to; a sure mistake is in two of them."""
    wrong = label != pred
    return F.filter(
        F.array(
            F.when((pred == 1) & (label == 0), FALSE_POSITIVE),
            F.when((pred == 0) & (label == 1), FALSE_NEGATIVE),
            F.when(wrong & (confidence > HIGH_CONFIDENCE), SURE_AND_WRONG),
            F.when(~wrong & (confidence < LOW_CONFIDENCE), UNSURE_AND_RIGHT),
        ),
        lambda name: name.isNotNull(),
    )


def _bucketed(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    buckets = error_buckets(F.col("label"), F.col("pred"), F.col("confidence"))
    return scored.select(*columns, F.explode(buckets).alias("bucket"))


def error_samples(
    scored: DataFrame, texts: DataFrame, n: int = 50, key: str = "doc_id", text: str = "text", text_limit: int = 200
) -> DataFrame:
    """The first ``n`` rows of every error bucket with the uncleaned text, cut to ``text_limit``.

    The rows are chosen by key alone and written once, so that the optimizer knows how few they are
    and joins them to the scan of the texts by its own threshold. Runs a job.
    """
    listed = first_per_bucket(_bucketed(scored, [key, "label", "pred", "confidence"]), "bucket", n, key)
    shown = texts.select(key, shorten(F.col(text), text_limit).alias("text"))
    found = shown.join(materialize(listed, "samples"), key)
    return found.select(
        "bucket", "rn", key, "text",
        label_name(F.col("label")).alias("true_label"),
        label_name(F.col("pred")).alias("predicted"),
        "confidence",
    )


def error_counts(scored: DataFrame, n: int = 50) -> DataFrame:
    """Rows per bucket: all of them, and as many as the sample listing shows."""
    counted = _bucketed(scored, []).groupBy("bucket").agg(F.count("*").alias("true_n"))
    return counted.withColumn("capped_n", F.least(F.col("true_n"), F.lit(n).cast("long")))
