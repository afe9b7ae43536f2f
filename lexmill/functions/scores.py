"""Scores, confidence bands, rounding and schedules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexmill.functions.text import bind


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def argmax(values: Column) -> Column:
    """Position of the largest element, the first one on ties, counted from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    def normalise(exps: Column) -> Column:
        return bind(
            F.aggregate(exps, F.lit(0.0), lambda total, x: total + x),
            lambda total: F.transform(exps, lambda x: x / total),
        )

    shifted = bind(
        logits.cast("array<double>"),
        lambda seq: bind(F.array_max(seq), lambda top: F.transform(seq, lambda x: F.exp(x - top))),
    )
    return bind(shifted, normalise)


def confidence_phrase(score: Column) -> Column:
    return (
        F.when(score > 0.9, "very high confidence")
        .when(score > 0.7, "high confidence")
        .when(score > 0.5, "moderate confidence")
        .otherwise("low confidence")
    )


def confidence_emoji(label: Column, score: Column) -> Column:
    # Faces per band, positive and negative.
    positive = F.when(score > 0.9, "😄").when(score > 0.7, "🙂").otherwise("😐")
    negative = F.when(score > 0.9, "😢").when(score > 0.7, "😕").otherwise("😐")
    return F.when(F.lower(label) == "positive", positive).otherwise(negative)


def round_tenth(value: Column) -> Column:
    """Nearest tenth of the exact binary value, ties to even, as ``'%.1f'`` prints it.

    Spark's own rounding starts from the shortest decimal form, which turns 0.35 (stored just
    below) into a tie. The distance to the middle of the two candidate tenths is taken without
    rounding error: 16v and 4v are exact, and the error of their sum is recovered.
    """
    low = F.floor(value * 10.0).cast("double")
    a, b = value * 16.0, value * 4.0
    total = a + b
    part = total - a
    error = (a - (total - part)) + (b - part)
    distance = (total - (low * 2.0 + 1.0)) + error
    up = (distance > 0) | ((distance == 0) & (F.abs(low % 2.0) == 1.0))
    return (F.when(up, low + 1.0).otherwise(low)) / 10.0


def percent(share: Column) -> Column:
    """Share as a percentage with one decimal."""
    return round_tenth(F.lit(100.0) * share)


def percent_cell(mean: Column, std: Column, runs: Column) -> Column:
    """``65.0 ± 7.1``, without the second part for a single run, ``-`` when missing."""
    text = percent(mean).cast("string")
    spread = F.concat(text, F.lit(" ± "), percent(std).cast("string"))
    return F.when(mean.isNull(), "-").when(runs > 1, spread).otherwise(text)


def signed_percent(difference: Column) -> Column:
    """``+1.6``, ``-0.0``, ``-`` when missing."""
    size = F.abs(percent(difference)).cast("string")
    return F.when(difference.isNull(), "-").otherwise(F.concat(F.when(difference < 0, "-").otherwise("+"), size))


def scheduled_epochs(examples: Column, batch_size: int, epochs: int, min_steps: int) -> Column:
    """``epochs``, or as many more as it takes to reach ``min_steps`` steps."""
    needed = F.ceil(F.lit(float(min_steps)) / steps_per_epoch(examples, batch_size))
    return F.greatest(F.lit(epochs).cast("long"), needed)


def steps_per_epoch(examples: Column, batch_size: int) -> Column:
    return F.ceil(examples.cast("double") / float(batch_size))
