"""Run records: planning, resuming, averaging over seeds, tables, stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.functions import scores as P

# The grid of the learning curve.
CURVE_SIZES = (100, 250, 500, 1000, 2500, 9681)
CURVE_SEEDS = (42, 43, 44)


def _literals(values: Sequence) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def run_plan(
    train: DataFrame,
    conditions: Sequence[str],
    sizes: Sequence[int] = CURVE_SIZES,
    seeds: Sequence[int] = CURVE_SEEDS,
    batch_size: int = 16,
    epochs: int = 4,
    min_steps: int = 200,
) -> DataFrame:
    """One row per run: condition, size, seed, rows used, epochs and steps.

    ``train`` is counted once; the grid is unfolded from that single row.
    """
    grid = (
        train.select(F.count("*").alias("available")).where(F.col("available") > 0)
        .select("available", _literals([str(c) for c in conditions]).alias("condition"))
        .select("*", _literals([int(s) for s in sizes]).alias("size"))
        .select("*", _literals([int(s) for s in seeds]).alias("seed"))
        .withColumn("examples", F.least(F.col("size").cast("long"), F.col("available")))
    )
    planned = grid.withColumn("epochs", P.scheduled_epochs(F.col("examples"), batch_size, epochs, min_steps))
    steps = F.col("epochs") * P.steps_per_epoch(F.col("examples"), batch_size)
    return planned.select("condition", "size", "seed", "examples", "epochs", steps.alias("steps"))


def pending_runs(plan: DataFrame, finished: DataFrame, on: Sequence[str] = ("condition", "size", "seed")) -> DataFrame:
    """Planned runs that have no record yet."""
    return plan.join(finished.select(*on), list(on), "left_anti")


def spread(value: str) -> Column:
    """Sample standard deviation, zero for a single run."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def seed_summary(runs: DataFrame, by: Sequence[str], value: str, seed: str = "seed") -> DataFrame:
    """Mean and deviation over seeds, number of runs and the sorted seeds."""
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        spread(value).alias("std"),
        F.count(value).alias("runs"),
        F.sort_array(F.collect_set(seed)).alias("seeds"),
    )


def collect_results(runs: DataFrame, by: Sequence[str] = ("mode", "lang")) -> DataFrame:
    """Accuracy and F1 over seeds per mode and language, with the first run's sizes."""
    return runs.groupBy(*by).agg(
        F.min_by("n", "seed").alias("n"),
        F.min_by("train_samples", "seed").alias("train_samples"),
        F.avg("accuracy").alias("accuracy_mean"),
        spread("accuracy").alias("accuracy_std"),
        F.avg("f1").alias("f1_mean"),
        spread("f1").alias("f1_std"),
        F.count("*").alias("runs"),
        F.sort_array(F.collect_set("seed")).alias("seeds"),
    )


def curve_summary(runs: DataFrame, by: Sequence[str] = ("condition", "size", "lang"), value: str = "f1") -> DataFrame:
    """As ``seed_summary``, with the single values in the order of their seeds."""
    pairs = F.sort_array(F.collect_list(F.struct("seed", F.col(value).alias("v"))))
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        spread(value).alias("std"),
        F.count(value).alias("runs"),
        F.transform(pairs, lambda p: p["seed"]).alias("seeds"),
        F.transform(pairs, lambda p: p["v"]).alias("scores"),
    )


def curve_band(summary: DataFrame, zero_shot: Column | None = None) -> DataFrame:
    """Percent mean and the band of one deviation around it, per condition and size.

    ``zero_shot`` is the score without target labels, a line across all sizes.
    """
    mean, std = 100 * F.col("mean"), 100 * F.col("std")
    line = [] if zero_shot is None else [(100 * zero_shot).alias("zero_shot")]
    return summary.select(
        "condition", "size", mean.alias("mean"), (mean - std).alias("lo"), (mean + std).alias("hi"), *line
    )


def results_table(summary: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], metric: str = "") -> DataFrame:
    """One text cell ``mean ± std`` per value of ``column``, one row per value of ``rows``, in their order.

    Columns are filled by conditional aggregates over declared values; a missing cell is ``-``.
    """
    prefix = f"{metric}_" if metric else ""

    def pick(name: str, value: str) -> Column:
        return F.max(F.when(F.col(column) == value, F.col(name)))

    wide = summary.groupBy(*rows).agg(
        *[pick(f"{prefix}{part}", v).alias(f"_{part}_{i}") for i, v in enumerate(values) for part in ("mean", "std")],
        *[pick("runs", v).alias(f"_runs_{i}") for i, v in enumerate(values)],
    )
    cells = [
        P.percent_cell(F.col(f"_mean_{i}"), F.col(f"_std_{i}"), F.col(f"_runs_{i}")).alias(str(v))
        for i, v in enumerate(values)
    ]
    return wide.select(*rows, *cells).orderBy(*rows)


def condition_diff(summary: DataFrame, first: str, second: str, by: str = "size") -> DataFrame:
    """Means of two conditions side by side and their difference in percent points."""

    def mean_of(condition: str) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col("mean")))

    wide = summary.filter(F.col("condition").isin(first, second)).groupBy(by).agg(
        mean_of(first).alias("a"), mean_of(second).alias("b")
    )
    return wide.select(
        by,
        P.percent(F.col("a")).alias("a_mean"),
        P.percent(F.col("b")).alias("b_mean"),
        P.percent(F.col("b") - F.col("a")).alias("diff"),
    )


def curve_table(summary: DataFrame, first: str, second: str, target: str, source: str) -> DataFrame:
    """The learning-curve table: one row per size with text cells.

    Both conditions on the target's test set, their signed difference in points, and the second
    condition on the source's test set. ``summary`` has condition, size, lang, mean, std, runs.
    """

    def pick(name: str, condition: str, lang: str) -> Column:
        return F.max(F.when((F.col("condition") == condition) & (F.col("lang") == lang), F.col(name)))

    cells = {"a": (first, target), "b": (second, target), "c": (second, source)}
    wide = summary.groupBy("size").agg(
        *[pick(part, *cells[c]).alias(f"{part}_{c}") for c in cells for part in ("mean", "std", "runs")]
    )
    text = {c: P.percent_cell(F.col(f"mean_{c}"), F.col(f"std_{c}"), F.col(f"runs_{c}")) for c in cells}
    return wide.select(
        "size",
        text["a"].alias(first),
        text["b"].alias(second),
        P.signed_percent(F.col("mean_b") - F.col("mean_a")).alias("difference"),
        text["c"].alias(f"{second}_on_{source}"),
    ).orderBy("size")


def model_rows(runs: DataFrame) -> DataFrame:
    """One row per run and test set: size, accuracy and F1 in percent."""
    return runs.select(
        "mode", "seed", "lang", "n",
        P.percent(F.col("accuracy")).alias("accuracy_pct"),
        P.percent(F.col("f1")).alias("f1_pct"),
    )


def best_epoch(log: DataFrame, run: Sequence[str] = ("run",), epoch: str = "epoch", value: str = "eval_f1") -> DataFrame:
    """Epoch with the highest score per run, the earliest on ties; rows without a score are skipped."""
    rank = F.struct(F.col(value), -F.col(epoch))
    return log.filter(F.col(value).isNotNull()).groupBy(*run).agg(
        F.max_by(epoch, rank).alias("best_epoch"), F.max(value).alias("best_score")
    )


def early_stop(
    log: DataFrame,
    patience: int = 3,
    min_delta: float = 0.0,
    mode: str = "max",
    run: Sequence[str] = ("run",),
    epoch: str = "epoch",
    value: str = "score",
) -> DataFrame:
    """``run..., stop_epoch``: the epoch at which patience runs out, NULL if it never does.

    A score must beat the best one by more than ``min_delta`` to reset the patience. The log has
    one row per run and epoch.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    if patience < 1:
        raise ValueError("patience must be at least 1")
    signed = log.select(
        *run, F.col(epoch).alias("_epoch"), (F.col(value) if mode == "max" else -F.col(value)).alias("_score")
    )
    if min_delta == 0:
        return _stop_by_running_best(signed, patience, run)
    return _stop_by_fold(signed, patience, float(min_delta), run)


def _stop_by_running_best(log: DataFrame, patience: int, run: Sequence[str]) -> DataFrame:
    """Without a margin: the first epoch whose last ``patience`` scores all stay at or below the
    best one before them. One sort per run, nothing collected."""
    ordered = Window.partitionBy(*run).orderBy("_epoch")
    before = F.max("_score").over(ordered.rowsBetween(Window.unboundedPreceding, -patience))
    recent = F.max("_score").over(ordered.rowsBetween(1 - patience, Window.currentRow))
    judged = log.select(*run, "_epoch", (recent <= before).alias("_over"))
    return judged.groupBy(*run).agg(F.min(F.when(F.col("_over"), F.col("_epoch"))).alias("stop_epoch"))


def _stop_by_fold(log: DataFrame, patience: int, min_delta: float, run: Sequence[str]) -> DataFrame:
    """With a margin the best score depends on the whole past, so the epochs are folded in order."""
    steps = F.sort_array(F.collect_list(F.struct("_epoch", F.col("_score").cast("double").alias("_score"))))
    epoch_type = log.schema["_epoch"].dataType
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("waited"), F.lit(None).cast(epoch_type).alias("stop")
    )

    def advance(state: Column, step: Column) -> Column:
        better = state["best"].isNull() | (step["_score"] > state["best"] + F.lit(min_delta))
        waited = F.when(better, F.lit(0)).otherwise(state["waited"] + 1)
        stops = state["stop"].isNull() & (waited >= patience)
        return F.struct(
            F.when(better, step["_score"]).otherwise(state["best"]).alias("best"),
            waited.alias("waited"),
            F.when(stops, step["_epoch"]).otherwise(state["stop"]).alias("stop"),
        )

    folded = log.groupBy(*run).agg(F.aggregate(steps, start, advance).alias("_s"))
    return folded.select(*run, F.col("_s.stop").alias("stop_epoch"))
