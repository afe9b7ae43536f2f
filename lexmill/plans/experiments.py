"""Whole experiments: training and testing across languages, learning curves, batch reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import labels as L, scores as P, text as X
from lexmill.operators import features as V, grid as G, linear as M, metrics as E, runs as R, sampling as S
from lexmill.operators.cleaning import clean_rows
from lexmill.sources import corpus as I
from lexmill.sources.workdir import materialize, new_path

CONDITIONS = ("target_only", "source_first")
CURVE_RECORD = (
    "condition STRING, size INT, seed INT, examples BIGINT, positive_share DOUBLE, "
    "lang STRING, n BIGINT, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE"
)


@dataclass(frozen=True)
class Mode:
    """Languages a model is trained on, and those it is meant to be judged on."""

    train: tuple[str, ...]
    judged: tuple[str, ...]


def standard_modes(source: str, target: str) -> dict[str, Mode]:
    """Train on the source, on the target, or on both."""
    return {
        "zero_shot": Mode((source,), (target,)),
        "low_resource": Mode((target,), (target,)),
        "combined": Mode((source, target), (source, target)),
    }


def mode_rows(corpus: DataFrame, modes: Mapping[str, Mode]) -> DataFrame:
    """``mode, role`` and the corpus columns: the rows every mode trains, validates and tests on.

    Training and validation take the mode's own languages; testing takes all, so that no label
    of a target language takes part in choosing a model. Each row is handed to its modes in one
    pass over the corpus.
    """
    options = F.array(*[
        F.struct(F.lit(name).alias("mode"), F.array(*[F.lit(x) for x in mode.train]).alias("langs"))
        for name, mode in modes.items()
    ])
    takes_part = F.filter(
        options, lambda m: (F.col("split") == "test") | F.array_contains(m["langs"], F.col("lang"))
    )
    rows = corpus.select("*", F.explode(F.transform(takes_part, lambda m: m["mode"])).alias("mode"))
    return rows.select("mode", F.col("split").alias("role"), *[c for c in corpus.columns if c != "split"])


@dataclass(frozen=True)
class FileRun:
    """What was read, the keyed training rows, the model, its confusion cells, metrics and report."""

    train: I.Checked
    test: I.Checked
    keyed: DataFrame
    model: M.TfidfModel
    cells: DataFrame
    metrics: DataFrame
    report: DataFrame


def train_and_evaluate(
    train: DataFrame, test: DataFrame, settings: M.TfidfModel | None = None, key: str = "doc_id"
) -> tuple[M.TfidfModel, DataFrame, DataFrame]:
    """The fitted model, its confusion cells on ``test`` and the classification report."""
    model = M.fit(train, settings, key=key)
    cells = materialize(E.confusion(M.score(test, model, ["label"], key=key)), "cells")
    return model, cells, E.report(cells)


def run_from_files(spark: SparkSession, train_path: str, test_path: str, out: str | None = None, settings: M.TfidfModel | None = None) -> FileRun:
    """Train on one CSV file (or a pattern of them) and test on another.

    Malformed records are set aside, and with ``out`` given kept in ``<out>/_quarantine``, beside the
    model, the metrics (JSON) and the report. Rows get keys made from their content. Runs jobs.
    """
    read = {part: I.read_checked(spark, path) for part, path in (("train", train_path), ("test", test_path))}
    train, test = (I.with_key(c.rows.select("text", "label").na.drop(subset=["label"])) for c in read.values())
    model, cells, report = train_and_evaluate(train, test, settings)
    metrics = E.summary(cells)
    if out:
        M.save_model(model, f"{out}/model")
        I.write_json(metrics, f"{out}/metrics", "overwrite")
        report.write.mode("overwrite").parquet(f"{out}/report")
        I.write_quarantine(read["train"].malformed.unionByName(read["test"].malformed), out)
    return FileRun(read["train"], read["test"], train, model, cells, metrics, report)


def _counted(corpus: DataFrame, settings: M.TfidfModel, key: str) -> DataFrame:
    """The corpus with its texts cleaned and taken apart, in folders by language and split."""
    cleaned = clean_rows(corpus.select(key, "text", "label", "lang", "split"), drop_empty=False)
    keep = ["label", "lang", "split"]
    return V.word_docs(cleaned, keep, key, ngram_range=settings.ngram_range, partition_by=("lang", "split"))


def _runs_of(*conditions: Column) -> Column:
    """The numbers of the conditions that hold, as an array."""
    return F.filter(F.array(*[F.when(holds, F.lit(i)) for i, holds in enumerate(conditions)]), lambda r: r.isNotNull())


def train_runs(modes: Mapping[str, Mode]) -> Column:
    """The modes a row trains, as numbers."""
    return _runs_of(*[(F.col("split") == "train") & F.col("lang").isin(*mode.train) for mode in modes.values()])


def fit_modes(counted: DataFrame, modes: Mapping[str, Mode], settings: M.TfidfModel, key: str = "doc_id", **options) -> G.GridModel:
    """All modes in one joint fit; run *i* is the *i*-th mode. ``counted`` has label, lang, split and terms."""
    rows = counted.select(key, "label", "terms", train_runs(modes).alias("runs"))
    return G.fit_grid(rows, len(modes), settings, key=key, **options)


def transfer_matrix(
    corpus: DataFrame,
    modes: Mapping[str, Mode],
    settings: M.TfidfModel | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """One row per mode and test language: size, rows trained on, metrics, confusion cells.

    ``corpus`` has key, text, label, lang and split; its texts are cleaned and counted once for
    all modes. All modes are fitted together and scored together, one pass over the test rows of all
    languages. ``judged`` marks the languages the mode is meant for.
    """
    settings = settings or M.TfidfModel()
    counted = _counted(corpus, settings, key)
    model = fit_modes(counted, modes, settings, key)
    scored = G.score_grid(counted.filter(F.col("split") == "test"), model, ["label", "lang"], key)
    measured = _measured(scored, ["run", "lang"])
    # One row per mode.
    rows = [(i, name, model.train_rows[i], list(mode.judged)) for i, (name, mode) in enumerate(modes.items())]
    told = corpus.sparkSession.createDataFrame(rows, "run INT, mode STRING, train_samples BIGINT, _judged ARRAY<STRING>")
    results = measured.join(F.broadcast(told), "run").select(
        "mode", "lang", "n", "train_samples", F.array_contains("_judged", F.col("lang")).alias("judged"),
        "accuracy", "precision", "recall", "f1", "confusion_matrix",
    )
    return materialize(results, "transfer")


def _measured(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    cells = E.confusion(scored, list(by))
    return E.summary(cells.withColumn("confusion_matrix", E.matrix()), [*by, "confusion_matrix"])


def evaluation(
    test: DataFrame, model: M.TfidfModel, key: str = "doc_id", n_samples: int = 50
) -> dict[str, DataFrame]:
    """Scores and everything reported about them: per language and pooled, per class, errors."""
    scored = materialize(M.score(test.select(key, "text", "label", "lang"), model, ["label", "lang"], key=key), "scored")
    cells = E.confusion(scored, ["lang"])
    return {
        "scored": scored,
        "metrics": E.evaluate_rollup(scored),
        "per_class": E.per_class(cells, ["lang"]),
        "report": E.report(cells, ["lang"]),
        "error_samples": E.error_samples(scored, test, n_samples, key),
        "error_counts": E.error_counts(scored, n_samples),
    }


def batch_view(scored: DataFrame, text: str = "text", limit: int = 50) -> DataFrame:
    """The rows of a scored batch as shown to a reader; blank texts are left out."""
    sentiment = L.label_name(F.col("pred"))
    return scored.filter(~X.is_blank(F.col(text))).select(
        *[c for c in scored.columns if c not in (text, "label", "pred", "score", "confidence", "z")],
        X.shorten(F.col(text), limit, "...").alias("text"),
        sentiment.alias("sentiment"),
        P.percent(F.col("confidence")).alias("confidence"),
        P.confidence_phrase(F.col("confidence")).alias("band"),
        P.confidence_emoji(sentiment, F.col("confidence")).alias("emoji"),
    )


def batch_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("sentiment").agg(F.count("*").alias("n"))


def _finished(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(CURVE_RECORD).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class CurveFit:
    """The runs of a curve that were to do, in the order of the joint fit's runs, and what they train on."""

    plan: list
    rows: DataFrame
    model: G.GridModel


def fit_curve(counted: DataFrame, source: str, target: str, todo: Sequence, settings: M.TfidfModel, key: str = "doc_id", **options) -> CurveFit:
    """Planned runs of a learning curve in one joint fit.

    ``todo`` has condition, size and seed of each run. Nested subsets of the target's training rows
    are used alone or together with the source language's. Every row lists the runs it trains, so no
    row is copied for a size, a seed or a condition. Runs jobs.
    """
    train = counted.filter(F.col("split") == "train").select(key, "label", "lang", "terms")
    sizes, seeds = sorted({r["size"] for r in todo}), sorted({r["seed"] for r in todo})
    levels = S.nested_levels(train.filter(F.col("lang") == target).select(key), sizes, seeds, key)
    taken = _runs_of(*[(F.col("seed") == r["seed"]) & (F.col("level") <= r["size"]) for r in todo])
    members = levels.select(key, taken.alias("_runs")).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_runs"))).alias("runs"))
    always = F.array(*[F.lit(i) for i, r in enumerate(todo) if r["condition"] == CONDITIONS[1]]).cast("array<int>")
    target_rows = train.filter(F.col("lang") == target).join(members, key)
    source_rows = train.filter(F.col("lang") == source).withColumn("runs", always)
    rows = materialize(target_rows.unionByName(source_rows).select(key, "label", "lang", "runs", "terms"), "curve-rows")
    return CurveFit(list(todo), rows, G.fit_grid(rows, len(todo), settings, key=key, **options))


def learning_curve(
    corpus: DataFrame,
    source: str,
    target: str,
    sizes: Sequence[int] = R.CURVE_SIZES,
    seeds: Sequence[int] = R.CURVE_SEEDS,
    settings: M.TfidfModel | None = None,
    key: str = "doc_id",
    records: str | None = None,
) -> DataFrame:
    """One row per condition, size, seed and test language.

    All runs that have no record yet are fitted and scored together, and each leaves its record in a
    folder of its own, so a second call with the same ``records`` folder only does those that are
    missing. A size beyond the target's training rows takes all of them.
    """
    spark = corpus.sparkSession
    records = records or new_path(spark, "curve")
    settings = settings or M.TfidfModel()
    counted = _counted(corpus, settings, key)
    plan = R.run_plan(counted.filter((F.col("split") == "train") & (F.col("lang") == target)), CONDITIONS, sizes, seeds)
    done = _finished(spark, records)
    if done is not None:
        plan = R.pending_runs(plan, done)
    # The plan has conditions x sizes x seeds rows, all of them given by the caller.
    todo = plan.orderBy("condition", "size", "seed").collect()
    if todo:
        fit = fit_curve(counted, source, target, todo, settings, key)
        scored = G.score_grid(counted.filter(F.col("split") == "test"), fit.model, ["label", "lang"], key)
        shares = fit.rows.filter(F.col("lang") == target).select("label", F.explode("runs").alias("run")).groupBy("run").agg(F.avg("label").alias("positive_share"))
        rows = [(i, r["condition"], r["size"], r["seed"], r["examples"]) for i, r in enumerate(todo)]
        told = spark.createDataFrame(rows, "run INT, condition STRING, size INT, seed INT, examples BIGINT")
        figures = E.evaluate(scored, ["run", "lang"])
        record = figures.join(F.broadcast(told), "run").join(shares, "run").select(
            "condition", "size", "seed", "examples", "positive_share", *[c for c in figures.columns if c != "run"]
        )
        # Folders of other runs stay as they are.
        record = record.repartition("condition", "size", "seed")
        record.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition", "size", "seed").parquet(records)
    return spark.read.schema(CURVE_RECORD).parquet(records)
