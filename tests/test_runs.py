import json
import math
import os

import pytest
from pyspark.sql import functions as F

from lexmill.operators import runs as R
from lexmill.sources import records as J


def put(root, path, value):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, ensure_ascii=False)


def metrics(accuracy, f1, n=10):
    return {"n": n, "accuracy": accuracy, "f1": f1, "precision": 0.5, "recall": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}


def test_runs_are_collected_and_averaged(spark, folder):
    for seed, f1 in ((42, 0.60), (43, 0.70)):
        put(folder, f"joint/seed{seed}/metrics.json", {
            "model": "m", "seed": seed, "train_samples": seed, "test": {"en": metrics(0.9, f1), "bn": metrics(0.8, f1 / 2)},
        })
    put(folder, "solo/seed42/metrics.json", {"train_samples": 7, "test": {"en": metrics(0.3, 0.33), "bn": metrics(0.7, 0.75)}})
    put(folder, "joint/seed42/training_history.json", [{"loss": 1.0}])
    runs = J.read_runs(spark, folder, "metrics.json")
    assert runs.count() == 6 and runs.head()["confusion_matrix"] == [[1, 2], [3, 4]]
    summary = R.collect_results(runs)
    row = summary.filter("mode = 'joint' and lang = 'en'").head()
    assert math.isclose(row["f1_mean"], 0.65) and math.isclose(row["f1_std"], math.sqrt(0.005))
    assert (row["runs"], row["seeds"], row["train_samples"], row["n"]) == (2, [42, 43], 42, 10)
    table = {r["mode"]: (r["en"], r["bn"], r["xx"]) for r in R.results_table(summary, ["mode"], "lang", ["en", "bn", "xx"], "f1").collect()}
    assert table == {"joint": ("65.0 ± 7.1", "32.5 ± 3.5", "-"), "solo": ("33.0", "75.0", "-")}
    shown = R.model_rows(runs.filter("mode = 'solo' and lang = 'bn'")).head()
    assert (shown["n"], shown["accuracy_pct"], shown["f1_pct"]) == (10, 70.0, 75.0)


def test_no_runs_give_no_rows(spark, folder):
    os.makedirs(os.path.join(folder, "empty"))
    assert J.read_runs(spark, folder).count() == 0


def test_curve_runs(spark, folder):
    for condition, shift in (("target_only", 0.0), ("source_first", 0.016)):
        for seed in (42, 43):
            if (condition, seed) == ("source_first", 43):
                continue
            put(folder, f"{condition}/n100/seed{seed}.json", {
                "condition": condition, "size": 100, "seed": seed, "positive_share": 0.5, "epochs": 29, "steps": 203,
                "test": {"bn": metrics(0.7, 0.7 + shift + (seed - 42) / 10)},
            })
    put(folder, "target_only/n250/seed42.json", {"test": {"bn": metrics(0.7, 0.9)}})
    runs = J.read_curve_runs(spark, folder)
    assert {(r["condition"], r["size"], r["seed"]) for r in runs.collect()} == {
        ("target_only", 100, 42), ("target_only", 100, 43), ("source_first", 100, 42), ("target_only", 250, 42),
    }
    summary = R.curve_summary(runs)
    row = summary.filter("condition = 'target_only' and size = 100").head()
    assert (row["seeds"], row["scores"], row["runs"]) == ([42, 43], [0.7, 0.7 + 0.1], 2)
    diff = {r["size"]: tuple(r)[1:] for r in R.condition_diff(summary, "target_only", "source_first").collect()}
    assert diff == {100: (75.0, 71.6, -3.4), 250: (90.0, None, None)}
    table = {r["size"]: tuple(r)[1:] for r in R.curve_table(summary, "target_only", "source_first", "bn", "en").collect()}
    assert table == {100: ("75.0 ± 7.1", "71.6", "-3.4", "-"), 250: ("90.0", "-", "-", "-")}
    band = R.curve_band(summary.filter("size = 250"), F.lit(0.5)).head()
    assert band["zero_shot"] == 50.0
    assert (band["mean"], band["lo"], band["hi"]) == (90.0, 90.0, 90.0)


def test_records_round_trip(spark, folder):
    rows = [("a", 42, "en", 5, 0.5, 0.25), ("a", 42, "de", 6, 0.75, 0.5), ("b", 43, "en", 7, 1.0, 1.0)]
    runs = spark.createDataFrame(rows, "mode STRING, seed INT, lang STRING, n LONG, accuracy DOUBLE, f1 DOUBLE")
    J.write_runs(runs, folder + "/out", ["mode", "seed"], [])
    back = J.read_runs(spark, folder + "/out").select(*runs.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_history_and_best_epoch(spark, folder):
    rows = []
    for epoch, f1 in enumerate([0.8384144, 0.8513811, 0.8762784, 0.8685985], 1):
        rows.append({"loss": 1.0 / epoch, "learning_rate": 1e-5, "grad_norm": 1.0, "epoch": epoch - 0.5, "step": epoch * 10 - 5})
        rows.append({"eval_f1": f1, "eval_loss": 0.3, "epoch": float(epoch), "step": epoch * 10})
    rows.append({"train_runtime": 1.5, "train_loss": 0.2, "epoch": 4.0, "step": 40})
    put(folder, "solo/seed42/training_history.json", rows)
    log = J.read_history(spark, folder, "training_history.json")
    assert log.count() == 9 and log.filter("eval_f1 is null").count() == 5
    best = R.best_epoch(log, ["mode", "seed"]).head()
    assert (best["mode"], best["seed"], best["best_epoch"], best["best_score"]) == ("solo", 42, 3.0, 0.8762784)


def test_best_epoch_ties_go_to_the_earliest(spark):
    log = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7)], "run STRING, epoch INT, eval_f1 DOUBLE")
    assert R.best_epoch(log).head()["best_epoch"] == 2


def early(scores, patience, delta, mode):
    best, waited = None, 0
    for i, s in enumerate(scores, 1):
        if best is None:
            best = s
            continue
        if (s > best + delta) if mode == "max" else (s < best - delta):
            best, waited = s, 0
        else:
            waited += 1
            if waited >= patience:
                return i
    return None


@pytest.mark.parametrize("patience,delta,mode", [(2, 0.0, "max"), (3, 0.0, "min"), (1, 0.0, "max"), (2, 0.05, "max"), (3, 0.05, "min")])
def test_early_stop(spark, patience, delta, mode):
    curves = {
        "a": [0.1, 0.3, 0.2, 0.25, 0.9], "b": [0.5, 0.52, 0.54, 0.56, 0.58, 0.6], "c": [0.9, 0.8, 0.7, 0.6, 0.61, 0.62, 0.63],
        "d": [0.4], "e": [0.5, 0.5, 0.5, 0.5],
    }
    rows = [(run, i, s) for run, scores in curves.items() for i, s in enumerate(scores, 1)]
    log = spark.createDataFrame(rows, "run STRING, epoch INT, score DOUBLE").repartition(4)
    got = {r["run"]: r["stop_epoch"] for r in R.early_stop(log, patience, delta, mode).collect()}
    assert got == {run: early(scores, patience, delta, mode) for run, scores in curves.items()}


def test_early_stop_mode_is_checked(spark):
    with pytest.raises(ValueError):
        R.early_stop(spark.createDataFrame([("r", 1, 0.1)], "run STRING, epoch INT, score DOUBLE"), mode="up")


def test_run_plan_and_pending(spark):
    train = spark.range(2000)
    plan = R.run_plan(train, ["a", "b"])
    assert plan.count() == 36
    rows = {r["size"]: r for r in plan.filter("condition = 'a' and seed = 42").collect()}
    assert (rows[100]["epochs"], rows[100]["steps"], rows[9681]["examples"]) == (29, 203, 2000)
    done = plan.filter("size = 100").select("condition", "size", "seed")
    left = R.pending_runs(plan, done)
    assert left.count() == 30 and left.filter("size = 100").count() == 0
    assert R.run_plan(train.limit(0), ["a"]).count() == 0


def test_spread_of_one_run_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.25), ("b", 2, 0.75)], "g STRING, seed INT, v DOUBLE")
    got = {r["g"]: (r["mean"], r["std"], r["runs"]) for r in R.seed_summary(df, ["g"], "v").collect()}
    assert got["a"] == (0.5, 0.0, 1) and math.isclose(got["b"][1], math.sqrt(0.125))


def test_patience_must_be_positive(spark):
    log = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.3)], "run STRING, epoch INT, score DOUBLE")
    with pytest.raises(ValueError):
        R.early_stop(log, patience=0)


def test_records_with_and_without_a_seed_folder_are_read_together(spark, folder):
    put(folder, "low_resource/seed42/metrics.json", {"model": "neural", "train_samples": 7, "test": {"en": metrics(0.8, 0.75)}})
    put(folder, "baseline/low_resource/metrics.json", {"model": "linear", "train_samples": 7, "test": {"en": metrics(0.4, 0.33)}})
    runs = J.read_runs(spark, folder, "metrics.json")
    assert {(r["mode"], r["seed"], r["model"]) for r in runs.collect()} == {("low_resource", 42, "neural"), ("low_resource", None, "linear")}
    summary = R.collect_results(runs, ["mode", "model", "lang"])
    table = R.results_table(summary, ["mode"], "model", ["linear", "neural"], "f1")
    assert [tuple(r) for r in table.collect()] == [("low_resource", "33.0", "75.0")]
