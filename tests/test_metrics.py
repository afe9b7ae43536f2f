import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import metrics as E, stats as A

# Published matrices (tn, fp, fn, tp) with accuracy, precision, recall and F1.
GOLDEN = [
    (341, 87, 77, 367, 0.8119266055045872, 0.8120797588685369, 0.8116527742695967, 0.8117592548716086),
    (444, 127, 202, 452, 0.7314285714285714, 0.733981402760177, 0.7343573429307455, 0.731417116665034),
    (425, 3, 443, 1, 0.48853211009174313, 0.369815668202765, 0.49762145322892987, 0.33016424162257496),
    (454, 117, 182, 472, 0.7559183673469387, 0.7575973561414187, 0.7584044302339905, 0.7558656562916375),
    (347, 81, 79, 365, 0.8165137614678899, 0.816469820417272, 0.816409867811737, 0.8164355445622714),
    (4, 567, 5, 649, 0.5330612244897959, 0.48908077485380114, 0.49967999700080873, 0.3539553752535497),
    (388, 40, 30, 414, 0.9197247706422018, 0.9200619690997618, 0.9194872442535994, 0.9196533404939793),
    (507, 64, 84, 570, 0.8791836734693877, 0.8784608240324104, 0.8797377849901187, 0.8788632792037716),
    (280, 148, 50, 394, 0.7729357798165137, 0.7877110589287711, 0.7707964974320114, 0.7689874603285041),
    (510, 61, 93, 561, 0.8742857142857143, 0.8738502023643839, 0.8754840212728354, 0.8740674381718851),
    (388, 40, 29, 415, 0.9208715596330275, 0.9212717737897593, 0.9206133703797255, 0.9207956243294653),
    (531, 40, 342, 312, 0.6881632653061225, 0.7473055295220243, 0.7035058403894665, 0.6778676968658961),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, *g[:4]) for i, g in enumerate(GOLDEN)], "run INT, tn LONG, fp LONG, fn LONG, tp LONG")


def test_summary_reproduces_published_figures(cells):
    for row in E.summary(cells, ["run"]).collect():
        expected = GOLDEN[row["run"]][4:]
        for name, value in zip(("accuracy", "precision", "recall", "f1"), expected):
            assert math.isclose(row[name], value, rel_tol=1e-12), (row, name)


def scored(spark, rows):
    return spark.createDataFrame(rows, "doc_id LONG, lang STRING, label INT, pred INT, confidence DOUBLE, text STRING")


ROWS = [
    (1, "en", 0, 1, 0.95, "a" * 300), (2, "en", 1, 0, 0.8, "b"), (3, "en", 1, 1, 0.55, "c"), (4, "en", 0, 0, 0.99, "d"),
    (5, "de", 1, 1, 0.7, "e"), (6, "de", 1, 1, 0.59, "f"), (7, "de", 0, 1, 0.5, "g"),
]


def test_confusion_and_matrix(spark):
    got = E.confusion(scored(spark, ROWS), ["lang"]).select("lang", E.matrix().alias("m")).collect()
    assert {r["lang"]: r["m"] for r in got} == {"en": [[1, 1], [1, 1]], "de": [[0, 1], [0, 2]]}


def test_rollup_is_the_pooled_evaluation(spark):
    df = scored(spark, ROWS)
    pooled = E.evaluate(df).head()
    rolled = {r["lang"]: r for r in E.evaluate_rollup(df).collect()}
    assert set(rolled) == {"en", "de", "ALL"}
    assert [rolled["ALL"][c] for c in pooled.asDict()] == list(pooled)
    by_mode = E.evaluate_rollup(df.withColumn("mode", F.lit("m")), by=["mode"]).collect()
    assert {(r["mode"], r["lang"]): r["f1"] for r in by_mode} == {("m", k): v["f1"] for k, v in rolled.items()}


def test_absent_classes(spark):
    one = E.evaluate(scored(spark, [(1, "x", 1, 1, 0.9, "t")])).head()
    assert tuple(one) == (1, 1.0, 1.0, 1.0, 1.0)
    wrong = E.evaluate(scored(spark, [(1, "x", 1, 0, 0.9, "t")])).head()
    assert tuple(wrong) == (1, 0.0, 0.0, 0.0, 0.0)
    rows = E.per_class(E.confusion(scored(spark, [(1, "x", 1, 1, 0.9, "t")]))).collect()
    assert [(r["class"], r["precision"], r["support"]) for r in rows] == [("negative", 0.0, 0), ("positive", 1.0, 1)]


def test_report(spark):
    rows = {r["row"]: r for r in E.report(E.confusion(scored(spark, ROWS))).collect()}
    assert list(rows) == ["negative", "positive", "accuracy", "macro avg", "weighted avg"]
    neg, pos = rows["negative"], rows["positive"]
    assert math.isclose(rows["weighted avg"]["f1"], (neg["f1"] * neg["support"] + pos["f1"] * pos["support"]) / 7)
    assert math.isclose(rows["macro avg"]["recall"], (neg["recall"] + pos["recall"]) / 2)


def test_errors(spark):
    df = scored(spark, ROWS)
    counts = {r["bucket"]: (r["true_n"], r["capped_n"]) for r in E.error_counts(df, 1).collect()}
    assert counts == {
        "false_positives": (2, 1), "false_negatives": (1, 1), "high_confidence_wrong": (1, 1), "low_confidence_correct": (2, 1),
    }
    rows = E.error_samples(df.drop("text"), df, 1).collect()
    assert {(r["bucket"], r["doc_id"]) for r in rows} == {
        ("false_positives", 1), ("false_negatives", 2), ("high_confidence_wrong", 1), ("low_confidence_correct", 3),
    }
    first = next(r for r in rows if r["bucket"] == "false_positives")
    assert (len(first["text"]), first["true_label"], first["predicted"]) == (200, "negative", "positive")


def test_error_samples_meet_the_texts_by_broadcast(spark):
    df = scored(spark, ROWS)
    plan = E.error_samples(df.drop("text"), df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_corpus_stats(spark):
    df = spark.createDataFrame([("short", 0), ("two words", 1), ("three words here", 1), ("x", None)], "text STRING, label INT")
    got = A.corpus_stats(df).head()
    assert tuple(got) == (4, 2, 1, 0.5, 7.75, 16, 1, 1.75, 3)


def test_token_stats_use_population_deviation(spark):
    df = spark.createDataFrame([("aa bb",), ("aa",), ("aa bb cc",), ("aa bb cc dd",)], "text STRING")
    got = A.token_stats(df).head()
    assert tuple(got)[:5] == (2.5, math.sqrt(1.25), 1, 4, 2.5)
    assert math.isclose(got["p95"], 3.85) and math.isclose(got["p99"], 3.97)


def test_class_weights_and_balance(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label INT")
    assert {r["label"]: r["weight"] for r in A.class_weights(df).collect()} == {0: 4 / 6, 1: 2.0}
    row = A.balance(df.withColumn("lang", F.lit("en")), ["lang"]).head()
    assert (row["total"], row["positive"], row["pos_pct"], row["neg_pct"]) == (4, 1, 25.0, 75.0)
    assert A.positive_share(df.withColumn("g", F.lit(1)), ["g"]).head()["positive_share"] == 0.25


def test_merged_length_sketches_keep_ranks(spark):
    """Sketches of many parts, merged, rank every mark within 2 % of the texts; small groups are exact."""
    texts = spark.range(20_000).select((F.col("id") % 40).alias("part"), F.expr("repeat('word ', int(1 + id * id % 997))").alias("text"))
    sketches = A.length_sketches(texts, ["part"])
    rows = A.sketch_marks(A.merge_sketches(sketches), [0.01, 0.5, 0.95, 0.99]).collect()
    lengths = np.array([1 + i * i % 997 for i in range(20_000)])
    for r in rows:
        assert r["n"] == 20_000
        assert (lengths < r["value"]).mean() <= r["mark"] + 0.02 and (lengths <= r["value"]).mean() >= r["mark"] - 0.02
    few = A.sketch_marks(A.length_sketches(texts.filter("id < 400 and part = 3"), ["part"]), [0.5]).head()
    own = sorted(lengths[3:400:40])
    assert own[4] <= few["value"] <= own[5]
