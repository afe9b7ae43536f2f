import math
import random

from pyspark.sql import functions as F

from lexmill.functions import scores as P


def test_round_tenth_prints_like_format(spark):
    rng = random.Random(7)
    values = [i / 100 for i in range(0, 10_100, 5)] + [0.25, 0.35, 0.45, 65.05, 99.95, 100.0, -0.25, -1.35, -0.04]
    values += [rng.uniform(-100, 100) for _ in range(2000)] + [100 * (k / n) for n in (7, 16, 40, 872) for k in range(n)]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", P.round_tenth(F.col("v")).alias("r")).collect()
    for row in rows:
        assert row["r"] == float(f"{row['v']:.1f}"), row


def test_cells(spark):
    df = spark.createDataFrame([(0.65, 0.0707106781, 2), (0.33, 0.0, 1), (None, None, None)], "m DOUBLE, s DOUBLE, r INT")
    got = [r[0] for r in df.select(P.percent_cell(F.col("m"), F.col("s"), F.col("r"))).collect()]
    assert got == ["65.0 ± 7.1", "33.0", "-"]


def test_signed_percent(spark):
    values = [0.016, -0.016, 0.0, -0.0004, 0.0006, None]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    expected = ["-" if v is None else f"{100 * v:+.1f}" for v in values]
    assert [r[0] for r in df.select(P.signed_percent(F.col("v"))).collect()] == expected


def test_schedule(spark):
    df = spark.createDataFrame([(100,), (9681,)], "n INT")
    got = [tuple(r) for r in df.select(
        P.scheduled_epochs(F.col("n"), 16, 4, 200), P.scheduled_epochs(F.col("n"), 16, 4, 200) * P.steps_per_epoch(F.col("n"), 16)
    ).collect()]
    assert got == [(29, 203), (4, 2424)]


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([2.0, 2.0],), ([1000.0, 0.0],)], "l ARRAY<FLOAT>")
    rows = df.select(P.argmax(F.col("l")).alias("a"), P.softmax(F.col("l")).alias("p")).collect()
    assert [r["a"] for r in rows] == [1, 0, 0]
    assert math.isclose(rows[0]["p"][1], 1 / (1 + math.exp(-2)), rel_tol=1e-12)
    assert rows[1]["p"] == [0.5, 0.5] and rows[2]["p"][0] == 1.0


def test_bands_are_strict(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.5,)], "s DOUBLE")
    rows = df.select(P.confidence_phrase(F.col("s")), P.confidence_emoji(F.lit("Positive"), F.col("s")), P.confidence_emoji(F.lit("negative"), F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [
        ("very high confidence", "😄", "😢"), ("high confidence", "🙂", "😕"),
        ("moderate confidence", "😐", "😐"), ("low confidence", "😐", "😐"),
    ]
