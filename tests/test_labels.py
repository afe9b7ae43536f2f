import pytest
from pyspark.sql import functions as F

from lexmill.functions import labels as L
from lexmill.operators import cleaning as C


def standardized(spark, values, kind):
    df = spark.createDataFrame(list(enumerate(values)), f"i INT, label {kind}")
    out = C.standardize_labels(df)
    assert out.schema["label"].dataType.simpleString() == "bigint"
    return {r["i"]: r["label"] for r in out.collect()}


def test_string_labels(spark):
    values = ["positive", "Negative", " POS ", "neg", "1", "0", "good", "bad", "neutral", "5", "-3", "junk", None, "1.5"]
    assert standardized(spark, values, "STRING") == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 9: 5, 10: -3}


def test_int_labels(spark):
    assert standardized(spark, [0, 1, 2, 3, 4, 5, 6, -1, None], "INT") == {0: 0, 1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}


def test_float_labels(spark):
    assert standardized(spark, [0.5, 0.51, 2.0, float("nan"), None, -1.0], "DOUBLE") == {0: 0, 1: 1, 2: 1, 3: 0, 5: 0}


def test_boolean_and_missing_columns_are_refused(spark):
    with pytest.raises(TypeError):
        C.standardize_labels(spark.createDataFrame([(True,)], "label BOOLEAN"))
    with pytest.raises(ValueError):
        C.standardize_labels(spark.createDataFrame([("a",)], "text STRING"))


def test_mapping_drops_unmapped_and_takes_string_keys(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 1), (4, None)], "i INT, label INT")
    for mapping in ({1: 1, 2: 0}, {"1": 1, "2": 0}):
        assert {r["i"]: r["label"] for r in C.map_labels(df, mapping).collect()} == {1: 1, 2: 0, 3: 1}
    assert C.map_labels(df, {}).count() == 0


def test_mapping_compares_whole_numbers(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.5), (2, float("nan")), (3, 2.0)], "i INT, label DOUBLE")
    assert {r["i"]: r["label"] for r in C.map_labels(df, {1: 1, 2: 0}).collect()} == {0: 1, 3: 0}
    assert C.map_labels(spark.createDataFrame([("1",), ("x",)], "label STRING"), {1: 1}).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("LABEL_1",), ("POSITIVE",), ("pos",), ("LABEL_0",), ("NEGATIVE",), ("other",)], "n STRING")
    got = [tuple(r) for r in df.select("n", L.label_id(F.col("n")), L.shown_name(F.col("n"))).collect()]
    assert got == [
        ("LABEL_1", 1, "positive"), ("POSITIVE", 1, "positive"), ("pos", 1, "pos"),
        ("LABEL_0", 0, "negative"), ("NEGATIVE", 0, "negative"), ("other", 0, "other"),
    ]


def test_labels_beyond_32_bits_are_kept(spark):
    rows = spark.createDataFrame([("3000000000",), ("-3000000000",)], "x STRING").select(L.standardize_string_label(F.col("x")).alias("y"))
    assert sorted(r["y"] for r in rows.collect()) == [-3000000000, 3000000000]
    mapped = spark.createDataFrame([(3000000000,)], "x LONG").select(L.map_label(F.col("x"), {"3000000000": 1}).alias("y"))
    assert mapped.head()["y"] == 1


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1", 1), ("0", 0), ("2", None), ("2.0", 1), ("4", 1), ("-1", 0), ("0.5", 0), ("0.51", 1), ("1e0", 1), ('"pos"', 1), ('" NEG "', 0),
        ('"neutral"', None), ('"5"', 5), ('"junk"', None), ("true", 1), ("false", 0), ("null", None), ("[1]", None), ('{"a": 1}', None), (None, None),
        ("99999999999999999999", 1), ("-99999999999999999999", 0), ('"true"', None), ('""', None),
    ],
)
def test_mixed_labels_follow_the_rule_of_their_own_type(spark, raw, expected):
    df = spark.createDataFrame([(1, raw)], "doc_id INT, raw STRING").select("doc_id", F.parse_json("raw").alias("label"))
    assert [r["label"] for r in C.standardize_labels(df).collect()] == ([] if expected is None else [expected])


def test_mixed_labels_that_json_lacks(spark):
    """NaN is negative, a date no label; numbers of every width keep their kind."""
    values = {"cast('NaN' as double)": 0, "cast(0.7 as float)": 1, "cast(2 as tinyint)": None, "cast(3 as smallint)": 1, "date'2020-01-01'": None, "cast(0.2 as decimal(3,1))": 0}
    for sql, expected in values.items():
        rows = C.standardize_labels(spark.sql(f"select cast({sql} as variant) as label")).collect()
        assert [r["label"] for r in rows] == ([] if expected is None else [expected])


def test_rows_are_counted_as_they_are_written(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "<b></b>"), (5, "c")], "doc_id INT, text STRING").repartition(3)
    rows, counts = C.clean_rows_counted(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
    rows.write.parquet(f"{folder}/clean")
    assert counts() == {"before": 5, "after": 2, "removed": 3} and spark.read.parquet(f"{folder}/clean").count() == 2
