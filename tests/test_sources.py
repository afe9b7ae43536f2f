import os
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexmill.plans import experiments as W
from lexmill.operators import linear as M
from lexmill.sources import cache, corpus as I, workdir

ROWS = [
    (1, "plain", 1, "en", "train"), (2, 'quote " and, comma', 0, "en", "train"), (3, "line\nbreak\r\nhere", 1, "en", "test"),
    (4, "  spaces  ", 0, "bn", "train"), (5, "null", 1, "bn", "train"), (6, "অসাধারণ 😀", 1, "bn", "test"), (7, 'back\\slash "', 0, "bn", "test"),
]
SCHEMA = "doc_id LONG, text STRING, label INT, lang STRING, split STRING"
KEYED = "doc_id LONG, text STRING, label INT"


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, frame, folder, fmt):
    I.write_corpus(frame, f"{folder}/c", None, fmt)
    back = I.read_corpus(spark, f"{folder}/c", KEYED, fmt).select(*frame.columns)
    assert sorted(map(tuple, back.collect())) == ROWS
    one = I.read_split(spark, f"{folder}/c", "bn", "test", KEYED, fmt)
    assert sorted(r["doc_id"] for r in one.collect()) == [6, 7]
    assert one.select("lang", "split").distinct().collect() == [("bn", "test")]


def test_only_text_and_label_are_written_by_default(spark, frame, folder):
    I.write_corpus(frame, f"{folder}/c")
    assert I.read_split(spark, f"{folder}/c", "en").columns == ["text", "label", "lang", "split"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_languages_are_written_and_replaced_by_themselves(spark, frame, folder, fmt):
    root = f"{folder}/c"
    I.write_corpus(frame.filter("lang = 'en'"), root, None, fmt)
    for _ in range(2):
        I.write_corpus(frame.filter("lang = 'bn'"), root, None, fmt, mode="overwrite")
        back = I.read_corpus(spark, root, KEYED, fmt).select(*frame.columns)
        assert sorted(map(tuple, back.collect())) == ROWS
    changed = frame.filter("lang = 'bn' and split = 'test'").withColumn("text", F.lit("new"))
    I.write_corpus(changed, root, None, fmt, mode="overwrite")
    back = {r["doc_id"]: r["text"] for r in I.read_corpus(spark, root, KEYED, fmt).collect()}
    assert back == {r[0]: "new" if r[0] in (6, 7) else r[1] for r in ROWS}


BODY = """text,label
"good, ""one""
two",1
"bad",abc
"one field"
three,1,fields
empty label,
"null",0
,1
"ends",0"""


def test_malformed_records_are_set_aside(spark, folder):
    for name, body in (("a", BODY), ("b", "text,label\nx,1\ny,\"2\n")):
        with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as out:
            out.write(body)
    read = I.read_checked(spark, f"{folder}/*.csv")
    rows = {(r["text"], r["label"], r["file"]) for r in read.rows.collect()}
    assert rows == {('good, "one"\ntwo', 1, "a.csv"), ("empty label", None, "a.csv"), ("null", 0, "a.csv"), (None, 1, "a.csv"), ("ends", 0, "a.csv"), ("x", 1, "b.csv")}
    bad = {(r["record"], r["file"]) for r in read.malformed.collect()}
    assert {r for r in bad if r[1] == "a.csv"} == {('"bad",abc', "a.csv"), ('"one field"', "a.csv"), ("three,1,fields", "a.csv")} and len(bad) == 4
    counts = {r["file"]: (r["good"], r["malformed"]) for r in read.counts().collect()}
    assert counts == {"a.csv": (5, 3), "b.csv": (1, 1)}
    for _ in range(2):
        I.write_quarantine(read.malformed, folder)
    I.write_quarantine(read.malformed.filter("file = 'b.csv'"), folder)
    assert {(r["record"], r["file"]) for r in I.read_quarantine(spark, folder).collect()} == bad
    with pytest.raises(FileNotFoundError):
        I.read_checked(spark, f"{folder}/none.csv")


def test_quarantine_is_no_part_of_the_corpus(spark, frame, folder):
    I.write_corpus(frame, f"{folder}/c", None, "parquet")
    I.write_quarantine(spark.createDataFrame([("f.csv", "x")], "file STRING, record STRING"), f"{folder}/c")
    assert I.read_corpus(spark, f"{folder}/c", KEYED, "parquet").count() == len(ROWS)


def test_keys_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(I, "COPIES", 7)
    rows = [("copy", 1, None)] * 100 + [(f"t{i % 40}", i % 3, "x") for i in range(100)] + [(None, None, None)] * 3 + [("", None, None)]
    df = spark.createDataFrame(rows, "text STRING, label INT, doc STRING")
    found = [sorted(map(repr, I.with_key(df.repartition(n)).collect())) for n in (3, 5, 64)]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(rows)
    keyed = I.with_key(df)
    assert keyed.select("doc_id").distinct().count() == len(rows) and keyed.columns == ["doc_id", "text", "label", "doc"]
    assert sorted(map(repr, keyed.drop("doc_id").collect())) == sorted(map(repr, df.collect()))


def test_run_from_two_files(spark, folder):
    lines = ["text,label"] + [f"{'good' if i % 2 else 'bad'} film number{i % 5},{i % 2}" for i in range(60)]
    for name, body in (("train", [*lines, "broken,x", "too,1,many"]), ("test", [*lines[:21], "short"])):
        with open(f"{folder}/{name}.csv", "w") as out:
            out.write("\n".join(body) + "\n")
    run = W.run_from_files(spark, f"{folder}/train.csv", f"{folder}/test.csv", f"{folder}/out", SETTINGS)
    assert run.keyed.count() == 60 and run.metrics.head()["accuracy"] == 1.0 and run.metrics.head()["n"] == 20
    assert spark.read.json(f"{folder}/out/metrics").head()["f1"] == 1.0
    assert spark.read.parquet(f"{folder}/out/model/terms").count() == run.model.terms.count()
    assert {r["record"] for r in I.read_quarantine(spark, f"{folder}/out").collect()} == {"broken,x", "too,1,many", "short"}


def test_missing_data(spark, frame, folder):
    I.write_corpus(frame, f"{folder}/c")
    with pytest.raises(FileNotFoundError):
        I.read_split(spark, f"{folder}/c", "xx")
    with pytest.raises(FileNotFoundError):
        I.read_corpus(spark, f"{folder}/nothing")
    with pytest.raises(FileNotFoundError):
        I.read_csv(spark, f"{folder}/nothing.csv")


def test_partition_pruning(spark, frame, folder):
    I.write_corpus(frame, f"{folder}/c", None, "parquet")
    plan = I.read_corpus(spark, f"{folder}/c", KEYED, "parquet").filter("lang = 'en' and split = 'test'").select("label")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "lang" in text.split("PartitionFilters")[1].split("]")[0] and "ReadSchema: struct<label:int>" in text


def test_read_csv_with_header_in_another_order_is_an_error(spark, folder):
    spark.createDataFrame([(1, "a")], "label INT, text STRING").coalesce(1).write.option("header", True).csv(f"{folder}/x")
    with pytest.raises(Exception):
        I.read_csv(spark, f"{folder}/x").collect()


def test_plain_files_get_language_split_and_key(spark, folder):
    for lang, split, body in [("en", "train", 'text,label\n"a, ""b""\nc",1\na,0\na,0\n'), ("en", "test", "text,label\nx,1\n"), ("bn", "test", "text,label\nঅ,0\n")]:
        os.makedirs(f"{folder}/{lang}", exist_ok=True)
        with open(f"{folder}/{lang}/{split}.csv", "w", encoding="utf-8") as out:
            out.write(body)
    rows = I.with_key(I.read_files(spark, folder))
    assert rows.columns == ["doc_id", "text", "label", "lang", "split"]
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [
        ("a", 0, "en", "train"), ("a", 0, "en", "train"), ('a, "b"\nc', 1, "en", "train"), ("x", 1, "en", "test"), ("অ", 0, "bn", "test"),
    ]
    assert rows.select("doc_id").distinct().count() == 5 and rows.collect() == rows.collect()
    assert I.read_files(spark, folder, "en", "test").count() == 1
    with pytest.raises(FileNotFoundError):
        I.read_files(spark, folder, "bn", "train")


def test_renamed_and_mapped_source(spark):
    raw = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "Data STRING, Label INT")
    got = I.mapped_source(I.rename_columns(raw, "Data", "Label"), {1: 1, 2: 0})
    assert sorted(map(tuple, got.collect())) == [("b", 1), ("c", 0)]


def test_holdout_source(spark):
    train = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    test = spark.range(200, 230).select(F.col("id").alias("doc_id"), F.lit(1).alias("label"))
    got = {r["split"]: r["count"] for r in I.holdout_source(train, test).groupBy("split").count().collect()}
    assert got == {"train": 190, "val": 10, "test": 30}


def test_raw_source(spark):
    raw = spark.createDataFrame([(i, "en" if i % 4 else "xx", f"text <b>{i}</b>" if i % 10 else "http://x", "pos" if i % 2 else "neg") for i in range(200)],
                                "doc_id LONG, lang STRING, text STRING, label STRING")
    got = I.raw_source(raw, ["en"])
    expected = {i for i in range(200) if i % 4 and i % 10}
    assert {r["doc_id"] for r in got.collect()} == expected
    assert got.filter("text like '%<%'").count() == 0


def test_json_keeps_non_ascii(spark, folder):
    I.write_json(spark.createDataFrame([("ভালো",)], "t STRING").coalesce(1), f"{folder}/j")
    assert spark.read.text(f"{folder}/j").head()["value"] == '{"t":"ভালো"}'


def test_cache_is_keyed_by_source_and_options(spark, folder):
    path = f"{folder}/data"
    spark.createDataFrame([(1, "<b>A</b>")], "doc_id LONG, text STRING").write.parquet(path)
    df = spark.read.parquet(path)
    name = f"{folder}-v1"
    first = cache.cleaned(df, name)
    assert first.head()["text"] == "A"
    assert cache.cleaned(df, name).inputFiles() == first.inputFiles()
    assert cache.cleaned(df, name, lowercase=True).head()["text"] == "a"
    assert cache.cleaned(df, f"{folder}-v2").inputFiles() != first.inputFiles()


def test_tables_between_stages_lie_in_the_work_folder(spark):
    rows = workdir.materialize(spark.range(3).toDF("x"), "rows")
    assert rows.count() == 3 and all(workdir.app_root(spark) in f for f in rows.inputFiles())
    assert workdir.app_root(spark).startswith(workdir.work_root(spark))


def test_work_folder_without_a_setting_is_in_the_warehouse():
    class Conf:
        def get(self, name, default=None):
            return "/data/warehouse/" if name == workdir.WAREHOUSE else default

    class Context:
        master = "local[8]"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    assert workdir.work_root(Session()) == "/data/warehouse/work"


def corpus(spark):
    good, bad = "lovely fine good", "awful poor bad"
    gut, schlecht = "schoen fein gut", "uebel arm schlecht"
    rows = []
    for i in range(160):
        positive = i % 2
        words = (good if positive else bad) if i < 80 else (gut if positive else schlecht)
        split = "test" if i % 8 in (0, 1) else "val" if i % 8 in (2, 3) else "train"
        rows.append((i, f"{words.split()[i % 3]} word{i % 5} {words.split()[(i + 1) % 3]}", positive, "en" if i < 80 else "de", split))
    return spark.createDataFrame(rows, SCHEMA)


MODES = W.standard_modes("en", "de")
SETTINGS = M.TfidfModel(max_features=200)


def test_mode_rows(spark):
    rows = W.mode_rows(corpus(spark), MODES).groupBy("mode", "role", "lang").count().collect()
    got = {(r["mode"], r["role"], r["lang"]): r["count"] for r in rows}
    assert got["zero_shot", "test", "de"] == 20 and ("zero_shot", "train", "de") not in got
    assert ("low_resource", "val", "en") not in got and got["combined", "val", "en"] == 20


def test_transfer_matrix(spark):
    rows = {(r["mode"], r["lang"]): r for r in W.transfer_matrix(corpus(spark), MODES, SETTINGS).collect()}
    assert len(rows) == 6
    assert rows["zero_shot", "en"]["f1"] == 1.0 and rows["zero_shot", "de"]["accuracy"] < 0.9
    assert rows["low_resource", "de"]["f1"] == 1.0 and rows["combined", "en"]["f1"] == rows["combined", "de"]["f1"] == 1.0
    assert rows["combined", "en"]["train_samples"] == 80
    assert rows["zero_shot", "de"]["judged"] and not rows["zero_shot", "en"]["judged"]


def test_evaluation_and_report(spark):
    rows = corpus(spark)
    model, cells, report = W.train_and_evaluate(rows.filter("split = 'train'"), rows.filter("split = 'test'"), SETTINGS)
    assert {r["row"] for r in report.collect()} >= {"negative", "positive", "macro avg"}
    out = W.evaluation(rows.filter("split = 'test'"), model)
    assert {r["lang"]: r["n"] for r in out["metrics"].collect()} == {"en": 20, "de": 20, "ALL": 40}
    assert out["scored"].count() == 40 and out["per_class"].count() == 4


def test_learning_curve_resumes(spark, folder):
    args = (corpus(spark), "en", "de", (10, 30), (42,), SETTINGS)
    runs = W.learning_curve(*args, records=f"{folder}/curve")
    assert runs.count() == 8
    before = set(runs.inputFiles())
    again = W.learning_curve(*args[:4], (42, 43), SETTINGS, records=f"{folder}/curve")
    assert again.count() == 16 and before < set(again.inputFiles())
    assert {r["examples"] for r in again.select("examples").distinct().collect()} == {10, 30}


def test_batch_view(spark):
    df = spark.createDataFrame([(1, "x" * 51, 1, 0.91), (2, " \n", 0, 0.8), (3, "short", 0, 0.65)], "doc_id LONG, text STRING, pred INT, confidence DOUBLE")
    view = W.batch_view(df)
    assert [tuple(r) for r in view.orderBy("doc_id").collect()] == [
        (1, "x" * 50 + "...", "positive", 91.0, "very high confidence", "😄"), (3, "short", "negative", 65.0, "moderate confidence", "😐"),
    ]
    assert {r["sentiment"]: r["n"] for r in W.batch_summary(view).collect()} == {"positive": 1, "negative": 1}


def test_cache_cleans_new_and_changed_files_only(spark, folder):
    root, schema = f"{folder}/data", "doc_id LONG, text STRING, day STRING"

    def write(day, *rows):
        spark.createDataFrame(rows, "doc_id LONG, text STRING").coalesce(1).write.mode("overwrite").parquet(f"{root}/day={day}")

    def state():
        rows = sorted((r["doc_id"], r["text"], r["day"]) for r in cache.cleaned_files(spark, root, schema).collect())
        return rows, {r["file"].split("day=")[1][:3]: r["_update"] for r in cache.manifest(spark, cache.cache_root(spark, root, schema)).collect()}

    write("a b", (1, "<b>A</b>"), (2, " "))
    write("b[1", (3, "B"))
    rows, first = state()
    assert rows == [(1, "A", "a b"), (3, "B", "b[1")] and len(first) == 2
    assert state() == (rows, first)
    write("c{*", (4, "C"))
    rows, second = state()
    assert rows == [(1, "A", "a b"), (3, "B", "b[1"), (4, "C", "c{*")]
    assert {k: v for k, v in second.items() if k in first} == first and len(set(second.values())) == 2
    write("a b", (5, "new"))
    shutil.rmtree(f"{root}/day=c{{*")
    rows, third = state()
    assert rows == [(3, "B", "b[1"), (5, "new", "a b")] and len(third) == 2
    # Rows of an update that did not finish are there, but no manifest names them.
    spark.createDataFrame([(9, "x", "d", "id")], f"{schema}, _file_id STRING").write.parquet(f"{cache.cache_root(spark, root, schema)}/rows/_update=lost")
    assert state() == (rows, third)


def test_cache_of_a_folder_that_runs_empty(spark, folder):
    root, schema = f"{folder}/none", "doc_id LONG, text STRING"
    os.makedirs(root)
    assert cache.cleaned_files(spark, root, schema).count() == 0
    spark.createDataFrame([(1, "a")], schema).coalesce(1).write.mode("append").parquet(root)
    assert cache.cleaned_files(spark, root, schema).count() == 1
    for file in os.listdir(root):
        os.remove(f"{root}/{file}")
    assert cache.cleaned_files(spark, root, schema).count() == 0
    spark.createDataFrame([(2, "b")], schema).coalesce(1).write.mode("append").parquet(root)
    assert [r["doc_id"] for r in cache.cleaned_files(spark, root, schema).collect()] == [2]


@pytest.mark.parametrize("master, shared, warehouse, expected", [
    ("local[8]", None, "file:/tmp/wh", "file:/tmp/wh/work"),
    ("spark://host:1", "/shared/x/", "file:/tmp/wh", "/shared/x"),
    ("yarn", None, "hdfs://host/wh/", "hdfs://host/wh/work"),
    ("yarn", None, "file:/tmp/wh", None),
    ("spark://host:1", None, "/tmp/wh", None),
])
def test_a_cluster_never_writes_to_a_folder_of_one_machine(master, shared, warehouse, expected):
    settings = {workdir.WAREHOUSE: warehouse, **({workdir.SETTING: shared} if shared else {})}
    context = SimpleNamespace(master=master, getConf=lambda: settings, getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, *default: settings.get(name)), sparkContext=context)
    if expected is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            workdir.work_root(session)
    else:
        assert workdir.work_root(session) == expected
