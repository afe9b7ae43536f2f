import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import ODD, documents, prose
from lexmill.llm import queries as Q, quality, toxicity
from lexmill.llm.labelled import labelled_ids, row_sums, sample, sampled_rows

LABELS = "doc_id BIGINT, quality INT, toxic INT"


@pytest.mark.parametrize("name, column, least", [("op7_toxicity", "toxic", 0.9), ("op1_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    folder = "/root/testdata/sf0.1"
    scored = Q.QUERIES[name](spark, folder)
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    rows = scored.join(marks, "doc_id").filter("held_out").toPandas()
    assert rows["score"].between(0, 1).all() and len(rows) > 500
    assert (rows["label"] == rows["predicted"]).mean() > least
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def rude(spark):
    texts = [" ".join(prose(k, 30) + (["wretch", "vermin"] if k % 3 == 0 else [])) for k in range(300)] + ODD
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(200)] + [(None, 0, 1), (5, None, None), (10**9, 0, 1)], LABELS)
    return documents(spark, texts), labels, texts


def test_toxicity_of_all_kinds_of_texts(spark):
    docs, labels, texts = rude(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts)
    assert all((got[k] >= 0.7) == (k % 3 == 0) for k in range(300))
    assert max(got[k] for k in range(300, len(texts))) < 0.7 and got[300] == got[301]
    left = toxicity.drop_toxic(docs, labels, 0.7)
    assert left.columns == docs.columns and left.count() == 200 + len(ODD)


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels, texts = rude(spark)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.grams.tolist(), model.weights))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k in (0, 1, 3, 300, 301, 305):
        plain = "".join(c if c.isalnum() else " " for c in (texts[k] or "").lower())
        found = set()
        for word in plain.split():
            marked = f" {word} "
            for n in toxicity.SIZES:
                found |= {marked[i : i + n] for i in range(len(marked) - n + 1)}
        total = model.intercept
        for gram in found:
            flat = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
            hashes, _ = toxicity.grams(flat, np.array([0, len(flat)]))
            total += sum(weight.get(int(h), 0.0) for h in hashes[-1:])
        assert got[k] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_without_labels_nothing_is_toxic(spark):
    docs = documents(spark, ["a b c", None])
    empty = spark.createDataFrame([], LABELS)
    assert toxicity.drop_toxic(docs, empty, 0.7).count() == 2
    assert quality.score(docs, quality.fit(docs, empty)).count() == 2
    assert toxicity.score(documents(spark, []), toxicity.fit(docs, empty)).count() == 0


def test_sum_of_squares_identity():
    random = np.random.default_rng(1)
    linear, factors = random.normal(size=20), random.normal(size=(20, 3))
    at, value, of = np.array([1, 4, 7, 2, 2]), random.normal(size=5), np.array([0, 3, 3, 5])
    got, _ = quality.machine(at, value, of, 0.5, linear, factors)
    for row in range(3):
        i, x = at[of[row] : of[row + 1]], value[of[row] : of[row + 1]]
        pairs = sum(factors[i[p]] @ factors[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert got[row] == pytest.approx(0.5 + linear[i] @ x + pairs)


def test_quality_of_all_kinds_of_texts(spark):
    good = [" ".join(prose(k, 60)).capitalize() + "." for k in range(120)]
    bad = ["SPAM!! " * (20 + k) for k in range(120)]
    docs = documents(spark, good + bad + ODD)
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(0, 240, 2)], LABELS)
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 240 + len(ODD) and all(0 <= s <= 1 for s in got.values())
    assert min(got[k] for k in range(120)) > max(got[k] for k in range(120, 240))
    stated = docs.withColumn("n_chars", F.lit(float("nan")))
    assert quality.score(stated, model).count() == 240 + len(ODD)


def test_samples_are_bounded_and_repeatable(spark):
    labels = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(null AS int) AS toxic")
    picked = [sorted(r["doc_id"] for r in sample(labelled_ids(labels, "quality"), 30).collect()) for _ in range(2)]
    assert len(picked[0]) == 60 and picked[0] == picked[1]
    assert labelled_ids(labels, "toxic").count() == 0
    assert row_sums(np.ones(3), np.array([0, 2, 2, 3])).tolist() == [2, 0, 1]


@pytest.mark.parametrize("name", ["op1_quality", "op7_toxicity"])
def test_scores_do_not_depend_on_partitioning(spark, name):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for tasks in (8, 13, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            rows = Q.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
            got.append(list(zip(rows["doc_id"], rows["score"], rows["predicted"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


@pytest.mark.parametrize("name, column, rare, precision, recall", [("op7_toxicity", "toxic", 1, 0.9, 0.7), ("op1_quality", "quality", 0, 0.9, 0.9)])
def test_the_rare_label_is_found(spark, name, column, rare, precision, recall):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    rows = Q.QUERIES[name](spark, folder).filter("held_out").join(marks, "doc_id").toPandas()
    said, true = rows["predicted"] == rare, rows["label"] == rare
    assert (said & true).sum() >= precision * said.sum() and (said & true).sum() >= recall * true.sum()


def test_scores_keep_their_level_when_the_sample_bound_bites(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    means = []
    for bound in (6000, 300):
        model = toxicity.fit(docs, labels, toxicity.Settings(per_class=bound))
        means.append(toxicity.score(docs, model).agg(F.avg("score")).first()[0])
    assert abs(means[0] - means[1]) < 0.03


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_kind_are_given_to_all(spark, label):
    docs = documents(spark, ["a b c", "d e f", None])
    labels = spark.createDataFrame([(0, label, label), (1, label, label)], LABELS)
    for module in (toxicity, quality):
        scores = [r["score"] for r in module.score(docs, module.fit(docs, labels)).collect()]
        assert len(scores) == 3 and all(round(s) == label for s in scores)


def test_equal_texts_count_as_their_smallest_doc_id(spark):
    docs = documents(spark, ["same", "same", "other", "same"])
    for order in ("doc_id", "-doc_id"):
        marks = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1)], "doc_id BIGINT, label INT")
        rows = sampled_rows(docs.select("doc_id", "text").orderBy(F.expr(order)), marks, 10).collect()
        assert sorted((r["doc_id"], r["label"]) for r in rows) == [(0, 0), (2, 1)]
