import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import sampling as S


def order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


def labelled(spark, n, positive_every=5):
    return spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % positive_every == 0).cast("int").alias("label"))


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["split"], set()).add(r["doc_id"])
    return out


def test_three_way_split_sizes(spark):
    got = parts(S.stratified_split(labelled(spark, 100, 2)))
    assert {k: len(v) for k, v in got.items()} == {"train": 80, "val": 10, "test": 10}
    assert set.union(*got.values()) == set(range(100))


def test_imbalanced_split_keeps_both_classes(spark):
    rows = S.stratified_split(labelled(spark, 100, 5)).groupBy("split").agg(F.countDistinct("label").alias("k")).collect()
    assert [r["k"] for r in rows] == [2, 2, 2]


@pytest.mark.parametrize("n,every", [(97, 3), (251, 7), (33, 2), (12, 11)])
def test_split_matches_brute_force(spark, n, every):
    got = parts(S.stratified_split(labelled(spark, n, every)))
    classes = {1: [i for i in range(n) if i % every == 0], 0: [i for i in range(n) if i % every]}

    def shares(sizes, want, lone_first):
        total = sum(sizes.values())
        base = {c: s * want // total for c, s in sizes.items()}
        extra = want - sum(base.values())
        ranked = sorted(sizes, key=lambda c: ((len(classes[c]) >= 2) == lone_first, -(sizes[c] * want % total), c))
        return {c: base[c] + (ranked.index(c) < extra) for c in sizes}

    sizes = {c: len(m) for c, m in classes.items()}
    n_train = math.floor(0.8 * n)
    train = shares(sizes, n_train, True)
    rest = {c: sizes[c] - train[c] for c in sizes}
    val = shares(rest, math.floor(0.5 * (n - n_train)), False)
    expected = {"train": set(), "val": set(), "test": set()}
    for c, members in classes.items():
        ranked = order(members, 42)
        expected["train"].update(ranked[: train[c]])
        expected["val"].update(ranked[train[c] : train[c] + val[c]])
        expected["test"].update(ranked[train[c] + val[c] :])
    assert {k: got.get(k, set()) for k in expected} == expected


def test_ratios_are_checked(spark):
    with pytest.raises(ValueError):
        S.stratified_split(labelled(spark, 10), train=0.8, val=0.1, test=0.2)


def test_holdout_size_is_rounded_up(spark):
    assert len(parts(S.holdout_split(labelled(spark, 67_349, 2), 0.05))["val"]) == 3368


def test_lone_row_of_a_class_trains(spark):
    df = labelled(spark, 41, 1000)
    assert 0 in parts(S.stratified_split(df))["train"]
    assert 0 in parts(S.holdout_split(df, 0.05))["train"]


def test_groups_split_on_their_own_with_a_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, "mid").otherwise("cold").alias("lang"),
    )
    rows = S.stratified_split(df, group=["lang"]).groupBy("lang", "split").count().collect()
    assert {(r["lang"], r["split"]): r["count"] for r in rows} == {
        ("hot", "train"): 2000, ("hot", "val"): 250, ("hot", "test"): 250,
        ("mid", "train"): 392, ("mid", "val"): 49, ("mid", "test"): 49,
        ("cold", "train"): 8, ("cold", "val"): 1, ("cold", "test"): 1,
    }


def test_null_strata_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "doc_id LONG, label INT")
    assert S.stratified_split(df).count() == 40
    assert S.balanced_sample(df, ["label"]).groupBy("label").count().select("count").distinct().collect() == [(10,)]


def test_results_do_not_depend_on_partitioning(spark):
    df = labelled(spark, 500)
    assert parts(S.stratified_split(df.repartition(7))) == parts(S.stratified_split(df.coalesce(1)))


def test_balanced_sample_takes_the_first_of_each_order(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 45, "en").otherwise("de").alias("lang"))
    rows = S.combined(df, ["en", "de"]).collect()
    assert Counter(r["language"] for r in rows) == {"en": 15, "de": 15}
    assert {r["doc_id"] for r in rows if r["language"] == "en"} == set(order(range(45), 42)[:15])
    assert S.combined(df, ["en"], balance=False).count() == 45


def test_capped(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").repartition(5)
    assert {r["doc_id"] for r in S.capped(df, 7).collect()} == set(order(range(50), 42)[:7])
    assert {r["doc_id"] for r in S.capped(df, 3, seed=None).collect()} == {0, 1, 2}
    assert S.capped(df, 500).count() == 50 and S.capped(df, 0).count() == 0 == S.capped(df.limit(0), 3).count()
    assert S.capped(df, None).count() == 50
    assert [r["doc_id"] for r in S.shuffled(df, 1).collect()] == order(range(50), 1)


def test_nested_subsets(spark):
    df = spark.range(9681).withColumnRenamed("id", "doc_id")
    got = {}
    for r in S.nested_subsets(df, [100, 1000, 20_000], [42, 43]).collect():
        got.setdefault((r["seed"], r["size"]), set()).add(r["doc_id"])
    assert got[42, 100] == set(order(range(9681), 42)[:100])
    assert got[42, 100] < got[42, 1000] < got[42, 20_000] == set(range(9681))
    assert got[42, 100] != got[43, 100]


def test_selection_never_ranks_a_whole_stratum(spark):
    """The wide frame meets only broadcast cut rows: no shuffle or window above its scan."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumnRenamed("quality", "label"), "doc_id"
    )
    plan = S.stratified_split(df.select("doc_id", "label", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange")


def test_first_per_bucket_limits_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("if(id < 990, 'b', 'c')").alias("bucket"))
    top = S.first_per_bucket(df, "bucket", 5)
    assert [r["doc_id"] for r in top.filter("bucket = 'b'").orderBy("rn").collect()] == [0, 1, 2, 3, 4]
    for n in (5, 100_000):
        plan = S.first_per_bucket(df, "bucket", n)._jdf.queryExecution().executedPlan().toString()
        # Every full bucket is ranked in parts; only their first rows meet.
        assert plan.count("_salt") > 0 and plan.rindex("Exchange") > plan.index("Window")
    assert S.first_per_bucket(df, "bucket", 400).filter("bucket = 'b'").agg(F.max("doc_id"), F.count("*")).first() == (399, 400)
