import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from fixtures import ALNUM, ODD, documents, prose, words

from lexmill.llm import resample as R


def brute_features(text):
    w = words(text, ALNUM)
    return [crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(texts, target, setting):
    corpus, goal = Counter(), Counter()
    for t in texts:
        corpus.update(c % setting.buckets for c in brute_features(t))
    for t in target:
        goal.update(c % setting.buckets for c in brute_features(t))
    size, total = corpus.total() + setting.buckets, goal.total() + setting.buckets
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * size / ((corpus[b] + 1) * total)))
    rows = []
    for i, t in enumerate(texts):
        f = brute_features(t)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(c % setting.buckets) for c in f)
        rows.append([i, len(words(t, ALNUM)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= setting.min_words), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(fit[: setting.percent * len(fit) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("text", ["", "one", "one two", "One  two\tTHREE four", " -a-b- ", "É-é x!y?z", "x" * 5000, "a " * 5000])
def test_scan_emits_every_run(text):
    for size in (1, 2, 1000):
        crcs = [c for part in R.feature_crcs(R.collapsed(text), size) for c in part.tolist()]
        assert sorted(crcs) == sorted(brute_features(text))


@pytest.mark.parametrize("buckets", [97, 1 << 16, 1 << 17])
def test_buckets_are_read_back(buckets):
    texts = ["", " ".join(prose(1, 30, 8)), "one", ""]
    own = [R.text_buckets(R.collapsed(t), buckets, 7) for t in texts]
    column = pa.array([b""] + [o.tobytes() for o in own], pa.binary()).slice(1)
    flat, ends = R.found(column, buckets)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sorted(c % buckets for c in brute_features(t)) for t in texts]


@pytest.mark.parametrize("setting", [R.Resampling(), R.Resampling(buckets=97, min_words=3, percent=40)])
def test_resample_equals_brute_force(spark, setting):
    texts = [" ".join(prose(i, i % 60, 80)) for i in range(250)] + ODD + ["w1 w2 w3 " * 10] * 30
    items = [" ".join(prose(1000 + i, 30, 40)) for i in range(20)] + [None, ""]
    target = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(items)], "item_id BIGINT, text STRING, counts INT, rank INT")
    got = R.resample(documents(spark, texts).repartition(5), target, setting)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(texts, items, setting)


def test_target_like_documents_are_drawn(spark):
    texts = [" ".join(prose(i, 50, 300)) for i in range(400)] + [" ".join(f"t{x}" for x in prose(i, 50, 60)) for i in range(20)]
    target = spark.createDataFrame([(i, " ".join(f"t{x}" for x in prose(900 + i, 60, 60))) for i in range(50)], "item_id BIGINT, text STRING")
    docs = documents(spark, texts)
    drawn = R.selected(docs, R.resample(docs, target))
    assert {r["doc_id"] for r in drawn.collect()} >= set(range(400, 420)) and drawn.count() == 21
    assert drawn.columns == [*docs.columns, "_rank"]


def test_odd_tables(spark):
    target = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert R.resample(documents(spark, []), target).count() == 0
    twice = documents(spark, ["a b " * 20, None]).union(documents(spark, ["c d " * 20]))
    rows = R.resample(twice, target, R.Resampling(percent=100)).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"] is None) for r in rows) == [(0, 117, False), (0, 117, False), (1, 0, True)]


def test_gains_are_floors_of_log_ratios():
    got = R.gains(np.array([0, 5]), np.array([3, 0]))
    assert got.tolist() == [math.floor(1000 * math.log(4 * 7 / (1 * 5))), math.floor(1000 * math.log(1 * 7 / (6 * 5)))]
