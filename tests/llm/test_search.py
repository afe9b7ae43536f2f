import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import topk as T

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, score INT, part INT"


def brute(rows, k, scale=64.0):
    whole = {i: [int(np.floor(scale * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], e)), i) for i, e in whole.items() if i != q and len(e) == len(whole[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 5, 16])
def test_results_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "GROUP", 4)
    random = np.random.default_rng(size)
    rows = [(i, [float(x) for x in np.round(random.normal(size=size), 1)]) for i in range(300)]
    rows += [(i, [0.5] * size) for i in range(300, 400)]  # ties
    rows += [(400, None), (420, [None] * size), (440, [float("nan")] * size), (441, [float("inf")] * size)]
    rows += [(460, []), (480, [1e7] * size), (481, [-1e7] * size), (482, [1.0] * (size + 1)), (None, [1.0] * size)]
    frame = spark.createDataFrame([(i, e, 1, 1) for i, e in rows], SCHEMA).repartition(5)
    got = T.top_k(frame, F.col("vec_id") % 20 == 0, T.Search(k=20))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_bounds_hold():
    random = np.random.default_rng(3)
    grid = random.integers(-60, 60, (50, 24)).astype(float)
    exact = grid @ grid.T
    last = np.full_like(exact, np.inf)
    for segments in (1, 2, 4, 8, 16):
        own = T.statistics(grid, segments)
        bound = own @ own.T
        assert (bound + 1e-6 >= exact).all()
        last = bound


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0], 1, 1), (1, [2.0], 1, 1)], SCHEMA)
    assert [tuple(r) for r in T.top_k(frame, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert T.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_numbers_beyond_doubles_are_exact():
    left, right = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 0.0]])
    assert T.exact(left, right, np.array([0, 0]), np.array([0, 1])).tolist() == [2**60 + 1, 2**60]
