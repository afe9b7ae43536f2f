import math
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import RETAINED

from lexmill.operators import features as V

TABLES = "documents labels pages conversations events embeddings benchmark".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def rows(frame):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return repr(float(v)) if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


class Plans:
    """The plans of all SQL executions that start inside the block, those between stages included.

    Executions are told apart by their ids: the store forgets the oldest, so its length says nothing.
    """

    def __init__(self, spark):
        self.context, self.store = spark.sparkContext, spark._jsparkSession.sharedState().statusStore()

    def executions(self):
        self.context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        kept = self.store.executionsList()
        return [kept.apply(i) for i in range(kept.size())]

    def __enter__(self):
        self.last = max((e.executionId() for e in self.executions()), default=-1)
        return self

    def __exit__(self, *_):
        new = [e for e in self.executions() if e.executionId() > self.last]
        self.ids = sorted(e.executionId() for e in new)
        self.texts = [e.physicalPlanDescription() for e in new]


def check_plans(plans):
    """No plan of the block was forgotten, the query's own is among them, and none holds what it should not."""
    assert plans.ids == list(range(plans.last + 1, plans.last + 1 + len(plans.ids))) and plans.ids
    texts = plans.texts
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEvalPython"):
        assert not [t for t in texts if word in t]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    with Plans(spark) as plans:
        got = QUERIES[name](spark, sf_dir).toPandas()
    check_plans(plans)
    expected = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) > 0 and rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    with Plans(spark) as plans:
        assert QUERIES[name](spark, sf_dir).count() > 0
    check_plans(plans)


def test_guard_sees_plans_beyond_those_the_store_keeps(spark):
    """More executions than are retained run before and inside other blocks."""
    for _ in range(RETAINED + 20):
        spark.range(1).write.format("noop").mode("overwrite").save()
    with Plans(spark) as plans:
        spark.range(3).alias("a").crossJoin(spark.range(3).alias("b")).collect()
    assert len(plans.texts) == 1
    with pytest.raises(AssertionError):
        check_plans(plans)
    with Plans(spark) as plans:
        for _ in range(RETAINED + 20):
            spark.range(1).write.format("noop").mode("overwrite").save()
    with pytest.raises(AssertionError):
        check_plans(plans)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_run_chain_makes_its_vocabulary_once(spark, sf_dir, monkeypatch):
    made, vocabulary = [], V.vocabulary
    monkeypatch.setattr(V, "vocabulary", lambda *a, **b: made.append(a) or vocabulary(*a, **b))
    assert QUERIES["q_run_chain"](spark, sf_dir).count() and len(made) == 1
