"""What the classifiers share: bounded samples of labelled rows, and logistic fitting in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def labelled_ids(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of rows marked 0 or 1; a doc_id marked both ways counts as 1."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return marks.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(marks: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each label, by the smallest hash of doc_id; the same on every run.

    The hash is of a salted key, so that it says nothing of the remainders rows are held out by.
    """
    order = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [marks.filter(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_rows(docs: DataFrame, marks: DataFrame, per_class: int, tasks: int = 16) -> DataFrame:
    """doc_id, label and the columns of ``docs`` of sampled rows; of equal texts the smallest doc_id counts.

    The sample has at most 2 x ``per_class`` ids, so it is safe to broadcast. Rows equal in text and
    doc_id are told apart by their other columns, so the result depends on nothing but the tables.
    """
    rows = docs.join(F.broadcast(sample(marks, per_class)), "doc_id")
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    first = rows.repartition(tasks, "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", *others)).alias("row"))
    return first.select("row.*", "text")


def in_order(rows: DataFrame) -> pd.DataFrame:
    """The rows on the driver, ordered by their columns ``doc_id`` and ``mark``, however they arrive.

    Sums and batches of a fit follow the order of rows, so without this a model would depend on
    how the table was dealt out.
    """
    return rows.toPandas().sort_values(["doc_id", "mark"], kind="stable", ignore_index=True)


def label_weights(marks: DataFrame, per_class: int) -> dict[int, float]:
    """How many labelled rows a sampled row of each label stands for: 1 where the bound does not bite.

    Rows weighted like this keep the labels' true shares, so scores mean the same at every size.
    """
    counts = marks.groupBy("label").agg(F.count("*").alias("n")).collect()
    return {r["label"]: r["n"] / min(r["n"], per_class) for r in counts}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def row_sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that ``of`` (n + 1 bounds) gives; empty runs are 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[of[1:]] - total[of[:-1]]


def adam(parameters: list[np.ndarray], gradients: Callable[[int], list[np.ndarray]], steps: int, rate: float) -> None:
    """Adam in place; ``gradients`` gets the number of the step."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(parameters, gradients(t - 1), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
