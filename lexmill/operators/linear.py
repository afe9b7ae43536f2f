"""TF-IDF logistic regression: distributed fit, table-shaped model, scoring by joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexmill.functions.scores import sigmoid
from lexmill.operators import features as V
from lexmill.operators.cleaning import clean_rows
from lexmill.operators.stats import class_weights
from lexmill.sources.workdir import materialize, new_path


@dataclass
class TfidfModel:
    """Settings and, once fitted, the model table.

    ``terms`` holds ``term, idx, tf, df, idf, coef``; its size is bounded by ``max_features``.
    ``depth`` is the number of levels over which the tasks' gradients are added up.
    """

    max_features: int = V.MAX_FEATURES
    ngram_range: tuple[int, int] = V.NGRAMS
    max_iter: int = 1000
    tolerance: float = 1e-6
    c: float = 1.0
    balanced: bool = True
    depth: int = 2
    intercept: float = 0.0
    train_rows: int = 0
    terms: DataFrame | None = field(default=None, repr=False)

    @property
    def is_fitted(self) -> bool:
        return self.terms is not None

    def require_fitted(self) -> DataFrame:
        if self.terms is None:
            raise RuntimeError("the model must be fitted before it can predict")
        return self.terms


def as_vectors(rows: DataFrame, size: int, indices: str = "indices", values: str = "values") -> DataFrame:
    """Rows with index and value arrays as rows with a sparse ``features`` vector.

    They are written in the stored layout of a vector, which the vector type itself declares,
    and read back as one: no row passes through Python, and the iterative fit gets a table that
    outlives lost executors. Runs a job.
    """
    spark = rows.sparkSession
    layout = VectorUDT.sqlType()
    parts = {"type": F.lit(0).cast("byte"), "size": F.lit(size).cast("int"), "indices": F.col(indices), "values": F.col(values)}
    stored = F.struct(*[part.alias(name) for name, part in parts.items()])
    made = rows.select(stored.alias("s")).schema["s"].dataType.simpleString()
    if made != layout.simpleString():
        raise RuntimeError(f"vectors are stored as {layout.simpleString()}, not as {made}")
    rest = [c for c in rows.columns if c not in (indices, values)]
    path = new_path(spark, "features")
    rows.select(*rest, stored.alias("features")).write.parquet(path)
    fields = [rows.schema[c] for c in rest] + [T.StructField("features", VectorUDT())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def fit(
    docs: DataFrame, settings: TfidfModel | None = None, text: str = "text", label: str = "label", key: str = "doc_id", clean: bool = True
) -> TfidfModel:
    """Fit vocabulary and coefficients on labelled texts; texts without words take part."""
    settings = settings or TfidfModel()
    if clean:
        docs = clean_rows(docs, text, drop_empty=False)
    return fit_counted(V.word_docs(docs, [label], key, text, settings.ngram_range), settings, label, key)


def fit_counted(
    counted: DataFrame, settings: TfidfModel | None = None, label: str = "label", key: str = "doc_id"
) -> TfidfModel:
    """Fit on a table of counted texts.

    Runs jobs; the driver gets one coefficient per vocabulary term, at most ``max_features``.
    Balanced class weights sum to the number of rows, so the penalty ``1 / (C n)`` of the mean
    loss is the penalty ``1 / C`` of the summed loss. The intercept carries none.
    """
    settings = settings or TfidfModel()
    spark = counted.sparkSession
    # The class counts are two numbers per class; two classes are required.
    weights = {row[label]: row for row in class_weights(counted.select(label), label=label).limit(3).collect()}
    if set(weights) != {0, 1}:
        raise ValueError(f"training needs rows of both classes 0 and 1, found {sorted(weights, key=str)}")
    n_rows = sum(row["n"] for row in weights.values())
    vocab = V.vocabulary(counted, settings.max_features, key)
    size = vocab.count()
    if size == 0:
        raise ValueError("the training texts hold no terms")
    rows = as_vectors(V.sparse_rows(counted, vocab, [label], key), size)
    weight = F.lit(1.0)
    if settings.balanced:
        weight = F.when(F.col(label) == 1, weights[1]["weight"]).otherwise(weights[0]["weight"])
    train = rows.select(F.col(label).cast("double").alias("label"), weight.alias("weight"), "features")
    # Every iteration is a job over the scan's partitions, which spark.sql.files.maxPartitionBytes sizes.
    solver = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / (settings.c * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=settings.max_iter,
        tol=settings.tolerance,
        aggregationDepth=settings.depth,
        family="binomial",
    )
    fitted = solver.fit(train)
    # One number per vocabulary term, at most max_features of them.
    coefficients = spark.createDataFrame(
        list(enumerate(fitted.coefficients.toArray().tolist())), "idx INT, coef DOUBLE"
    )
    table = materialize(vocab.join(coefficients, "idx").select("term", "idx", "tf", "df", "idf", "coef"), "model")
    return replace(settings, intercept=float(fitted.intercept), train_rows=n_rows, terms=table)


def dot_products(counted: DataFrame, model: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``key, keep..., _top, _square``: weight times coefficient and squared weight, summed per counted text.

    ``model`` has ``term, idf, coef``. Runs a job.
    """
    columns = [key, *keep]

    def body(part, table, row, place, n):
        w = (1 + np.log(n)) * V.numbers(table, "idf")[place]
        top, square = (np.bincount(row, v, part.num_rows) for v in (w * V.numbers(table, "coef")[place], np.square(w)))
        return {c: part.column(c) for c in columns} | {"_top": pa.array(top), "_square": pa.array(square)}

    schema = f"{V.schema_of(counted, columns)}, _top double, _square double"
    return V.looked_up(counted, columns, model.select("term", "idf", "coef"), body, schema)


def decide(z: Column) -> Column:
    return F.when(z > 0, 1).otherwise(0)


def score(docs: DataFrame, model: TfidfModel, keep: Sequence[str] = (), text: str = "text", key: str = "doc_id", clean: bool = True) -> DataFrame:
    """``key, keep..., z, score, pred, confidence``: ``score`` is the chance of the positive class."""
    model.require_fitted()
    if clean:
        docs = clean_rows(docs, text, drop_empty=False)
    columns = [key, *keep]
    sums = dot_products(V.word_rows(docs, keep, key, text, model.ngram_range), model.terms, key, keep)
    return score_sums(sums.groupBy(*columns).agg(F.sum("_top").alias("_top"), F.sum("_square").alias("_square")), model, keep, key)


def score_counted(counted: DataFrame, model: TfidfModel, keep: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """Scores of counted texts. Runs jobs."""
    sums = dot_products(V.one_per_key(counted, keep, key), model.require_fitted(), key, keep)
    return score_sums(sums, model, keep, key)


def score_sums(sums: DataFrame, model: TfidfModel, keep: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """Scores from one row of sums per document; one without known terms has the intercept's."""
    dot = F.coalesce(F.try_divide(F.col("_top"), F.sqrt("_square")), F.lit(0.0))
    summed = sums.select(key, *keep, dot.alias("_dot"))
    z = F.col("_dot") + F.lit(model.intercept)
    scored = summed.select(key, *keep, z.alias("z"), sigmoid(z).alias("score"))
    confidence = F.greatest(F.col("score"), 1 - F.col("score"))
    return scored.select("*", decide(F.col("z")).alias("pred"), confidence.alias("confidence"))


def save_model(model: TfidfModel, path: str) -> None:
    """Two tables: the terms with their coefficients, and one row of settings."""
    table = model.require_fitted()
    table.write.mode("overwrite").parquet(f"{path}/terms")
    settings = [(
        model.max_features, list(model.ngram_range), model.max_iter, model.tolerance, model.c, model.balanced,
        model.depth, model.intercept, model.train_rows,
    )]
    table.sparkSession.createDataFrame(
        settings,
        "max_features INT, ngram_range ARRAY<INT>, max_iter INT, tolerance DOUBLE, c DOUBLE, balanced BOOLEAN, "
        "depth INT, intercept DOUBLE, train_rows BIGINT",
    ).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark, path: str) -> TfidfModel:
    row = spark.read.parquet(f"{path}/settings").head()
    return TfidfModel(
        row["max_features"], tuple(row["ngram_range"]), row["max_iter"], row["tolerance"], row["c"], row["balanced"],
        row["depth"], row["intercept"], row["train_rows"], spark.read.parquet(f"{path}/terms"),
    )
