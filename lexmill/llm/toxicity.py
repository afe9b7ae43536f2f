"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 3 to 5 characters of a lower-cased text, within a word and its
blank on either side; characters other than letters and digits are blanks. On a bounded sample of
labelled rows Spark counts in how many texts of each label every n-gram stands. N-grams whose counts
differ by more than chance are kept, each scaled by its log-count ratio, and a logistic regression
with L2 penalty gives their weights. The fitted model has at most ``max_features`` weights; texts are
scored against them in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import map_arrow, texts
from lexmill.llm.labelled import adam, in_order, label_weights, labelled_ids, row_sums, sampled_rows, sigmoid

SIZES = (3, 4, 5)
STEP = K.mix(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)
SLOTS = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the sample: at most so many labelled rows of either label are learned from.

    ``min_docs`` and ``chi`` are the least number of texts and the least chi-square of a kept n-gram.
    """

    per_class: int = 6000
    min_docs: int = 5
    chi: float = 30.0
    max_features: int = 20_000
    alpha: float = 1.0
    penalty: float = 1e-4
    steps: int = 300


@dataclass(frozen=True)
class Model:
    """Fingerprints of the n-grams, ascending; their weights times log-count ratios; the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        slots = np.zeros(SLOTS, dtype=bool)
        slots[(self.grams & np.uint64(SLOTS - 1)).astype(np.int64)] = True
        object.__setattr__(self, "slots", slots)


def codes(batch: pa.Array, limit: int = K.CHUNK):
    """(first row, code points, bounds) of runs of lower-cased texts, each text between two blanks."""
    rows, size, first = [], 0, 0
    for i, text in enumerate(batch.to_pylist()):
        rows.append((text or "").lower())
        size += len(rows[-1])
        if size >= limit:
            yield first, *joined(rows)
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, *joined(rows)


def joined(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer((" " + " ".join(rows) + " ").encode("utf-32-le", "replace"), np.uint32)
    bounds = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=bounds[1:])
    letter = (flat > 127) | ((flat >= 97) & (flat <= 122)) | ((flat >= 48) & (flat <= 57))
    return np.where(letter, flat, 32), bounds


def grams(flat: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams and the text of each; ``wanted`` drops those whose slot is not set."""
    blank = flat == 32
    found, owners = [], []
    total = np.zeros(len(flat), dtype=np.uint64)
    gap = np.zeros(len(flat), dtype=bool)  # a blank inside the n-gram, not at either end
    for size in range(1, SIZES[-1] + 1):
        n = len(flat) - size + 1
        if n <= 0:
            break
        total = total[:n] + flat[size - 1 :].astype(np.uint64) * STEP[size - 1]
        if size > 2:
            gap = gap[:n] | blank[size - 2 : size - 2 + n]
        if size in SIZES:
            hashes = K.mix(total + np.uint64(size))
            keep = ~gap[:n]
            if wanted is not None:
                keep &= wanted[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
            at = np.flatnonzero(keep)
            found.append(hashes[at])
            # A leading blank belongs to the text after it.
            owners.append(np.searchsorted(bounds, at, "right") - 1)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def distinct(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once per text, in the order of texts."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (np.diff(hashes) != 0) | (np.diff(owners) != 0)
    return hashes[new], owners[new]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, label, n): in how many texts of a label an n-gram stands, counted per chunk first."""

    def step(batch):
        labels = batch.column("label").to_numpy()
        for first, flat, bounds in codes(batch.column("text")):
            hashes, owners = distinct(*grams(flat, bounds))
            own = labels[first + owners]
            for label in (0, 1):
                values, counts = np.unique(hashes[own == label], return_counts=True)
                yield {"gram": K.signed(values), "label": np.full(len(values), label, np.int32), "n": counts}

    return map_arrow(rows, step, "gram long, label int, n long", "label", "text").groupBy("gram", "label").agg(F.sum("n").alias("n"))


def matched(flat: np.ndarray, bounds: np.ndarray, model_grams: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the model's n-gram, text) for each distinct n-gram of the model in a text."""
    hashes, owners = grams(flat, bounds, slots)
    at = np.searchsorted(model_grams, hashes)
    at[at == len(model_grams)] = 0
    known = model_grams[at] == hashes if len(model_grams) else np.zeros(len(at), dtype=bool)
    at, owners = distinct(at[known].astype(np.uint64), owners[known])
    return at.astype(np.int64), owners


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from labelled texts. Runs jobs.

    With labels of one kind only every text gets that label, without any labels 0. Rows are weighted
    so that the labels' true shares hold whatever the sample's are. The driver gets the kept n-grams
    and the sample's rows in terms of them, both bounded by the settings. The model does not depend
    on the order or partitioning of the tables.
    """
    marks = labelled_ids(labels, "toxic")
    rows = sampled_rows(texts(docs), marks, settings.per_class).withColumn("mark", F.xxhash64("text"))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if n1 else -40.0)
    counts = gram_counts(rows).groupBy("gram").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("q"),
    )
    a, b = F.col("p").cast("double"), F.col("q").cast("double")
    cross = a * (n0 - b) - b * (n1 - a)
    chi = cross * cross * float(n0 + n1) / ((a + b) * (n0 + n1 - a - b) * float(n0) * float(n1) + 1e-9)
    kept = counts.filter(F.col("p") + F.col("q") >= settings.min_docs).withColumn("chi", chi)
    kept = kept.filter(F.col("chi") >= settings.chi).orderBy(F.desc("chi"), "gram").limit(settings.max_features).toPandas()
    gram = np.ascontiguousarray(kept["gram"].to_numpy(np.int64)).view(np.uint64)
    order = np.argsort(gram)
    gram, p, q = gram[order], kept["p"].to_numpy(float)[order], kept["q"].to_numpy(float)[order]
    ratio = np.log((p + settings.alpha) / (n1 + 2 * settings.alpha)) - np.log((q + settings.alpha) / (n0 + 2 * settings.alpha))
    blank = Model(gram, ratio, 0.0)

    def step(batch):
        ids, mark, label = (batch.column(c).to_numpy() for c in ("doc_id", "mark", "label"))
        for first, flat, bounds in codes(batch.column("text")):
            at, owners = matched(flat, bounds, blank.grams, blank.slots)
            cuts = np.searchsorted(owners, np.arange(len(bounds)))
            own = slice(first, first + len(bounds) - 1)
            yield {"doc_id": ids[own], "mark": mark[own], "label": label[own], "at": K.long_lists([at[x:y] for x, y in zip(cuts[:-1], cuts[1:])])}

    table = in_order(map_arrow(rows, step, "doc_id long, mark long, label int, at array<long>", "doc_id", "mark", "label", "text"))
    labels_, lists = table["label"].to_numpy(float), [np.asarray(x, dtype=np.int64) for x in table["at"]]
    of = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    at = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(of))
    share = label_weights(marks, settings.per_class)
    counts_as = np.where(labels_ == 1, share[1], share[0])
    counts_as /= counts_as.mean()
    weights, intercept = np.zeros(len(gram)), np.zeros(1)

    def gradients(_):
        miss = sigmoid(row_sums((weights * ratio)[at], of) + intercept[0]) - labels_
        miss *= counts_as
        slope = np.bincount(at, weights=miss[owner], minlength=len(gram)) * ratio / len(lists)
        return [slope + settings.penalty * weights, np.array([miss.mean()])]

    adam([weights, intercept], gradients, settings.steps, 0.05)
    return Model(gram, weights * ratio, float(intercept[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): from 0 to 1, higher where toxic is likelier.

    ``docs`` has doc_id and text; other columns are not read. Null and empty texts score what a text
    without any n-gram does; rows without doc_id are left out; repeated rows score alike. An empty
    table gives no rows.
    """

    def step(batch):
        ids = batch.column("doc_id").to_numpy()
        for first, flat, bounds in codes(batch.column("text")):
            at, owners = matched(flat, bounds, model.grams, model.slots)
            total = np.bincount(owners, weights=model.weights[at], minlength=len(bounds) - 1)[: len(bounds) - 1]
            yield {"doc_id": ids[first : first + len(bounds) - 1], "score": sigmoid(total + model.intercept)}

    return map_arrow(texts(docs), step, "doc_id long, score double", "doc_id", "text")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; rows without doc_id stay. Runs jobs."""
    gone = score(docs, fit(docs, labels, settings)).filter(F.col("score") >= threshold).select(F.col("doc_id").alias("_gone"))
    gone = gone.distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
