"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Features of a text are its distinct words, hashed to ``WORDS`` places and scaled to length one, and
one place for each statistic's bin: shares of characters, words and lines of some kind, sizes, and
the number of characters the table states. Every feature i has a weight w_i and a short vector v_i;
the score is the logistic of

    w_0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

whose last sum is half of the squared length of sum_i v_i x_i less sum_i |v_i|^2 x_i^2, so a text is
scored in time linear in its features. The model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import map_arrow
from lexmill.llm.labelled import adam, in_order, label_weights, labelled_ids, row_sums, sampled_rows, sigmoid

WORDS = 1 << 12
BINS = 12
STATISTICS = (
    "upper", "symbol", "digit", "stop", "feed", "word_length", "repeat", "longest_repeat", "distinct", "odd_word",
    "line_words", "equal_lines", "words", "chars_stated",
)
FEATURES = WORDS + BINS * len(STATISTICS)

UPPER = K.byte_set((65, 90))
SYMBOL = K.byte_set((33, 33), (35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
DIGIT = K.byte_set((48, 57))
STOP = K.byte_set((44, 44), (46, 46), (58, 59), (63, 63))
FEED = K.byte_set((10, 10))


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the sample: at most so many labelled rows of either label are learned from."""

    per_class: int = 4000
    rank: int = 8
    epochs: int = 40
    batch: int = 256
    rate: float = 0.01
    penalty: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """Bin bounds of the statistics, and the machine's parameters."""

    bounds: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def described(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (a row per text), and the places of each text's distinct words with their bounds."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def share(kind):
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    spans = K.words(data, offsets)
    count = np.diff(spans.of)
    some = np.maximum(count, 1)
    owner = spans.owner()
    equal = np.zeros(len(owner), dtype=bool)
    equal[1:] = (spans.hash[1:] == spans.hash[:-1]) & (owner[1:] == owner[:-1])
    run = np.arange(len(owner)) - np.maximum.accumulate(np.where(equal, -1, np.arange(len(owner)))) if len(owner) else np.zeros(0, np.int64)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, run)
    odd = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    odd_word = np.bincount(owner, weights=(odd[spans.end] - odd[spans.start] > 0), minlength=n)
    order = np.lexsort((spans.hash, owner))
    hashes, owners = spans.hash[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    distinct = np.bincount(owners, minlength=n)
    starts, of_text = K.lines(data, offsets)
    n_lines = np.diff(of_text)
    line_hash = K.span_hash(data, starts[:-1], starts[1:])
    line_owner = np.repeat(np.arange(n), n_lines)
    full = np.diff(starts) > 1
    order = np.lexsort((line_hash, line_owner))
    same = np.zeros(len(order), dtype=bool)
    lh, lo = line_hash[order], line_owner[order]
    same[1:] = (lh[1:] == lh[:-1]) & (lo[1:] == lo[:-1]) & full[order][1:]
    grid = np.stack([
        share(UPPER), share(SYMBOL), share(DIGIT), share(STOP), share(FEED),
        np.bincount(owner, weights=spans.end - spans.start, minlength=n) / some,
        np.bincount(owner, weights=equal, minlength=n) / some,
        longest,
        distinct / np.sqrt(some),
        odd_word / some,
        count / np.maximum(n_lines, 1),
        np.bincount(lo, weights=same, minlength=n) / np.maximum(n_lines, 1),
        np.log1p(count),
        np.log1p(np.maximum(stated, 0)),
    ], axis=1)
    return grid, (hashes & np.uint64(WORDS - 1)).astype(np.int64), np.searchsorted(owners, np.arange(n + 1))


def features(grid: np.ndarray, places: np.ndarray, of: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and bounds of each text's features: its words, then the bin of each statistic."""
    n, kinds = grid.shape
    bins = np.stack([np.searchsorted(bounds[k], grid[:, k], "right") for k in range(kinds)], axis=1)
    bins += WORDS + BINS * np.arange(kinds)
    count = np.diff(of)
    value = np.repeat(1 / np.sqrt(np.maximum(count, 1)), count)
    owner = np.concatenate([np.repeat(np.arange(n), count), np.repeat(np.arange(n), kinds)])
    order = np.argsort(owner, kind="stable")
    return (
        np.concatenate([places, bins.ravel()])[order],
        np.concatenate([value, np.full(n * kinds, 1 / np.sqrt(kinds))])[order],
        of + kinds * np.arange(n + 1),
    )


def machine(at: np.ndarray, value: np.ndarray, of: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text before the logistic, by the sum-of-squares identity, and sum_i v_i x_i."""
    scaled = factors[at] * value[:, None]
    total = row_sums(scaled, of)
    pairs = 0.5 * ((total**2).sum(axis=1) - row_sums((scaled**2).sum(axis=1), of))
    return bias + row_sums(linear[at] * value, of) + pairs, total


def text_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the stated number of characters; without such a column or value, the text's own."""
    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), stated.alias("stated")).filter("doc_id IS NOT NULL")
    return rows.withColumn("stated", F.when(F.isnan("stated"), None).otherwise(F.col("stated"))).withColumn("stated", F.coalesce("stated", F.length("text").cast("double")))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from labelled texts; without labels of both kinds it scores everything alike. Runs jobs.

    The driver gets the sample's statistics and word places, bounded by ``per_class``; texts stay on
    the executors. Rows are weighted so that the labels' true shares hold whatever the sample's are.
    The model does not depend on the order or partitioning of the tables.
    """
    marks = labelled_ids(labels, "quality")
    weights = label_weights(marks, settings.per_class)

    def step(batch):
        ids, mark, label, stated = (batch.column(c).to_numpy() for c in ("doc_id", "mark", "label", "stated"))
        for first, data, offsets in K.chunks(batch.column("text")):
            rows = slice(first, first + len(offsets) - 1)
            grid, places, of = described(data, offsets, stated[rows])
            yield {"doc_id": ids[rows], "mark": mark[rows], "label": label[rows], "grid": list(grid), "places": K.long_lists([places[a:b] for a, b in zip(of[:-1], of[1:])])}

    rows = sampled_rows(text_columns(docs), marks, settings.per_class).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, label int, grid array<double>, places array<long>"
    got = in_order(map_arrow(rows, step, schema, "doc_id", "mark", "label", "text", "stated"))
    y = got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(np.zeros((len(STATISTICS), BINS - 1)), 40.0 if y.any() else -40.0, np.zeros(FEATURES), np.zeros((FEATURES, settings.rank)))
    grid = np.stack(got["grid"].to_numpy())
    # Even bins for the bulk, finer ones at either end, where the odd texts are.
    cuts = [0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.85, 0.93, 0.97, 0.99]
    bounds = np.quantile(grid, cuts, axis=0).T
    lists = [np.asarray(x, dtype=np.int64) for x in got["places"]]
    of = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    at, value, of = features(grid, np.concatenate(lists), of, bounds)
    weight = np.where(y == 1, weights[1], weights[0])
    weight /= weight.mean()
    random = np.random.default_rng(settings.seed)
    bias, linear = np.zeros(1), np.zeros(FEATURES)
    factors = random.normal(0, 0.05, (FEATURES, settings.rank))
    rounds = [random.permutation(len(y)) for _ in range(settings.epochs)]
    batches = [r[i : i + settings.batch] for r in rounds for i in range(0, len(y), settings.batch)]

    def gradients(k):
        rows = batches[k]
        count = of[rows + 1] - of[rows]
        own = np.concatenate([[0], np.cumsum(count)])
        pick = np.repeat(of[rows] - own[:-1], count) + np.arange(own[-1])
        a, x = at[pick], value[pick]
        z, total = machine(a, x, own, bias[0], linear, factors)
        miss = np.repeat((sigmoid(z) - y[rows]) * weight[rows] / len(rows), count)
        slope = (miss * x)[:, None] * (np.repeat(total, count, axis=0) - factors[a] * x[:, None])
        by_factor = np.stack([np.bincount(a, weights=slope[:, f], minlength=FEATURES) for f in range(settings.rank)], axis=1)
        return [
            np.array([((sigmoid(z) - y[rows]) * weight[rows]).mean()]),
            np.bincount(a, weights=miss * x, minlength=FEATURES) + settings.penalty * linear,
            by_factor + settings.penalty * factors,
        ]

    adam([bias, linear, factors], gradients, len(batches), settings.rate)
    return Model(bounds, float(bias[0]), linear, factors)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): from 0 to 1, higher where label 1 is likelier.

    ``docs`` has doc_id, text and perhaps n_chars; other columns are not read. Null and empty texts
    are scored by their statistics, which are those of a text without words; rows without doc_id are
    left out; repeated rows score alike. An empty table gives no rows.
    """

    def step(batch):
        ids, stated = batch.column("doc_id").to_numpy(), batch.column("stated").to_numpy()
        for first, data, offsets in K.chunks(batch.column("text")):
            rows = slice(first, first + len(offsets) - 1)
            at, value, of = features(*described(data, offsets, stated[rows]), model.bounds)
            yield {"doc_id": ids[rows], "score": sigmoid(machine(at, value, of, model.bias, model.linear, model.factors)[0])}

    return map_arrow(text_columns(docs), step, "doc_id long, score double", "doc_id", "text", "stated")
