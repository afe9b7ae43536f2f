"""Importance resampling towards a target distribution: hashed n-grams of one to three words, found
by an overlapped regex scan, a gain for every bucket, and Gumbel scores of which the highest are drawn."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.common import map_arrow, texts
from lexmill.llm.kernel import LOWER, NOT_ALNUM
from lexmill.llm.ordered import running
from lexmill.sources.workdir import materialize

#: At every word: the word, and the second and third word after it with the space before each.
GRAMS = regex.compile(rb"(?<![^ ])([^ ]++)( [^ ]++)?+( [^ ]++)?+(?![^ ])")
#: A-Z become a-z and every byte between words a space.
PLAIN = bytes(32 if NOT_ALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))
#: So many words of one text are scanned at a time, and so many texts make one batch of results.
PART, ROWS = 1 << 18, 256


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents of at least ``min_words`` words are drawn; ``salt`` seeds the draw."""

    buckets: int = 10_000
    min_words: int = 20
    percent: int = 5
    salt: str = "42:"


def collapsed(text: str) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.encode().translate(PLAIN).split())


def feature_crcs(words: bytes, size: int = PART) -> Iterator[np.ndarray]:
    """crc32 of every run of one to three words, for ``size`` words at a time.

    A longer run goes on from the shorter one's crc.
    """
    matches = GRAMS.finditer(words, overlapped=True)
    while True:
        crcs = []
        add = crcs.append
        for match in islice(matches, size):
            one, two, three = match.groups()
            crc = crc32(one)
            add(crc)
            if two:
                crc = crc32(two, crc)
                add(crc)
                if three:
                    add(crc32(three, crc))
        if not crcs:
            return
        yield np.array(crcs, np.uint32)


def numbers(buckets: int) -> np.dtype:
    """The smallest type that holds the number of a bucket."""
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def text_buckets(words: bytes, buckets: int, size: int = PART) -> np.ndarray:
    """The bucket of every feature of a text, sorted."""
    kind = numbers(buckets)
    parts = [(crcs % np.uint32(buckets)).astype(kind) for crcs in feature_crcs(words, size)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, kind)


def featured(docs: DataFrame, setting: Resampling, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, buckets``, one row per document with a key; buckets as bytes of ``numbers``."""

    def step(batch: pa.RecordBatch):
        ids, column = batch.column("doc_id"), batch.column("text")
        for first in range(0, batch.num_rows, ROWS):
            all_words = [collapsed(text.as_py()) for text in column.slice(first, ROWS)]
            yield {
                "doc_id": ids.slice(first, ROWS),
                "n_words": pa.array([words.count(b" ") + 1 if words else 0 for words in all_words], pa.int64()),
                "buckets": pa.array([text_buckets(words, setting.buckets).tobytes() for words in all_words], pa.binary()),
            }

    return map_arrow(texts(docs, key), step, "doc_id bigint, n_words bigint, buckets binary")


def found(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows of a batch, one after the other, and where each row's begin (n + 1 places)."""
    kind = numbers(buckets)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // kind.itemsize
    flat = np.frombuffer(column.buffers()[2], kind, count=int(ends[-1]))[ends[0] :] if ends[-1] > ends[0] else np.zeros(0, kind)
    return flat, ends - ends[0]


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket. The driver gets one number per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(found(batch.column("buckets"), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(buckets), pa.int32()), "n": pa.array(total)})

    sums = features.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of target and corpus, rounded down."""
    size = len(corpus)
    s_all, t_all = float(corpus.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of a document's features."""

    def step(batch: pa.RecordBatch):
        if batch.num_rows:
            flat, ends = found(batch.column("buckets"), len(gain))
            upto = np.concatenate([[0], np.cumsum(gain[flat])])
            yield {**{c: batch.column(c) for c in ("doc_id", "n_words")}, "n_features": np.diff(ends), "weight": np.diff(upto[ends]).astype(np.int64)}

    return map_arrow(features, step, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, setting: Resampling = Resampling(), key: str = "doc_id", target_key: str = "item_id") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``, one row per document; undrawn rows have no rank.

    Texts are scanned once: what the scan finds is written as bucket numbers, from which the
    totals of the corpus and the weights are made. The documents long enough are sorted by score
    over the cluster, and the first ``percent`` of them are numbered.

    A null text has no features, weight 0 and its own score. Rows without a key are left out; a key
    given twice counts as two documents. Rows of equal score come by key. An empty target gives
    every bucket its share of smoothing. Empty tables give no rows. Runs jobs.
    """
    features = materialize(featured(docs, setting, key), "features")
    gain = gains(totals(features, setting.buckets), totals(featured(target, setting, target_key), setting.buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(setting.salt), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighted(features, gain).withColumn("score", F.col("weight") + gumbel), "scores")
    fits = F.col("n_words") >= setting.min_words
    rows = scored.withColumns({"_short": (~fits).cast("long"), "_one": F.lit(1).cast("long")})
    placed = running(rows, "_short", [F.desc("score"), F.col("doc_id")], "_one", "_before")
    # One number: how many documents are long enough.
    n = scored.filter(fits).count()
    chosen = fits & (F.col("_before") < setting.percent * n // 100)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(chosen, F.col("_before") + 1).alias("rank"))


def selected(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn documents with all their columns and ``_rank``; keys must be unique."""
    ranks = ranked.filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), F.col("rank").alias("_rank"))
    return docs.join(ranks, F.col("doc_id") == F.col("_drawn")).drop("_drawn")
