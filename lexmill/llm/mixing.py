"""Mixing sources to target weights: exponential keys scaled by quality weights, sorted within each
source, prefix-summed to the source's budget of words; complete epochs come before the selection."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.common import map_arrow
from lexmill.llm.kernel import BLANK, byte_set, chunks
from lexmill.llm.ordered import running
from lexmill.sources.workdir import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII letters and the first byte of every other character.
LETTER = byte_set((65, 90), (97, 122), (0xC0, 0xFF))
#: Bytes two and on of a character.
INNER = byte_set((0x80, 0xBF))


@dataclass(frozen=True)
class Mix:
    """``weights`` go round the sources in code point order; a target stops at ``most`` times its source's size."""

    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 42


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, letters and characters other than blanks of every text of a chunk."""
    inside = ~BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = inside[inner]

    def per_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[offsets])

    return {"size": per_text(begins), "letters": per_text(LETTER[data]), "chars": per_text(inside & ~INNER[data])}


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, letters, chars`` of every row; a null text is empty."""

    def step(batch: pa.RecordBatch):
        for first, data, offsets in chunks(batch.column("text")):
            n = len(offsets) - 1
            yield {"doc_id": batch.column("doc_id").slice(first, n), "source": batch.column("source").slice(first, n), **counts(data, offsets)}

    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))])
    return map_arrow(rows, step, "doc_id bigint, source string, size bigint, letters bigint, chars bigint")


def letter_share() -> Column:
    """The weight used where none is given: how much of a text is letters, above 0 and at most 1."""
    return (F.col("letters") + 1) / (F.col("chars") + 1)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size, place, target`` from ``source, source_size``: one row per source.

    The sources share the sum of all sizes by weight. A target that would pass ``most`` times its
    source's size stops there and the others share the rest by weight, until none passes; sources
    taken by rising limit per weight, that is one running comparison, made in whole numbers. The
    windows see one row per source.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    weight = F.get(F.array(*[F.lit(int(w)).cast("long") for w in mix.weights]), ((F.col("place") - 1) % len(mix.weights)).cast("int"))
    rows = placed.withColumn("w", weight).withColumn("cap", F.col("source_size") * mix.most)
    everything = Window.partitionBy()
    rows = rows.select("*", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"))
    earlier = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("cap", "w")])
    rows = rows.select("*", (F.col("total") - F.col("cap_before")).alias("left"), (F.col("all_w") - F.col("w_before")).alias("left_w"))
    rows = rows.withColumn("full", whole("cap") * whole("left_w") < whole("w") * whole("left"))
    spent = [F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0)) for c in ("cap", "w")]
    rows = rows.select("*", (F.col("total") - spent[0]).cast("double").alias("rest"), (F.col("all_w") - spent[1]).cast("double").alias("rest_w"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("rest") / F.col("rest_w"))
    return rows.select("source", "source_size", "place", target.alias("target"))


def uniform(seed: int) -> Column:
    """A number between 0 and 1 from the md5 of seed and doc_id, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def plan(docs: DataFrame, mix: Mix = Mix(), quality: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, repeats, extra, taken``.

    ``docs`` has doc_id, source and text; other columns are ignored. A document is taken whole
    ``repeats`` times, as often as its source's budget (the whole words of its target) holds the
    source's size. What is left of the budget goes to documents by rising exponential key
    -ln(u) / quality: each gives all its words, the one at the border its first ``extra`` words,
    so a source's words add up to its budget exactly. ``quality`` is computed from size, letters
    and chars and must be above 0; where it is not given, the share of letters counts.

    A null text is empty, a null source is a source of its own and the last one, and sizes of 0
    take no part. Rows without a doc_id share one draw. Rows of one source with equal keys come by
    doc_id and size; what still ties is interchangeable. Empty tables give no rows. Runs jobs.
    """
    quality = letter_share() if quality is None else quality
    rows = materialize(measured(docs).select("doc_id", "source", "size", (-F.log(uniform(mix.seed)) / quality).alias("key")), "sizes")
    shares = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), mix), "targets")
    placed = rows.join(shares.select(F.col("source").alias("s"), "place"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = running(placed, "place", [F.col("key"), F.col("doc_id"), F.col("size")], "size")
    budget = F.floor("target")
    repeats = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    left = (budget - repeats * F.col("source_size")).alias("left")
    shares = shares.select(F.col("place").alias("p"), "source_size", "target", repeats.alias("repeats"), left)
    joined = before.join(shares, F.col("place") == F.col("p"))
    extra = F.least(F.greatest(F.col("left") - F.col("before"), F.lit(0)), F.col("size"))
    joined = joined.select("doc_id", "source", "size", "source_size", "target", "repeats", extra.alias("extra"))
    return joined.withColumn("taken", F.col("repeats") * F.col("size") + F.col("extra"))


def mixed(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The mix itself: ``doc_id, source, copy, text``, one row for every time a document is taken.

    ``chosen`` is the plan of ``docs``, whose doc_ids must be unique; rows without one are left
    out. The document at the border of its source is cut after its last word that fits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = chosen.filter("taken > 0").join(rows, "doc_id")
    whole = F.col("repeats") + (F.col("extra") == F.col("size")).cast("long")
    full = rows.filter(whole > 0).select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("copy"), "text")

    def step(batch: pa.RecordBatch):
        rows = batch.to_pydict()
        ends = [next(islice(WORD.finditer(t), n - 1, None)).end() for t, n in zip(rows["text"], rows["extra"])]
        yield {**{c: batch.column(c) for c in ("doc_id", "source", "copy")}, "text": pa.array([t[:e] for t, e in zip(rows["text"], ends)], pa.string())}

    # One document of each source at most.
    part = rows.filter("extra > 0 AND extra < size").select("doc_id", "source", (F.col("repeats") + 1).alias("copy"), "text", "extra")
    return full.unionByName(map_arrow(part, step, "doc_id bigint, source string, copy bigint, text string"))
