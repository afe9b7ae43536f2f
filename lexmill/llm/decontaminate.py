"""Benchmark decontamination by greedy string tiling.

Tokens are words of letters and digits, A-Z lower-cased. Every ``min_match`` tokens in a row of a
benchmark item are a seed, found by their rolling fingerprint. Documents are read once; a bitmap of
fixed size keeps the seeds that may occur in the benchmark, and a join on the fingerprint says where
they stand there. Seeds of one document and item that follow each other in both are one match, so a
maximal match is as long as its run of seeds plus ``min_match`` - 1 tokens. Per document and item the
longest match whose tokens are free on both sides is marked, again and again, until none of
``min_match`` tokens is left; what the tiles cover of the item counts, in whatever order its parts
stand in the document.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import Members, map_arrow, texts
from lexmill.sources.workdir import materialize


@dataclass(frozen=True)
class Tiling:
    """Settings: tokens of the shortest match, and the covered share of an item from which on a
    document holds it. An item shorter than a match says too little and is matched by nothing."""

    min_match: int = 5
    coverage: float = 0.5


def tokens(data: np.ndarray, offsets: np.ndarray) -> K.Spans:
    return K.words(data, offsets, K.NOT_ALNUM)


def item_seeds(benchmark: DataFrame, tiling: Tiling) -> DataFrame:
    """(seed, item_id, at, n_tokens): the seeds of each item, from token ``at`` on."""

    def step(batch):
        ids = batch.column(0).to_numpy()
        for first, data, offsets in K.chunks(batch.column(1)):
            spans = tokens(data, offsets)
            seeds, start = K.sequences(spans, tiling.min_match)
            owner = np.searchsorted(spans.of, start, "right") - 1
            yield {
                "seed": K.signed(seeds),
                "item_id": ids[first + owner],
                "at": start - spans.of[owner],
                "n_tokens": np.diff(spans.of)[owner],
            }

    rows = texts(benchmark.drop("doc_id").withColumnRenamed("item_id", "doc_id"))
    return map_arrow(rows, step, "seed long, item_id long, at long, n_tokens long")


def document_seeds(docs: DataFrame, members: Members, tiling: Tiling) -> DataFrame:
    """(seed, doc_id, place) of all sequences that the filter lets pass."""

    def step(batch):
        ids = batch.column(0).to_numpy()
        for first, data, offsets in K.chunks(batch.column(1)):
            spans = tokens(data, offsets)
            seeds, start = K.sequences(spans, tiling.min_match)
            keep = np.flatnonzero(members(seeds))
            seeds, start = seeds[keep], start[keep]
            owner = np.searchsorted(spans.of, start, "right") - 1
            yield {"seed": K.signed(seeds), "doc_id": ids[first + owner], "place": start - spans.of[owner]}

    return map_arrow(texts(docs), step, "seed long, doc_id long, place long")


def tiles(places: np.ndarray, ats: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place, at, length) of the tiles a greedy tiling marks, given every pair of equal seeds.

    The longest match comes first; of equally long ones that of the smallest place, then at.
    """
    order = np.lexsort((places, places - ats))
    places, ats = places[order], ats[order]
    cut = np.flatnonzero((np.diff(places - ats) != 0) | (np.diff(places) != 1)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
    heap = [(-(int(e - s) + width - 1), int(places[s]), int(ats[s])) for s, e in zip(starts, ends)]
    heapify(heap)
    out, used, covered = [], set(), set()
    while heap:
        size, place, at = heappop(heap)
        free = [k for k in range(-size) if place + k not in used and at + k not in covered]
        if len(free) < -size:  # Parts of it are marked by now: what is left goes back as shorter matches.
            run = 0
            for i, k in enumerate(free):
                run += 1
                if i + 1 == len(free) or free[i + 1] != k + 1:
                    if run >= width:
                        heappush(heap, (-run, place + k - run + 1, at + k - run + 1))
                    run = 0
            continue
        out.append((place, at, -size))
        used.update(range(place, place - size))
        covered.update(range(at, at - size))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, tiles) of every document and item with a tile. Runs jobs.

    ``tiles`` are (place, at, length) in tokens of document and item. ``docs`` needs doc_id and text,
    ``benchmark`` item_id and text; other columns are not read. Null texts are empty; empty texts
    match nothing; rows without id are left out; rows with the same id count as one text's matches.
    Empty tables give no rows. Equal items each get their rows.
    """
    seeds = materialize(item_seeds(benchmark, tiling), "seeds")
    members = Members.of(seeds, "seed")
    hits = document_seeds(docs, members, tiling).join(seeds, "seed")

    def pair(key, table):
        place, at, size = (table.column(c).to_numpy() for c in ("place", "at", "n_tokens"))
        own = tiles(place, at, tiling.min_match)
        return pa.Table.from_pydict({
            "doc_id": [key[0]],
            "item_id": [key[1]],
            "n_tokens": [int(size[0])],
            "covered": pa.array([sum(t[2] for t in own)], pa.int64()),
            "tiles": pa.array([[{"place": p, "at": a, "length": n} for p, a, n in own]], TILES),
        })

    return (
        hits.select("doc_id", "item_id", "place", "at", "n_tokens")
        .groupBy("doc_id", "item_id")
        .applyInArrow(pair, "doc_id long, item_id long, n_tokens long, covered long, tiles array<struct<place:long,at:long,length:long>>")
    )


TILES = pa.list_(pa.struct([("place", pa.int64()), ("at", pa.int64()), ("length", pa.int64())]))


def contamination(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """The matches that cover enough of their item. Runs jobs."""
    return matches(docs, benchmark, tiling).filter(F.col("covered") >= F.col("n_tokens") * F.lit(tiling.coverage))


def report(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items it holds, the best coverage and its item. Runs jobs."""
    share = F.round(F.col("covered") / F.col("n_tokens"), 6)
    held = contamination(docs, benchmark, tiling).withColumn("share", share)
    held = held.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.max("share").alias("coverage"),
        F.max_by("item_id", F.struct("share", -F.col("item_id"))).alias("item_id"),
    )
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    return every.join(held, "doc_id", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        "item_id",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without doc_id stay. Runs jobs."""
    gone = contamination(docs, benchmark, tiling).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
