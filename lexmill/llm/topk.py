"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

Vectors hold whole numbers: floor(64 x) of every component. A vector is cut into 1, 2, 4, ... equal
segments; of each the mean m and deviation s over its L places are kept. Two vectors lie at least

    sum over segments of L ((m_q - m_x)^2 + (s_q - s_x)^2)

apart (squared), and as squared distance = |q|^2 + |x|^2 - 2 <q, x>, their inner product is at most
the sum of L (m_q m_x + s_q s_x). Bounds are computed coarse to fine, each for the pairs the coarser
one left, against the k-th best score found so far; survivors get exact products.

Queries are dealt into groups by a hash of their key, candidates are packed in blocks and sent to
every group, and each (group, share of the blocks) is one stream of blocks for one task, which holds
a group, a block and the group's best k, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.llm.common import map_arrow
from lexmill.sources.workdir import materialize

BLOCK = 1024
GROUP = 512
STREAMS = 48
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Search:
    k: int = 20
    scale: float = 64.0


def packed(ids: np.ndarray, grid: np.ndarray) -> dict:
    """A block as one row, its numbers in the smallest type that holds them."""
    top = np.abs(grid).max(initial=0)
    kind = next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), np.float64)
    return {"width": grid.shape[1], "kind": np.dtype(kind).str, "ids": ids.astype(np.int64).tobytes(), "grid": grid.astype(kind).tobytes()}


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["grid"], row["kind"]).reshape(len(ids), row["width"]).astype(np.float64)


PACKED = "width int, kind string, ids binary, grid binary"


def grids(batch: pa.RecordBatch, scale: float):
    """(keys, whole-numbered vectors) of a batch's usable rows, by length of the vector."""
    lists = batch.column("embedding").cast(pa.list_(pa.float64()))
    keys = batch.column("vec_id").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # nulls are NaN here
    fine = (bad[offsets[1:]] == bad[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == size))
        at = offsets[rows][:, None] + np.arange(size)
        yield keys[rows].astype(np.int64), np.floor(scale * flat[at]).reshape(len(rows), size)


def blocks(vectors: DataFrame, search: Search) -> DataFrame:
    """Candidates packed in blocks of at most ``BLOCK`` vectors of equal length."""

    def step(batch):
        for ids, grid in grids(batch, search.scale):
            rows = [packed(ids[i : i + BLOCK], grid[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            yield {name: [r[name] for r in rows] for name in ("width", "kind", "ids", "grid")} | {"width": pa.array([r["width"] for r in rows], pa.int32())}

    return map_arrow(vectors, step, PACKED, "vec_id", "embedding")


def query_groups(queries: DataFrame, groups: int, search: Search) -> DataFrame:
    """Queries packed by group, one row for each length of vector in it."""

    def pack(key, table):
        whole = table.combine_chunks().to_batches()
        rows = [packed(ids, grid) | {"part": key[0].as_py()} for batch in whole for ids, grid in grids(batch, search.scale)]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int64()), ("width", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("grid", pa.binary())]))

    part = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    return queries.withColumn("part", part).groupBy("part").applyInArrow(pack, f"part long, {PACKED}")


def statistics(grid: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that a plain product of two rows is the bound."""
    size = -(-grid.shape[1] // segments)
    cut = np.zeros((len(grid), segments * size))
    cut[:, : grid.shape[1]] = grid
    cut = cut.reshape(len(grid), segments, size)
    return np.concatenate([cut.mean(axis=2), cut.std(axis=2)], axis=1) * np.sqrt(size)


def pair_products(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of ``left`` with rows j of ``right``, as a matrix where most pairs are asked for."""
    if len(i) * 5 > len(left) * len(right):
        return (left @ right.T)[i, j]
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("nd,nd->n", left[i[part]], right[j[part]])
    return out


def exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact products: in doubles where no sum can leave their whole numbers, else in Python's integers."""
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1) < EXACT:
        return pair_products(left, right, i, j).astype(np.int64)
    whole = [[int(x) for x in row] for row in left], [[int(x) for x in row] for row in right]
    return np.array([sum(a * b for a, b in zip(whole[0][p], whole[1][q])) for p, q in zip(i, j)], dtype=np.int64)


class Best:
    """The best k of each query of a group so far, fed block by block."""

    def __init__(self, ids: np.ndarray, grid: np.ndarray, k: int):
        self.ids, self.grid, self.k = ids, grid, k
        self.levels = [1 << p for p in range(20) if 1 << p < max(grid.shape[1], 1)]
        self.stats = [statistics(grid, s) for s in self.levels]
        self.query = np.zeros(0, np.int64)
        self.score, self.found = self.query, self.query
        self.bar = np.full(len(ids), -np.inf)

    def feed(self, ids: np.ndarray, grid: np.ndarray) -> None:
        i, j = np.nonzero(self.ids[:, None] != ids)
        if np.isfinite(self.bar).any():
            for segments, own in zip(self.levels, self.stats):
                if not len(i):
                    return
                bound = pair_products(own, statistics(grid, segments), i, j)
                # Room for rounding: a bound is a sum of doubles of its own size.
                keep = bound + 1e-9 * np.abs(bound) + 1e-6 >= self.bar[i]
                i, j = i[keep], j[keep]
        score = exact(self.grid, grid, i, j)
        query, score, found = np.concatenate([self.query, i]), np.concatenate([self.score, score]), np.concatenate([self.found, ids[j]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.found = query[keep], score[keep], found[keep]
        counts = np.bincount(self.query, minlength=len(self.ids))
        full = counts >= self.k
        last = np.searchsorted(self.query, np.arange(len(self.ids)), "right") - 1
        self.bar[full] = self.score[last[full]]


def top_k(vectors: DataFrame, is_query, search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best rows but its own. Runs jobs.

    ``vectors`` has vec_id (unique) and embedding; other columns are not read. ``is_query`` is a
    condition on its rows. Ties go to the smaller vec_id. A vector that is null, or holds a null or
    non-finite component, is neither query nor candidate; vectors of different lengths are not
    compared; an empty vector scores 0 with others; rows without vec_id are left out, and rows with
    the same vec_id are taken for the query's own. With fewer rows than k all are returned; an empty
    table gives none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL")
    asked = rows.filter("asks").select("vec_id", "embedding")
    groups = max(1, -(-asked.count() // GROUP))
    # Few groups alone would keep few tasks busy: then the blocks of a group go to several streams.
    shares = max(1, STREAMS // groups)
    packs = materialize(query_groups(asked, groups, search), "queries")
    found = materialize(blocks(rows.select("vec_id", "embedding"), search), "blocks")
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    share = F.pmod(F.xxhash64("ids"), F.lit(shares)).alias("share")
    sent = found.select("*", share).select("*", spread).withColumn("part", F.col("part").cast("long"))
    asked_rows = packs.select(
        "part", "width", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("grid").alias("q_grid"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    ).withColumn("share", F.col("share").cast("long"))
    joined = sent.join(asked_rows.hint("merge"), ["part", "share", "width"])

    def search_streams(batches):
        key, best = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["share"], row["width"]) != key:
                    if best is not None:
                        yield results(best)
                    key = (row["part"], row["share"], row["width"])
                    best = Best(*unpacked({"ids": row["q_ids"], "grid": row["q_grid"], "kind": row["q_kind"], "width": row["width"]}), search.k)
                best.feed(*unpacked(row))
        if best is not None:
            yield results(best)

    def results(best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": pa.array(best.ids[best.query]), "vec_id": pa.array(best.found), "score": pa.array(best.score)})

    each = joined.mapInArrow(search_streams, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
