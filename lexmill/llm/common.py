"""Helpers the operators share: input tables, keys, membership filters, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.sources.workdir import materialize

FILTER_BITS = 1 << 24
BITMAP_BITS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and text of rows that have a key; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(
        "doc_id IS NOT NULL"
    )


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, *columns: str) -> DataFrame:
    """``mapInArrow`` for a step that turns a batch into column dictionaries, one per chunk."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_pydict({k: pa.array(out[k]) if not isinstance(out[k], pa.Array) else out[k] for k in names})
            pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(run, schema) if columns else df.mapInArrow(run, schema)


class Members:
    """A set of 64-bit keys as a bitmap of fixed size: no key is missed, a few others pass.

    Its size is ``bits`` / 8 bytes whatever the number of keys; with very many keys it lets more
    rows pass, and the join that follows does the exact work.
    """

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    @staticmethod
    def of(df: DataFrame, key: str, bits: int = FILTER_BITS) -> Members:
        """Built on the executors, in pieces of 4 KB; the driver gets ``bits`` / 8 bytes at most."""
        slot = F.pmod(F.col(key), F.lit(bits))
        pieces = (
            df.select(slot.alias("slot"))
            .groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
            .collect()
        )
        # Bucket b holds the positions from (b - 1) * 32768 + 1 to b * 32768, bucket 0 the position 0.
        bitmap = np.zeros(bits // 8 + 2 * BITMAP_BITS // 8, dtype=np.uint8)
        for bucket, piece in pieces:
            at = bucket * BITMAP_BITS // 8
            bitmap[at : at + len(piece)] |= np.frombuffer(bytes(piece), np.uint8)
        return Members(bitmap)

    def __call__(self, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
        """Which of the keys (64 bits, signed or not) may be members."""
        slot = (np.ascontiguousarray(keys).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
        bucket = np.where(slot > 0, 1 + (slot - 1) // BITMAP_BITS, 0)
        position = np.where(slot > 0, (slot - 1) % BITMAP_BITS, -slot % BITMAP_BITS)
        at = bucket * BITMAP_BITS + position
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def crc_rest(key: str | Column, by: int) -> Column:
    """crc32 of the key written as text, modulo ``by``."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % by


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that reaches a smaller one.

    Alternates hooking every neighbourhood to its smallest node and to smaller nodes only, until
    nothing changes; the number of rounds grows with the logarithm of the longest path. Each round
    writes its edges to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    links = materialize(links, name)
    if links.isEmpty():
        return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    last = None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest of its neighbourhood.
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
        links = materialize(small, name)
        state = links.agg(F.count("*"), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        last = state
    raise RuntimeError(f"components have not settled after {rounds} rounds")
