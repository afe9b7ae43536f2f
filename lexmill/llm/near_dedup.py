"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Texts with equal shingle sets become one class at once, so a group of copies costs one row. Every
class has a signature of 128 MinHash values. Each of the forest's orders reads the signature from
another place on; all classes are sorted by it over the cluster, and classes that stand close
together with a common prefix of at least ``MIN_DEPTH`` values are candidates. How deep a prefix
counts depends on the region: up to ``NEAR`` classes below one prefix are all compared; in a denser
region a class is compared with its ``DENSE`` next neighbours, which share the longest prefixes, and
with the smallest class below its prefixes of several depths. Sorting splits a dense region over
tasks like any other rows, and the candidates of a class are bounded, so no group emits its pairs.

Components need not every link: first each class is confirmed against its best candidate only, then
the other candidates between different components. Then every class of a dense region that is outside
the region's main component is compared with all others of the region, wherever they were sorted: both
are spread by hash over blocks, and every two blocks meet in a group of rows of bounded size. A class
comes with its difference to the region's hub, the smallest class. As X and M differ where exactly one
of X - H and M - H (symmetric differences) has a shingle, these lists give the exact similarity, by an
inverted index over them. One link is handed on for each class and component it found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import Members, components, map_arrow, texts
from lexmill.sources.workdir import materialize

VALUES = 128
MIN_DEPTH = 3
DEPTH = 12
NEAR = 8
DENSE = 2
HUB_DEPTHS = (3, 6)
BLOCK = 1024


@dataclass(frozen=True)
class Forest:
    """Settings: words of a shingle, link threshold in percent, number of sorted orders."""

    words: int = 5
    percent: int = 85
    orders: int = 12
    seed: int = 7


def multipliers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    grid = K.mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))
    return grid[:VALUES] | np.uint64(1), grid[VALUES:]


def signature(shingles: np.ndarray, seed: int) -> np.ndarray:
    """``VALUES`` MinHash values of 16 bits."""
    up, add = multipliers(seed)
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024, None] * up + add
        np.minimum(least, (part >> np.uint64(16)).min(axis=0), out=least)
    return least.astype(np.uint16)


def fingerprints(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, n_shingles, set_hash (two LONGs in one string of bytes) and signature of each text."""

    def step(batch):
        ids = batch.column(0).to_numpy()
        for first, data, offsets in K.chunks(batch.column(1)):
            spans = K.words(data, offsets)
            out = {"doc_id": ids[first : first + len(offsets) - 1], "n_shingles": [], "set_hash": [], "signature": []}
            for a, b in zip(spans.of[:-1], spans.of[1:]):
                own = K.shingles(spans.hash[a:b], forest.words)
                whole = np.array([own.sum(), K.mix(own).sum()] if len(own) else [0, 0], dtype=np.uint64)
                out["n_shingles"].append(len(own))
                out["set_hash"].append(whole.tobytes())
                out["signature"].append(signature(own, forest.seed).tobytes() if len(own) else b"")
            out["n_shingles"] = pa.array(out["n_shingles"], pa.int64())
            out["set_hash"] = pa.array(out["set_hash"], pa.binary())
            out["signature"] = pa.array(out["signature"], pa.binary())
            yield out

    return map_arrow(texts(docs), step, "doc_id long, n_shingles long, set_hash binary, signature binary")


def sorted_orders(classes: DataFrame, forest: Forest) -> DataFrame:
    """One row per class and order: ``key``, the order's number and the signature read from its place."""

    def step(batch):
        ids = batch.column("doc_id").to_numpy()
        if not len(ids):
            return
        values = byte_grid(batch.column("signature"), 2 * VALUES).view(np.uint16)
        for order in range(forest.orders):
            at = (order * VALUES // forest.orders + np.arange(DEPTH)) % VALUES
            rows = np.ascontiguousarray(values[:, at].byteswap())
            flat = rows.view(np.uint8).reshape(len(ids), 2 * DEPTH)
            keys = np.concatenate([np.full((len(ids), 1), order, np.uint8), flat], axis=1)
            yield {"key": pa.FixedSizeBinaryArray.from_buffers(pa.binary(keys.shape[1]), len(ids), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary()), "doc_id": ids}

    return map_arrow(classes, step, "key binary, doc_id long", "doc_id", "signature")


WIDTH = 1 + 2 * DEPTH


def common_depth(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Number of leading values two rows of keys share; -1 where the order differs."""
    differs = upper != lower
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)
    return (first - 1) // 2


def neighbours(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows sorted by key."""
    n = len(ids)
    left, right = [], []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = common_depth(keys[:-1], keys[1:])
    region = np.concatenate([[0], np.cumsum(depth < MIN_DEPTH)])
    size = np.bincount(region)[region]
    dense = size > NEAR
    for step in range(1, NEAR):
        if step >= n:
            break
        same = region[:-step] == region[step:]
        keep = np.flatnonzero(same & ((size[:-step] <= NEAR) | (step <= DENSE)))
        left.append(ids[keep])
        right.append(ids[keep + step])
    for at in HUB_DEPTHS:
        below = np.concatenate([[0], np.cumsum(depth < at)])
        starts = np.flatnonzero(np.concatenate([[True], below[1:] != below[:-1]]))
        hub = np.minimum.reduceat(ids, starts)[below]
        keep = dense & (hub != ids)
        left.append(hub[keep])
        right.append(ids[keep])
    return np.concatenate(left), np.concatenate(right)


def regions(keys: np.ndarray) -> np.ndarray:
    """Order and first ``MIN_DEPTH`` values of each key as one number."""
    out = np.zeros(len(keys), np.int64)
    for at in range(1 + 2 * MIN_DEPTH):
        out = (out << 8) | keys[:, at]
    return out


def maybe_dense(region: np.ndarray) -> np.ndarray:
    """The rows of a task whose region may have more than ``NEAR`` classes, here or with other tasks' rows."""
    _, at, size = np.unique(region, return_inverse=True, return_counts=True)
    return np.flatnonzero((size[at] > NEAR) | (region == region[0]) | (region == region[-1]))


def sorted_rows(batches, width: int = WIDTH):
    """A task's rows as one table, and its keys as a grid of bytes."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None, None
    whole = pa.Table.from_batches(got).combine_chunks()
    return whole, byte_grid(whole.column("key"), width)


def byte_grid(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[first : first + len(column) * width].reshape(-1, width)


def candidates(classes: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of the forest, and (region, doc_id, hub, size) of dense regions' classes. Runs jobs.

    Runs of sorted rows lie in different tasks, so each task also hands on its first and last rows;
    these few rows, whose number follows the number of tasks, are compared once more by themselves.
    """

    def pairs(batches, rims: bool):
        whole, keys = sorted_rows(batches)
        if whole is None:
            return
        ids = whole.column("doc_id").to_numpy()
        left, right = neighbours(keys, ids)
        rim = crowd = region = np.zeros(0, np.int64)
        if rims:
            region = regions(keys)
            crowd = maybe_dense(region)
            rim = np.unique(np.concatenate([np.arange(min(NEAR, len(ids))), np.arange(max(0, len(ids) - NEAR), len(ids))]))
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(np.concatenate([np.minimum(left, right), ids[rim], ids[crowd]])),
            "b": pa.array(np.concatenate([np.maximum(left, right), ids[rim], ids[crowd]])),
            "key": pa.array([None] * len(left) + [keys[i].tobytes() for i in rim] + [None] * len(crowd), pa.binary()),
            "region": pa.concat_arrays([pa.nulls(len(left) + len(rim), pa.int64()), pa.array(region[crowd])]),
        })

    schema = "a long, b long, key binary, region long"
    found = materialize(in_order(sorted_orders(classes, forest)).mapInArrow(lambda batches: pairs(batches, True), schema), "forest")
    rims = found.filter("key IS NOT NULL").select("key", F.col("a").alias("doc_id"))
    across = rims.repartition(1).sortWithinPartitions("key", "doc_id").mapInArrow(lambda batches: pairs(batches, False), schema)
    crowd = found.filter("region IS NOT NULL").select("region", F.col("a").alias("doc_id"))
    sizes = crowd.groupBy("region").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).filter(F.col("size") > NEAR)
    dense = materialize(crowd.join(materialize(sizes, "regions"), "region"), "dense")
    return found.unionByName(across).filter("a < b").select("a", "b").distinct(), dense


def in_order(rows: DataFrame) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")


def floor(forest: Forest) -> int:
    """Equal signature values below which a pair is not confirmed: five standard deviations under the threshold."""
    share = forest.percent / 100
    return int(VALUES * share - 5 * (VALUES * share * (1 - share)) ** 0.5)


def differences(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, hub, n_shingles, apart) of the wanted (doc_id, hub): where the class differs from the hub."""
    of_hub = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("hub_shingles"))
    apart = F.concat(F.array_except("shingles", "hub_shingles"), F.array_except("hub_shingles", "shingles"))
    both = wanted.select("doc_id", "hub").distinct().join(sets, "doc_id").join(of_hub, "hub")
    return both.select("doc_id", "hub", F.size("shingles").cast("long").alias("n_shingles"), apart.alias("apart"))


def spread(dense: DataFrame, roots: DataFrame) -> DataFrame:
    """(region, hub, doc_id, root, outside, of, among): classes of dense regions with several components. Runs a job.

    ``outside`` is whether the class is outside the region's main component, ``of`` the number of blocks
    of such classes and ``among`` the number of blocks of all.
    """
    rooted = dense.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rooted = materialize(rooted, "rooted")
    counts = rooted.groupBy("region", "root").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    main = counts.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.first("size") - F.max("n")).alias("out"))
    main = materialize(main.filter("out > 0"), "main")
    rows = rooted.join(main, "region")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    return rows.select("region", "hub", "doc_id", "root", (F.col("root") != F.col("main")).alias("outside"), blocks("out").alias("of"), blocks("size").alias("among"))


def crowd_links(own: Side, other: Side, forest: Forest) -> tuple[list[int], list[int]]:
    """Links of own to other classes in different components, one for each class and component."""
    lengths = np.array([len(x) for x in other.apart])
    rows = np.repeat(np.arange(len(other.ids)), lengths)
    flat = np.concatenate(other.apart)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    left, right = [], []
    for one, root, size, apart in zip(own.ids, own.roots, own.sizes, own.apart):
        low, high = np.searchsorted(flat, apart, "left"), np.searchsorted(flat, apart, "right")
        count = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else low
        shared = np.bincount(rows[at], minlength=len(other.ids))
        differ = len(apart) + lengths - 2 * shared
        both = size + other.sizes  # intersection = (both - differ) / 2, union = (both + differ) / 2
        linked = np.flatnonzero((100 * (both - differ) >= forest.percent * (both + differ)) & (other.roots != root))
        for j in linked[np.unique(other.roots[linked], return_index=True)[1]]:
            left.append(int(one))
            right.append(int(other.ids[j]))
    return left, right


@dataclass(frozen=True)
class Side:
    """Classes of a block: ids, components, set sizes and differences to the hub."""

    ids: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray
    apart: list[np.ndarray]

    @staticmethod
    def of(table: pa.Table) -> Side:
        lists = table.column("apart").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return Side(*(table.column(c).to_numpy() for c in ("doc_id", "root", "n_shingles")), [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])])


def groups(batches, *names: str):
    """Tables of the rows with equal values of the columns, which stand one after the other."""
    kept, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        edges = [0, *(1 + np.flatnonzero((values[1:] != values[:-1]).any(axis=1))), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:]):
            if kept and (values[start] != last).any():
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(start, end - start))
            last = values[start]
    if kept:
        yield pa.Table.from_batches(kept)


def crowds(dense: DataFrame, sets: DataFrame, roots: DataFrame, forest: Forest) -> DataFrame:
    """Confirmed (a, b) of dense regions between different components. Runs jobs."""
    rows = materialize(spread(dense, roots), "spread")
    apart = materialize(differences(rows, sets), "apart")
    # Each class stands once in a block of all, which meets every block of those outside, and if outside in one of these.
    block = lambda c, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    other = F.transform(every("of"), lambda i: F.struct(i.alias("i"), block("among", 1).alias("j"), F.lit(False).alias("own")))
    own = F.transform(every("among"), lambda j: F.struct(block("of", 2).alias("i"), j.alias("j"), F.lit(True).alias("own")))
    met = rows.join(apart, ["doc_id", "hub"]).withColumn("meets", F.explode(F.when(F.col("outside"), F.concat(other, own)).otherwise(other)))
    met = met.select("region", "meets.i", "meets.j", "meets.own", "doc_id", "root", "n_shingles", "apart")

    def links(batches):
        for group in groups(batches, "region", "i", "j"):
            mine = group.column("own")
            own, other = group.filter(mine), group.filter(pa.compute.invert(mine))
            if own.num_rows and other.num_rows:
                left, right = crowd_links(Side.of(own), Side.of(other), forest)
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = met.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j")
    return met.mapInArrow(links, "a long, b long").distinct()


def promising(pairs: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """(a, b, alike): candidates whose set sizes allow a link and whose signatures agree in enough values."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    fits = 100 * F.least("n_a", "n_b") >= forest.percent * F.greatest("n_a", "n_b")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits)

    def step(batch):
        if not batch.num_rows:
            return
        grid = [byte_grid(batch.column(c), 2 * VALUES).view(np.uint16) for c in ("s_a", "s_b")]
        alike = (grid[0] == grid[1]).sum(axis=1)
        keep = np.flatnonzero(alike >= floor(forest))
        yield {"a": batch.column("a").to_numpy()[keep], "b": batch.column("b").to_numpy()[keep], "alike": pa.array(alike[keep], pa.int32())}

    return map_arrow(joined, step, "a long, b long, alike int", "a", "b", "s_a", "s_b")


def shingle_sets(docs: DataFrame, wanted: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, shingles) of the texts whose ids ``wanted`` holds (and perhaps a few more)."""
    members = Members.of(wanted.select(F.xxhash64("doc_id").alias("h")), "h")

    def step(batch):
        keep = members(batch.column("h").to_numpy())
        if not keep.any():
            return
        batch = batch.filter(pa.array(keep))
        ids = batch.column("doc_id").to_numpy()
        for first, data, offsets in K.chunks(batch.column("text")):
            spans = K.words(data, offsets)
            sets = [K.signed(K.shingles(spans.hash[a:b], forest.words)) for a, b in zip(spans.of[:-1], spans.of[1:])]
            yield {"doc_id": ids[first : first + len(sets)], "shingles": K.long_lists(sets)}

    rows = texts(docs).withColumn("h", F.xxhash64("doc_id"))
    return map_arrow(rows, step, "doc_id long, shingles array<long>", "doc_id", "h", "text")


def confirmed(pairs: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"x_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x_a", "x_b")).alias("i"), (F.size("x_a") + F.size("x_b")).alias("n"))
    return sized.filter(100 * F.col("i") >= forest.percent * (F.col("n") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Runs jobs.

    ``docs`` has doc_id (unique) and text; other columns are not read. Words are runs of bytes other
    than space and the controls from tab to carriage return, A-Z lower-cased. Texts are linked when
    their sets of distinct shingles have the similarity asked for; component_id is the smallest doc_id
    reachable over links. Null and empty texts, and texts of blanks, have no shingle and are linked
    with nothing; a text shorter than a shingle is one. Rows without doc_id are left out; a doc_id
    given twice is one document with the texts' results by chance. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, forest), "prints")
    classes = prints.filter("n_shingles > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = materialize(classes, "classes")
    found, dense = candidates(classes, forest)
    pairs = materialize(promising(found, classes, forest), "pairs")
    best = pairs.groupBy(F.col("b")).agg(F.max_by("a", F.struct("alike", -F.col("a"))).alias("a"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(dense.select("doc_id"))
    sets = materialize(shingle_sets(docs, wanted, forest), "sets")
    first = materialize(confirmed(best, sets, forest), "links")
    roots = materialize(components(first), "roots")

    def rooted(c):
        return roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))

    between = pairs.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left")
    between = between.filter(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b")))
    second = materialize(confirmed(between.select("a", "b"), sets, forest), "links")
    roots = materialize(components(first.unionByName(second)), "roots")
    third = materialize(crowds(dense, sets, roots, forest), "links")
    roots = materialize(components(first.unionByName(second).unionByName(third)), "roots")
    class_root = classes.join(roots, classes.doc_id == roots.node, "left").select("set_hash", F.coalesce("root", "doc_id").alias("component_id"))
    shared = prints.drop("signature").join(class_root, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return shared.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component. Rows without doc_id stay. Runs jobs."""
    gone = near_duplicates(docs, forest).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
