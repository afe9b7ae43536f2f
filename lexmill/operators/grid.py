"""One joint fit for a whole grid of runs over the same texts.

The runs of an experiment train on overlapping rows: modes share languages, the sizes of a learning
curve are nested, seeds draw from one pool. Their TF-IDF features differ only by each run's own idf
and row norm, so all runs share one table of term counts over the union of their vocabularies, and
one pass over it gives the losses and gradients of every run: a sparse block times a matrix with a
column per run. The optimiser keeps a state of its own for each run and moves all of them in step,
so the number of passes is that of the slowest run, not the sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.functions.scores import sigmoid
from lexmill.operators import features as V
from lexmill.operators.linear import TfidfModel, decide
from lexmill.sources.workdir import materialize

#: Entries of one block, and numbers in one row of a sum that is handed on.
BLOCK, SLICE = 1 << 16, 1 << 10
#: A set of runs with at least one of so many parts of the texts is a large one.
LARGE = 8
#: Steps a run's optimiser remembers, and numbers that all of them remember together.
MEMORY, REMEMBERED = 30, 1 << 27


@dataclass
class GridModel:
    """All runs of a grid. ``terms`` holds ``run, term, idx, tf, df, idf, coef``; ``idx`` numbers the
    terms of all runs together. ``passes`` counts the passes over the training rows."""

    settings: TfidfModel
    terms: DataFrame
    intercepts: np.ndarray
    train_rows: list[int]
    passes: int

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """idf and idf times coefficient, terms x runs. Bounded by runs x ``max_features`` squared at worst."""
        rows = self.terms.select("run", "idx", "idf", "coef").toArrow()
        run, idx = rows["run"].to_numpy(), rows["idx"].to_numpy()
        idf = np.zeros((int(idx.max()) + 1, len(self.train_rows)))
        idf[idx, run] = rows["idf"].to_numpy()
        weight = np.zeros_like(idf)
        weight[idx, run] = rows["coef"].to_numpy()
        return idf, weight * idf


def set_sums(texts: DataFrame, rows: np.ndarray, member: np.ndarray, max_features: int):
    """``_set, term, tf, df`` as ``partial_sums`` has them, and what may be missing from them.

    ``rows`` has the texts of every set of runs, ``member`` the runs of each. A set with many of the texts
    hands on only terms that can make the vocabulary of one of its runs: no term is more frequent in a run
    than the sum of either of its slots. All terms of the other sets are counted. The second result has for
    every run the frequency from which on no term is missing; the third counts the terms that are missing
    where a run's border turns out to be lower, or is None. Runs jobs.
    """
    spark, slots, sure = texts.sparkSession, V.SLOTS_PER_FEATURE * max_features, np.ones(member.shape[1], np.int64)
    large = [int(i) for i in np.flatnonzero(rows * LARGE >= rows.sum()) if rows[i]]
    if not large:
        return V.partial_sums(texts, ["_set"]), sure, None
    inside = F.col("_set").isin(large)
    rest = [i for i in np.flatnonzero(rows) if i not in large]
    # The large sets by their numbers, which begin at 1, and all others together.
    sums = V.grouped_slot_sums(texts.withColumn("_set", F.when(inside, F.col("_set")).otherwise(0)), "_set", slots)
    none = np.zeros((2, slots), np.int64)
    # Runs of the same large sets, with or without any of the others, share their bounds.
    alike: dict[tuple, list[int]] = {}
    for r in range(member.shape[1]):
        own = tuple(i for i in large if member[i, r])
        if own:
            alike.setdefault((own, bool(member[rest, r].any())), []).append(r)
    bounds = {}
    for (own, more), alike_runs in alike.items():
        total = sum(sums.get(i, none) for i in own)
        sure[alike_runs] = V._guess(total, max_features)
        bounds[own, more] = total + sums.get(0, none) if more else total
    if (sure == 1).all():
        return V.partial_sums(texts, ["_set"]), sure, None

    def reaching(least: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([bounds[kind] >= least[alike_runs].min() for kind, alike_runs in alike.items()])

    first = reaching(sure)
    counted = V.partial_sums(texts.filter(inside), ["_set"], spark.sparkContext.broadcast((first, None)))
    if rest:
        counted = counted.unionByName(V.partial_sums(texts.filter(~inside), ["_set"]))

    def missing(least: np.ndarray) -> DataFrame:
        chosen = spark.sparkContext.broadcast((reaching(np.minimum(least, sure)), first))
        return V.partial_sums(texts.filter(inside), ["_set"], chosen)

    return counted, sure, missing


def vocabularies(counted: DataFrame, sizes: dict[int, int], max_features: int) -> DataFrame:
    """``run, term, idx, tf, df, idf``: the most frequent terms of every run, ties by term.

    ``counted`` has terms and ``runs``, the runs a row trains; ``sizes`` has the rows of run 0, 1, ...
    Terms are added up once per set of runs that occurs, and only terms that reach a run's border
    frequency become rows of their own. Runs jobs.
    """
    spark = counted.sparkSession
    runs = sorted(sizes)
    # One row per set of runs that occurs; texts carry its number, so terms are not grouped by a list.
    sets = counted.groupBy("runs").agg(F.count("*").alias("_rows")).withColumn("_set", F.row_number().over(Window.orderBy("runs")))
    sets = materialize(sets.select(F.col("runs").alias("_runs"), "_set", "_rows"), "run-sets")
    numbered = sets.collect()
    member, rows = np.zeros((len(numbered) + 1, len(runs)), np.int64), np.zeros(len(numbered) + 1, np.int64)
    for row in numbered:
        member[row["_set"], [runs.index(r) for r in row["_runs"] if r in sizes]] = 1
        rows[row["_set"]] = row["_rows"]
    texts = counted.join(sets.select("_runs", "_set"), F.col("runs") == F.col("_runs"))
    # A term has a part for each task and set; the parts are added up where they are read.
    parts, sure, missing = set_sums(texts, rows, member, max_features)
    stats = materialize(parts.groupBy("term").agg(F.collect_list(F.struct("_set", "tf", "df")).alias("_parts")), "run-terms")

    def totals(batch: pa.RecordBatch):
        """Per stretch of terms: its first, and the occurrences and texts of every term, a column per run."""
        ends = np.concatenate([[0], np.cumsum(batch.column("_parts").value_lengths().to_numpy())]).astype(np.int64)
        own, tf, df = (a.to_numpy() for a in batch.column("_parts").flatten().flatten())
        for start, stop in stretches(ends):
            e = slice(ends[start], ends[stop])
            yield start, *(sums_of(n[e, None] * member[own[e]], ends[start : stop + 1] - ends[start]) for n in (tf, df))

    def counted_levels(batches):
        found, times, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(runs)) << 48
        for batch in batches:
            for _, tfs, _ in totals(batch):
                level, n = np.unique((tfs + places)[tfs > 0], return_counts=True)
                found.append(level)
                times.append(n)
                if len(found) > 64:
                    found, times = summed_levels(found, times)
        found, times = summed_levels(found, times)
        yield pa.RecordBatch.from_pydict({
            "run": pa.array(np.array(runs, np.int32)[found[0] >> 48]), "tf": pa.array(found[0] & ((1 << 48) - 1)), "_n": pa.array(times[0])
        })

    def summed_levels(found, times):
        level, at = np.unique(np.concatenate(found), return_inverse=True)
        total = np.zeros(len(level), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return [level], [total]

    def borders() -> np.ndarray:
        """The lowest frequency that can make each run's vocabulary; the window sees one row per run and frequency."""
        levels = stats.select("_parts").mapInArrow(counted_levels, "run int, tf bigint, _n bigint").groupBy("run", "tf").agg(F.sum("_n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("run").orderBy(F.desc("tf")))
        border = levels.withColumn("_upto", upto).groupBy("run").agg(
            F.coalesce(F.max(F.when(F.col("_upto") >= max_features, F.col("tf"))), F.lit(1)).alias("_border")
        )
        # One number per run.
        lowest = dict(border.collect())
        return np.array([lowest.get(r, 1) for r in runs], np.int64)

    limits = borders()
    if missing is not None and (limits < sure).any():
        more = missing(limits).groupBy("term").agg(F.collect_list(F.struct("_set", "tf", "df")).alias("_parts"))
        stats = stats.unionByName(more).groupBy("term").agg(F.flatten(F.collect_list("_parts")).alias("_parts"))
        stats = materialize(stats, "run-terms")
        limits = borders()

    def reached(batches):
        for batch in batches:
            for start, tfs, dfs in totals(batch):
                at, run = np.nonzero(tfs >= limits)
                yield pa.RecordBatch.from_pydict({
                    "term": batch.column("term").take(pa.array(start + at)), "run": pa.array(np.array(runs, np.int32)[run]),
                    "tf": pa.array(tfs[at, run]), "df": pa.array(dfs[at, run]),
                })

    kept = stats.select("term", "_parts").mapInArrow(reached, "term string, run int, tf bigint, df bigint")
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("tf"), "term"))
    kept = materialize(kept.withColumn("_place", place).filter(F.col("_place") <= max_features).drop("_place"), "run-vocabularies")
    # At most runs x max_features terms, whatever the data.
    union = kept.select("term").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    n_docs = spark.createDataFrame(list(sizes.items()), "run INT, n_docs BIGINT")
    joined = kept.join(union, "term").join(F.broadcast(n_docs), "run")
    return materialize(joined.select("run", "term", "idx", "tf", "df", V.idf(F.col("df"), F.col("n_docs")).alias("idf")), "grid-vocabulary")


def entries(counted: DataFrame, vocab: DataFrame, keep: Sequence[str], key: str) -> DataFrame:
    """``key, keep..., indices, values``: sublinear counts of the terms any run knows, one row per text."""
    columns = [key, *keep]

    def body(part, table, row, place, n):
        idx, w = V.numbers(table, "idx")[place], 1 + np.log(n)
        order = V._in_order(row, idx, w)
        row = row[order]
        lists = {"indices": V.as_lists(row, part.num_rows, idx[order], pa.int32()), "values": V.as_lists(row, part.num_rows, w[order], pa.float64())}
        return {c: part.column(c) for c in columns} | lists

    schema = f"{V.schema_of(counted, columns)}, indices array<int>, values array<double>"
    return V.looked_up(V.one_per_key(counted, keep, key, ()), columns, vocab.select("term", "idx").distinct(), body, schema)


def sums_of(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between every two ``ends``; an empty stretch is 0."""
    out = np.zeros((len(ends) - 1, values.shape[1]), values.dtype)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[some] = np.add.reduceat(values, ends[some], axis=0)
    return out


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column one after the other, and where each row's begin (n + 1 places)."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)
    return column.flatten().to_numpy(), ends


def pieces(indices: pa.Array, values: pa.Array):
    """(first row, one past the last, term numbers, values, ends) of stretches of about ``BLOCK`` entries."""
    flat, ends = lists(indices)
    weights, _ = lists(values)
    for start, stop in stretches(ends):
        yield start, stop, flat[ends[start] : ends[stop]], weights[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]


def stretches(ends: np.ndarray):
    """First row and one past the last of stretches of about ``BLOCK`` entries."""
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BLOCK, "right")) - 1)
        yield start, stop
        start = stop


def packed(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the least bytes that hold them all."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def unpacked(part: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` packed numbers of a block."""
    return np.frombuffer(part.as_buffer(), f"u{len(part.as_buffer()) // n}" if n else "u1").astype(np.int64)


def blocks(rows: DataFrame, idf, n_runs: int, label: str) -> DataFrame:
    """Training rows as blocks of bytes, written once: the block's terms, each once, and the place of every
    entry among them, its values likewise, row ends, labels, and for every row and run 1 / norm and
    membership. Runs a job."""

    def run(batches):
        weight = idf.value
        for batch in batches:
            member, at = lists(batch.column("runs"))
            mask = np.zeros((batch.num_rows, n_runs), np.uint8)
            mask[np.repeat(np.arange(batch.num_rows), np.diff(at)), member] = 1
            # Rows of the same runs lie side by side: a block is only read for the runs of its rows.
            order = np.lexsort(mask.T)
            batch, mask = batch.take(pa.array(order)), mask[order]
            labels = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int8)
            for a, b, idx, w, ends in pieces(batch.column("indices"), batch.column("values")):
                norm = np.sqrt(sums_of(np.square(w[:, None] * weight[idx]), ends))
                scale = np.divide(mask[a:b], norm, out=np.zeros_like(norm), where=norm > 0)
                own, at = np.unique(idx, return_inverse=True)
                kinds, kind = np.unique(w, return_inverse=True)
                parts = {"own": own.astype(np.int32), "at": packed(at), "kinds": kinds, "kind": packed(kind), "ends": ends, "y": labels[a:b], "scale": scale, "mask": mask[a:b]}
                yield pa.RecordBatch.from_pydict({c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in parts.items()})

    schema = ", ".join(f"{c} binary" for c in ("own", "at", "kinds", "kind", "ends", "y", "scale", "mask"))
    return materialize(rows.select("runs", label, "indices", "values").mapInArrow(run, schema), "grid-blocks")


def one_pass(table: DataFrame, shape: tuple[int, int], weights: np.ndarray, state, known, active: np.ndarray, curvature: bool = False):
    """Loss, slope of the intercept and slopes of its own terms for every active run, in one pass.

    ``known`` is the broadcast list of each run's terms, ``state`` the broadcast pair (idf x
    coefficients of the active runs' own terms, one run after the other; intercepts). Slopes are in the
    same order and those before idf is applied; with ``curvature`` the sums of squared weighted values
    take their place. Tasks hand on the sums of their own rows in slices, which are added up on the
    executors; what a run does not know is never handed on.
    """
    size, n_runs = shape
    width = len(active)

    def local(batches):
        (given, bias), terms = state.value, known.value
        moved, slopes, heads = np.zeros((width, size)), np.zeros((width, size)), np.zeros((2, width))
        for j, part in enumerate(np.split(given, np.cumsum([len(terms[r]) for r in active])[:-1])):
            moved[j, terms[active[j]]] = part
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: E731, B023
                own, ends, y = read("own", np.int32), read("ends", np.int64), read("y", np.int8)
                scale, mask = (read(c, kind).reshape(len(y), n_runs)[:, active] for c, kind in (("scale", np.float64), ("mask", np.uint8)))
                here = np.flatnonzero(mask.any(axis=0))
                if not len(here):
                    continue
                # A run's numbers for the block's own terms are few enough to stay in the cache.
                at, kind = (unpacked(batch.column(c)[i], int(ends[-1])) for c in ("at", "kind"))
                w = read("kinds", np.float64).take(kind)
                row, some = np.repeat(np.arange(len(y)), np.diff(ends)), np.flatnonzero(np.diff(ends))
                values = np.square(w) if curvature else w
                # One run after the other: sums of plain columns are several times as fast as sums of rows of a matrix.
                for j in here:
                    unit, member = scale[:, j], mask[:, j] * weights[active[j]][y]
                    if curvature:
                        pull = 0.25 * member * np.square(unit)
                        heads[1, j] += 0.25 * member.sum()
                    else:
                        z = np.zeros(len(y))
                        if len(some):
                            z[some] = np.add.reduceat(moved[j].take(own).take(at) * w, ends[some])
                        z = z * unit + bias[j]
                        miss = member * (1 / (1 + np.exp(-z)) - y)
                        heads[0, j] += (member * (np.logaddexp(0, z) - y * z)).sum()
                        heads[1, j] += miss.sum()
                        pull = miss * unit
                    slopes[j, own] += np.bincount(at, pull.take(row) * values, len(own))
        flat = np.concatenate([heads.ravel(), *[slopes[j, terms[r]] for j, r in enumerate(active)]])
        starts = np.arange(0, len(flat), SLICE)
        kept = [s for s in starts.tolist() if flat[s : s + SLICE].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(kept, pa.int64()), "sums": pa.array([flat[s : s + SLICE].tobytes() for s in kept], pa.binary())})

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, sums in zip(batch.column("slice").to_pylist(), batch.column("sums")):
                own = np.frombuffer(sums.as_buffer())
                total[s] = total[s] + own if s in total else own
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int64()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    schema = "slice bigint, sums binary"
    total = 2 * width + sum(len(known.value[r]) for r in active)
    tasks = max(1, min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SLICE // 16))
    # As many tasks as run at a time: a task hands on sums of a fixed size, however little it has read.
    read = table.coalesce(table.sparkSession.sparkContext.defaultParallelism)
    rows = read.mapInArrow(local, schema).repartition(tasks, "slice").mapInArrow(added, schema).toArrow()
    flat = np.zeros(total)
    for s, sums in zip(rows["slice"].to_pylist(), rows["sums"]):
        own = np.frombuffer(sums.as_buffer())
        flat[s : s + len(own)] = own
    heads = flat[: 2 * width].reshape(2, width)
    return heads[0], heads[1], flat[2 * width :]


class Descent:
    """L-BFGS for one run, moved on by whoever has its loss and slopes; the last coordinate is the intercept.

    The steps it remembers and the turns of the slopes along them lie in two matrices, so a new direction
    takes a few products with these (the compact form of Byrd, Nocedal and Schnabel) and no loop over them.
    """

    def __init__(self, diagonal: np.ndarray, memory: int = MEMORY):
        self.x, self.loss, self.slopes = np.zeros(len(diagonal)), np.inf, None
        self.diagonal, self.memory = diagonal, memory
        self.way, self.step = np.zeros(len(diagonal)), 1.0
        self.forget()

    def forget(self) -> None:
        """Without what it remembers, the next direction follows the diagonal alone."""
        self.moves, self.turns = np.empty((0, len(self.x)), np.float32), np.empty((0, len(self.x)), np.float32)
        #: Rows in the order of their steps; products of moves and turns, and of turns over the diagonal.
        self.order, self.across, self.within = [], np.zeros((self.memory, self.memory)), np.zeros((self.memory, self.memory))

    def trial(self) -> np.ndarray:
        return self.x + self.step * self.way

    def feed(self, loss: float, slopes: np.ndarray) -> None:
        """What the trial point gave: it is taken if the loss fell enough, else the step is halved."""
        if self.slopes is not None:
            if loss > self.loss + 1e-4 * self.step * float(self.slopes @ self.way) + 1e-12 * abs(self.loss):
                self.step /= 2
                return
            moved = self.step * self.way
            self.remember(moved, slopes - self.slopes)
            self.x = self.x + moved
        self.loss, self.slopes, self.step = loss, slopes, 1.0
        self.way = -self.bent(slopes)
        if not self.way @ slopes < 0 and self.order:
            self.forget()
            self.way = -self.bent(slopes)

    def remember(self, moved: np.ndarray, turned: np.ndarray) -> None:
        """Takes up a step if the loss curves upwards along it; the oldest gives way."""
        if not moved @ turned > 1e-14 * (moved @ moved):
            return
        # Only ratios of the two count; short steps keep their digits.
        length = np.sqrt(moved @ moved)
        moved, turned = (moved / length).astype(np.float32), (turned / length).astype(np.float32)
        if len(self.order) < self.memory:
            i = len(self.order)
            if i == len(self.moves):
                more = np.empty((min(self.memory, max(8, 2 * i)) - i, len(self.x)), np.float32)
                self.moves, self.turns = np.concatenate([self.moves, more]), np.concatenate([self.turns, more])
        else:
            i = self.order.pop(0)
        self.order.append(i)
        self.moves[i], self.turns[i] = moved, turned
        n = len(self.order)
        moves, turns = self.moves[:n], self.turns[:n]
        self.across[i, :n], self.across[:n, i] = turns @ moved, moves @ turned
        self.within[i, :n] = self.within[:n, i] = turns @ (turned / self.diagonal).astype(np.float32)

    def bent(self, slopes: np.ndarray) -> np.ndarray:
        """The inverse of the approximate curvature times the slopes."""
        straight = slopes / self.diagonal
        if not self.order:
            return straight
        at, n = self.order, len(self.order)
        moves, turns = self.moves[:n], self.turns[:n]
        across, within = self.across[np.ix_(at, at)], self.within[np.ix_(at, at)]
        # The slopes may be much smaller than the numbers of type float32 they are multiplied with.
        size = np.abs(slopes).max()
        along = (moves @ (slopes / size).astype(np.float32)).astype(float)[at] * size
        pulled = (turns @ (straight / size).astype(np.float32)).astype(float)[at] * size
        upper, scale = np.triu(across), across[-1, -1] / within[-1, -1]
        back = np.linalg.solve(upper, along)
        ahead = np.linalg.solve(upper.T, np.diag(across) * back + scale * (within @ back - pulled))
        by_row = np.zeros((2, n))
        by_row[:, at] = ahead, back
        return scale * (straight - (by_row[1].astype(np.float32) @ turns) / self.diagonal) + by_row[0].astype(np.float32) @ moves

    def follow(self, leader: Descent, own: np.ndarray, there: np.ndarray) -> None:
        """Starts where another run has ended and with what it remembers, as far as both know a term.

        ``own`` and ``there`` are the places of the common coordinates here and in the other run.
        """
        self.x[own] = leader.x[there]
        for i in leader.order:
            moved, turned = np.zeros((2, len(self.x)))
            moved[own], turned[own] = leader.moves[i, there], leader.turns[i, there]
            self.remember(moved, turned)


def followed(shared: np.ndarray) -> dict[int, list[int]]:
    """Runs that go first, and those that start from where they end; ``shared`` has the rows every two runs share.

    A run follows the largest run that has at least half of its rows in common with it, of both. Going one
    after the other pays if one run spares passes over most rows to several, so a run leads two or more.
    """
    sizes, out, free = np.diag(shared), {}, set(range(len(shared)))
    for leader in np.argsort(-sizes, kind="stable").tolist():
        if leader not in free:
            continue
        alike = [r for r in sorted(free) if r != leader and 2 * shared[r, leader] >= max(sizes[r], sizes[leader])]
        if len(alike) > 1:
            out[leader] = alike
            free -= {leader, *alike}
    return out


def solve(
    spark: SparkSession, table: DataFrame, idf: np.ndarray, weights: np.ndarray, settings: TfidfModel, slope: float, leads: dict[int, list[int]]
) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (terms x runs), intercepts and passes: runs moved in step until no slope exceeds ``slope``.

    A run that follows another (``leads``) joins in where that one has settled.
    """
    size, n_runs = idf.shape
    known = [np.flatnonzero(idf[:, r]) for r in range(n_runs)]
    scale = [idf[k, r] for r, k in enumerate(known)]
    shared = spark.sparkContext.broadcast(known)

    def measured(runs: np.ndarray, points: list[np.ndarray], curvature: bool = False):
        own, bias = np.concatenate([p[:-1] * scale[r] for r, p in zip(runs, points)]), np.array([p[-1] for p in points])
        state = spark.sparkContext.broadcast((own, bias))
        try:
            loss, head, slopes = one_pass(table, (size, n_runs), weights, state, shared, runs, curvature)
        finally:
            state.destroy()
        parts = np.split(slopes, np.cumsum([len(known[r]) for r in runs])[:-1])
        return loss, [np.append(part * (np.square(scale[r]) if curvature else scale[r]), head[j]) for j, (r, part) in enumerate(zip(runs, parts))]

    everyone = np.arange(n_runs)
    ridge = [np.append(np.full(len(k), 1 / settings.c), 0.0) for k in known]
    _, curved = measured(everyone, [np.zeros(len(k) + 1) for k in known], curvature=True)
    memory = max(1, min(MEMORY, REMEMBERED // (2 * sum(map(len, ridge)))))
    runs = [Descent(curve + own, memory) for curve, own in zip(curved, ridge)]
    waiting = {r for own in leads.values() for r in own}
    active, passes = np.array([r for r in everyone if r not in waiting], int), 1
    while len(active):
        if passes > settings.max_iter:
            raise RuntimeError(f"runs {active.tolist()} have not settled after {passes} passes")
        points = [runs[r].trial() for r in active]
        losses, slopes = measured(active, points)
        passes += 1
        for r, point, loss, own in zip(active, points, losses, slopes):
            runs[r].feed(float(loss + 0.5 * ridge[r] @ np.square(point)), own + ridge[r] * point)
        active, still = np.array([r for r in active if np.abs(runs[r].slopes).max() > slope], int), active
        for r in set(still.tolist()) - set(active.tolist()):
            for own in leads.get(r, []):
                _, here, there = np.intersect1d(known[own], known[r], assume_unique=True, return_indices=True)
                runs[own].follow(runs[r], np.append(here, len(known[own])), np.append(there, len(known[r])))
            active = np.sort(np.append(active, leads.get(r, []))).astype(int)
            runs[r].forget()
    shared.destroy()
    coefficients = np.zeros((size, n_runs))
    for r, k in enumerate(known):
        coefficients[k, r] = runs[r].x[:-1]
    return coefficients, np.array([run.x[-1] for run in runs]), passes


def fit_grid(
    counted: DataFrame,
    n_runs: int,
    settings: TfidfModel | None = None,
    label: str = "label",
    key: str = "doc_id",
    slope: float = 5e-3,
    cells: int = 1 << 24,
) -> GridModel:
    """Fit every run of a grid on a table of counted texts whose ``runs`` column lists the runs a row trains.

    Each run has its own vocabulary, idf, row norms and balanced class weights, and its objective is
    that of ``linear.fit_counted``; it has settled when no partial derivative of the summed loss
    exceeds ``slope``. The driver holds terms x runs numbers, at most ``cells``: a grid with more is
    fitted in groups of runs. Runs jobs.
    """
    settings = settings or TfidfModel()
    spark = counted.sparkSession
    taking = counted.filter(F.size("runs") > 0)
    # Two numbers for each run.
    counts = {(r["run"], r[label]): r["n"] for r in taking.select(label, F.explode("runs").alias("run")).groupBy("run", label).agg(F.count("*").alias("n")).collect()}
    sizes = {r: sum(n for (own, _), n in counts.items() if own == r) for r in range(n_runs)}
    for r in range(n_runs):
        found = {y for own, y in counts if own == r}
        if found != {0, 1}:
            raise ValueError(f"training needs rows of both classes 0 and 1, run {r} has {sorted(found, key=str)}")
    # Two numbers for every set of runs that occurs.
    together = np.zeros((n_runs, n_runs), np.int64)
    for row in taking.groupBy("runs").agg(F.count("*").alias("n")).collect():
        together[np.ix_(row["runs"], row["runs"])] += row["n"]
    vocab = vocabularies(taking, sizes, settings.max_features)
    listed = vocab.select("run", "idx", "idf").toArrow()
    run, idx = listed["run"].to_numpy(), listed["idx"].to_numpy()
    if len(set(run.tolist())) < n_runs:
        raise ValueError("the training texts of a run hold no terms")
    balance = np.array([[sizes[r] / (2 * counts[r, y]) if settings.balanced else 1.0 for y in (0, 1)] for r in range(n_runs)])
    rows = materialize(entries(taking, vocab, [label, "runs"], key), "grid-rows")
    coefficients, intercepts, passes = np.zeros(len(run)), np.zeros(n_runs), 0
    width = max(1, cells // (int(idx.max()) + 1))
    for first in range(0, n_runs, width):
        group = np.arange(first, min(first + width, n_runs))
        own = (run >= group[0]) & (run <= group[-1])
        idf = np.zeros((int(idx.max()) + 1, len(group)))
        idf[idx[own], run[own] - first] = listed["idf"].to_numpy()[own]
        members = F.transform(F.filter("runs", lambda r: (r >= int(group[0])) & (r <= int(group[-1]))), lambda r: r - first)
        shared = spark.sparkContext.broadcast(idf)
        table = blocks(rows.withColumn("runs", members).filter(F.size("runs") > 0), shared, len(group), label)
        shared.destroy()
        solved, intercepts[group], taken = solve(spark, table, idf, balance[group], settings, slope, followed(together[np.ix_(group, group)]))
        coefficients[own] = solved[idx[own], run[own] - first]
        passes += taken
    made = spark.createDataFrame(pa.table({"run": run, "idx": idx, "coef": coefficients}))
    terms = materialize(vocab.join(made, ["run", "idx"]).select("run", "term", "idx", "tf", "df", "idf", "coef"), "grid-model")
    return GridModel(settings, terms, intercepts, [sizes[r] for r in range(n_runs)], passes)


def score_grid(counted: DataFrame, model: GridModel, keep: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """``key, keep..., run, z, score, pred, confidence``: every text scored by every run, in one pass."""
    spark = counted.sparkSession
    rows = entries(counted.select(key, *keep, "terms"), model.terms, list(keep), key)
    n_runs, state = len(model.train_rows), spark.sparkContext.broadcast((*model.matrices(), model.intercepts))

    def run(batches):
        idf, moved, bias = state.value
        for batch in batches:
            for a, b, idx, w, ends in pieces(batch.column("indices"), batch.column("values")):
                norm = np.sqrt(sums_of(np.square(w[:, None] * idf[idx]), ends))
                top = sums_of(w[:, None] * moved[idx], ends)
                z = np.divide(top, norm, out=np.zeros_like(top), where=norm > 0) + bias
                same = pa.array(np.repeat(np.arange(a, b), n_runs))
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).take(same) for c in (key, *keep)},
                    "run": pa.array(np.tile(np.arange(n_runs, dtype=np.int32), b - a)),
                    "z": pa.array(z.ravel()),
                })

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, *keep).schema)
    scored = rows.mapInArrow(run, f"{schema}, run int, z double").withColumn("score", sigmoid(F.col("z")))
    return scored.select("*", decide(F.col("z")).alias("pred"), F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"))


def slopes(counted: DataFrame, model: GridModel, label: str = "label", key: str = "doc_id", cells: int = 1 << 24) -> DataFrame:
    """``run, term, df, idf, slope``: each partial derivative of every run's objective, from the counted texts.

    ``counted`` is what the grid was fitted on. The objectives are strictly convex, so slopes of
    zero tell the optimum apart from all other models. Neither the blocks nor the solver take part.
    A task adds up its own rows for as many runs as ``cells`` holds and hands on one number per run and
    term, whatever it has read. Runs jobs.
    """
    spark, n_runs = counted.sparkSession, len(model.train_rows)
    taking = counted.filter(F.size("runs") > 0)
    # Two numbers for each run.
    counts = np.zeros((n_runs, 2))
    for r in taking.select(label, F.explode("runs").alias("run")).groupBy("run", label).agg(F.count("*").alias("n")).collect():
        counts[r["run"], r[label]] = r["n"]
    balance = counts.sum(axis=1, keepdims=True) / (2 * counts) if model.settings.balanced else np.ones_like(counts)
    rows = V.one_per_key(taking, [label, "runs"], key, ()).select(label, "runs", "terms")
    listed = model.terms.select("run", "term", "idx", "idf", "coef").toArrow()
    run, idx = listed["run"].to_numpy(), listed["idx"].to_numpy()
    _, first = np.unique(idx, return_index=True)
    names = spark.sparkContext.broadcast(listed["term"].take(pa.array(first)).combine_chunks())
    width, intercepts = max(1, cells // len(first)), model.intercepts

    def pulls(group: range) -> DataFrame:
        own = [np.flatnonzero(run == r) for r in group]
        shared = spark.sparkContext.broadcast([(idx[o], listed["idf"].to_numpy()[o], listed["coef"].to_numpy()[o]) for o in own])

        def local(batches):
            tables = []
            for at, idf, coef in shared.value:
                both = np.zeros((2, len(first)))
                both[0, at], both[1, at] = idf, coef
                tables.append(both)
            total = np.zeros((len(group), len(first)))
            for batch in batches:
                for part, row, term, n in V.held(batch):
                    place = V.places(term, names.value)
                    hit = place >= 0
                    row, place, w = row[hit], place[hit], 1 + np.log(n.to_numpy(zero_copy_only=False)[hit])
                    takes, ends = lists(part.column("runs"))
                    taker = np.repeat(np.arange(part.num_rows), np.diff(ends))
                    y = part.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
                    for j, r in enumerate(group):
                        member = np.zeros(part.num_rows, bool)
                        member[taker[takes == r]] = True
                        if not member.any():
                            continue
                        mine = member[row]
                        at, of = place[mine], row[mine]
                        idf, coef = tables[j]
                        weight = w[mine] * idf[at]
                        norm, top = np.sqrt(np.bincount(of, np.square(weight), part.num_rows)), np.bincount(of, weight * coef[at], part.num_rows)
                        norm[norm == 0] = np.inf
                        miss = balance[r][y] * (1 / (1 + np.exp(-(top / norm + intercepts[r]))) - y) / norm
                        total[j] += np.bincount(at, weight * miss[of], len(first))
            for j, r in enumerate(group):
                some = np.flatnonzero(total[j])
                yield pa.RecordBatch.from_pydict({"run": pa.array(np.full(len(some), r), pa.int32()), "idx": pa.array(some, pa.int32()), "pull": pa.array(total[j, some])})

        return rows.mapInArrow(local, "run int, idx int, pull double")

    parts = [pulls(range(first_, min(first_ + width, n_runs))) for first_ in range(0, n_runs, width)]
    pulled = reduce(DataFrame.unionByName, parts).groupBy("run", "idx").agg(F.sum("pull").alias("_pull"))
    slope = F.coalesce("_pull", F.lit(0.0)) + F.col("coef") / model.settings.c
    return model.terms.join(pulled, ["run", "idx"], "left").select("run", "term", "df", "idf", slope.alias("slope"))
