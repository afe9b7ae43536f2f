"""Line dedup by a deletion-neighbourhood join, earliest line first.

A line is the sequence of its words, A-Z lower-cased; the edit distance of two lines counts words put
in, left out or replaced. Equal lines are joined by their fingerprint. Lines of ``min_words`` and more
are also joined within one edit: every line emits the fingerprint of itself and of each variant with
one word left out, and

* two lines of which one is the other's variant differ by one word put in,
* two lines with an equal variant, left out at the same place, differ by one word replaced.

Both are kept apart as keys, so all lines with the same key of the second kind are within one edit of
each other, and those of the first kind of the one line they are variants of. The earliest line of a
key therefore decides for all others, however many there are: keys are aggregated, and no pairs of a
key are emitted. Fingerprints that meet are verified on the lines' words.

Variants number as the words of the corpus. So lines that cannot have a partner do not emit them: two
lines within one edit share their first or last m words, m being half of the shorter one's words less
one. Lines whose half no other line has are left out, without loss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import Members, map_arrow, texts
from lexmill.sources.workdir import materialize

PLACE = "struct<doc_id:long,line:int>"


@dataclass(frozen=True)
class Lines:
    """Settings: shortest line, in words, that is compared with one edit; shorter ones must be equal."""

    min_words: int = 8


class Grid:
    """Lines of a chunk with their words' fingerprints and those of any run of words in a line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, self.of_text = K.lines(data, offsets)
        self.spans = K.words(data, starts)
        self.size = np.diff(self.spans.of)
        self.first = self.spans.of[:-1]
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.of_text))
        self.number = np.arange(len(self.size)) - self.of_text[self.text]
        n = len(self.spans.hash)
        self.up, self.down = K.WORD_POWERS.to(n + 2)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.spans.hash * self.up[1 : n + 1], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed sum of the words from start to end, as if the run began at place 0."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def whole(self) -> np.ndarray:
        """Fingerprint of each line."""
        return K.mix(self.run(self.first, self.first + self.size) + self.size.astype(np.uint64))

    def halves(self, settings: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Line number and key of the first and last m words, for lines that one edit applies to."""
        owner, keys = [], []
        for less in (1, 2):
            # less 1: as the shorter or an equally long line; less 2: as the longer one.
            at = np.flatnonzero((self.size >= settings.min_words) & ((less == 1) | ((self.size - 1) // 2 != (self.size - 2) // 2)))
            m = (self.size[at] - less) // 2
            low, high = self.first[at], self.first[at] + self.size[at]
            for side, (a, b) in enumerate(((low, low + m), (high - m, high))):
                owner.append(at)
                keys.append(K.mix(self.run(a, b) + (4 * m + side + 2).astype(np.uint64) * K.BASE))
        return np.concatenate(owner), np.concatenate(keys)


def variants(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of lines with each of their words left out in turn, as ``whole`` would give them.

    ``words`` are the lines' words one after the other, ``sizes`` the number of words of each line.
    """
    n = len(words)
    up, down = K.WORD_POWERS.to(n + 2)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[1 : n + 1], out=sums[1:])
    end = np.repeat(np.cumsum(sizes), sizes)
    start = end - np.repeat(sizes, sizes)
    gap = np.arange(n)
    head = (sums[gap] - sums[start]) * down[start]
    # The words after the gap move up by one place.
    tail = (sums[end] - sums[gap + 1]) * down[start + 1]
    return K.mix(head + tail + (end - start - 1).astype(np.uint64))


def first_lines(docs: DataFrame, settings: Lines) -> DataFrame:
    """(line_hash, place, halves) of the first place of every distinct line that is not blank."""

    def step(batch):
        ids = batch.column(0).to_numpy()
        for first, data, offsets in K.chunks(batch.column(1)):
            grid = Grid(data, offsets)
            hashes = grid.whole()
            owner, keys = grid.halves(settings)
            order = np.argsort(owner, kind="stable")
            owner, keys = owner[order], K.signed(keys[order])
            cuts = np.searchsorted(owner, np.arange(len(hashes) + 1))
            # One row for each distinct line of the chunk is enough: the earliest.
            rows = np.flatnonzero(grid.size > 0)
            order = np.lexsort((grid.number[rows], ids[first + grid.text[rows]], hashes[rows]))
            rows = rows[order]
            rows = rows[np.concatenate([[True], np.diff(hashes[rows]) != 0])] if len(rows) else rows
            yield {
                "line_hash": K.signed(hashes[rows]),
                "place": pa.StructArray.from_arrays([pa.array(ids[first + grid.text[rows]], pa.int64()), pa.array(grid.number[rows], pa.int32())], ["doc_id", "line"]),
                "halves": K.long_lists([keys[cuts[r] : cuts[r + 1]] for r in rows]),
            }

    found = map_arrow(texts(docs), step, f"line_hash long, place {PLACE}, halves array<long>")
    return found.groupBy("line_hash").agg(F.min("place").alias("place"), F.first("halves").alias("halves"))


def paired(firsts: DataFrame) -> DataFrame:
    """(line_hash, place) of the distinct lines that share a half with another one, and perhaps a few more. Runs jobs."""
    halves = firsts.select("line_hash", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line_hash").alias("a"), F.max("line_hash").alias("b")).filter("a < b")
    members = Members.of(shared, "half")

    def step(batch):
        lists = batch.column("halves")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        keep = pa.array(np.unique(owner[members(lists.flatten().to_numpy())]))
        yield {"line_hash": batch.column("line_hash").take(keep), "place": batch.column("place").take(keep)}

    return map_arrow(firsts, step, f"line_hash long, place {PLACE}", "line_hash", "place", "halves")


def neighbourhoods(docs: DataFrame, wanted: DataFrame, settings: Lines) -> DataFrame:
    """(line_hash, place, words) of the wanted lines, read at their first places. Runs a job."""
    members = Members.of(wanted, "line_hash")

    def step(batch):
        ids = batch.column(0).to_numpy()
        for first, data, offsets in K.chunks(batch.column(1)):
            grid = Grid(data, offsets)
            hashes = grid.whole()
            keep = np.flatnonzero((grid.size >= settings.min_words) & members(hashes))
            # As in first_lines, the earliest by doc_id, in whatever order the rows stand.
            keep = keep[np.lexsort((grid.number[keep], ids[first + grid.text[keep]], hashes[keep]))]
            keep = keep[np.concatenate([[True], np.diff(hashes[keep]) != 0])] if len(keep) else keep
            yield {
                "line_hash": K.signed(hashes[keep]),
                "place": pa.StructArray.from_arrays([pa.array(ids[first + grid.text[keep]], pa.int64()), pa.array(grid.number[keep], pa.int32())], ["doc_id", "line"]),
                "words": K.long_lists([K.signed(grid.spans.hash[grid.first[i] : grid.first[i] + grid.size[i]]) for i in keep]),
            }

    rows = map_arrow(texts(docs), step, f"line_hash long, place {PLACE}, words array<long>")
    return rows.join(wanted, ["line_hash", "place"], "left_semi")


def keys_of(lines: DataFrame, wanted: Members | None = None) -> DataFrame:
    """(key, kind, line_hash, place) of the lines' keys, or of those that ``wanted`` lets pass.

    Kind 0 is the line itself, 1 a variant to meet a line itself, 2 a variant with its place.
    """

    def step(batch):
        lists = batch.column("words")
        hashes, sizes = batch.column("line_hash").to_numpy(), np.diff(lists.offsets.to_numpy())
        if not len(hashes):
            return
        without = variants(lists.flatten().to_numpy().view(np.uint64), sizes)
        owner = np.repeat(np.arange(len(hashes)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        placed = K.mix(without + (at + 1).astype(np.uint64) * K.BASE)
        key = np.concatenate([hashes, K.signed(without), K.signed(placed)])
        kind = np.repeat(np.array([0, 1, 2], np.int8), [len(hashes), len(owner), len(owner)])
        owner = np.concatenate([np.arange(len(hashes)), owner, owner])
        keep = np.arange(len(key)) if wanted is None else np.flatnonzero(wanted(key))
        yield {"key": key[keep], "kind": kind[keep], "line_hash": hashes[owner[keep]], "place": batch.column("place").take(pa.array(owner[keep]))}

    return map_arrow(lines, step, f"key long, kind byte, line_hash long, place {PLACE}", "line_hash", "place", "words")


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two word sequences are at most one insertion, deletion or replacement apart."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if len(long) - n > 1:
        return False
    same = short == long[:n]
    head = n if same.all() else int(same.argmin())
    same = (short == long[len(long) - n :])[::-1]
    tail = n if same.all() else int(same.argmin())
    return head + tail >= len(long) - 1


def near_lines(docs: DataFrame, firsts: DataFrame, settings: Lines) -> DataFrame:
    """line_hash of distinct lines with an earlier line within one edit. Runs jobs."""
    lines = materialize(neighbourhoods(docs, materialize(paired(firsts), "paired"), settings), "paired-lines")
    # Most keys are one line's alone. What is left of the others is small, so only they are aggregated in full.
    every = keys_of(lines).groupBy("key").agg(F.min("line_hash").alias("a"), F.max("line_hash").alias("b"))
    shared = materialize(every.filter("a < b").select("key"), "shared-keys")
    rows = keys_of(lines, Members.of(shared, "key"))
    who = F.struct("place", "line_hash")
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, who)).alias(f"k{k}") for k in range(3)])
    # A line meets variants, a variant the line it is of, a variant left out at a place its equals.
    met = F.when(F.col("kind") == 0, F.col("k1")).when(F.col("kind") == 1, F.col("k0")).otherwise(F.col("k2"))
    found = rows.join(least, "key").withColumn("met", met)
    found = found.filter("met.place < place").select("line_hash", F.col("met.line_hash").alias("other")).distinct()
    words = lines.select("line_hash", "words")
    pairs = found.join(words, "line_hash").join(words.select(F.col("line_hash").alias("other"), F.col("words").alias("others")), "other")

    def step(batch):
        a, b = batch.column("words"), batch.column("others")
        keep = [i for i in range(batch.num_rows) if one_edit(a[i].values.to_numpy(), b[i].values.to_numpy())]
        yield {"line_hash": batch.column("line_hash").take(pa.array(keep, pa.int64()))}

    return map_arrow(pairs, step, "line_hash long", "line_hash", "words", "others").distinct()


def kept_lines(docs: DataFrame, settings: Lines = Lines()) -> DataFrame:
    """(line_hash, place): the distinct lines that stay, each at its first place. Runs jobs."""
    firsts = materialize(first_lines(docs, settings), "lines")
    near = materialize(near_lines(docs, firsts, settings), "near-lines")
    return firsts.select("line_hash", "place").join(near, "line_hash", "left_anti")


def shortened(rows: DataFrame, kept: DataFrame, carry: str = "") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text), and the column ``carry`` as it is (name and type)."""
    by_doc = kept.groupBy(F.col("place.doc_id").alias("doc_id")).agg(F.collect_list("place.line").alias("kept"))

    def step(batch):
        out = {"n_lines": [], "n_dropped": [], "text": []}
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept")):
            parts = [] if text is None else text.split("\n")
            own = set(kept.values.to_numpy().tolist()) if kept.is_valid else set()
            left = [p for i, p in enumerate(parts) if i in own or not p.strip(BLANKS)]
            out["n_lines"].append(len(parts))
            out["n_dropped"].append(len(parts) - len(left))
            out["text"].append(None if text is None else text if len(left) == len(parts) else "\n".join(left))
        made = {"n_lines": pa.array(out["n_lines"], pa.int64()), "n_dropped": pa.array(out["n_dropped"], pa.int64()), "text": pa.array(out["text"], pa.string())}
        yield {"doc_id": batch.column("doc_id")} | made | {name: batch.column(name) for name in carry.split(" ")[:1] if name}

    schema = "doc_id long, n_lines long, n_dropped long, text string"
    return rows.join(by_doc, "doc_id", "left").mapInArrow(arrow_step(step), f"{schema}, {carry}" if carry else schema)


def arrow_step(step):
    """A function of batches from one of a batch, for results whose column names are the schema's."""

    def run(batches):
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_pydict(out)

    return run


def deduped(docs: DataFrame, settings: Lines = Lines()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text without the dropped lines. Runs jobs.

    ``docs`` has doc_id and text; other columns are not read. Lines are what line feeds part. A line
    is dropped if an equal line, or one within one edit (both of ``min_words`` words or more), stands
    earlier, by doc_id and then by line; it does not matter whether that line is dropped itself.
    Blank lines stay. A null text stays null, with no lines; rows without doc_id are left out. Rows
    with the same doc_id are the same document: give each its own id before. An empty table gives no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shortened(rows.filter("doc_id IS NOT NULL"), kept_lines(docs, settings))


BLANKS = " \t\n\v\f\r"


def drop_lines(docs: DataFrame, settings: Lines = Lines()) -> DataFrame:
    """``docs`` with deduped texts, in its own columns. Runs jobs.

    Documents that lost all their words with the dropped lines repeat earlier ones altogether and go;
    those that had none to begin with stay, as do rows without doc_id.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)
    kind = rows.schema["rest"].dataType.simpleString()
    gone = (F.col("n_dropped") > 0) & (F.length(F.translate("text", BLANKS, "")) == 0)
    left = shortened(rows.filter("doc_id IS NOT NULL"), kept_lines(docs, settings), f"rest {kind}").filter(~F.coalesce(gone, F.lit(False)))
    left = left.select("rest", "text").unionByName(rows.filter("doc_id IS NULL").select("rest", "text"))
    return left.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
