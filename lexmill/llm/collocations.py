"""Phrase collocations by stripes: every prefix keys an associative counter of the words that follow
it. Stripes of the same prefix are merged elementwise; a merged stripe gives the extensions of its
prefix, the prefix's own total, and the most frequent extension, which tells what is subsumed.

Words are 64-bit fingerprints of language and word, so one corpus holds all languages; a phrase is
the bytes of its words' fingerprints, and phrases differ whenever their words do. That no two words
share a fingerprint is checked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.common import FILTER_BITS, Members
from lexmill.llm.kernel import LOWER, U64, byte_set, chunks, mix, signed, words
from lexmill.sources.workdir import materialize

#: What ends a piece, and what ends a word.
ENDS = byte_set((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
GAP = ENDS | byte_set((0x20, 0x20), (0x09, 0x09))
#: Parts in which the best phrases of a language are found before they meet.
PARTS = 64


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``max_words`` words that occur ``least`` times; ``top`` of each language.

    A phrase is subsumed where a longer one has ``share`` percent of its occurrences. A prefix that
    holds more than 1 / ``hot`` of all words is split by the word that follows into as many parts
    as it holds such shares. A task gathers the stripes of ``held`` places before it hands them on,
    in rows of at most ``row`` entries.
    """

    max_words: int = 3
    least: int = 10
    share: int = 50
    top: int = 2000
    hot: int = 1024
    held: int = 3 << 19
    row: int = 512


def lang_of(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang_of(F.col("lang")).alias("lang"), F.xxhash64(lang_of(F.col("lang"))).alias("code"))


def places(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, object]:
    """Fingerprints of a chunk's words, whether the next word goes on in the same piece, and the spans."""
    spans = words(data, offsets, GAP, LOWER)
    owner = spans.owner()
    ids = mix(spans.hash ^ mix(codes.view(U64))[owner])
    ends = np.concatenate([[0], np.cumsum(ENDS[data], dtype=np.int64)])
    goes_on = np.zeros(len(ids), bool)
    goes_on[:-1] = (owner[1:] == owner[:-1]) & (ends[spans.start[1:]] == ends[spans.end[:-1]])
    return ids, goes_on, spans


def all_places(batch: pa.RecordBatch) -> Iterator[tuple]:
    codes = batch.column("code").to_numpy()
    for first, data, offsets in chunks(batch.column("text")):
        ids, goes_on, spans = places(data, offsets, codes[first : first + len(offsets) - 1])
        if len(ids):
            yield first, data, ids, goes_on, spans


def vocabulary(docs: DataFrame, held_words: int = Mining.held // 2) -> DataFrame:
    """``id, lang, word, n`` of every word of every language: the stripe of the empty prefix.

    Each task hands on every distinct word once for as much text as it holds at a time. Fails if
    two words share a fingerprint. Runs a job.
    """

    def out(held: list[dict]) -> pa.RecordBatch:
        table = pa.concat_tables([pa.table(h) for h in held]).combine_chunks()
        ids, first, back = np.unique(table["id"].to_numpy(), return_index=True, return_inverse=True)
        n = np.bincount(back, table["n"].to_numpy(), len(ids)).astype(np.int64)
        kept = table.select(["lang", "word"]).take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_pydict({"id": pa.array(ids), "n": pa.array(n), "lang": kept["lang"].chunk(0), "word": kept["word"].chunk(0)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            langs = batch.column("lang")
            for first, data, ids, _, spans in all_places(batch):
                own, at, n = np.unique(ids, return_index=True, return_counts=True)
                low = LOWER[data].tobytes()
                texts = [low[s:e].decode("utf-8", "replace") for s, e in zip(spans.start[at].tolist(), spans.end[at].tolist())]
                lang = langs.take(pa.array(first + spans.owner()[at]))
                held.append({"id": pa.array(signed(own)), "n": pa.array(n), "lang": lang, "word": pa.array(texts, pa.string())})
                size += len(own)
                if size >= held_words:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return merged_words(rows_of(docs).mapInArrow(run, "id bigint, n bigint, lang string, word string"))


def merged_words(found: DataFrame) -> DataFrame:
    """Counts of the same word added up; no two words may have one id."""
    named = F.struct("lang", "word")
    merged = found.groupBy("id").agg(F.sum("n").alias("n"), F.min(named).alias("low"), F.max(named).alias("high"))
    merged = merged.select("id", "n", "low.lang", "low.word", (F.col("low") == F.col("high")).alias("same"))
    kept = materialize(merged, "words")
    if not kept.filter("NOT same").isEmpty():
        raise RuntimeError("two words share a fingerprint")
    return kept.drop("same")


def phrase_key(ids: np.ndarray) -> np.ndarray:
    """One number for each row of fingerprints, for the bitmaps only: different phrases may share it."""
    key = np.full(len(ids), U64(ids.shape[1]), U64)
    for j in range(ids.shape[1]):
        key = mix(key * U64(0x9E3779B97F4A7C15) + ids[:, j])
    return key


def bytes_of(ids: np.ndarray) -> pa.Array:
    """A binary column: the fingerprints of each row, highest byte first."""
    flat = np.ascontiguousarray(ids.astype(">u8")).tobytes()
    ends = np.arange(len(ids) + 1, dtype=np.int32) * (8 * ids.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def of_bytes(column: pa.Array, k: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, k), U64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], ">u8", count=k * len(column), offset=int(ends[0]))
    return flat.astype(U64).reshape(-1, k)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns that are sorted by them."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def stripe_rows(prefix: np.ndarray, follow: np.ndarray, known: np.ndarray, heat: dict[int, int], row: int = Mining.row) -> pa.RecordBatch:
    """One task's stripes: prefix, part, next words with their counts, and what is followed by none of them.

    ``known`` says which places have a next word that counts as one; the others are ``rest``.
    """
    k = prefix.shape[1]
    order = np.lexsort((follow, known, *[prefix[:, j] for j in range(k - 1, -1, -1)]))
    prefix, follow, known = prefix[order], np.where(known, follow, U64(0))[order], known[order]
    own = [prefix[:, j] for j in range(k)]
    first = runs(*own, known, follow)
    n = np.diff(np.append(first, len(follow)))
    prefix, follow, known = prefix[first], follow[first], known[first]
    part = np.zeros(len(prefix), np.int64)
    if heat:
        keys = np.array(sorted(heat), U64)
        at = np.minimum(np.searchsorted(keys, phrase_key(prefix)), len(keys) - 1)
        hot = (keys[at] == phrase_key(prefix)) & known
        parts = np.array([heat[int(x)] for x in keys], U64)[at]
        part = np.where(hot, (mix(follow) % np.maximum(parts, U64(1))).astype(np.int64), 0)
        order = np.lexsort((part, ~known, *[prefix[:, j] for j in range(k - 1, -1, -1)]))
        prefix, follow, known, part, n = prefix[order], follow[order], known[order], part[order], n[order]
    else:
        order = np.lexsort((~known, *[prefix[:, j] for j in range(k - 1, -1, -1)]))
        prefix, follow, known, n = prefix[order], follow[order], known[order], n[order]
    start = runs(*[prefix[:, j] for j in range(k)], part, known)
    long = np.diff(np.append(start, len(part)))
    start = np.concatenate([np.arange(s, s + m, row) for s, m in zip(start[long > row], long[long > row])] + [start[long <= row]])
    start.sort()
    ends = np.append(start, len(part))
    # Rows of rests have no entries; their one number is the rest.
    listed = known[start]
    sizes = np.where(listed, np.diff(ends), 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_pydict({
        "prefix": bytes_of(prefix[start]),
        "part": pa.array(part[start]),
        "next": pa.ListArray.from_arrays(offsets, pa.array(signed(follow[known]))),
        "n": pa.ListArray.from_arrays(offsets, pa.array(n[known].astype(np.int32))),
        "rest": pa.array(np.where(listed, 0, n[start]).astype(np.int64)),
    })


STRIPE = "prefix binary, part bigint, next array<bigint>, n array<int>, rest bigint"
MERGED = "prefix binary, next bigint, n bigint, total bigint, longest bigint"


def merge_stripes(batches, k: int, least: int):
    """Merges the sorted rows of the same prefix and part elementwise.

    Gives one row for each entry of ``least`` occurrences or more, and one without ``next`` that
    holds the total of the stripe and its largest entry. Only the last stripe of a batch is kept
    for the next one.
    """

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("next").value_lengths().to_numpy().astype(np.int64)
        own, part = of_bytes(batch.column("prefix"), k), batch.column("part").to_numpy()
        # A rest is an entry of its own kind, so that one array holds all that is added up.
        here = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.concatenate([here, np.arange(batch.num_rows)])
        entry = {
            "prefix": own[at],
            "part": part[at],
            "known": np.concatenate([np.ones(len(here), bool), np.zeros(batch.num_rows, bool)]),
            "next": np.concatenate([batch.column("next").flatten().to_numpy().view(U64), np.zeros(batch.num_rows, U64)]),
            "n": np.concatenate([batch.column("n").flatten().to_numpy().astype(np.int64), batch.column("rest").to_numpy()]),
        }
        if kept is not None:
            entry = {c: np.concatenate([kept[c], entry[c]]) for c in entry}
        entry = added(entry, k)
        same = (entry["prefix"] == entry["prefix"][-1]).all(axis=1) & (entry["part"] == entry["part"][-1])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        kept = {c: v[cut:] for c, v in entry.items()}
        if cut:
            yield stripe_sums({c: v[:cut] for c, v in entry.items()}, k, least)
    if kept is not None:
        yield stripe_sums(kept, k, least)


def added(entry: dict, k: int) -> dict:
    """Equal entries added up, sorted by prefix, part and next word."""
    own = [entry["prefix"][:, j] for j in range(k)]
    order = np.lexsort((entry["next"], entry["known"], entry["part"], *own[::-1]))
    entry = {c: v[order] for c, v in entry.items()}
    first = runs(*[entry["prefix"][:, j] for j in range(k)], entry["part"], entry["known"], entry["next"])
    n = np.add.reduceat(entry["n"], first)
    return {**{c: v[first] for c, v in entry.items()}, "n": n}


def stripe_sums(entry: dict, k: int, least: int) -> pa.RecordBatch:
    first = runs(*[entry["prefix"][:, j] for j in range(k)], entry["part"])
    total = np.add.reduceat(entry["n"], first)
    longest = np.maximum.reduceat(np.where(entry["known"], entry["n"], 0), first)
    often = np.flatnonzero(entry["known"] & (entry["n"] >= least))
    none = np.zeros(len(first), bool)
    shown = np.concatenate([np.ones(len(often), bool), none])
    zeros = np.zeros(len(often), np.int64)
    return pa.RecordBatch.from_pydict({
        "prefix": bytes_of(np.concatenate([entry["prefix"][often], entry["prefix"][first]])),
        "next": pa.array(np.concatenate([signed(entry["next"][often]), np.zeros(len(first), np.int64)]), mask=~shown),
        "n": pa.array(np.concatenate([entry["n"][often], np.zeros(len(first), np.int64)])),
        "total": pa.array(np.concatenate([zeros, total])),
        "longest": pa.array(np.concatenate([zeros, longest])),
    })


def stripes(docs: DataFrame, k: int, members: Members, heat: dict[int, int], mining: Mining) -> DataFrame:
    """The merged stripes of all prefixes of ``k`` words that may occur often enough. Runs a job.

    Only phrases whose two halves, all words but the last and all but the first, passed ``members``
    can occur often enough, so next words that make no such phrase are only added to the rest.
    """

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, ids, goes_on, _ in all_places(batch):
                m = len(ids) - k + 1
                if m <= 0:
                    continue
                rows = np.stack([ids[j : m + j] for j in range(k)], axis=1)
                whole = np.ones(m, bool)
                for j in range(k - 1):
                    whole &= goes_on[j : m + j]
                whole &= members(phrase_key(rows))
                follow, known = np.zeros(m, U64), np.zeros(m, bool)
                follow[:-1] = ids[k:]
                known[:-1] = goes_on[k - 1 : k - 1 + m - 1] & whole[1:]
                at = np.flatnonzero(whole)
                held.append((rows[at], follow[at], known[at]))
                size += len(at)
                if size >= mining.held:
                    yield stripe_rows(*[np.concatenate(x) for x in zip(*held)], heat, mining.row)
                    held, size = [], 0
        if size:
            yield stripe_rows(*[np.concatenate(x) for x in zip(*held)], heat, mining.row)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows_of(docs).mapInArrow(gather, STRIPE).repartition(tasks, "prefix", "part").sortWithinPartitions("prefix", "part")
    return materialize(dealt.mapInArrow(lambda batches: merge_stripes(batches, k, mining.least), MERGED), "stripes")


def hot_prefixes(totals: DataFrame, hot: int) -> dict[int, int]:
    """Keys of the prefixes that hold more than 1 / ``hot`` of all words, and their numbers of parts.

    Fewer than ``hot`` phrases of one length can, so that many rows reach the driver at most.
    """
    all_words = totals.agg(F.sum("total")).first()[0] or 0
    found = totals.filter(F.col("total") * hot > all_words).select("prefix", "total").collect()
    keys = [phrase_key(np.frombuffer(bytes(r["prefix"]), ">u8").astype(U64)[None, :])[0] for r in found]
    return {int(key): -(-r["total"] * hot // all_words) for key, r in zip(keys, found)}


def keyed(phrases: DataFrame, k: int, bits: int) -> Members:
    """A bitmap of phrases of ``k`` words given as bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(phrase_key(of_bytes(batch.column("prefix"), k))))})

    return Members.of(phrases.select("prefix").mapInArrow(run, "key bigint"), "key", bits)


def as_bytes(number: Column) -> Column:
    """The eight bytes of a LONG, highest first, as ``bytes_of`` gives them."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language.

    ``docs`` has text and lang; other columns are ignored. A null text is empty, a null lang is
    ``und``. ``a`` counts a phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` all
    words of the language; score is 10^6 a^2 / (l r), rounded down, computed in whole numbers.
    Phrases that tie in score and count come by their text. Repeated rows count again; empty
    tables give no rows. Runs jobs.
    """
    vocab = vocabulary(docs, mining.held // 2)
    langs = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = vocab.select(as_bytes(F.col("id")).alias("prefix"), F.col("n").alias("total"))
    found, lengths = [], []
    for k in range(1, mining.max_words):
        often = totals.filter(F.col("total") >= mining.least)
        level = stripes(docs, k, keyed(often, k, FILTER_BITS), hot_prefixes(totals, mining.hot), mining)
        sums = level.filter("next IS NULL").groupBy("prefix").agg(F.sum("total").alias("total"), F.max("longest").alias("longest"))
        found.append(sums.filter(F.col("total") >= mining.least))
        phrases = level.filter("next IS NOT NULL").select(F.concat("prefix", as_bytes(F.col("next"))).alias("phrase"), F.col("n").alias("a"))
        lengths.append(phrases)
        totals = phrases.select(F.col("phrase").alias("prefix"), F.col("a").alias("total"))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    known = materialize(known, "prefixes")
    phrases = lengths[0]
    for more in lengths[1:]:
        phrases = phrases.unionByName(more)

    # What a longer phrase takes away: its own stripe's largest entry to the right, and to the left
    # the most frequent phrase that ends in it.
    left = [p.select(F.expr("substring(phrase, 9)").alias("inner"), F.col("a").alias("over")) for p in lengths[1:]]
    right = known.select(F.col("prefix").alias("inner"), F.col("longest").alias("over"))
    over = right
    for more in left:
        over = over.unionByName(more)
    over = over.groupBy("inner").agg(F.max("over").alias("over"))
    kept = phrases.join(over, F.col("phrase") == F.col("inner"), "left")
    subsumed = (F.col("over") >= mining.least) & (100 * F.col("over") >= mining.share * F.col("a"))
    kept = kept.filter(~F.coalesce(subsumed, F.lit(False))).select("phrase", "a")

    cut = F.explode(F.expr("sequence(1, cast(length(phrase) div 8 as int) - 1)")).alias("k")
    cuts = kept.select("phrase", "a", cut)
    cuts = cuts.select("phrase", "a", "k", F.expr("substring(phrase, 1, 8 * k)").alias("head"), F.expr("substring(phrase, 8 * k + 1)").alias("tail"))
    cuts = cuts.join(known.select(F.col("prefix").alias("head"), F.col("total").alias("l")), "head")
    cuts = cuts.join(known.select(F.col("prefix").alias("tail"), F.col("total").alias("r")), "tail")
    exact = lambda *names: " * ".join(f"cast({c} as decimal(19,0))" for c in names)
    score = F.expr(f"cast(({exact('a', 'a')} * 1000000) div ({exact('l', 'r')}) as bigint)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("phrase").agg(F.first("a").alias("a"), weakest)
    scored = materialize(scored.select("phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")

    names = vocab.filter(F.col("n") >= mining.least).select(as_bytes(F.col("id")).alias("id"), "lang", "word")
    spelt = scored.select("*", F.posexplode(F.expr("transform(sequence(1, length(phrase), 8), i -> substring(phrase, i, 8))")).alias("pos", "id"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "word")))
    spelt = spelt.join(names, "id").groupBy("phrase", "a", "l", "r", "score").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("text")
    )
    order = [F.desc("score"), F.desc("a"), F.col("text")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("text"), F.lit(PARTS))).orderBy(*order))
    few = spelt.withColumn("rank", part).filter(F.col("rank") <= mining.top).drop("rank", "phrase")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.filter(F.col("rank") <= mining.top).join(langs, "lang")
    return ranked.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
