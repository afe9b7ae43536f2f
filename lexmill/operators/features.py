"""Term counts, vocabulary, TF-IDF weights and encoded sequences.

Counting happens inside each row, so texts are never shuffled and only (term, count) pairs of
distinct terms leave a document. Spark finds the words; tables of counted texts are made, added up
and looked up in Arrow batches, a bounded number of terms at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lexmill.functions import text as X
from lexmill.sources.workdir import materialize, materialize_bucketed

NGRAMS = (1, 2)
MAX_FEATURES = 50_000
SLOTS_PER_FEATURE = 32
#: Terms of counted texts that a task makes, and those that it adds up or looks up, at a time (or one text's).
MADE, HELD = 1 << 18, 1 << 20
#: Words hashed at a time, and slots in one row of a sum that is handed on.
HASHED, SLICE = 1 << 16, 1 << 12
#: Bytes of texts kept as words that a task counts, and those that it only hashes, at a time (or one text's).
HELD_BYTES, HASHED_BYTES = 1 << 22, 1 << 18
#: Bytes of a word that are hashed eight at a time; longer words are hashed whole.
LONG = 64
SUMS = (np.int32, np.int64)
#: Masks of a number's first bytes.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2


def _grams(text: str, ngram_range: tuple[int, int]) -> Column:
    return X.ngrams(X.tokens(F.col(text)), *ngram_range)


def gram_positions(df: DataFrame, key: str = "doc_id", text: str = "text", ngram_range=NGRAMS) -> DataFrame:
    """``key, pos, gram`` for every n-gram of every text, unigrams first."""
    return df.select(key, F.posexplode(_grams(text, ngram_range)).alias("pos", "gram"))


def _counted(text: str, ngram_range: tuple[int, int]) -> Column:
    return X.term_counts(_grams(text, ngram_range))


def doc_terms(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ngram_range=NGRAMS, keep: Sequence[str] = (), outer: bool = False
) -> DataFrame:
    """``key, keep..., term, n``: how often each n-gram occurs in each text. No shuffle.

    With ``outer`` a text without terms yields one row whose term is NULL.
    """
    explode = F.explode_outer if outer else F.explode
    counted = docs.select(key, *keep, explode(_counted(text, ngram_range)).alias("_t"))
    return counted.select(key, *keep, F.col("_t.term").alias("term"), F.col("_t.n").alias("n"))


def counted_docs(
    docs: DataFrame, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", ngram_range=NGRAMS, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """``key, keep..., terms``, one row per text, written once.

    Runs a job. Cleaning and taking apart the texts is the costly part of an experiment; vocabulary,
    training rows and scoring all start from this table.
    """
    return materialize(counted_rows(docs, keep, key, text, ngram_range), "counted-terms", partition_by)


def schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def counted_rows(docs: DataFrame, keep: Sequence[str], key: str, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """``key, keep..., terms``, not yet written. A text without terms has none (NULL)."""
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("n-gram range must satisfy 1 <= low <= high")
    columns = [key, *keep]
    # No word holds a space.
    words = docs.select(*columns, F.array_join(X.tokens(F.col(text)), " ").alias("_words"))

    def made(batch: pa.RecordBatch, ends: list[int], terms: list[str], n: list[int]) -> pa.RecordBatch:
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["term", "n"])
        none = pa.array(np.diff(ends) == 0)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=none)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], lists], [*columns, "terms"])

    def run(batches):
        for batch in batches:
            start, ends, terms, n = 0, [0], [], []
            for row, text_ in enumerate(batch.column("_words")):
                own = text_.as_py()
                own = own.split(" ") if own else []
                counts: Counter[str] = Counter()
                for size in range(low, high + 1):
                    counts.update(own if size == 1 else map(" ".join, zip(*[own[i:] for i in range(size)])))
                terms.extend(counts.keys())
                n.extend(counts.values())
                ends.append(len(terms))
                if len(terms) >= MADE:
                    yield made(batch.slice(start, row + 1 - start), ends, terms, n)
                    start, ends, terms, n = row + 1, [0], [], []
            if start < batch.num_rows:
                yield made(batch.slice(start), ends, terms, n)

    return words.mapInArrow(run, f"{schema_of(docs, columns)}, terms array<struct<term: string, n: bigint>>")


def word_docs(
    docs: DataFrame, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", ngram_range=NGRAMS, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """``key, keep..., terms``, one row per text, written once; ``terms`` holds the words in their order.

    Stands wherever a table of counted texts does, except for ``listed_terms``, and is as large as the
    texts. Every pass counts the n-grams of the words again, many texts at a time, which takes less than
    writing and reading them. Runs a job.
    """
    return materialize(word_rows(docs, keep, key, text, ngram_range), "words", partition_by)


def word_rows(docs: DataFrame, keep: Sequence[str], key: str, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """The same, not yet written. Words are parted by spaces; texts that became one (``one_per_key``) by line feeds."""
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError("n-gram range must satisfy 1 <= low <= high")
    words = F.array_join(X.tokens(F.col(text)), " ")
    terms = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.coalesce(words, F.lit("")).alias("words"))
    return docs.select(key, *keep, terms.alias("terms"))


class Words:
    """The words of texts kept as words: where they begin and end in the texts' bytes, their row and text, and a hash.

    ``row_of`` has the row of every text that has words. A word of up to eight bytes is told by its ``key``,
    its bytes as one number, as no word holds a zero byte.
    """

    def __init__(self, words: pa.Array):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        # Spaces and line feeds lie between words; a text's first and last byte need none around them.
        gap, cut = data <= 32, np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        opens, closes = cut[:-1].copy(), cut[1:].copy()
        opens[1:] |= gap[:-1]
        closes[:-1] |= gap[1:]
        self.start, self.stop = np.flatnonzero(opens & ~gap), np.flatnonzero(closes & ~gap) + 1
        self.row = self.text = np.repeat(np.arange(len(words)), np.diff(np.searchsorted(self.start, offsets)))
        self.n_texts, breaks = len(words), np.flatnonzero(data == 10)
        if len(breaks):
            self.text, self.n_texts = self.row + np.searchsorted(breaks, self.start), len(words) + len(breaks)
        self.row_of = np.zeros(max(1, self.n_texts), np.int64)
        self.row_of[self.text] = self.row
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        # The eight bytes from every place on; a shorter word's are cut off.
        eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
        length = self.stop - self.start
        self.short = length <= 8
        self.key = eight[self.start] & FIRST_BYTES[np.minimum(length, 8)]
        self._spans = np.empty(2 * len(self.start), np.int32)
        self._spans[0::2], self._spans[1::2] = self.start, self.stop
        self._data = padded
        self.hash = mixed(self.key)
        for at in range(8, LONG, 8):
            longer = np.flatnonzero(length > at)
            more = eight[self.start[longer] + at] & FIRST_BYTES[np.minimum(length[longer] - at, 8)]
            self.hash[longer] = mixed(joined_hash(self.hash[longer], more))
            if not len(longer):
                break
        else:
            longer = np.flatnonzero(length > LONG)
            self.hash[longer] = byte_sums(self.strings(longer))

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        if not len(at):
            return pa.array([], pa.string())
        # Words and the gaps between them, one after the other.
        spans = pa.StringArray.from_buffers(len(self._spans) - 1, pa.py_buffer(self._spans), pa.py_buffer(self._data))
        return spans.take(pa.array(2 * at))

    def runs(self, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ..., ``high`` words: where the runs of so many words begin, and a hash of each."""
        hashed = self.hash
        for size in range(1, high + 1):
            begin = np.arange(max(0, len(self.text) - size + 1))
            if size > 1:
                begin = begin[self.text[begin] == self.text[begin + size - 1]]
                longer = np.zeros(len(self.text), np.uint64)
                longer[begin] = joined_hash(hashed[begin], self.hash[begin + size - 1])
                hashed = longer
            yield begin, hashed[begin]

    def numbered(self, used: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """A number for each of the words used, the same for equal words, and the word of each number."""
        number, places_ = np.zeros(len(self.text), np.int64), np.flatnonzero(used)
        short, long = places_[self.short[places_]], places_[~self.short[places_]]
        own = pa.array(self.key[short].view(np.int64)).dictionary_encode()
        number[short], total = own.indices.to_numpy(), len(own.dictionary)
        own = self.strings(long).dictionary_encode()
        number[long], total = own.indices.to_numpy() + total, total + len(own.dictionary)
        one = np.zeros(total, np.int64)
        one[number[places_]] = places_
        return number, self.strings(one)


def dense(numbers_: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers get equal numbers from 0 on, and how many there are."""
    found = pa.array(numbers_).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def counted_words(words: pa.Array, low: int, high: int, chosen: tuple[np.ndarray, np.ndarray | None] | None = None) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Row, term and count of every n-gram of texts given as words, or of those in ``chosen`` slots."""
    own = Words(words)
    runs, used = {}, np.zeros(len(own.text), bool)
    for size, (begin, hashed) in enumerate(own.runs(high), 1):
        if size < low:
            continue
        if chosen is not None:
            begin = begin[in_slots(hashed, chosen)]
        runs[size] = begin
        for i in range(size):
            used[begin + i] = True
    word, names = own.numbered(used)
    rows, codes, counts, terms, known = [], [], [], [], 0
    for size, begin in runs.items():
        number = word[begin]
        for i in range(1, size):
            # Numbers of runs stay below the number of words.
            number = (number if i == 1 else dense(number)[0]) * len(names) + word[begin + i]
        code, found = dense(number)
        at = np.zeros(found, np.int64)
        at[code] = begin
        pair, n = np.unique(code * own.n_texts + own.text[begin], return_counts=True)
        parts = [names.take(pa.array(word[at + i])) for i in range(size)]
        terms.append(parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " "))
        rows.append(own.row_of[pair % max(1, own.n_texts)])
        codes.append(pair // max(1, own.n_texts) + known)
        counts.append(n.astype(np.int64))
        known += found
    term = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(codes).astype(np.int32)), pa.concat_arrays(terms))
    return np.concatenate(rows), term, np.concatenate(counts)


def kept_as_words(batch: pa.RecordBatch) -> bool:
    return pa.types.is_struct(batch.column("terms").type)


def word_stretches(batch: pa.RecordBatch, size: int = HELD_BYTES):
    """First row and one past the last of stretches of texts kept as words, these, and the n-gram range."""
    low, high, words = batch.column("terms").flatten()
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in _stretches(lengths, size):
        yield start, stop, words.slice(start, stop - start), low[0].as_py(), high[0].as_py()


def _stretches(lengths: np.ndarray, held_: int = HELD):
    ends, start = np.concatenate([[0], np.cumsum(lengths)]), 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + held_, "right")) - 1)
        yield start, stop
        start = stop


def held(batch: pa.RecordBatch, chosen: tuple[np.ndarray, np.ndarray | None] | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, pa.Array]]:
    """Stretches of counted texts: their rows, the row of every term, the terms and how often each occurs.

    With ``chosen`` given, only terms of these slots. Terms of texts kept as words come as a dictionary
    array, in which a term has one place.
    """
    if kept_as_words(batch):
        for start, stop, words, low, high in word_stretches(batch):
            row, term, n = counted_words(words, low, high, chosen)
            yield batch.slice(start, stop - start), row, term, pa.array(n)
        return
    lengths = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, stop in _stretches(lengths):
        part = batch.slice(start, stop - start)
        term, n = part.column("terms").flatten().flatten()
        row = np.repeat(np.arange(stop - start), lengths[start:stop])
        if chosen is not None:
            kept = in_slots(hashes_of(term), chosen)
            row, term, n = row[kept], term.filter(pa.array(kept)), n.filter(pa.array(kept))
        yield part, row, term, n


def places(term: pa.Array, names: pa.Array) -> np.ndarray:
    """Where each term stands in ``names``, -1 if nowhere."""
    if pa.types.is_dictionary(term.type):
        return places(term.dictionary, names)[term.indices.to_numpy()]
    return pc.fill_null(pc.index_in(term, value_set=names), -1).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length, b, np.uint64)])) for b in (ODD, np.uint64(pow(int(ODD), -1, 1 << 64))))


def byte_sums(words: pa.Array) -> np.ndarray:
    """For every word the sum of its bytes times powers of an odd number."""
    if len(words) > HASHED:
        return np.concatenate([byte_sums(words.slice(at, HASHED)) for at in range(0, len(words), HASHED)])
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    powers, back = _powers(1 << len(data).bit_length())
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[: len(data)])])
    return (upto[offsets[1:]] - upto[offsets[:-1]]) * back[offsets[:-1]]


def mixed(sums: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        sums = (sums ^ (sums >> np.uint64(shift))) * np.uint64(factor)
    return sums ^ (sums >> np.uint64(31))


def joined_hash(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of runs with one more word."""
    return run * ODD + word


def hashes_of(terms: pa.Array) -> np.ndarray:
    """The hash of every term, from those of its words; the same in all tasks."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    own = Words(terms)
    count = np.bincount(own.row, minlength=len(terms))
    first = np.cumsum(count) - count
    out = np.zeros(len(terms), np.uint64)
    for i in range(int(count.max(initial=0))):
        some = np.flatnonzero(count > i)
        word = own.hash[first[some] + i]
        out[some] = joined_hash(out[some], word) if i else word
    return out


def slots_of(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A slot in each of two rows of slots, by the two halves of a hash."""
    whole = mixed(hashes)
    # Products of a half and the number of slots spread over all of them.
    return tuple((half * np.uint64(slots) >> np.uint64(32)).astype(np.int64) for half in (whole >> np.uint64(32), whole & np.uint64(0xFFFFFFFF)))


def in_slots(hashes: np.ndarray, chosen: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
    """Whether both slots of a term are among the first of two sets of slots, and not both among the second (if there is one)."""
    wanted, but = chosen
    first, second = slots_of(hashes, wanted.shape[1])
    kept = wanted[0][first] & wanted[1][second]
    return kept if but is None else kept & ~(but[0][first] & but[1][second])


def summed_terms(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., term, tf, df``: occurrences and texts holding the term, per group of texts.

    The same as ``term_stats`` of the listed terms; a task adds up what it holds before the shuffle.
    """
    return partial_sums(counted, by).groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def partial_sums(counted: DataFrame, by: Sequence[str] = (), chosen=None) -> DataFrame:
    """The same columns, summed by each task for itself: a group's term may have several rows. No shuffle.

    ``chosen``, a broadcast pair of arrays of booleans, tells the slots whose terms are summed, and those
    whose terms are left out of them; all are summed if not given.
    """
    keys = [*by, "term"]

    def added(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
        return sums.select([*keys, "tf_sum", "df_sum"]).rename_columns([*keys, "tf", "df"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part, row, term, n in held(batch, None if chosen is None else chosen.value):
                row, term, tf, df = summed_places(part, by, row, term, n)
                groups = [part.column(c).take(pa.array(row)) for c in by]
                parts.append(pa.Table.from_arrays([*groups, term, tf, df], [*keys, "tf", "df"]))
                size += len(row)
                if size >= 4 * HELD:
                    # Sums that are few enough are held on to.
                    parts = [added(parts)]
                    size = len(parts[0])
                    if size >= 2 * HELD:
                        yield from parts[0].to_batches(1 << 16)
                        parts, size = [], 0
        if size:
            yield from added(parts).to_batches(1 << 16)

    groups = f"{schema_of(counted, by)}, " if by else ""
    return counted.select(*by, "terms").mapInArrow(run, f"{groups}term string, tf bigint, df bigint")


def summed_places(part: pa.RecordBatch, by: Sequence[str], row: np.ndarray, term: pa.Array, n: pa.Array):
    """Of every term of each group one of its rows, the term, its occurrences and its texts, if it has one place only."""
    if not pa.types.is_dictionary(term.type):
        return row, term, n, pa.array(np.ones(len(row), np.int64))
    group, groups = np.zeros(part.num_rows, np.int64), 1
    for c in by:
        own = part.column(c).dictionary_encode(null_encoding="encode")
        group, groups = dense(group * len(own.dictionary) + own.indices.to_numpy())
    place = term.indices.to_numpy().astype(np.int64)
    code, found = dense(place * groups + group[row])
    one = np.zeros(found, np.int64)
    one[code] = np.arange(len(row))
    tf = np.bincount(code, n.to_numpy(zero_copy_only=False), found).astype(np.int64)
    return row[one], term.dictionary.take(pa.array(place[one])), pa.array(tf), pa.array(np.bincount(code, minlength=found))


def _add_to_slots(total: np.ndarray, batch: pa.RecordBatch, slots: int) -> None:
    """Adds the occurrences of all terms of these texts to the slots in each of two rows, which lie one after the other."""
    if not kept_as_words(batch):
        for _, _, term, n in held(batch):
            for at, own in enumerate(slots_of(hashes_of(term), slots)):
                np.add.at(total, own + at * slots, n.to_numpy(zero_copy_only=False))
        return
    for _, _, words, low, high in word_stretches(batch, HASHED_BYTES):
        for _, hashed in islice(Words(words).runs(high), low - 1, None):
            for at, own in enumerate(slots_of(hashed, slots)):
                np.add.at(total, own + at * slots, 1)


def _sliced(total: np.ndarray) -> dict:
    """Sums in slices, those of zeros left out; one task's sums mostly fit 32 bits, added up they may not."""
    total = total.astype(SUMS[int(total.max(initial=0) >= 1 << 31)])
    starts = [at for at in range(0, len(total), SLICE) if total[at : at + SLICE].any()]
    return {"slice": pa.array(starts, pa.int64()), "sums": pa.array([total[at : at + SLICE].tobytes() for at in starts], pa.binary()), "wide": pa.array([total.dtype == np.int64] * len(starts), pa.bool_())}


def slot_sums(counted: DataFrame, slots: int) -> np.ndarray:
    """Occurrences of all terms of each slot, in two rows of ``slots``; a term has a slot in each. Runs a job.

    As many tasks as run at a time, each with one number per slot; these are added up on the executors
    in slices. The driver gets twice ``slots`` numbers.
    """

    def local(batches):
        total = np.zeros(2 * slots, np.int64)
        for batch in batches:
            _add_to_slots(total, batch, slots)
        yield pa.RecordBatch.from_pydict(_sliced(total))

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums, wide in zip(*(batch.column(c).to_pylist() for c in ("slice", "sums", "wide"))):
                total[at] = total.get(at, 0) + np.frombuffer(sums, SUMS[wide]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int64()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    schema, tasks = "slice bigint, sums binary", counted.sparkSession.sparkContext.defaultParallelism
    read = counted.select("terms").coalesce(tasks).mapInArrow(local, f"{schema}, wide boolean")
    out = np.zeros(2 * slots, np.int64)
    rows = read.repartition("slice").mapInArrow(added, schema).toArrow()
    for at, sums in zip(rows["slice"].to_pylist(), rows["sums"].to_pylist()):
        own = np.frombuffer(sums, np.int64)
        out[at : at + len(own)] = own
    return out.reshape(2, slots)


def grouped_slot_sums(counted: DataFrame, by: str, slots: int) -> dict[int, np.ndarray]:
    """``slot_sums`` of every group of texts, in one pass; ``by`` has whole numbers, of which there must be few.

    A task holds, and the driver gets, twice ``slots`` numbers for each group. Runs a job.
    """

    def local(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column(by).to_numpy()
            for g in np.unique(group).tolist():
                total = totals.setdefault(g, np.zeros(2 * slots, np.int64))
                _add_to_slots(total, batch.filter(pa.array(group == g)).select(["terms"]), slots)
        for g, total in totals.items():
            parts = _sliced(total)
            yield pa.RecordBatch.from_pydict({"group": pa.array([g] * len(parts["slice"]), pa.int64()), **parts})

    def added(key, table):
        total = sum(np.frombuffer(sums, SUMS[wide]).astype(np.int64) for sums, wide in zip(table["sums"].to_pylist(), table["wide"].to_pylist()))
        return pa.table({"group": pa.array([key[0].as_py()], pa.int64()), "slice": pa.array([key[1].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema, tasks = "group bigint, slice bigint, sums binary", counted.sparkSession.sparkContext.defaultParallelism
    read = counted.select(by, "terms").coalesce(tasks).mapInArrow(local, f"{schema}, wide boolean")
    rows = read.groupBy("group", "slice").applyInArrow(added, schema).toArrow()
    out: dict[int, np.ndarray] = {}
    for g, at, sums in zip(*(rows[c].to_pylist() for c in ("group", "slice", "sums"))):
        own = np.frombuffer(sums, np.int64)
        out.setdefault(g, np.zeros(2 * slots, np.int64))[at : at + len(own)] = own
    return {g: total.reshape(2, slots) for g, total in out.items()}


def _guess(total: np.ndarray, max_features: int) -> int:
    """A frequency that the border of a vocabulary may not lie below, from the sums of its slots."""
    filled = total[0][total[0] > 0]
    if len(filled) <= max_features:
        return 1
    last = np.partition(filled, len(filled) - max_features)[len(filled) - max_features]
    return max(1, int(0.7 * (last - np.median(total[0]))))


def _least(stats: DataFrame, max_features: int) -> int:
    """A frequency that the border cannot lie below, from some terms' ``term, tf``."""
    border = top_terms(stats, max_features).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    return border["tf"] if border["n"] >= max_features else 1


def winning_stats(counted: DataFrame, max_features: int = MAX_FEATURES, slots: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by..., term, tf, df`` of a superset of the ``max_features`` most frequent terms, all ties at their border included.

    No term is more frequent than the sum of either of its slots. Terms whose slots both reach a guess of
    the border are counted exactly; the last of the ``max_features`` most frequent of them is a frequency
    that the border cannot lie below. If that is less than the guess, the other terms whose slots reach
    it are counted too. So the result does not depend on the guess. Groups only part the counts. Runs jobs.
    """
    spark, slots = counted.sparkSession, slots or SLOTS_PER_FEATURE * max_features
    total = slot_sums(counted, slots)
    guess = _guess(total, max_features)

    def count(chosen: np.ndarray, but: np.ndarray | None = None) -> DataFrame:
        sums = partial_sums(counted, by, spark.sparkContext.broadcast((chosen, but)))
        return materialize(sums.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "term-stats")

    first = count(total >= guess)
    if guess == 1:
        return first
    whole = materialize(first.groupBy("term").agg(F.sum("tf").alias("tf")), "term-totals") if by else first
    least = _least(whole, max_features)
    return first if least >= guess else first.unionByName(count(total >= least, total >= guess))


def winning_set_stats(
    counted: DataFrame, sets: Mapping[str, Sequence[str]], max_features: int, by: str, slots: int | None = None
) -> DataFrame:
    """``train_set, term, by, tf`` as ``winning_stats`` has them, for several sets of groups at a time.

    Each group is hashed once, and the sets' slot sums are added up from those of their groups; terms that
    can win in any of the sets are counted in one pass. A set whose guess fails is counted by itself. Runs jobs.
    """
    slots = slots or SLOTS_PER_FEATURE * max_features
    sums = {g: slot_sums(counted.filter(F.col(by) == g), slots) for g in sorted({g for own in sets.values() for g in own})}
    totals = {name: sum((sums[g] for g in set(own)), np.zeros((2, slots), np.int64)) for name, own in sets.items()}
    guesses = {name: _guess(total, max_features) for name, total in totals.items()}
    chosen = np.logical_or.reduce([totals[name] >= guesses[name] for name in sets])
    parts = partial_sums(counted, [by], counted.sparkSession.sparkContext.broadcast((chosen, None)))
    stats = materialize(parts.groupBy(by, "term").agg(F.sum("tf").alias("tf")), "term-stats")
    out = []
    for name, own in sets.items():
        first = stats.filter(F.col(by).isin(list(own)))
        if guesses[name] > 1:
            whole = materialize(first.groupBy("term").agg(F.sum("tf").alias("tf")), "term-totals")
            if _least(whole, max_features) < guesses[name]:
                first = winning_stats(counted.filter(F.col(by).isin(list(own))), max_features, slots, [by])
        out.append(first.select(F.lit(name).alias("train_set"), "term", by, "tf"))
    return reduce(DataFrame.unionByName, out)


def one_per_key(counted: DataFrame, keep: Sequence[str], key: str, group: Sequence[str] | None = None) -> DataFrame:
    """``key, keep..., terms``: rows that share the key and ``group`` (all of ``keep`` if not given) become one.

    Its terms are theirs one after the other; of other columns the first value stays. Only rows whose
    key occurs more than once are shuffled. Runs a job, which finds those keys.
    """
    group = list(keep if group is None else group)
    counts = counted.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = materialize(counts.select("_key"), "repeated-keys")
    columns = [key, *keep, "terms"]
    same = F.col(key).eqNullSafe(F.col("_key"))
    kind = counted.schema["terms"].dataType
    if isinstance(kind, T.StructType):
        joined = F.array_join(F.collect_list("terms.words"), "\n")
        terms = F.struct(F.first("terms.low").alias("low"), F.first("terms.high").alias("high"), joined.alias("words")).alias("terms")
    else:
        terms = F.flatten(F.collect_list(F.coalesce("terms", F.array().cast(kind)))).alias("terms")
    firsts = [F.first(c).alias(c) for c in keep if c not in group]
    several = counted.select(*columns).join(repeated, same, "left_semi").groupBy(key, *group).agg(terms, *firsts)
    return counted.select(*columns).join(repeated, same, "left_anti").unionByName(several.select(*columns))


def looked_up(rows: DataFrame, columns: Sequence[str], known: DataFrame, body: Callable, schema: str) -> DataFrame:
    """Counted texts with their terms looked up in the table ``known``, whose first column is ``term``.

    ``body`` gets a stretch of rows, ``known`` as an Arrow table, and for each known term of these
    rows, in their order, its row, its place in ``known`` and its count; it gives columns by name.
    What is broadcast is bounded by the size of a vocabulary. Runs a job.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known.toArrow().combine_chunks())

    def run(batches):
        table = shared.value
        names = table.column("term").combine_chunks()
        chosen = np.zeros((2, max(1, SLOTS_PER_FEATURE * len(names))), bool)
        for own, slots in zip(chosen, slots_of(hashes_of(names), chosen.shape[1])):
            own[slots] = True
        for batch in batches:
            for part, row, term, n in held(batch, (chosen, None) if kept_as_words(batch) else None):
                place = places(term, names)
                hit = place >= 0
                yield pa.RecordBatch.from_pydict(body(part, table, row[hit], place[hit], n.to_numpy(zero_copy_only=False)[hit]))

    return rows.select(*columns, "terms").mapInArrow(run, schema)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def bucketed_docs(
    docs: DataFrame, buckets: int, keep: Sequence[str] = (), key: str = "doc_id", text: str = "text", ngram_range=NGRAMS
) -> DataFrame:
    """The same table laid out by key in ``buckets`` buckets, one file each. Runs a job.

    The counted texts are shuffled once, while they are written; training rows, weights and scores
    made from them afterwards group by key where the rows lie. That pays from the second use on.
    A bucket is one task: choose as many as keep a bucket of counted texts within a task's memory.
    """
    return materialize_bucketed(word_rows(docs, keep, key, text, ngram_range), "words", key, buckets)


def listed_terms(counted: DataFrame, key: str = "doc_id", keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """The same rows as ``doc_terms`` from a table of counted texts."""
    inline = F.inline_outer if outer else F.inline
    return counted.select(key, *keep, inline("terms"))


def term_stats(terms: DataFrame) -> DataFrame:
    """``term, tf, df``: occurrences in the corpus and documents holding the term."""
    return terms.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def top_terms(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms, ties by term, with ``idx`` in term order.

    A first look at how many terms share each frequency gives the lowest frequency that can
    make it, so that the final sort only sees the winners and the ties at the border. Both
    windows, in one task each, hold at most ``max_features`` rows: the parameter is their bound. ``stats`` is read twice: write it first.
    """
    levels = stats.groupBy("tf").agg(F.count("*").alias("_n")).orderBy(F.desc("tf")).limit(max_features)
    running = F.sum("_n").over(Window.orderBy(F.desc("tf")))
    border = (
        levels.withColumn("_upto", running)
        .agg(F.coalesce(F.max(F.when(F.col("_upto") >= max_features, F.col("tf"))), F.lit(0)).alias("tf"))
        .scalar()
    )
    kept = stats.filter(F.col("tf") >= border).orderBy(F.desc("tf"), "term").limit(max_features)
    return kept.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def idf(df: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def vocabulary(counted: DataFrame, max_features: int = MAX_FEATURES, key: str = "doc_id") -> DataFrame:
    """``term, idx, tf, df, idf`` of the most frequent n-grams; every text counts as a document.

    Runs jobs. Written once, so that joining it later is a broadcast whenever it is small enough.
    """
    return _weighted(winning_stats(counted, max_features), counted, max_features)


def _weighted(stats: DataFrame, counted: DataFrame, max_features: int) -> DataFrame:
    n_docs = counted.select(F.count("*")).scalar()
    return materialize(
        top_terms(stats, max_features).withColumn("idf", idf(F.col("df"), n_docs)), "vocabulary"
    )


def frequent_stats(
    counted: DataFrame, max_features: int = MAX_FEATURES, key: str = "doc_id", slots: int | None = None, tasks: int | None = None
) -> DataFrame:
    """``term, tf, df`` of a superset of the ``max_features`` most frequent terms, without counting the rest.

    Every term belongs to one of ``slots`` slots by its hash, and occurrences are first summed per
    slot: no term is more frequent than its slot. The terms of the ``max_features`` fullest slots are
    counted exactly; the last of the ``max_features`` most frequent among them is a frequency that
    the whole vocabulary's border cannot lie below. Terms of slots below it are never shuffled, those
    of all other slots are counted too. All counts returned are exact, whatever the number of slots
    (``SLOTS_PER_FEATURE`` for each term wanted if not given); fewer slots only prune less. Ties at
    the border are all returned.

    Runs jobs and reads the counted texts three times, but a task holds and hands on at most ``slots``
    sums, then the terms that can still win. As that does not grow with what a task reads, the texts
    are read by ``tasks`` tasks (if there are more splits; ``spark.sql.shuffle.partitions`` if not
    given), so the shuffled rows do not grow with the splits. What is broadcast is at most ``slots``
    numbers.
    """
    slots = slots or SLOTS_PER_FEATURE * max_features
    tasks = tasks or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("term"), F.lit(slots)).alias("slot")
    terms = listed_terms(counted.coalesce(tasks), key).select(slot, "term", "n")
    sums = materialize(terms.groupBy("slot").agg(F.sum("n").alias("total")), "slots")
    # Written: both the first count and its complement must see the same slots.
    fullest = materialize(sums.orderBy(F.desc("total"), "slot").limit(max_features), "fullest-slots")

    def count(chosen: DataFrame, name: str) -> DataFrame:
        return materialize(term_stats(terms.join(F.broadcast(chosen.select("slot")), "slot")), name)

    first = count(fullest, "first-terms")
    border = top_terms(first, max_features).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    least = border["tf"] if border["n"] >= max_features else 0
    others = sums.filter(F.col("total") >= least).join(F.broadcast(fullest.select("slot")), "slot", "left_anti")
    return first.unionByName(count(others, "other-terms"))


def frequent_vocabulary(
    counted: DataFrame, max_features: int = MAX_FEATURES, key: str = "doc_id", slots: int | None = None, tasks: int | None = None
) -> DataFrame:
    """The same table as ``vocabulary``, for corpora with many more distinct terms than it holds. Runs jobs."""
    return _weighted(frequent_stats(counted, max_features, key, slots, tasks), counted, max_features)


def raw_weight(n: Column, idf_: Column) -> Column:
    """Sublinear term frequency times inverse document frequency."""
    return (1 + F.log(n)) * idf_


def _in_order(row: np.ndarray, idx: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of the entries by row, then term number, then value."""
    entry = (row.astype(np.int64) << 32) + idx
    order = np.argsort(entry)
    entry = entry[order]
    # A text that became one of several may list a term more than once.
    return np.lexsort((w, idx, row)) if (entry[1:] == entry[:-1]).any() else order


def _unit_entries(part: pa.RecordBatch, table: pa.Table, row: np.ndarray, place: np.ndarray, n: np.ndarray):
    """Row, place in the vocabulary, term number and unit-length weight of every entry, in order."""
    idx, w = numbers(table, "idx")[place], (1 + np.log(n)) * numbers(table, "idf")[place]
    order = _in_order(row, idx, w)
    row, place, idx, w = row[order], place[order], idx[order], w[order]
    norm = np.sqrt(np.bincount(row, np.square(w), part.num_rows))
    return row, place, idx, w / norm[row]


def as_lists(row: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values of each row, which lie one after the other, as a list column."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def tfidf(counted: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, term, idx, weight`` with unit length per document; unknown terms are ignored. Runs jobs."""

    def body(part, table, row, place, n):
        row, place, idx, weight = _unit_entries(part, table, row, place, n)
        return {
            key: part.column(key).take(pa.array(row)), "term": table.column("term").combine_chunks().take(pa.array(place)),
            "idx": pa.array(idx, pa.int32()), "weight": pa.array(weight),
        }

    schema = f"{schema_of(counted, [key])}, term string, idx int, weight double"
    return looked_up(one_per_key(counted, (), key), [key], vocab.select("term", "idx", "idf"), body, schema)


def sparse_rows(counted: DataFrame, vocab: DataFrame, keep: Sequence[str] = (), key: str = "doc_id") -> DataFrame:
    """``key, keep..., indices, values``: one unit-length sparse row per text.

    A text without known terms gives an empty row. Every text is made where it lies; only those that
    share a key are shuffled. Runs jobs.
    """
    columns = [key, *keep]

    def body(part, table, row, place, n):
        row, _, idx, weight = _unit_entries(part, table, row, place, n)
        lists = {"indices": as_lists(row, part.num_rows, idx, pa.int32()), "values": as_lists(row, part.num_rows, weight, pa.float64())}
        return {c: part.column(c) for c in columns} | lists

    schema = f"{schema_of(counted, columns)}, indices array<int>, values array<double>"
    return looked_up(one_per_key(counted, keep, key), columns, vocab.select("term", "idx", "idf"), body, schema)


def encode(
    docs: DataFrame,
    vocab: DataFrame,
    max_length: int = 128,
    pad: bool = False,
    text: str = "text",
    key: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key, keep..., n_unknown, input_ids, attention_mask`` over a word vocabulary.

    Ids start at 2; 0 pads and 1 stands for an unknown word. Truncation comes before the join,
    so no text sends more than ``max_length`` words.
    """
    words = F.slice(X.tokens(F.col(text)), 1, max_length)
    placed = docs.select(key, *keep, F.posexplode_outer(words).alias("_pos", "term"))
    known = placed.join(vocab.select("term", "idx"), "term", "left")
    word_id = F.coalesce(F.col("idx") + FIRST_ID, F.lit(UNKNOWN_ID))
    entry = F.when(F.col("term").isNotNull(), F.struct("_pos", word_id.alias("id")))
    rows = known.groupBy(key, *keep).agg(
        F.count_if(F.col("term").isNotNull() & F.col("idx").isNull()).alias("n_unknown"),
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["id"]).alias("_ids"),
    )
    ids, mask = X.truncate_ids(F.col("_ids"), max_length, PAD_ID if pad else None)
    return rows.select(key, *keep, "n_unknown", ids.alias("input_ids"), mask.alias("attention_mask"))


def term_origin(
    docs: DataFrame,
    train_sets: Mapping[str, Sequence[str]],
    max_features: int = MAX_FEATURES,
    by: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    ngram_range=NGRAMS,
) -> DataFrame:
    """``train_set, term_<by>, n_terms``: vocabulary terms by the group where each is most frequent.

    Every named training set is a list of groups and gets a vocabulary of its own. The texts of these
    groups are cleaned and written once; the terms that can make any set's vocabulary are counted once,
    and all sets find their border frequency and their terms side by side. Runs jobs.
    """
    groups = sorted({g for own in train_sets.values() for g in own})
    words = word_docs(docs.filter(F.col(by).isin(groups)), [by], key, text, ngram_range)
    per_set = winning_set_stats(words, train_sets, max_features, by)
    home = F.min_by(by, F.struct(-F.col("tf"), F.col(by))).alias(f"term_{by}")
    stats = per_set.groupBy("train_set", "term").agg(F.sum("tf").alias("tf"), home)
    stats = materialize(stats, "set-terms")
    # The lowest frequency that can make a set's vocabulary; windows see one row per set and frequency.
    levels = stats.groupBy("train_set", "tf").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("train_set").orderBy(F.desc("tf")))
    border = levels.withColumn("_upto", upto).groupBy("train_set").agg(
        F.coalesce(F.max(F.when(F.col("_upto") >= max_features, F.col("tf"))), F.lit(0)).alias("_border")
    )
    kept = stats.join(F.broadcast(border), "train_set").filter(F.col("tf") >= F.col("_border"))
    place = F.row_number().over(Window.partitionBy("train_set").orderBy(F.desc("tf"), "term"))
    kept = kept.withColumn("_place", place).filter(F.col("_place") <= max_features)
    return kept.groupBy("train_set", f"term_{by}").agg(F.count("*").alias("n_terms"))
