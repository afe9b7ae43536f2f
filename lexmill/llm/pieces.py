"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

A text becomes marked words: a blank is put before it, blanks turn into the mark U+2581, and the text
is cut before each run of marks. No piece of the vocabulary has a mark after another character, so no
piece reaches over such a cut, and words are encoded by themselves.

The distinct marked words of a chunk are sorted, which is a depth-first walk of their trie: every word
goes on from the forward states at the end of the prefix it shares with the word before. The state at
a place is the best way to write the prefix up to it: its score, its last piece and where that begins.

The vocabulary is of the BPE kind, whose encoding is not the cheapest path but the outcome of merging
the best pair again and again. Which pieces may follow each other is then a matter of pairs alone: a
sequence of pieces is the outcome of merging exactly if every two neighbours, written together, are
merged into just these two. So a transition from piece a to piece b is open if merging their joint
text gives (a, b), and closed otherwise. Exactly one path is open for every prefix, which makes the
forward pass exact. For a vocabulary of the unigram kind every transition is open, and scores decide.

Characters without a piece are written as the pieces of their UTF-8 bytes, or as the unknown piece.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import map_arrow

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CHUNK_CHARS = 1 << 21
REMEMBERED = 1 << 19
PAIRS = 1 << 19


class Vocabulary:
    """Pieces of a SentencePiece model, and the encoder over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        byte_of = {i: int(self.texts[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in byte_of.items()}
        self.unknown = model.unk_id()
        # What every piece decodes to: control pieces to nothing.
        self.raw = [bytes([byte_of[i]]) if i in byte_of else b"" if model.is_control(i) else t.encode() for i, t in enumerate(self.texts)]
        self.raw[self.unknown] = " \u2047 ".encode()
        self.number = {self.texts[i]: i for i in range(size) if i not in special}
        self.score = {i: model.get_score(i) for i in self.number.values()}
        # BPE scores are the ranks of merges: whole numbers, none above 0.
        whole = [x for x in self.score.values() if x > -1e8]
        self.merges = bool(whole) and all(x <= 0 and x == int(x) for x in whole)
        # Characters that stand in pieces without being one: merging may still join them.
        self.loose = {c for text in self.number for c in text} - set(self.number)
        # The trie of the pieces: a node is (children, number of the piece that ends here or -1).
        self.root: dict = {}
        for text, number in self.number.items():
            children = self.root
            for c in text[:-1]:
                children = children.setdefault(c, [{}, -1])[0]
            children.setdefault(text[-1], [{}, -1])[1] = number
        self.opened: dict[int, bool] = {}

    # Merging ------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Repeatedly joins the neighbours whose joint piece has the best score, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.number.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.score[number] > best):
                    best, at = self.score[number], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_open(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces as they are; a bounded number of pairs is remembered."""
        key = left * len(self.texts) + right
        known = self.opened.get(key)
        if known is None:
            if len(self.opened) >= PAIRS:
                self.opened.clear()
            known = self.opened[key] = self.texts_open(self.texts[left], self.texts[right])
        return known

    def texts_open(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    # Shared-prefix Viterbi ------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The pieces of each distinct marked word, as the bytes of 32-bit numbers."""
        out: dict[str, bytes] = {}
        root, score, merges, loose, opened, size = self.root, self.score, self.merges, self.loose, self.opened, len(self.texts)
        # Forward states of the first i characters: score, last piece (-1: a character that is none),
        # its start, and the pieces begun before and not ended, as (start, children in the trie).
        total, last, begin, going = [0.0], [-2], [0], [[]]
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            keep = shared + 1
            del total[keep:], last[keep:], begin[keep:], going[keep:]
            for place in range(shared, len(word)):
                c = word[place]
                best, found, since, alive = None, -1, place, []
                for start, children in (*going[place], (place, root)):
                    node = children.get(c)
                    if node is None:
                        continue
                    children, piece = node
                    if children:
                        alive.append((start, children))
                    if piece < 0:
                        continue
                    if merges:
                        # The one open transition; longer pieces are tried first.
                        if best is None:
                            left = last[start]
                            if left >= 0:
                                fits = opened.get(left * size + piece)
                                if fits is None:
                                    fits = self.pair_open(left, piece)
                            else:
                                fits = left == -2 or word[start - 1] not in loose or self.texts_open(word[start - 1], word[start : place + 1])
                            if fits:
                                best, found, since = 0.0, piece, start
                    else:
                        reach = total[start] + score[piece]
                        if best is None or reach > best:
                            best, found, since = reach, piece, start
                total.append(total[place] - 1e9 if best is None else best)
                last.append(found)
                begin.append(since)
                going.append(alive)
            ids: list[int] = []
            end = len(word)
            while end:
                if last[end] >= 0:
                    ids.append(last[end])
                else:
                    ids.extend(reversed(self.piece_ids(word[begin[end] : end])))
                end = begin[end]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            before = word
        return out

    def piece_ids(self, piece: str) -> list[int]:
        number = self.number.get(piece)
        if number is not None:
            return [number]
        raw = piece.encode("utf-8", "replace")
        return [self.of_byte[b] for b in raw] if self.of_byte else [self.unknown]

    # Texts ----------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of a list of ids: pieces and bytes joined, marks as blanks, the first blank dropped."""
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes chunks of texts in one Python worker; words met before are remembered, a bounded number."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = {w for words in split for w in words}
        self.known.update(self.vocabulary.encode_words(list(fresh)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in split]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def shipped(spark: SparkSession, path: str) -> str:
    """Make a model file of the driver known to all executors; gives the name they find it under."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every text; ``round_trip`` tells if the ids decode to it.

    ``docs`` has doc_id and text; other columns are not read. A null or empty text has no ids; rows
    without doc_id are left out; repeated rows are encoded alike; an empty table gives no rows. Texts
    are encoded whole. The result is that of the library whose model this is, without the model's
    control pieces and for a model that normalises nothing. Only a text with the mark itself in it
    decodes to another one.
    """
    name = shipped(docs.sparkSession, model_path)

    def step(batch):
        own = encoder(SparkFiles.get(name))
        ids, texts = batch.column("doc_id"), batch.column("text")
        for first, count in text_runs(texts):
            rows = [t or "" for t in texts.slice(first, count).to_pylist()]
            lists = own.encode(rows)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield {
                "doc_id": ids.slice(first, count),
                "n_ids": np.diff(offsets).astype(np.int64),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                "round_trip": pa.array([own.vocabulary.decode(x) == t for x, t in zip(lists, rows)], pa.bool_()),
            }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return map_arrow(rows, step, "doc_id long, n_ids long, ids array<int>, round_trip boolean", "doc_id", "text")


def text_runs(texts: pa.Array):
    """(first row, number of rows) of runs of whole texts of about ``CHUNK_CHARS`` bytes."""
    for first, _, offsets in K.chunks(texts, CHUNK_CHARS):
        yield first, len(offsets) - 1


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    name = shipped(encoded.sparkSession, model_path)

    def step(batch):
        own = vocabulary(SparkFiles.get(name))
        texts = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column("ids")]
        yield {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return map_arrow(encoded, step, "doc_id long, text string", "doc_id", "ids")
