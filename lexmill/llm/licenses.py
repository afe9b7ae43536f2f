"""License scans by a positional index of rare licence words.

Words are runs of letters and digits, A-Z lower-cased. A template is a wording of a licence with a
mandatory key phrase; the base phrases are templates that are all key. How rare a licence word is
comes from the corpus: one pass counts in how many files each stands. The ``ANCHORS`` rarest words of
every key phrase form the index, word -> (template, place in it). A file's words are looked up there;
every hit says where the template would begin, and a begin on which all anchors of a template agree
is a candidate. There the key phrase must stand word for word; the share of the template's words that
stand in their places around it is the match's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import map_arrow, texts

ANCHORS = 2

# Phrases every scan reports, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wordings of licences with their mandatory phrases, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0", "apache license", "apache"),
    ("you may not use this file except in compliance with the license", "except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version 3", "general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software", "isc"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    label: str
    base: bool


def template(text: str, key: str, label: str, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(words, at, phrase, label, base)


def known_templates() -> list[Template]:
    return [template(p, p, label, True) for p, label in BASE] + [template(*t) for t in TEMPLATES]


def fingerprint(words: list[str]) -> np.ndarray:
    flat = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in flat])]).astype(np.int64)
    return K.span_hash(np.frombuffer(b"".join(flat), np.uint8), offsets[:-1], offsets[1:])


class Lookup:
    """A few words by fingerprint: the number of each word of a chunk that is one of them."""

    def __init__(self, words: list[str]):
        hashes = fingerprint(words)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hits = np.flatnonzero(self.sorted[at] == hashes)
        return hits, self.number[at[hits]]


def file_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts each of the words stands; the driver gets one number for each word. Runs a job."""
    lookup = Lookup(words)

    def step(batch):
        for _, data, offsets in K.chunks(batch.column("text")):
            spans = K.words(data, offsets, K.NOT_ALNUM)
            hits, number = lookup(spans.hash)
            owner = np.searchsorted(spans.of, hits, "right") - 1
            pairs = np.unique(owner * len(words) + number)
            value, count = np.unique(pairs % len(words), return_counts=True)
            yield {"word": value, "n": count}

    rows = map_arrow(texts(docs), step, "word long, n long", "text").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {words[r["word"]]: r["n"] for r in rows}
    return {w: found.get(w, 0) for w in words}


def anchors(templates: list[Template], counts: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Each template's rarest key words with their place in the template; of equally rare ones the first."""
    out = []
    for t in templates:
        places = {}
        for j, word in enumerate(t.key):
            places.setdefault(word, t.key_at + j)
        out.append(sorted(sorted(places.items(), key=lambda x: x[1]), key=lambda x: counts[x[0]])[:ANCHORS])
    return out


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, matches) of every text. Runs a job.

    ``matches`` are (label, base, word, share): a template's label, whether it is a base phrase, the
    number of the word where its key phrase begins, and the share of its words in their places, by
    word, label and share. ``docs`` has doc_id and text; other columns are not read. Null and empty
    texts have no words and no matches; rows without doc_id are left out; repeated rows are scanned
    alike. An empty table gives no rows.
    """
    templates = templates or known_templates()
    counts = file_counts(docs, sorted({w for t in templates for w in t.key}))
    index = anchors(templates, counts)
    words = sorted({w for own in index for w, _ in own})
    lookup = Lookup(words)
    prepared = [(t, [(words.index(w), at) for w, at in own], fingerprint(list(t.words))) for t, own in zip(templates, index)]
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64()), ("share", pa.float64())]))

    def step(batch):
        ids = batch.column("doc_id").to_numpy()
        for first, data, offsets in K.chunks(batch.column("text")):
            spans = K.words(data, offsets, K.NOT_ALNUM)
            hits, number = lookup(spans.hash)
            n, size = len(offsets) - 1, len(spans.hash)
            found = [[] for _ in range(n)]
            owner = spans.owner()
            for t, own, hashes in prepared:
                begins = None
                for word, at in own:
                    places = hits[number == word] - at
                    begins = places if begins is None else np.intersect1d(begins, places)
                low, high = begins + t.key_at, begins + t.key_at + len(t.key) - 1
                begins = begins[(low >= 0) & (high < size)]
                begins = begins[owner[begins + t.key_at] == owner[begins + t.key_at + len(t.key) - 1]]
                for j in range(len(t.key)):
                    begins = begins[spans.hash[begins + t.key_at + j] == hashes[t.key_at + j]]
                if not len(begins):
                    continue
                of = owner[begins + t.key_at]
                share = np.zeros(len(begins))
                for j in range(len(t.words)):
                    at = begins + j
                    inside = (at >= spans.of[of]) & (at < spans.of[of + 1])
                    share += inside & (spans.hash[np.clip(at, 0, size - 1)] == hashes[j])
                for d, b, s in zip(of, begins, share / len(t.words)):
                    found[d].append({"label": t.label, "base": t.base, "word": int(b + t.key_at - spans.of[d]), "share": float(s)})
            for own in found:
                own.sort(key=lambda m: (m["word"], m["label"], m["base"], m["share"]))
            yield {"doc_id": ids[first : first + n], "n_words": np.diff(spans.of), "matches": pa.array(found, kind)}

    schema = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,word:long,share:double>>"
    return map_arrow(texts(docs), step, schema, "doc_id", "text")
