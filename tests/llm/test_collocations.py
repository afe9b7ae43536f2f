import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import LOWER, ODD

from lexmill.llm import collocations as C
from lexmill.llm.kernel import U64

DOCS = "doc_id BIGINT, text STRING, lang STRING, phrase STRING, n INT, id INT, total INT"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 1, 1) for i, (t, lang) in enumerate(rows)], DOCS)


def brute(rows, mining):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, mining.max_words + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= mining.least}
        rows = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= mining.share * a and inside(q) for q, b in often.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[: mining.top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def text_rows(seed, n=150):
    draw = random.Random(seed)
    fixed = ["new york city", "New York", "hot  dog", "ça va", "a a a a", "to be or", "x"]
    rows = []
    for i in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else draw.choice("the of and to in on at by é ü".split()) for _ in range(draw.randrange(60))]
        text = "".join(p + draw.choice([" ", " ", " ", "\t", ". ", ",", "\n", "!", " \x0b"]) for p in parts)
        rows.append((text, draw.choice(["en", "en", "en", "de", None])))
    return rows + [(t, "en") for t in ODD if t is None or len(t) < 1000] + [("word " * 3000, "xx"), ("the the the", ""), (None, None)]


@pytest.mark.parametrize("mining", [C.Mining(), C.Mining(top=7), C.Mining(max_words=4, least=5, share=80), C.Mining(max_words=2, hot=16)])
def test_collocations_equal_brute_force(spark, mining):
    rows = text_rows(mining.max_words)
    got = C.collocations(documents(spark, rows).repartition(5), mining)
    assert sorted(map(tuple, got.collect())) == brute(rows, mining)


def test_small_parts_give_the_same(spark):
    """Stripes split by the next word, handed on often and cut into short rows."""
    rows = text_rows(9)
    mining = C.Mining(hot=40, held=500, row=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = sorted(map(tuple, C.collocations(documents(spark, rows).repartition(9), mining).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, mining)


def test_stripe_rows_hold_every_place():
    random = np.random.default_rng(1)
    prefix, follow = random.integers(0, 6, (4000, 2)).astype(U64), random.integers(0, 900, 4000).astype(U64)
    known = random.random(4000) < 0.7
    heat = {int(C.phrase_key(np.array([[1, 1]], U64))[0]): 4}
    table = C.stripe_rows(prefix, follow, known, heat).to_pydict()
    found = Counter()
    for p, part, nexts, n, rest in zip(*[table[c] for c in ("prefix", "part", "next", "n", "rest")]):
        own = tuple(np.frombuffer(p, ">u8").tolist())
        assert len(nexts) == len(n) <= 512 and (part == 0 or own == (1, 1))
        found[own, None] += rest
        for x, m in zip(nexts, n):
            found[own, x] += m
    expected = Counter((tuple(p), int(f) if k else None) for p, f, k in zip(prefix.tolist(), follow, known))
    assert +found == expected


def test_no_rows(spark):
    assert C.collocations(documents(spark, [])).count() == 0
    assert C.collocations(documents(spark, [(None, None), ("", "en"), ("one", "en")])).count() == 0
    assert C.collocations(documents(spark, [("a b. " * 10, "en")])).collect()[0].asDict() == dict(lang="en", rank=1, phrase="a b", a=10, l=10, r=10, n=20, score=1000000)


def test_words_of_one_fingerprint_are_noticed(spark):
    found = [(1, 2, "en", "a"), (1, 3, "en", "a"), (2, 1, "en", "b")]
    schema = "id BIGINT, n BIGINT, lang STRING, word STRING"
    assert sorted(map(tuple, C.merged_words(spark.createDataFrame(found, schema)).collect())) == [(1, 5, "en", "a"), (2, 1, "en", "b")]
    for other in ((2, 1, "en", "c"), (1, 1, "de", "a")):
        with pytest.raises(RuntimeError, match="fingerprint"):
            C.merged_words(spark.createDataFrame([*found, other], schema))
