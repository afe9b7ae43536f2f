import random

import numpy as np

from fixtures import ALNUM, ODD, documents, prose, words
from lexmill.llm import decontaminate as D


def brute(doc, item, least):
    """Greedy string tiling by looking at all places again for each tile."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for p in range(len(doc)):
            for a in range(len(item)):
                n = 0
                while p + n < len(doc) and a + n < len(item) and doc[p + n] == item[a + n] and p + n not in marked_d and a + n not in marked_i:
                    n += 1
                if n >= least and (best is None or (-n, p, a) < best):
                    best = (-n, p, a)
        if best is None:
            return out
        n, p, a = -best[0], best[1], best[2]
        marked_d |= set(range(p, p + n))
        marked_i |= set(range(a, a + n))
        out.append((p, a, n))


def test_tiles_equal_brute_force():
    draw = random.Random(2)
    for _ in range(300):
        doc = [draw.choice("abc") for _ in range(draw.randrange(1, 25))]
        item = [draw.choice("abc") for _ in range(draw.randrange(1, 12))]
        seeds = [(p, a) for p in range(len(doc) - 2) for a in range(len(item) - 2) if doc[p : p + 3] == item[a : a + 3]]
        if seeds:
            places, ats = (np.array(x) for x in zip(*seeds))
            assert D.tiles(places, ats, 3) == brute(doc, item, 3)


def test_reordered_and_changed_passages_are_caught(spark):
    item = prose(7, 40, 10**6)
    text = lambda *parts: " ".join(prose(8, 30, 10**6) + [w for p in parts for w in p] + prose(9, 30, 10**6))
    texts = [
        text(item),
        text(item[20:], item[:20]),
        text(item[:12], ["new"], item[13:]),
        text(item[:15]),
        text(item).upper(),
        text(item[::-1]),
        *ODD,
    ]
    bench = spark.createDataFrame([(1, " ".join(item), 5), (2, None, 5), (3, "", 5), (4, "one", 5), (5, " ".join(item), 5)], "item_id BIGINT, text STRING, doc_id INT")
    got = {r["doc_id"]: r for r in D.report(documents(spark, texts), bench).collect()}
    assert len(got) == len(texts)
    assert [got[i]["contaminated"] for i in range(6)] == [True, True, True, False, True, False]
    assert not any(got[i]["contaminated"] for i in range(6, len(texts)))
    assert (got[0]["n_items"], got[0]["coverage"], got[0]["item_id"]) == (2, 1.0, 1)
    found = D.matches(documents(spark, texts), bench).filter("item_id = 1").collect()
    for r in found:
        expected = brute(words(texts[r["doc_id"]], ALNUM), item, 5)
        assert [(t["place"], t["at"], t["length"]) for t in r["tiles"]] == expected
    left = D.drop_contaminated(documents(spark, texts), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, *range(5, len(texts))]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert D.report(documents(spark, ["a b c d e f g"]), bench).filter("contaminated").count() == 0
    assert D.report(documents(spark, []), bench).count() == 0
