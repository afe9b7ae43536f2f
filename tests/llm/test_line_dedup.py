import random

from pyspark.sql import functions as F

from fixtures import ODD, changed, documents, prose, words
from lexmill.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts, least):
    firsts, out = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            if w and any(w == f or (min(len(w), len(f)) >= least and distance(w, f) <= 1) for f in firsts):
                pass
            else:
                kept.append(line)
            if w and w not in firsts:
                firsts.append(w)
        n = len((text or "").split("\n"))
        out.append((None, 0, 0) if text is None else ("\n".join(kept), n, n - len(kept)))
    return out


def noisy():
    draw = random.Random(3)
    texts, lines = [], [prose(k, draw.choice([3, 7, 8, 9, 12]), 40) for k in range(12)]
    for k in range(60):
        own = []
        for _ in range(draw.randrange(1, 5)):
            w = list(draw.choice(lines))
            kind = draw.randrange(5)
            at = draw.randrange(len(w))
            if kind == 1:
                w[at] = draw.choice(["p", "q"])
            elif kind == 2:
                del w[at]
            elif kind == 3:
                w.insert(at, draw.choice(["p", "q"]))
            elif kind == 4:
                w = changed(w, set(draw.sample(range(len(w)), 2)), "z")
            own.append(" ".join(w))
        texts.append("\n".join(own))
    return texts + ["r r r r r r r r r\nr r r r r r r r\nr r r r s r r r r", "r r r r r r r r r r"] + ODD


def test_lines_equal_brute_force(spark):
    texts = noisy()
    got = {r["doc_id"]: r for r in L.deduped(documents(spark, texts)).collect()}
    expected = brute(texts, 8)
    for i in range(len(texts)):
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == expected[i]


def test_lines_do_not_depend_on_the_order_of_rows(spark):
    # An equal line with a larger doc_id before the smallest one, in the same chunk, hid the line's variants.
    texts = noisy()
    expected = brute(texts, 8)
    for order in (F.desc("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary"))):
        docs = documents(spark, texts).coalesce(1).sortWithinPartitions(order)
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in L.deduped(docs).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_documents_that_lose_all_words_go(spark):
    docs = documents(spark, ["a b\nc", "c\na b", "c\nnew", "", None, " \n"])
    left = L.drop_lines(docs)
    assert left.columns == docs.columns and left.filter("key = doc_id").count() == 5
    assert L.drop_lines(docs.withColumn("doc_id", F.expr("if(key = 0, null, doc_id)"))).filter("doc_id IS NULL").head()["text"] == "a b\nc"
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(0, "a b\nc"), (2, "new"), (3, ""), (4, None), (5, " \n")]


def test_empty_table(spark):
    assert L.deduped(documents(spark, [])).count() == 0


def test_many_lines_with_one_variant(spark):
    base = prose(1, 10)
    docs = documents(spark, [" ".join(changed(base, {4}, f"v{k}")) for k in range(300)])
    kept = [r["doc_id"] for r in L.deduped(docs).filter("n_dropped = 0").collect()]
    assert kept == [0]
