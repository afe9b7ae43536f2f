import math
import hashlib

import pytest
from fixtures import ODD, prose, words
from pyspark.sql import functions as F

from lexmill.llm import mixing as M, ordered as O

DOCS = "doc_id BIGINT, text STRING, source STRING, target STRING, place INT, before INT"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, t, s in rows], DOCS)


def brute_targets(sizes, mix):
    """Reshared step by step, as the rule has it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    free, left, out = set(names), sum(sizes.values()), {}
    while free:
        share = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / share > mix.most * sizes[s]]
        if not over:
            return out | {s: weight[s] * left / share for s in free}
        for s in over:
            out[s] = float(mix.most * sizes[s])
            free.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def brute_key(doc_id, text, seed):
    digest = hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}".encode()).hexdigest()
    u = (int(digest[:13], 16) + 0.5) / 2.0**52
    chars = [c for c in text or "" if c not in " \t\n\x0b\x0c\r"]
    letters = [c for c in chars if c.isascii() and c.isalpha() or not c.isascii()]
    return -math.log(u) / ((len(letters) + 1) / (len(chars) + 1))


def brute_plan(rows, mix):
    sizes, out = {}, []
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets = brute_targets(sizes, mix)
    for s in sizes:
        own = sorted(((brute_key(i, t, mix.seed), -1 if i is None else i, len(words(t))) for i, t, x in rows if x == s))
        budget = math.floor(targets[s])
        repeats = budget // sizes[s] if sizes[s] else 0
        left = budget - repeats * sizes[s]
        for _, i, n in own:
            extra = min(n, left)
            left -= extra
            out.append((None if i == -1 else i, s, n, sizes[s], round(targets[s], 6), repeats * n + extra))
    return sorted(out, key=repr)


def rows_for_test():
    rows = [(i, " ".join(prose(i, 1 + i % 37)), "big" if i % 3 else f"s{i % 11}") for i in range(300)]
    rows += [(1000 + i, t, "ödd" if i % 2 else None) for i, t in enumerate(ODD)]
    return rows + [(None, "no key at all", "s1"), (5, "the same key again 1 2 3", "s1"), (5, "the same key again 1 2 3", "s1"), (2000, "", "empty"), (2001, "tiny", "zz")]


@pytest.mark.parametrize("mix", [M.Mix(), M.Mix((1, 100), 3, 7), M.Mix((1,), 1)])
def test_plan_equals_brute_force(spark, mix):
    rows = rows_for_test()
    got = M.plan(documents(spark, rows).repartition(5), mix)
    got = sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect()), key=repr)
    assert got == brute_plan(rows, mix)


def test_budgets_are_met_and_no_document_exceeds_the_limit(spark):
    rows = M.plan(documents(spark, rows_for_test())).collect()
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["repeats"] * r["size"] + r["extra"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(taken[r["source"]] == math.floor(r["target"]) for r in rows)


def test_the_mix_holds_the_planned_words(spark):
    rows = [r for r in rows_for_test() if r[0] not in (None, 5)]
    docs = documents(spark, rows)
    plan = M.plan(docs)
    want = {r["doc_id"]: (r["repeats"], r["extra"], r["taken"], r["size"]) for r in plan.collect()}
    texts = {i: t for i, t, _ in rows}
    found = {}
    for r in M.mixed(docs, plan).collect():
        found.setdefault(r["doc_id"], []).append((r["copy"], r["text"]))
    assert {i for i, w in want.items() if w[2]} == set(found)
    for i, copies in found.items():
        repeats, extra, taken, size = want[i]
        assert sorted(c for c, _ in copies) == list(range(1, len(copies) + 1))
        assert sum(len(words(t)) for _, t in copies) == taken
        assert all(texts[i].startswith(t) for _, t in copies) and sum(t == texts[i] for _, t in copies) >= repeats


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, ("word " if i % 2 else "w0123456789 ") * 10, "a" if i < 2000 else "b") for i in range(4000)]
    taken = M.plan(documents(spark, rows), M.Mix((1, 9), 3)).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken"))
    taken = dict(taken.collect())
    assert taken[1] > 2 * taken[0] > 0


def test_partitions_do_not_matter(spark):
    rows = rows_for_test()
    results = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, M.plan(documents(spark, rows).repartition(n)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1]


def test_no_rows(spark):
    assert M.plan(documents(spark, [])).count() == 0
    assert M.plan(documents(spark, [(1, None, None)])).first()["taken"] == 0


def test_running_sums(spark):
    rows = spark.range(5000).selectExpr("id % 3 * 0 + if(id < 4000, 0, id % 3) as g", "id * 7919 % 5000 as k", "id % 11 as v").repartition(7)
    got = {(r["g"], r["k"]): r["before"] for r in O.running(rows, "g", [F.col("k")], "v").collect()}
    sums = {}
    for g, k, v in sorted(map(tuple, rows.collect())):
        assert got[g, k] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
