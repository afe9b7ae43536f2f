import random

from fixtures import DOCS, ODD, changed, documents, prose, words
from lexmill.llm import near_dedup as N
from lexmill.llm.common import Members, components


def sets_of(texts, k=5):
    out = []
    for text in texts:
        w = words(text)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, percent):
    sets = sets_of(texts)
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def crowd():
    """Copies, chains, a crowd around one text, and texts whose only link leads to one of the crowd."""
    draw = random.Random(5)
    texts = list(ODD)
    for group in range(6):
        base = prose(group, 120)
        texts += [" ".join(base)] * 3
        for k in range(5):
            base = changed(base, {draw.randrange(120)}, f"x{group}.{k}")
            texts.append(" ".join(base).upper())
    base = prose(99, 90)
    for k in range(60):
        texts.append(" ".join(changed(base, draw.sample(range(90), draw.randrange(3)), f"y{k}")))
    return texts + [" ".join(prose(1000 + k, 40)) for k in range(30)]


def test_components_equal_brute_force(spark):
    texts = crowd()
    for percent in (85, 80):
        got = N.near_duplicates(documents(spark, texts), N.Forest(percent=percent)).collect()
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
        assert [found[i] for i in range(len(texts))] == brute(texts, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def passage(pairs, start=0):
    """Unlike texts that share a passage, in pairs that are alike."""
    draw, shared, texts = random.Random(11 + start), prose(7, 180), []
    for k in range(pairs):
        own = [f"o{start}.{k}.{i}" for i in range(20)]
        texts += [" ".join(shared + own), " ".join(changed(shared, {draw.randrange(20, 160)}, f"c{start}.{k}") + changed(own, {9}, f"d{k}"))]
    draw.shuffle(texts)
    return texts


def test_crowd_cut_over_many_tasks_equals_brute_force(spark):
    texts = passage(250)
    expected = [r for _, r in brute(texts, 85)]
    assert len(set(expected)) == 250
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(documents(spark, texts)).collect()}
            assert [found[i] for i in range(len(texts))] == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def star():
    """Two families below one passage: unlike texts with the smaller ids, and texts that are linked to their first one only."""
    draw, shared = random.Random(23), prose(8, 135, 4000)
    texts = [" ".join(shared + [f"u{k}.{i}" for i in range(65)]) for k in range(40)]
    hub = shared + [f"h{i}" for i in range(65)]
    texts.append(" ".join(hub))
    for k in range(40):
        places = draw.sample(range(5, 195, 10), 3)
        texts.append(" ".join(changed(hub, places, f"s{k}")))
    return texts


def test_dense_regions_find_links_the_forest_did_not_propose(spark, monkeypatch):
    # All of them lead to the hub 40, the smallest of its family and not the smallest below the passage.
    texts = star()
    expected = [r for _, r in brute(texts, 85)]
    assert expected == [*range(40)] + [40] * 41
    real = N.candidates

    def none_proposed(classes, forest):
        found, dense = real(classes, forest)
        return found.filter("false"), dense

    monkeypatch.setattr(N, "candidates", none_proposed)
    found = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == expected


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = documents(spark, ["a b c d e f"] * 4 + ["other words", None, ""])
    kept = N.keep_one(docs.unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "x", 1, 1, None)], DOCS)))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 0), (False, 4), (False, 5), (False, 6), (True, None)]


def test_empty_table(spark):
    assert N.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id + 1 AS a", "id AS b").unionByName(spark.createDataFrame([(500, 400), (400, 500), (7, 7)], "a long, b long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}


def test_membership_misses_no_key(spark):
    import numpy as np

    frame = spark.range(3000).selectExpr("xxhash64(id) AS h")
    keys = np.array([r[0] for r in frame.collect()])
    for bits in (1 << 12, 1 << 24):
        members = Members.of(frame, "h", bits)
        assert members(keys, bits).all()
    others = np.array([r[0] for r in spark.range(5000, 8000).selectExpr("xxhash64(id) AS h").collect()])
    assert members(others, bits).mean() < 0.01
