from fixtures import ALNUM, ODD, documents, words
from lexmill.llm import licenses as C, url_rules as U

RULES = (("allow", "org", "/"), ("block", "a.org", "/x"))


def brute_scan(text):
    w = words(text, ALNUM)
    out = []
    for t in C.known_templates():
        for i in range(len(w) - len(t.key) + 1):
            if tuple(w[i : i + len(t.key)]) == t.key:
                begin = i - t.key_at
                fits = sum(0 <= begin + j < len(w) and w[begin + j] == x for j, x in enumerate(t.words))
                out.append((i, t.label, t.base, fits / len(t.words)))
    return len(w), sorted(out)


def test_scan_equals_brute_force(spark):
    texts = [
        "Released under the MIT License. MIT license",
        "license mit License",
        "the Apache\nLicense, version 2.0 and GNU General Public License",
        "Licensed under CC BY-NC 4.0. All rights reserved. all rights, reserved",
        "mit",
        "apache license",
        "lesser general public license general public license " * 500,
        "Permission is hereby granted, free of charge, to any person",
        "mitlicense mit-license MIT  LICENSE",
    ] + ODD
    docs = documents(spark, texts + texts)
    got = {r["doc_id"]: r for r in C.scan(docs).collect()}
    for i, text in enumerate(texts + texts):
        n, expected = brute_scan(text)
        assert got[i]["n_words"] == n
        assert [(m["word"], m["label"], m["base"], m["share"]) for m in got[i]["matches"]] == expected
    assert C.scan(documents(spark, [])).count() == 0


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "t", "x") for i, u in enumerate(urls)], "page_id BIGINT, url STRING, tokens STRING, verdict STRING")


def test_listed_rules_and_parts(spark):
    urls = [
        "https://Sub.A.org/x/1?q=1#f",
        "http://a.org/y",
        "http://a.org",
        "http://ba.org/x",
        "http://org/x://y",
        None,
        "",
        "no address",
        "x://?a/b",
        "http://é.com/a?b",
        "http://a.org/x" + "y" * 100000,
    ]
    got = {r["page_id"]: r for r in U.judge(pages(spark, urls), RULES).collect()}
    assert [(got[i]["host"], got[i]["path"][:10], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("sub.a.org", "/x/1", "a.org/x", "block"),
        ("a.org", "/y", "org/", "allow"),
        ("a.org", "", None, "allow"),
        ("ba.org", "/x", "org/", "allow"),
        ("org", "/x://y", "org/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("é.com", "/a", None, "allow"),
        ("a.org", "/xyyyyyyyy", "a.org/x", "block"),
    ]


def test_mined_rules_judge_the_rest(spark):
    urls = [f"http://a.org/x/{i}?ad=1" for i in range(30)] + [f"http://b.org/news/{i}" for i in range(30)]
    urls += ["http://c.net/p?ad=2", "http://c.net/news/1"]
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages(spark, urls), RULES).collect()}
    assert got[60] == "block" and got[61] == "allow"
    assert U.judge(pages(spark, urls).limit(0), RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rows = [(i, [f"t{j}" for j in range(6) if (i >> j) & 1] + ["all"], bool((i & 3) == 3 or i % 17 == 0)) for i in range(64)]
    frame = spark.createDataFrame(rows, "page_id BIGINT, tokens ARRAY<STRING>, block BOOLEAN")
    mining = U.Mining(min_support=0.05, min_confidence=0.8)
    got = {tuple(r["tokens"]): round(r["confidence"], 9) for r in U.mined_rules(frame, mining).collect()}
    expected = {}
    for k in (1, 2, 3):
        for x in combinations(sorted({t for r in rows for t in r[1]}), k):
            own = [r[2] for r in rows if set(x) <= set(r[1])]
            if own and sum(own) >= 0.05 * 64 and sum(own) >= 0.8 * len(own):
                expected[x] = round(sum(own) / len(own), 9)
    assert got == expected and got
