import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import features as V, linear as M
from lexmill.sources.corpus import write_corpus
from lexmill.sources.workdir import new_path

TEXTS = [
    "good film good cast", "bad film", "good story and good music", "bad plot bad cast bad film", "fine film and fine music",
    "the cast was bad", "such a good good film", "bad", "??", "music and story",
]
LABELS = [1, 0, 1, 0, 1, 0, 1, 0, 1, 1]


def grams(text):
    words = re.findall(r"\w\w+", text)
    return words + [" ".join(p) for p in zip(words, words[1:])]


def reference_tfidf(texts, cap):
    counts = [Counter(grams(t)) for t in texts]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    vocab = sorted(sorted(total, key=lambda t: (-total[t], t))[:cap])
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    matrix = np.zeros((len(texts), len(vocab)))
    for i, c in enumerate(counts):
        for j, t in enumerate(vocab):
            if t in c:
                matrix[i, j] = (1 + math.log(c[t])) * idf[t]
        norm = np.linalg.norm(matrix[i])
        if norm:
            matrix[i] /= norm
    return vocab, idf, matrix


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "en" if i % 2 else "de", t, l) for i, (t, l) in enumerate(zip(TEXTS, LABELS))]
    return spark.createDataFrame(rows, "doc_id LONG, lang STRING, text STRING, label INT").cache()


@pytest.mark.parametrize("cap", [3, 7, 20, 500])
def test_vocabulary_and_weights(docs, cap):
    names, idf, matrix = reference_tfidf(TEXTS, cap)
    counted = V.counted_docs(docs)
    vocab = V.vocabulary(counted, cap)
    rows = vocab.orderBy("idx").collect()
    assert [r["term"] for r in rows] == names and [r["idx"] for r in rows] == list(range(len(names)))
    assert all(math.isclose(r["idf"], idf[r["term"]], rel_tol=1e-12) for r in rows)
    got = np.zeros_like(matrix)
    for r in V.tfidf(counted, vocab).collect():
        got[r["doc_id"], r["idx"]] = r["weight"]
    assert np.allclose(got, matrix, atol=1e-12)


def test_sparse_rows_keep_documents_without_terms(docs):
    _, _, matrix = reference_tfidf(TEXTS, 20)
    counted = V.counted_docs(docs, ["label"])
    rows = V.sparse_rows(counted, V.vocabulary(counted, 20), ["label"]).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        dense = np.zeros(matrix.shape[1])
        dense[r["indices"]] = r["values"]
        assert np.allclose(dense, matrix[r["doc_id"]], atol=1e-12)
        assert r["indices"] == sorted(r["indices"])


def test_copies_and_hot_terms(spark):
    """A third of the texts are copies of one, and one word is in all of them."""
    texts = ["the same hot text the the"] * 100 + [f"the word{i % 17} item{i % 5} more{i % 3}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(6)
    names, idf, matrix = reference_tfidf(texts, 25)
    counted = V.counted_docs(docs)
    vocab = V.vocabulary(counted, 25)
    assert [r["term"] for r in vocab.orderBy("idx").collect()] == names
    got = np.zeros_like(matrix)
    for r in V.tfidf(counted, vocab).collect():
        got[r["doc_id"], r["idx"]] = r["weight"]
    assert np.allclose(got, matrix, atol=1e-12)


@pytest.mark.parametrize("cap, slots", [(1, 5), (3, 1), (7, 5), (7, 64), (20, None), (500, 64)])
def test_pruned_vocabulary_equals_the_full_one(docs, cap, slots):
    """From one slot for all terms, where nothing is pruned, to a slot for each."""
    counted = V.counted_docs(docs)
    expected = sorted(map(tuple, V.vocabulary(counted, cap).collect()))
    assert sorted(map(tuple, V.frequent_vocabulary(counted, cap, slots=slots).collect())) == expected


def test_pruned_vocabulary_leaves_rare_terms_uncounted(spark):
    """Ten frequent words, ties at the border among them, below thousands that occur once."""
    texts = [" ".join([f"hot{j}" for j in range(10)] * (3 if i % 3 else 1) + [f"rare{i}x{j}" for j in range(20)]) for i in range(300)]
    counted = V.counted_docs(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(5), ngram_range=(1, 1))
    stats = V.frequent_stats(counted, 4, slots=1 << 20, tasks=2)
    full = {r["term"]: (r["tf"], r["df"]) for r in V.term_stats(V.listed_terms(counted)).collect()}
    got = {r["term"]: (r["tf"], r["df"]) for r in stats.collect()}
    assert len(full) == 6010 and sorted(got) == sorted(f"hot{j}" for j in range(10))
    assert all(full[t] == got[t] for t in got)


def test_pruned_vocabulary_of_nothing(spark):
    counted = V.counted_docs(spark.createDataFrame([(1, ""), (2, "")], "doc_id LONG, text STRING"))
    assert V.frequent_vocabulary(counted, 4).count() == 0
    assert V.frequent_vocabulary(counted.limit(0), 4).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_texts_are_grouped_where_they_lie(spark, docs):
    bucketed, counted = V.bucketed_docs(docs, 3, ["label"]), V.counted_docs(docs, ["label"])
    vocab = V.vocabulary(counted, 20)
    model = M.TfidfModel(terms=vocab.withColumn("coef", F.lit(0.5)), intercept=0.1)
    pairs = [
        (V.sparse_rows(bucketed, vocab, ["label"]), V.sparse_rows(counted, vocab, ["label"])),
        (V.tfidf(bucketed, vocab), V.tfidf(counted, vocab)),
        (M.score_counted(bucketed, model, ["label"]), M.score_counted(counted, model, ["label"])),
    ]
    for got, expected in pairs:
        assert "Exchange hashpartitioning" not in plan_of(got)
        assert "Exchange hashpartitioning" in plan_of(expected)
        numbers = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r if not isinstance(v, list)]) for r in df.collect())
        assert got.count() > 0 and numbers(got) == numbers(expected)


def test_term_counts_need_no_shuffle(docs):
    plan = V.doc_terms(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sparse_rows_gather_before_the_only_shuffle(spark):
    counted = V.counted_docs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["lang"])
    plan = V.sparse_rows(counted, V.vocabulary(counted, 100), ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert "partial_collect_list" in plan.split("Exchange hashpartitioning")[1]


def test_listed_terms_equal_doc_terms(docs):
    for outer in (False, True):
        left = V.doc_terms(docs, keep=["label"], outer=outer)
        right = V.listed_terms(V.counted_docs(docs, ["label"]), keep=["label"], outer=outer)
        assert left.columns == right.columns
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_top_terms_with_ties_at_the_border(spark):
    stats = spark.createDataFrame([(f"t{i:03d}", 1 if i else 5, 1) for i in range(50)], "term STRING, tf LONG, df LONG")
    rows = V.top_terms(stats, 4).orderBy("idx").collect()
    assert [r["term"] for r in rows] == ["t000", "t001", "t002", "t003"]
    assert V.top_terms(stats, 1000).count() == 50


def test_encode(docs):
    vocab = V.vocabulary(V.counted_docs(docs, ngram_range=(1, 1)), 3)
    names = [r["term"] for r in vocab.orderBy("idx").collect()]
    for r in V.encode(docs, vocab, 3, pad=True).collect():
        words = re.findall(r"\w\w+", TEXTS[r["doc_id"]])[:3]
        ids = [names.index(w) + 2 if w in names else 1 for w in words]
        assert r["input_ids"] == ids + [0] * (3 - len(ids))
        assert r["attention_mask"] == [1] * len(ids) + [0] * (3 - len(ids))
        assert r["n_unknown"] == ids.count(1)
    kept = V.encode(docs.withColumn("split", F.lit("train")), vocab, 3, keep=["lang", "split"])
    path = new_path(docs.sparkSession, "encoded")
    write_corpus(kept, path, None, "parquet")
    back = docs.sparkSession.read.parquet(f"{path}/lang=en/split=train")
    assert {r["doc_id"]: r["input_ids"] for r in back.collect()} == {r["doc_id"]: r["input_ids"] for r in kept.filter("lang = 'en'").collect()}
    free = {r["doc_id"]: r for r in V.encode(docs, vocab, 3).collect()}
    assert free[7]["input_ids"] == [names.index("bad") + 2] and free[8]["input_ids"] == []


def test_term_origin(docs):
    got = {(r["train_set"], r["term_lang"]): r["n_terms"] for r in V.term_origin(docs, {"both": ["en", "de"], "only": ["en"]}, 500).collect()}
    per = {"en": Counter(), "de": Counter()}
    for i, t in enumerate(TEXTS):
        per["en" if i % 2 else "de"].update(grams(t))
    expected = Counter(min(("de", "en"), key=lambda g: (-per[g][t], g)) for t in set(per["en"]) | set(per["de"]))
    assert got == {("both", "en"): expected["en"], ("both", "de"): expected["de"], ("only", "en"): len(per["en"])}


def newton(x, y, weights, c=1.0):
    """Coefficients that minimise the summed weighted loss with an L2 penalty, intercept free."""
    n, d = x.shape
    beta = np.zeros(d + 1)
    ones = np.hstack([x, np.ones((n, 1))])
    penalty = np.append(np.ones(d) / c, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-ones @ beta))
        gradient = ones.T @ (weights * (p - y)) + penalty * beta
        hessian = (ones * (weights * p * (1 - p))[:, None]).T @ ones + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


@pytest.mark.parametrize("balanced", [True, False])
def test_fit_matches_newton_and_scoring_matches_the_model(docs, balanced):
    names, _, matrix = reference_tfidf(TEXTS, 30)
    y = np.array(LABELS)
    n_class = {c: (y == c).sum() for c in (0, 1)}
    weights = np.array([len(y) / (2 * n_class[c]) if balanced else 1.0 for c in y])
    beta = newton(matrix, y, weights)
    model = M.fit(docs, M.TfidfModel(max_features=30, tolerance=1e-12, balanced=balanced))
    got = [r["coef"] for r in model.terms.orderBy("idx").collect()]
    assert np.allclose(got, beta[:-1], atol=1e-5) and abs(model.intercept - beta[-1]) < 1e-5
    z = matrix @ np.array(got) + model.intercept
    for r in M.score(docs, model, ["label"]).collect():
        assert math.isclose(r["z"], z[r["doc_id"]], abs_tol=1e-9)
        assert r["pred"] == int(z[r["doc_id"]] > 0)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z[r["doc_id"]])), abs_tol=1e-9)


def test_save_and_load(spark, docs, folder):
    model = M.fit(docs, M.TfidfModel(max_features=10))
    M.save_model(model, folder)
    again = M.load_model(spark, folder)
    assert (again.max_features, again.ngram_range, again.intercept, again.train_rows) == (10, (1, 2), model.intercept, 10)
    left = {r["doc_id"]: r["z"] for r in M.score(docs, model).collect()}
    assert {r["doc_id"]: r["z"] for r in M.score(docs, again).collect()} == left


def test_unfitted_and_one_class(docs):
    with pytest.raises(RuntimeError):
        M.score(docs, M.TfidfModel())
    with pytest.raises(ValueError):
        M.fit(docs.filter(F.col("label") == 1))


def test_summed_terms_equal_the_listed_ones(docs):
    counted = V.counted_docs(docs.repartition(3), ["label"])
    assert sorted(map(tuple, V.summed_terms(counted).collect())) == sorted(map(tuple, V.term_stats(V.listed_terms(counted)).collect()))
    by_label = V.listed_terms(counted, keep=["label"]).groupBy("label", "term").agg(F.sum("n"), F.count("*"))
    assert sorted(map(tuple, V.summed_terms(counted, ["label"]).collect())) == sorted(map(tuple, by_label.collect()))
    assert "HashAggregate" not in plan_of(V.partial_sums(counted))


def test_rows_of_one_key_become_one_text(spark):
    rows = [(1, "aa bb"), (1, "aa cc cc"), (None, "bb"), (None, "cc"), (2, ""), (3, "aa bb")]
    counted = V.counted_docs(spark.createDataFrame(rows, "doc_id LONG, text STRING"), ngram_range=(1, 1))
    vocab = V.vocabulary(counted, 3)
    got = {r["doc_id"]: (r["indices"], [round(v * v, 6) for v in r["values"]]) for r in V.sparse_rows(counted, vocab).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: [0, 0, 1, 2], None: [1, 2], 2: [], 3: [0, 1]}
    assert all(abs(sum(v[1]) - 1) < 1e-5 for k, v in got.items() if k != 2)


def test_tfidf_and_scores_shuffle_no_terms(docs):
    counted = V.counted_docs(docs)
    vocab = V.vocabulary(counted, 20)
    model = M.TfidfModel(terms=vocab.withColumn("coef", F.lit(0.5)))
    for made in (V.tfidf(counted, vocab), V.sparse_rows(counted, vocab), M.score_counted(counted, model)):
        assert "Generate" not in plan_of(made) and "MapInArrow" in plan_of(made)


def test_words_count_the_same_as_listed_terms(spark):
    """Texts kept as words: any n-gram range, empty texts, one word, words of other scripts, rows that share a key."""
    texts = ["a1 b1 a1 b1 a1", "", "one", None, "été über été über 漢字 漢字", "x1 x2 x3 x4", "a1 b1 a1 b1 a1"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING").repartition(3)
    for ngram_range in ((1, 1), (1, 2), (2, 3), (1, 4)):
        words, listed = (f(docs, ngram_range=ngram_range) for f in (V.word_docs, V.counted_docs))
        assert sorted(map(tuple, V.summed_terms(words).collect())) == sorted(map(tuple, V.summed_terms(listed).collect()))
        vocab = V.vocabulary(listed, 50)
        assert sorted(map(tuple, V.vocabulary(words, 50).collect())) == sorted(map(tuple, vocab.collect()))
        for made in (V.sparse_rows, V.tfidf):
            assert sorted(map(str, made(words, vocab).collect())) == sorted(map(str, made(listed, vocab).collect()))


@pytest.mark.parametrize("cap, slots", [(1, 5), (3, 1), (7, 5), (7, 64), (20, None), (500, 64)])
def test_winning_stats_hold_the_border_and_all_above(docs, cap, slots):
    for counted in (V.counted_docs(docs, ["lang"]), V.word_docs(docs, ["lang"])):
        full = sorted(map(tuple, V.summed_terms(counted).collect()))
        border = sorted((r[1] for r in full), reverse=True)[:cap][-1]
        got = sorted(map(tuple, V.winning_stats(counted, cap, slots).collect()))
        assert set(got) <= set(full) and {r for r in full if r[1] >= border} <= set(got)
        by_lang = {tuple(r) for r in V.summed_terms(counted, ["lang"]).collect()}
        parts = {tuple(r) for r in V.winning_stats(counted, cap, slots, ["lang"]).collect()}
        assert parts <= by_lang and {r for r in by_lang if dict((f[0], f[1]) for f in full)[r[1]] >= border} <= parts


def test_vocabulary_leaves_rare_terms_uncounted(spark):
    """Only terms of slots that can win are shuffled, whatever else the texts hold."""
    texts = [" ".join([f"hot{j}" for j in range(10)] * 3 + [f"rare{i}x{j}" for j in range(20)]) for i in range(300)]
    words = V.word_docs(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(5), ngram_range=(1, 1))
    assert sorted(r["term"] for r in V.winning_stats(words, 4, 1 << 16).collect()) == sorted(f"hot{j}" for j in range(10))


def test_rare_terms_of_a_frequent_ones_slot_are_left_uncounted(spark):
    """A term has a slot in each of two rows; sharing one of them with a frequent term is not enough to be counted."""
    rows = [(i, " ".join(["often", "usual"] * 40 + [f"rare{i}x{j}" for j in range(40)])) for i in range(60)]
    words = V.word_docs(spark.createDataFrame(rows, "doc_id LONG, text STRING"), ngram_range=(1, 1))
    stats = {r["term"]: (r["tf"], r["df"]) for r in V.winning_stats(words, 2, 64).collect()}
    assert stats["often"] == stats["usual"] == (2400, 60)
    # 2,400 rare terms: 1 of 32 shares a slot in one row, 1 of 1,024 in both.
    assert len(stats) < 25


def test_runs_and_listed_terms_have_the_same_hash():
    texts = ["ab cd ab cd", "", "zz", "longerthan8chars ab ñandú\nab " + "w" * 200 + " eightlet\n\nx", "日本語文字列 " + "é" * 40]
    own = V.Words(pa.array(["before", *texts]).slice(1))
    found = {}
    for size, (begin, hashed) in enumerate(own.runs(3), 1):
        for at, value in zip(begin, hashed):
            found.setdefault(" ".join(own.strings(np.arange(at, at + size)).to_pylist()), set()).add(int(value))
    expected = {" ".join(words[i : i + n]) for t in texts for words in (u.split() for u in t.split("\n")) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    assert set(found) == expected and len(set().union(*found.values())) == len(expected)
    assert all(found[t] == {int(h)} for t, h in zip(found, V.hashes_of(pa.array(list(found)))))


def test_a_stretch_of_texts_hands_on_each_term_once(spark):
    """Terms of texts kept as words are added up before they are handed on, per group."""
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en", "de", None, "en"],
        "terms": pa.array([{"low": 1, "high": 1, "words": w} for w in ("ab ab cd", "ab", "cd", "ab\ncd")], pa.struct([("low", pa.int32()), ("high", pa.int32()), ("words", pa.string())])),
    })
    (part, row, term, n), = V.held(batch)
    row, term, tf, df = V.summed_places(part, ["lang"], row, term, n)
    got = {(part.column("lang")[int(r)].as_py(), t): (a, b) for r, t, a, b in zip(row, term.to_pylist(), tf.to_pylist(), df.to_pylist())}
    assert got == {("en", "ab"): (3, 2), ("en", "cd"): (2, 2), ("de", "ab"): (1, 1), (None, "cd"): (1, 1)} and len(row) == 4


def test_slot_sums_beyond_32_bits(spark):
    """Sums of one task that pass 32 bits, and sums that pass them only when added up."""
    for n in (1 << 40, 3 << 29):
        rows = spark.createDataFrame([([("ab", n)],)] * 4, "terms array<struct<term: string, n: bigint>>").repartition(4)
        assert sorted(V.slot_sums(rows, 8).flatten())[-3:] == [0, 4 * n, 4 * n]


@pytest.mark.parametrize("cap, slots", [(1, 5), (3, 1), (7, 64), (20, None), (500, 64)])
def test_winning_stats_of_sets_hold_each_sets_border(docs, cap, slots):
    sets = {"one": ["en"], "two": ["de"], "both": ["en", "de"], "none": ["xx"]}
    words = V.word_docs(docs, ["lang"])
    got = {tuple(r) for r in V.winning_set_stats(words, sets, cap, "lang", slots).collect()}
    for name, own in sets.items():
        part = words.filter(F.col("lang").isin(own))
        full = {tuple(r)[:3] for r in V.summed_terms(part, ["lang"]).select("term", "lang", "tf").collect()}
        whole = Counter()
        for term, _, tf in full:
            whole[term] += tf
        border = sorted(whole.values(), reverse=True)[:cap][-1] if whole else 0
        found = {g[1:] for g in got if g[0] == name}
        assert found <= full and {f for f in full if whole[f[0]] >= border} <= found


def test_term_origin_hashes_each_group_once(spark, docs, monkeypatch):
    read, slot_sums = [], V.slot_sums
    monkeypatch.setattr(V, "slot_sums", lambda counted, slots: read.append(1) or slot_sums(counted, slots))
    V.term_origin(docs, {"one": ["en"], "two": ["de"], "both": ["en", "de"]}, 20).collect()
    assert len(read) == 2
