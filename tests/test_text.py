import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import cleaning as C


def run(spark, value, expression):
    return spark.createDataFrame([(value,)], "t STRING").select(expression(F.col("t")).alias("r")).head()["r"]


def run_all(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, t STRING").select("i", expression(F.col("t")).alias("r"))
    return [r["r"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


CASES = [
    ("read https://a.example/x?y=1 today", "read today"),
    ("look at www.a.example/p now", "look at now"),
    ("<div>one <i>two</i></div>", "one two"),
    ("a<br>b", "a b"),
    ("one    two\t\tthree\n\nfour", "one two three four"),
    ("   padded  ", "padded"),
    ("write to someone@mail.example please", "write to please"),
    ("hi @someone there", "hi someone there"),
    ("so #great today", "so great today"),
    ("Lovely film! 😀👍", "Lovely film! 😀👍"),
    ("ছবিটি ভালো ছিল", "ছবিটি ভালো ছিল"),
    ("!!! ??? ...", "!!! ??? ..."),
    ("https://only.example", ""),
    ("##a #b @c d@e a@ @@x @a@", "#a b c a@ a@"),
    ("xhttpfoo y HTTP://a www.", "x y HTTP://a www."),
    ("<a<b>> 1<2 and 3>2", "> 1 2"),
    ("a b​c\x1cd", "a b​c d"),
    ("", ""),
    (None, ""),
]


def test_clean_text_cases(spark):
    assert run_all(spark, [c[0] for c in CASES], X.clean_text) == [c[1] for c in CASES]


def test_switches(spark):
    assert run(spark, "Big WORDS", lambda c: X.clean_text(c, lowercase=True)) == "big words"
    assert run(spark, "see http://a.b c", lambda c: X.clean_text(c, remove_urls=False)) == "see http://a.b c"
    assert run(spark, "<b>x</b>", lambda c: X.clean_text(c, remove_html=False)) == "<b>x</b>"
    assert run(spark, " a  b ", lambda c: X.clean_text(c, normalize_whitespace=False)) == " a  b "


def test_long_text_is_processed_whole(spark):
    text = "word " * 20_000 + "someone@mail.example end"
    assert run(spark, text, X.clean_text) == "word " * 20_000 + "end"


def test_unclosed_tags_stay_fast_and_unchanged(spark):
    text = "<" * 200_000
    assert run(spark, text, X.strip_html) == text
    assert run(spark, "<a>" + text, X.strip_html) == " " + text


# The cleaning steps as Unicode patterns, in their order.
STEPS = [(r"<[^>]+>", " "), (r"http\S+|www\.\S+", " "), (r"\S+@\S+", " "), (r"[@#](\w+)", r"\1"), (r"\s+", " ")]


def python_clean(t):
    for pattern, by in STEPS:
        t = re.sub(pattern, by, t)
    return t.strip()


ALPHABET = st.sampled_from(list("ab@#<>. \t\n/:_w1") + ["http", "www.", " ", "\x1c", " ", "কা", "é", "😀", "​"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ALPHABET, max_size=40).map("".join), min_size=150, max_size=200))
def test_clean_text_matches_unicode_regexes(spark, texts):
    assert run_all(spark, texts, X.clean_text) == [python_clean(t) for t in texts]
    assert run_all(spark, texts, X.tokens) == [re.findall(r"\w\w+", t) for t in texts]
    assert run_all(spark, texts, X.word_count) == [len(t.split()) for t in texts]
    assert run_all(spark, texts, X.strip) == [t.strip() for t in texts]


def test_tokens_split_at_vowel_signs(spark):
    assert run(spark, "সিনেমাটি অসাধারণ ছিল a bb c_d", X.tokens) == ["অস", "রণ", "bb", "c_d"]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 2), (1, 3), (2, 4)])
def test_ngrams(spark, low, high):
    for text in ["", "aa", "aa bb", "aa bb cc dd ee"]:
        words = re.findall(r"\w\w+", text)
        expected = [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
        assert run(spark, text, lambda c: X.ngrams(X.tokens(c), low, high)) == expected


def test_ngram_range_is_checked(spark):
    with pytest.raises(ValueError):
        X.ngrams(F.col("x"), 2, 1)


def test_term_counts(spark):
    got = run(spark, "bb aa bb cc bb aa", lambda c: X.term_counts(X.tokens(c)))
    assert [(r["term"], r["n"]) for r in got] == [("aa", 2), ("bb", 3), ("cc", 1)]
    assert run(spark, "x", lambda c: X.term_counts(X.tokens(c))) is None


def test_shorten_counts_code_points(spark):
    assert run(spark, "😀" * 60, lambda c: X.shorten(c, 50, "...")) == "😀" * 50 + "..."
    assert run(spark, "😀" * 50, lambda c: X.shorten(c, 50, "...")) == "😀" * 50
    assert run(spark, "abc", lambda c: X.shorten(c, 2)) == "ab"


def test_lines_and_blank(spark):
    assert run(spark, " a \n\n\t\n b \nc", X.lines) == ["a", "b", "c"]
    assert run_all(spark, ["  \t", "", None, "x"], X.is_blank) == [True, True, True, False]


def test_truncate_ids(spark):
    row = spark.createDataFrame([([5, 6, 7],)], "a ARRAY<INT>")
    ids, mask = X.truncate_ids(F.col("a"), 2)
    assert row.select(ids, mask).head() == ([5, 6], [1, 1])
    ids, mask = X.truncate_ids(F.col("a"), 5, 0)
    assert row.select(ids, mask).head() == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0])


def test_clean_rows_keeps_other_columns_and_drops_empty(spark):
    df = spark.createDataFrame(
        [(1, "<p>fine</p>", 1, "x"), (2, "https://only.example", 0, "y"), (3, None, 1, "z")], "k INT, sentence STRING, label INT, extra STRING"
    )
    out = C.clean_rows(df, "sentence")
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [(1, "fine", 1, "x")]
    assert C.clean_rows(df, "sentence", drop_empty=False).count() == 3
    assert C.removed_count(df, "sentence").head().asDict() == {"before": 3, "after": 1, "removed": 2}


def test_non_string_text_is_empty(spark):
    df = spark.createDataFrame([(1, 123)], "k INT, text INT")
    assert C.clean_rows(df).count() == 0


def test_cleaning_runs_each_pattern_once(spark):
    df = spark.createDataFrame([(1, "a")], "k INT, text STRING")
    plan = C.clean_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("http[^") == 1 and "Filter" not in plan
