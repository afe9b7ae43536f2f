"""The registered queries: every operator on the given tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import labels as L, scores as P, text as X
from lexmill.operators import cleaning as C, features as V, grid as G, linear as M, metrics as E, runs as R, sampling as S, stats as A
from lexmill.operators.cleaning import clean_rows
from lexmill.plans import experiments as W
from lexmill.sources import corpus as I, records as J
from lexmill.sources.cache import cleaned, cleaned_files
from lexmill.sources.workdir import materialize, new_path
from lexmill.streaming import scoring as Z

LANGS = ("en", "de", "fr", "es")
SOURCE, TARGET = "en", "de"
KEYED = "doc_id BIGINT, text STRING, label INT"
FEATURES = V.MAX_FEATURES
FEW_FEATURES = 5_000
SETTINGS = M.TfidfModel()
TIGHT = M.TfidfModel(tolerance=1e-9)

FIGURES = ("accuracy", "precision", "recall", "f1")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register a query under its function name with a leading ``q_``."""
    QUERIES[f"q_{fn.__name__}"] = fn
    return fn


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Inputs -------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, languages and labels without the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return docs.join(marks, "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(marks, "doc_id")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_rows(documents(spark, sf_dir))


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_rows(corpus(spark, sf_dir))


def hash_score(key: Column) -> Column:
    """A score in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0


def with_score(df: DataFrame) -> DataFrame:
    score = hash_score(F.col("doc_id"))
    return df.withColumn("score", score).withColumns(
        {"pred": (F.col("score") > 0.5).cast("int"), "confidence": F.greatest(F.col("score"), 1.0 - F.col("score"))}
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records: type is the condition, user gives the size, day the seed."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    size = F.element_at(F.array(*[F.lit(s) for s in R.CURVE_SIZES]), (F.col("user_id") % 6 + 1).cast("int"))
    return (
        events.select(
            F.col("event_type").alias("condition"), size.alias("size"),
            (F.dayofmonth("ts") % 3 + 42).alias("seed"),
            F.when(F.col("event_id") % 2 == 0, SOURCE).otherwise(TARGET).alias("lang"),
            F.round(F.col("value") * 100).cast("long").alias("cents"), "value",
        )
        .groupBy("condition", "size", "seed", "lang")
        .agg(
            F.count("*").alias("n"),
            (F.sum("cents") / (F.count("cents") * 10000.0)).alias("f1"),
            (F.count_if(F.col("value") > 10) / F.count("*")).alias("accuracy"),
        )
    )


def mode_runs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events as run records per mode, seed and language, and per model if asked."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return (
        events.select(
            F.col("event_type").alias("mode"), (F.dayofmonth("ts") % 3 + 42).alias("seed"),
            F.when(F.col("user_id") % 2 == 0, "linear").otherwise("other").alias("model"),
            F.when(F.col("event_id") % 2 == 0, SOURCE).otherwise(TARGET).alias("lang"),
            F.round(F.col("value") * 100).cast("long").alias("cents"), "value",
        )
        .groupBy("mode", "seed", "lang", *more)
        .agg(
            F.count("*").alias("n"),
            (F.sum("cents") / (F.count("cents") * 10000.0)).alias("f1"),
            (F.count_if(F.col("value") > 10) / F.count("*")).alias("accuracy"),
        )
        .withColumn("train_samples", F.col("n") * F.col("seed"))
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means per event type as the scores of a run's epochs."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    return events.groupBy("run", "epoch").agg((F.sum("cents") / (F.count("cents") * 100.0)).alias("score"))


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(labelled(spark, sf_dir).drop("toxic"), group=["lang"])


def texts_with_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled texts with their split; the split itself looks at keys and labels only."""
    return S.stratified_split(corpus(spark, sf_dir), group=["lang"])


# Sources and sinks --------------------------------------------------------------------------


@query
def read_split(spark, sf_dir):
    root = new_path(spark, "csv")
    I.write_corpus(texts_with_split(spark, sf_dir), root, ["doc_id", "text", "label"])
    back = I.read_split(spark, root, SOURCE, "train", KEYED)
    return back.select("doc_id", "lang", "split", "label", F.md5("text").alias("text_md5"))


@query
def read_corpus(spark, sf_dir):
    root = new_path(spark, "csv")
    I.write_corpus(texts_with_split(spark, sf_dir), root, None)
    back = I.read_corpus(spark, root, KEYED)
    return back.select("doc_id", "lang", "split", "label", F.md5("text").alias("text_md5"))


@query
def rewrite_language(spark, sf_dir):
    """Two languages written; one is written again, twice, with other labels; both are read."""
    root, rows = new_path(spark, "csv"), texts_with_split(spark, sf_dir)
    I.write_corpus(rows.filter(F.col("lang") == SOURCE), root, ["doc_id", "text", "label"])
    changed = rows.filter(F.col("lang") == TARGET).withColumn("label", 1 - F.col("label"))
    I.write_corpus(rows.filter(F.col("lang") == TARGET), root, ["doc_id", "text", "label"], mode="overwrite")
    for _ in range(2):
        I.write_corpus(changed, root, ["doc_id", "text", "label"], mode="overwrite")
    back = I.read_corpus(spark, root, KEYED)
    return back.select("doc_id", "lang", "split", "label", F.md5("text").alias("text_md5"))


@query
def encoded_files(spark, sf_dir):
    """Encoded sequences written by language and split, one language a second time, and read back."""
    root, rows = new_path(spark, "encoded"), clean_rows(texts_with_split(spark, sf_dir))
    words = V.vocabulary(V.word_docs(rows, ngram_range=(1, 1)), FEATURES)
    encoded = materialize(V.encode(rows, words, 128, keep=["lang", "split"]), "encoded-rows")
    I.write_corpus(encoded, root, None, "parquet")
    I.write_corpus(encoded.filter(F.col("lang") == TARGET), root, None, "parquet", mode="overwrite")
    back = I.read_corpus(spark, root, "doc_id BIGINT, n_unknown BIGINT, input_ids ARRAY<INT>, attention_mask ARRAY<INT>", "parquet")
    return back.select(
        "doc_id", "lang", "split", big("n_unknown").alias("n_unknown"), big(F.size("attention_mask")).alias("n_ids"), F.md5(F.array_join("input_ids", ",")).alias("ids_md5")
    )


def raw_records(df: DataFrame) -> DataFrame:
    """CSV records of texts and labels, some of them malformed: a word for a label, one field, three fields."""
    text = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    kind = F.col("doc_id") % 10
    record = (
        F.when(kind == 0, F.concat(text, F.lit(",abc"))).when(kind == 1, text)
        .when(kind == 2, F.concat_ws(",", text, F.col("label").cast("string"), F.lit("9")))
        .otherwise(F.concat_ws(",", text, F.col("label").cast("string")))
    )
    return df.select("doc_id", record.alias("record"))


def write_records(records: DataFrame, path: str, files: int = 8) -> str:
    """Files of raw records, each below a header line; gives the pattern that reads them."""
    part = F.pmod(F.xxhash64("record"), F.lit(files))
    rows = records.select(part.alias("part"), F.lit(1).alias("place"), F.col("record").alias("value"))
    heads = records.sparkSession.range(files).select(F.col("id").alias("part"), F.lit(0).alias("place"), F.lit("text,label").alias("value"))
    whole = rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "place")
    whole.select("value", "part").write.partitionBy("part").text(path)
    return f"{path}/part=*"


@query
def checked_csv(spark, sf_dir):
    """Good rows and malformed records of the same files, which together are all records."""
    root = new_path(spark, "raw")
    read = I.read_checked(spark, write_records(raw_records(corpus(spark, sf_dir)), f"{root}/csv"))
    for _ in range(2):
        I.write_quarantine(read.malformed, root)
    good = read.rows.select(F.lit("good").alias("kind"), F.md5("text").alias("md5"), "label")
    return good.unionByName(I.read_quarantine(spark, root).select(F.lit("malformed").alias("kind"), F.md5("record").alias("md5"), F.lit(None).cast("int").alias("label")))


@query
def csv_run(spark, sf_dir):
    """A model trained on one CSV file and judged on another; what was read, set aside, learned and judged."""
    root, rows = new_path(spark, "run"), texts_with_split(spark, sf_dir)
    records = raw_records(rows).join(rows.select("doc_id", "split"), "doc_id")
    paths = [write_records(records.filter(F.col("split") == s), f"{root}/{s}") for s in ("train", "test")]
    run = W.run_from_files(spark, *paths, f"{root}/out", SETTINGS)
    parts = [c.counts().agg(F.sum("good").alias("good"), F.sum("malformed").alias("malformed")).withColumn("part", F.lit(p)) for p, c in (("train", run.train), ("test", run.test))]
    n_terms, judged = M.load_model(spark, f"{root}/out/model").terms.count(), spark.read.json(f"{root}/out/metrics").head()["n"]
    told = {"train": n_terms, "test": judged}
    return parts[0].unionByName(parts[1]).select("part", "good", "malformed", F.when(F.col("part") == "train", told["train"]).otherwise(told["test"]).cast("long").alias("used"))


@query
def row_keys(spark, sf_dir):
    """Rows without a key, half of them copies of one, get keys of their own."""
    rows = documents(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, "copy").otherwise(F.col("text")).alias("text"), "lang")
    keyed = I.with_key(rows)
    return keyed.groupBy("lang", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_keys"))


@query
def demo_corpus(spark, sf_dir):
    raw = corpus(spark, sf_dir).withColumn("label", raw_string_label())
    ready = I.raw_source(raw, LANGS)
    return ready.groupBy("split", "label").agg(F.count("*").alias("n"))


@query
def holdout_source(spark, sf_dir):
    rows = labelled(spark, sf_dir).drop("toxic")
    parts = I.holdout_source(rows.filter(F.col("lang") != TARGET), rows.filter(F.col("lang") == TARGET))
    return parts.select("doc_id", "lang", "label", "split")


# Text ---------------------------------------------------------------------------------------


def digest(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Hash and length of a text, which is made once."""
    made = df.select(key, text.alias("text"))
    return made.select(key, F.md5("text").alias("text_md5"), big(X.char_count(F.col("text"))).alias("n_chars"))


def pages(spark, sf_dir, column: str) -> DataFrame:
    return I.spread(table(spark, sf_dir, "pages").select("page_id", column), "page_id")


@query
def strip_html(spark, sf_dir):
    return digest(pages(spark, sf_dir, "html"), "page_id", X.strip_html(F.col("html")))


@query
def clean_text(spark, sf_dir):
    return digest(pages(spark, sf_dir, "html"), "page_id", X.clean_text(F.col("html")))


@query
def strip_urls(spark, sf_dir):
    return pages(spark, sf_dir, "url").select("page_id", X.strip_urls(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("text"))


@query
def strip_emails(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(X.strip_emails(F.col("text"))).alias("text_md5"))


@query
def unwrap_tags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(X.unwrap_mentions(F.col("text"))).alias("text_md5"))


@query
def norm_ws(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(X.normalize_spaces(F.col("text"))).alias("text_md5"))


@query
def lower(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(F.lower("text")).alias("text_md5"))


@query
def clean_corpus_rows(spark, sf_dir):
    cleaned = C.clean_rows(documents(spark, sf_dir), lowercase=True)
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"))


QUERIES["q_clean_corpus"] = QUERIES.pop("q_clean_corpus_rows")


@query
def removed_observed(spark, sf_dir):
    """The same counts, taken while the cleaned rows are written."""
    rows, counts = C.clean_rows_counted(documents(spark, sf_dir))
    materialize(rows, "clean")
    return spark.createDataFrame([counts()], "before BIGINT, after BIGINT, removed BIGINT")


@query
def removed_count(spark, sf_dir):
    return C.removed_count(documents(spark, sf_dir))


@query
def tokens(spark, sf_dir):
    words = clean_documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id", big(F.size("w")).alias("n_tokens"), big(F.size(F.array_distinct("w"))).alias("n_distinct")
    )


@query
def ngrams(spark, sf_dir):
    made = V.gram_positions(clean_corpus(spark, sf_dir))
    return made.select("doc_id", big("pos").alias("pos"), "gram")


@query
def ngrams_1_3(spark, sf_dir):
    grams = X.ngrams(X.tokens(F.col("text")), 1, 3)
    counted = clean_documents(spark, sf_dir).select("doc_id", X.bind(grams, lambda g: F.struct(
        F.size(g).alias("n"), F.md5(F.array_join(F.sort_array(g), "|")).alias("md5"))).alias("s"))
    return counted.select("doc_id", big("s.n").alias("n_grams"), F.col("s.md5").alias("grams_md5"))


@query
def explode_lines(spark, sf_dir):
    rows = C.split_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", big("line_no").alias("line_no"), F.md5("text").alias("line_md5"))


# Labels -------------------------------------------------------------------------------------


def raw_string_label() -> Column:
    forms = ["Positive", " neg ", "neutral", "5", "junk", "GOOD", "bad", "0", "1"]
    return F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("doc_id") % 9 + 1).cast("int"))


@query
def std_labels_int(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8 - 1).cast("int").alias("label"))
    return C.standardize_labels(raw)


@query
def std_labels_str(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", raw_string_label().alias("label"))
    return C.standardize_labels(raw)


@query
def std_labels_float(spark, sf_dir):
    kind = F.col("event_id") % 10
    value = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(None).cast("double")).otherwise(F.col("value") / 20.0)
    return C.standardize_labels(table(spark, sf_dir, "events").select("event_id", value.alias("label")))


@query
def std_labels_mixed(spark, sf_dir):
    """Raw labels of many types in one column, as JSON has them, and NaN, which JSON has not."""
    kind = F.col("doc_id") % 14
    written = ["1", "2.0", '"pos"', None, "true", "null", "2", '" Bad "', "0.5", "-3", '"7"', "[1]", "false", "4"]
    label = F.parse_json(F.element_at(F.array(*[F.lit(w) for w in written]), (kind + 1).cast("int")))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.when(kind == 3, F.lit(float("nan")).cast("variant")).otherwise(label).alias("label"))
    return C.standardize_labels(raw)


@query
def label_map(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("label"))
    return C.map_labels(raw, {"1": 1, "2": 0})


@query
def label_map_toxic(spark, sf_dir):
    raw = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return I.mapped_source(raw, {0: 1, 1: 0})


@query
def label_names(spark, sf_dir):
    name = F.when(F.col("role") == "user", "LABEL_1").when(F.col("role") == "assistant", "NEGATIVE").otherwise("pos")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", L.label_id(name).alias("label_id"), L.shown_name(name).alias("label_name"),
        L.label_name(L.label_id(name)).alias("class_name"),
    )


# Splits and samples -------------------------------------------------------------------------


@query
def holdout_split(spark, sf_dir):
    return S.holdout_split(labelled(spark, sf_dir).drop("toxic"), 0.05).select("doc_id", "split")


@query
def stratified_split(spark, sf_dir):
    return S.stratified_split(labelled(spark, sf_dir).drop("toxic")).select("doc_id", "split")


@query
def stratified_split_by_lang(spark, sf_dir):
    return split_corpus(spark, sf_dir).select("doc_id", "lang", "split")


@query
def split_balance(spark, sf_dir):
    return rounded(A.balance(split_corpus(spark, sf_dir)), "pos_pct", "neg_pct")


@query
def combined(spark, sf_dir):
    return S.combined(split_corpus(spark, sf_dir), LANGS, split="train", balance=False).select("doc_id", "language", "label")


@query
def balanced_sample(spark, sf_dir):
    return S.combined(labelled(spark, sf_dir), LANGS).select("doc_id", "language")


@query
def capped_sample(spark, sf_dir):
    return S.capped(clean_documents(spark, sf_dir), 100).select("doc_id")


@query
def first_rows(spark, sf_dir):
    return S.capped(labelled(spark, sf_dir), 100, seed=None).select("doc_id")


SIZES, SEEDS = (10, 25, 50, 100), (42, 43, 44)


@query
def nested_subsets(spark, sf_dir):
    return S.nested_subsets(labelled(spark, sf_dir).select("doc_id"), SIZES, SEEDS)


@query
def subset_balance(spark, sf_dir):
    subsets = S.nested_subsets(labelled(spark, sf_dir).select("doc_id", "label"), SIZES, SEEDS)
    return rounded(A.positive_share(subsets, ["seed", "size"]), "positive_share")


@query
def mode_datasets(spark, sf_dir):
    rows = W.mode_rows(split_corpus(spark, sf_dir), W.standard_modes(SOURCE, TARGET))
    return rows.groupBy("mode", "role", "lang").agg(F.count("*").alias("n"))


# Statistics ---------------------------------------------------------------------------------


@query
def corpus_stats(spark, sf_dir):
    stats = A.corpus_stats(clean_corpus(spark, sf_dir), ["lang"])
    return rounded(stats, "positive_ratio", "avg_text_length", "avg_word_count")


@query
def class_weights(spark, sf_dir):
    return rounded(A.class_weights(labelled(spark, sf_dir), ["lang"]), "weight")


@query
def token_stats(spark, sf_dir):
    return rounded(A.token_stats(clean_documents(spark, sf_dir), ["lang"]), "mean", "std", "median", "p95", "p99")


@query
def token_sketch(spark, sf_dir):
    """Marks of merged sketches, and whether their rank among all lengths is within 2 % of the mark."""
    docs = clean_documents(spark, sf_dir)
    parts = materialize(A.length_sketches(docs.withColumn("part", F.pmod(F.col("doc_id"), F.lit(7))), ["lang", "part"]), "sketches")
    marks = A.sketch_marks(A.merge_sketches(parts, ["lang"]))
    lengths = docs.select("lang", F.size(X.tokens(F.col("text"))).cast("long").alias("length"))
    counted = lengths.groupBy("lang", "length").agg(F.count("*").alias("times"))
    met = marks.join(counted, "lang")
    ranks = met.groupBy("lang", "n", "mark", "value").agg(
        F.sum(F.when(F.col("length") < F.col("value"), F.col("times")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("length") <= F.col("value"), F.col("times")).otherwise(0)).alias("upto"),
    )
    near = (F.col("below") / F.col("n") <= F.col("mark") + 0.02) & (F.col("upto") / F.col("n") >= F.col("mark") - 0.02)
    return ranks.select("lang", "mark", "n", near.alias("near"))


# Metrics ------------------------------------------------------------------------------------


def scored(spark, sf_dir) -> DataFrame:
    return with_score(labelled(spark, sf_dir))


@query
def confusion(spark, sf_dir):
    return E.confusion(scored(spark, sf_dir), ["lang"])


@query
def metrics(spark, sf_dir):
    return rounded(E.evaluate(scored(spark, sf_dir), ["lang"]), *FIGURES)


@query
def per_class(spark, sf_dir):
    rows = E.per_class(E.confusion(scored(spark, sf_dir), ["lang"]), ["lang"])
    return rounded(rows, "precision", "recall", "f1")


@query
def class_report(spark, sf_dir):
    return rounded(E.report(E.confusion(scored(spark, sf_dir))), "precision", "recall", "f1")


@query
def metrics_rollup(spark, sf_dir):
    return rounded(E.evaluate_rollup(scored(spark, sf_dir)), *FIGURES)


@query
def error_counts(spark, sf_dir):
    return E.error_counts(scored(spark, sf_dir), 50)


@query
def error_samples_5000(spark, sf_dir):
    rows = E.error_samples(scored(spark, sf_dir), documents(spark, sf_dir), 5000)
    return rounded(rows.withColumn("rn", big("rn")), "confidence")


@query
def error_samples(spark, sf_dir):
    rows = E.error_samples(scored(spark, sf_dir), documents(spark, sf_dir), 5)
    return rounded(rows.withColumn("rn", big("rn")), "confidence")


@query
def confidence_bands(spark, sf_dir):
    band = P.confidence_phrase(F.col("score")).alias("band")
    face = P.confidence_emoji(L.label_name(F.col("pred")), F.col("confidence")).alias("emoji")
    return with_score(table(spark, sf_dir, "documents").select("doc_id")).groupBy(band, face).agg(F.count("*").alias("n"))


@query
def batch_view(spark, sf_dir):
    rows = with_score(documents(spark, sf_dir).select("doc_id", "text"))
    return W.batch_view(rows)


@query
def batch_summary(spark, sf_dir):
    return W.batch_summary(W.batch_view(with_score(documents(spark, sf_dir).select("doc_id", "text"))))


@query
def softmax(spark, sf_dir):
    logits = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", P.argmax(logits).alias("pred"), F.posexplode(P.softmax(logits)).alias("place", "p"))
    return rows.select("vec_id", "pred", "place", r6("p").alias("p"))


# Features -----------------------------------------------------------------------------------


@query
def term_counts(spark, sf_dir):
    return V.doc_terms(clean_corpus(spark, sf_dir))


@query
def term_df(spark, sf_dir):
    return V.term_stats(V.doc_terms(clean_documents(spark, sf_dir)))


def counted(spark, sf_dir, keep=(), ngram_range=V.NGRAMS) -> DataFrame:
    return V.word_docs(clean_documents(spark, sf_dir), keep, ngram_range=ngram_range)


@query
def vocab_topk(spark, sf_dir):
    return V.vocabulary(counted(spark, sf_dir), FEATURES).select("term", big("idx").alias("idx"), "tf", "df")


@query
def vocab_pruned(spark, sf_dir):
    """A small vocabulary of a corpus with many terms, most of which are never counted."""
    words = V.frequent_vocabulary(V.counted_docs(clean_documents(spark, sf_dir)), FEW_FEATURES)
    return words.select("term", big("idx").alias("idx"), "tf", "df", r6("idf").alias("idf"))


@query
def idf(spark, sf_dir):
    return rounded(V.vocabulary(counted(spark, sf_dir), FEATURES).select("term", "idf"), "idf")


@query
def tfidf(spark, sf_dir):
    docs = counted(spark, sf_dir)
    return rounded(V.tfidf(docs, V.vocabulary(docs, FEATURES)), "weight").select("doc_id", "term", "weight")


def bucketed(spark, sf_dir) -> DataFrame:
    """Counted texts laid out by document, in as many buckets as a shuffle has partitions."""
    return V.bucketed_docs(clean_documents(spark, sf_dir), int(spark.conf.get("spark.sql.shuffle.partitions")))


@query
def tfidf_bucketed(spark, sf_dir):
    docs = bucketed(spark, sf_dir)
    return rounded(V.tfidf(docs, V.vocabulary(docs, FEATURES)), "weight").select("doc_id", "term", "weight")


@query
def linear_score_bucketed(spark, sf_dir):
    docs = bucketed(spark, sf_dir)
    rows = M.score_counted(docs, known_model(docs))
    return rows.select("doc_id", r6("z").alias("z"), r6("score").alias("p"), "pred")


@query
def sparse_rows(spark, sf_dir):
    docs = counted(spark, sf_dir, ["lang"])
    rows = V.sparse_rows(docs, V.vocabulary(docs, FEATURES), ["lang"])
    whole = F.transform("values", lambda v: F.round(v * 100000).cast("long"))
    return rows.select(
        "doc_id", "lang", big(F.size("indices")).alias("n_terms"),
        F.md5(F.array_join("indices", ",")).alias("indices_md5"), F.md5(F.array_join(whole, ",")).alias("values_md5"),
    )


@query
def vocab_by_lang(spark, sf_dir):
    sets = {name: mode.train for name, mode in W.standard_modes(SOURCE, TARGET).items()}
    return V.term_origin(clean_documents(spark, sf_dir), sets, FEATURES)


@query
def encode(spark, sf_dir):
    words = V.vocabulary(counted(spark, sf_dir, ngram_range=(1, 1)), FEATURES)
    rows = V.encode(clean_documents(spark, sf_dir), words, 128, pad=True)
    ones = F.aggregate("attention_mask", F.lit(0), lambda acc, m: acc + m)
    return rows.select(
        "doc_id", big(ones).alias("n_ids"), big("n_unknown").alias("n_unknown"), big(F.size("input_ids")).alias("n_padded"),
        F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
    )


def known_model(docs: DataFrame, seed: str = "", vocab: DataFrame | None = None) -> M.TfidfModel:
    """A model over the texts' vocabulary (``vocab`` if it is there already) whose coefficients are a hash of the term."""
    vocab = V.vocabulary(docs, FEATURES) if vocab is None else vocab
    term = F.concat(F.lit(seed), F.col("term"))
    coefficient = F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("double") / 16777216.0 - 0.5
    return M.TfidfModel(max_features=FEATURES, intercept=0.01, terms=vocab.withColumn("coef", coefficient))


@query
def linear_score(spark, sf_dir):
    docs = counted(spark, sf_dir)
    rows = M.score_counted(docs, known_model(docs))
    return rows.select("doc_id", r6("z").alias("z"), r6("score").alias("p"), "pred")


@query
def saved_model(spark, sf_dir):
    """Scores of a model that was saved and loaded."""
    docs = counted(spark, sf_dir)
    path = new_path(spark, "model")
    M.save_model(known_model(docs), path)
    rows = M.score_counted(docs, M.load_model(spark, path))
    return rows.select("doc_id", r6("z").alias("z"), r6("score").alias("p"), "pred")


@query
def stream_scores(spark, sf_dir):
    """Files scored as a stream that takes what is there, and asked again when nothing is new.

    The second start goes on from the checkpoint, so no text counts twice.
    """
    root, model = new_path(spark, "stream"), known_model(counted(spark, sf_dir))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts.withColumn("part", F.col("doc_id") % 3).repartition("part").drop("part").write.parquet(f"{root}/in")
    for _ in range(2):
        rows = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        Z.score_stream(rows, model, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    scored = spark.read.parquet(f"{root}/out")
    return scored.select("doc_id", r6("z").alias("z"), r6("score").alias("p"), "pred")


def known_evaluation(spark, sf_dir, part: str) -> DataFrame:
    """One table of everything reported about a model on all labelled texts."""
    return W.evaluation(corpus(spark, sf_dir), known_model(counted(spark, sf_dir)))[part]


@query
def model_metrics(spark, sf_dir):
    return rounded(known_evaluation(spark, sf_dir, "metrics"), *FIGURES)


@query
def model_per_class(spark, sf_dir):
    return rounded(known_evaluation(spark, sf_dir, "per_class"), "precision", "recall", "f1")


@query
def model_error_counts(spark, sf_dir):
    return known_evaluation(spark, sf_dir, "error_counts")


@query
def model_error_samples(spark, sf_dir):
    rows = known_evaluation(spark, sf_dir, "error_samples")
    return rounded(rows.withColumn("rn", big("rn")), "confidence")


@query
def run_chain(spark, sf_dir):
    """Evaluations of two seeds become run records, which are read back, collected and shown as a table."""
    docs, root = counted(spark, sf_dir), new_path(spark, "chain")
    marks = labelled(spark, sf_dir).select("doc_id", "lang", "label")
    vocab = V.vocabulary(docs, FEATURES)
    for seed in (42, 43):
        rows = M.score_counted(docs, known_model(docs, str(seed), vocab)).join(marks, "doc_id")
        measured = E.evaluate(rows, ["lang"]).withColumns({"mode": F.lit("known"), "seed": F.lit(seed)})
        J.write_runs(measured, f"{root}/{seed}", ["mode", "seed"], [])
    summary = R.collect_results(J.read_runs(spark, root))
    return R.results_table(summary, ["mode"], "lang", list(LANGS), "f1")


@query
def cleaned_cache(spark, sf_dir):
    """Texts cleaned once and read back the second time."""
    source = f"{sf_dir} {spark.sparkContext.applicationId}"
    for _ in range(2):
        rows = cleaned(documents(spark, sf_dir), source, lowercase=True)
    return rows.select("doc_id", F.md5("text").alias("text_md5"))


@query
def changed_files_cache(spark, sf_dir):
    """A folder cleaned twice: in between files are added, one is written again, one vanishes, one stays."""
    root = new_path(spark, "source")
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("part", F.pmod(F.col("doc_id"), F.lit(4)).cast("int"))
    schema = "doc_id LONG, text STRING, part INT"

    def write(rows):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(root)

    stale = docs.filter("part = 0").withColumn("text", F.concat(F.lit("old "), "text"))
    write(stale.unionByName(docs.filter("part = 1")).unionByName(docs.filter("part = 2").withColumn("part", F.lit(9))))
    cleaned_files(spark, root, schema, lowercase=True)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/part=9")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    write(docs.filter("part <> 1"))
    return cleaned_files(spark, root, schema, lowercase=True).select("doc_id", F.md5("text").alias("text_md5"))


# Fitted models ------------------------------------------------------------------------------


def fitted(spark, sf_dir, settings: M.TfidfModel = SETTINGS) -> tuple[DataFrame, M.TfidfModel]:
    rows = materialize(texts_with_split(spark, sf_dir), "split-corpus", ("lang", "split"))
    return rows, M.fit(rows.filter(F.col("split") == "train"), settings)


@query
def lr_fit(spark, sf_dir):
    """The vocabulary, and per term whether the gradient of the training objective vanishes there.

    The objective is strictly convex, so this tells the optimum apart from all other models. It is
    computed by joins from the scores of the training rows, without the solver.
    """
    rows, model = fitted(spark, sf_dir, TIGHT)
    train = V.word_docs(clean_rows(rows.filter(F.col("split") == "train"), drop_empty=False), ["label"])
    weights = A.class_weights(train.select("label"), label="label").select("label", "weight")
    misses = M.score_counted(train, model, ["label"]).join(weights, "label")
    misses = misses.select("doc_id", (F.col("weight") * (F.col("score") - F.col("label"))).alias("miss"))
    pulls = V.tfidf(train, model.terms).join(misses, "doc_id").groupBy("idx").agg(F.sum(F.col("weight") * F.col("miss")).alias("pull"))
    slope = F.abs(F.coalesce("pull", F.lit(0.0)) + F.col("coef") / model.c)
    return model.terms.join(pulls, "idx", "left").select("term", "idx", "df", r6("idf").alias("idf"), (slope < 0.01).alias("settled"))


@query
def lr_eval(spark, sf_dir):
    rows, model = fitted(spark, sf_dir)
    return W.evaluation(rows.filter(F.col("split") == "test"), model)["metrics"]


@query
def lr_report(spark, sf_dir):
    rows = materialize(texts_with_split(spark, sf_dir), "split-corpus", ("lang", "split"))
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    _, _, report = W.train_and_evaluate(train, test, SETTINGS)
    return report


@query
def transfer_matrix(spark, sf_dir):
    return W.transfer_matrix(texts_with_split(spark, sf_dir), W.standard_modes(SOURCE, TARGET), SETTINGS)


@query
def lr_curve(spark, sf_dir):
    """The whole grid of the learning curve in one joint fit."""
    return R.curve_summary(W.learning_curve(texts_with_split(spark, sf_dir), SOURCE, TARGET, settings=SETTINGS))


def counted_split(spark, sf_dir) -> DataFrame:
    rows = clean_rows(texts_with_split(spark, sf_dir), drop_empty=False)
    return V.word_docs(rows, ["label", "lang", "split"])


SETTLED = 0.01


@query
def grid_fit(spark, sf_dir):
    """Per mode and term whether the gradient vanishes at the jointly fitted models, computed without the solver."""
    modes, docs = W.standard_modes(SOURCE, TARGET), counted_split(spark, sf_dir)
    model = W.fit_modes(docs, modes, SETTINGS, slope=1e-3)
    rows = docs.select("doc_id", "label", "terms", W.train_runs(modes).alias("runs"))
    name = F.element_at(F.array(*[F.lit(m) for m in modes]), F.col("run") + 1)
    return G.slopes(rows, model).select(name.alias("mode"), "term", "df", r6("idf").alias("idf"), (F.abs("slope") < SETTLED).alias("settled"))


@query
def curve_fit(spark, sf_dir):
    """Per run of the learning curve: its rows and vocabulary, and whether the whole gradient vanishes."""
    docs = counted_split(spark, sf_dir)
    target = docs.filter((F.col("split") == "train") & (F.col("lang") == TARGET))
    todo = R.run_plan(target, W.CONDITIONS).orderBy("condition", "size", "seed").collect()
    fit = W.fit_curve(docs, SOURCE, TARGET, todo, SETTINGS, slope=1e-3)
    told = spark.createDataFrame([(i, r["condition"], r["size"], r["seed"], r["examples"], fit.model.train_rows[i]) for i, r in enumerate(todo)],
                                 "run INT, condition STRING, size INT, seed INT, examples BIGINT, train_rows BIGINT")
    found = G.slopes(fit.rows, fit.model).groupBy("run").agg(F.count("*").alias("n_terms"), F.sum("df").alias("sum_df"), (F.max(F.abs("slope")) < SETTLED).alias("settled"))
    return found.join(F.broadcast(told), "run").select("condition", "size", "seed", "examples", "train_rows", "n_terms", "sum_df", "settled")


# Run records --------------------------------------------------------------------------------


@query
def run_plan(spark, sf_dir):
    train = split_corpus(spark, sf_dir).filter((F.col("split") == "train") & (F.col("lang") == SOURCE))
    return R.run_plan(train, W.CONDITIONS)


@query
def pending_runs(spark, sf_dir):
    records = event_runs(spark, sf_dir).filter(F.col("lang") == SOURCE)
    condition = F.when(F.col("condition") == "click", "target_only").when(F.col("condition") == "view", "source_first")
    finished = records.filter(F.col("n") % 2 == 1).withColumn("condition", condition).na.drop(subset=["condition"])
    train = split_corpus(spark, sf_dir).filter((F.col("split") == "train") & (F.col("lang") == SOURCE))
    return R.pending_runs(R.run_plan(train, W.CONDITIONS), finished)


@query
def collect_runs(spark, sf_dir):
    root = new_path(spark, "runs")
    runs = mode_runs(spark, sf_dir)
    J.write_runs(runs, root, ["mode", "seed"], [])
    # Baselines have no seed: one record per mode, in a folder of their own.
    J.write_runs(runs.filter(F.col("seed") == 42).drop("seed"), f"{root}/baseline", ["mode"], [])
    back = J.read_runs(spark, root)
    seed = F.coalesce("seed", F.lit(-1)).alias("seed")
    return rounded(back.select("mode", seed, "lang", "n", "accuracy", "f1"), "accuracy", "f1")


@query
def collect_curve_runs(spark, sf_dir):
    root = new_path(spark, "curve")
    J.write_runs(event_runs(spark, sf_dir), root, ["condition", "size", "seed"], [])
    back = J.read_curve_runs(spark, root)
    return rounded(back.select("condition", "size", "seed", "lang", "n", "f1"), "f1")


def listed(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


@query
def seed_summary(spark, sf_dir):
    rows = R.collect_results(mode_runs(spark, sf_dir))
    figures = ["accuracy_mean", "accuracy_std", "f1_mean", "f1_std"]
    return rows.select("mode", "lang", "n", "train_samples", *[r6(c).alias(c) for c in figures], "runs", listed("seeds"))


@query
def curve_summary(spark, sf_dir):
    rows = R.curve_summary(event_runs(spark, sf_dir))
    scores = F.array_join(F.transform("scores", lambda v: F.floor(v * 1000).cast("string")), ",").alias("scores")
    return rows.select("condition", "size", "lang", r6("mean").alias("mean"), r6("std").alias("std"), "runs", listed("seeds"), scores)


def size_summary(spark, sf_dir) -> DataFrame:
    return R.seed_summary(event_runs(spark, sf_dir).filter(F.col("lang") == TARGET), ["condition", "size"], "f1")


@query
def curve_band(spark, sf_dir):
    other = event_runs(spark, sf_dir).filter((F.col("lang") == TARGET) & (F.col("condition") == "signup"))
    band = R.curve_band(size_summary(spark, sf_dir), other.select(F.avg("f1")).scalar())
    return rounded(band, "mean", "lo", "hi", "zero_shot")


@query
def condition_diff(spark, sf_dir):
    return R.condition_diff(size_summary(spark, sf_dir), "click", "view")


@query
def curve_table(spark, sf_dir):
    summary = R.curve_summary(event_runs(spark, sf_dir).filter((F.col("condition") != "view") | (F.col("size") != 250)))
    return R.curve_table(summary, "click", "view", TARGET, SOURCE)


@query
def results_table(spark, sf_dir):
    gap = (F.col("mode") == "error") & (F.col("model") == "linear") & (F.col("lang") == TARGET)
    rows = R.collect_results(mode_runs(spark, sf_dir, "model").filter(~gap), ["mode", "model", "lang"])
    return R.results_table(rows, ["mode", "model"], "lang", [SOURCE, TARGET], "f1")


@query
def accuracy_table(spark, sf_dir):
    rows = R.collect_results(mode_runs(spark, sf_dir, "model"), ["mode", "model", "lang"])
    return R.results_table(rows, ["mode", "model"], "lang", [SOURCE, TARGET], "accuracy")


@query
def model_rows(spark, sf_dir):
    return R.model_rows(mode_runs(spark, sf_dir)).withColumn("seed", big("seed"))


@query
def history(spark, sf_dir):
    """Training histories written as JSON arrays with mixed rows, read back and evaluated."""
    log = event_log(spark, sf_dir).select(F.col("run").alias("mode"), F.lit(42).alias("seed"), "epoch", "score")
    step = F.col("epoch").cast("long") * 2
    mixed = F.array(
        F.struct(step.alias("step"), F.lit(None).cast("double").alias("eval_f1"), (1 / F.col("score")).alias("loss")),
        F.struct((step + 1).alias("step"), F.col("score").alias("eval_f1"), F.lit(None).cast("double").alias("loss")),
    )
    rows = log.select("mode", "seed", F.col("epoch").cast("double").alias("epoch"), F.inline(mixed))
    root = new_path(spark, "history")
    J.write_history(rows, root, ["mode", "seed"])
    back = J.read_history(spark, root, "*.txt")
    sizes = back.groupBy("mode").agg(F.count("*").alias("n"), F.count("eval_f1").alias("evaluations"))
    best = R.best_epoch(back, ["mode"]).withColumn("best_epoch", big("best_epoch"))
    return rounded(sizes.join(best, "mode"), "best_score")


@query
def best_epoch(spark, sf_dir):
    rows = R.best_epoch(event_log(spark, sf_dir), value="score")
    return rounded(rows.withColumn("best_epoch", big("best_epoch")), "best_score")


@query
def early_stop(spark, sf_dir):
    rows = R.early_stop(event_log(spark, sf_dir), patience=2)
    return rows.withColumn("stop_epoch", big("stop_epoch"))


@query
def early_stop_margin(spark, sf_dir):
    rows = R.early_stop(event_log(spark, sf_dir), patience=3, min_delta=0.05, mode="min")
    return rows.withColumn("stop_epoch", big("stop_epoch"))
