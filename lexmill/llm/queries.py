"""The registered queries of the operators of this folder: whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import (
    chat, collocations, decontaminate, licenses, line_dedup, mixing, near_dedup, pieces, quality, resample, topk, toxicity, url_rules,
)
from lexmill.llm.common import crc_rest, table
from lexmill.sources.workdir import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_rest("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_rest("doc_id", 5) == 0
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_LIST = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_LIST)


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.base)
    joined = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m.word)).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m.word)).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)).alias("score"),
    )


@query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the conversations; ``n_right`` counts lines whose role is the table's."""
    known = materialize(chat.transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    held_out = crc_rest("conv_id", 5) == 0
    model = chat.fit(known.filter(~held_out))
    parsed = chat.parse(known, model)
    truth = F.flatten(F.transform(F.arrays_zip("roles", "counts"), lambda t: F.array_repeat(t.roles, t.counts)))
    found = F.transform("states", lambda s: F.element_at(F.array(*[F.lit(r) for r in chat.ROLES]), (F.floor(s / 2) + 1).cast("int")))
    rows = parsed.join(known.select("conv_id", "piece", truth.alias("truth")), ["conv_id", "piece"])
    right = F.aggregate(F.zip_with(found, "truth", lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select(
        "conv_id",
        "piece",
        held_out.alias("held_out"),
        F.size("truth").cast("long").alias("n_lines"),
        right.alias("n_right"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: t.role).alias("roles"),
        "rendered",
    )


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op9_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_path)


@query
def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
