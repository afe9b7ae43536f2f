"""URL filters by association rules.

A URL is a set of tokens: its host's suffixes, the segments of its path with their place, the names
of its query, its scheme and whether it has a fragment; numbers count as one token. Spark's FP-growth
mines the token combinations of labelled URLs. Combinations of at most ``max_tokens`` that lead to
"block" with enough support and confidence are rules. Rules are found by an inverted index: a rule
stands under its token that the fewest rules share, a URL's tokens meet the rules there, and a rule matches if the URL has
all its tokens. All steps are Spark expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.sources.workdir import materialize

BLOCK = "=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """``max_urls`` bounds the labelled URLs that are mined; the rest are judged all the same."""

    min_support: float = 0.01
    min_confidence: float = 0.9
    max_tokens: int = 3
    max_urls: int = 200_000


def address(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path) of each page."""
    rest = address(F.col("url"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest of (verdict, host, path) rules that fits, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    return F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def tokens() -> Column:
    """The distinct tokens of a page with host and path; none for a page without host."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(parts, -i, i), ".")))
    number = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    segments = F.filter(F.transform(F.split("path", "/"), lambda s, i: F.when(s != "", F.concat(F.lit("p"), i.cast("string"), F.lit(":"), number(s)))), lambda s: s.isNotNull())
    query = F.regexp_extract(F.col("url"), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda s: F.when(s != "", F.concat(F.lit("q:"), F.substring_index(s, "=", 1)))), lambda s: s.isNotNull())
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index("url", "://", 1)))
    fragment = F.when(F.instr(F.col("url"), "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(suffixes, segments, names, scheme, fragment))
    return F.when(F.col("host") != "", every).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, mining: Mining) -> DataFrame:
    """(tokens, confidence, support) of the rules mined from (page_id, tokens, block). Runs jobs.

    Without labelled URLs there is no rule.
    """
    rows = labelled.filter(F.size("tokens") > 0).orderBy(F.xxhash64("page_id"), "page_id").limit(mining.max_urls)
    rows = rows.withColumn("items", F.when(F.col("block"), F.array_append("tokens", BLOCK)).otherwise(F.col("tokens")))
    rows = materialize(rows.select("items"), "labelled-urls")
    model = FPGrowth(itemsCol="items", minSupport=mining.min_support, minConfidence=mining.min_confidence).fit(rows)
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCK).filter(F.size("antecedent") <= mining.max_tokens)
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id of pages, given with their tokens, that some rule matches. Runs jobs."""
    rules = materialize(rules, "url-rules")
    # A rule stands under the one of its tokens that the fewest rules share.
    use = rules.select("tokens", F.explode("tokens").alias("token"))
    often = use.groupBy("token").agg(F.count("*").alias("n"))
    index = use.join(often, "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    met = pages.select("page_id", "tokens", F.explode("tokens").alias("token")).join(index.withColumnRenamed("tokens", "needed"), "token")
    return met.filter(F.size(F.array_except("needed", "tokens")) == 0).select("page_id").distinct()


def judge(pages: DataFrame, listed_rules: tuple[tuple[str, str, str], ...], mining: Mining = Mining()) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. Runs jobs.

    A page that a listed rule fits gets its verdict, and serves as labelled URL. Every other page is
    blocked if a mined rule matches its URL, and allowed if not. ``pages`` has page_id (unique) and url;
    other columns are not read. A null url, or one without ``://``, has an empty host and path, no
    tokens, and is allowed; rows without page_id are judged by listed rules only. An empty table gives
    no rows.
    """
    rows = with_parts(pages).withColumn("listed", listed(F.col("host"), F.col("path"), listed_rules))
    rows = rows.withColumn("tokens", tokens())
    known = F.col("listed.verdict").isNotNull()
    rules = mined_rules(rows.filter(known).select("page_id", "tokens", (F.col("listed.verdict") == "block").alias("block")), mining)
    hits = blocked(rows.filter(~known).select("page_id", "tokens"), rules)
    hits = hits.select(F.col("page_id").alias("_hit"))
    out = rows.drop("tokens").join(hits, (F.col("page_id") == F.col("_hit")) & ~known, "left")
    verdict = F.coalesce("listed.verdict", F.when(F.col("_hit").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))
