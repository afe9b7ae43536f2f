"""Reproducible splits, subsets and balancing, keyed by a hash of the row key.

The order of a stratum is the md5 of seed and key, then the key. Selecting the first ``k`` rows
of it needs no ranking of the whole stratum, which one task would have to do. Rows are counted
by stratum and the first two hash digits; running counts tell which of these 256 buckets holds
rank ``k``. The keys of that bucket are set aside, counted by five digits, and only the rows of
one such narrow bucket (a millionth of the stratum) are ranked to find the last row taken. The
selection itself is a comparison with that row, so the wide data is read once and never
shuffled. Keys must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.sources.workdir import materialize

COARSE_DIGITS, FINE_DIGITS = 2, 5
SALTS = 64
SPLITS = ("train", "val", "test")


def order_hash(key: Column, seed: Column | int) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), key.cast("string")))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    """NULL-safe equality on all columns, so that a NULL stratum is a stratum."""
    test = F.lit(True)
    for name in columns:
        test = test & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return test


def last_taken(
    rows: DataFrame,
    strata: Sequence[str],
    key: str,
    quotas: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The row of rank ``k`` per stratum and target: ``strata, target, cut_hash, cut_key``.

    ``rows`` holds the strata, the key and ``_hash``; it is read twice, keys and strata only.
    ``quotas`` gets the stratum sizes (``strata, n``) and returns ``strata, target, k`` with
    ``k <= n``; a target with ``k = 0`` yields no row. Runs jobs, which write the counts, the rows
    of the buckets that were hit, and the cuts, so that a join with these is a broadcast.
    """
    strata = list(strata)
    rows = rows.select(
        *strata, F.col(key).alias("_key"), "_hash",
        F.substring("_hash", 1, COARSE_DIGITS).alias("_p"), F.substring("_hash", 1, FINE_DIGITS).alias("_q"),
    )
    coarse = materialize(rows.groupBy(*strata, "_p").agg(F.count("*").alias("_n")), "coarse-counts")
    targets = quotas(coarse.groupBy(*strata).agg(F.sum("_n").alias("n"))).withColumnRenamed("k", "_rank")
    hits = _bucket_of_rank(coarse, targets, strata, "_p")

    # From here on only the rows of the buckets that were hit are looked at.
    wanted = hits.select(*strata, "_p").distinct()
    near = rows.alias("r").join(wanted.alias("w"), _same("r", "w", [*strata, "_p"]), "left_semi")
    near = materialize(near, "near-rows")
    fine = near.groupBy(*strata, "_p", "_q").agg(F.count("*").alias("_n"))
    narrow = _bucket_of_rank(fine, hits, [*strata, "_p"], "_q")
    place = F.row_number().over(Window.partitionBy(*strata, "_q").orderBy("_hash", "_key"))
    ranked = near.select(*strata, "_q", "_hash", "_key", place.alias("_rank"))
    cut = (
        ranked.alias("r")
        .join(narrow.alias("h"), _same("r", "h", [*strata, "_q", "_rank"]))
        .select(*[F.col(f"h.{s}") for s in strata], "h.target", F.col("r._hash").alias("cut_hash"), F.col("r._key").alias("cut_key"))
    )
    return materialize(cut, "cuts")


def _bucket_of_rank(counts: DataFrame, targets: DataFrame, within: Sequence[str], bucket: str) -> DataFrame:
    """``within, target, bucket, _rank``: the bucket holding each target's rank, and its rank there."""
    ordered = Window.partitionBy(*within).orderBy(bucket)
    placed = counts.withColumn("_upto", F.sum("_n").over(ordered)).withColumn("_before", F.col("_upto") - F.col("_n"))
    rank = F.col("t._rank")
    here = _same("c", "t", within) & (rank > F.col("c._before")) & (rank <= F.col("c._upto"))
    return placed.alias("c").join(targets.alias("t"), here).select(
        *[F.col(f"c.{w}") for w in within], "t.target", f"c.{bucket}", (rank - F.col("c._before")).alias("_rank")
    )


def _taken(hash_: Column, key: Column, cut_hash: Column, cut_key: Column) -> Column:
    return (hash_ < cut_hash) | ((hash_ == cut_hash) & (key <= cut_key))


# The quota tables below have one row per stratum; their windows see nothing else.


def _shares(sizes: DataFrame, group: Sequence[str], label: str, total: str, size: str, wanted: str, out: str, lone_first: bool) -> DataFrame:
    """Integer share of ``wanted`` per class, by largest remainder, ties by label.

    ``lone_first`` says whether a class of a single row is the first or the last to receive one
    of the rows left over after rounding down: it belongs to the training part.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    product = F.col(size) * F.col(wanted)
    lone = (F.col("n") < 2).cast("int")
    shared = sizes.withColumn("_base", F.expr(f"{size} * {wanted} div {total}")).withColumn("_rem", product % F.col(total))
    shared = shared.withColumn("_extra", F.col(wanted) - F.sum("_base").over(whole)).withColumn(
        "_place",
        F.row_number().over(whole.orderBy(lone.desc() if lone_first else lone.asc(), F.col("_rem").desc(), F.col(label))),
    )
    return shared.withColumn(out, F.col("_base") + (F.col("_place") <= F.col("_extra")).cast("long")).drop(
        "_base", "_rem", "_extra", "_place"
    )


def _group_total(sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    return sizes.withColumn("_total", F.sum("n").over(whole))


def _with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` with one cut struct column per target name, NULL where nothing is taken."""
    wide = cuts.groupBy(*strata).agg(
        *[F.max(F.when(F.col("target") == name, F.struct("cut_hash", "cut_key"))).alias(f"_cut_{name}") for name in names]
    )
    joined = df.alias("d").join(wide.alias("w"), _same("d", "w", strata), "left")
    return joined.select("d.*", *[F.col(f"w._cut_{name}") for name in names])


def _within(cut: str, key: str) -> Column:
    inside = _taken(F.col("_hash"), F.col(key), F.col(f"{cut}.cut_hash"), F.col(f"{cut}.cut_key"))
    return F.coalesce(inside, F.lit(False))


def holdout_split(
    df: DataFrame,
    fraction: float,
    seed: int = 42,
    key: str = "doc_id",
    label: str = "label",
    group: Sequence[str] = (),
    names: tuple[str, str] = ("train", "val"),
) -> DataFrame:
    """Adds ``split``: ``ceil(fraction * n)`` rows held out, classes in their own proportion.

    With ``group`` columns every group is split on its own.
    """
    strata = [*group, label]

    def quotas(sizes: DataFrame) -> DataFrame:
        sized = _group_total(sizes, group).withColumn("_want", F.ceil(F.lit(float(fraction)) * F.col("_total")))
        sized = _shares(sized, group, label, "_total", "n", "_want", "k", lone_first=False)
        return sized.select(*strata, F.lit("held").alias("target"), "k")

    hashed = df.withColumn("_hash", order_hash(F.col(key), seed))
    cuts = last_taken(hashed.select(*strata, key, "_hash"), strata, key, quotas)
    marked = _with_cuts(hashed, cuts, strata, ["held"])
    split = F.when(_within("_cut_held", key), names[1]).otherwise(names[0])
    return marked.select(*df.columns, split.alias("split"))


def stratified_split(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
    key: str = "doc_id",
    label: str = "label",
    group: Sequence[str] = (),
) -> DataFrame:
    """Adds ``split`` with train, val and test, stratified by label within each group.

    ``floor(train * n)`` rows train; the rest is divided between val and test by their ratio.
    """
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1.0")
    strata = [*group, label]
    val_ratio = val / (val + test) if val + test else 0.0

    def quotas(sizes: DataFrame) -> DataFrame:
        sized = _group_total(sizes, group).withColumn("_want", F.floor(F.lit(float(train)) * F.col("_total")))
        sized = _shares(sized, group, label, "_total", "n", "_want", "_train", lone_first=True)
        sized = (
            sized.withColumn("_left", F.col("n") - F.col("_train"))
            .withColumn("_rest", F.greatest(F.col("_total") - F.col("_want"), F.lit(1)))
            .withColumn("_want_val", F.floor(F.lit(float(val_ratio)) * (F.col("_total") - F.col("_want"))))
        )
        sized = _shares(sized, group, label, "_rest", "_left", "_want_val", "_val", lone_first=False)
        ends = F.array(
            F.struct(F.lit("train").alias("target"), F.col("_train").alias("k")),
            F.struct(F.lit("val").alias("target"), (F.col("_train") + F.col("_val")).alias("k")),
        )
        return sized.select(*strata, F.inline(ends))

    hashed = df.withColumn("_hash", order_hash(F.col(key), seed))
    cuts = last_taken(hashed.select(*strata, key, "_hash"), strata, key, quotas)
    marked = _with_cuts(hashed, cuts, strata, ["train", "val"])
    split = F.when(_within("_cut_train", key), "train").when(_within("_cut_val", key), "val").otherwise("test")
    return marked.select(*df.columns, split.alias("split"))


def balanced_sample(
    df: DataFrame, strata: Sequence[str] = ("lang",), seed: int = 42, key: str = "doc_id"
) -> DataFrame:
    """Every stratum cut down to the size of the smallest one."""
    strata = list(strata)

    def quotas(sizes: DataFrame) -> DataFrame:
        smallest = F.min("n").over(Window.partitionBy(F.lit(1)))
        return sizes.select(*strata, F.lit("kept").alias("target"), smallest.alias("k"))

    hashed = df.withColumn("_hash", order_hash(F.col(key), seed))
    cuts = last_taken(hashed.select(*strata, key, "_hash"), strata, key, quotas)
    marked = _with_cuts(hashed, cuts, strata, ["kept"])
    return marked.filter(_within("_cut_kept", key)).select(*df.columns)


def combined(
    df: DataFrame,
    languages: Sequence[str],
    split: str | None = None,
    balance: bool = True,
    seed: int = 42,
    key: str = "doc_id",
    lang: str = "lang",
) -> DataFrame:
    """Rows of the given languages (and split) with a ``language`` column, balanced if asked.

    One frame holds all languages, so this is a filter rather than a union of reads.
    """
    rows = df.filter(F.col(lang).isin(*languages))
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    if balance:
        rows = balanced_sample(rows, [lang], seed, key)
    return rows.withColumnRenamed(lang, "language")


def shuffled(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Rows in seeded order."""
    return df.orderBy(order_hash(F.col(key), seed), key)


def capped(df: DataFrame, max_rows: int | None, seed: int | None = 42, key: str = "doc_id") -> DataFrame:
    """The first ``max_rows`` rows: of the seeded order, or of key order when ``seed`` is None.

    They come in no particular order. The seeded order is cut as splits are, by a comparison with
    the last row taken, so any number of rows may be asked for; this runs jobs.
    """
    if max_rows is None:
        return df
    if seed is None:
        return first_per_bucket(df.withColumn("_all", F.lit(0)), "_all", max_rows, key).select(*df.columns)
    if max_rows < 1:
        return df.limit(0)
    rows = df.withColumn("_all", F.lit(0)).withColumn("_hash", order_hash(F.col(key), seed))

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.select("_all", F.lit("taken").alias("target"), F.least("n", F.lit(max_rows).cast("long")).alias("k"))

    cut = last_taken(rows, ["_all"], key, quotas).head()
    if cut is None:
        return df.limit(0)
    return rows.filter(_taken(F.col("_hash"), F.col(key), F.lit(cut["cut_hash"]), F.lit(cut["cut_key"]))).select(*df.columns)


def nested_levels(
    df: DataFrame, sizes: Sequence[int], seeds: Sequence[int], key: str = "doc_id"
) -> DataFrame:
    """``seed, level`` and the columns of ``df``: the smallest of ``sizes`` that takes the row.

    The subset of a size is ``level <= size``, so every row is held once per seed however many
    sizes there are. Rows beyond the largest size are left out; a size beyond the data takes all.
    """
    wanted = sorted(set(sizes))

    def quotas(totals: DataFrame) -> DataFrame:
        size = F.explode(F.array(*[F.lit(s).cast("long") for s in wanted])).alias("target")
        return totals.select("seed", "n", size).select("seed", "target", F.least("target", "n").alias("k"))

    seeded = df.select(F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"), "*")
    seeded = seeded.withColumn("_hash", order_hash(F.col(key), F.col("seed")))
    cuts = last_taken(seeded.select("seed", key, "_hash"), ["seed"], key, quotas)
    # The cuts of a seed in one array, one entry per size: a row compares itself with each.
    levels = cuts.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("target", "cut_hash", "cut_key"))).alias("_cuts"))
    joined = seeded.alias("d").join(levels.alias("c"), F.col("d.seed") == F.col("c.seed"))
    inside = F.filter("c._cuts", lambda c: _taken(F.col("d._hash"), F.col(f"d.{key}"), c["cut_hash"], c["cut_key"]))
    placed = joined.select("d.seed", F.get(F.transform(inside, lambda c: c["target"]), F.lit(0)).alias("level"), *[F.col(f"d.{c}") for c in df.columns])
    return placed.filter(F.col("level").isNotNull())


def nested_subsets(
    df: DataFrame, sizes: Sequence[int], seeds: Sequence[int], key: str = "doc_id"
) -> DataFrame:
    """``seed, size`` and the columns of ``df``: the first ``size`` rows of each seed's order.

    Larger subsets contain the smaller ones of the same seed.
    """
    rows = nested_levels(df, sizes, seeds, key)
    taking = F.filter(F.array(*[F.lit(s).cast("long") for s in sorted(set(sizes))]), lambda s: s >= F.col("level"))
    return rows.select("seed", F.explode(taking).alias("size"), *df.columns)


def first_per_bucket(df: DataFrame, bucket: str, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows of every bucket in key order, numbered in ``rn``.

    A bucket may hold most rows, so it is first cut in ``SALTS`` parts by a hash of the key, each
    ranked by itself; only their first ``n`` rows meet for the final ranking.
    """
    salt = F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS))
    part = F.row_number().over(Window.partitionBy(bucket, "_salt").orderBy(key))
    few = df.withColumn("_salt", salt).withColumn("rn", part).filter(F.col("rn") <= n).drop("_salt", "rn")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(key))
    return few.withColumn("rn", rank).filter(F.col("rn") <= n)
