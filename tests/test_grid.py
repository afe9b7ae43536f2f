import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import grams, newton

from lexmill.operators import features as V, grid as G, linear as M

WORDS = "good bad fine poor film plot great awful long short cast song".split()


def texts(n, seed=1):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(random.random() < 0.4)
        pool = WORDS[: 8 + 2 * label] if random.random() < 0.7 else WORDS[4 * label :]
        rows.append((i, " ".join(random.choice(pool, random.integers(0, 12))), label, int(random.integers(0, 3))))
    return rows


def reference(rows, size):
    """Vocabulary, matrix and labels of one run, counted by hand."""
    counts = [grams(t) for _, t, _ in rows]
    total = {}
    for c in counts:
        for g in c:
            total[g] = total.get(g, 0) + 1
    names = sorted(sorted(total, key=lambda g: (-total[g], g))[:size])
    raw = np.array([[c.count(g) for g in names] for c in counts], float)
    df = (raw > 0).sum(axis=0)
    weights = np.where(raw > 0, 1 + np.log(np.where(raw > 0, raw, 1)), 0) * (np.log((1 + len(rows)) / (1 + df)) + 1)
    norm = np.sqrt((weights**2).sum(axis=1, keepdims=True))
    return names, weights / np.where(norm > 0, norm, 1), np.array([y for _, _, y in rows])


@pytest.fixture(scope="module")
def grid(spark):
    rows = texts(120)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, label INT, part INT").repartition(5)
    part = F.col("part")
    runs = F.filter(F.array(F.when(part == 0, 0), F.when(part == 1, 1), F.when(part < 2, 2), F.lit(3)), lambda r: r.isNotNull())
    counted = V.counted_docs(docs.withColumn("runs", runs), ["label", "part", "runs"])
    members = [[r[:3] for r in rows if keep(r[3])] for keep in (lambda p: p == 0, lambda p: p == 1, lambda p: p < 2, lambda p: True)]
    return counted, members


@pytest.mark.parametrize("cells, balanced", [(1 << 24, True), (60, False)])
def test_every_run_matches_newton(grid, cells, balanced):
    """Runs that share rows, fitted together or in groups, each with its own vocabulary."""
    counted, members = grid
    model = G.fit_grid(counted, 4, M.TfidfModel(max_features=25, balanced=balanced), slope=1e-7, cells=cells)
    assert model.train_rows == [len(m) for m in members]
    for run, rows in enumerate(members):
        names, matrix, y = reference(rows, 25)
        weights = np.array([len(y) / (2 * (y == c).sum()) if balanced else 1.0 for c in y])
        beta = newton(matrix, y, weights)
        got = {r["term"]: r["coef"] for r in model.terms.filter(F.col("run") == run).collect()}
        assert sorted(got) == names
        assert np.allclose([got[t] for t in names], beta[:-1], atol=1e-5) and abs(model.intercepts[run] - beta[-1]) < 1e-5


def test_passes_do_not_add_up_over_runs(grid):
    counted, _ = grid
    settings = M.TfidfModel(max_features=25)
    joint = G.fit_grid(counted, 4, settings).passes
    single = [G.fit_grid(counted.withColumn("runs", F.transform(F.filter("runs", lambda r: r == i), lambda r: r - i)), 1, settings).passes for i in (0, 3)]
    assert max(single) <= joint < 2 * max(single)


def test_fit_and_scores_equal_the_single_fit(grid):
    counted, _ = grid
    model = G.fit_grid(counted, 4, M.TfidfModel(max_features=25), slope=1e-7)
    scored = G.score_grid(counted, model, ["label"]).collect()
    assert len(scored) == 4 * 120
    for run in (0, 2):
        alone = M.fit_counted(counted.filter(F.array_contains("runs", run)), M.TfidfModel(max_features=25, tolerance=1e-12))
        z = {r["doc_id"]: r["z"] for r in M.score_counted(counted, alone, ["label"]).collect()}
        got = {r["doc_id"]: r for r in scored if r["run"] == run}
        assert all(abs(got[i]["z"] - z[i]) < 1e-4 and got[i]["pred"] == (got[i]["z"] > 0) for i in z)


def test_partitions_do_not_matter(grid):
    counted, _ = grid
    got = []
    for n in (1, 7):
        model = G.fit_grid(counted.repartition(n), 4, M.TfidfModel(max_features=25), slope=1e-6)
        got.append([r["coef"] for r in model.terms.orderBy("run", "idx").collect()])
    assert np.allclose(got[0], got[1], atol=1e-5)


def test_unfit_runs_are_refused(grid):
    counted, _ = grid
    with pytest.raises(ValueError, match="run 0"):
        G.fit_grid(counted.filter("label = 1"), 4)
    with pytest.raises(ValueError, match="run 4"):
        G.fit_grid(counted, 5)
    with pytest.raises(ValueError, match="no terms"):
        G.fit_grid(counted.withColumn("terms", F.slice("terms", 1, 0)), 4)


def test_slopes_vanish_at_the_optimum_and_only_there(grid):
    """All terms of every run, without a join of the rows' terms, in groups of runs or all at once."""
    counted, _ = grid
    model = G.fit_grid(counted, 4, M.TfidfModel(max_features=25), slope=1e-7)
    for cells in (1, 1 << 24):
        found = G.slopes(counted, model, cells=cells)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        assert len(rows) == model.terms.count() and max(abs(r["slope"]) for r in rows) < 1e-6
    model.intercepts = model.intercepts + 0.5
    assert max(abs(r["slope"]) for r in G.slopes(counted, model).collect()) > 1e-3


def test_a_pass_has_as_many_tasks_as_run_at_a_time(spark, grid, monkeypatch):
    """However many splits the blocks have, what the tasks of a pass hand on does not grow."""
    counted, _ = grid
    kind, made, most, seen = type(counted), G.blocks, spark.sparkContext.defaultParallelism, []
    plain = kind.repartition

    def watched(self, *args):
        seen.append(self.rdd.getNumPartitions())
        return plain(self, *args)

    monkeypatch.setattr(G, "blocks", lambda *args: plain(made(*args), 3 * most))
    monkeypatch.setattr(kind, "repartition", watched)
    assert G.fit_grid(counted, 4, M.TfidfModel(max_features=25), slope=1.0).passes == len(seen)
    assert max(seen) <= most


def test_a_direction_is_that_of_the_loop_over_the_steps():
    """Also after the oldest steps have given way."""
    random = np.random.default_rng(2)
    half = random.normal(size=(30, 30))
    curve = half @ half.T + np.eye(30)
    diagonal, run = np.diag(curve).copy(), G.Descent(np.diag(curve).copy(), memory=7)
    pairs = []
    for _ in range(12):
        moved = random.normal(size=30) * 10.0 ** random.integers(-4, 2)
        run.remember(moved, curve @ moved)
        pairs = [*pairs, (moved, curve @ moved)][-7:]
    slopes = random.normal(size=30)
    out, shares = slopes.copy(), []
    for moved, turned in reversed(pairs):
        shares.append(moved @ out / (moved @ turned))
        out -= shares[-1] * turned
    moved, turned = pairs[-1]
    out *= (moved @ turned) / (turned @ (turned / diagonal)) / diagonal
    for (moved, turned), share in zip(pairs, reversed(shares)):
        out += (share - turned @ out / (moved @ turned)) * moved
    assert np.allclose(run.bent(slopes), out, rtol=1e-3, atol=1e-4 * np.abs(out).max())
    assert len(run.moves) == 7 and run.bent(slopes) @ slopes > 0


def test_a_run_remembers_enough_steps_for_a_badly_shaped_loss():
    """A quadratic loss with 25 different curvatures over four powers of ten."""
    curve = np.repeat(np.geomspace(1, 1e4, 25), 8)
    passes = []
    for run in (G.Descent(np.ones(200)), G.Descent(np.ones(200), memory=10)):
        passes.append(0)
        while run.slopes is None or np.abs(run.slopes).max() > 1e-3:
            gap = run.trial() - 1
            run.feed(0.5 * gap @ (curve * gap), curve * gap)
            passes[-1] += 1
    assert passes[0] < 0.6 * passes[1]


def test_runs_that_share_most_rows_follow_the_largest():
    shared = np.array([[100, 90, 80, 20], [90, 90, 75, 10], [80, 75, 80, 5], [20, 10, 5, 20]])
    assert G.followed(shared) == {0: [1, 2]}
    # One follower alone spares too little.
    assert G.followed(shared[np.ix_([0, 1, 3], [0, 1, 3])]) == {}
    assert G.followed(np.full((4, 4), 7)) == {0: [1, 2, 3]}


@pytest.fixture(scope="module")
def overlapping(spark):
    """Five runs that share nine tenths of their rows, and a small one."""
    rows = texts(200, seed=5)
    held = [[r for r in rows if r[0] % 20 not in (i, i + 5)] if i < 5 else [r for r in rows if r[0] % 20 < 4] for i in range(6)]
    runs = {r[0]: [i for i in range(6) if r in held[i]] for r in rows}
    docs = spark.createDataFrame([(*r[:3], runs[r[0]]) for r in rows], "doc_id LONG, text STRING, label INT, runs ARRAY<INT>").repartition(4)
    return V.counted_docs(docs, ["label", "runs"]), held


def test_followers_match_newton_and_spare_passes(overlapping, monkeypatch):
    counted, held = overlapping
    one_pass, widths = G.one_pass, []
    monkeypatch.setattr(G, "one_pass", lambda *a, **b: widths.append(len(a[5])) or one_pass(*a, **b))
    model = G.fit_grid(counted, 6, M.TfidfModel(max_features=40), slope=1e-7)
    for run, rows in enumerate(held):
        names, matrix, y = reference([r[:3] for r in rows], 40)
        beta = newton(matrix, y, np.array([len(y) / (2 * (y == c).sum()) for c in y]))
        got = {r["term"]: r["coef"] for r in model.terms.filter(F.col("run") == run).collect()}
        assert sorted(got) == names
        assert np.allclose([got[t] for t in names], beta[:-1], atol=1e-5) and abs(model.intercepts[run] - beta[-1]) < 1e-5
    # The curvature of all runs, then the first and the small one alone, then those that follow.
    assert widths[:2] == [6, 2] and max(widths[1:]) <= 5
    alone = list(widths)
    widths.clear()
    monkeypatch.setattr(G, "followed", lambda shared: {})
    G.fit_grid(counted, 6, M.TfidfModel(max_features=40), slope=1e-7)
    assert sum(alone) < sum(widths)


def test_blocks_hold_rows_of_the_same_runs_side_by_side(grid, monkeypatch):
    counted, _ = grid
    made, blocks = [], G.blocks
    monkeypatch.setattr(G, "blocks", lambda rows, *a: made.append(blocks(rows.coalesce(1), *a)) or made[-1])
    G.fit_grid(counted, 4, M.TfidfModel(max_features=25), slope=1.0)
    for row in made[0].select("mask").collect():
        mask = np.frombuffer(row["mask"], np.uint8).reshape(-1, 4)
        changes = (mask[1:] != mask[:-1]).any(axis=1).sum()
        assert len(mask) > 10 and changes == len(np.unique(mask, axis=0)) - 1


@pytest.mark.parametrize("guess", [None, 1 << 40])
def test_vocabularies_leave_out_what_cannot_win(spark, monkeypatch, guess):
    """Exact with the usual guess of the border and with one that is far too high."""
    random = np.random.default_rng(4)
    weights = 1 / np.arange(1, 3001)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(i, " ".join(random.choice(words, 60, p=weights / weights.sum())), [[0, 2], [1, 2], [3]][(i > 150) + (i > 292)]) for i in range(300)]
    counted = V.counted_docs(spark.createDataFrame(rows, "doc_id LONG, text STRING, runs ARRAY<INT>").repartition(3), ["runs"])
    sizes = {r: sum(r in row[2] for row in rows) for r in range(4)}
    made, sums, usual = [], V.partial_sums, V._guess
    monkeypatch.setattr(V, "partial_sums", lambda *a: made.append(sums(*a)) or made[-1])
    if guess:
        monkeypatch.setattr(V, "_guess", lambda total, n: guess)
    got = G.vocabularies(counted, sizes, 50).collect()
    for r in range(4):
        tf, df = {}, {}
        for _, text, runs in rows:
            if r in runs:
                for g, n in zip(*np.unique(grams(text), return_counts=True)):
                    tf[g], df[g] = tf.get(g, 0) + n, df.get(g, 0) + 1
        best = sorted(tf, key=lambda g: (-tf[g], g))[:50]
        assert {g: (tf[g], df[g]) for g in best} == {x["term"]: (x["tf"], x["df"]) for x in got if x["run"] == r}
    if not guess:
        # The runs of the two large sets are found among few terms; run 3 needs all of its own.
        assert usual is V._guess
        all_terms = sums(counted).select("term").distinct().count()
        assert made[0].filter("_set <> 3").select("term").distinct().count() < all_terms / 4
