"""Expressions, metrics, kernels and grids against NumPy and hand-made cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabag.functions import expressions as e
from terrabag.operators import bags, folds, grid, kernels, metrics, stats


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(b, b * 100 + i, b % 2, [float(v) for v in rng.normal(b % 2, 1, 3)], float(i), float(b), b // 2) for b in range(6) for i in range(5 + b)]
    return spark.createDataFrame(rows, "bag_id long, cell_id long, label int, features array<double>, x double, y double, group_id long")


def matrix(cells):
    out = {}
    for r in cells.collect():
        out.setdefault(r.bag_id, []).append(r.features)
    return {k: np.array(v) for k, v in out.items()}


def test_rounding_is_half_to_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.0625), 3)).first()[0] == 0.062


def test_sigmoid_and_loss_do_not_overflow(spark):
    r = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "z double").select(e.sigmoid("z").alias("p"), e.log_loss("z", F.lit(1)).alias("l")).collect()
    assert [x.p for x in r] == [0.0, 0.5, 1.0]
    assert r[0].l == 1000.0 and r[2].l == 0.0


@pytest.mark.parametrize(("n", "q"), [(1, 4), (7, 5), (8, 8), (5, 9)])
def test_quantile_functions(spark, n, q):
    v = sorted(np.random.default_rng(n).normal(size=n).tolist())
    r = spark.createDataFrame([(v,)], "v array<double>").select(e.midpoint_quantiles("v", q).alias("m"), e.endpoint_quantiles("v", q).alias("e")).first()
    assert np.allclose(r.m, np.interp((np.arange(q) + 0.5) / q, (np.arange(n) + 0.5) / n, v))
    assert np.allclose(r.e, np.interp(np.linspace(0, 1, q), np.linspace(0, 1, n), v))


def test_ring(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1.0, 1.0, ring), (5.0, 1.0, ring), (2.0, 3.9, ring)], "x double, y double, ring array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(e.in_ring("x", "y", "ring")).collect()] == [True, False, True]


def test_perfect_and_one_class_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "label int, score double")
    assert metrics.roc_auc(df).first().auc == 1.0
    assert metrics.average_precision(df).first().average_precision == 1.0
    assert metrics.roc_auc(df.filter("label = 1")).first().auc is None


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 8
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in s[y == 1] for n in s[y == 0]])
    assert math.isclose(metrics.roc_auc(df).first().auc, want)


def test_metrics_of_empty_quadrants(spark):
    q = spark.createDataFrame([(0.5, 0, 4, 0, 3), (0.1, 3, 0, 4, 0), (0.9, 5, 5, 0, 0)], "threshold double, tp long, tn long, fp long, fn long")
    rows = metrics.metrics(q).collect()
    assert all(math.isfinite(v) for r in rows for v in r)
    assert rows[2].kappa == 1.0 and rows[2].mcc == 1.0 and rows[0].sensitivity == 0.0
    assert len(rows[0]) >= 51


def test_replicates_and_pairs(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3)], "g string, v double")
    r = metrics.replicate_summary(df, "v", "g", 3).first()
    assert math.isclose(r["mean"], 0.2) and r.ci_low < 0.1 and r.ci_high > 0.3
    rows = spark.createDataFrame([("M0", 1, 0.6), ("M0", 2, 0.5), ("M1", 1, 0.7), ("M1", 2, 0.55)], "method string, repeat int, auc double")
    p = metrics.paired_differences(rows, "M0", ["repeat"], "auc").first()
    assert p.pairs == 2 and math.isclose(p.mean_difference, 0.075)


def test_student_t():
    assert math.isclose(metrics.student_t_quantile(0.975, 1), 12.706204736, rel_tol=1e-8)
    assert math.isclose(metrics.student_t_quantile(0.975, 10), 2.228138852, rel_tol=1e-8)


def test_exact_gram_is_symmetric_and_positive(cells):
    m = matrix(cells)
    got = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(cells, cells, 1.3).collect()}
    full = np.array([[got[min(i, j), max(i, j)] for j in range(6)] for i in range(6)])
    want = np.array([[np.exp(-((m[i][:, None] - m[j][None]) ** 2).sum(-1) / (2 * 1.3**2)).mean() for j in range(6)] for i in range(6)])
    assert np.allclose(full, want) and np.linalg.eigvalsh(full).min() > -1e-9


def test_partial_embeddings_are_no_larger_than_cells(spark, monkeypatch):
    """Bags of few cells in a partition send the cells, not a sum each; both give the mean."""
    x = np.random.default_rng(5).normal(size=(3000, 2))
    bag = np.where(np.arange(3000) < 400, 0, np.arange(3000))  # one bag of 400 cells, others of one
    df = spark.createDataFrame([(int(b), v.tolist()) for b, v in zip(bag, x, strict=True)], "bag_id long, features array<double>")
    sent = []
    real = kernels._added_up
    monkeypatch.setattr(kernels, "_added_up", lambda part, *more: sent.append(part) or real(part, *more))
    w = kernels.fourier_weights(2, 64, 1.0, 3)
    got = {r.bag_id: r.embedding for r in kernels.embeddings(df, w).collect()}
    phi = np.concatenate([np.cos(x @ w.T), np.sin(x @ w.T)], axis=1) / 8.0
    assert len(got) == 2601 and all(np.allclose(got[b], phi[bag == b].mean(axis=0), atol=1e-12) for b in (0, 400, 2999))
    assert sent[0].agg(F.sum(F.size("s") + F.size("x"))).first()[0] <= 2600 * 2 + 4 * 128


@pytest.mark.parametrize("d,width", [(1, 30.0), (2, 4.0), (3, 1.0), (2, 1e4)])
def test_exact_gram_of_many_cells(spark, d, width):
    """Bags of many cells by their mean terms, or by tiles where the range is too wide, against NumPy."""
    rng = np.random.default_rng(d)
    x, bag = rng.uniform(0, width, (6000, d)), [f"b{i % 3}" for i in range(6000)]
    df = spark.createDataFrame([(b, i, v.tolist()) for i, (b, v) in enumerate(zip(bag, x, strict=True))], "bag_id string, cell_id long, features array<double>")
    sets = {b: x[np.array(bag) == b] for b in set(bag)}
    want = lambda a, b: np.exp(-0.5 * ((sets[a][:, None] - sets[b][None]) ** 2).sum(-1)).mean()
    assert (kernels._expansion(df, None, 1.0) is None) == (width > 1000)
    got = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(df, df, 1.0).collect()}
    assert len(got) == 6 and all(math.isclose(v, want(*p), abs_tol=1e-12) for p, v in got.items())
    both = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(df.filter("bag_id != 'b1'"), df.filter("bag_id != 'b0'"), 1.0, upper=False).collect()}
    assert both.keys() == {(a, b) for a in ("b0", "b2") for b in ("b1", "b2")} and all(math.isclose(v, want(*p), abs_tol=1e-12) for p, v in both.items())


@pytest.mark.parametrize("wide,n,times", [([True], 3000, 1), ([False, True], 4000, 3), ([True, True], 4000, 20)])
def test_exact_gram_of_cells_with_outliers(spark, monkeypatch, wide, n, times):
    """Cells in boxes meet without tiles of pairs of cells, against NumPy; repeated cells leave the means as they are."""
    monkeypatch.setattr(kernels, "_cell_tiles", None)
    rng = np.random.default_rng(n)
    x = np.where(wide, rng.normal(size=(n, 1)) + rng.standard_cauchy((n, len(wide))) ** 3 * 0.1, rng.uniform(0, 3, (n, len(wide))))
    bag = np.where(np.arange(n) < 50, "far", [f"b{i % 3}" for i in range(n)])
    x[:50, wide] += 1e7
    rows = spark.createDataFrame([(b, v.tolist()) for b, v in zip(bag, x, strict=True)], "bag_id string, features array<double>")
    df = rows.crossJoin(spark.range(times).withColumnRenamed("id", "cell_id")).repartition(3)
    sets = {b: x[bag == b] for b in set(bag)}
    want = {(a, b): np.exp(-0.5 * sum(np.subtract.outer(u, v) ** 2 for u, v in zip(sets[a].T, sets[b].T, strict=True)) / 0.81).mean() for a in sets for b in sets}
    got = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(df, df, 0.9).collect()}
    assert len(got) == 10 and all(math.isclose(v, want[p], abs_tol=1e-12) for p, v in got.items()) and got["b0", "far"] == 0 < got["far", "far"]
    both = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(df, df.filter("bag_id != 'b0'"), 0.9, upper=False).collect()}
    assert len(both) == 12 and all(math.isclose(v, want[p], abs_tol=1e-12) for p, v in both.items())


def test_distances_of_embeddings_meet_in_tiles(spark):
    v = np.random.default_rng(4).normal(size=(1500, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "bag_id long, embedding array<double>")
    got = kernels.embedding_distances(df)
    assert "NestedLoop" not in got._jdf.queryExecution().sparkPlan().toString()
    held = got.toPandas()
    assert len(held) == 1500 * 1501 // 2 and (held.bag_i <= held.bag_j).all() and not held.duplicated(["bag_i", "bag_j"]).any()
    assert np.allclose(held.value, np.linalg.norm(v[held.bag_i] - v[held.bag_j], axis=1), rtol=0, atol=1e-14)


def test_distances_of_embeddings_need_no_shuffle(spark, monkeypatch):
    """Vectors that a task can hold aren't copied to the pairs of tiles; rows are those of the tiles, for text ids and repeated ones too."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 3))
    ids = [f"b{i}" for i in rng.permutation(700)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "bag_id string, embedding array<double>")
    got = kernels.embedding_distances(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    held = sorted(map(tuple, got.collect()))
    twice = spark.createDataFrame([(1, [0.0, 1.0]), (0, [5.0, 5.0]), (1, [3.0, 5.0]), (2, [3.0, 5.0])], "bag_id int, embedding array<float>")
    assert sorted(map(tuple, kernels.embedding_distances(twice).select("bag_i", "bag_j", F.round("value", 3)).collect())) == [(0, 0, 0.0), (0, 1, 2.0), (0, 1, 6.403), (0, 2, 2.0), (1, 1, 0.0), (1, 1, 0.0), (1, 1, 5.0), (1, 1, 5.0), (1, 2, 0.0), (1, 2, 5.0), (2, 2, 0.0)]
    assert kernels.embedding_distances(df.limit(0)).isEmpty()
    monkeypatch.setattr(kernels, "HELD_BYTES", 1000)
    tiled = kernels.embedding_distances(df)
    assert "Exchange" in tiled._jdf.queryExecution().executedPlan().toString() and held == sorted(map(tuple, tiled.collect()))


def test_embeddings_agree_and_approximate(cells):
    w = kernels.fourier_weights(3, 6, 1.0, 1)
    a = {r.bag_id: r.embedding for r in kernels.embeddings(cells, w).collect()}
    b = {r.bag_id: r.embedding for r in kernels.small_embeddings(cells.repartition(5), w).collect()}
    assert all(np.allclose(a[k], b[k]) for k in b) and len(a) == len(b) == 6
    big = kernels.linear_gram(kernels.embeddings(cells, kernels.fourier_weights(3, 1000, 1.0, 1)))
    exact = {(r.bag_i, r.bag_j): r.value for r in kernels.exact_gram(cells, cells, 1.0).collect()}
    assert max(abs(r.value - exact[r.bag_i, r.bag_j]) for r in big.collect()) < 0.15


def test_wasserstein_of_a_shift(spark):
    rows = [(b, i, [float(i) + 3.0 * b]) for b in range(2) for i in range(7)]
    df = spark.createDataFrame(rows, "bag_id int, cell_id int, features array<double>")
    p = kernels.projections(df, np.array([[1.0]]))
    for order in (1, 2):
        d = {(r.bag_i, r.bag_j): r.value for r in kernels.sliced_wasserstein(p, order).collect()}
        assert math.isclose(d[0, 1], 3.0) and d[0, 0] == 0.0
    with pytest.raises(ValueError, match="1 or 2"):
        kernels.sliced_wasserstein(p, 3)


def test_bucket_sizes(spark):
    sizes = [10, 15, 23, 50, 73, 75, 100]
    df = spark.createDataFrame([(b, [float(i)]) for b, n in enumerate(sizes) for i in range(n)], "bag_id int, features array<double>")
    got = {r.bag_id: r.n for r in kernels.bucketed(kernels.projections(df, np.array([[1.0]])), 25).select("bag_id", F.size("v").alias("n")).collect()}
    assert got == {0: 23, 1: 23, 2: 23, 3: 73, 4: 73, 5: 75, 6: 100}


def test_zscore_uses_given_statistics(cells):
    train = cells.filter("bag_id < 3")
    z = stats.zscore(train, 3)
    x = np.array([r.features for r in z.collect()])
    assert np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)


def test_audit(spark):
    rows = [(1, "a", 0.0, 0.0, 1.0), (1, "a", 0.0, 0.0, 2.0), (1, "a", 1.0, 0.0, 3.0), (1, "a", 2.0, 0.0, 4.0), (1, "b", 0.0, 0.0, 1.0), (0, None, 0.0, 0.0, 1.0), (2, "c", 0.0, 0.0, 1.0), (1, "a", 3.0, 0.0, float("inf"))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "p int, s string, x double, y double, v double, o int")
    c, ex = bags.audited_bags(df, ["v"], "p", "s", "x", "y", "o")
    assert sorted(r.features[0] for r in c.collect()) == [1.0, 3.0, 4.0]
    assert sorted((r.reason, r.rows) for r in ex.collect()) == [("fewer_than_min_unique_cells", 1), ("invalid_label", 1), ("missing_id", 1)]


def test_results_do_not_depend_on_partitions(cells):
    a = sorted(bags.cap(cells.repartition(1), "bag_id", "cell_id", 3, 5).select("bag_id", "cell_id").collect())
    b = sorted(bags.cap(cells.repartition(7), "bag_id", "cell_id", 3, 5).select("bag_id", "cell_id").collect())
    assert a == b


def test_fold_plans(cells):
    b = cells.groupBy("bag_id").agg(F.max("label").alias("label"), F.max("group_id").alias("group_id"))
    cov = folds.coverage(folds.fold_plan(b, 3, 2, 1), b).collect()
    assert all(r.tested == 6 and r.repeated == 0 for r in cov)
    g = folds.group_fold_plan(b, 3, 1).withColumn("repeat", F.lit(0)).drop("group_id")
    assert folds.leaks(g, b).isEmpty()


def test_focal_window_mirrors(spark):
    h, w = 5, 6
    v = np.random.default_rng(0).normal(size=(h, w))
    g = spark.createDataFrame([(r, c, [float(v[r, c])], True, float(v[r, c])) for r in range(h) for c in range(w)], "row int, col int, bands array<double>, valid boolean, v double")
    pad = np.pad(v, 1, mode="reflect")
    got = {(r.row, r.col): r.focal for r in grid.focal_mean(g, "v", 3, h, w).collect()}
    assert all(math.isclose(got[r, c], pad[r : r + 3, c : c + 3].mean()) for r in range(h) for c in range(w))


@pytest.mark.parametrize("size", [3, 4, 5])
def test_focal_mean_broadcasts_no_cells(spark, size, tmp_path):
    """Cells missing or invalid, against windows of focal_cells; however small the grid's files are, it may have many cells."""
    rows = [(r, c, [float(r * 7 % 5 + c)], (r + c) % 4 > 0) for r in range(6) for c in range(7) if (r, c) not in ((0, 3), (4, 4))]
    spark.createDataFrame(rows, "row int, col int, bands array<double>, valid boolean").write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g")).withColumn("v", F.element_at("bands", 1))
    got = grid.focal_mean(g, "v", size, 6, 7)
    seen = grid.focal_cells(g, g, size, 6, 7)
    for df in (got, seen):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    want = {}
    for r in seen.collect():
        want.setdefault((r.row, r.col), []).extend(r.bands if r.valid else [])
    held = {(r.row, r.col): r.focal for r in got.collect()}
    assert held.keys() == want.keys() and len(held) == len(rows)
    assert all(math.isclose(held[p], np.mean(v)) if v else held[p] is None for p, v in want.items())


def test_polygon_covers_valid_cells(spark):
    g = spark.createDataFrame([(r, c, c + 0.5, 6 - r - 0.5, [1.0], not (r == 2 and c == 2)) for r in range(6) for c in range(6)], "row int, col int, x double, y double, bands array<double>, valid boolean")
    box = spark.createDataFrame([(1, [(1.0, 2.0), (4.0, 2.0), (4.0, 5.0), (1.0, 5.0), (1.0, 2.0)])], "site_id int, ring array<struct<x:double,y:double>>")
    assert grid.cover(g, box).count() == 8


def test_background_is_free_of_sites(spark):
    g = spark.createDataFrame([(r, c, [1.0], True) for r in range(12) for c in range(12)], "row int, col int, bands array<double>, valid boolean")
    taken = g.filter("row < 4 and col < 4").select("row", "col")
    b = grid.background_bags(g, taken, 3, 5, 7, 3)
    assert b.join(taken, ["row", "col"]).isEmpty()
    assert sorted(r["count"] for r in b.groupBy("bag_id").count().collect()) == [5, 5, 5]


def test_nearest_cells_of_skewed_centres(spark):
    """Clusters, far centres, and k-th cells that lie outside the first buckets although these hold k."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 2, (40, 2)), rng.normal(500, 1, (3, 2)), [[0.9, 5.0], [9.0, 5.0], [9.5, 9.5]]])
    at = np.array([[0.0, 0.0], [499.0, 500.0], [-3000.0, 40.0], [250.0, 250.0], [9.9, 0.1]])
    frame = lambda v, name: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(v)], f"{name} long, x double, y double")
    got = {(r.centre_id, r["rank"]): r.cell_id for r in grid.nearest_cells(frame(xy, "cell_id"), frame(at, "centre_id"), 5, 4.0).collect()}
    d2 = ((at[:, None] - xy[None]) ** 2).sum(axis=2)
    assert got == {(i, k + 1): j for i in range(len(at)) for k, j in enumerate(np.argsort(d2[i], kind="stable")[:5])}
    assert grid.nearest_cells(frame(xy[:2], "cell_id"), frame(at, "centre_id"), 5, 4.0).count() == 10


def test_points_and_background_beside_nodata(spark):
    ok = lambda r, c: c >= 30 or (r, c) == (1, 1)
    g = spark.createDataFrame([(r, c, [1.0], ok(r, c)) for r in range(12) for c in range(40)], "row int, col int, bands array<double>, valid boolean")
    p = spark.createDataFrame([(1, 1, 1), (2, 6, 35)], "point_id long, row int, col int")
    want = {}
    for i, r0, c0 in ((1, 1, 1), (2, 6, 35)):
        count = lambda k: sum(ok(r, c) for r in range(12) for c in range(40) if max(abs(r - r0), abs(c - c0)) <= k)  # noqa: B023, E731
        k = next(k for k in range(1, 50) if count(k) >= 12)
        want[i] = (k, count(k))
    assert {r.point_id: (r.radius, r.cells) for r in grid.grow_points(p, g, 12, 4).collect()} == want
    assert {r.point_id: (r.radius, r.cells) for r in grid.grow_points(p, g, 500, 4).collect()} == {1: (38, 121), 2: (35, 121)}
    taken = g.filter("valid and not (row = 1 and col = 1) and (row + col) % 11 > 0").select("row", "col")
    b = grid.background_bags(g, taken, 4, 8, 7, 1).groupBy("bag_id").count().collect()
    assert sorted(r["count"] for r in b) == [8, 8, 8, 8]


def test_running_sums_by_ranges(spark, monkeypatch):
    """Curves and ranks are the same whether one task orders the rows or many ranges do."""
    from terrabag.operators import metrics, stats

    rows = [(i, i * 7919 % 997 / 997, i * 31 % 7 / 7, i * 13 % 3 % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score double, other double, label int")
    forms = [lambda: metrics.roc_curve(df), lambda: metrics.capture_curve(df, "id"), lambda: metrics.cumulative_lift(df, "id", [0.1, 0.5]), lambda: metrics.score_agreement(df, "id", "score", "other"), lambda: metrics.spearman(df, "score", "other")]
    near = lambda d: sorted(tuple(round(float(v), 9) for v in r) for r in d.collect())
    one = [near(f()) for f in forms]
    monkeypatch.setattr(stats, "ONE_TASK", 0)
    assert [near(f()) for f in forms] == one


def test_embeddings_of_many_small_bags(spark):
    """Bags that span batches and partitions, of null and equal ids too, are read through in tasks, not by a call each."""
    x = np.random.default_rng(6).normal(size=(30_000, 2))
    bag = [None if i % 1000 == 7 else f"b{i % 12_000}" for i in range(30_000)]
    df = spark.createDataFrame([(b, i % 2, v.tolist()) for i, (b, v) in enumerate(zip(bag, x, strict=True))], "bag_id string, label int, features array<double>")
    w = kernels.fourier_weights(2, 3, 1.0, 3)
    out = kernels.embeddings(df, w, ("bag_id", "label"))
    assert "InArrow" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInArrow" not in plan
    phi, want = np.concatenate([np.cos(x @ w.T), np.sin(x @ w.T)], axis=1) / math.sqrt(3), {}
    for i, b in enumerate(bag):
        want.setdefault((b, i % 2), []).append(phi[i])
    got = out.collect()
    assert len(got) == len(want) and all(np.allclose(r.embedding, np.mean(want[r.bag_id, r.label], axis=0), atol=1e-12) for r in got)
    assert kernels.embeddings(df.limit(0), w).isEmpty()


def test_quantile_rows(spark):
    """Bags of one cell, that span batches, of a null id: the vectors of the column expressions, without a row a projection."""
    rng = np.random.default_rng(7)
    bag = ["wide"] * 13_000 + [None] * 5 + [f"b{i // 3}" for i in range(900)] + ["one"]
    df = spark.createDataFrame([(b, v.tolist()) for b, v in zip(bag, rng.normal(size=(len(bag), 2)).round(1), strict=True)], "bag_id string, features array<double>")
    t = kernels.unit_directions(2, 5, 1)
    out = kernels.quantile_rows(df, t, 4)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {r.bag_id: r.embedding for r in kernels.quantile_vectors(kernels.quantile_embeddings(df, t, 4)).collect()}
    got = {r.bag_id: r.embedding for r in out.collect()}
    assert len(want) == 303 and got.keys() == want.keys() and all(np.allclose(got[b], want[b], atol=1e-12) for b in want)
    assert kernels.quantile_rows(df.limit(0), t, 4).isEmpty()
