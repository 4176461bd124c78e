"""Builders, surfaces, evaluation and the facade on small made tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabag import api
from terrabag.operators import builders, evaluation as ev, grid as g, kernels as k, prediction
from terrabag.operators.classifier import DistributionClassifier, ModelSpec
from terrabag.sources import synthetic as syn


@pytest.fixture(scope="module")
def land(spark):
    """12 x 12 cells with bands a = 0..143 and 2 a; cell (2, 2) is invalid."""
    a = np.arange(144.0).reshape(12, 12)
    b = 2 * a
    b[2, 2] = np.nan
    return syn.grid_of(spark, np.stack([a, b])).persist()


def test_geometry_cells(spark, land):
    ring = [(1.0, 2.0), (4.0, 2.0), (4.0, 5.0), (1.0, 5.0), (1.0, 2.0)]
    sites = spark.createDataFrame([("p", "Polygon", None, None, ring, None, None), ("q", "Point", 0.5, 11.5, None, 0, 0)], "site_id string, geom_type string, x double, y double, ring array<struct<x:double,y:double>>, row int, col int")
    got = builders.geometry_cells(land, sites, window=3).groupBy("site_id").count().collect()
    assert {r.site_id: r["count"] for r in got} == {"p": 9, "q": 4}
    near = builders.geometry_cells(land, sites.filter("site_id = 'q'"), reach=1.0)
    assert sorted((r.row, r.col) for r in near.collect()) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError, match="window or a reach"):
        builders.geometry_cells(land, sites)


def test_distributions_at_points(spark, land):
    p = spark.createDataFrame([(1, 0, 0), (2, 2, 2)], "point_id long, row int, col int")
    got = builders.distributions_at_points(land, p, 5, 3, 1).collect()
    by = {b: [(r.row, r.col) for r in got if r.bag_id == b] for b in ("location_1", "location_2")}
    assert all(len(v) == len(set(v)) == 5 for v in by.values()) and all(max(r, c) <= 2 for r, c in by["location_1"]) and (2, 2) not in by["location_2"]
    few = land.filter("row = 0 and col < 2")
    got = builders.distributions_at_points(few, p.filter("point_id = 1"), 5, 3, 1).collect()
    assert sorted(r.cell_id for r in got) == [0, 1, 2, 3, 4] and len({(r.row, r.col) for r in got}) == 2


def test_points_in_sites(spark):
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    s = spark.createDataFrame([("t", tri)], "site_id string, ring array<struct<x:double,y:double>>")
    got = builders.points_in_sites(s, 20, 5).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.i)] == list(range(20)) and all(r.x + r.y < 10 for r in got)


def test_buffers(spark):
    cells = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "cell_id long, x double, y double")
    p = spark.createDataFrame([("a", 5.0, 5.0), ("b", 0.0, 0.0)], "point_id string, x double, y double")
    want = {(n, i) for n, a, b in (("a", 5, 5), ("b", 0, 0)) for i in range(100) if (i % 10 - a) ** 2 + (i // 10 - b) ** 2 <= 4}
    assert {(r.point_id, r.cell_id) for r in builders.within(cells, p, 2.0).collect()} == want
    assert builders.outside(cells, p, 2.0, "cell_id").count() == 100 - len(want)
    assert builders.cells_in_buffers(cells, p, 2.0, 6, 1).count() == 12
    with pytest.raises(ValueError, match="fewer than 7"):
        builders.cells_in_buffers(cells, p, 2.0, 7, 1)


def test_matched_background(spark, land):
    taken = land.filter("row < 3").select("row", "col")
    sizes = spark.createDataFrame([("s1", 4), ("s2", 7), ("s3", 900)], "bag_id string, n long")
    got = builders.matched_background(land, taken, sizes, 3, 7, exact=True, bag_cap=10)
    assert sorted(r["count"] for r in got.groupBy("bag_id").count().collect()) == [4, 7, 10] and got.filter("row < 3").isEmpty()
    drawn = builders.matched_background(land, taken, sizes, 6, 7, bag_cap=10).groupBy("bag_id").count().collect()
    assert len(drawn) == 6 and {r["count"] for r in drawn} <= {4, 7, 10}
    with pytest.raises(ValueError, match="exact sizes"):
        builders.matched_background(land, taken, sizes, 2, 7, exact=True)
    with pytest.raises(RuntimeError, match="background bags fit"):
        builders.matched_background(land, land.select("row", "col"), sizes, 6, 7)


def test_common_focal_bags(spark, land):
    sites = spark.createDataFrame([("s1", 3, 8), ("s2", 9, 3)], "bag_id string, row int, col int")
    got = builders.common_focal_bags(land, sites, [1, 3], 2, 1)
    for w in (1, 3):
        rows = got.filter(F.col("window") == w).collect()
        assert {r.bag_id for r in rows} == {"s1", "s2", "background-00000", "background-00001"} and len(rows) == 4 * w * w == len({(r.row, r.col) for r in rows})
    with pytest.raises(RuntimeError, match="background windows fit"):
        builders.common_focal_bags(land, sites, [1, 3], 50, 1)


def test_tables_of_sites(spark):
    t = syn.simulated_sites(spark, rows=300, n_sites=20).withColumn("cell_id", F.monotonically_increasing_id()).withColumn("x", F.rand(1) * 50).withColumn("y", F.rand(2) * 50).persist()
    b = builders.bags_from_table(t, ["var1", "var2"], background="spatial", bag_cap=12, n_background=6)
    sizes = {r.bag_id: r["count"] for r in b.groupBy("bag_id").count().collect()}
    assert sum(k.startswith("site_") for k in sizes) == 20 and [v for k, v in sizes.items() if k.startswith("background_")] == [12] * 6
    with pytest.raises(ValueError, match="not enough"):
        builders.bags_from_table(t.limit(302), ["var1", "var2"], background="spatial")
    old = builders.site_table(t, ["var1", "var2"], n_sites=10, test_share=0.3)
    assert old.filter("label = 1").select(F.when(F.col("part") == "train", F.col("bag_id"))).distinct().count() <= 11
    assert old.filter("part = 'test'").groupBy("bag_id").count().filter("count > 1").isEmpty()
    t.unpersist()


def test_surfaces_agree(spark, land):
    """A linear surface by scores of cells equals the model's scores of its windows as bags."""
    cells = syn.toy_bags(spark, n_bags=6, size=8, d=2)
    model = DistributionClassifier(ModelSpec.m1(8)).fit(cells)
    fast = {(r.row, r.col): r.suitability for r in prediction.predict_grid(model, land, 3, 12, 12).collect()}
    seen = g.focal_cells(land.select("row", "col"), land, 3, 12, 12).filter("valid").select((F.col("row").cast("long") * 12 + F.col("col")).alias("bag_id"), F.col("bands").alias("features"))
    slow = {divmod(r.bag_id, 12): r.suitability for r in model.predict(seen).collect()}
    assert len(fast) == 144 and all(math.isclose(fast[p], slow[p], abs_tol=1e-9) for p in slow)
    alone = land.withColumn("valid", (F.col("row") == 0) & (F.col("col") == 0))
    assert [r.suitability is None for r in prediction.predict_grid(model, alone, 3, 12, 12).orderBy("row", "col").limit(3).collect()] == [False, False, True]
    with pytest.raises(ValueError, match="bands"):
        prediction.predict_grid(model, land.withColumn("bands", F.array(F.lit(1.0))), 3, 12, 12)


def test_facade(spark, land, tmp_path):
    sites = spark.createDataFrame([(i, 4 + i, 4 + i % 3) for i in range(4)], "point_id long, row int, col int")
    for spec in (ModelSpec.m1(8), ModelSpec.m3(4, 6)):
        s = api.Suitability(spec, bag_size=5)
        cells = s.prepare(land, sites, site_reach=1.5)
        assert cells.groupBy("label").agg(F.countDistinct("bag_id").alias("n")).select("n").distinct().collect()[0].n == 4
        out = s.fit(cells).predict(land)
        assert out.count() == 144 and out.filter("suitability is null or suitability < 0 or suitability > 1").isEmpty()
        s.save_prediction(out, land, str(tmp_path / spec.method))
        assert spark.read.parquet(str(tmp_path / spec.method)).columns == ["row", "col", "x", "y", "suitability"]
    with pytest.raises(RuntimeError):
        api.Suitability().predict(land)


def test_evaluation(spark):
    cells = syn.toy_bags(spark, n_bags=9, size=10, d=2).persist()
    model = DistributionClassifier(ModelSpec.m1(8))
    scores, rows, means = ev.validated(model, cells, 3)
    assert scores.count() == 18 and rows.count() == 3 and means.first()["mean_auc"] > 0.8
    held, metrics = ev.heldout(ev.mean_embedding("rbf", 8), cells)
    assert held.count() == 6 and metrics.first().auc >= 0.5
    best = ev.grid_search(cells, ModelSpec.m1(8), [0.5, 2.0], [0.1], 3).collect()
    assert len(best) == 2 and best[0].mean_auc >= best[1].mean_auc
    change = {r.transformation: r.max_change for r in ev.invariances(model.fit(cells), cells).collect()}
    assert change["permute"] < 1e-9 and change["duplicate_all"] < 1e-9 < change["duplicate_selected"]
    far = cells.withColumn("x", F.hash("bag_id") % 50 * 10.0).withColumn("y", F.lit(0.0))
    plan, n = ev.spatial_plan(far, 3, 1, 10.0)
    assert 2 <= n <= 3 and plan.select("bag_id").distinct().count() == 18
    with pytest.raises(RuntimeError):
        ev.spatial_plan(cells.withColumn("x", F.col("label") * 1.0).withColumn("y", F.lit(0.0)), 3, 1, 0.5)
    with pytest.raises(ValueError, match="repeats a key"):
        ev.checked_merge(cells, cells, ["bag_id"])
    cells.unpersist()


def test_cases_and_lab(spark):
    config = {"seed": 3, "n_bags_per_class": 6, "bag_size": 6, "scenarios": [{"scenario": "mean_shift", "effect_sizes": [0.5, 1.0], "replicates": 2}, {"scenario": "moment_matched_xor", "effect_size": 0.95}]}
    cases = ev.expand_cases(config)
    assert [(c.scenario, c.effect_size) for c in cases] == [("mean_shift", 0.5)] * 2 + [("mean_shift", 1.0)] * 2 + [("moment_matched_xor", 0.95)] and len({c.seed for c in cases}) == 5
    rows, metrics = ev.run_case(spark, cases[2], {"M0": DistributionClassifier(ModelSpec.m0()), "M1": DistributionClassifier(ModelSpec.m1(32))}, 2)
    assert rows.count() == 24 and metrics.count() == 2
    assert ev.with_agreement(rows).first().pearson > 0.8


def test_kernels():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    exact = k.GaussianKernel(1.5)(x, y)
    assert np.allclose(exact, [[math.exp(-((a - b) ** 2).sum() / 4.5) for b in y] for a in x])
    assert np.abs(k.FourierKernel(1.5, 4000)(x, y) - exact).max() < 0.1


def test_scenarios():
    rng = np.random.default_rng(2)
    many = lambda name, label, bag=0, **kw: syn.draw(syn.Scenario(name, **kw), label, bag, 20_000, rng)
    assert abs(many("sparse_signal", 1)[:, 0].mean() - 0.75) < 0.05 and abs(many("sparse_signal", 1)[:, 1].mean()) < 0.05
    assert abs(many("nonlinear_mixture", 1, 0)[:, 0].mean() + 0.75) < 0.05 and abs(many("nonlinear_mixture", 1, 1)[:, 0].mean() - 0.75) < 0.05 and abs(many("nonlinear_mixture", 0)[:, 0].mean()) < 0.05
    kurtosis = lambda v: ((v - v.mean()) ** 4).mean() / v.var() ** 2
    shapes = {(label, bag): [kurtosis(many("moment_matched_xor", label, bag, effect_size=0.95)[:, f]) < 2 for f in (0, 1)] for label in (0, 1) for bag in (0, 1)}
    assert shapes == {(0, 0): [False, False], (0, 1): [True, True], (1, 0): [False, True], (1, 1): [True, False]}
    assert abs(many("multimodal", 1, effect_size=0.9)[:, 0].var() - 1) < 0.05
    xy = syn.places(10, 13, 1)
    assert xy[0].tolist() == [7.0, 1007.0] and xy[5].tolist() == [8.0, 1008.0]
