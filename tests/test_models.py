"""Solvers, classifiers, archives, sources and synthetic data."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabag.operators import classifier as c
from terrabag.operators.solvers import KernelLogistic, PrimalLogistic
from terrabag.sources import archive, raster, synthetic, tabular
from terrabag.streaming import embeddings as stream


@pytest.fixture(scope="module")
def data(spark):
    return synthetic.synthetic_bags(spark, synthetic.Scenario("mean_shift", 8, 2, 2, 8, effect_size=2.5)).persist()


def test_near_singular_gram():
    k = np.ones((8, 8))
    k[0, 0] = 1.000001
    r = KernelLogistic(1e-6).fit(k * 1e5, np.arange(8) % 2)
    assert np.all(np.isfinite(r.coefficients)) and np.isfinite(r.loss)


def test_primal_equals_dual():
    x = np.random.default_rng(0).normal(size=(12, 5))
    y = np.arange(12) % 2
    dual = KernelLogistic(0.3, 200, 1e-10).fit(x @ x.T, y)
    primal = PrimalLogistic(0.3, 200, 1e-12).fit_arrays(x, y)
    assert np.allclose(x @ x.T @ dual.coefficients, x @ primal.coefficients, atol=2e-5)


def test_distributed_newton_equals_local(spark):
    x = np.random.default_rng(1).normal(size=(40, 3))
    y = (x[:, 0] > 0.2).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y, strict=True)], "features array<double>, label int").repartition(3)
    assert np.allclose(PrimalLogistic(0.5).fit(df).coefficients, PrimalLogistic(0.5).fit_arrays(x, y).coefficients)


@pytest.mark.parametrize("spec", [c.ModelSpec.m0(), c.ModelSpec.m1(32), c.ModelSpec.m2(32), c.ModelSpec.m3(8, 8)])
def test_models_tell_classes_apart_and_survive_the_archive(spark, data, tmp_path, spec):
    m = c.DistributionClassifier(spec).fit(data)
    p = {r.bag_id: r.suitability for r in m.predict(data).collect()}
    assert len(p) == 16 and all(0 <= v <= 1 for v in p.values())
    assert min(v for k, v in p.items() if k.startswith("site")) > max(v for k, v in p.items() if k.startswith("back"))
    archive.save_model(m, str(tmp_path / spec.method))
    again = {r.bag_id: r.suitability for r in archive.load_model(spark, str(tmp_path / spec.method)).predict(data).collect()}
    assert all(abs(again[k] - v) < 2e-6 for k, v in p.items())


@pytest.mark.parametrize("spec", [c.ModelSpec.m2(16), c.ModelSpec.m3(4, 8)])
def test_dual_models_of_more_bags_than_a_matrix_holds(spark, monkeypatch, spec):
    """Fitted by products with the kernel, a model has the bandwidth and the scores that the whole matrix gives."""
    cells = synthetic.synthetic_bags(spark, synthetic.Scenario("mean_shift", 60, 61, 5, 2, effect_size=0.7)).persist()
    whole = c.DistributionClassifier(spec).fit(cells)
    monkeypatch.setattr(c, "MAX_DUAL_BAGS", 100)
    monkeypatch.setattr(c, "LANDMARKS", 20)
    parts = c.DistributionClassifier(spec).fit(cells)
    assert len(parts.bag_ids) > 100 and parts.result.converged and whole.result.converged
    assert abs(parts.decision_sigma_ - whole.decision_sigma_) < 1e-9
    want = {r.bag_id: r.suitability for r in whole.predict(cells).collect()}
    assert all(abs(want[r.bag_id] - r.suitability) < 1e-5 for r in parts.predict(cells).collect())
    with pytest.raises(ValueError, match="100 bags"):
        c.DistributionClassifier(c.ModelSpec.m0()).fit(cells)


def test_archive_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="fitted"):
        archive.save_model(c.DistributionClassifier(c.ModelSpec.m1()), str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(ValueError, match="version"):
        archive.load_model(spark, str(tmp_path))


def test_specs():
    with pytest.raises(ValueError, match="no such model"):
        c.ModelSpec("exact_kme", "rbf", "dual")
    with pytest.raises(ValueError, match="order 2"):
        c.ModelSpec.m3(order=1)
    assert c.ModelSpec.from_legacy("mean_embedding").method == "M1" and c.ModelSpec.from_legacy("wasserstein").method == "M3"


def test_fingerprints_follow_content_not_partitions(data):
    a = archive.dataset_fingerprint(data)
    assert a == archive.dataset_fingerprint(data.repartition(5))
    assert a != archive.dataset_fingerprint(data.withColumn("label", 1 - F.col("label")))


def test_strict_json(tmp_path):
    archive.write_strict_json(str(tmp_path / "a.json"), {"finite": 1.0, "undefined": float("nan")})
    assert json.loads((tmp_path / "a.json").read_text()) == {"finite": 1.0, "undefined": None}


def test_resolution_is_strict(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 2)], "Presence int, SITENO string, x double, y double, slope double, `Unnamed: 0` int")
    cfg = tabular.resolve(df)
    assert (cfg.label, cfg.bag_id, cfg.features) == ("Presence", "SITENO", ("slope",))
    with pytest.raises(ValueError, match="expected one"):
        tabular.resolve(df.withColumn("label", F.lit(1)))
    assert tabular.detect_xy(df) == ("x", "y") and tabular.detect_columns(df)["bag_id"] == "SITENO"


def test_csv_and_geojson(spark, tmp_path):
    (tmp_path / "c.csv").write_text("presence,siteno,x,y,a\n" + "".join(f"1,s,{i},0,{i * 2}\n" for i in range(4)))
    cells, out, cfg = tabular.read_cells(spark, str(tmp_path / "c.csv"))
    assert cells.count() == 4 and out.isEmpty() and cfg.features == ("a",)
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [0.5, 0.25]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    s = tabular.read_geojson(spark, str(tmp_path / "g.json")).orderBy("site_id").collect()
    assert (s[0].x, s[0].y) == (0.5, 0.25) and len(s[1].ring) == 4


def test_rasters_round_trip(spark, tmp_path):
    sig = raster.Signature(4, 3, 10.0, 20.0, 2.0, 2.0)
    v = np.arange(12.0).reshape(3, 4)
    v[1, 1] = np.nan
    (tmp_path / "a.tif").write_bytes(raster.to_tiff(np.where(np.isnan(v), -9999, v), sig, -9999))
    (tmp_path / "b.asc").write_text(raster.to_ascii(v * 2, sig))
    g, s = raster.stack(spark, [str(tmp_path / "a.tif"), str(tmp_path / "b.asc")])
    assert s == sig
    rows = {(r.row, r.col): r for r in g.collect()}
    assert not rows[1, 1].valid and rows[2, 3].bands == [11.0, 22.0] and (rows[0, 0].x, rows[0, 0].y) == (11.0, 19.0)
    (tmp_path / "c.tif").write_bytes(raster.to_tiff(v, raster.Signature(4, 3, 11.0, 20.0, 2.0, 2.0)))
    with pytest.raises(ValueError, match="not aligned"):
        raster.stack(spark, [str(tmp_path / "a.tif"), str(tmp_path / "c.tif")])
    raster.write_tiles(g, str(tmp_path / "tiles"), 2)
    assert spark.read.parquet(str(tmp_path / "tiles")).filter("tile_row = 1 and tile_col = 1").count() == 2


@pytest.mark.parametrize("name", synthetic.SCENARIOS)
def test_scenarios(spark, name):
    cfg = synthetic.Scenario(name, 3, 3, 2, unequal_bag_sizes=True, spatial_range=2.0)
    a = sorted((r.bag_id, r.cell_id, tuple(r.features)) for r in synthetic.synthetic_bags(spark, cfg).collect())
    assert a == sorted((r.bag_id, r.cell_id, tuple(r.features)) for r in synthetic.synthetic_bags(spark, cfg).repartition(3).collect())
    n = {}
    for b, _, _ in a:
        n[b] = n.get(b, 0) + 1
    assert all(n[f"site-{i:05d}"] == n[f"background-{i:05d}"] and 3 <= n[f"site-{i:05d}"] <= 120 for i in range(3))


def test_fields():
    f = synthetic.gaussian_field(20, 15, 6, 1)
    assert f.shape == (20, 15) and f.min() == 0 and f.max() == 1
    t, sites = synthetic.site_trend(30, 30, 4, 3, 1)
    assert len(sites) == 4 and t.max() == 1
    assert np.all(synthetic.rescale(np.ones((2, 2)), 3.0, 1.0) == 3.0)


def test_stream_equals_batch(spark, data, tmp_path):
    from terrabag.operators.kernels import fourier_weights

    w, beta = fourier_weights(2, 4, 1.0, 1), np.linspace(-1, 1, 8)
    data.select("bag_id", "features").repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("bag_id string, features array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.stream_scores(s, w, beta).writeStream.format("memory").queryName("scores").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r.bag_id: r.suitability for r in spark.table("scores").collect()}
    want = {r.bag_id: r.suitability for r in stream.stream_scores(data, w, beta).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cross_validation_scores_every_bag_once(data):
    from terrabag.operators.folds import fold_plan

    plan = fold_plan(data.groupBy("bag_id").agg(F.max("label").alias("label")), 2, 1, 3).select("fold", "bag_id")
    r = c.cross_validate(c.DistributionClassifier(c.ModelSpec.m1(16)), data, plan, 2).collect()
    assert len(r) == len({x.bag_id for x in r}) == 16


def test_vector_pairs_against_the_whole_matrix(spark, monkeypatch):
    """Median and products, also where the sampled bounds miss the median, few distances may be sorted, or all rows are equal."""
    from terrabag.operators import vector_pairs
    from terrabag.operators.kernels import GaussianKernel

    rng = np.random.default_rng(1)
    sets = [rng.normal(size=(700, 5)), np.repeat(rng.normal(size=(2, 3)), 50, axis=0), np.eye(40), rng.normal(size=(300, 4)) + 1e3, np.ones((30, 3))]
    for bounds in (None, (0.001, 0.0011)):
        if bounds:
            monkeypatch.setattr(vector_pairs.VectorPairs, "_bracket", lambda self: bounds)
            monkeypatch.setattr(vector_pairs, "SORTED", 10)
        for x in sets:
            held, v = vector_pairs.VectorPairs(spark, x), rng.normal(size=len(x))
            apart = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(len(x), 1)]
            got = held.median()
            assert got is None if not (apart > 0).any() else abs(got - np.median(apart[apart > 0])) < 1e-9
            assert np.allclose(held.product(v, got or 1.0), GaussianKernel(got or 1.0)(x, x) @ v, atol=1e-8)
            held.close()
