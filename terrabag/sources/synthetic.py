"""Synthetic bags and rasters; every bag draws from a generator seeded by (seed, bag), so results don't depend on partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = ("null", "mean_shift", "variance_shift", "heavy_tail", "multimodal", "correlation_shift", "sparse_signal", "nonlinear_mixture", "moment_matched_xor")


@dataclass(frozen=True)
class Scenario:
    """What to generate."""

    scenario: str = "mean_shift"
    n_bags_per_class: int = 24
    n_features: int = 3
    n_signal_features: int = 1
    bag_size: int = 30
    unequal_bag_sizes: bool = False
    min_bag_size: int = 3
    max_bag_size: int = 120
    effect_size: float = 0.75
    spatial_range: float = 0.0
    bags_per_group: int = 1
    seed: int = 42

    def __post_init__(self):
        if self.scenario not in SCENARIOS:
            raise ValueError(f"unknown scenario {self.scenario!r}")
        if not 0 < self.n_signal_features <= self.n_features:
            raise ValueError("signal features must be among the features")
        if self.scenario in ("correlation_shift", "moment_matched_xor", "nonlinear_mixture") and self.n_features < 2:
            raise ValueError(f"{self.scenario} needs two features")


def _size(cfg: Scenario, i: int) -> int:
    """The size of the i-th bag of either class: uniform between the limits where sizes are unequal."""
    return int(np.random.default_rng([cfg.seed, 11, i]).integers(cfg.min_bag_size, cfg.max_bag_size + 1)) if cfg.unequal_bag_sizes else cfg.bag_size


#: Largest distance of two modes from 0, and least variance within one, of distributions whose variance is kept at 1.
MOST_APART, LEAST_WITHIN = 0.95, 0.05
#: Deviation within the modes of nonlinear_mixture.
WITHIN = 0.35


def _two_modes(apart: float, shape: int | tuple[int, int], rng: np.random.Generator) -> np.ndarray:
    """Values around -apart and +apart, at random, with a variance of about 1 in all."""
    return rng.choice([-apart, apart], size=shape) + rng.normal(size=shape) * math.sqrt(max(1 - apart * apart, LEAST_WITHIN))


def draw(cfg: Scenario, label: int, bag: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """n cells of a bag of the label. `bag` numbers it in its class: two scenarios differ between even and odd bags.

    Background bags are standard normal, but for nonlinear_mixture, where each cell of theirs is at either mode while a site's are all at
    one, and moment_matched_xor, where the first two features of a background bag have equal shapes, one or two modes, and a site's
    unequal ones.
    """
    x, k, e = rng.normal(size=(n, cfg.n_features)), cfg.n_signal_features, cfg.effect_size
    if cfg.scenario == "nonlinear_mixture":
        side = rng.choice([-1.0, 1.0], size=n) if label == 0 else 2.0 * (bag % 2) - 1.0
        x[:, 0] = side * max(e, 1e-8) + rng.normal(size=n) * WITHIN
    elif cfg.scenario == "moment_matched_xor":
        for feature, bimodal in enumerate((bag % 2, (bag + label) % 2)):
            if bimodal:
                x[:, feature] = _two_modes(min(e, MOST_APART), n, rng)
    elif label == 1 and cfg.scenario in ("mean_shift", "sparse_signal"):
        x[:, :k] += e
    elif label == 1 and cfg.scenario == "variance_shift":
        x[:, :k] *= 1 + e
    elif label == 1 and cfg.scenario == "heavy_tail" and e > 0:
        tail = rng.standard_t(3, size=(n, k)) / math.sqrt(3)
        x[:, :k] = np.where(rng.random((n, k)) < min(e, 1.0), tail, x[:, :k])
    elif label == 1 and cfg.scenario == "multimodal" and e > 0:
        x[:, :k] = _two_modes(min(e, MOST_APART), (n, k), rng)
    elif label == 1 and cfg.scenario == "correlation_shift":
        rho = min(e, MOST_APART)
        x[:, 1] = rho * x[:, 0] + math.sqrt(1 - rho * rho) * x[:, 1]
    return x


def places(n: int, bag: int, label: int) -> np.ndarray:
    """Coordinates of n cells in a square; twelve bags a row, three cells apart, classes 1000 apart."""
    side = math.ceil(math.sqrt(n))
    at = np.arange(n)
    return np.stack([at % side + bag % 12 * (side + 3), at // side + bag // 12 * (side + 3) + 1000 * label], axis=1).astype(float)


def spatial_copula(x: np.ndarray, xy: np.ndarray, reach: float, rng: np.random.Generator) -> np.ndarray:
    """x with each column read from its own quantile function at the probabilities of a Gaussian field of exponential covariance.

    Probabilities are clipped to those of the least and the largest value; so a bag's mean varies the more, the farther the field reaches.
    """
    if reach <= 0 or len(x) < 2:
        return x
    d = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1))
    root = np.linalg.cholesky(np.exp(-d / reach) + 1e-6 * np.eye(len(x)))
    at, out = (np.arange(len(x)) + 0.5) / len(x), np.empty_like(x)
    for j in range(x.shape[1]):
        z = root @ rng.normal(size=len(x))
        u = np.clip([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z], at[0], at[-1])
        out[:, j] = np.interp(u, at, np.sort(x[:, j]))
    return out


def synthetic_bags(spark: SparkSession, cfg: Scenario) -> DataFrame:
    """Cells of 2 n_bags_per_class bags: bag_id, cell_id, label, features, x, y, group_id."""
    bags = spark.range(2 * cfg.n_bags_per_class).select(F.col("id").cast("int").alias("bag"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bag in b["bag"]:
                label, i = divmod(int(bag), cfg.n_bags_per_class)
                rng, n = np.random.default_rng([cfg.seed, label, i]), _size(cfg, i)
                xy = places(n, i, label)
                x = spatial_copula(draw(cfg, label, i, n, rng), xy, cfg.spatial_range, rng)
                yield pd.DataFrame({"bag_id": f"{'site' if label else 'background'}-{i:05d}", "cell_id": np.arange(n), "label": label, "features": list(x), "x": xy[:, 0], "y": xy[:, 1], "group_id": f"group-{label}-{i // cfg.bags_per_group}"})

    return bags.mapInPandas(make, "bag_id string, cell_id long, label int, features array<double>, x double, y double, group_id string")


def simulated_sites(spark: SparkSession, seed: int = 42, n_sites: int = 75, rows: int = 800) -> DataFrame:
    """presence, SITENO, var1, var2: `rows` site cells over n_sites ids and as many background cells."""
    r = spark.range(rows)
    site = r.select(F.lit(1).alias("presence"), F.format_string("site_%03d", F.col("id") % n_sites).alias("SITENO"), (F.randn(seed) * 10 + 50).alias("var1"), (F.randn(seed + 1) * 2 + 3).alias("var2"))
    back = r.select(F.lit(0).alias("presence"), F.lit("background").alias("SITENO"), (F.randn(seed + 2) * 20 + 100).alias("var1"), (F.randn(seed + 3) * 3 + 6).alias("var2"))
    return site.unionByName(back)


def gaussian_field(height: int, width: int, reach: float, seed: int) -> np.ndarray:
    """White noise smoothed by a Gaussian of deviation reach / 3, scaled to [0, 1]."""
    noise, sd = np.random.default_rng(seed).normal(size=(height, width)), max(reach / 3, 1e-6)
    half = int(4 * sd + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sd) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = np.pad(noise, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        noise = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, pad)
    span = noise.max() - noise.min()
    return (noise - noise.min()) / span if span > 0 else np.zeros_like(noise)


def site_trend(height: int, width: int, n_sites: int, size: int, seed: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(trend, sites): sites at least 2 size apart, and a surface in [0, 1] that falls off with the distance to the nearest."""
    rng, sites = np.random.default_rng(seed), []
    for _ in range(1000 * n_sites):
        if len(sites) == n_sites:
            break
        p = (int(rng.integers(height)), int(rng.integers(width)))
        if all(math.hypot(p[0] - a, p[1] - b) >= 2 * size for a, b in sites):
            sites.append(p)
    r, c = np.mgrid[:height, :width]
    d = np.min([np.hypot(r - a, c - b) for a, b in sites], axis=0)
    t = np.exp(-0.1 * d / (max(height, width) / 10))
    return (t - t.min()) / max(t.max() - t.min(), 1e-12), sites


def rescale(raster: np.ndarray, mean: float, sd: float) -> np.ndarray:
    """raster with the mean and deviation given; a constant one becomes the mean."""
    s = raster.std()
    return np.full_like(raster, mean) if s == 0 else (raster - raster.mean()) / s * sd + mean


def grid_of(spark: SparkSession, bands: np.ndarray) -> DataFrame:
    """The grid of a small bands x rows x columns array."""
    n, h, w = bands.shape
    r, c = np.divmod(np.arange(h * w), w)
    cells = pd.DataFrame({"row": r.astype("int32"), "col": c.astype("int32"), "x": c + 0.5, "y": h - r - 0.5, "bands": list(bands.reshape(n, -1).T.astype(float)), "valid": np.isfinite(bands).all(axis=0).ravel()})
    return spark.createDataFrame(cells, "row int, col int, x double, y double, bands array<double>, valid boolean")


def noise_grid(spark: SparkSession, height: int, width: int, n_bands: int, seed: int) -> DataFrame:
    """A grid of uniform noise; every value is a hash of its place, so any size is made in parallel."""
    from terrabag.functions.expressions import hash_uniform

    r, c = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    bands = F.array(*[hash_uniform(seed, F.lit(str(b)), "id") for b in range(n_bands)])
    return spark.range(height * width).select(r.alias("row"), c.alias("col"), (c + 0.5).cast("double").alias("x"), (F.lit(height) - r - 0.5).cast("double").alias("y"), bands.alias("bands"), F.lit(True).alias("valid"))


def benchmark_landscape(spark: SparkSession, height: int, width: int, n_sites: int, size: int, seed: int, weight: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(grid, sites): three bands that mix the sites' trend with smooth fields, and the sites (point_id, row, col); for small rasters."""
    trend, sites = site_trend(height, width, n_sites, size, seed)
    fields = [gaussian_field(height, width, size * (b + 2), seed + b + 1) for b in range(3)]
    bands = np.stack([weight * trend + (1 - weight) * fields[0], rescale((1 - trend) * weight + (1 - weight) * fields[1], 50.0, 10.0), fields[2]])
    return grid_of(spark, bands), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sites)], "point_id long, row int, col int")


def toy_bags(spark: SparkSession, kind: str = "standard", n_bags: int = 12, size: int = 30, d: int = 4, seed: int = 42) -> DataFrame:
    """Cells of n_bags bags a class: 'standard' classes differ in their mean by 1, 'bimodal' ones only in having one or two modes."""
    if kind not in ("standard", "bimodal"):
        raise ValueError("kind must be 'standard' or 'bimodal'")
    scenario = Scenario("mean_shift" if kind == "standard" else "multimodal", n_bags, d, d, size, effect_size=1.0 if kind == "standard" else 0.95, seed=seed)
    return synthetic_bags(spark, scenario)
