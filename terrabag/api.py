"""One object from sites and a grid to a suitability surface."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabag.operators import builders, evaluation, grid as g, kernels as k, prediction
from terrabag.operators.classifier import DistributionClassifier, ModelSpec
from terrabag.sources.raster import write_surface


@dataclass
class Suitability:
    """Bags of the cells around sites and around background points, a model of them, and its surface over a grid."""

    spec: ModelSpec = field(default_factory=ModelSpec.m1)
    window: int = 3
    bag_size: int = 10
    sigma: float | None = None
    lam: float = 0.1
    seed: int = 42

    model: DistributionClassifier | None = None

    def prepare(self, grid: DataFrame, sites: DataFrame, n_background: int | None = None, site_reach: float = 0.0) -> DataFrame:
        """Cells of bags around sites (point_id, row, col) and around as many random valid cells, none of them within site_reach of a site."""
        here = builders.distributions_at_points(grid, sites, self.bag_size, self.seed, 1)
        n = n_background or sites.count()
        free = grid.filter("valid")
        if site_reach > 0:
            at = sites.select("row", "col").join(grid.select("row", "col", "x", "y"), ["row", "col"]).select("x", "y")
            free = builders.outside(free.withColumn("point_id", F.struct("row", "col")), at, site_reach).drop("point_id")
        points = g.anchors(free, n, self.seed).select(F.concat(F.lit("b"), "priority").alias("point_id"), "row", "col")
        return here.unionByName(builders.distributions_at_points(grid, points, self.bag_size, self.seed, 0))

    def estimate_sigma(self, cells: DataFrame, pct: float = 50.0) -> float:
        """Percentile of the distances between bags' mean embeddings for models of them, else the median distance of cells."""
        if pct == 50.0 or self.spec.representation != "rff":
            return float(k.median_cell_distance(cells, self.seed).first().sigma)
        width = cells.select(F.size("features")).first()[0]
        e = k.embeddings(cells, k.fourier_weights(width, self.spec.frequencies, 1.0, self.seed))
        return float(k.distance_percentile(k.vector_distances(e), pct, positive=True).first().sigma)

    def _new(self) -> DistributionClassifier:
        return DistributionClassifier(self.spec, sigma=self.sigma or 1.0, lam=self.lam, auto_sigma=self.sigma is None, seed=self.seed)

    def fit(self, cells: DataFrame) -> Suitability:
        self.model = self._new().fit(cells)
        return self

    def predict(self, grid: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
        """(row, col, suitability) of every cell of the grid, whose size is read from it if not given."""
        if self.model is None:
            raise RuntimeError("fit the model before predicting")
        if height is None or width is None:
            height, width = grid.agg(F.max("row") + 1, F.max("col") + 1).first()
        return prediction.predict_grid(self.model, grid, self.window, height, width)

    def save_prediction(self, surface: DataFrame, reference: DataFrame, path: str) -> None:
        """The surface with the coordinates of its reference grid, as Parquet."""
        write_surface(surface.join(reference.select("row", "col", "x", "y"), ["row", "col"]), path)

    def cross_validate(self, cells: DataFrame, n_splits: int = 5, stratified: bool = True, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(scores, metrics by fold, their means and deviations)."""
        return evaluation.validated(self._new(), cells, n_splits, self.seed, stratified, plan)
