"""Surfaces of a fitted model: focal windows of a grid, patches of the nearest cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabag.functions.expressions import sigmoid

from . import grid as g
from .classifier import DistributionClassifier


def cell_scores(model: DistributionClassifier, cells: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, score): each cell's part in the decision of a linear model. A bag's is the mean of its cells' scores."""
    if model.spec.method != "M1":
        raise ValueError("only linear models of explicit features score cells one by one")
    w, beta = np.ascontiguousarray(model.weights.T), model.result.coefficients
    m = w.shape[1]
    row = model.stats.first() if model.scale_features else None
    mean, scale = (np.array([row[f"{k}_{i}"] for i in range(model.width)]) for k in ("mean", "scale")) if row else (0.0, 1.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                z = ((x - mean) / scale) @ w
                s = (np.cos(z) @ beta[:m] + np.sin(z) @ beta[m:]) * np.sqrt(1.0 / m)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(s)], [*keep, "score"])

    kinds = dict(cells.dtypes)
    return cells.select(*keep, "features").mapInArrow(score, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def predict_grid(model: DistributionClassifier, grid: DataFrame, window: int, height: int, width: int, masked: bool = True) -> DataFrame:
    """(row, col, suitability) of every cell: the model's score of the window around it, mirrored at the edges.

    Invalid cells count in no window, unless masked is False; a window without valid cells has a null. Linear models score each cell once
    and average; others see every window as a bag. Raises if the grid has another number of bands than the model has features.
    """
    one = grid.select(F.size("bands")).first()
    if one is not None and one[0] != model.width:
        raise ValueError(f"the grid has {one[0]} bands, the model {model.width} features")
    held = grid if masked else grid.withColumn("valid", F.lit(True))
    places = held.select("row", "col")
    if model.spec.method == "M1":
        scores = cell_scores(model, held.filter("valid").withColumnRenamed("bands", "features"), ["row", "col"])
        scored = places.join(scores, ["row", "col"], "left").withColumn("valid", F.col("score").isNotNull())
        return g.focal_mean(scored, "score", window, height, width).select("row", "col", sigmoid("focal").alias("suitability"))
    seen = g.focal_cells(places, held, window, height, width).filter("valid")
    number = F.col("row").cast("long") * width + F.col("col")
    bags = seen.select(number.alias("bag_id"), F.col("bands").alias("features"))
    got = model.predict(bags).select(F.floor(F.col("bag_id") / width).cast("int").alias("row"), (F.col("bag_id") % width).cast("int").alias("col"), "suitability")
    return places.join(got, ["row", "col"], "left")


def predict_surface(model: DistributionClassifier, centres: DataFrame, cells: DataFrame, k: int = 16) -> DataFrame:
    """(centre_id, suitability) of the k nearest cells (cell_id, x, y, features) around each centre (centre_id, x, y)."""
    near = g.nearest_cells(cells, centres, k).select("centre_id", "cell_id")
    if model.spec.method == "M1":
        scores = cell_scores(model, cells, ["cell_id"])
        return near.join(scores, "cell_id").groupBy("centre_id").agg(F.avg("score").alias("eta")).select("centre_id", sigmoid("eta").alias("suitability"))
    bags = near.join(cells.select("cell_id", "features"), "cell_id").select(F.col("centre_id").alias("bag_id"), "cell_id", "features")
    return model.predict(bags).withColumnRenamed("bag_id", "centre_id")
