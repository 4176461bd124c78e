"""Mean embeddings of bags over a stream of cells: sums of random features add up, so running sums are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabag.functions.expressions import literal_vector, random_fourier, sigmoid


def stream_scores(cells: DataFrame, weights: np.ndarray, beta: np.ndarray) -> DataFrame:
    """bag_id, n and suitability of a linear model, updated as cells arrive. State: one sum and a count a bag.

    For a linear decision the cell's own contribution phi(x) beta is a number, so the state doesn't hold the embedding.
    """
    phi = random_fourier("features", weights.tolist())
    value = F.aggregate(F.zip_with(phi, literal_vector(beta), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    s = cells.select("bag_id", value.alias("v")).groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return s.select("bag_id", "n", sigmoid(F.col("total") / F.col("n")).alias("suitability"))


def windowed_means(events: DataFrame, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean by key and tumbling window of ts; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")
