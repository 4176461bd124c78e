"""Baselines on bag summaries: logistic regression and random forest of pyspark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats


def summaries(cells: DataFrame, d: int, kind: str = "mean_std") -> tuple[DataFrame, list[str]]:
    """(bag table, feature columns) of kind mean, mean_std or geometry."""
    if kind == "geometry":
        return stats.bag_geometry(cells), ["log_n", "log_extent"]
    if kind not in ("mean", "mean_std"):
        raise ValueError("kind must be mean, mean_std or geometry")
    s = stats.bag_means(cells, d, deviations=kind == "mean_std")
    return s, [c for c in s.columns if c != "bag_id"]


def baseline_scores(train: DataFrame, test: DataFrame, d: int, kind: str = "mean_std", model: str = "logistic", seed: int = 42) -> DataFrame:
    """(bag_id, suitability) of the test bags by a model of the training bags; features are standardised with training statistics."""
    fit, names = summaries(train, d, kind)
    use, _ = summaries(test, d, kind)
    labels = train.groupBy("bag_id").agg(F.max("label").cast("double").alias("label"))
    one = stats.column_scaling(fit, names).first()
    scale = lambda df: df.select("bag_id", *[((F.col(c) - one[f"mean_{c}"]) / one[f"std_{c}"]).alias(c) for c in names])
    pack = VectorAssembler(inputCols=names, outputCol="v")
    rows = pack.transform(scale(fit)).join(labels, "bag_id").persist()
    n = rows.count()
    if model == "logistic":
        est = LogisticRegression(featuresCol="v", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=5000, tol=1e-9)
    elif model == "forest":
        share = rows.groupBy("label").agg((n / (2.0 * F.count(F.lit(1)))).alias("w"))
        rows = rows.join(F.broadcast(share), "label")  # two rows
        est = RandomForestClassifier(featuresCol="v", numTrees=500, minInstancesPerNode=5, featureSubsetStrategy="sqrt", weightCol="w", seed=seed)
    else:
        raise ValueError("model must be logistic or forest")
    out = est.fit(rows).transform(pack.transform(scale(use)))
    return out.select("bag_id", F.element_at(vector_to_array("probability"), 2).alias("suitability"))
