"""Queries that fit models."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrabag.functions.expressions import dot, literal_vector, sigmoid
from terrabag.operators import baselines, stats
from terrabag.operators import classifier as c
from terrabag.operators import kernels as k
from terrabag.operators.solvers import PrimalLogistic

from .catalogue import _EMB, query
from .views import CELLS, Z, cells, people


def _scores(spec: c.ModelSpec, data):
    return c.DistributionClassifier(spec).fit(data).predict(data)


@query()
def m0_bag_scores(spark, d):
    return _scores(c.ModelSpec.m0(), people(spark, d))


@query()
def m1_bag_scores(spark, d):
    return _scores(c.ModelSpec.m1(), cells(spark, d))


@query()
def m2_bag_scores(spark, d):
    return _scores(c.ModelSpec.m2(), cells(spark, d))


@query()
def m3_bag_scores(spark, d):
    return _scores(c.ModelSpec.m3(), people(spark, d))


_BETA = [0.9, -0.4, 0.25, 0.6, -0.7, 0.2, 0.35, -0.15]


@query(_EMB + "SELECT bag_id, round(1 / (1 + exp(-(" + " + ".join(f"p{i} * {b!r}::DOUBLE" for i, b in enumerate(_BETA)) + "))), 6) AS suitability FROM emb")
def m1_fixed_beta_scores(spark, d):
    e = k.embeddings(people(spark, d), k.fourier_weights(2, 4, 0.5, 42))
    return e.select("bag_id", sigmoid(dot("embedding", literal_vector(_BETA))).alias("suitability"))


def _newton_sql(steps: int) -> str:
    out = "WITH " + CELLS + "," + Z + ", f AS (SELECT bag_id, avg(z0) AS a, avg(z1) AS b, max(label)::DOUBLE AS y FROM z GROUP BY 1), w0 AS (SELECT 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"
    for i in range(steps):
        out += f""", s{i} AS (SELECT any_value(u) AS u, any_value(v) AS v, sum(a * (p - y)) + 0.1::DOUBLE * any_value(u) AS g1, sum(b * (p - y)) + 0.1::DOUBLE * any_value(v) AS g2,
sum(a * a * p * (1 - p)) + 0.1::DOUBLE AS h11, sum(a * b * p * (1 - p)) AS h12, sum(b * b * p * (1 - p)) + 0.1::DOUBLE AS h22 FROM (SELECT f.*, u, v, 1 / (1 + exp(-(a * u + b * v))) AS p FROM f, w{i})),
w{i + 1} AS (SELECT u - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS u, v - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS v FROM s{i})"""
    return out + f" SELECT round(u, 6) AS beta_0, round(v, 6) AS beta_1 FROM w{steps}"


@query(_newton_sql(10))
def primal_newton_2d(spark, d):
    z = stats.zscore(cells(spark, d), 4)
    f = z.groupBy("bag_id").agg(F.array(F.avg(F.element_at("features", 1)), F.avg(F.element_at("features", 2))).alias("features"), F.max("label").alias("label"))
    beta = PrimalLogistic(0.1, 100, 1e-10).fit(f).coefficients
    return spark.sql(f"SELECT {float(beta[0])!r}D AS beta_0, {float(beta[1])!r}D AS beta_1")


@query()
def baseline_lr(spark, d):
    x = cells(spark, d)
    return baselines.baseline_scores(x, x, 4, "mean_std", "logistic")


@query()
def baseline_rf(spark, d):
    x = cells(spark, d)
    return baselines.baseline_scores(x, x, 4, "mean_std", "forest")


@query()
def cross_validated_m1(spark, d):
    from terrabag.operators.folds import fold_plan

    x = cells(spark, d)
    plan = fold_plan(x.groupBy("bag_id").agg(F.max("label").alias("label")), 3, 1, 42).select("fold", "bag_id")
    return c.cross_validate(c.DistributionClassifier(c.ModelSpec.m1(16)), x, plan, 3)


@query()
def permutation_importance(spark, d):
    x = cells(spark, d)
    return c.permutation_importance(c.DistributionClassifier(c.ModelSpec.m1(8)).fit(x), x, repeats=1)


