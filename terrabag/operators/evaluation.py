"""Held-out and cross-validated evaluation, searches, comparisons of methods and their checks."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrabag.sources.synthetic import Scenario, synthetic_bags

from . import bags, folds, metrics as m, stats
from .classifier import DistributionClassifier, ModelSpec, cross_validate

# ---- tables of results


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables with the columns of any; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def checked_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "many_to_one") -> DataFrame:
    """Left join on equal keys; raises if right, or for one_to_one either side, repeats a key."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError("validate must be one_to_one or many_to_one")
    for name, side in (("right", right), ("left", left)):
        if (name == "right" or validate == "one_to_one") and not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{validate}: the {name} table repeats a key")
    return left.join(right, list(keys), "left")


def join_all(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The first table with the columns of the others by key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, list(keys), "left")
    return out


def reordered(matrix: DataFrame, order: DataFrame) -> DataFrame:
    """A matrix in coordinate form (bag_i, bag_j, value) with places i and j by the cluster label and bag_id of `order` (bag_id, cluster)."""
    place = order.select("bag_id", (F.row_number().over(Window.orderBy("cluster", "bag_id")) - 1).alias("place"))
    at = lambda c, n: place.select(F.col("bag_id").alias(c), F.col("place").alias(n))
    return matrix.join(at("bag_i", "i"), "bag_i").join(at("bag_j", "j"), "bag_j").select("i", "j", "value")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, or one a file, as rows."""
    return spark.read.json(path, multiLine=True)


def first_of(branches: Sequence[tuple[Column, Any]], default: Any) -> Column:
    """The value of the first branch whose condition holds."""
    out = F.when(F.lit(False), F.lit(default))
    for condition, value in branches:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def robust_gains(rows: DataFrame, least: float = 0.02) -> DataFrame:
    """Rows (pairs, mean_difference, ci_low) of two pairs or more with a mean over `least` and an interval over 0."""
    return rows.filter((F.col("pairs") >= 2) & (F.col("mean_difference") > least) & (F.col("ci_low") > 0))


# ---- metrics


def safe_correlation(df: DataFrame, a: str, b: str, rank: bool = False) -> DataFrame:
    """One row: Pearson or Spearman correlation; with fewer than two rows or a constant column 1 if all values are close, else 0."""
    x, y = (stats.rank_average(a), stats.rank_average(b)) if rank else (F.col(a), F.col(b))
    t = df.select(F.col(a).alias("a"), F.col(b).alias("b"), x.alias("x"), y.alias("y"))
    close = F.bool_and(F.abs(F.col("a") - F.col("b")) <= 1e-8 + 1e-5 * F.abs("b"))
    flat = (F.count(F.lit(1)) < 2) | (F.max("a") == F.min("a")) | (F.max("b") == F.min("b"))
    r = stats.correlation("x", "y")
    return t.agg(F.when(flat, F.when(F.coalesce(close, F.lit(True)), 1.0).otherwise(0.0)).otherwise(F.when(F.isnan(r) | r.isNull(), 0.0).otherwise(r)).alias("correlation"))


def youden(scored: DataFrame) -> DataFrame:
    """threshold, tpr, fpr and youden of the score with the largest tpr - fpr, the largest of equal ones."""
    c = m.roc_curve(scored).withColumn("youden", F.col("tpr") - F.col("fpr"))
    return c.agg(F.max_by(F.struct("threshold", "tpr", "fpr", "youden"), F.struct("youden", "threshold")).alias("r")).select("r.*")


def bag_lift(scored: DataFrame, item: str, top: float = 0.05) -> DataFrame:
    """One row: share of positives among the top max(1, round half-even(top n)) rows over their share of all."""
    n = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("prevalence")).first()
    k = max(1, round(top * n.n))
    return scored.orderBy(F.desc("score"), item).limit(k).agg((F.avg("label") / F.lit(n.prevalence)).alias("lift"))


def fold_metrics(scored: DataFrame, by: Sequence[str] = ("fold",), threshold: float = 0.5) -> DataFrame:
    """By fold: every confusion metric at the threshold, auc and average precision of scored rows (label, score)."""
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    quads = scored.groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"))
    cols = m.metric_columns(*[F.col(c) for c in ("tp", "tn", "fp", "fn")])
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    return quads.select(*by, *[clean(c).alias(k) for k, c in cols.items()]).join(m.roc_auc(scored, by), list(by)).join(m.average_precision(scored, by), list(by))


# ---- plans


def two_sided(plan: DataFrame, labelled: DataFrame, n_splits: int) -> DataFrame:
    """(repeat, fold) of folds that have both classes in the training and in the test part."""
    plan = plan if "repeat" in plan.columns else plan.withColumn("repeat", F.lit(0))
    roles = folds.with_roles(plan.select("repeat", "fold", "bag_id"), n_splits).join(labelled.select("bag_id", "label"), "bag_id")
    classes = roles.groupBy("repeat", "fold", "role").agg(F.countDistinct("label").alias("k"))
    return classes.groupBy("repeat", "fold").agg(F.count_if(F.col("k") == 2).alias("good")).filter("good = 2").select("repeat", "fold")


def block_width(cells: DataFrame, resolution: float) -> float:
    """Twice the 95th percentile of the bags' diameters, the resolution at least."""
    return max(2 * (stats.bag_diameter(cells).agg(F.percentile("diameter", F.lit(0.95))).first()[0] or 0.0), resolution)


def spatial_plan(cells: DataFrame, n_splits: int, seed: int, width: float) -> tuple[DataFrame, int]:
    """(plan, splits): folds of whole spatial blocks, with the largest number of splits up to n_splits, 2 at least, whose folds all have both
    classes on both sides; raises if there is none."""
    labelled = cells.groupBy("bag_id").agg(F.max("label").alias("label")).join(stats.spatial_groups(cells, width), "bag_id")
    for n in range(n_splits, 1, -1):
        plan = folds.group_fold_plan(labelled, n, seed, "spatial_group")
        if two_sided(plan, labelled, n).count() == n:
            return plan, n
    raise RuntimeError(f"no number of spatial folds from {n_splits} to 2 has both classes on both sides")


# ---- evaluation


def validated(model: DistributionClassifier, cells: DataFrame, n_splits: int = 5, seed: int = 42, stratified: bool = True, plan: DataFrame | None = None, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, metrics by fold, their means and deviations) of cross-validation; a model is fitted for every fold."""
    labelled = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
    plan = folds.fold_plan(labelled, n_splits, 1, seed, stratified).select("fold", "bag_id") if plan is None else plan
    scores = cross_validate(model, cells, plan, n_splits).persist()
    rows = fold_metrics(scores, ("fold",), threshold)
    return scores, rows, folds.aggregate_folds(rows.withColumn("all", F.lit(0)), [c for c in rows.columns if c != "fold"], ["all"]).drop("all")


def heldout(model: DistributionClassifier, cells: DataFrame, fraction: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(scores of the test bags, presence-background metrics) after a stratified split of the bags."""
    labelled = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
    parts = bags.stratified_split(labelled, fraction, seed, at_least_one=True)
    test = parts.filter("role = 'test'").select("bag_id")
    fitted = model.clone().fit(cells.join(test, "bag_id", "left_anti"))
    scored = fitted.predict(cells.join(test, "bag_id", "left_semi")).withColumnRenamed("suitability", "score").join(labelled, "bag_id")
    return scored, m.presence_background(scored)


def mean_embedding(kernel: str = "linear", frequencies: int = 128, **settings: Any) -> DistributionClassifier:
    """An unfitted model of mean random-Fourier embeddings with a linear or Gaussian ('rbf') kernel between bags."""
    if kernel not in ("linear", "rbf"):
        raise ValueError("kernel must be 'linear' or 'rbf'")
    return DistributionClassifier((ModelSpec.m1 if kernel == "linear" else ModelSpec.m2)(frequencies), **settings)


def grid_search(cells: DataFrame, spec: ModelSpec, sigmas: Sequence[float], lams: Sequence[float], n_splits: int = 5, seed: int = 42) -> DataFrame:
    """(sigma, lam, mean_auc) of every combination by cross-validation, best first."""
    rows = []
    for s in sigmas:
        for lam in lams:
            model = DistributionClassifier(spec, sigma=s, lam=lam, auto_sigma=spec.decision == "rbf", seed=seed)
            auc = validated(model, cells, n_splits, seed)[2].first()["mean_auc"]
            rows.append((float(s), float(lam), auc))
    return cells.sparkSession.createDataFrame(rows, "sigma double, lam double, mean_auc double").orderBy(F.desc("mean_auc"), "sigma", "lam")


def invariances(model: DistributionClassifier, cells: DataFrame, seed: int = 7) -> DataFrame:
    """(transformation, max_change): largest change of a fitted model's scores when cells are renamed, all doubled, or some doubled."""
    base = model.predict(cells).withColumnRenamed("suitability", "base")
    forms = {"permute": permuted(cells, seed), "duplicate_all": bags.duplicate_all(cells, 2).drop("copy"), "duplicate_selected": bags.duplicate_selected(cells, 0.25, seed).drop("copy")}
    out = [model.predict(c).join(base, "bag_id").agg(F.max(F.abs(F.col("suitability") - F.col("base"))).alias("max_change")).select(F.lit(k).alias("transformation"), "max_change") for k, c in forms.items()]
    return union_all(out)


def permuted(cells: DataFrame, seed: int) -> DataFrame:
    """cells with the numbers cell_id of each bag in a random order."""
    from terrabag.functions.expressions import hash_key

    n = F.row_number().over(Window.partitionBy("bag_id").orderBy(hash_key(seed, "bag_id", "cell_id"), "cell_id")) - 1
    return cells.withColumn("cell_id", n.cast(dict(cells.dtypes)["cell_id"]))


# ---- experiments


def expand_cases(config: Mapping[str, Any]) -> list[Scenario]:
    """The scenarios of a configuration: every combination of effect, bag size, spatial range and replicate, with a seed of its own."""
    cases = []
    for i, s in enumerate(config["scenarios"]):
        axis = lambda many, one, default, s=s: s.get(many, [s.get(one, default)])
        combos = [(e, b, r) for e in axis("effect_sizes", "effect_size", 0.75) for b in axis("bag_sizes", "bag_size", config.get("bag_size", 30)) for r in axis("spatial_ranges", "spatial_range", 0.0)]
        rest = {k: s[k] for k in ("n_signal_features", "unequal_bag_sizes", "min_bag_size", "max_bag_size", "bags_per_group") if k in s}
        for c, (effect, size, reach) in enumerate(combos):
            for r in range(int(s.get("replicates", config.get("replicates", 1)))):
                seed = int(np.random.SeedSequence([int(config["seed"]), i, c, r]).generate_state(1)[0])
                cases.append(Scenario(scenario=s["scenario"], n_bags_per_class=int(s.get("n_bags_per_class", config.get("n_bags_per_class", 24))), n_features=int(s.get("n_features", config.get("n_features", 3))), bag_size=int(size), effect_size=float(effect), spatial_range=float(reach), seed=seed, **rest))
    return cases


def compare(cells: DataFrame, models: Mapping[str, DistributionClassifier], plan: DataFrame, n_splits: int) -> tuple[DataFrame, DataFrame]:
    """(scores, timings): out-of-fold scores (method, fold, bag_id, label, score) and seconds (method, fold, fit_seconds, predict_seconds)."""
    spark, out, times = cells.sparkSession, [], []
    labelled = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
    for name, model in models.items():
        for fold in range(n_splits):
            test = plan.filter(F.col("fold") == fold).select("bag_id")
            began = time.perf_counter()
            fitted = model.clone().fit(cells.join(test, "bag_id", "left_anti"))
            middle = time.perf_counter()
            got = fitted.predict(cells.join(test, "bag_id", "left_semi")).persist()
            got.count()
            times.append((name, fold, middle - began, time.perf_counter() - middle))
            out.append(got.join(labelled, "bag_id").select(F.lit(name).alias("method"), F.lit(fold).alias("fold"), "bag_id", "label", F.col("suitability").alias("score")))
    return union_all(out), spark.createDataFrame(times, "method string, fold int, fit_seconds double, predict_seconds double")


def run_case(spark: SparkSession, case: Scenario, models: Mapping[str, DistributionClassifier], n_splits: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pooled rows, metrics): out-of-fold scores of all methods on one synthetic case, and by method auc, average precision and lift."""
    cells = synthetic_bags(spark, case)
    labelled = cells.groupBy("bag_id").agg(F.max("label").alias("label"), F.max("group_id").alias("group_id"))
    plan = folds.group_fold_plan(labelled, n_splits, case.seed % 2**31) if case.bags_per_group > 1 else folds.fold_plan(labelled, n_splits, 1, case.seed % 2**31)
    rows, _ = compare(cells, models, plan.select("fold", "bag_id"), n_splits)
    return rows, fold_metrics(rows, ("method",)).select("method", "auc", "average_precision", "sensitivity", "specificity")


def run_lab(spark: SparkSession, config: Mapping[str, Any], models: Mapping[str, DistributionClassifier], n_splits: int = 3) -> DataFrame:
    """Metrics of every case of a configuration by method."""
    out = []
    for i, case in enumerate(expand_cases(config)):
        _, got = run_case(spark, case, models, n_splits)
        out.append(got.select(F.lit(i).alias("case"), F.lit(case.scenario).alias("scenario"), F.lit(case.effect_size).alias("effect_size"), F.lit(case.bag_size).alias("bag_size"), "*"))
    return union_all(out)


def with_agreement(rows: DataFrame, reference: str = "M0", other: str = "M1") -> DataFrame:
    """One row: score_agreement of two methods on the bags that both scored (method, fold, bag_id, score)."""
    of = lambda n, c: rows.filter(F.col("method") == n).select("fold", "bag_id", F.col("score").alias(c))
    return m.score_agreement(of(reference, "a").join(of(other, "b"), ["fold", "bag_id"]), "bag_id", "a", "b")


def converged(old: np.ndarray, new: np.ndarray, tol: float) -> bool:
    """Whether no coefficient moved by tol or more."""
    return bool(np.max(np.abs(np.asarray(new) - np.asarray(old)), initial=0.0) < tol)


def irls_weights(p: np.ndarray, floor: float = 1e-7) -> np.ndarray:
    """p (1 - p) with p kept off 0 and 1."""
    p = np.clip(p, floor, 1 - floor)
    return p * (1 - p)


def with_seed(case: Scenario, seed: int) -> Scenario:
    return replace(case, seed=seed)
