"""Fold plans with and without groups, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrabag.functions.expressions import hash_key


def fold_plan(bags: DataFrame, n_splits: int, n_repeats: int, seed: int, stratified: bool = True) -> DataFrame:
    """(repeat, fold, bag_id): each bag in one test fold of every repeat, folds of equal size within each label if stratified."""
    r = bags.select("bag_id", "label", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    by = ["repeat", "label"] if stratified else ["repeat"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", (F.lit(seed) + F.col("repeat")).cast("string"), F.col("bag_id").cast("string"))), "bag_id")) - 1
    return r.select("repeat", (rank % n_splits).cast("int").alias("fold"), "bag_id")


def group_fold_plan(bags: DataFrame, n_splits: int, seed: int, group: str = "group_id") -> DataFrame:
    """(fold, bag_id): the bags of a group share a fold; groups are dealt in a random order, snake-wise from large to small."""
    g = bags.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), hash_key(seed, group))) - 1
    turn, place = F.floor(rank / n_splits), rank % n_splits
    dealt = g.select(group, F.when(turn % 2 == 0, place).otherwise(n_splits - 1 - place).cast("int").alias("fold"))
    return bags.join(dealt, group).select("fold", "bag_id", group)


def with_roles(plan: DataFrame, n_splits: int) -> DataFrame:
    """plan for every fold with role 'test' or 'train'."""
    every = plan.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return every.withColumn("role", F.when(F.col("own") == F.col("fold"), "test").otherwise("train")).drop("own")


def coverage(plan: DataFrame, bags: DataFrame) -> DataFrame:
    """By repeat: bags tested, bags in all, bags tested more than once, folds with one class only in test."""
    seen = plan.groupBy("repeat", "bag_id").agg(F.count(F.lit(1)).alias("k"))
    one = plan.join(bags.select("bag_id", "label"), "bag_id").groupBy("repeat", "fold").agg(F.countDistinct("label").alias("classes")).groupBy("repeat").agg(F.count_if(F.col("classes") < 2).alias("one_class_folds"))
    return seen.groupBy("repeat").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("k") > 1).alias("repeated")).join(one, "repeat")


def leaks(plan: DataFrame, bags: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups whose bags are in more than one test fold of a repeat."""
    return plan.join(bags.select("bag_id", group), "bag_id").groupBy("repeat", group).agg(F.countDistinct("fold").alias("folds")).filter("folds > 1")


def aggregate_folds(rows: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds, leaving out what isn't finite, and the first fold of the best auc."""
    clean = lambda m: F.when(F.isnan(m) | (F.abs(m) == float("inf")), None).otherwise(F.col(m))
    aggs = [x for m in metrics for x in (F.avg(clean(m)).alias(f"mean_{m}"), F.stddev_pop(clean(m)).alias(f"std_{m}"))]
    return rows.groupBy(*by).agg(*aggs, F.max_by("fold", F.struct(F.col("auc"), -F.col("fold"))).alias("best_fold"))
