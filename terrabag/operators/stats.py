"""Aggregates over the cells of bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrabag.storage import materialize


def _component(i: int) -> Column:
    return F.element_at("features", i + 1)


def zscore_stats(cells: DataFrame, d: int, floor: float = 1e-12) -> DataFrame:
    """One row: population mean and deviation of every feature over all cells; deviations under `floor` count as 1."""
    aggs = []
    for i in range(d):
        s = F.stddev_pop(_component(i))
        aggs += [F.avg(_component(i)).alias(f"mean_{i}"), F.when(s < floor, 1.0).otherwise(s).alias(f"scale_{i}")]
    return cells.agg(*aggs)


def zscore(cells: DataFrame, d: int, stats: DataFrame | None = None) -> DataFrame:
    """cells with standardised features; every other column stays. `stats` has one row, so it is broadcast."""
    stats = zscore_stats(cells, d) if stats is None else stats
    met = cells.crossJoin(F.broadcast(stats))
    scaled = F.array(*[(_component(i) - F.col(f"mean_{i}")) / F.col(f"scale_{i}") for i in range(d)])
    return met.withColumn("features", scaled).select(*cells.columns)


def column_scaling(df: DataFrame, columns: Sequence[str], sample: bool = False) -> DataFrame:
    """One row of mean_<c> and std_<c>; a deviation of exactly 0 counts as 1. sample: divide by n - 1."""
    dev = F.stddev_samp if sample else F.stddev_pop
    return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.when(dev(c) == 0, 1.0).otherwise(dev(c)).alias(f"std_{c}"))])


def bag_means(cells: DataFrame, d: int, deviations: bool = False) -> DataFrame:
    """Mean (and population deviation) of every feature for each bag."""
    aggs = [F.avg(_component(i)).alias(f"mean_{i}") for i in range(d)]
    if deviations:
        aggs += [F.stddev_pop(_component(i)).alias(f"std_{i}") for i in range(d)]
    return cells.groupBy("bag_id").agg(*aggs)


def bag_geometry(cells: DataFrame) -> DataFrame:
    """log(1 + n) and log(1 + diagonal of the bounding box) of each bag."""
    return cells.groupBy("bag_id").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("log_n"), F.log1p(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("log_extent"))


def bag_diameter(cells: DataFrame) -> DataFrame:
    """Diagonal of each bag's bounding box."""
    return cells.groupBy("bag_id").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diameter"))


def centroids(cells: DataFrame, key: str = "bag_id") -> DataFrame:
    """Mean coordinates by key."""
    return cells.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def size_distribution(cells: DataFrame) -> DataFrame:
    """Number, least, median, largest and mean size of bags."""
    sizes = cells.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("bags"), F.min("n").alias("min_n"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"))


def spatial_groups(cells: DataFrame, width: float) -> DataFrame:
    """Group id "i:j" of the square block of `width` in which a bag's centroid lies, counted from the least centroid."""
    c = centroids(cells)
    origin = c.agg(F.min("cx").alias("ox"), F.min("cy").alias("oy"))  # one row
    block = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.lit(width)).cast("string")
    return c.crossJoin(F.broadcast(origin)).select("bag_id", F.concat_ws(":", block("cx", "ox"), block("cy", "oy")).alias("spatial_group"))


def bounding_box(cells: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row xmin, xmax, ymin, ymax, widened by a fraction of the extent."""
    b = cells.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    w, h = (F.col("b") - F.col("a")) * F.lit(margin), (F.col("d") - F.col("c")) * F.lit(margin)
    return b.select((F.col("a") - w).alias("xmin"), (F.col("b") + w).alias("xmax"), (F.col("c") - h).alias("ymin"), (F.col("d") + h).alias("ymax"))


def restrict_to_background(cells: DataFrame, margin: float = 0.0) -> DataFrame:
    """Cells inside the closed bounding box of the background cells (label 0)."""
    box = bounding_box(cells.filter("label = 0"), margin)
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return cells.crossJoin(F.broadcast(box)).filter(inside).select(*cells.columns)


def domain_info(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells and presence bags before and after a restriction, and those dropped."""
    count = lambda df, tag: df.agg(F.count(F.lit(1)).alias(f"cells_{tag}"), F.countDistinct(F.when(F.col("label") == 1, F.col("bag_id"))).alias(f"sites_{tag}"))
    return count(before, "before").crossJoin(F.broadcast(count(after, "after"))).withColumn("cells_dropped", F.col("cells_before") - F.col("cells_after")).withColumn("sites_dropped", F.col("sites_before") - F.col("sites_after"))


def upper_triangle(values: DataFrame) -> DataFrame:
    """Pairs i < j of a matrix in coordinate form."""
    return values.filter("bag_i < bag_j")


def mirror(upper: DataFrame, value: str) -> DataFrame:
    """The whole symmetric matrix from its upper triangle with the diagonal."""
    return upper.unionByName(upper.filter("bag_i < bag_j").select(F.col("bag_j").alias("bag_i"), F.col("bag_i").alias("bag_j"), value))


#: Rows up to which one task orders them all.
ONE_TASK = 1_000_000


def running_sums(rows: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """rows with run_<value>: the sum of each value from the first row by `order` to the row itself. No two rows have equal places.

    Beyond ONE_TASK rows, ranges of the order are sorted each in a task of its own, and what earlier ranges hold is added from a table of
    one row a range.
    """
    if rows.count() <= ONE_TASK:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(v).over(w).alias(f"run_{v}") for v in values])
    # Written once: bounds of ranges are sampled anew each time that a plan runs.
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values])
    held = held.select("__range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__before_{v}") for v in values])
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(held), "__range")
    return met.select(*rows.columns, *[(F.col(f"__before_{v}") + F.sum(v).over(w)).alias(f"run_{v}") for v in values])


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation; null where either column is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def rank_average(by: str | Column, partition: Sequence[str] = ()) -> Column:
    """Average rank from 1 on, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*partition).orderBy(by)
    same = Window.partitionBy(*partition, by)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0
